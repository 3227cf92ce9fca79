"""Quoted history, signatures and notices in mail bodies: keep only what the sender newly wrote.

Multilingual line rules (en, de, fr, es, pt). Lines are judged in the body as it stands; runs of
characters outside ASCII are folded to one mark before words are compared, so the rules also hold in
garbled text. A marked quotation ends with its marks, so replies between quotations are kept. Indented lines
are a quotation only after an attribution or beside marked lines, and letters before a ``>`` are a mark only
as initials. An attribution without marked lines after it, a header block or a second greeting opens earlier
mail, which runs to the end of the body. A closing, a signature or a device line opens a signature: it counts
only if the end, a quotation, a rule, a notice or short lines that are no sentences come next, and a
reply written below a quotation after it is new text again. A sentence like a notice within a text, with new
sentences after it, is a notice only if it speaks of the message itself.

Edge cases: null and empty bodies have no lines; blank lines are never reported; a line that holds only a
quote mark is quotation; '\\r' before the line feed is ignored; bodies of any length are read once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.session import spread

# Closing formulas, device lines, attribution verbs, header names and notice phrases, folded
# (lower case, each run of characters outside ASCII as ~).
CLOSINGS = (
    "best regards|kind regards|warm regards|regards|best wishes|all the best|best|many thanks|thanks|thank you|"
    "thanks again|cheers|sincerely|yours sincerely|yours faithfully|yours truly|yours|with best wishes|take care|"
    "viele gr~e|mit freundlichen gr~en|mit besten gr~en|freundliche gr~e|beste gr~e|liebe gr~e|herzliche gr~e|"
    "gru~|gr~e|vg|mfg|lg|danke|vielen dank|besten dank|sch~ne gr~e|"
    "cordialement|bien cordialement|bien ~ vous|merci et ~ bient~t|~ bient~t|merci|merci d~avance|amicalement|"
    "salutations|sinc~res salutations|bonne journ~e|"
    "saludos cordiales|saludos|un saludo|un cordial saludo|atentamente|gracias|muchas gracias|un abrazo|"
    "obrigado|obrigada|muito obrigado|muito obrigada|cumprimentos|com os melhores cumprimentos|melhores cumprimentos|"
    "atenciosamente|abra~o|um abra~o|at~ breve"
)
DEVICES = (
    r"sent from my|sent via|sent with|typed on|written on my|get \w+ for|"
    r"von unterwegs|von meinem \S+ gesendet|gesendet von|gesendet mit|"
    r"envoy~ depuis|envoy~ de mon|enviado desde|enviado do|enviado de|enviado pelo|enviado a partir"
)
GREETINGS = (
    r"dear|hi|hello|hey|morning|good morning|good afternoon|good evening|greetings|"
    r"liebe|lieber|hallo|guten tag|guten morgen|moin|sehr geehrte|sehr geehrter|servus|"
    r"bonjour|salut|cher|ch~re|chers|ch~res|bonsoir|"
    r"hola|buenos d~as|buenas tardes|buenas|estimado|estimada|estimados|querido|querida|"
    r"ol~|bom dia|boa tarde|boa noite|caro|cara|caros|caras|prezado|prezada|prezados"
)
SAID = (
    r"wrote|writes|said|says|wrote the following|schrieb|schreibt|hat geschrieben|geschrieben|a ~?crit|~crivait|~crit|"
    r"escribi~|escribe|ha escrito|escreveu|escreve"
)
HEADERS = (
    r"from|to|cc|bcc|sent|date|subject|reply-to|von|an|kopie|gesendet|datum|betreff|"
    r"de|~|envoy~|date|objet|copie|para|enviado|enviada|enviado el|enviada em|fecha|data|asunto|assunto"
)
FORWARDS = (
    r"original message|forwarded message|begin forwarded message|urspr~ngliche nachricht|weitergeleitete nachricht|"
    r"message d~origine|message transf~r~|d~but du message|mensaje original|mensaje reenviado|"
    r"mensagem original|mensagem encaminhada|mensagem reencaminhada"
)
NOTICES = (
    r"accepts? no (?:liability|responsibility)|(?:meant|intended) (?:only|solely) for|reached you by (?:mistake|error)|"
    r"received (?:this|it) (?:by mistake|in error)|^confidential\b|passing on or copying|delete (?:every|all) cop|"
    r"mail traffic may be|views (?:given|expressed)|(?:think|environment) before (?:you )?print|as the law requires|"
    r"privileged|haftet nicht f|nur f~r den genannten|irrt~mlich erhalten|l~schen sie alle|vertraulich|"
    r"r~serv~ (?:~ )?son destinataire|d~cline toute responsabilit|confidentiel|re~u par erreur|"
    r"es confidencial|va dirigido solo|no responde de los da|no se hace responsable|recibido por error|"
    r"destina-se apenas|~ confidencial|n~o se responsabiliza|n~o responde|recebeu por engano|"
    r"bevor sie diese mail drucken|avant d~imprimer|antes de imprimir"
)

_FOLD = re.compile(r"[^\x00-\x7f]+")
_SAID = re.compile(rf"(?:^|[\s>,;])(?:{SAID})(?:\s|:|$)")
_HEADER = re.compile(rf"(?:{HEADERS}) ?:(?: |$)")
_SHORT = re.compile(
    rf"(?P<closing>(?:{CLOSINGS})[ ]?[,.!]?$)|(?P<device>(?:{DEVICES})\b)|(?P<sender>(?:from|von|de) ?:(?: |$))|"
    rf"(?P<forward>(?:[-_=* ]{{2,}} ?)?(?:{FORWARDS})(?: ?[-_=* ]{{2,}})?:?$)|(?P<sign>(?:--|__|_|~)$)|(?P<rule>(?:[-_*=~#+.] ?){{2,}}$)"
)
_NOTICE = re.compile(NOTICES)
#: A body without any of these holds no notice; each alternative of NOTICES contains one.
_NOTICE_STEMS = (
    "accept", "only for", "solely for", "reached you", "received", "confiden", "passing on", "delete", "traffic", "views ",
    "before", "as the law", "privileged", "haftet", "nur f~r", "irrt~mlich", "alle", "vertraulich", "destinataire",
    "toute responsabilit", "par erreur", "va dirigido", "no responde", "no se hace", "por error", "destina-se", "responsabiliza",
    "n~o responde", "engano", "drucken", "imprim",
)
#: Longest line of a greeting, closing or header; of a line of a signature; head of an attribution that has neither date nor address;
#: whole attribution (over three lines at most); a first line without any of its signs; in characters.
SHORT_LINE, SIGNATURE_LINE, ATTRIBUTION_HEAD, ATTRIBUTION, ATTRIBUTION_START = 80, 48, 60, 220, 60
#: A line of new text below a quotation has at least this many characters, or ends like a sentence.
REPLY_LINE = 30
_MARK_STARTS = frozenset(" \t>|\u00bbABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_MARK = re.compile(r"^\s{0,3}(?:>|[A-Z]{1,3}>(?=[\s>|]|$)|\|(?=\s|$)|»)")
_INDENT = re.compile(r"^(?:\t| {4})")
# What a notice that stands within a text says of itself, folded.
_ITSELF = re.compile(r"\b(?:th(?:is|e) (?:e-?mail|mail|message)|dies(?:e|er) (?:e-?mail|mail|nachricht)|ce (?:message|courriel)|est(?:e|a) (?:mensaje|correo|mensagem|e-?mail)|confiden|vertraulich|recipient|empf~nger|destinat)")
_GREETING = re.compile(rf"(?:(?:{GREETINGS})(?:[ ,][^.!?]{{0,50}})?|[a-z~]+(?:[- ][a-z~.]+){{0,3}}) ?[,:]$|(?:{GREETINGS})(?: [^.!?,:]{{1,30}})?[!]?$")
_DATE = re.compile(r"\d{1,4}[-./]\d{1,2}[-./]\d{2,4}|\d{1,2}:\d\d")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*\.?")
_ENDS = re.compile(r"[.!?:;,…)\"”»]$")


def _fold(line: str) -> str:
    return _FOLD.sub("~", line).lower()


def _attribution(folded: list[str], i: int) -> int:
    """Number of lines (1 to 3) of an attribution that starts at line i; 0 if none does."""
    line = folded[i]
    if not line:
        return 0
    text = line
    for n in range(1, 4):
        if text.endswith(":"):
            if not _SAID.search(text):
                return 0
            head = text[: -1].strip()
            if "@" in head or _DATE.search(head) or len(head) < ATTRIBUTION_HEAD and re.search(rf"(?:{SAID})$", head):
                return n
            return 0
        if i + n >= len(folded) or not folded[i + n]:
            return 0
        if n == 1 and not ("@" in line or _DATE.search(line) or line.startswith(("on ", "at ", "am ", "le ", "el ", "em ", "a "))) and len(line) > ATTRIBUTION_START:
            return 0
        text = text + " " + folded[i + n]
        if len(text) > ATTRIBUTION:
            return 0
    return 0


def _name_words(sender: str | None) -> set[str]:
    return {w.strip(".").lower() for w in _WORD.findall((sender or "").split("@")[0] + " " + (sender or ""))}


_CODE = re.compile(r"[{}()=\[\]_$#\\;]|^[-*+\d]")


def _letter_like(plain: str, folded: str) -> bool:
    """Whether an indented line reads like mail rather than like code, a list or a table: a sentence of six words, a greeting, closing or header."""
    if len(plain.split()) >= 6:
        return not _CODE.search(plain)
    return bool(_GREETING.match(folded) or _SHORT.match(folded) or _HEADER.match(folded))


def _marks(lines: list[str], plain: list[str], folded: list[str]) -> list[bool]:
    """Which lines carry a quotation's mark. Indented lines do if a block of them reads like mail, or stands after an attribution or beside marked lines."""
    n = len(lines)
    out = [bool(x) and x[0] in _MARK_STARTS and _MARK.match(x) is not None for x in lines]
    if not any(x[:1] == "\t" or x[:4] == "    " for x in lines):
        return out
    blocks, like_mail, i = [], False, 0
    while i < n:
        if out[i] or not plain[i] or not _INDENT.match(lines[i]):
            i += 1
            continue
        k = i
        while k < n and (not plain[k] or _INDENT.match(lines[k])) and not out[k]:
            k += 1
        b = i - 1
        while b >= 0 and not plain[b]:
            b -= 1
        said = b >= 0 and plain[b][-1] == ":" and any(_attribution(folded, x) == b - x + 1 for x in range(max(0, b - 2), b + 1))
        beside = said or b >= 0 and out[b] or k < n and out[k]
        # a first line set in, with the rest of its paragraph not, is no quotation
        alone = k == i + 1 and k < n and plain[k]
        like_mail = like_mail or not alone and any(plain[x] and _letter_like(plain[x], folded[x]) for x in range(i, k))
        blocks.append((i, k, beside))
        i = k
    for i, k, beside in blocks:
        if beside or like_mail:
            for x in range(i, k):
                out[x] = bool(lines[x])
    return out


def foreign_lines(body: str | None, sender: str | None = None) -> list[int]:
    """Numbers (from 1) of the non-blank lines that the sender did not newly write."""
    if not body:
        return []
    lines = body.split("\n")
    plain = [x.strip() for x in lines]
    text = _fold(body)
    folded = [x.strip() for x in text.split("\n")]
    marked = _marks(lines, plain, folded)
    notices = any(x in text for x in _NOTICE_STEMS)
    n = len(lines)
    out = [False] * n
    names: set[str] | None = None
    fresh = False  # new text other than a greeting was seen
    kept = 0  # lines of new text so far
    signed = False  # within a signature
    quoted = False  # the last line that was not blank is marked
    i = 0
    while i < n:
        here = plain[i]
        if not here:
            i += 1
            continue
        if marked[i]:
            out[i] = quoted = True
            i += 1
            continue
        below, quoted = quoted, False
        line = folded[i]
        short = len(here) <= SHORT_LINE
        kind = _SHORT.match(line) if short else None
        if short and (fresh or signed) and not plain[i - 1] and here[-1] in ",:!" and not (kind and kind.lastgroup == "closing") and _GREETING.match(line):
            break  # a second greeting: earlier mail without marks
        if here[-1] == ":" or "".join(plain[i + 1 : i + 3]).find(":") >= 0:
            k = _attribution(folded, i)
            if k:
                j = i + k
                out[i:j] = [True] * k
                while j < n and not plain[j]:
                    j += 1
                i += k
                if j < n and not marked[j]:
                    break
                continue
        if kind:
            what = kind.lastgroup
            if what == "forward" or what == "sender" and i + 1 < n and _HEADER.match(folded[i + 1]):
                break
            if what in ("closing", "device", "sign") and (signed or what != "closing" or _closes(plain, folded, marked, i + 1)):
                signed = out[i] = True
                i += 1
                continue
            if what == "rule":
                signed = signed or _opens_tail(folded, plain, marked, i + 1)
                out[i] = True
                i += 1
                continue
        if notices and _NOTICE.search(line):
            end = i + 1
            while end < n and plain[end] and not marked[end]:
                end += 1
            if signed or not kept or _ends_here(plain, folded, marked, end) or any(_ITSELF.search(x) for x in folded[i:end]):
                start = i
                out[i:end] = [True] * (end - i)
                # the notice may have begun on the lines before, after the end of a sentence
                while start > 0 and plain[start - 1] and not marked[start - 1] and not out[start - 1] and not _ENDS.search(plain[start - 1]):
                    start -= 1
                    out[start] = True
                    kept -= 1
                if kept and _ends_here(plain, folded, marked, end):
                    signed = True  # a notice ends its sender's text, unless it stands before or within it
                i = end
                continue
        if signed:
            if not below or not (len(here) >= REPLY_LINE or here[-1] in ".!?"):
                out[i] = True
                i += 1
                continue
            signed = False  # a reply below a quotation
        if short and len(here) <= SIGNATURE_LINE and here[-1] not in ".,:;?!":
            if names is None:
                names = _name_words(sender)
            if _signature_line(plain, marked, i, names):
                signed = out[i] = True
                i += 1
                continue
        fresh = fresh or not (short and _GREETING.match(line))
        kept += 1
        i += 1
    out[i:] = [True] * (n - i)
    return [i + 1 for i in range(n) if out[i] and plain[i]]


def _next_line(plain: list[str], i: int) -> int:
    while i < len(plain) and not plain[i]:
        i += 1
    return i


def _closes(plain: list[str], folded: list[str], marked: list[bool], i: int) -> bool:
    """Whether a closing formula before line i is one: a name, the end, a quotation, a rule or a notice comes next, no sentence."""
    j = _next_line(plain, i)
    if j >= len(plain) or marked[j]:
        return True
    here = plain[j]
    kind = _SHORT.match(folded[j]) if len(here) <= SHORT_LINE else None
    if kind or _NOTICE.search(folded[j]) or _attribution(folded, j):
        return True
    return len(here) <= SIGNATURE_LINE and here[-1] not in ".!?;" or here[-1] in ",:!" and _GREETING.match(folded[j]) is not None


def _ends_here(plain: list[str], folded: list[str], marked: list[bool], i: int) -> bool:
    """Whether no new sentence follows from line i on: the end, a quotation, earlier mail or short lines come next."""
    j = _next_line(plain, i)
    if j >= len(plain) or marked[j]:
        return True
    here = plain[j]
    if len(here) > SHORT_LINE:
        return _attribution(folded, j) > 0 or _NOTICE.search(folded[j]) is not None
    return bool(_SHORT.match(folded[j]) or _GREETING.match(folded[j]) or _attribution(folded, j) or _NOTICE.search(folded[j])) or len(here) <= SIGNATURE_LINE and here[-1] not in ".!?;,"


def _opens_tail(folded: list[str], plain: list[str], marked: list[bool], i: int) -> bool:
    """Whether a rule before line i sets off a signature or a header block rather than parts of new text."""
    for j in range(i, min(i + 3, len(plain))):
        if not plain[j]:
            continue
        if marked[j]:
            return False
        return bool(_HEADER.match(folded[j])) or len(plain[j].split()) <= 4 and not _ENDS.search(plain[j])
    return True


def _signature_line(plain: list[str], marked: list[bool], i: int, names: set[str]) -> bool:
    """A line that is only the sender's name, or only a name at the end of a paragraph."""
    words = _WORD.findall(plain[i])
    if not 1 <= len(words) <= 4 or "".join(words) != re.sub(r"[\s,]+", "", plain[i]) or plain[i].endswith(","):
        return False
    last = i + 1 >= len(plain) or not plain[i + 1] or marked[i + 1] or not re.search(r"[.!?]$", plain[i + 1])
    if all(w.strip(".").lower() in names for w in words):
        return last
    if i == 0 or not all(w[0].isupper() for w in words):
        return False
    before = plain[i - 1]
    return last and bool(re.search(r"[.!?”\"»)]$", before)) and not marked[i - 1]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [foreign_lines(t, s) for t, s in zip(b["body"].to_pylist(), b["sender"].to_pylist())]
        yield pa.RecordBatch.from_arrays([b["message_id"], pa.array(found, pa.list_(pa.int64()))], ["message_id", "lines"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for body, sender in zip(b["body"].to_pylist(), b["sender"].to_pylist()):
            if body is None:
                texts.append(None)
                continue
            drop = set(foreign_lines(body, sender))
            kept = "\n".join(x.rstrip("\r") for i, x in enumerate(body.split("\n"), 1) if i not in drop)
            texts.append(re.sub(r"\n(?:[ \t]*\n){2,}", "\n\n", kept).strip())
        yield pa.RecordBatch.from_arrays([b["message_id"], pa.array(texts, pa.string())], ["message_id", "new_text"])


def foreign_line_numbers(documents: DataFrame) -> DataFrame:
    """message_id, line_no of the lines the sender did not newly write; repeated documents count once."""
    return (
        spread(documents.select("message_id", "body", "sender"))
        .mapInArrow(_found, "message_id string, lines array<bigint>")
        .filter(F.size("lines") > 0)
        .groupBy("message_id")
        .agg(F.array_distinct(F.flatten(F.collect_set("lines"))).alias("lines"))
        .select("message_id", F.explode("lines").alias("line_no"))
    )


def newly_written(documents: DataFrame) -> DataFrame:
    """message_id, new_text: the body without quotation, signature and notices; one row per input row."""
    return spread(documents.select("message_id", "body", "sender")).mapInArrow(_kept, "message_id string, new_text string")
