"""Personal information in free text: find it and put typed placeholders in its place.

Candidate gradient boosting. Generators of high recall propose spans by their form alone, and the spans may
overlap: everything around an at sign or spelt out like one, runs of digits, small numbers beside
capitalised words, every two neighbouring words that are capitalised (with a middle initial, a comma, or one
line break between), an initial and a word, two words before an address, and pairs in lower case where the
record's own addresses or a list of given names speak for one of them. No list decides what is proposed
among capitalised words. Boosted trees, one model per kind, judge each candidate by format and context: the
shapes of the words, what stands before and after, whether a word also occurs in lower case in the same text,
whether the record's addresses hold it, and a public list of given names as one feature of many. The
thresholds are those with the best F1 on rows kept apart. Of overlapping spans the most probable stays. The
models are fitted when first needed, from examples composed in ``personal_training`` (a fixed seed and a
fixed number of rows), in a few seconds, on the driver; they go to the workers with the task.

Candidates read over line breaks and quote marks. Kinds: email, phone, id_number, street_address, person_name.

Edge cases: null and empty texts have none; texts of any length are read whole; repeated documents count
once in ``found_kinds``; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.boosting import Boosted
from postmill.session import materialise, spread

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street_address": "[ADDRESS]", "person_name": "[PERSON]"}

# Frequent given names of several countries. One feature of the model; no gate.
GIVEN_NAMES = frozenset(
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah "
    "Charles Karen Daniel Nancy Matthew Lisa Anthony Betty Mark Margaret Paul Sandra Steven Ashley Andrew Emily Kenneth Donna Joshua "
    "Michelle George Carol Kevin Amanda Brian Melissa Edward Deborah Ronald Stephanie Timothy Rebecca Jason Laura Jeffrey Helen Ryan "
    "Anna Peter Hans Klaus Jürgen Wolfgang Dieter Manfred Uwe Günter Horst Bernd Ursula Monika Petra Sabine Renate Helga Karin Brigitte "
    "Andrea Claudia Lukas Leon Jonas Lena Hannah Jean Pierre Jacques Philippe Nicolas Julien Laurent Christophe François Nathalie "
    "Isabelle Sylvie Catherine Martine Sophie Camille Chloé Antonio José Manuel Francisco Javier Carlos Miguel Rafael Pedro Pablo Carmen "
    "María Josefa Isabel Dolores Pilar Lucía Paula Marta João Luís Paulo Rui Tiago Nuno Ana Maria Inês Beatriz Teresa Fernanda Marco "
    "Giulia Luca Giovanni Francesca Erik Lars Sven Ingrid Astrid Anders Olga Ivan Dmitri Katarzyna Piotr Aleksandra Mehmet Ayşe".split()
)
# Words that belong to no name, by language: articles, pronouns, prepositions, conjunctions, auxiliaries, what opens
# and closes a letter, header names, days and months.
OTHER_WORDS = frozenset(
    (
        "the a an and or but nor so if then than of to in on at by for from with into about over under after before until since while when "
        "where why how what which who whom whose that this these those there here it its he his him she her they their them we our us you "
        "your i my me is are was were be been has have had do does did will would shall should can could may might must not no yes please "
        "all both each some any nothing everything nobody everybody only also just still again now today tomorrow yesterday dear hi hello "
        "hey good morning afternoon evening thanks thank regards best kind wishes cheers sincerely yours sent subject cc bcc re fwd date reply "
        "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december "
    ).split()
    + (
        "der die das den dem des ein eine einen einem einer und oder aber denn wenn falls weil dass von vom zu zum zur im in am an auf aus bei mit "
        "nach vor für über unter seit bis um ohne gegen durch ich du er sie es wir ihr mich mir uns ihnen mein dein sein unser diese dieser dieses ist "
        "sind war waren wird werden wurde hat haben kann können soll muss bitte nicht kein keine alle beide auch noch nur schon hier dort heute morgen "
        "liebe lieber hallo guten tag sehr geehrte geehrter viele beste freundliche freundlichen herzliche grüße gruß grüßen danke betreff gesendet datum "
        "schrieb schreibt montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar märz mai juni juli oktober dezember nord süd ost"
    ).split()
    + (
        "le la les un une des du de et ou mais donc car si que qui dont où quand comme pour par avec sans sur sous dans chez vers avant après depuis "
        "je tu il elle nous vous ils elles on mon ma mes son sa ses notre votre leur ce cet cette ces est sont était ont avez merci ne pas plus tous "
        "toutes déjà encore aussi bonjour bonsoir salut cher chère chers chères cordialement bien objet envoyé écrit lundi mardi mercredi jeudi vendredi "
        "samedi dimanche janvier février mars avril juin juillet août septembre octobre novembre décembre nord sud ouest"
    ).split()
    + (
        "el los las una unos unas y e o pero porque aunque cuando como para por con sin sobre entre hasta desde hacia según al del su sus mi mis nuestro "
        "este esta estos estas ese esa es son era fue han ha hay está están no sí ya muy más también todavía hoy ayer mañana hola buenos buenas días "
        "tardes estimado estimada querido querida gracias saludos saludo cordiales atentamente asunto enviado fecha escribió lunes martes miércoles jueves "
        "viernes sábado domingo enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre norte oeste"
    ).split()
    + (
        "os as um uma uns umas em no na nos nas ao à aos às do da dos das pelo pela com sem até mas porém quando onde quem seu sua nosso nossa isto isso "
        "esse essa foi são está estão tem têm há não sim já mais muito também ainda hoje ontem amanhã olá bom boa dia tarde noite caro cara caros obrigado "
        "obrigada cumprimentos abraço atenciosamente assunto enviada data escreveu segunda terça quarta quinta sexta janeiro fevereiro março maio junho "
        "julho setembro outubro novembro dezembro norte sul"
    ).split()
)
#: Articles and the like before a word: a name hardly follows them.
_ARTICLES = frozenset("the a an this that our your der die das den dem des ein eine einem einer unser le la les un une des du ce cette notre votre el los las una del al este esta nuestro o os as um uma do da dos das no na ao esta este im am zum zur vom beim".split())
# Endings of ordinary derived words, and of frequent family names, in several languages.
# Words of function mailboxes.
ROLE_WORDS = frozenset(
    "team support service services office desk admin administration info information sales billing account accounts bot robot notice notices notification notifications alert "
    "alerts news newsletter digest list lists monitor system help helpdesk reception booking orders shipping press media jobs careers marketing legal finance webmaster postmaster "
    "management control center centre department group committee mail mailer postmaster gateway server build updates records customer customers staff parcel delivery purchasing planning "
    "kundendienst vertrieb buchhaltung büro verwaltung abteilung versand einkauf accueil bureau direction comptabilité achats ventas oficina soporte compras vendas escritório suporte equipe équipe equipo equipa".split()
)
_WORD_ENDINGS = re.compile(
    r"(?:ing|tion|sion|ment|ness|ity|ance|ence|ship|able|ible|ful|less|ous|ive|ly|ies|ics|ers|ings|tions|ments|ung|ungen|heit|keit|schaft|tät|lich|isch|"
    r"erung|nis|tum|eur|euse|ique|ité|iques|ación|ciones|ción|dad|idad|miento|mente|ções|ção|dade|agem|mento)$"
)
_FAMILY_ENDINGS = re.compile(r"(?:son|sen|ton|ley|ford|man|mann|berg|stein|feld|bach|meyer|ez|es|eau|elli|ini|ski|ska|ov|ova|eira|inho|oux|ard|ier|er|er)$")

_ODD = re.compile(r"[^\x00-\x7f]+")
_OTHER = frozenset(_ODD.sub("~", w) for w in OTHER_WORDS)
_GIVEN_FOLDED = frozenset(_ODD.sub("~", w.lower()) for w in GIVEN_NAMES if len(_ODD.sub("", w)) > 2)
_SKIPPED = frozenset(f for w in OTHER_WORDS for f in (w.capitalize(), w.upper()))
_GIVEN_LOWER = frozenset(w.lower() for w in GIVEN_NAMES)
_BREAK = re.compile(r"\r?\n(?:[>|\s]|[A-Z]{1,3}(?=>))*")
_QUOTES = "“”‘’«»„\"'-—–…¡¿☎"


def _is_other(low: str) -> bool:
    """Whether a word in lower case is a function word, garbled or not."""
    return low in OTHER_WORDS or not low.isascii() and _ODD.sub("~", low) in _OTHER


# --- generators -------------------------------------------------------------------------------------------------------

_EMAIL = re.compile(
    r"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]{0,63}) ?(?:@|\((?:at|AT)\)|\[(?:at|AT)\]|\{(?:at|AT)\}|<at>| at | arroba | AT ) ?"
    r"[A-Za-z0-9][A-Za-z0-9\-]*(?:(?:\.| dot | punkt | point | punto | ponto | DOT | ?\((?:dot|DOT)\) ?| ?\[(?:dot|DOT)\] ?)[A-Za-z0-9\-]+)+"
)
_DIGITS = re.compile(r"\d(?:(?:[ .\-/]|\) ?|\)-| \()?\d){5,}")
_CAP = r"[A-ZÀ-Þ\u0080-\U0010ffff][^\s,;:.!?()<>@\d]*"
# Words for streets. English ones follow the name, Romance ones precede it, German ones end it.
_TYPES_AFTER = frozenset(
    "street lane road close avenue drive way court terrace place square crescent gardens row hill boulevard park grove mews parkway circle trail "
    "highway walk alley green view wharf st rd ave blvd ln dr st. rd. ave. blvd.".split()
)
_TYPES_BEFORE = frozenset(
    "rue avenue av av. chemin all~e allée boulevard bd bd. place impasse quai route cours passage square sentier faubourg esplanade c/ calle avda avda. avenida plaza "
    "pza pza. paseo camino ronda carrera glorieta rua r. travessa tv. pra~a praça largo estrada alameda beco ladeira via viale piazza corso vicolo".split()
)
_TYPE_ENDS = re.compile(r"(?:stra(?:~|ß)e|strasse|str\.?|gasse|weg|platz|allee|ufer|damm|steig|graben|chaussee|markt|ring|straat|laan|plein)$")
_PREPOSED = frozenset("am an im in zum zur auf unter beim hinter".split())
_PARTICLES = frozenset("de du des la le les del da do das dos los las el der den dem des di della d~ l~ d' l'".split())
_SMALL = re.compile(r"\d(?<![\w.,/:#\-€$£+].)\d{0,3}(?: ?(?:bis|ter|quater)\b|[a-zA-Z]\b| [a-z]\b(?! ))?(?![\w/:%\-€$£]|[.,]\d)")
_FLAT_PREFIX = re.compile(r"(?:Flat|Apt\.?|Apartment|Unit|Suite) \d+[a-z]?, +$")

# What stands before a phone number, an identity number, and any other number.
_PHONE_CUES = tuple("tel|t:|t :|phone|ring |text |call|mobil|fax|anruf|ruf |unter|joignable|appel|llam|fono|fone|lig|☎|cell|sms|whats|handy|reach|dial|durchwahl|móvil|telem".split("|"))
_ID_CUES = tuple(
    "id |id:|identi|social|insurance|national|passport|ssn|tax |fiscal|steuer|ausweis|sozialvers|rentenvers|versicherungs|curit|insee|"
    "dni|nie |nif|nss|documento|contribuinte|cidad|personal|licen|pass-nr|pesel|bsn".split("|")
)
_ORDER_CUES = re.compile(
    r"(?:lot|ticket|order|batch|part|item|#|version|release|invoice|account|room|page|vorgang|nummer|nr\.|no\.|auftrag|rechnung|bestellung|expediente|pedido|factura|"
    r"dossier|commande|facture|processo|encomenda|fatura|n.{1,4}mero|num.{1,4}ro|number|€|\$|£|rows|units)\W*$"
)
_MAILTO_CUES = re.compile(r"(?:\bsee|\bref|message-id|in-reply-to|references|siehe|voir|v.{1,4}ase|ver|vide|id|cf)\W*$", re.I)


def _may_be_spelt(text: str) -> bool:
    """Whether a text holds a piece of an address that is spelt out; without one it has none."""
    return (
        "dot" in text or "at)" in text or "at]" in text or "DOT" in text or " arroba " in text or " punkt " in text or " point " in text or " punto " in text
        or " ponto " in text or "at}" in text or "<at>" in text or "AT)" in text or "AT]" in text
    )


def _blanks(m: re.Match) -> str:
    return " " * (m.end() - m.start())


def _flat(text: str) -> str:
    """Text of the same length with line breaks and the quote marks after them blanked."""
    if "\n" not in text:
        return text
    if ">" in text or "|" in text:
        return _BREAK.sub(_blanks, text)
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ")


_MAIL_STATIC: dict[str, tuple] = {}


def _mail_static(s: str) -> tuple:
    """Features of the address alone."""
    row = _MAIL_STATIC.get(s)
    if row is None:
        if len(_MAIL_STATIC) > 200_000:
            _MAIL_STATIC.clear()
        how = 0 if "@" in s else 1 if re.search(r"[(\[{<]at[)\]}>]", s, re.I) else 2
        spelt = int(bool(re.search(r" dot | punkt | point | punto | ponto |\(dot\)|\[dot\]| DOT ", s)))
        host = re.split(r"@|\bat\b|arroba|\)|\]", s, maxsplit=1, flags=re.I)[-1].strip(" )]}>")
        first = re.split(r"[. ]", host, maxsplit=1)[0].lower()
        local = s[: s.find("@")] if how == 0 else ""
        mx = int(bool(re.fullmatch(r"mx\d*|mta\d*|smtp\d*|msgid|localhost", first)))
        row = _MAIL_STATIC[s] = (how, spelt, min(3, sum(c.isdigit() for c in local) // 3), mx, min(4, host.count(".")), int(how == 2 and not spelt))
    return row


def _email_row(flat: str, a: int, b: int) -> tuple:
    how, spelt, digits, mx, dots, loose = _mail_static(flat[a:b])
    before = flat[max(0, a - 24) : a]
    angle = int(before.endswith("<") and flat[b : b + 1] == ">")
    word = (before[:-1] if angle else before).rstrip()
    named = 0 if not word else 3 if not (word[-1].isalpha() or word[-1] in ".:-") else 1 if _MAILTO_CUES.search(word) else 2 if word[-1].isalpha() or word[-1] == "." else 3
    url = int("/" in before and bool(re.search(r"(?:https?:|www\.|://)\S*$", before)))
    return (how, spelt, angle, named, url, digits, mx, dots, loose)


_NINES = str.maketrans("012345678", "9" * 9)
_SHAPES: dict[str, tuple | None] = {}


def _shape(s: str) -> tuple | None:
    """Features of the digits' grouping; null for dates and times, which are no candidates."""
    if re.fullmatch(r"\d{4}-\d\d-\d\d(?: \d\d?)?|\d\d?[./]\d\d?[./](?:\d{4}|\d\d)(?: \d\d?)?", s):
        return None
    groups = re.findall(r"\d+", s)
    tail = 2 if s[-1].isalpha() and s[:2].isalpha() else 1 if s[-1].isalpha() else 0
    shape = "-".join(str(len(g)) for g in groups[:6])
    sep = sum(v for v, c in ((1, " "), (2, "-"), (4, "."), (8, "/"), (16, "(")) if c in s)
    return (
        min(sum(map(len, groups)), 16), tail, len(groups), len(groups[0]), len(groups[-1]), sep, int(shape == "3-2-4"), int(shape in ("4-4", "3-4")),
        len(groups[min(1, len(groups) - 1)]),
    )


def _line_start(text: str, a: int) -> int:
    lead = text[max(0, a - 16) : a].rstrip(" \t>|")
    while lead and lead[-1] > "\x7f":  # a sign for the telephone, or what became of it
        lead = lead[:-1].rstrip(" \t>|")
    return int(not lead or lead[-1] == "\n")


def _digit_row(flat: str, a: int, b: int, text: str) -> tuple | None:
    s = flat[a:b]
    key = s.translate(_NINES)
    if key in _SHAPES:
        own = _SHAPES[key]
    else:
        if len(_SHAPES) > 100_000:
            _SHAPES.clear()
        own = _SHAPES[key] = _shape(s)
    if own is None:
        return None
    before = flat[max(0, a - 34) : a].lower()
    after = flat[b : b + 14]
    plus = 1 if s[0] == "+" else 2 if s.startswith("00") else 3 if s[0] == "0" else 4 if s[0] == "(" else 0
    lead = before.rstrip()
    phone = len(lead) if lead[-2:] == "l." else max([before.rfind(x) for x in _PHONE_CUES])
    other = max([before.rfind(x) for x in _ID_CUES])
    return (
        *own, plus, int(lead[-1:] == ":"), int(phone >= 0), int(other >= 0), 0 if phone < 0 and other < 0 else 1 if phone >= other else 2,
        int(bool(lead) and (lead[-1].isalpha() or lead[-1] in "#€$") and bool(_ORDER_CUES.search(lead))),
        int(after.lstrip().startswith(("works", "after", "if the", "when", "erreichbar", "l’apr", "depois", "despu", "apr"))),
        _line_start(text, a),
        int(text[b : b + 2].lstrip(" \r")[:1] in ("", "\n")),
    )


_TOWN = re.compile(r"[,\s]{0,3}(?:\d{4,5}\b|[A-ZÀ-Þ])")
_NO_NAME: dict[str, bool] = {}


def _no_name(w: str) -> bool:
    """Whether a word within a street is a function word other than those streets have."""
    known = _NO_NAME.get(w)
    if known is None:
        if len(_NO_NAME) > 100_000:
            _NO_NAME.clear()
        low = w.lower()
        known = _NO_NAME[w] = low not in _PARTICLES and low not in _PREPOSED and _is_other(w.strip(".,").lower())
    return known


def _street_row(flat: str, a: int, b: int, kind: int, words: int, number: str) -> tuple:
    """``kind``: 0 no street word, 1 one after the name, 2 one before it, 3 one that ends the name, 4 a preposition before the name."""
    s, before, after = flat[a:b], flat[max(0, a - 24) : a], flat[b : b + 4]
    lead = before.rstrip()
    last = lead[lead.rfind(" ") + 1 :].lower()
    words_ = s.split()
    months = int(any(w[0].isalpha() and _no_name(w) for w in words_))
    return (
        kind, int(s[0].isdigit() or s.startswith(("Flat", "Apt", "Unit", "Suite"))), min(6, words), len(number), int(not s[-1].isdigit() and s[-2:-1].isdigit()),
        0 if not lead else 1 if lead[-1] in ",:" else 2 if lead[-1] in ".!?>|" else 3, int(last in _ARTICLES), int(last in _PLACE_WORDS),
        int(bool(_ORDER_CUES.search(lead.lower()))), int(bool(_TOWN.match(flat, b))), int(after[:1] == ","), int("," in s), months, int(number[0] == "0"),
        int(any(len(w) > 1 and w.isupper() for w in words_)), int(after[:1] == " " and after.lstrip()[:1].isdigit()),
    )


#: Words that say where something is, before an address.
_PLACE_WORDS = frozenset("at to in address live lives adresse wohnt wohne nach an auf en au à em na no a calle domicilio morada dirección demeure habite sede".split())


_SIGNS = frozenset("€°£–—“”„«»’‘…•§")


def _digits_of(number: str) -> str:
    return number[: 4 if number[:4].isdigit() else 3 if number[:3].isdigit() else 2 if number[:2].isdigit() else 1]


def street_candidates(flat: str, text: str) -> Iterator[tuple[int, int, tuple]]:
    """(start, end, features) of small numbers with the capitalised words after or before them; at most one line break between."""
    for m in _SMALL.finditer(flat):
        a, b = m.span()
        k = b + 1 if flat[b : b + 1] == "," else b
        if flat[k : k + 1] == " ":
            while flat[k : k + 1] == " ":
                k += 1
            c = flat[k : k + 1]
            if c and (c.isupper() or c > "\x7f" and c not in _SIGNS or c in "rabpqcesif" and _folded(flat[k : flat.find(" ", k)]) in _TYPES_BEFORE):
                got = _after_number(flat, b)
                if got is not None:
                    end, kind, words = got
                    lead = _FLAT_PREFIX.search(flat, max(0, a - 24), a) if flat[a - 2 : a] == ", " else None
                    start = lead.start() if lead else a
                    if text.count("\n", start, end) < 2:
                        yield start, end, _street_row(flat, start, end, kind, words, _digits_of(m.group()))
        if flat[a - 1 : a] == " ":
            j = a - 1
            while j and flat[j - 1] == " ":
                j -= 1
            c = flat[flat.rfind(" ", max(0, j - 60), j) + 1 : j][:1]
            if c and (c.isupper() or c > "\x7f" and c not in _SIGNS or c == "n"):
                got = _before_number(flat, a)
                if got is not None:
                    start, kind, words = got
                    if text.count("\n", start, b) < 2:
                        b -= flat[b - 1] == " "
                        yield start, b, _street_row(flat, start, b, kind, words, _digits_of(m.group()))


def _capital(w: str) -> bool:
    return w[0].isupper() or w[0] > "\x7f" and w[0] not in _QUOTES


def _folded(w: str) -> str:
    if w.isascii():
        return w.lower()
    return _ODD.sub("~", w).lower()


def _after_number(flat: str, b: int) -> tuple[int, int, int] | None:
    """End, kind and number of words of a street whose number ends at ``b``."""
    if flat[b : b + 1] == ",":
        b += 1
    if flat[b : b + 1] != " ":
        return None
    words: list[tuple[str, int]] = []
    at, stop = b, min(len(flat), b + 90)
    while at < stop and len(words) < 5:
        if flat[at] == " ":
            at += 1
            continue
        e = flat.find(" ", at, stop)
        if e < 0:
            e = stop
        words.append((flat[at:e], at))
        at = e
    if not words:
        return None
    first = _folded(words[0][0])
    if first in _TYPES_BEFORE and len(words) > 1:
        for w, at in words[1:]:
            if _capital(w) or "’" in w or "'" in w:
                core = w.rstrip(".,;:!?)>")
                return at + len(core), 2, 2
            if _folded(w) not in _PARTICLES:
                return None
        return None
    caps = 0
    end = b
    for w, at in words:
        core = w.rstrip(".,;:!?)>")
        if len(core) < 2 or core[0] in "°º" or not _capital(core) or any(c.isdigit() or c in "@<°" for c in core):
            break
        caps += 1
        end = at + len(core)
        if caps > 1 and _folded(core) in _TYPES_AFTER:
            return end, 1, caps
        if len(core) < len(w) and (w[len(core)] != "." or core.lower() not in ("st", "ste", "mt", "dr")):
            break
    return (end, 0, caps) if caps else None


def _before_number(flat: str, a: int) -> tuple[int, int, int] | None:
    """Start, kind and number of words of a street whose number begins at ``a``."""
    j = a
    while j and flat[j - 1] == " ":
        j -= 1
    if j == a:
        return None
    marker = re.search(r"(?:,? n[^\s\d]{1,4})$", flat[max(0, j - 8) : j])
    if marker and marker.group().strip(" ,")[-1:] in "ºo°.~Âr" or marker and not marker.group().isascii():
        j -= len(marker.group())
    if flat[j - 1 : j] == ",":
        j -= 1
    low = max(0, j - 70)
    taken: list[tuple[str, int]] = []
    e = j
    while e > low and len(taken) < 6:
        if flat[e - 1] == " ":
            e -= 1
            continue
        at = flat.rfind(" ", low, e) + 1
        if at == 0:
            if low:
                break  # begins before the window
            at = 0
        w = flat[at:e]
        if taken and w[-1] in ".,;:!?>)":
            bare = _folded(w)
            if bare not in _TYPES_BEFORE and not _TYPE_ENDS.search(bare):
                break
        taken.insert(0, (w, at))
        if w.startswith("C/") or _folded(w).lstrip("(\"'") in _TYPES_BEFORE:
            break
        e = at
    if not taken:
        return None
    for k in range(len(taken)):
        w, at = taken[k]
        if (_folded(w) in _TYPES_BEFORE and len(taken) > k + 1 or w.startswith("C/") and (len(w) > 2 or len(taken) > k + 1)) and any(_capital(x) for x, _ in taken[k + 1 :] or [("C", 0)]):
            return at, 2, len(taken) - k
    w, at = taken[-1]
    if not _capital(w) or not (w[0].isalpha() or w[0] > "\x7f") or any(c.isdigit() or c in "@<>" for c in w):
        return None
    bare = _folded(w)
    if _TYPE_ENDS.search(bare):
        alone = bare.rstrip(".") in ("straße", "stra~e", "strasse", "str", "gasse", "weg", "platz", "allee", "ring", "ufer", "damm", "steig", "graben", "markt")
        if alone and len(taken) > 1 and (_capital(taken[-2][0]) or taken[-2][0].lower() in _PREPOSED):
            return taken[-2][1], 3, 2
        return at, 0 if alone else 3, 1
    if len(taken) > 1:
        w2, at2 = taken[-2]
        if w2.lower() in _PREPOSED:
            return at2, 4, 2
        if w2.lower() in _PARTICLES and len(taken) > 2 and taken[-3][0].lower() in _PREPOSED:
            return taken[-3][1], 4, 3
        if _capital(w2) and w2[0].isalpha() and not _is_other(w2.lower()):
            return at2, 0, 2
    return at, 0, 1


def _case(word: str) -> int:
    letters = [c for c in word if c.isalpha()]
    if not letters:
        return 0
    if len(letters) > 1 and all(c.isupper() or not c.islower() for c in letters):
        return 3
    return 2 if letters[0].isupper() else 1


def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if c < "\x80")


_STATIC: dict[str, tuple] = {}


def _word(w: str) -> tuple:
    """Features of one word alone: listed given name, ending, case, length, function word, outside ASCII; and its plain form."""
    row = _STATIC.get(w)
    if row is None:
        if len(_STATIC) > 300_000:
            _STATIC.clear()
        low = w.lower()
        folded = _ODD.sub("~", low)
        ending = 3 if low in ROLE_WORDS else 1 if _WORD_ENDINGS.search(low) else 2 if _FAMILY_ENDINGS.search(low) else 0
        row = _STATIC[w] = (
            int(w in GIVEN_NAMES or folded in _GIVEN_FOLDED), ending, _case(w), min(len(w), 12), int(_is_other(low)), int(not w.isascii()), _plain(w), low, folded,
        )
    return row


class Context:
    """What the features of names look up in one text: words in lower case, address pieces, header words of the record."""

    def __init__(self, text: str, flat: str, addresses: set[str], locals_: str, marks: set[int], book: frozenset[str]) -> None:
        self.text, self.flat, self.addresses, self.locals, self.book = text, flat, addresses, locals_, book
        self.marks = marks  # where addresses begin
        self._asked, self._low = 0, None

    @property
    def low(self) -> frozenset[str]:
        """The words between blanks, as they stand."""
        if self._low is None:
            self._low = frozenset(self.flat.split(" "))
        return self._low

    def holds(self, word: str) -> bool:
        """Whether ``word`` is one of ``low``; a few words are cheaper to look for than to gather all."""
        self._asked += 1
        if self._low is None and self._asked <= 12:
            flat = self.flat
            return f" {word} " in flat or flat.startswith(word + " ") or flat.endswith(" " + word) or flat == word
        return word in self.low

    def marked(self, end: int) -> int:
        """1 if an address comes right after this place."""
        flat = self.flat
        n = len(flat)
        while end < n and flat[end] in " <(":
            end += 1
        return int(end in self.marks)

    def known(self, plain: str) -> int:
        """2 if an address of the record has this piece, 1 if one only begins or goes on with it."""
        if len(plain) < 3:
            return 0
        return 2 if plain in self.addresses else 1 if plain in self.locals else 0


_HEADER = re.compile(r"(?:^|\s)(?:from|to|cc|bcc|von|an|de|para|à|da|kopie|copie|copia|[^\x00-\x7f:\s]{1,4}) ?: ?$", re.I)
_SPEAKING = re.compile(r"(?i)(?:\s(?:said|says|wrote|writes|asked|schrieb|schreibt|sagte|a écrit|écrit|écrivait|dit|escribió|escribe|dijo|escreveu|escreve|disse)|[^\S\n]*:)(?![^\W\d_])")


def _name_row(c: Context, a: int, b: int, given: str | None, family: str, gap: str, reverse: int, middle: int, mark: int) -> tuple:
    flat, text = c.flat, c.text
    g = _word(given) if given is not None else None
    f = _word(family)
    j = a - 1
    while j >= 0 and flat[j] == " ":
        j -= 1
    last = flat[j] if j >= 0 else ""
    previous = flat[flat.rfind(" ", max(0, j - 40), j + 1) + 1 : j + 1] if j >= 0 else ""
    low = previous.strip(_QUOTES + "(").lower()
    after = flat[b : b + 14]
    rest = after.lstrip()
    head = rest[:1]
    follows = 1 if head == "<" or mark else 2 if not head else 3 if after[0] in ".,;:)!?" else 4 if head.islower() else 5 if head.isupper() else 6
    line_end = int(text[b : b + 3].lstrip(" \r>")[:1] in ("", "\n"))
    starts = 1 if not last else 2 if last in ".!?:;>|<" else 3 if last == "," else 4 if last in "°º&-/@" or last > "\x7f" and last not in _QUOTES else 0
    line = text.rfind("\n", max(0, a - 20), a)
    line_start = int((line >= 0 or a < 20) and not text[line + 1 if line >= 0 else 0 : a].strip(" >|\t"))
    header = 0 if last != ":" else 1 if _HEADER.search(flat, max(0, a - 40), a) else 2
    wrapped = 0
    if "\n" in gap:
        at = text.rfind("\n", 0, a)
        wrapped = 1 if text.find("\n", a) - at > 48 else 2
    comma = int("," in gap)
    return (
        4 if g is None else g[0], f[0], 0 if g is None else g[1], f[1], 0 if g is None else g[2], f[2], min(3, f[3] // 2) if f[3] < 8 else 4, f[4] + 2 * (g[4] if g else 0),
        f[5] + 2 * (g[5] if g else 0), wrapped, comma, reverse, middle, follows, line_end, starts, line_start, header,
        0 if last in ".!?:;,>|" else 1 if low in _ARTICLES else 2 if previous[:1].islower() else 3 if previous[:1].isupper() else 0, int(_is_other(low)) if low else 0,
        c.known(f[6]), 0 if g is None else c.known(g[6]), int(c.holds(f[7])), 0 if g is None else int(c.holds(g[7])), mark, int((after[:1] == " " or after[:1] == ":") and bool(_SPEAKING.match(after))),
        int(f[8] in c.book) + 2 * int(g is not None and g[8] in c.book), 0 if g is None else min(3, g[3] // 3), int(family.find("-") > 0 or given is not None and given.find("-") > 0),
    )


_W = r"[A-Za-z\u0080-\U0010ffff][A-Za-z\u0080-\U0010ffff'\-]*"
_CHARS = r"A-Za-z\u0080-\U0010ffff'\-"
#: A word that begins like a name and has another such word, or an initial, after it; and what may come there.
_FIRST = re.compile(rf"[A-Z\u0080-\U0010ffff](?<![A-Za-z0-9'\-_@/.À-ɏ].)(?:\.(?= +[A-Z\u0080-\U0010ffff])|[{_CHARS}]*(?=(?: |,)(?: *[A-Z\u0080-\U0010ffff])))")
_SECOND = re.compile(rf"( {{1,40}}|, {{0,40}})(?:([A-Z])\.( {{1,40}}))?(?:([A-Z\u0080-\U0010ffff][{_CHARS}]+)|([A-Z])\.(?![A-Za-z]))")
_PAIR_BEFORE = re.compile(rf"({_W})( | {{0,2}}, )(?:[A-Z]\. )?({_W}) [<(]?$")
_LOWER_NEXT = re.compile(r"(?: {1,40}|, {1,40})([a-z\u0080-\U0010ffff][a-z\u0080-\U0010ffff'\-]{2,})(?![A-Za-z0-9_@/À-ɏ]|\.\w)")


def _trimmed(w: str, at: int) -> tuple[str, int]:
    """The word without quotes around it, and its place."""
    s = w.strip(_QUOTES)
    return s, at + (w.find(s) if s else 0)


def name_candidates(c: Context, mails: list[int]) -> Iterator[tuple[int, int, tuple]]:
    """(start, end, what ``_name_row`` needs beside them) of pairs of words, or of an initial and a word, that could be a person's name.

    Every two neighbouring words that begin with a capital, or with a character outside ASCII as a garbled
    capital may (a middle initial or a comma between); an initial and a word, in both orders; the two words
    before an address (starts in ``mails``); words in lower case beside a listed given name or a word of one
    of the record's addresses. At most one line break between. Function words are never part of a name.
    """
    flat, text = c.flat, c.text
    n = len(flat)
    seen: set[tuple[int, int]] = set()
    for m in _FIRST.finditer(flat):
        w = m.group()
        if w in _SKIPPED:
            continue
        k = _SECOND.match(flat, m.end())
        if k is None:
            continue
        gap, middle, _, second, after = k.groups()
        a = m.start()
        initial = w[1:] == "."
        if initial:
            if not w[0].isupper() or gap[0] == "," or middle or second is None or a and flat[a - 1] in "°º":
                continue
            first = None
        else:
            first, a = _trimmed(w, a)
            if len(first) < 2 or a + len(first) != m.end() or "a" <= first[0] <= "z" or _word(first)[4]:
                continue
        if second is None:  # a family name, a comma and an initial
            if gap[0] == "," and middle is None:
                b = k.end()
                yield a, b, (None, first, text[m.end() : b - 2], 1, 0, 0)
            continue
        if second in _SKIPPED:
            continue
        second, x = _trimmed(second, k.start(4))
        if len(second) < 2 or "a" <= second[0] <= "z" or _word(second)[4]:
            continue
        b = x + len(second)
        q = flat[b : b + 2]
        if q[:1] in ("@", "_") or q[:1].isdigit() or q[:1] == "." and q[1:].isalnum():
            continue
        gap = text[m.end() : x]
        lines = gap.count("\n")
        if lines > 1 or lines and middle or initial and len(second) < 3:
            continue
        seen.add((a, b))
        mark = c.marked(b)
        if gap[0] == ",":
            yield a, b, (second, first, gap, 1, 0, mark)
        else:
            yield a, b, (first, second, gap, 0, int(middle is not None), mark)
    for at in mails:
        m = _PAIR_BEFORE.search(flat, max(0, at - 70), at)
        if m and (m.start(1), m.end(3)) not in seen:
            s, a = _trimmed(m.group(1), m.start(1))
            s2, x = _trimmed(m.group(3), m.start(3))
            gap = text[a + len(s) : x]
            if len(s) > 1 and len(s2) > 1 and gap.count("\n") < 2 and not _word(s)[4] and not _word(s2)[4]:
                comma = "," in gap
                b = x + len(s2)
                seen.add((a, b))
                yield a, b, (s2 if comma else s, s if comma else s2, gap, int(comma), 0, 1)
    for w, at in _lower_places(flat, sorted((c.low & c.book) | (c.low & c.addresses) | (c.low & _GIVEN_LOWER))):
        end = at + len(w)
        for other, x in _lower_beside(flat, at, end):
            a, b = (at, x + len(other)) if x > at else (x, end)
            gap = text[end:x] if x > at else text[x + len(other) : at]
            if (a, b) not in seen and gap.count("\n") < 2:
                seen.add((a, b))
                first, second = (w, other) if x > at else (other, w)
                comma = "," in gap
                yield a, b, (second if comma else first, first if comma else second, gap, int(comma), 0, c.marked(b))


#: More words than this are looked for together, in one pass; fewer are cheaper one by one.
MANY_WORDS = 24
_BETWEEN = re.compile(r"[^ ,.:;)!?(\"'>“„«]+")


def _lower_places(flat: str, words: list[str]) -> Iterator[tuple[str, int]]:
    """(word, place) wherever one of the words stands by itself; function words, words of function mailboxes and capitals are left out."""
    wanted = [w for w in words if len(w) > 2 and not _word(w)[4] and _word(w)[1] != 3 and ("a" <= w[0] <= "z" or w[0] > "\x7f")]
    together = frozenset(w for w in wanted if _BETWEEN.fullmatch(w)) if len(wanted) > MANY_WORDS else frozenset()
    if together:
        for m in _BETWEEN.finditer(flat):
            if m.group() in together and (m.start() == 0 or flat[m.start() - 1] in _LOWER_STARTS) and flat[m.end() : m.end() + 1] in _LOWER_ENDS:
                yield m.group(), m.start()
    for w in wanted:
        if w in together:
            continue
        at = flat.find(w)
        while at >= 0:
            end = at + len(w)
            if (at == 0 or flat[at - 1] in _LOWER_STARTS) and flat[end : end + 1] in _LOWER_ENDS:
                yield w, at
            at = flat.find(w, end)


_LOWER_STARTS = frozenset(" (\"'>“„«")
_LOWER_ENDS = frozenset(["", *" ,.:;)!?"])


def _lower_beside(flat: str, at: int, end: int) -> Iterator[tuple[str, int]]:
    """The words in lower case, no function words, right after and right before a word."""
    m = _LOWER_NEXT.match(flat, end)
    if m and not _word(m.group(1))[4]:
        yield m.group(1), m.start(1)
    j = at
    while j and flat[j - 1] == " ":
        j -= 1
    if at - 40 < j < at:
        if flat[j - 1 : j] == ",":
            j -= 1
        k = flat.rfind(" ", max(0, j - 40), j) + 1
        other = flat[k:j].lstrip(_QUOTES + "(>")
        if len(other) > 2 and ("a" <= other[0] <= "z" or other[0] > "\x7f") and other.replace("-", "").isalpha() and not _word(other)[4]:
            yield other, j - len(other)


def _mail_starts(flat: str) -> list[tuple[int, int]]:
    """(start of the local part, place of the at sign) of everything around an at sign."""
    out = []
    at = flat.find("@")
    while at >= 0:
        end = at - 1 if flat[at - 1 : at] == " " else at
        word = flat[max(0, flat.rfind(" ", max(0, end - 80), end) + 1) : end]
        for mark in "<>\":;,|([\n\t":
            if mark in word:
                word = word[word.rfind(mark) + 1 :]
        word = word.lstrip("._%+-")
        if word:
            out.append((end - len(word), at))
        at = flat.find("@", at + 1)
    return out


def _number_spans(flat: str, text: str) -> Iterator[tuple[int, int]]:
    n = len(flat)
    for m in _DIGITS.finditer(flat):
        a, b = m.span()
        line = text.find("\n", a, b)
        if line >= 0 and line - a >= 9 and (flat[b : b + 1].isalpha() or flat[b : b + 1] in (" ", ",") and (flat[b : b + 2].strip() == "," or flat[b + 1 : b + 2].isalpha())):
            b = line  # the next line begins with a house number
            while flat[b - 1] == " ":
                b -= 1
        if a:
            p = flat[a - 1]
            if p in "+(":
                a -= 1
            elif p.isalpha():
                if not (flat[a - 2 : a].isupper() and len(flat[a - 2 : a]) == 2 and (a < 3 or not flat[a - 3].isalnum())) and not (
                    p in "XYZ" and (a < 2 or not flat[a - 2].isalnum())
                ):
                    continue
                a -= 2 if flat[a - 2 : a - 1].isupper() else 1
            elif p == " " and a > 2 and flat[a - 3 : a - 1].isupper() and flat[a - 3 : a - 1].isalpha() and (a < 4 or not flat[a - 4].isalnum()):
                a -= 3
            elif p in "-#/@_.":
                continue
        if b < n:
            q = flat[b]
            if q.isupper() and (b + 1 >= n or not flat[b + 1].isalnum()):
                b += 1
            elif q in " -" and b + 1 < n and flat[b + 1].isupper() and (q == "-" or flat[a].isalpha()) and (b + 2 >= n or not flat[b + 2].isalnum()):
                b += 2
            elif q.isalnum() or q == "@":
                continue
        yield a, b


def number_candidates(flat: str, text: str, mails: list[tuple[int, int]], lazy: bool = False) -> Iterator[tuple[str, int, int, tuple]]:
    """(kind, start, end, features) of all kinds but names; ``lazy``: without the features of addresses."""
    ends = -1
    for a, _ in mails:
        if a >= ends:
            m = _EMAIL.match(flat, a)
            if m:
                ends = m.end()
                yield "email", a, ends, () if lazy else _email_row(flat, a, ends)
    if _may_be_spelt(flat):
        for m in _EMAIL.finditer(flat):
            if "@" not in m.group():
                yield "email", m.start(), m.end(), () if lazy else _email_row(flat, m.start(), m.end())
    if not _FREE_DIGIT.search(flat):
        return  # digits within words and addresses only
    for a, b in _number_spans(flat, text):
        row = _digit_row(flat, a, b, text)
        if row is not None:
            yield "phone", a, b, row
            yield "id_number", a, b, row
    for a, b, row in street_candidates(flat, text):
        yield "street_address", a, b, row


#: A digit that can begin a number: both searches below it refuse those after what stands here.
_FREE_DIGIT = re.compile(r"\d(?<![a-z0-9@_.#/\-].)")


def context_of(flat: str, text: str, mails: list[tuple[int, int]], record: str, book: frozenset[str]) -> Context:
    locals_ = " ".join([flat[a:at] for a, at in mails] + [record]).lower()
    return Context(text, flat, set(_PIECES.findall(locals_)), locals_, {a for a, _ in mails}, book)


def candidates(text: str, record: str = "", book: frozenset[str] = frozenset()) -> Iterator[tuple[str, int, int, tuple]]:
    """(kind, start, end, features); ``record``: local parts of the record's other addresses; ``book``: words of the corpus's headers. Both count as context."""
    flat = _flat(text)
    mails = _mail_starts(flat) if "@" in flat else []
    yield from number_candidates(flat, text, mails)
    context = context_of(flat, text, mails, record, book)
    for a, b, words in name_candidates(context, [a for a, _ in mails]):
        yield "person_name", a, b, _name_row(context, a, b, *words)


_PIECES = re.compile(r"[a-z]{3,}")


def local_parts(text: str | None) -> str:
    """Local parts of all addresses in a text."""
    return " ".join([text[a:at] for a, at in _mail_starts(text)]) if text else ""


def _placed(hits: list[tuple]) -> list[tuple[int, int, str]]:
    """Of overlapping hits (-probability, -length, start, end, kind) the most probable, then the longest, in order of place."""
    hits.sort()
    taken: list[tuple[int, int, str]] = []  # they do not overlap, so the neighbours decide
    for _, _, a, b, kind in hits:
        k = bisect_left(taken, (a, b, kind))
        if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or taken[k][0] >= b):
            taken.insert(k, (a, b, kind))
    return taken


class Judge:
    """Models of the kinds, with the probabilities of feature rows already seen."""

    def __init__(self, models: dict[str, Boosted], book: frozenset[str] = frozenset()) -> None:
        self.models, self.book = models, book
        self.known: dict[tuple, float] = {}

    def _probability(self, kind: str, row: tuple) -> float:
        key = (kind, row)
        p = self.known.get(key)
        if p is None:
            if len(self.known) > 500_000:
                self.known.clear()
            p = self.known[key] = self.models[kind].probability(row)
        return p

    def _hits(self, found: Iterator[tuple[str, int, int, tuple]]) -> list[tuple]:
        out = []
        for kind, a, b, row in found:
            p = self._probability(kind, row)
            if p >= self.models[kind].threshold:
                out.append((-p, a - b, a, b, kind))
        return out

    def spans(self, text: str | None, record: str = "") -> list[tuple[int, int, str]]:
        """(start, end, kind) of what is personal; spans do not overlap."""
        if not text:
            return []
        hits = self._hits(candidates(text, record, self.book))
        return _placed(hits)

    def kinds(self, text: str | None, record: str = "", mails: list[tuple[int, int]] | None = None) -> set[str]:
        """The kinds of ``spans``. A name that meets no other kind's span is placed, or a better name in its place: once one is found,
        only names that meet other spans, and could displace them, are judged. ``mails``: ``_mail_starts`` of the text, where known."""
        if not text:
            return set()
        flat = _flat(text)
        if mails is None or flat is not text:
            mails = _mail_starts(flat) if "@" in flat else []
        hits: list[tuple] = []
        mailed = False
        for kind, a, b, row in number_candidates(flat, text, mails, lazy=True):
            if kind == "email":
                # an address without a blank meets no other kind's span, so further ones change nothing
                bare = " " not in flat[a:b]
                if bare and mailed:
                    continue
                row = _email_row(flat, a, b)
            p = self._probability(kind, row)
            if p >= self.models[kind].threshold:
                if kind == "email" and bare:
                    mailed = True
                else:
                    hits.append((-p, a - b, a, b, kind))
        # names are words, so they meet no span of digits and signs, and no address without a blank in it
        others = [(a, b) for _, _, a, b, k in hits if k == "street_address" or k == "email" or k == "id_number" and not flat[a:b].upper() == flat[a:b].lower()]
        context, named = context_of(flat, text, mails, record, self.book), False
        for a, b, words in name_candidates(context, [a for a, _ in mails]):
            free = all([b <= x or y <= a for x, y in others]) if others else True
            if free and named:
                continue
            p = self._probability("person_name", _name_row(context, a, b, *words))
            if p >= self.models["person_name"].threshold:
                named = named or free
                if named and not others:
                    break
                hits.append((-p, a - b, a, b, "person_name"))
        found = {k for _, _, k in _placed(hits)} if len(hits) > 1 else {h[4] for h in hits}
        if named:
            found.add("person_name")
        if mailed:
            found.add("email")
        return found

    def redact(self, text: str | None, record: str = "") -> str | None:
        """Text with a typed placeholder for each span; null stays null."""
        if not text:
            return text
        out, at = [], 0
        for a, b, kind in self.spans(text, record):
            out += [text[at:a], PLACEHOLDERS[kind]]
            at = b
        return "".join(out) + text[at:]


_MODELS: dict[str, Boosted] = {}


def models() -> dict[str, Boosted]:
    """The fitted models; fitted once in a process."""
    if not _MODELS:
        from postmill.llm.personal_training import fit_models

        _MODELS.update(fit_models())
    return _MODELS


FIELDS = ("body", "sender", "recipients")
#: A word belongs to the book if at least this share of the records holds it outside the addresses of its headers.
BOOK_SHARE = 1 / 5000
#: Bound of the book: the share rises as far as no more words than this can reach it.
BOOK_WORDS = 200_000


_MARKS = ",;:<>()[]\"“”„«»"


def _header_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of headers with the number of records that hold them, summed over as many batches as fit a bounded table."""
    counts: dict[str, int] = {}
    for last in (False, True):
        for b in batches if not last else (None,):
            if b is not None:
                for sender, recipients in zip(b["sender"].to_pylist(), b["recipients"].to_pylist()):
                    line = f"{sender or ''} {recipients or ''}".lower()
                    for mark in _MARKS:
                        if mark in line:
                            line = line.replace(mark, " ")
                    for w in set(line.split()):
                        if "@" not in w and "." not in w and len(w) > 1 and w[0].isalpha():
                            counts[w] = counts.get(w, 0) + 1
            if last or len(counts) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["w", "docs"])
                counts = {}


def header_book(documents: DataFrame, share: float = BOOK_SHARE, most: int = BOOK_WORDS) -> frozenset[str]:
    """Words that stand beside the addresses of many records, in lower case, each also with its runs outside ASCII folded to ``~``.

    Counted over the headers of all documents, combined before the shuffle. At most (words in all) / (share * documents)
    words can reach the share, so raising it to (words in all) / (``most`` * documents) bounds the book whatever the data.
    """
    rows = documents.select("sender", "recipients").mapInArrow(_header_words, "w string, docs bigint")
    counted = materialise(rows.groupBy("w").agg(F.sum("docs").alias("docs")), "header-words")
    total = counted.agg(F.sum("docs")).first()[0]
    if not total:
        return frozenset()
    least = max(share * documents.count(), total / most)  # so at most ``most`` words reach it
    found = counted.filter(F.col("docs") >= least)
    return frozenset(x for r in found.select("w").collect() for x in (r["w"], _ODD.sub("~", r["w"])))


def found_kinds(documents: DataFrame) -> DataFrame:
    """message_id, field, kind: the kinds of personal information each field holds, once for each document."""
    fitted, book = models(), documents.sparkSession.sparkContext.broadcast(header_book(documents))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(fitted, book.value)
        bits = {k: 1 << i for i, k in enumerate(KINDS)}
        for b in batches:
            codes = []
            for body, sender, recipients in zip(*(b[f].to_pylist() for f in FIELDS)):
                code = 0
                starts = {5: _mail_starts(sender or ""), 10: _mail_starts(recipients or "")}
                heads = " ".join([sender[a:at] for a, at in starts[5]]) + " " + " ".join([recipients[a:at] for a, at in starts[10]])
                for shift, text in ((0, body), (5, sender), (10, recipients)):
                    for kind in judge.kinds(text, heads, starts.get(shift)):
                        code |= bits[kind] << shift
                codes.append(code)
            yield pa.RecordBatch.from_arrays([b["message_id"], pa.array(codes, pa.int32())], ["message_id", "code"])

    names = F.array(
        *[
            F.when(F.col("code").bitwiseAND(1 << i) != 0, F.struct(F.lit(f).alias("field"), F.lit(k).alias("kind")))
            for i, (f, k) in enumerate((f, k) for f in FIELDS for k in KINDS)
        ]
    )
    return (
        spread(documents.select("message_id", *FIELDS))
        .mapInArrow(kernel, "message_id string, code int")
        .filter("code <> 0")
        .groupBy("message_id")
        .agg(F.bit_or("code").alias("code"))
        .select("message_id", F.explode(F.array_compact(names)).alias("x"))
        .select("message_id", "x.field", "x.kind")
    )


def redacted(documents: DataFrame) -> DataFrame:
    """message_id, body, sender, recipients with placeholders; one row per input row."""
    fitted, book = models(), documents.sparkSession.sparkContext.broadcast(header_book(documents))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(fitted, book.value)
        for b in batches:
            columns: dict[str, list] = {f: b[f].to_pylist() for f in FIELDS}
            heads = [local_parts(s) + " " + local_parts(r) for s, r in zip(columns["sender"], columns["recipients"])]
            done = [pa.array([judge.redact(t, h) for t, h in zip(columns[f], heads)], pa.string()) for f in FIELDS]
            yield pa.RecordBatch.from_arrays([b["message_id"], *done], ["message_id", *FIELDS])

    return spread(documents.select("message_id", *FIELDS)).mapInArrow(kernel, "message_id string, body string, sender string, recipients string")
