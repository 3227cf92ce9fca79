"""Garbled text from a wrong character encoding: find the records and restore the text.

Every distinct word of the corpus that holds a character outside ASCII is put through all encoding chains
(written in one encoding and read in another, once or twice); the garbled forms are hash-joined with the
corpus's distinct words. Where a form is itself a word of the corpus, it is taken for garbled if the
original is the more plausible of the two: fewer odd characters, or as many and more documents. Words that
decode back through a chain of UTF-8 add their originals to the list, so a word need not occur clean.
A word wholly in another script is sound by itself; it is restored only in a record that other words show to be garbled.
Replacement characters mark a word as garbled by themselves; it is restored where just one word of the
corpus gives that form.

A word is a maximal run of ASCII letters and digits and of characters outside ASCII with at least one of
the latter: encodings agree on ASCII, so a garbled word and its original have the same ends.

Scale: both shuffles are keyed by word and carry (word, count) or (record, word); the words of the table
are distinct, and no word's documents are gathered anywhere.

Edge cases: null and empty texts have no words; repeated records are reported once; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.session import materialise

WORD = r"[A-Za-z0-9\x{80}-\x{10FFFF}]*[\x{80}-\x{10FFFF}][A-Za-z0-9\x{80}-\x{10FFFF}]*"
_WORD = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]*[\u0080-\U0010ffff][A-Za-z0-9\u0080-\U0010ffff]*")
LOST = "�"
#: Encodings text is mistaken for. Bytes they leave undefined are read as control characters or as lost.
READERS = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251")
#: One-byte encodings text is written in before it is misread as another.
WRITERS = ("cp1252", "cp437", "cp850", "mac_roman")
# Characters that ordinary Latin text holds beside ASCII; the letters of Latin Extended-A, which no reader but cp1252 makes, count too.
ORDINARY = frozenset("äöüßéèêëàâôîïûùçœæñóíáúãõìòåøÄÖÜÉÈÊËÀÂÔÎÏÛÙÇŒÆÑÓÍÁÚÃÕÅØðþýÐÞÝ’‘“”„«»‹›–—…€£°¿¡ºª§·•☎") | frozenset(
    chr(c) for c in range(0x100, 0x180) if chr(c) not in "ŒœŠšŽžŸ"
)
#: Letters that cp1252 also makes of a second byte, and the letters it makes of a first one.
_SECOND, _FIRST = frozenset("šžŠŽ"), frozenset("ÂÃÄÅ")


def _reader(name: str) -> list[str]:
    table = []
    for b in range(256):
        try:
            table.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            table.append(chr(b) if name == "cp1252" else LOST)
    return table


_READ = {name: _reader(name) for name in READERS}
_WRITE = {name: {c: b for b, c in enumerate(table) if c != LOST} for name, table in _READ.items()}


def _write(word: str, name: str) -> bytes | None:
    if name == "utf-8":
        return word.encode("utf-8", "surrogatepass")
    try:
        return bytes([_WRITE[name][c] for c in word])
    except KeyError:
        return None


def _read(raw: bytes, name: str) -> str:
    if name == "utf-8":
        return raw.decode("utf-8", "replace")
    table = _READ[name]
    return "".join([table[b] for b in raw])


_TWICE = [
    (("utf-8", a), ("utf-8", b)) for a in ("cp1252", "latin-1") for b in ("cp1252", "latin-1")
]
CHAINS = (
    [(("utf-8", r),) for r in READERS]
    + _TWICE
    + [((w, r),) for w in WRITERS for r in (*READERS, "utf-8") if w != r and r != "latin-1"]
)


def garble(word: str, chain: tuple) -> str | None:
    """The word after the chain; null if a step cannot write it."""
    for writer, reader in chain:
        raw = _write(word, writer)
        if raw is None:
            return None
        word = _read(raw, reader)
    return word


def ungarble(word: str, chain: tuple) -> str | None:
    """The word that the chain turns into this one, if the way back is clean and leads here again."""
    back = word
    for writer, reader in reversed(chain):
        raw = _write(back, reader)
        if raw is None:
            return None
        try:
            back = raw.decode("utf-8") if writer == "utf-8" else _read(raw, writer)
        except UnicodeDecodeError:
            return None
    return back if back != word and garble(back, chain) == word else None


def _foreign(c: str) -> bool:
    """Whether a character is a letter of another script than the Latin one."""
    return c.isalpha() and c > "\u024f" and not unicodedata.name(c, "LATIN").startswith(("LATIN", "FEMININE", "MASCULINE", "MODIFIER"))


def oddity(word: str) -> int:
    """Number of characters that text would hardly have there; twice that of capitals inside a word.

    Judged by script: letters of another script are odd beside Latin ones or signs, not in a word of their own.
    """
    if not word.isascii() and all(c.isdigit() or c in "’'" or _foreign(c) or unicodedata.combining(c) for c in word):
        return 0
    odd = 0
    before = ""
    for c in word:
        if c > "\x7f":
            if c in _SECOND:
                odd += 2 if before in _FIRST else 0
            elif c not in ORDINARY:
                odd += 2
            elif c.isupper() and before.islower():
                odd += 1
        before = c
    # a sign where a letter is wanted
    for k in range(1, len(word) - 1):
        if word[k] in "°€£¿¡ºª§·•„«»‹›…–—☎" and word[k - 1].isalpha() and word[k + 1].isalpha():
            odd += 1
    return odd


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        forms, words, docs = [], [], []
        for word, n in zip(b["word"].to_pylist(), b["docs"].to_pylist()):
            if LOST in word:
                continue
            for chain in CHAINS:
                form = garble(word, chain)
                if form is not None and form != word and (chain[-1][1] != "utf-8" or LOST in form):
                    forms.append(form)
                    words.append(word)
                    docs.append(n)
                if chain[0][0] == "utf-8":
                    back = ungarble(word, chain)
                    if back is not None and oddity(back) < oddity(word):
                        forms.append(word)
                        words.append(back)
                        docs.append(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(forms, pa.string()), pa.array(words, pa.string()), pa.array(docs, pa.int64())], ["word", "original", "original_docs"]
        )


@F.pandas_udf(T.IntegerType())
def _oddity(words):
    return words.map(oddity).astype("int32")


def records_words(records: DataFrame) -> DataFrame:
    """Distinct words outside ASCII of each record; ``records``: record, field, text."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    return records.filter(F.col("text").rlike(r"[^\x00-\x7F]")).select("record", "field", words.alias("words"))


#: Words wholly of letters of another script than the Latin one.
_OWN_SCRIPT = r"^[^\x00-\x7F\p{IsLatin}\p{P}\p{S}\p{N}\p{C}\p{Z}]+$"


def garbled_words(words: DataFrame) -> DataFrame:
    """word, original, sure: the garbled words among ``words`` (word, docs); original is null where it cannot be told.

    Words wholly in another script are never sure: they come too, with the word they may have been (null if none), for records
    that sure words show to be garbled.
    """
    own = F.col("word").rlike(_OWN_SCRIPT)
    lost = words.filter(F.col("word").contains(LOST)).select("word", "docs")
    forms = words.mapInArrow(_forms, "word string, original string, original_docs bigint")
    pairs = forms.join(words, "word").groupBy("word", "docs", "original").agg(F.max("original_docs").alias("n"))
    weighed = pairs.withColumn("odd", _oddity("word")).withColumn("odd2", _oddity("original"))
    broken = F.col("word").contains(LOST)
    better = broken | (F.col("odd2") < F.col("odd")) | ((F.col("odd2") == F.col("odd")) & (F.col("n") > 2 * F.col("docs")) & (F.length("word") > 2))
    best = (
        weighed.withColumn("maybe", own & (F.col("odd2") == 0) & (F.col("n") > F.col("docs")))
        .filter(better & ~own | F.col("maybe"))
        .groupBy("word")
        .agg(
            F.min_by("original", F.struct("odd2", -F.col("n"), "original")).alias("original"),
            F.count_if(F.col("odd2") == 0).alias("ways"),
        )
        .select("word", F.when(~broken | (F.col("ways") == 1), F.col("original")).alias("original"))
    )
    named = lost.select("word").unionByName(best.select("word")).unionByName(words.filter(own).select("word")).distinct()
    return named.join(best, "word", "left").withColumn("sure", ~own)


def garbled_map(records: DataFrame) -> DataFrame:
    """(record, field, word, original, sure) of every word of a record that is garbled, or may be (``garbled_words``)."""
    stored = materialise(records_words(records), "words")
    each = stored.select("record", "field", F.explode("words").alias("word"))
    counted = materialise(each.groupBy("word").agg(F.count("*").alias("docs")), "vocabulary")
    return each.join(materialise(garbled_words(counted), "garbled"), "word")


def garbled_records(records: DataFrame) -> DataFrame:
    """record, field of the garbled records, restorable or not; ``records``: record, field, text."""
    return garbled_map(records).filter("sure").select("record", "field").distinct()


def restored_text(records: DataFrame) -> DataFrame:
    """record, field, text, restored of the garbled records; ``complete`` tells whether every garbled word was restored.

    Words wholly in another script are restored where the record has sure ones and all its words of that kind can be.
    """
    swap = lambda sure: F.collect_list(F.when(F.col("original").isNotNull() & sure, F.struct("word", "original")))
    per = materialise(  # its size is known from here on, so while it is small no text is shuffled to meet it
        garbled_map(records)
        .distinct()
        .groupBy("record", "field")
        .agg(
            swap(F.col("sure")).alias("sure_swaps"),
            swap(~F.col("sure")).alias("others"),
            F.bool_or("sure").alias("garbled"),
            F.bool_and(F.col("sure") | F.col("original").isNotNull()).alias("all_others"),
            F.bool_and(~F.col("sure") | F.col("original").isNotNull()).alias("complete"),
        )
        .filter("garbled")
        .select("record", "field", F.map_from_entries(F.when(F.col("all_others"), F.concat("sure_swaps", "others")).otherwise(F.col("sure_swaps"))).alias("swaps"), "complete"),
        "swaps",
    )

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for text, swaps in zip(b["text"].to_pylist(), b["swaps"].to_pylist()):
                table = dict(swaps or ())
                done.append(_WORD.sub(lambda m: table.get(m.group(), m.group()), text))
            yield pa.RecordBatch.from_arrays(
                [b["record"], b["field"], b["text"], pa.array(done, pa.string()), b["complete"]], ["record", "field", "text", "restored", "complete"]
            )

    return (
        records.select("record", "field", "text")
        .join(per, ["record", "field"])
        .dropDuplicates(["record", "field", "text"])  # of the garbled ones only
        .select("record", "field", "text", "swaps", "complete")
        .mapInArrow(kernel, "record string, field string, text string, restored string, complete boolean")
    )


def mail_records(messages: DataFrame, documents: DataFrame) -> DataFrame:
    """Subjects of messages and bodies of search documents, as records."""
    row = lambda i, field, text: (F.col(i).alias("record"), F.lit(field).alias("field"), F.col(text).alias("text"))
    return messages.select(*row("id", "subject", "subject")).unionByName(documents.select(*row("message_id", "body", "body")))
