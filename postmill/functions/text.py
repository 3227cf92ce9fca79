"""Search tokens: letters and digits, lower case, without diacritics, all in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Letters that decompose into a letter and marks, and these letters; then the marks, which are dropped."""
    take, give = [], []
    for point in range(0xC0, 0x2000):
        base = unicodedata.normalize("NFD", chr(point))
        if len(base) > 1 and all(unicodedata.combining(c) for c in base[1:]) and base[0].isalpha():
            take.append(chr(point))
            give.append(base[0])
    return "".join(take) + "".join(map(chr, range(0x300, 0x370))), "".join(give)


_TAKE, _GIVE = _accents()


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), _TAKE, _GIVE)


def tokens(text: Column) -> Column:
    """Array of tokens; null text has none."""
    return F.regexp_extract_all(F.coalesce(fold(text), F.lit("")), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def fold_word(word: str) -> str:
    """The same fold for a query's words."""
    return word.lower().translate({ord(t): (_GIVE[i] if i < len(_GIVE) else None) for i, t in enumerate(_TAKE)})
