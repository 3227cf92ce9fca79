"""Thread subjects: reply and forward prefixes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes that mark a reply and a forward.
REPLY = "re|res|aw|antw|sv|vs|ref|odp|r"
FORWARD = "fwd|fw|wg|tr|rv|enc|vb|i"
PASSES = 16


def _prefix(words: str) -> str:
    return rf"(?:{words})\s*(?:\[\d+\])?\s*:\s*"


_RUN = rf"(?i)^\s*(?:{_prefix(REPLY + '|' + FORWARD)}){{0,{PASSES}}}"


def collapsed(subject: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(subject, F.lit("")), r"\s+", " "))


def base_subject(subject: Column) -> Column:
    """Subject without its prefixes (16 at most); case is kept. The run of prefixes is one anchored match."""
    return F.trim(F.regexp_replace(collapsed(subject), _RUN, ""))


def _run(subject: Column) -> Column:
    return F.regexp_extract(collapsed(subject), _RUN, 0)


def is_reply(subject: Column) -> Column:
    return _run(subject).rlike(rf"(?i)(?:^|[:\s]){_prefix(REPLY)}")


def is_forward(subject: Column) -> Column:
    return _run(subject).rlike(rf"(?i)(?:^|[:\s]){_prefix(FORWARD)}")
