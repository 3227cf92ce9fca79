"""The search language: any string parses to a flat list of clauses; nothing is an error.

``from:ann is:unread "exact words" -draft after:2026-03``: words and phrases are text clauses, the rest
filters. A field name that is not known, or that lacks a value, is text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone

TEXT_KINDS = ("text", "phrase")
# Field names of the language and the keywords behind is:.
FIELDS = {
    "from": "from", "to": "to", "cc": "to", "subject": "subject", "in": "mailbox", "mailbox": "mailbox", "list": "list",
    "before": "before", "until": "before", "after": "after", "since": "after",
}
STATES = {
    "unread": ("$seen", True), "unseen": ("$seen", True), "read": ("$seen", False), "seen": ("$seen", False), "flagged": ("$flagged", False),
    "starred": ("$flagged", False), "draft": ("$draft", False), "answered": ("$answered", False),
}
_PIECES = re.compile(r'"([^"]*)(?:"|$)|([^\s"]+)')
_DATE = re.compile(r"(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?")


@dataclass(frozen=True)
class Clause:
    kind: str  # text, phrase, from, to, subject, list, mailbox, keyword, attachment, before, after
    value: str
    negated: bool = False


@dataclass(frozen=True)
class Query:
    clauses: tuple[Clause, ...]
    raw: str

    @property
    def text(self) -> list[Clause]:
        return [c for c in self.clauses if c.kind in TEXT_KINDS]

    @property
    def filters(self) -> list[Clause]:
        return [c for c in self.clauses if c.kind not in TEXT_KINDS]


def tokens(raw: str) -> list[tuple[str, bool]]:
    """(value, quoted) pieces: quotes open and close runs, an open one reaches to the end, the rest splits at blanks."""
    return [(m.group(2), False) if m.group(2) is not None else (m.group(1), True) for m in _PIECES.finditer(raw)]


def instant(value: str) -> datetime | None:
    """Start, in UTC, of a year, month or day; None if the value is no date."""
    m = _DATE.fullmatch(value)
    if not m:
        return None
    try:
        return datetime(int(m[1]), int(m[2] or 1), int(m[3] or 1), tzinfo=timezone.utc)
    except ValueError:
        return None


def _clause(word: str, negated: bool) -> Clause:
    plain = Clause("text", word, negated)
    name, colon, value = word.partition(":")
    if not colon or not name or not value:
        return plain
    name = name.lower()
    if name == "is":
        state = STATES.get(value.lower())
        return Clause("keyword", state[0], negated != state[1]) if state else plain
    if name == "has":
        return Clause("attachment", "", negated) if value.lower() in ("attachment", "attachments") else plain
    kind = FIELDS.get(name)
    if kind is None:
        return plain
    if kind in ("before", "after"):
        at = instant(value)
        return Clause(kind, at.isoformat(), negated) if at else plain
    return Clause(kind, value, negated)


def parse(raw: str) -> Query:
    clauses = []
    for value, quoted in tokens(raw):
        if quoted:
            clauses.append(Clause("phrase", value))
        elif value.startswith("-") and len(value) > 1:
            clauses.append(_clause(value[1:], True))
        else:
            clauses.append(_clause(value, False))
    return Query(tuple(clauses), raw)
