"""Splitting oversized texts at natural boundaries, by recursive bisection.

A text of more than ``limit`` tokens is cut at the strongest boundary near its midpoint; halves of more
than ``limit - overlap`` tokens are cut again. Then every piece but the first takes the last ``overlap``
tokens before it in front. Boundaries, strongest first: blank line, line end, sentence end, clause mark,
white space, any token edge. "Near" is the middle half of the part; the strongest boundary there wins,
nearest the midpoint among equals, the left one among equally near.

Edge cases: null, empty and blank texts, and texts within the limit, are one piece (null stays null). The
cores of the pieces (``core_start`` to ``core_end``) join to the whole text exactly. A single token is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.tokens import TOKEN
from postmill.session import spread

LIMIT, OVERLAP = 512, 64
PIECE = "doc_id bigint, piece int, pieces int, tokens int, overlap int, core_start bigint, core_end bigint, piece_text string"
_STOPS = np.array([ord(c) for c in ".!?…"], np.uint32)
_CLOSERS = np.array([ord(c) for c in "\"'”’»)]"], np.uint32)
_CLAUSE = np.array([ord(c) for c in ",;:—–"], np.uint32)


def strengths(text: str, spans: np.ndarray) -> np.ndarray:
    """Strength of the boundary before each token (0 before the first)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lines = np.concatenate([[0], np.cumsum(points == 10)])
    start, end = spans[1:, 0], spans[:-1, 1]
    last, before = points[end - 1], points[np.maximum(end - 2, 0)]
    feeds = lines[start] - lines[end]
    stop = np.isin(last, _STOPS) | np.isin(last, _CLOSERS) & np.isin(before, _STOPS)
    kind = np.where(stop, 3, np.where(np.isin(last, _CLAUSE), 2, 1))
    kind = np.where(feeds > 1, 5, np.where(feeds == 1, 4, kind))
    return np.concatenate([[0], np.where(start > end, kind, 0)]).astype(np.int8)


def cuts(text: str, spans: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Token numbers at which the cores of the pieces begin (the first is 0)."""
    n = len(spans)
    if n <= limit:
        return [0]
    room = limit - overlap
    strength = strengths(text, spans)
    out = []
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if b - a <= room:
            out.append(a)
            continue
        middle = (a + b) / 2
        reach = max(1, (b - a) // 4)
        low, high = max(a + 1, int(middle) - reach), min(b, int(middle) + reach + 1)
        window = strength[low:high]
        best = np.flatnonzero(window == window.max()) + low
        at = int(best[np.argmin(np.abs(best - middle))])
        todo += [(at, b), (a, at)]
    return out


def split_text(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int, str | None]]:
    """(tokens, overlap tokens, core start, core end, text) of each piece."""
    if not text or len(text) <= limit:  # no more tokens than characters
        return [(len(TOKEN.findall(text)) if text else 0, 0, 0, len(text or ""), text)]
    n = len(TOKEN.findall(text))
    if n <= limit:
        return [(n, 0, 0, len(text), text)]
    spans = np.array([m.span() for m in TOKEN.finditer(text)], np.int64)
    starts = cuts(text, spans, limit, overlap)
    spans = spans.tolist()
    out = []
    for k, a in enumerate(starts):
        b = starts[k + 1] if k + 1 < len(starts) else len(spans)
        core_start = spans[a][0] if k else 0
        core_end = spans[b][0] if b < len(spans) else len(text)
        lead = min(overlap, a)
        out.append((b - a + lead, lead, core_start, core_end, text[spans[a - lead][0] if k else 0 : core_end]))
    return out


def split_documents(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, whole: bool = True) -> DataFrame:
    """One row per piece: see ``PIECE``. ``whole=False`` leaves out the texts that are one piece.

    No shuffle: each text is split where it is read; texts of at most ``limit`` characters are not even
    sent to Python when ``whole`` is off.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("doc_id", pa.int64()), ("piece", pa.int32()), ("pieces", pa.int32()), ("tokens", pa.int32()), ("overlap", pa.int32()),
             ("core_start", pa.int64()), ("core_end", pa.int64()), ("piece_text", pa.string())]
        )
        for b in batches:
            rows = []
            for i, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                pieces = split_text(text, limit, overlap)
                if whole or len(pieces) > 1:
                    rows.extend((i, k, len(pieces), *p) for k, p in enumerate(pieces, 1))
            columns = list(zip(*rows)) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    rows = documents.select("doc_id", "text")
    if not whole:
        rows = rows.filter(F.length("text") > limit)
    return spread(rows).mapInArrow(kernel, PIECE)
