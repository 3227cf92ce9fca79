"""Held-out passages in training text, found with a generalised suffix automaton.

The automaton is built over the words of the test items (lower case; words are maximal runs of letters and
digits). Each training text streams through it once; at every word the automaton holds the longest run of
words that ends there and occurs in some item. Where the run has at least ``words`` words, the state that
stands for its last ``words`` words names the items that hold them. Texts are read where they lie, without
a shuffle. Items come in blocks of at most about ``BLOCK_CHARS`` characters (the automaton's size is
proportional to that), one broadcast and one pass over the texts for each block, so the number of items is
not limited. With several blocks, what a block finds is written before the next one is built, so neither the
driver nor a worker ever holds more than one block; what all of them found is cut out of a text at once, so the
result does not depend on the blocks.

Memory: nearly every state of the automaton has one way on, which takes two integers in an array; only branching
states have a table of their own.

Edge cases: null and short texts and passages match nothing; equal passages of several items all count;
repeated items are reported once; an empty item table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.tokens import WORD
from postmill.session import materialise, spread

WORDS = 12
BLOCK_CHARS = 8_000_000
#: Spans are cut out whole; a text is dropped once this share of its words lies in them.
MAX_COVERAGE = 0.8


class Automaton:
    """Generalised suffix automaton over words, with the items of each state of length ``words``."""

    def __init__(self, items: Iterable[tuple[str, str]], words: int = WORDS) -> None:
        self.words = words
        self.vocabulary: dict[str, int] = {}
        self.names: list[str] = []
        # a state's only word and where it leads (-1: none), or, where there are more, its table
        self.word, self.to = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        texts = []
        for name, passage in items:
            ids = array("i", [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in WORD.findall((passage or "").lower())])
            if len(ids) >= words:
                texts.append((len(self.names), ids))
                self.names.append(name)
                self._add(ids)
        self.items: dict[int, int | list[int]] = {}  # of a state: its item, or all of them
        for k, ids in texts:
            for _, state in self._states(ids):
                held = self.items.get(state)
                if held is None:
                    self.items[state] = k
                elif isinstance(held, int):
                    if held != k:
                        self.items[state] = [held, k]
                elif held[-1] != k:  # items come in order
                    held.append(k)

    def _way(self, state: int, c: int) -> int:
        """Where word ``c`` leads from a state; -1 if nowhere."""
        if self.word[state] == c:
            return self.to[state]
        table = self.more.get(state)
        return -1 if table is None else table.get(c, -1)

    def _lead(self, state: int, c: int, to: int) -> None:
        if self.word[state] == c or self.word[state] == -1:
            self.word[state], self.to[state] = c, to
        else:
            self.more.setdefault(state, {})[c] = to

    def _state(self, length: int, link: int) -> int:
        self.word.append(-1)
        self.to.append(-1)
        self.length.append(length)
        self.link.append(link)
        return len(self.word) - 1

    def _add(self, ids: Iterable[int]) -> None:
        link, length = self.link, self.length
        last = 0
        for c in ids:
            q = self._way(last, c)
            if q >= 0:  # the run is known from another item
                last = q if length[q] == length[last] + 1 else self._clone(last, c, q)
                continue
            new = self._state(length[last] + 1, 0)
            p = last
            while p >= 0 and self._way(p, c) < 0:
                self._lead(p, c, new)
                p = link[p]
            if p >= 0:
                q = self._way(p, c)
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = new

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q])
        self.word[clone], self.to[clone] = self.word[q], self.to[q]
        if q in self.more:
            self.more[clone] = dict(self.more[q])
        self.link[q] = clone
        while p >= 0 and self._way(p, c) == q:
            self._lead(p, c, clone)
            p = self.link[p]
        return clone

    def _states(self, ids: Iterable[int]) -> Iterator[tuple[int, int]]:
        """(position, state of the last ``words`` words) wherever a run of at least that length ends."""
        word, to, more, link, length, words = self.word, self.to, self.more, self.link, self.length, self.words
        state = run = 0
        for at, c in enumerate(ids):
            if c < 0:
                state = run = 0
                continue
            while True:
                if word[state] == c:
                    state = to[state]
                    run += 1
                    break
                table = more.get(state)
                if table is not None and c in table:
                    state = table[c]
                    run += 1
                    break
                if not state:
                    run = 0
                    break
                state = link[state]
                run = length[state]
            if run >= words:
                top = state
                while length[link[top]] >= words:
                    top = link[top]
                yield at, top

    def matches(self, text: str | None) -> dict[str, list[int]]:
        """Item to the (word) positions at which ``words`` of its words end."""
        out: dict[str, list[int]] = {}
        if not text:
            return out
        low = text.lower()  # a few capitals become two characters; then word by word
        found = WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]
        if len(found) < self.words:
            return out
        get = self.vocabulary.get
        for at, state in self._states([get(w, -1) for w in found]):
            held = self.items.get(state)
            if held is not None:
                for k in (held,) if isinstance(held, int) else held:
                    out.setdefault(self.names[k], []).append(at)
        return out


def _blocks(items: DataFrame, block_chars: int) -> tuple[int, Iterator[list[tuple[str, str]]]]:
    """Number of blocks, and the items of each in turn, as a list on the driver (bounded; collected when its turn comes)."""
    rows = items.select("item_id", "passage").filter(F.col("item_id").isNotNull() & F.col("passage").isNotNull()).distinct()
    chars = rows.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0))).first()[0]
    blocks = -(-chars // block_chars)

    def each() -> Iterator[list[tuple[str, str]]]:
        for k in range(blocks):
            part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
            yield sorted((r["item_id"], r["passage"]) for r in part.collect())

    return blocks, each()


FOUND = "doc_id bigint, digest binary, item_id string, ends array<int>"


def _found(documents: DataFrame, items: DataFrame, words: int, block_chars: int) -> DataFrame:
    """doc_id, digest of the text, item_id, and the positions at which ``words`` words of the item end."""
    spark = documents.sparkSession
    blocks, each = _blocks(items, block_chars)
    parts = []
    for block in each:
        shared = spark.sparkContext.broadcast(block)

        def kernel(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = _built(shared, words)
            for b in batches:
                rows = []
                for i, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                    found = automaton.matches(text)
                    if found:
                        digest = _digest(text)
                        rows += [(i, digest, item, ends) for item, ends in found.items()]
                columns = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.list_(pa.int32()))],
                    ["doc_id", "digest", "item_id", "ends"],
                )

        part = spread(documents.select("doc_id", "text")).mapInArrow(kernel, FOUND)
        if blocks > 1:
            part = materialise(part, "leaks")
            shared.destroy()
        parts.append(part)
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], FOUND)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def leaked_items(documents: DataFrame, items: DataFrame, words: int = WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, words_matched: texts that hold at least ``words`` consecutive words of the item's passage."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = pa.array([_covered(ends, words) for ends in b["ends"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["item_id"], counts], ["doc_id", "item_id", "words_matched"])

    return _found(documents, items, words, block_chars).mapInArrow(count, "doc_id bigint, item_id string, words_matched bigint")


_CACHE: dict = {}


def _built(shared, words: int) -> Automaton:
    """One automaton per worker process, kept for its further tasks."""
    items = shared.value
    key = (id(items), words)
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = (Automaton(items, words), items)  # holding the items keeps their id from being used again
    return _CACHE[key][0]


def _covered(ends: list[int], words: int) -> int:
    """Number of words in the union of the runs that end there."""
    total, until = 0, -1
    for end in ends:
        total += end - max(until, end - words)
        until = end
    return total


def cut(text: str | None, ends: list[int], words: int = WORDS, max_coverage: float = MAX_COVERAGE) -> tuple[str | None, int]:
    """Text without the runs of ``words`` words that end at ``ends`` (null where they cover too much of it), and the words removed."""
    if not text or not ends:
        return text, 0
    ends = sorted(set(ends))
    spans = [m.span() for m in WORD.finditer(text)]
    removed = _covered(ends, words)
    if removed > max_coverage * len(spans):
        return None, removed
    out, at, k = [], 0, 0
    while k < len(ends):
        first = ends[k] - words + 1
        while k + 1 < len(ends) and ends[k + 1] - words + 1 <= ends[k] + 1:
            k += 1
        out.append(text[at : spans[first][0]])
        at = spans[ends[k]][1]
        k += 1
    out.append(text[at:])
    return "".join(out), removed


def without_leaks(
    documents: DataFrame, items: DataFrame, words: int = WORDS, max_coverage: float = MAX_COVERAGE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """doc_id, text, removed_words of every document, leaked spans cut out; text is null where they cover too much of it.

    With one block of items the texts are cut as they are read. With several, what all blocks found of a text comes first; the join
    that brings it to its text is a broadcast while the findings, whose size is known by then, are small, and a sort-merge join beyond.
    """
    spark = documents.sparkSession
    result = "doc_id bigint, text string, removed_words bigint"
    rows = spread(documents.select("doc_id", "text"))

    def done(ids, texts: list, ends: list) -> pa.RecordBatch:
        cuts = [cut(t, e or [], words, max_coverage) for t, e in zip(texts, ends)]
        return pa.RecordBatch.from_arrays([ids, pa.array([c[0] for c in cuts], pa.string()), pa.array([c[1] for c in cuts], pa.int64())], ["doc_id", "text", "removed_words"])

    blocks, each = _blocks(items, block_chars)
    if blocks <= 1:
        shared = spark.sparkContext.broadcast(next(each, []))

        def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _built(shared, words)
            for b in batches:
                texts = b["text"].to_pylist()
                yield done(b["doc_id"], texts, [[e for es in automaton.matches(t).values() for e in es] for t in texts])

        return rows.mapInArrow(at_once, result)

    found = _found(documents, items, words, block_chars)
    per = materialise(found.groupBy("doc_id", "digest").agg(F.array_distinct(F.flatten(F.collect_list("ends"))).alias("ends")), "leaks")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = [_digest(t) if t else None for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text"], pa.array(digests, pa.binary())], ["doc_id", "text", "own"])

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield done(b["doc_id"], b["text"].to_pylist(), b["ends"].to_pylist())

    keyed = rows.mapInArrow(digested, "doc_id bigint, text string, own binary")
    mine = per.withColumnRenamed("doc_id", "id")
    joined = keyed.join(mine, keyed["doc_id"].eqNullSafe(mine["id"]) & (keyed["own"] == mine["digest"]), "left")
    return joined.select("doc_id", "text", "ends").mapInArrow(cutting, result)
