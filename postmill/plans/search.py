"""Full-text search: matching, BM25 with recency, snippets, and the postings behind an index.

Three plans. A query with text over a ``SearchIndex`` reads the postings of its own words only, counts each word or
phrase from their positions, and joins only the hits with the messages. Without an index it scans the documents once and
counts with array functions inside the scan. A query without text never touches either. Statistics of the whole index
(documents, mean length, documents per phrase) enter the plan as literals.
"""

from __future__ import annotations

import math
import re
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import fold_word, tokens
from postmill.plans.index import FIELDS, SearchIndex, unique_documents
from postmill.plans.predicates import matching
from postmill.plans.query_language import Clause, Query, parse
from postmill.session import materialise, spread

K1, B = 1.2, 0.75
RECENCY_WEIGHT = 3.0
RECENCY_DAYS = 30.0
SNIPPET_TOKENS = 12


def phrase_of(clause: Clause) -> list[str]:
    """Tokens of a text clause; a word that holds several is a phrase."""
    return re.findall(r"[^\W_]+", fold_word(clause.value))


def tokenised(documents: DataFrame) -> DataFrame:
    """message_id, account_id, dl (tokens in all fields), and an array of tokens per field."""
    arrays = spread(documents).select("message_id", "account_id", *[tokens(F.col(f)).alias(f"{f}_t") for f in FIELDS])
    return arrays.withColumn("dl", reduce(Column.__add__, [F.size(f"{f}_t") for f in FIELDS]))


def postings(documents: DataFrame) -> DataFrame:
    """message_id, account_id, field, pos, token."""
    rows = tokenised(documents)
    parts = [rows.select("message_id", "account_id", F.lit(f).alias("field"), F.posexplode(f"{f}_t").alias("pos", "token")) for f in FIELDS]
    return reduce(DataFrame.unionByName, parts)


def document_frequencies(documents: DataFrame) -> DataFrame:
    """token, docs: distinct documents that hold it; one shuffle of distinct (token) per document, combined before it."""
    rows = tokenised(documents).select(F.explode(F.array_distinct(F.concat(*[f"{f}_t" for f in FIELDS]))).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("docs"))


def _borders(phrase: list[str]) -> bool:
    """Whether a phrase can overlap itself."""
    return any(phrase[:k] == phrase[-k:] for k in range(1, len(phrase)))


def _count_in(array: str, phrase: list[str]) -> Column:
    n = len(phrase)
    if _borders(phrase):
        wanted = F.array(*[F.lit(t) for t in phrase])
        starts = F.filter(
            F.sequence(F.lit(1), F.greatest(F.size(array) - (n - 1), F.lit(1))),
            lambda i: (F.size(array) >= n) & (F.slice(array, i, n) == wanted),
        )
        return F.when(F.array_contains(array, phrase[0]), F.size(starts)).otherwise(0)
    # each token stands between blanks of its own, so a phrase that cannot overlap itself is counted as a string
    text = F.concat(F.lit(" "), F.array_join(array, "  "), F.lit(" "))
    mark = " " + "  ".join(phrase) + " "
    return ((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)).cast("int")


def occurrences(phrase: list[str]) -> Column:
    """How often a phrase stands in a tokenised document, fields kept apart."""
    return reduce(Column.__add__, [_count_in(f"{f}_t", phrase) for f in FIELDS])


def idf(documents: int, holding: int) -> float:
    return max(1e-6, math.log((documents - holding + 0.5) / (holding + 0.5)))


def snippet(words: list[str], length: int = SNIPPET_TOKENS) -> Column:
    """Up to ``length`` words of the body from just before the first hit, with … where text was left out."""
    first = F.coalesce(reduce(F.least, [F.nullif(F.array_position("body_t", w), F.lit(0)) for w in words]) if len(words) > 1 else F.nullif(F.array_position("body_t", words[0]), F.lit(0)), F.lit(1))
    start = F.greatest(first - 3, F.lit(1))
    cut = F.array_join(F.slice("body_t", start.cast("int"), length), " ")
    return F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(F.size("body_t") > start + length - 1, "…").otherwise(""))


def bm25(rows: DataFrame, phrases: list[list[str]], unwanted: list[list[str]] = ()) -> DataFrame:
    """message_id, account_id, snippet, bm25 (negative, smaller is better) of the tokenised ``rows`` that hold all phrases and none unwanted."""
    hits = reduce(Column.__and__, [F.col(f"f{i}") > 0 for i in range(len(phrases))])
    bad = reduce(Column.__or__, [occurrences(p) > 0 for p in unwanted], F.lit(False))
    counts = [occurrences(p).alias(f"f{i}") for i, p in enumerate(phrases)]
    # one pass over the text; what is kept of it are a few numbers a document, and the snippets of the hits
    counted = rows.select("message_id", "account_id", "dl", "body_t", *counts, bad.alias("bad"))
    numbers = counted.select(
        "message_id", F.struct("dl", *[f"f{i}" for i in range(len(phrases))], "bad", "account_id", F.when(hits, snippet([p[0] for p in phrases])).alias("snippet")).alias("x")
    )
    counted = materialise(numbers.groupBy("message_id").agg(F.max("x").alias("x")).select("message_id", "x.*"), "counts")  # repeated documents count once
    stats = counted.agg(
        F.count("*"), F.coalesce(F.avg("dl"), F.lit(0.0)), *[F.count_if(F.col(f"f{i}") > 0) for i in range(len(phrases))]
    ).first()
    n, mean = stats[0], max(stats[1], 1e-9)
    parts = []
    for i in range(len(phrases)):
        f = F.col(f"f{i}")
        parts.append(F.lit(idf(n, stats[2 + i])) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / mean)))
    return counted.filter(hits & ~F.col("bad")).withColumn("bm25", -reduce(Column.__add__, parts))


def _back(places: Column, n: int) -> Column:
    return F.transform(places, lambda x: x - n)


def _starts(phrase: list[str]) -> Column:
    """How often a phrase stands in a document, from ``p``: the (token, field, positions) of the query's words in it, fields kept apart."""
    of = lambda word, field: F.flatten(F.transform(F.filter("p", lambda x: (x["token"] == word) & (x["field"] == field)), lambda x: x["positions"]))
    total = F.lit(0)
    for k in range(len(FIELDS)):
        at = of(phrase[0], k)
        for n, word in enumerate(phrase[1:], 1):
            at = F.array_intersect(at, _back(of(word, k), n))
        total = total + F.size(at)
    return total


def bm25_indexed(index: SearchIndex, phrases: list[list[str]], unwanted: list[list[str]] = ()) -> DataFrame:
    """message_id, account_id, segment, bm25 of the indexed documents that hold all phrases and none unwanted.

    What is read are the postings of the words in question; what is gathered of a document is at most four entries a word.
    """
    words = sorted({w for p in (*phrases, *unwanted) for w in p})
    rows = index.postings(words)
    wanted = sorted({w for p in phrases for w in p})
    per = rows.groupBy("message_id", "account_id", "segment", "dl").agg(
        F.collect_list(F.struct("token", "field", "positions")).alias("p"), *[F.max(F.when(F.col("token") == w, 1).otherwise(0)).alias(f"w{i}") for i, w in enumerate(wanted)]
    )
    own = [reduce(Column.__and__, [F.col(f"w{wanted.index(w)}") == 1 for w in set(p)]) for p in phrases]
    counted = per.filter(reduce(Column.__or__, own)).select(
        "message_id", "account_id", "segment", "dl", *[F.when(o, F.lit(1) * _starts(p)).otherwise(0).alias(f"f{i}") for i, (p, o) in enumerate(zip(phrases, own))],
        reduce(Column.__or__, [_starts(p) > 0 for p in unwanted], F.lit(False)).alias("bad"),
    )
    counted = materialise(counted, "counts")
    held = counted.agg(*[F.count_if(F.col(f"f{i}") > 0) for i in range(len(phrases))]).first()
    mean = max(index.length / max(index.documents, 1), 1e-9)
    hits = reduce(Column.__and__, [F.col(f"f{i}") > 0 for i in range(len(phrases))])
    parts = []
    for i in range(len(phrases)):
        f = F.col(f"f{i}")
        parts.append(F.lit(idf(index.documents, held[i])) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / mean)))
    return counted.filter(hits & ~F.col("bad")).withColumn("bm25", -reduce(Column.__add__, parts))


def _indexed_search(index: SearchIndex, account: str, kept: DataFrame, wanted: list, unwanted: list, now: datetime, weight: float, limit: int) -> DataFrame:
    hits = bm25_indexed(index, wanted, unwanted).filter(F.col("account_id") == account)
    scored = kept.select("id", "received_at").join(hits.select(F.col("message_id").alias("id"), "segment", "bm25"), "id")
    score = F.round(F.col("bm25") - recency(F.col("received_at"), now, weight), 6).alias("score")
    top = materialise(scored.select("id", "segment", score, "received_at").orderBy("score", F.desc("received_at"), F.desc("id")).limit(limit), "top")
    places = [(r["id"], r["segment"]) for r in top.select("id", "segment").collect()]  # at most ``limit``
    live = index.live().filter(F.col("bucket").isin(_buckets(index, [i for i, _ in places])) & F.col("message_id").isin([i for i, _ in places]))
    shown = live.select(F.col("message_id").alias("id"), "segment", F.col("body").alias("body_t")).select("id", "segment", snippet([p[0] for p in wanted]).alias("snippet"))
    return top.join(shown, ["id", "segment"]).select("id", "score", "snippet", "received_at").orderBy("score", F.desc("received_at"), F.desc("id"))


def _buckets(index: SearchIndex, ids: list[str]) -> list[int]:
    if not ids:
        return []
    return sorted({r[0] for r in index.spark.range(1).select(F.explode(F.array(*[index.bucket(F.lit(i)) for i in ids]))).collect()})


def recency(received: Column, now: datetime, weight: float) -> Column:
    """weight / (1 + age in days / 30); messages from the future count as new."""
    days = (F.unix_micros(F.lit(now)) - F.unix_micros(received)) / 86_400e6
    return F.lit(float(weight)) / (1 + F.greatest(days, F.lit(0.0)) / RECENCY_DAYS)


def search(
    query: str | Query,
    account: str,
    messages: DataFrame,
    documents: DataFrame | SearchIndex,
    mailboxes: DataFrame,
    now: datetime,
    weight: float = RECENCY_WEIGHT,
    limit: int = 50,
    strict_reference: bool = False,
) -> DataFrame:
    """id, score, snippet of the best hits, best first; ties by date and id. ``documents`` may be a ``SearchIndex``.

    Only excluded words: everything but what holds them (``strict_reference``: everything).
    """
    q = parse(query) if isinstance(query, str) else query
    wanted = [p for p in (phrase_of(c) for c in q.text if not c.negated) if p]
    unwanted = [p for p in (phrase_of(c) for c in q.text if c.negated) if p]
    filters = q.filters
    kept = matching(messages, mailboxes, account, filters)
    newest = (F.desc("received_at"), F.desc("id"))
    if not wanted:
        if unwanted and not strict_reference and isinstance(documents, SearchIndex):
            rows = documents.postings(sorted({w for p in unwanted for w in p})).filter(F.col("account_id") == account)
            held = rows.groupBy("message_id").agg(F.collect_list(F.struct("token", "field", "positions")).alias("p")).filter(reduce(Column.__or__, [_starts(p) > 0 for p in unwanted]))
            kept = kept.join(held.select(F.col("message_id").alias("id")), "id", "left_anti")
        elif unwanted and not strict_reference:
            bad = tokenised(documents.filter(F.col("account_id") == account)).filter(reduce(Column.__or__, [occurrences(p) > 0 for p in unwanted]))
            kept = kept.join(bad.select(F.col("message_id").alias("id")), "id", "left_anti")
        top = kept.orderBy(*newest).limit(limit)
        return top.select("id", F.lit(0.0).alias("score"), F.coalesce("preview", F.lit("")).alias("snippet"), "received_at")
    if isinstance(documents, SearchIndex):
        return _indexed_search(documents, account, kept, wanted, unwanted, now, weight, limit)
    hits = bm25(tokenised(documents), wanted, unwanted).filter(F.col("account_id") == account)  # statistics span all accounts
    scored = kept.select("id", "received_at").join(hits.select(F.col("message_id").alias("id"), "bm25", "snippet"), "id")
    score = F.round(F.col("bm25") - recency(F.col("received_at"), now, weight), 6)
    return scored.select("id", score.alias("score"), "snippet", "received_at").orderBy("score", *newest).limit(limit)
