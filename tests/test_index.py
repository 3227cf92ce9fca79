"""The index on disk: searches equal those over the documents, changes and reopening included."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from postmill.plans import search
from postmill.plans.index import SearchIndex

NOW = datetime(2026, 10, 1, tzinfo=timezone.utc)
DOCS = "message_id string, account_id string, subject string, sender string, recipients string, body string, token string, dl string"
MESSAGES = "id string, account_id string, received_at timestamp, preview string, keywords array<string>, mailbox_ids array<string>, has_attachment boolean"
WORDS = "plan draft archive box half finished numéro Zoé naïve a b".split()


def documents(spark, seed, n=60):
    r = random.Random(seed)
    text = lambda k: " ".join(r.choice(WORDS) for _ in range(r.randrange(k)))
    rows = [(f"m{i}", f"acc{i % 3}", text(4), None, text(3), text(12) if i % 7 else None, "clash", "clash") for i in range(n)]
    return rows + rows[:5]


@pytest.fixture(scope="module")
def tables(spark):
    rows = documents(spark, 1)
    docs = spark.createDataFrame(rows, DOCS)
    messages = spark.createDataFrame([(f"m{i}", f"acc{i % 3}", datetime(2026, 1, 1 + i % 20), "p", [], [], i % 2 == 0) for i in range(60)], MESSAGES)
    return docs, messages, spark.createDataFrame([], "id string, account_id string, name string")


def hits(query, tables, source):
    docs, messages, boxes = tables
    found = search.search(query, "acc1", messages, source, boxes, NOW)
    return [(r.id, r.score, r.snippet) for r in found.select("id", "score", "snippet").collect()]


def test_equals_the_scan_and_follows_changes(spark, tables, tmp_path):
    docs = tables[0]
    path = f"file://{tmp_path}/index"
    index = SearchIndex(spark, path, buckets=8)
    index.add(docs)
    assert index.count() == 60
    for query in ("draft", "plan archive", '"a b"', '"a a"', "half-finished", "draft -box", "numero", "has:attachment draft", "nowhere", "-box"):
        assert hits(query, tables, index) == hits(query, tables, docs), query
    new = spark.createDataFrame([("m1", "acc1", "draft draft", None, None, "quite new"), ("m100", "acc1", "draft", None, None, None)], "message_id string, account_id string, subject string, sender string, recipients string, body string")
    gone = spark.createDataFrame([("m4",), ("not there",)], "message_id string")
    index.add(new)
    index.remove(gone)
    index.clear("acc2")
    now = docs.select(new.columns).join(new, "message_id", "left_anti").filter("message_id <> 'm4' and account_id <> 'acc2'").unionByName(new)
    again = SearchIndex(spark, path)
    assert again.count() == now.select("message_id").distinct().count()
    for query in ("draft", "quite", "plan"):
        assert hits(query, tables, again) == hits(query, tables, now), query
    again.optimise()
    assert len(again.segments) == 1 and again.dead == []
    assert hits("draft", tables, SearchIndex(spark, path)) == hits("draft", tables, now)


def test_a_search_reads_the_buckets_of_its_words(spark, tables, tmp_path):
    index = SearchIndex(spark, f"file://{tmp_path}/index", buckets=8)
    index.add(tables[0])
    rows = index.postings(["draft"])
    assert {r.token for r in rows.select("token").distinct().collect()} == {"draft"}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "EqualTo(token,draft)" in plan
    assert len({f.split("bucket=")[1].split("/")[0] for f in rows.inputFiles()}) == 1 or rows.select("bucket").distinct().count() == 1


def test_empty(spark, tables, tmp_path):
    index = SearchIndex(spark, f"file://{tmp_path}/index")
    assert hits("draft", tables, index) == [] and index.count() == 0
    index.add(tables[0].limit(0))
    index.remove(tables[0].select("message_id"))
    index.optimise()
    assert index.count() == 0 and index.live().count() == 0 and index.all_postings().filter(F.col("token") == "a").count() == 0
