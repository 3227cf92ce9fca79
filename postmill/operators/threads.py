"""Conversations from reference headers and subjects, independent of the order of arrival.

1. Messages that share any identifier fall into one component (distributed connected components).
2. Inside a component, messages taken by (received_at, id) claim their identifier and link their reference
   chains; first parents win, loops are refused, containers without a message are pruned away.
3. Roots of one account and base subject are joined without a fold: every reply root goes to the first root
   that is none, or, where all are replies, to the first. Forwards take no part. This is an aggregate and a join.
4. Members, participants, counts and ids are aggregates.

Step 2 holds one component in a task at a time (a conversation, not an account).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions.ids import message_id_key
from postmill.functions.subjects import base_subject, is_forward, is_reply
from postmill.operators.components import connected_components
from postmill.session import materialise, shuffle_partitions

ROOTS = (
    "id string, root string, root_at timestamp, root_by string, root_ordinal int, root_subject string, shown_subject string"
)
ID_HEAD = 440


def thread_inputs(messages: DataFrame) -> DataFrame:
    """account_id, id, received_at, subject, declared (own Message-ID), chain (references, then in-reply-to not among them)."""
    empty = F.array().cast("array<string>")
    keys = lambda c: F.filter(F.transform(F.coalesce(c, empty), message_id_key), lambda x: x.isNotNull())
    refs, replies = keys(F.col("refs")), keys(F.col("in_reply_to"))
    return messages.select(
        "account_id", "id", F.coalesce("received_at", F.timestamp_seconds(F.lit(0))).alias("received_at"), F.coalesce("subject", F.lit("")).alias("subject"),
        F.get(keys(F.col("message_id_header")), F.lit(0)).alias("declared"),
        F.concat(refs, F.array_distinct(F.array_except(replies, refs))).alias("chain"),
    )


def components(inputs: DataFrame) -> DataFrame:
    """id, component of every message: messages that share an identifier, directly or through others."""
    # 128 bits: with any number of messages no two identities fall together
    name = lambda *parts: F.unhex(F.md5(F.to_json(F.struct(*parts))))
    mine = name(F.lit("message").alias("a"), F.col("account_id").alias("b"), F.col("id").alias("c"))
    keys = F.array_distinct(F.array_compact(F.concat(F.array("declared"), "chain")))
    named = inputs.select(mine.alias("a"), F.explode(keys).alias("k"), "account_id").select("a", name(F.col("account_id").alias("a"), F.col("k").alias("b")).alias("k"))
    # one anchor for each identifier, its least message: identifiers are no nodes, and those of one message no edges
    anchor = named.groupBy("k").agg(F.min("a").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    found = connected_components(named.join(anchor, "k").select("a", "b"))
    return inputs.select("account_id", "id", mine.alias("h")).join(found, F.col("h") == F.col("node"), "left").select(
        "account_id", "id", F.coalesce("component", "h").alias("component")
    )


class Forest:
    """Containers of one component, by number: names, messages, parents, and a shortcut to the root of each.

    A container without a parent is the root of its tree, so a link closes a loop just where the child is the root of the parent's tree;
    the shortcuts are halved on the way, so asking for a root takes near constant time however deep the tree.
    """

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.names: list[str] = []
        self.born: list[tuple] = []
        self.message: list[dict | None] = []
        self.parent: list[int] = []
        self.short: list[int] = []
        self.linked: list[int] = []  # children in the order they were linked, which is that of siblings

    def container(self, name: str, born: tuple) -> int:
        k = self.number.setdefault(name, len(self.names))
        if k == len(self.names):
            self.names.append(name)
            self.born.append(born)
            self.message.append(None)
            self.parent.append(-1)
            self.short.append(k)
        return k

    def root(self, k: int) -> int:
        short = self.short
        while short[k] != k:
            short[k] = short[short[k]]
            k = short[k]
        return k

    def link(self, parent: int, child: int) -> None:
        """First parent wins; a link that would close a loop is refused."""
        if self.parent[child] < 0 and self.root(parent) != child:
            self.parent[child] = self.short[child] = parent
            self.linked.append(child)

    def add(self, m: dict) -> None:
        """Take the next message (in order of received_at and id): claim its own container and link its chain down to it."""
        first = len(self.names)
        at = lambda: (m["received_at"], m["id"], len(self.names) - first)
        own = m["declared"]
        taken = own is None or own in self.number and self.message[self.number[own]] is not None
        mine = self.container(f"local:{m['id']}" if taken else own, at())
        self.message[mine] = m
        chain = [self.container(name, at()) for name in m["chain"]]
        for parent, child in zip(chain, [*chain[1:], mine]):
            self.link(parent, child)

    def trees(self) -> list[tuple[int, int, dict | None, dict | None, list[dict]]]:
        """(root container, the one that stands for it, its message, the first message right below it, all messages) of every tree that holds messages.

        Empty containers below the root give their children to the next one above that stays; an empty root with just one child that
        remains is replaced by it, and keeps its own place in the order.
        """
        n = len(self.names)
        kids: list[list[int]] = [[] for _ in range(n)]
        for k in self.linked:
            kids[self.parent[k]].append(k)
        out = []
        for top in (k for k in range(n) if self.parent[k] < 0):
            order, todo = [], [top]
            while todo:
                k = todo.pop()
                order.append(k)
                todo.extend(kids[k])
            held: dict[int, list[int]] = {}  # of each container, the nearest ones below with a message
            for k in reversed(order):
                filled = [c for c in kids[k] if self.message[c] is not None]
                held[k] = filled + [x for c in kids[k] if self.message[c] is None for x in held.pop(c)]  # those handed up come last
            members = [self.message[k] for k in order if self.message[k] is not None]
            if not members:
                continue
            head = top
            if self.message[top] is None and len(held[top]) == 1:
                head = held[top][0]
            first = self.message[held[head][0]] if held[head] else None
            out.append((top, head, self.message[head], first, members))
        return out


def linked(messages: Iterable[dict]) -> Forest:
    """The forest of one component's messages."""
    forest = Forest()
    for m in sorted(messages, key=lambda m: (m["received_at"], m["id"])):
        forest.add(m)
    return forest


def _roots(group: list[dict]) -> Iterator[tuple]:
    forest = linked(group)
    for top, head, message, first, members in forest.trees():
        own = message["subject"] if message is not None else None
        grouping = own if own is not None else first["subject"] if first else ""
        yield from ((m["id"], forest.names[head], *forest.born[top], grouping, own) for m in members)


def _kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One component after the other; the rows come sorted by component, so a task holds one of them at a time."""
    schema = pa.schema(
        [("id", pa.string()), ("root", pa.string()), ("root_at", pa.timestamp("us", "UTC")), ("root_by", pa.string()), ("root_ordinal", pa.int32()),
         ("root_subject", pa.string()), ("shown_subject", pa.string())]
    )
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    group: list[dict] = []
    rows: list[tuple] = []
    for m in (m for b in batches for m in b.to_pylist()):
        if group and group[0]["component"] != m["component"]:
            rows += _roots(group)
            group = []
            if len(rows) >= 10_000:
                yield table(rows)
                rows = []
        group.append(m)
    if group:
        rows += _roots(group)
    if rows:
        yield table(rows)


@F.udf(T.StringType())
def _tail_hash(text):
    """32-bit FNV-1a over UTF-16 units, in hex; only identifiers beyond the length bound come here."""
    h = 2166136261
    raw = text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(raw), 2):
        h = (h ^ (raw[i] | raw[i + 1] << 8)) * 16777619 & 0xFFFFFFFF
    return f"{h:08x}"


def assign(messages: DataFrame) -> DataFrame:
    """account_id, id, received_at, root, base: the root container of each message after subject joining, and the thread's subject."""
    inputs = materialise(thread_inputs(messages), "thread-inputs")
    work = inputs.join(components(inputs), ["account_id", "id"]).select("component", "id", "received_at", "subject", "declared", "chain")
    rooted = materialise(work.repartition(shuffle_partitions(messages.sparkSession), "component").sortWithinPartitions("component").mapInArrow(_kernel, ROOTS), "rooted")
    rooted = inputs.select("account_id", "id", "received_at", "subject").join(rooted, "id")
    key = F.struct("root_at", "root_by", "root_ordinal", "root")
    roots = rooted.groupBy("account_id", "root").agg(
        F.min(key).alias("born"), F.first("root_subject").alias("s"), F.first("shown_subject").alias("shown"), F.min_by("subject", F.struct("received_at", "id")).alias("first_subject")
    )
    roots = roots.select(
        "account_id", "root", "born", "shown", "first_subject", base_subject(F.col("s")).alias("base"), is_reply(F.col("s")).alias("reply"), is_forward(F.col("s")).alias("forward")
    )
    taking = roots.filter((F.col("base") != "") & (F.col("reply") | ~F.col("forward")))
    target = taking.groupBy("account_id", "base").agg(F.min_by("root", F.struct("reply", "born")).alias("into"))
    moved = taking.filter("reply").join(target, ["account_id", "base"]).select("account_id", "root", "into").filter("root <> into")
    final = rooted.select("account_id", "id", "received_at", "root").join(moved, ["account_id", "root"], "left")
    named = roots.select("account_id", F.col("root").alias("top"), F.col("shown"))
    return (
        final.withColumn("top", F.coalesce("into", "root"))
        .join(named, ["account_id", "top"])
        .select("account_id", "id", "received_at", F.col("top").alias("root"), "shown")
    )


def thread_id(root):
    return F.when(F.length(root) <= ID_HEAD, F.concat(F.lit("t:"), root)).otherwise(
        F.concat(F.lit("t:"), F.substring(root, 1, ID_HEAD), F.lit("~"), _tail_hash(root))
    )


def threads(messages: DataFrame) -> DataFrame:
    """account_id, thread_id, subject, message_count, last_message_at, message_ids (old to new), newest thread first."""
    placed = assign(messages).join(messages.select("account_id", "id", "subject"), ["account_id", "id"])
    at = F.struct("received_at", "id")
    rows = placed.groupBy("account_id", "root").agg(
        F.count("*").alias("message_count"),
        F.max("received_at").alias("last_message_at"),
        F.transform(F.array_sort(F.collect_list(at)), lambda x: x["id"]).alias("message_ids"),
        base_subject(F.coalesce(F.first("shown", True), F.min_by("subject", at))).alias("subject"),
    )
    return rows.select("account_id", thread_id(F.col("root")).alias("thread_id"), "subject", "message_count", "last_message_at", "message_ids").orderBy(
        "account_id", F.desc("last_message_at"), "thread_id"
    )


def thread_of(all_threads: DataFrame, message_id: str) -> DataFrame:
    return all_threads.filter(F.array_contains("message_ids", message_id)).select("thread_id")
