"""Queries of the general training-data problems: 2 (change feed), 3 (repeated deliveries), 4 (hierarchies)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators import changes, hierarchy
from postmill.session import table
from postmill.streaming import dedupe


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.facets(changes.apply_changes(table(spark, sf_dir, "event_log")))


def p2_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p2_found, read after the runs were compacted into one."""
    store = changes.ChangeStore(spark)
    store.append(changes.message_changes(table(spark, sf_dir, "event_log")), runs=4)
    store.compact()
    return changes.facets(store.state())


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.duplicate_pairs(dedupe.message_classes(spark, f"{sf_dir}/messages.parquet"))


def p3_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one delivery that is kept of each message."""
    kept = dedupe.unique_messages(spark, f"{sf_dir}/messages.parquet")
    return kept.select("delivery_id", "class_id", "deliveries")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hierarchy.message_hierarchy(table(spark, sf_dir, "messages"))
    return found.select(F.col("grp").alias("account_id"), "node_id", "root_id", "depth")


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full path and all descendants of every node, as text."""
    found = hierarchy.message_hierarchy(table(spark, sf_dir, "messages"), lists=True)
    return found.select(
        F.col("grp").alias("account_id"),
        "node_id",
        F.array_join("path", " ").alias("path"),
        F.array_join(F.array_sort("descendants"), " ").alias("descendants"),
    )


QUERIES = {f.__name__: f for f in (p2_found, p2_compacted, p3_found, p3_unique, p4_found, p4_paths)}

_P2 = """
with e as (
  select distinct seq, type, payload.message_id as k,
         list_sort(list_distinct(coalesce(payload.keywords, []))) as kw,
         list_sort(list_distinct(coalesce(payload.mailbox_ids, []))) as mb
  from event_log where payload.message_id is not null
), gone as (select k, max(seq) as r from e where type = 'message.removed' group by k),
born as (
  select e.k, min(e.seq) as o from e left join gone on e.k = gone.k
  where e.type = 'message.observed' and e.seq > coalesce(gone.r, -1) group by e.k
), kws as (
  select b.k, arg_max(e.kw, e.seq) as v from born b join e on e.k = b.k and e.seq > b.o
  where e.type = 'message.keywords.set' group by b.k
), mbs as (
  select b.k, arg_max(e.mb, e.seq) as v from born b join e on e.k = b.k and e.seq > b.o
  where e.type = 'message.mailboxes.set' group by b.k
)
select k as message_id, 'present' as facet, '' as value from born
union all select k, 'keyword', unnest(v) from kws
union all select k, 'mailbox', unnest(v) from mbs
"""

_KEYS = """
  select delivery_id, account_id, delivered_at,
         nullif(trim(provider_id), '') as pid,
         nullif(lower(regexp_replace(message_id_header[1], '^[\\s<]+|[\\s>]+$', '', 'g')), '') as mid,
         nullif(trim(lower(from_addr[1].address)), '') as sender
  from messages
"""

_CLASSES = f"""
with recursive m as ({_KEYS}), links as (
  select a.delivery_id as a, b.delivery_id as b from m a join m b
    on a.account_id = b.account_id and a.pid = b.pid and a.delivery_id <> b.delivery_id
  union
  select a.delivery_id, b.delivery_id from m a join m b
    on a.account_id = b.account_id and a.mid = b.mid and a.sender = b.sender and a.delivery_id <> b.delivery_id
), reach(a, b) as (
  select delivery_id, delivery_id from m
  union
  select r.a, l.b from reach r join links l on l.a = r.b
)"""

_P3 = _CLASSES + " select a as delivery_id_1, b as delivery_id_2 from reach where a < b"
_P3_UNIQUE = (
    _CLASSES
    + """, cls as (select a as delivery_id, min(b) as class_id from reach group by a)
select arg_min(c.delivery_id, (coalesce(epoch_us(m.delivered_at), 0)::hugeint * 1000000000000 + c.delivery_id)) as delivery_id,
       c.class_id, count(*) as deliveries
from cls c join m on m.delivery_id = c.delivery_id group by c.class_id"""
)

_TREES = r"""
with recursive m as (
  select delivery_id, account_id,
         nullif(lower(regexp_replace(message_id_header[1], '^[\s<]+|[\s>]+$', '', 'g')), '') as node_id,
         list_concat(coalesce(in_reply_to, []), list_reverse(coalesce(refs, []))) as cands
  from messages where account_id is not null
), nodes as (select distinct account_id, node_id from m where node_id is not null),
c as (
  select account_id, node_id, delivery_id, unnest(cands) as raw, generate_subscripts(cands, 1) as pos
  from m where node_id is not null
), c2 as (
  select account_id, node_id, delivery_id, pos,
         nullif(lower(regexp_replace(raw, '^[\s<]+|[\s>]+$', '', 'g')), '') as parent from c
), p as (
  select c2.account_id, c2.node_id, arg_min(c2.parent, c2.delivery_id * 100000 + c2.pos) as parent
  from c2 join nodes n on n.account_id = c2.account_id and n.node_id = c2.parent
  group by c2.account_id, c2.node_id
), links as (
  select n.account_id, n.node_id, p.parent from nodes n left join p on p.account_id = n.account_id and p.node_id = n.node_id
), down(account_id, node_id, root_id, depth, path) as (
  select account_id, node_id, node_id, 0::bigint, node_id from links where parent is null
  union all
  select l.account_id, l.node_id, d.root_id, d.depth + 1, d.path || ' ' || l.node_id
  from links l join down d on l.account_id = d.account_id and l.parent = d.node_id
)"""

_P4 = (
    _TREES
    + """
select l.account_id, l.node_id, coalesce(d.root_id, '') as root_id, coalesce(d.depth, -1) as depth
from links l left join down d on d.account_id = l.account_id and d.node_id = l.node_id"""
)
_P4_PATHS = (
    _TREES
    + """, up as (select account_id, unnest(string_split(path, ' ')) as anc, node_id from down),
below as (
  select account_id, anc, string_agg(node_id, ' ' order by node_id collate "C") as descendants
  from up where anc <> node_id group by account_id, anc
)
select l.account_id, l.node_id, coalesce(d.path, '') as path, coalesce(b.descendants, '') as descendants
from links l left join down d on d.account_id = l.account_id and d.node_id = l.node_id
left join below b on b.account_id = l.account_id and b.anc = l.node_id"""
)
_P4_PATHS = _P4_PATHS.replace(' collate "C"', "")

SQL = {
    "p2_found": _P2,
    "p2_compacted": _P2,
    "p3_found": _P3,
    "p3_unique": _P3_UNIQUE,
    "p4_found": _P4,
    "p4_paths": _P4_PATHS,
}
