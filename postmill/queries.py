"""Registered queries over the store's tables, each with the DuckDB SQL that must give the same rows.

Dates leave as microseconds and sets as joined text, so that both engines print them alike.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import mime, provider
from postmill.functions.subjects import base_subject, is_forward, is_reply
from postmill.operators import blobs, event_log, intents, listing, projection, threads
from postmill.plans import rules, search
from postmill.plans.index import SearchIndex
from postmill.plans.predicates import matching
from postmill.plans.query_language import parse
from postmill.schemas import value_set
from postmill.session import materialise, scratch_path, table
from postmill.streaming import sync

ACCOUNT = "acc-0001"
NOW = datetime(2026, 10, 1, tzinfo=timezone.utc)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _messages(spark: SparkSession, d: str, account: str | None = None) -> DataFrame:
    return listing.current_messages(table(spark, d, "messages"), account)


def _mailboxes(spark: SparkSession, d: str) -> DataFrame:
    return listing.current_mailboxes(table(spark, d, "mailboxes"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return search.unique_documents(table(spark, d, "search_documents"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "event_log")


def _us(c: str) -> Column:
    return F.unix_micros(c).alias(c)


M = "m as (select * from messages where id is not null qualify row_number() over (partition by id order by delivery_id desc) = 1)"
B = "b as (select distinct id, account_id, provider_id, trim(name) as name, parent_id, role, sort_order, reported_total, reported_unread from mailboxes)"
D = (
    "d as (select * from search_documents qualify row_number() over (partition by message_id order by account_id desc nulls last, "
    "subject desc nulls last, sender desc nulls last, recipients desc nulls last, body desc nulls last) = 1)"
)

# --- lists ------------------------------------------------------------------------------------------------------------

_PAGE = "id, epoch_us(received_at) as received_at, subject"


def _page(spark: SparkSession, d: str, **conditions) -> DataFrame:
    rows = listing.list_messages(_messages(spark, d, ACCOUNT), listing.Filter(ACCOUNT, **conditions))
    return rows.select("id", _us("received_at"), "subject")


@query(f"with {M} select {_PAGE} from m where account_id = '{ACCOUNT}' order by m.received_at desc, id desc limit 50")
def list_page(spark, d):
    return _page(spark, d)


@query(
    f"with {M} select {_PAGE} from m where account_id = '{ACCOUNT}' and (m.received_at, id) < "
    f"(timestamptz '2026-06-01 00:00:00+00', 'm:{ACCOUNT}:5') order by m.received_at desc, id desc limit 50"
)
def list_keyset_next(spark, d):
    return _page(spark, d, after=(datetime(2026, 6, 1, tzinfo=timezone.utc), f"m:{ACCOUNT}:5"))


@query(f"with {M} select id from m where account_id = '{ACCOUNT}' and list_contains(mailbox_ids, 'mb:{ACCOUNT}:f01')")
def list_by_mailbox(spark, d):
    return _messages(spark, d, ACCOUNT).filter(listing.condition(listing.Filter(ACCOUNT, mailbox=f"mb:{ACCOUNT}:f01"))).select("id")


@query(f"with {M} select id from m where account_id = '{ACCOUNT}' and list_contains(keywords, '$flagged')")
def has_keyword(spark, d):
    return _messages(spark, d, ACCOUNT).filter(listing.condition(listing.Filter(ACCOUNT, keywords=("$flagged",)))).select("id")


@query(f"with {M} select id from m where account_id = '{ACCOUNT}' and not coalesce(list_contains(keywords, '$seen'), false)")
def lacks_keyword(spark, d):
    return _messages(spark, d, ACCOUNT).filter(listing.condition(listing.Filter(ACCOUNT, not_keywords=("$seen",)))).select("id")


@query(
    f"with {M} select id from m where account_id = '{ACCOUNT}' and received_at >= timestamptz '2026-01-01 00:00:00+00' "
    "and received_at < timestamptz '2026-07-01 00:00:00+00' and list_contains(keywords, '$seen') and not coalesce(list_contains(keywords, '$flagged'), false)"
)
def list_between(spark, d):
    f = listing.Filter(
        ACCOUNT, keywords=("$seen",), not_keywords=("$flagged",), received_after=datetime(2026, 1, 1, tzinfo=timezone.utc), received_before=datetime(2026, 7, 1, tzinfo=timezone.utc)
    )
    return _messages(spark, d, ACCOUNT).filter(listing.condition(f)).select("id")


@query(f"with {M} select id, thread_id from m where account_id = '{ACCOUNT}' and thread_id in (select thread_id from m where has_attachment and account_id = '{ACCOUNT}')")
def by_thread(spark, d):
    """Messages of the account in threads where something is attached (semi join on the thread)."""
    m = _messages(spark, d, ACCOUNT)
    return m.join(m.filter("has_attachment").select("thread_id"), "thread_id", "left_semi").select("id", "thread_id")


@query(f"with {M} select id, size, array_to_string(list_sort(list_distinct(coalesce(keywords, []))), ',') as keywords from m where id = (select min(id) from m)")
def message_read(spark, d):
    m = _messages(spark, d)
    first = m.agg(F.min("id")).first()[0]
    return listing.read_message(m, first or "").select("id", "size", F.array_join(value_set(F.col("keywords")), ",").alias("keywords"))


@query(f"with {B} select id, name, role, sort_order from b where account_id = '{ACCOUNT}'")
def mailbox_list(spark, d):
    return listing.list_mailboxes(_mailboxes(spark, d), ACCOUNT).select("id", "name", "role", "sort_order")


@query(f"with {M} select account_id, count(*) as messages from m group by account_id")
def message_count(spark, d):
    return listing.message_counts(_messages(spark, d))


@query(
    f"with {M} select account_id, thread_id, count(*) as message_count, epoch_us(max(received_at)) as last_message_at, "
    "string_agg(id, ' ' order by received_at, id) as message_ids from m where thread_id is not null group by account_id, thread_id"
)
def thread_rollup(spark, d):
    t = listing.thread_members(_messages(spark, d))
    return t.select("account_id", "thread_id", "message_count", _us("last_message_at"), F.array_join("message_ids", " ").alias("message_ids"))


@query(
    f"""with {M}, p as (
  select account_id, thread_id, received_at, id,
         list_concat(list_concat(coalesce(from_addr, []), coalesce(to_addr, [])), coalesce(cc_addr, [])) as people from m where thread_id is not null
), u as (select account_id, thread_id, received_at, id, generate_subscripts(people, 1) as pos, lower(unnest(people).address) as address from p),
f as (select account_id, thread_id, address, min((received_at, id, pos)) as since from u where coalesce(address, '') <> '' group by all)
select account_id, thread_id, string_agg(address, ' ' order by since) as participants from f group by account_id, thread_id"""
)
def thread_participants(spark, d):
    t = listing.participants(_messages(spark, d))
    return t.select("account_id", "thread_id", F.array_join("participants", " ").alias("participants"))


@query(
    f"with {M} select account_id, list_sort(list(size))[least(count(*) - 1, floor(count(*) * 0.95))::int + 1] as p95_size "
    "from m where size is not null group by account_id"
)
def size_percentile(spark, d):
    return listing.nearest_rank(_messages(spark, d), "account_id", "size", 0.95).withColumnRenamed("size", "p95_size")


# --- log and replay ---------------------------------------------------------------------------------------------------


@query("select coalesce(max(seq), 0) as latest_seq, count(distinct seq) as entries from event_log")
def latest_seq(spark, d):
    return event_log.latest(_log(spark, d))


@query(f"select distinct seq, type from event_log where account_id = '{ACCOUNT}' and seq > 500 order by seq limit 10000")
def log_since(spark, d):
    return event_log.since(event_log.distinct_entries(_log(spark, d).select("seq", "account_id", "type")), ACCOUNT, 500).select("seq", "type")


@query("select type, count(distinct seq) as entries from event_log group by type")
def log_types(spark, d):
    return _log(spark, d).groupBy("type").agg(F.count_distinct("seq").alias("entries"))


@query(
    """with mine as (select seq, type, row_number() over (order by seq) as rn from (select distinct seq, type from event_log where type = 'message.removed'))
select (select max(seq) from event_log) + rn as seq, type from mine"""
)
def log_append(spark, d):
    log = _log(spark, d)
    new = event_log.distinct_entries(log.filter(F.col("type") == "message.removed")).withColumn("position", F.col("seq")).drop("seq")
    return event_log.append(log, new).select(F.col("seq").cast("bigint").alias("seq"), "type")


_LIVE = """gone as (select payload.message_id as k, max(seq) as r from event_log where type = 'message.removed' group by 1),
o as (
  select distinct e.payload.message_id as k, e.seq, e.account_id, e.payload.blob_id as blob_id, e.payload.provider_id as provider_id, e.payload.received_at as received_at
  from event_log e left join gone g on g.k = e.payload.message_id
  where e.type = 'message.observed' and e.payload.message_id is not null and e.seq > coalesce(g.r, -1)
)"""


@query(
    f"with {_LIVE} select k as message_id, arg_min(account_id, seq) as account_id, arg_min(provider_id, seq) as provider_id, "
    "arg_max(blob_id, seq) as blob_id, epoch_us(arg_max(received_at, seq)) as received_at from o group by k"
)
def replay_messages(spark, d):
    return event_log.replay_messages(_log(spark, d)).select("message_id", "account_id", "provider_id", "blob_id", _us("received_at"))


@query(
    f"""with {_LIVE}, born as (select k, min(seq) as o from o group by k),
s as (select distinct payload.message_id as k, seq, list_sort(list_distinct(coalesce(payload.keywords, []))) as v from event_log where type = 'message.keywords.set')
select born.k as message_id, unnest(arg_max(v, s.seq)) as keyword from born join s on s.k = born.k and s.seq > born.o group by born.k"""
)
def replay_keywords(spark, d):
    return event_log.replay_sets(_log(spark, d)).filter("facet = 'keyword'").select("message_id", F.col("value").alias("keyword"))


@query(
    """with x as (
  select coalesce(payload.mailbox.id, payload.mailbox_id) as mailbox_id, seq, type, account_id, payload.mailbox.name as name, payload.mailbox.role as role
  from event_log where type in ('mailbox.upserted', 'mailbox.removed')
), gone as (select mailbox_id, max(seq) as r from x where type = 'mailbox.removed' group by 1),
l as (select distinct x.* from x left join gone using (mailbox_id) where type = 'mailbox.upserted' and seq > coalesce(r, -1))
select mailbox_id, arg_min(account_id, seq) as account_id, arg_max(name, seq) as name, arg_max(role, seq) as role from l group by mailbox_id"""
)
def replay_mailboxes(spark, d):
    """Account of the first upsert after the last removal, the rest of the last one (the rule for a conflict by id)."""
    return event_log.replay_mailboxes(_log(spark, d))


@query(
    'with x as (select distinct account_id, payload.collection as collection, seq, payload."cursor" as c, event_at from event_log where type = \'sync.cursor.advanced\') '
    'select account_id, collection, (arg_max({c: c}, seq)).c as "cursor", epoch_us((arg_max({e: event_at}, seq)).e) as updated_at from x group by 1, 2'
)
def replay_cursor(spark, d):
    return event_log.replay_cursors(_log(spark, d)).withColumn("updated_at", _us("updated_at"))


@query(
    f"""with {M}, p as (select account_id, provider_id, id from m union all select account_id, provider_id, id || ':again' from m where provider_id like '%7')
select account_id, provider_id, count(distinct id) as n, min(id) as first, max(id) as last from p group by 1, 2 having count(distinct id) > 1"""
)
def replay_conflicts(spark, d):
    """Ids claimed twice are found; messages whose provider id ends in 7 are planted a second time under another id."""
    m = _messages(spark, d).select("account_id", "provider_id", F.col("id").alias("message_id"))
    planted = m.filter(F.col("provider_id").endswith("7")).withColumn("message_id", F.concat("message_id", F.lit(":again")))
    return event_log.conflicts(m.unionByName(planted))


@query()
def replay_snapshot(spark, d):
    """All projections: live messages with their sets and thread, the threads of these messages, mailboxes and cursors."""
    log = _log(spark, d)
    live = materialise(event_log.replay_messages(log), "live")
    m = _messages(spark, d).join(live.select(F.col("message_id").alias("id")), "id", "left_semi")
    found = materialise(threads.threads(m), "threads")
    placed = found.select("account_id", "thread_id", F.explode("message_ids").alias("id"))
    people = listing.participants(m.drop("thread_id").join(placed, ["account_id", "id"]))
    t = found.join(people, ["account_id", "thread_id"], "left").drop("message_ids")
    sets = event_log.collected_sets(log)
    rows = live.join(sets, "message_id", "left").join(placed.withColumnRenamed("id", "message_id"), ["account_id", "message_id"], "left")
    parts = (
        event_log.snapshot(rows.withColumn("received_at", _us("received_at")), "message", F.col("message_id")),
        event_log.snapshot(t.withColumn("last_message_at", _us("last_message_at")), "thread", F.concat_ws(":", "account_id", "thread_id")),
        event_log.snapshot(event_log.replay_mailboxes(log), "mailbox", F.col("mailbox_id")),
        event_log.snapshot(event_log.replay_cursors(log), "cursor", F.concat_ws(":", "account_id", "collection")),
    )
    return reduce(DataFrame.unionByName, parts)


def _log_blobs(spark: SparkSession, d: str) -> DataFrame:
    """A message for every blob the log observes, written in the JVM."""
    rows = _log(spark, d).filter((F.col("type") == "message.observed") & F.col("payload.blob_id").isNotNull()).select(F.col("payload.blob_id").alias("id")).distinct()
    raw = F.concat(F.lit("From: W <w@x.test>\r\nTo: v@x.test\r\nSubject: about "), F.col("id"), F.lit("\r\nMessage-ID: <"), F.col("id"), F.lit("@x>\r\n\r\ntext\r\n"))
    return rows.select("id", raw.cast("binary").alias("bytes"))


_STATE = f"""{_LIVE}, born as (select k, min(seq) as o from o group by k), lm as (
  select k as id, arg_min(account_id, seq) as account_id, arg_min(provider_id, seq) as provider_id, (arg_max({{b: blob_id}}, seq)).b as blob_id, epoch_us((arg_max({{r: received_at}}, seq)).r) as received_at from o group by k
), sets as (
  select e.k, e.type, e.seq, list_sort(list_distinct(list_filter(coalesce(v, []), lambda x: x is not null))) as v from (
    select distinct payload.message_id as k, type, seq, case when type = 'message.keywords.set' then payload.keywords else payload.mailbox_ids end as v
    from event_log where type in ('message.keywords.set', 'message.mailboxes.set')) e join born on born.k = e.k and e.seq > born.o
), kw as (select k, arg_max(v, seq) as v from sets where type = 'message.keywords.set' group by k), mb as (select k, arg_max(v, seq) as v from sets where type = 'message.mailboxes.set' group by k),
sz as (select payload.blob_id as b, max(payload.size) as size from event_log where type = 'blob.stored' group by 1),
state as (
  select lm.*, array_to_string(coalesce(kw.v, []), ',') as keywords, array_to_string(coalesce(mb.v, []), ',') as mailbox_ids, sz.size
  from lm left join kw on kw.k = lm.id left join mb on mb.k = lm.id left join sz on sz.b = lm.blob_id)"""
_STATE_SQL = f"with {_STATE} select id, account_id, provider_id, blob_id, received_at, keywords, mailbox_ids, size, 'about ' || blob_id as subject, lower(blob_id) || '@x' as declared from state"


def _projected(rows: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(c, ",").alias(c)
    return rows.select("id", "account_id", "provider_id", "blob_id", _us("received_at"), joined("keywords"), joined("mailbox_ids"), "size", "subject", F.lower(F.get("message_id_header", F.lit(0))).alias("declared"))


@query(_STATE_SQL)
def replay_parsed(spark, d):
    """Messages of the whole log with their sets, sizes and the fields their blobs say."""
    log = _log(spark, d)
    return _projected(projection.messages_of(log, _log_blobs(spark, d), NOW))


@query(_STATE_SQL)
def projection_follow(spark, d):
    """The same from a projection on disk that was built from the older half of the log and then followed the newer one."""
    log, blobs_ = _log(spark, d), _log_blobs(spark, d)
    middle = log.agg(F.percentile_approx("seq", 0.5)).first()[0] or 0
    p = projection.Projection(spark, scratch_path(spark, "projection"))
    p.rebuild(log.filter(F.col("seq") <= middle), blobs_, NOW)
    p.apply(log, log.filter(F.col("seq") > middle), blobs_, NOW)
    return _projected(p.read("messages"))


@query()
def thread_write_back(spark, d):
    """Every message with the id of the conversation it belongs to in place of the one it was stored with."""
    return projection.with_thread_ids(_messages(spark, d)).select("account_id", "id", "thread_id")


# --- filters of the search language -----------------------------------------------------------------------------------


def _filtered(text: str, sql: str, name: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return matching(_messages(spark, d, ACCOUNT), _mailboxes(spark, d), ACCOUNT, parse(text).filters).select("id")

    QUERIES[name] = run
    SQL[name] = f"with {M}, {B} select id from m where account_id = '{ACCOUNT}' and ({sql})"


def _people_sql(columns: list[str], value: str) -> str:
    joined = " || ' ' || ".join(
        f"coalesce(lower(array_to_string(list_transform({c}, lambda a: coalesce(a.name, '') || ' ' || coalesce(a.address, '')), chr(1))), '')" for c in columns
    )
    return f"contains({joined}, '{value}')"


_filtered("from:Jonas", _people_sql(["from_addr"], "jonas"), "filter_from")
_filtered("to:alice", _people_sql(["to_addr", "cc_addr"], "alice"), "filter_to")
_filtered("subject:notes", "contains(lower(coalesce(subject, '')), 'notes')", "filter_subject")
_filtered("list:lists", "contains(lower(coalesce(list_id, '')), 'lists')", "filter_list")
_filtered(
    "in:Archive", f"list_has_any(coalesce(mailbox_ids, []), (select coalesce(list(id), []) from b where account_id = '{ACCOUNT}' and (lower(name) = 'archive' or id = 'Archive')))", "filter_in"
)
_filtered(
    "-in:Archive -in:inbox", "not list_has_any(coalesce(mailbox_ids, []), (select coalesce(list(id), []) from b "
    f"where account_id = '{ACCOUNT}' and (lower(name) in ('archive', 'inbox') or id in ('Archive', 'inbox'))))", "filter_not_in"
)
_filtered("is:unread", "not coalesce(list_contains(keywords, '$seen'), false)", "filter_is")
_filtered("has:attachment", "coalesce(has_attachment, false)", "filter_has")
_filtered("before:2026-03", "received_at < timestamptz '2026-03-01 00:00:00+00'", "filter_before")
_filtered("since:2026-03-15", "received_at >= timestamptz '2026-03-15 00:00:00+00'", "filter_after")
_filtered("-subject:re", "not contains(lower(coalesce(subject, '')), 're')", "filter_negated")
_filtered(
    "after:2026 is:seen -has:attachment subject:re",
    "received_at >= timestamptz '2026-01-01 00:00:00+00' and coalesce(list_contains(keywords, '$seen'), false) and not coalesce(has_attachment, false) "
    "and contains(lower(coalesce(subject, '')), 're')",
    "filter_all",
)

# --- full text --------------------------------------------------------------------------------------------------------

_TOKENS = ", ".join(f"regexp_extract_all(strip_accents(lower(coalesce({f}, ''))), '[\\p{{L}}\\p{{N}}]+') as {f}_t" for f in search.FIELDS)
T = f"{D}, t as (select message_id, account_id, {_TOKENS} from d)"


def _occurs(phrase: list[str]) -> str:
    parts = []
    for f in search.FIELDS:
        if len(phrase) == 1:
            parts.append(f"len(list_filter({f}_t, lambda x: x = '{phrase[0]}'))")
        else:
            wanted = "[" + ", ".join(f"'{w}'" for w in phrase) + "]"
            parts.append(f"len(list_filter(range(1, len({f}_t) - {len(phrase) - 2}), lambda i: {f}_t[i:i + {len(phrase) - 1}] = {wanted}))")
    return " + ".join(parts)


def _hits_sql(wanted: list[list[str]], unwanted: list[list[str]] = ()) -> str:
    tests = [f"({_occurs(p)}) > 0" for p in wanted] + [f"({_occurs(p)}) = 0" for p in unwanted]
    return f"with {T} select message_id from t where account_id = '{ACCOUNT}' and " + " and ".join(tests)


def _text(name: str, text: str) -> None:
    clauses = parse(text).text
    wanted = [search.phrase_of(c) for c in clauses if not c.negated]
    unwanted = [search.phrase_of(c) for c in clauses if c.negated]

    def run(spark: SparkSession, d: str) -> DataFrame:
        return search.bm25_indexed(_index(spark, d), wanted, unwanted).filter(F.col("account_id") == ACCOUNT).select("message_id")

    QUERIES[name] = run
    SQL[name] = _hits_sql(wanted, unwanted)


_text("text_term", "archive")
_text("text_all_terms", "archive draft")
_text("text_phrase", '"archive box"')
_text("text_word_phrase", "half-finished")
_text("text_exclude", "archive -draft")
_text("text_folded", "numéro")


def _score_sql(wanted: list[list[str]], filters: str, weight: float) -> str:
    n = len(wanted)
    counts = ", ".join(f"({_occurs(p)}) as f{i}" for i, p in enumerate(wanted))
    sums = ", ".join(f"count(*) filter (f{i} > 0) as n{i}" for i in range(n))
    parts = " + ".join(
        f"greatest(1e-6, ln((s.n - s.n{i} + 0.5) / (s.n{i} + 0.5))) * c.f{i} * {search.K1 + 1} / (c.f{i} + {search.K1} * (1 - {search.B} + {search.B} * c.dl / s.mean))" for i in range(n)
    )
    hits = " and ".join(f"c.f{i} > 0" for i in range(n))
    dl = " + ".join(f"len({f}_t)" for f in search.FIELDS)
    return f"""with {M}, {B}, {T}, c as (select message_id, account_id, {dl} as dl, {counts} from t),
s as (select count(*)::double as n, avg(dl) as mean, {sums} from c),
r as (
  select m.id, round(-({parts}) - {weight} / (1 + greatest((epoch_us(timestamptz '2026-10-01 00:00:00+00') - epoch_us(m.received_at)) / 86400000000.0, 0) / 30), 6) as score,
         m.received_at
  from c cross join s join m on m.id = c.message_id where m.account_id = '{ACCOUNT}' and c.account_id = '{ACCOUNT}' and {hits} and ({filters})
)
select id, score from r order by score, received_at desc, id desc limit 50"""


_INDEXES: dict[tuple, SearchIndex] = {}


def _index(spark: SparkSession, d: str) -> SearchIndex:
    """The index of a data folder: built at the first search, then read by all of this session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        index = SearchIndex(spark, scratch_path(spark, "index"))
        index.add(table(spark, d, "search_documents"))
        _INDEXES[key] = index
    return _INDEXES[key]


def _search(spark: SparkSession, d: str, text: str, **options) -> DataFrame:
    return search.search(text, ACCOUNT, _messages(spark, d, ACCOUNT), _index(spark, d), _mailboxes(spark, d), NOW, **options)


def ranked_search(spark: SparkSession, d: str, text: str) -> DataFrame:
    return _search(spark, d, text).select("id", "score")


@query(_score_sql([["archive"], ["draft"]], "true", search.RECENCY_WEIGHT))
def search_ranked(spark, d):
    return _search(spark, d, "archive draft").select("id", "score")


@query(_score_sql([["archive", "box"]], "true", 0.0))
def search_no_recency(spark, d):
    return _search(spark, d, '"archive box"', weight=0.0).select("id", "score")


@query(_score_sql([["archive"]], "coalesce(has_attachment, false) and m.received_at >= timestamptz '2025-02-01 00:00:00+00'", search.RECENCY_WEIGHT))
def search_filtered(spark, d):
    """Flagship: attachment, date and word, the combination a driver table flip makes slow elsewhere."""
    return _search(spark, d, "has:attachment after:2025-02 archive").select("id", "score")


@query(f"with {M} select id, 0.0::double as score from m where account_id = '{ACCOUNT}' and coalesce(list_contains(keywords, '$flagged'), false) order by received_at desc, id desc limit 50")
def search_filter_only(spark, d):
    return _search(spark, d, "is:flagged").select("id", "score")


@query(
    f"with {M}, {T} select m.id, 0.0::double as score from m where account_id = '{ACCOUNT}' and id not in "
    f"(select message_id from t where account_id = '{ACCOUNT}' and ({_occurs(['archive'])}) > 0) order by received_at desc, id desc limit 50"
)
def text_only_negative(spark, d):
    return _search(spark, d, "-archive").select("id", "score")


@query()
def search_snippet(spark, d):
    return _search(spark, d, "archive draft").select("id", "snippet")


_T_ROWS = (
    f"{T}, p as (select message_id, 0 as field, subject_t as x from t union all select message_id, 1, sender_t from t union all select message_id, 2, recipients_t from t "
    "union all select message_id, 3, body_t from t), r as (select message_id, field, generate_subscripts(x, 1) - 1 as pos, unnest(x) as token from p)"
)


@query(
    f"with {_T_ROWS} select token, field, message_id, string_agg(pos::varchar, ' ' order by pos) as positions from r group by all"
)
def index_build(spark, d):
    """The stored postings, built anew: every token of every field with its places."""
    index = SearchIndex(spark, scratch_path(spark, "index"))
    index.add(table(spark, d, "search_documents"))
    return index.all_postings().select("token", "field", "message_id", F.array_join("positions", " ").alias("positions"))


@query(
    f"""with {D}, n as (
  select message_id, account_id, case when message_id like '%5' then 'new words here' else body end as body from d
  where not (message_id like '%3') and account_id <> 'acc-0002'
), t as (select message_id, regexp_extract_all(strip_accents(lower(coalesce(body, ''))), '[\\p{{L}}\\p{{N}}]+') as b from n)
select message_id, len(b) as body_tokens, len(list_filter(b, lambda x: x = 'words')) as held from t"""
)
def index_update(spark, d):
    """An index after replacing, removing and clearing: what is live, and one word's postings in it."""
    docs = table(spark, d, "search_documents")
    index = SearchIndex(spark, scratch_path(spark, "index"))
    index.add(docs)
    index.add(docs.filter(F.col("message_id").endswith("5")).withColumn("body", F.lit("new words here")))
    index.remove(docs.filter(F.col("message_id").endswith("3")))
    index.clear("acc-0002")
    index.optimise()
    words = index.postings(["words"]).filter("field = 3").select("message_id", F.size("positions").alias("n"))
    return index.live().join(words, "message_id", "left").select("message_id", F.size("body").cast("bigint").alias("body_tokens"), F.coalesce("n", F.lit(0)).cast("bigint").alias("held"))


@query(
    f"with {T}, x as (select distinct message_id, unnest(" + "list_concat(list_concat(list_concat(subject_t, sender_t), recipients_t), body_t)" + ") as token from t) "
    "select token, count(*) as docs from x group by token"
)
def token_df(spark, d):
    """Documents of every token, from the stored postings: a message's postings of a token are one row a field."""
    return _index(spark, d).all_postings().groupBy("token").agg(F.count_distinct("message_id").alias("docs"))


@query(
    f"with {T}, p as (select 'subject' as field, subject_t as x from t union all select 'sender', sender_t from t union all select 'recipients', recipients_t from t "
    "union all select 'body', body_t from t) select field, sum(len(x))::bigint as tokens, count(*) filter (len(x) > 0) as documents from p where len(x) > 0 group by field"
)
def postings_stats(spark, d):
    names = F.element_at(F.array(*map(F.lit, search.FIELDS)), F.col("field") + 1).alias("field")
    p = _index(spark, d).all_postings().select(names, "message_id", F.size("positions").alias("n"))
    return p.groupBy("field").agg(F.sum("n").alias("tokens"), F.count_distinct("message_id").alias("documents"))


@query(
    f"""with {M} select id,
 array_to_string(list_transform(coalesce(from_addr, []), lambda a: trim(coalesce(a.name, '') || ' ' || coalesce(a.address, ''))), ' ') as sender,
 array_to_string(list_transform(list_concat(coalesce(to_addr, []), coalesce(cc_addr, [])), lambda a: trim(coalesce(a.name, '') || ' ' || coalesce(a.address, ''))), ' ') as recipients
from m"""
)
def index_documents(spark, d):
    """What a message contributes to the index beside its body: names and addresses as text."""
    empty = F.array().cast("array<struct<name:string,address:string>>")
    text = lambda c: F.array_join(F.transform(c, lambda a: F.trim(F.concat_ws(" ", F.coalesce(a["name"], F.lit("")), F.coalesce(a["address"], F.lit(""))))), " ")
    people = F.concat(F.coalesce("to_addr", empty), F.coalesce("cc_addr", empty))
    return _messages(spark, d).select("id", text(F.coalesce("from_addr", empty)).alias("sender"), text(people).alias("recipients"))


# --- threads ----------------------------------------------------------------------------------------------------------

_WS = r"trim(regexp_replace(coalesce(subject, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))"
_RUN_SQL = r"^\s*(?:(?:re|res|aw|antw|sv|vs|ref|odp|r|fwd|fw|wg|tr|rv|enc|vb|i)\s*(?:\[\d+\])?\s*:\s*){0,16}"


@query(
    rf"""with {M}, x as (select id, {_WS} as s from m), y as (select id, s, regexp_extract(s, '{_RUN_SQL}', 0, 'i') as run from x)
select id, trim(regexp_replace(s, '{_RUN_SQL}', '', 'i')) as base,
 regexp_matches(run, '(?:^|[:\s])(?:re|res|aw|antw|sv|vs|ref|odp|r)\s*(?:\[\d+\])?\s*:', 'i') as reply,
 regexp_matches(run, '(?:^|[:\s])(?:fwd|fw|wg|tr|rv|enc|vb|i)\s*(?:\[\d+\])?\s*:', 'i') as forward from y"""
)
def subject_normalise(spark, d):
    s = F.col("subject")
    return _messages(spark, d).select("id", base_subject(s).alias("base"), is_reply(s).alias("reply"), is_forward(s).alias("forward"))


@query()
def thread_jwz(spark, d):
    t = threads.threads(_messages(spark, d))
    return t.select("account_id", "thread_id", "subject", "message_count", _us("last_message_at"), F.array_join("message_ids", " ").alias("message_ids"))


_KEY = r"nullif(lower(regexp_replace(x, '^[\s<]+|[\s>]+$', '', 'g')), '')"


@query(
    rf"""with recursive {M}, raw as (
  select account_id, id, message_id_header as own, list_concat(coalesce(refs, []), coalesce(in_reply_to, [])) as others from m
), first_own as (
  select account_id, id, (list_filter(list_transform(coalesce(own, []), lambda x: {_KEY}), lambda x: x is not null))[1] as k from raw
), keys as (
  select account_id, id, k from first_own where k is not null
  union select account_id, id, {_KEY.replace("x,", "o,")} from (select account_id, id, unnest(others) as o from raw) where {_KEY.replace("x,", "o,")} is not null
), links as (select distinct a.account_id, a.id as a, b.id as b from keys a join keys b on a.account_id = b.account_id and a.k = b.k and a.id <> b.id),
reach(account_id, a, b) as (
  select account_id, id, id from m union select r.account_id, r.a, l.b from reach r join links l on l.account_id = r.account_id and l.a = r.b
), named as (select account_id, a, min(b) as first_id from reach group by all)
select account_id, count(*) as messages, first_id from named group by account_id, first_id"""
)
def thread_components(spark, d):
    c = threads.components(threads.thread_inputs(_messages(spark, d)))
    return c.groupBy("account_id", "component").agg(F.count("*").alias("messages"), F.min("id").alias("first_id")).drop("component")


# --- content ----------------------------------------------------------------------------------------------------------


@query(
    rf"""with {D}, x as (
  select message_id, case when strpos(coalesce(body, ''), '-- ' || chr(10)) > 1 then substr(body, 1, strpos(body, '-- ' || chr(10)) - 1) else coalesce(body, '') end as s from d
), y as (select message_id, case when strpos(s, '-- ' || chr(13) || chr(10)) > 1 then substr(s, 1, strpos(s, '-- ' || chr(13) || chr(10)) - 1) else s end as s from x),
z as (select message_id, case when strpos(s, '---------- Forwarded message') > 1 then substr(s, 1, strpos(s, '---------- Forwarded message') - 1) else s end as s from y),
k as (select message_id, trim(regexp_replace(array_to_string(list_filter(regexp_split_to_array(s, '\r?\n'), lambda v: not regexp_matches(v, '^[ \t\x0B\f\r]*>')), ' '), '[ \t\n\x0B\f\r]+', ' ', 'g')) as s from z)
select message_id, case when length(s) > 512 then rtrim(substr(s, 1, 511)) || '…' else s end as preview from k"""
)
def preview_text(spark, d):
    return _documents(spark, d).select("message_id", mime.preview(F.col("body")).alias("preview"))


@query(
    rf"""with {D}, x as (
  select message_id, '<p class="a">' || coalesce(subject, '') || '</p><script>if (a < 1) x()</script> <b>' || coalesce(sender, '') || '</b>' as html from d
), y as (select message_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style).*?</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) as s from x)
select message_id, case when length(s) > 512 then rtrim(substr(s, 1, 511)) || '…' else s end as preview from y"""
)
def preview_html(spark, d):
    html = F.concat(
        F.lit('<p class="a">'), F.coalesce("subject", F.lit("")), F.lit("</p><script>if (a < 1) x()</script> <b>"), F.coalesce("sender", F.lit("")), F.lit("</b>")
    )
    return _documents(spark, d).select("message_id", mime.preview(F.lit(None).cast("string"), html).alias("preview"))


_PARTS = "right(message_id, 1) in ('2', '5', '8')"


@query(
    f"""with {D} select message_id as id, coalesce(subject, '') as subject, message_id as declared, 'a@x.test' as sender, octet_length(encode(coalesce(body, '')))::bigint as text_bytes,
 case when {_PARTS} then 'multipart/mixed multipart/alternative text/plain text/html application/pdf' else 'text/plain' end as structure, {_PARTS} as has_attachment,
 case when {_PARTS} then octet_length(encode(message_id))::bigint else 0 end as attached_bytes from d"""
)
def mime_parse(spark, d):
    """Messages written in the JVM (encoded subject, base64 body; some with an alternative and an attachment) and read by the parser."""
    b64 = lambda c: F.regexp_replace(F.base64(F.encode(F.coalesce(c, F.lit("")), "utf-8")), r"[\r\n]", "")
    head = F.concat(
        F.lit("From: A <a@x.test>\r\nTo: friends: b@x.test, c@x.test;\r\nDate: Mon, 5 Jan 2026 10:00:00 +0530\r\nMessage-ID: <"), F.col("message_id"), F.lit(">\r\nSubject: =?utf-8?B?"), b64("subject"), F.lit("?=\r\n"),
    )
    text = F.concat(F.lit("Content-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"), b64("body"), F.lit("\r\n"))
    mixed = F.concat(
        F.lit('Content-Type: multipart/mixed; boundary="m1"\r\n\r\n--m1\r\nContent-Type: multipart/alternative; boundary="a1"\r\n\r\n--a1\r\n'), text,
        F.lit("--a1\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>other form</p>\r\n--a1--\r\n--m1\r\nContent-Type: application/pdf; name=a.pdf\r\n"
              "Content-Disposition: attachment; filename=a.pdf\r\nContent-Transfer-Encoding: base64\r\n\r\n"), b64(F.col("message_id")), F.lit("\r\n--m1--\r\n"),
    )
    raw = F.concat(head, F.when(F.substring("message_id", -1, 1).isin("2", "5", "8"), mixed).otherwise(text))
    parsed = mime.parse(_documents(spark, d).select(F.col("message_id").alias("id"), raw.cast("binary").alias("bytes")), NOW)
    body = F.octet_length(F.coalesce("text", F.lit("")))
    crlf = F.size(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit("\r\n"), F.lit(0)))
    sizes = _documents(spark, d).select(F.col("message_id").alias("id"), crlf.alias("crlf"))
    return parsed.join(sizes, "id").select(
        "id", "subject", F.col("message_id_header")[0].alias("declared"), F.col("from_addr")[0]["address"].alias("sender"), (body + F.col("crlf")).cast("bigint").alias("text_bytes"),
        F.array_join("structure", " ").alias("structure"), "has_attachment", F.coalesce(F.get("attachments", F.lit(0))["size"], F.lit(0)).cast("bigint").alias("attached_bytes"),
    )


@query(f"with {D} select distinct 'sha256:' || sha256(body) as id, octet_length(encode(body))::bigint as size from d where body is not null")
def blob_put(spark, d):
    contents = _documents(spark, d).select(F.encode("body", "utf-8").alias("bytes"))
    stored = spark.createDataFrame([], "id string, size bigint, bytes binary")
    return blobs.put(stored, contents).select("id", "size")


@query(f"with {D} select distinct message_id || ' sha256:' || sha256(body) as id from d where body is not null and message_id like '%7'")
def blob_verify(spark, d):
    """Of all blobs, those spoilt in one byte are found and no sound one is."""
    rows = _documents(spark, d).filter("body is not null").select("message_id", F.encode("body", "utf-8").alias("good"))
    bad = F.col("message_id").endswith("7")
    # the owner's name stands before the digest, so equal contents are blobs of their own
    stored = rows.select("message_id", F.concat(F.lit("sha256:"), F.sha2("good", 256)).alias("id"), F.when(bad, F.concat(F.col("good"), F.lit("!").cast("binary"))).otherwise(F.col("good")).alias("bytes"))
    return blobs.broken(stored, "message_id").select(F.concat_ws(" ", "message_id", "id").alias("id")).distinct()


@query(f"with {M} select distinct payload.blob_id as id from event_log where type = 'blob.stored' and payload.blob_id not in (select blob_id from m where blob_id is not null)")
def blob_gc(spark, d):
    stored = _log(spark, d).filter(F.col("type") == "blob.stored").select(F.col("payload.blob_id").alias("id")).distinct()
    return blobs.garbage(stored, _messages(spark, d))


@query("select payload.blob_id as id, max(payload.size) as size from event_log where type = 'blob.stored' group by 1 having max(payload.size) > 4000")
def blob_stat(spark, d):
    stored = _log(spark, d).filter(F.col("type") == "blob.stored").groupBy(F.col("payload.blob_id").alias("id")).agg(F.max("payload.size").alias("size"))
    return blobs.stat(stored).filter("size > 4000")


# --- intents and sync -------------------------------------------------------------------------------------------------


def _intents(spark: SparkSession, d: str) -> DataFrame:
    """Local entries of the log as intents: what the account changed itself."""
    rows = _log(spark, d).filter((F.col("source") == "local") & F.col("type").isin("message.keywords.set", "message.mailboxes.set", "message.removed"))
    rows = rows.dropDuplicates(["seq"])
    states = F.array(*map(F.lit, ("pending", "inflight", "settled", "rejected", "unknown")))
    keyword = F.col("type") == "message.keywords.set"
    return rows.select(
        F.concat(F.lit("i"), "seq").alias("id"), "account_id", F.timestamp_seconds("seq").alias("created_at"),
        F.when(keyword, "keywords.change").when(F.col("type") == "message.removed", "message.destroy").otherwise("mailboxes.change").alias("op"),
        F.array("payload.message_id").alias("message_ids"), F.when(keyword, F.col("payload.keywords")).otherwise(F.col("payload.mailbox_ids")).alias("add"),
        F.when(keyword, F.array(F.lit("$seen"))).alias("remove"), F.element_at(states, (F.col("seq") % 5 + 1).cast("int")).alias("state"), F.lit(0).alias("attempts"),
    )


_I = """i as (
  select distinct on (seq) seq, account_id, type, payload, ['pending', 'inflight', 'settled', 'rejected', 'unknown'][(seq % 5 + 1)::int] as state
  from event_log where source = 'local' and type in ('message.keywords.set', 'message.mailboxes.set', 'message.removed')
)"""


@query(f"with {_I} select account_id, state, count(*) as n from i group by 1, 2")
def intents_by_state(spark, d):
    return intents.count_by_state(_intents(spark, d))


@query(f"with {_I} select 'i' || seq as id, state from i where account_id = '{ACCOUNT}' and state in ('pending', 'inflight', 'unknown') order by seq limit 200")
def intents_outstanding(spark, d):
    return intents.outstanding(_intents(spark, d), ACCOUNT).select("id", "state")


@query(f"with {_I} select account_id, count(*) filter (state in ('pending', 'inflight', 'unknown')) as n from i group by 1")
def intents_open_count(spark, d):
    return intents.count_outstanding(_intents(spark, d))


@query(f"with {_I} select 'i' || seq as id, case when state = 'unknown' then 'settled' else state end as state from i")
def intents_update(spark, d):
    log = _intents(spark, d).withColumn("last_error", F.lit(None).cast("string"))
    done = log.filter("state = 'unknown'").select("id", F.lit("settled").alias("state"))
    return intents.update(log, done).select("id", "state")


@query(
    f"""with {M}, {_I}, k as (
  select account_id, payload.message_id as id, flatten(list(coalesce(payload.keywords, []))) as adds, arg_max(list_contains(coalesce(payload.keywords, []), '$seen'), seq) as seen
  from i where type = 'message.keywords.set' group by all
), b as (select account_id, payload.message_id as id, flatten(list(coalesce(payload.mailbox_ids, []))) as adds from i where type = 'message.mailboxes.set' group by all),
gone as (select distinct account_id, payload.message_id as id from i where type = 'message.removed'),
sets as (
  select k.account_id, k.id, 'message.keywords.set' as type, list_sort(list_distinct(coalesce(m.keywords, []))) as v0,
    list_sort(list_distinct(list_concat(list_filter(list_concat(coalesce(m.keywords, []), adds), lambda x: x <> '$seen'), case when seen then ['$seen'] else [] end))) as v from k join m on m.id = k.id
  union all select b.account_id, b.id, 'message.mailboxes.set', list_sort(list_distinct(coalesce(m.mailbox_ids, []))), list_sort(list_distinct(list_concat(coalesce(m.mailbox_ids, []), adds))) from b join m on m.id = b.id
)
select account_id, id as message_id, type, array_to_string(v, ',') as "values" from sets s where v <> v0 and not exists (from gone g where g.account_id = s.account_id and g.id = s.id)
union all select g.account_id, g.id, 'message.removed', '' from gone g join m on m.id = g.id"""
)
def optimistic_apply(spark, d):
    """Every intent on keywords also takes $seen away, so the fold's result has a closed form for the SQL."""
    e = intents.local_events(_intents(spark, d), _messages(spark, d))
    return e.select("account_id", "message_id", "type", F.array_join(F.coalesce("values", F.array().cast("array<string>")), ",").alias("values"))


_REFRESH_SIDES = """a as (select id, list_sort(list_distinct(coalesce(keywords, []))) as k, list_sort(list_distinct(coalesce(mailbox_ids, []))) as mb from m where id not like '%3'),
s as (select id, case when id like '%5' then ['$seen'] else list_sort(list_distinct(coalesce(keywords, []))) end as k,
        list_sort(list_distinct(coalesce(mailbox_ids, []))) as mb from m where id not like '%4')"""


@query(
    f"""with {M}, {_REFRESH_SIDES}, j as (select coalesce(a.id, s.id) as message_id, a.id as here, s.id as there, a.k, a.mb, s.k as k2, s.mb as m2 from a full join s on a.id = s.id)
select message_id, 'message.removed' as type, '' as "values" from j where there is null
union all select message_id, 'message.observed', '' from j where here is null
union all select message_id, 'message.keywords.set', array_to_string(k2, ',') from j where there is not null and k is distinct from k2
union all select message_id, 'message.mailboxes.set', array_to_string(m2, ',') from j where there is not null and mb is distinct from m2"""
)
def refresh(spark, d):
    m = _messages(spark, d).select("id", "keywords", "mailbox_ids")
    server = m.filter(~F.col("id").endswith("4")).withColumn("keywords", F.when(F.col("id").endswith("5"), F.array(F.lit("$seen"))).otherwise(F.col("keywords")))
    e = intents.refresh_events(m.filter(~F.col("id").endswith("3")), server)
    return e.select("message_id", "type", F.array_join(F.coalesce("values", F.array().cast("array<string>")), ",").alias("values"))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.when(F.col("type") == "message.removed", "destroyed").when(F.col("type") == "message.observed", "created").otherwise("updated")
    rows = _log(spark, d).filter(F.col("type").startswith("message."))
    return rows.select(F.col("payload.message_id").alias("provider_id"), kinds.alias("kind"))


_C = "c as (select payload.message_id as provider_id, bool_or(type = 'message.removed') as destroyed from event_log where type like 'message.%' group by 1)"


@query(
    f"with x as (select distinct on (seq) seq, payload.message_id as provider_id, type from event_log where account_id = '{ACCOUNT}' and type like 'message.%' and seq > 700) "
    "select seq, provider_id, case type when 'message.removed' then 'destroyed' when 'message.observed' then 'created' else 'updated' end as kind from x order by seq limit 100"
)
def tail_page(spark, d):
    """A tail pass's page: what comes after a cursor, up to a limit."""
    return sync.page(_log(spark, d), ACCOUNT, 700, 100)


@query(f"with {_C} select provider_id, destroyed from c")
def tail_batch(spark, d):
    return sync.collapse(_changes(spark, d))


@query(f"with {M}, {_C} select provider_id from c where not destroyed and provider_id not in (select id from m where id like '%1')")
def tail_unknown(spark, d):
    known = _messages(spark, d).filter(F.col("id").endswith("1")).select(F.col("id").alias("provider_id"))
    return sync.unknown_ids(_changes(spark, d), known)


@query(
    f"""with {M}, {_C}, j as (
  select c.provider_id, c.destroyed, f.id as there, k.id as here, list_sort(list_distinct(coalesce(f.keywords, []))) as kw, list_sort(list_distinct(coalesce(f.mailbox_ids, []))) as mb
  from c left join m f on f.id = c.provider_id left join (select id from m where id like '%1') k on k.id = c.provider_id
)
select provider_id, 'message.removed' as type, '' as "values" from j where destroyed and here is not null
union all select provider_id, 'message.observed', '' from j where not destroyed and there is not null and here is null
union all select provider_id, 'message.keywords.set', array_to_string(kw, ',') from j where not destroyed and there is not null
union all select provider_id, 'message.mailboxes.set', array_to_string(mb, ',') from j where not destroyed and there is not null"""
)
def tail_ingest(spark, d):
    m = _messages(spark, d)
    empty = F.array().cast("array<string>")
    fetched = m.select(F.col("id").alias("provider_id"), F.coalesce("keywords", empty).alias("keywords"), F.coalesce("mailbox_ids", empty).alias("mailbox_ids"))
    known = m.filter(F.col("id").endswith("1")).select(F.col("id").alias("provider_id"))
    e = sync.ingest(_changes(spark, d), fetched, known)
    return e.select("provider_id", "type", F.array_join(F.coalesce("values", empty), ",").alias("values"))


@query(
    f"with {M} select id, epoch_us(received_at) as received_at from m where account_id = '{ACCOUNT}' and (received_at, id) < (timestamptz '2026-03-01 00:00:00+00', 'm:{ACCOUNT}:9') "
    "order by received_at desc, id desc limit 40"
)
def backfill_page(spark, d):
    """A page of history below a watermark."""
    mark = (datetime(2026, 3, 1, tzinfo=timezone.utc), f"m:{ACCOUNT}:9")
    return sync.backfill_page(_messages(spark, d), ACCOUNT, mark, 40).select("id", _us("received_at"))


@query(
    f"with {M} select id, array_to_string(list_sort(list_distinct(coalesce(keywords, []))), ',') as keywords, array_to_string(list_sort(list_distinct(coalesce(mailbox_ids, []))), ',') as mailbox_ids from m"
)
def resync(spark, d):
    """After a lost cursor: the log's state, brought to the server's by the events of a full comparison."""
    live = event_log.replay_messages(_log(spark, d)).select("message_id")
    local = live.join(event_log.collected_sets(_log(spark, d)), "message_id", "left").withColumnRenamed("message_id", "id")
    _, after = sync.resynchronised(local, _messages(spark, d).select("id", "keywords", "mailbox_ids"))
    return after.select("id", F.array_join("keywords", ",").alias("keywords"), F.array_join("mailbox_ids", ",").alias("mailbox_ids"))


@query(
    f"""with {M}, r as (select id, unnest(range(2, 13)) as "at" from m where not (id like '%0'))
select id as provider_id, "at" from r where case when id like '%3' then "at" = 4 or "at" >= 9 when id like '%5' then "at" >= 9 else true end"""
)
def guard_state(spark, d):
    """Reads of every message through the stream's guards. Ids ending in 3: a change was applied, which read 4 shows; it is believed,
    and from the eighth read on all are; in 5: no read shows it, so those from the eighth on are; others: no guard; in 0: no reads."""
    reads = _messages(spark, d).select("id").filter(~F.col("id").endswith("0")).select("id", F.explode(F.sequence(F.lit(2), F.lit(12))).alias("at"))
    shows = F.col("id").endswith("3") & F.col("at").isin(4, 12)
    none = F.array().cast("array<string>")
    row = lambda kind, keywords, add: (F.col("id").alias("provider_id"), F.col("at").cast("bigint").alias("at"), F.lit(kind).alias("kind"), F.lit("keywords").alias("field"), keywords.alias("keywords"), none.alias("mailboxes"), add.alias("add"), none.alias("remove"))
    told = reads.filter(F.col("at").isin(2) & F.col("id").rlike("[35]$")).withColumn("at", F.lit(1)).select(*row("expect", none, F.array(F.lit("$x"))))
    seen = reads.select(*row("read", F.when(shows, F.array(F.lit("$x"))).otherwise(none), none))
    path = scratch_path(spark, "reads")
    told.unionByName(seen).write.parquet(path)
    return sync.run_guarded(spark, path).select("provider_id", "at")


# --- rules, capabilities, provider records ----------------------------------------------------------------------------

RULES = [
    rules.Rule("r1", {"all": [{"field": "hasAttachment", "op": "equals", "value": True}, {"not": {"field": "keyword", "op": "equals", "value": "$seen"}}]}, ("label.attach",)),
    rules.Rule("r2", {"any": [{"field": "subject", "op": "startsWith", "value": "re"}, {"field": "listId", "op": "exists", "value": True}]}, ("move.list",), stop_on_match=True),
    rules.Rule("r3", {"field": "size", "op": "gt", "value": 2000}, ("label.large",)),
    rules.Rule("r4", {"field": "from", "op": "contains", "value": "jonas"}, ("label.jonas", "flag")),
    rules.Rule("r5", {"field": "size", "op": "gt", "value": 0}, ("never",), enabled=False),
]
_RULE_TESTS = f"""r as (select id,
 coalesce(has_attachment, false) and not coalesce(list_contains(list_transform(keywords, lambda k: lower(k)), '$seen'), false) as r1,
 starts_with(lower(coalesce(subject, '')), 're') or list_id is not null as r2, coalesce(size > 2000, false) as r3,
 {_people_sql(["from_addr"], "jonas")} as r4 from m)"""


@query(
    f"""with {M}, {_RULE_TESTS}
select id, 'r1' as rule_id, 'label.attach' as actions from r where r1
union all select id, 'r2', 'move.list' from r where r2
union all select id, 'r3', 'label.large' from r where r3 and not r2
union all select id, 'r4', 'label.jonas,flag' from r where r4 and not r2"""
)
def rule_match(spark, d):
    return rules.evaluate(_messages(spark, d), RULES).select("id", "rule_id", F.array_join("actions", ",").alias("actions"))


_STOP_RULES = [
    rules.Rule("s1", {"field": "size", "op": "lt", "value": 1500}, ("small",), stop_on_match=True),
    rules.Rule("s2", {"all": [{"field": "receivedAt", "op": "gt", "value": "2026-03-01 00:00:00"}, {"field": "mailbox", "op": "exists", "value": True}]}, ("recent",)),
    rules.Rule("s3", {"field": "subject", "op": "endsWith", "value": "x"}, ("ends",), stop_on_match=True),
    rules.Rule("s4", {"any": [{"field": "subject", "op": "matches", "value": "^(re|aw):"}, {"field": "listId", "op": "in", "value": ["A", "b"]}]}, ("late",)),
]


@query(
    f"""with {M}, r as (select id, coalesce(size < 1500, false) as s1, coalesce(received_at > timestamptz '2026-03-01 00:00:00+00', false) and len(coalesce(mailbox_ids, [])) > 0 as s2,
 ends_with(lower(coalesce(subject, '')), 'x') as s3, regexp_matches(coalesce(subject, ''), '^(re|aw):', 'i') or coalesce(lower(list_id) in ('a', 'b'), false) as s4 from m)
select id, 's1' as rule_id from r where s1 union all select id, 's2' from r where s2 and not s1 union all select id, 's3' from r where s3 and not s1 union all select id, 's4' from r where s4 and not s1 and not s3"""
)
def rule_stop_on_match(spark, d):
    return rules.evaluate(_messages(spark, d), _STOP_RULES).select("id", "rule_id")


@query(
    """with h as (select id, [role || ':*', 'mail:read'] as held, ['mail:read', 'mail:read-body', 'inbox:' || id, 'sent:x'] as req from (select distinct id, coalesce(role, 'none') as role from mailboxes))
select id, array_to_string(list_filter(req, lambda r: not (list_contains(held, r) or starts_with(r, held[1][1:len(held[1]) - 1]))), ',') as missing from h"""
)
def capability_missing(spark, d):
    rows = _mailboxes(spark, d).select("id", F.coalesce("role", F.lit("none")).alias("role")).distinct()
    held = F.array(F.concat("role", F.lit(":*")), F.lit("mail:read"))
    wanted = F.array(F.lit("mail:read"), F.lit("mail:read-body"), F.concat(F.lit("inbox:"), "id"), F.lit("sent:x"))
    return rows.select("id", F.array_join(rules.missing_capabilities(held, wanted), ",").alias("missing"))


@query(f"with {M} select id as subject_id from m where id not like '%2' or has_attachment")
def annotation_stale(spark, d):
    m = _messages(spark, d)
    key = (F.col("id").alias("subject_id"), F.lit("tagger").alias("producer"))
    inputs = m.select(*key, F.when(F.col("has_attachment"), "2").otherwise("1").alias("producer_version"), F.col("blob_id").alias("input_hash"))
    done = m.filter(F.col("id").endswith("2")).select(*key, F.lit("1").alias("producer_version"), F.col("blob_id").alias("input_hash"))
    return rules.stale(inputs, done).select("subject_id")


@query("select distinct id, case when lower(role) in ('inbox','archive','drafts','sent','trash','junk','all','snoozed','none') then lower(role) else 'none' end as role from mailboxes")
def mailbox_roles(spark, d):
    return table(spark, d, "mailboxes").select("id", provider.mailbox_role(F.col("role")).alias("role")).distinct()


@query(
    f"""with {M}, x as (select id, unnest(list_distinct(list_concat(coalesce(keywords, []), ['$seen', 'a/b~c']))) as v, coalesce(keywords, []) as k from m)
select id, 'keywords/' || replace(replace(v, '~', '~0'), '/', '~1') as pointer, list_contains(k, v) as adds from x where v is not null"""
)
def keyword_patch(spark, d):
    empty = F.array().cast("array<string>")
    patch = provider.patch("keywords", F.coalesce("keywords", empty), F.array(F.lit("$seen"), F.lit("a/b~c")))
    return _messages(spark, d).select("id", F.explode(patch).alias("pointer", "adds"))


_ERRORS = (
    "rateLimit serverFail serverPartialFail serverUnexpected stateMismatch cannotCalculateChanges tooManyChanges unauthorized forbidden accountReadOnly overQuota notFound accountNotFound "
    "accountNotSupportedByMethod unknownMethod unknownCapability unsupportedFilter unsupportedSort singleton invalidArguments invalidPatch invalidProperties invalidResultReference alreadyExists "
    "willDestroy tooLarge requestTooLarge urn:ietf:params:jmap:error:limit urn:ietf:params:jmap:error:unauthorized urn:ietf:params:jmap:error:forbidden urn:ietf:params:jmap:error:limit:maxSizeRequest neverHeardOf"
)


@query(
    f"""with t as (select unnest(string_split('{_ERRORS}', ' ')) as type), k as (select type, case
  when type in ('stateMismatch', 'cannotCalculateChanges', 'tooManyChanges') then 'conflict'
  when type in ('unauthorized', 'forbidden', 'accountReadOnly') or type like '%error:unauthorized' or type like '%error:forbidden' then 'auth'
  when type like 'rate%' or type like 'server%' or type like '%error:limit' or type = 'neverHeardOf' then 'transient' else 'permanent' end as kind,
 case when type = 'rateLimit' or type like '%error:limit' then 'net.rate_limited' when type like 'server%' or type = 'neverHeardOf' then 'provider.server_error'
  when type = 'stateMismatch' then 'sync.state_mismatch' when type in ('cannotCalculateChanges', 'tooManyChanges') then 'sync.cursor_invalid'
  when type like '%unauthorized' then 'auth.unauthenticated' when type like '%forbidden' or type = 'accountReadOnly' then 'auth.forbidden' when type = 'overQuota' then 'provider.over_quota'
  when type = 'notFound' then 'resource.not_found' when type like 'account%' or type like 'unknown%' or type like 'unsupported%' or type = 'singleton' then 'provider.unsupported' else 'input.invalid' end as code from t)
select type, kind, code, case when kind in ('transient', 'conflict') then 'unknown' else 'rejected' end as outcome,
 case when type = 'notFound' then 'applied' when kind in ('transient', 'conflict') then 'unknown' else 'rejected' end as destroyed from k"""
)
def error_kinds(spark, d):
    """All error types of the provider protocol and one nobody knows: kind, code, and what becomes of a change and of a destroy."""
    rows = spark.range(1).select(F.explode(F.split(F.lit(_ERRORS), " ")).alias("type"))
    t = F.col("type")
    return rows.select("type", provider.error_kind(t).alias("kind"), provider.error_code(t).alias("code"), provider.outcome(F.lit(False), t).alias("outcome"), provider.outcome(F.lit(True), t).alias("destroyed"))


@query(
    f"""with {M} select id, size, array_to_string(list_sort(list_distinct(list_filter(coalesce(keywords, []), lambda k: k is not null and k <> '$seen'))), ',') as keywords from m"""
)
def remote_records(spark, d):
    """Messages as a provider's JSON and back: only flags that are true count."""
    flags = F.map_from_entries(F.transform(value_set(F.col("keywords")), lambda k: F.struct(k.alias("key"), (k != "$seen").alias("value"))))
    json = F.to_json(F.struct(F.col("id"), F.col("blob_id").alias("blobId"), F.col("size"), flags.alias("keywords")))
    r = provider.remote_message(json)
    return _messages(spark, d).select(r.alias("r")).select(F.col("r.provider_id").alias("id"), F.col("r.size").alias("size"), F.array_join("r.keywords", ",").alias("keywords"))
