"""Making a local event log follow a provider: pages of changes, guarded reads, pushed intents.

The DataFrame parts (``collapse``, ``ingest``, ``guarded``) serve micro-batches of any size; ``Engine`` is the
driver loop of one account that ties them to a provider, one pass after the other, until nothing moves.
A cursor travels as an entry of the same batch as the data it covers, so a rebuild needs only the log.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postmill.operators.intents import refresh_events
from postmill.schemas import value_set
from postmill.session import scratch_path
from postmill.sources.change_feed import CursorExpired, Server, Unreachable

READ_BUDGET = 8
MAX_ROUNDS = 40


def page(log: DataFrame, account: str, cursor: int = 0, limit: int = 500) -> DataFrame:
    """One page of an account's message changes: seq, provider_id, kind of the first ``limit`` sequence numbers after ``cursor``, each once.

    The next page goes on from the greatest seq of this one; an empty page is the end.
    """
    kinds = F.when(F.col("type") == "message.removed", "destroyed").when(F.col("type") == "message.observed", "created").otherwise("updated")
    rows = log.filter((F.col("account_id") == account) & (F.col("seq") > cursor) & F.col("type").startswith("message."))
    return rows.select("seq", F.col("payload.message_id").alias("provider_id"), kinds.alias("kind")).dropDuplicates(["seq"]).orderBy("seq").limit(limit)


def backfill_page(messages: DataFrame, account: str, watermark: tuple | None = None, limit: int = 500) -> DataFrame:
    """The next page of history: the account's messages below the watermark (received_at, id), newest first, ties by id.

    The last row of a page is the next watermark; a page of fewer than ``limit`` rows completes the backfill. It goes on apart from
    the tail: what arrives meanwhile lies above every watermark.
    """
    rows = messages.filter(F.col("account_id") == account)
    if watermark is not None:
        at, last = F.lit(watermark[0]), watermark[1]
        rows = rows.filter((F.col("received_at") < at) | ((F.col("received_at") == at) & (F.col("id") < last)))
    return rows.orderBy(F.desc("received_at"), F.desc("id")).limit(limit)


def resynchronised(local: DataFrame, server: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a lost cursor comes to: the events that make ``local`` equal to ``server``, and the local state after them.

    Both sides: id, keywords, mailbox_ids. The events are those of a refresh; a set that is already right gives none.
    """
    events = refresh_events(local, server)
    gone = events.filter("type = 'message.removed'").select(F.col("message_id").alias("id"))
    new = events.filter("type = 'message.observed'").select(F.col("message_id").alias("id"))
    last = lambda t: F.max(F.when(F.col("type") == t, F.col("values")))
    sets = events.groupBy(F.col("message_id").alias("id")).agg(last("message.keywords.set").alias("k"), last("message.mailboxes.set").alias("m"))
    none = F.array().cast("array<string>")
    kept = local.select("id", value_set(F.col("keywords")).alias("keywords"), value_set(F.col("mailbox_ids")).alias("mailbox_ids")).join(gone, "id", "left_anti")
    after = kept.unionByName(new.select("id", none.alias("keywords"), none.alias("mailbox_ids"))).join(sets, "id", "left")
    return events, after.select("id", F.coalesce("k", "keywords").alias("keywords"), F.coalesce("m", "mailbox_ids").alias("mailbox_ids"))


def collapse(changes: DataFrame) -> DataFrame:
    """provider_id, destroyed: each id of a page once; a removal wins over any other change of it."""
    return changes.groupBy("provider_id").agg(F.bool_or(F.col("kind") == "destroyed").alias("destroyed"))


def unknown_ids(changes: DataFrame, messages: DataFrame) -> DataFrame:
    """Ids whose bytes must be fetched: changed, not destroyed, not stored."""
    return collapse(changes).filter(~F.col("destroyed")).select("provider_id").join(messages.select("provider_id"), "provider_id", "left_anti")


def ingest(changes: DataFrame, fetched: DataFrame, known: DataFrame) -> DataFrame:
    """provider_id, type, values: events of a page. ``fetched``: provider_id, keywords, mailbox_ids; ``known``: provider_id.

    Destroyed ids give removals where they are known; fetched ones an observation where they are new, and both sets whole.
    """
    page = collapse(changes).join(fetched, "provider_id", "left").join(known.select("provider_id", F.lit(True).alias("here")), "provider_id", "left")
    none = F.lit(None).cast("array<string>")
    event = lambda t, v: F.struct(F.lit(t).alias("type"), v.alias("values"))
    there = ~F.col("destroyed") & F.col("keywords").isNotNull()
    events = F.array_compact(
        F.array(
            F.when(F.col("destroyed") & F.col("here"), event("message.removed", none)),
            F.when(there & F.col("here").isNull(), event("message.observed", none)),
            F.when(there, event("message.keywords.set", F.array_sort(F.array_distinct("keywords")))),
            F.when(there, event("message.mailboxes.set", F.array_sort(F.array_distinct("mailbox_ids")))),
        )
    )
    return page.select("provider_id", F.explode(events).alias("e")).select("provider_id", "e.type", "e.values")


class Guard:
    """What reads of one message must show after a change was applied, and how many more may contradict it."""

    def __init__(self, present: dict[str, set] | None = None, absent: dict[str, set] | None = None, satisfied: bool = False, budget: int = READ_BUDGET) -> None:
        self.present = present or {"keywords": set(), "mailboxes": set()}
        self.absent = absent or {"keywords": set(), "mailboxes": set()}
        self.satisfied, self.budget = satisfied, budget

    def expect(self, field: str, add: list[str], remove: list[str]) -> None:
        """A later change overrides an earlier one on the same value, and earlier reads prove nothing about it."""
        for v in remove:
            self.present[field].discard(v)
            self.absent[field].add(v)
        for v in add:
            self.absent[field].discard(v)
            self.present[field].add(v)
        self.satisfied, self.budget = False, READ_BUDGET

    def believe(self, read: dict) -> bool:
        """Whether a read may be written; ages the guard."""
        fits = all(self.present[f] <= set(read[f]) and not self.absent[f] & set(read[f]) for f in ("keywords", "mailboxes"))
        self.budget -= 1
        self.satisfied = self.satisfied or fits
        return fits or self.budget <= 0

    @property
    def spent(self) -> bool:
        return self.budget <= 0


def guarded(reads: DataFrame) -> DataFrame:
    """The believable reads of a stream; ``reads``: provider_id, at, kind (read or expect), field, keywords, mailboxes, add, remove.

    The guard of each message is keyed state; rows of one micro-batch take effect by ``at``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        guard = None
        if state.exists:
            pk, pm, ak, am, satisfied, budget = state.get
            split = lambda s: set(filter(None, s.split("\x1f")))
            guard = Guard({"keywords": split(pk), "mailboxes": split(pm)}, {"keywords": split(ak), "mailboxes": split(am)}, satisfied, budget)
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        kept = []
        for r in rows.itertuples():
            if r.kind == "expect":
                guard = guard or Guard()
                guard.expect(r.field, list(r.add), list(r.remove))
            elif guard is None or guard.believe({"keywords": list(r.keywords), "mailboxes": list(r.mailboxes)}):
                kept.append({"provider_id": key[0], "at": r.at, "keywords": list(r.keywords), "mailboxes": list(r.mailboxes)})
            if guard is not None and guard.spent:
                guard = None
        if guard is None:
            if state.exists:
                state.remove()
        else:
            join = lambda s: "\x1f".join(sorted(s))
            state.update((join(guard.present["keywords"]), join(guard.present["mailboxes"]), join(guard.absent["keywords"]), join(guard.absent["mailboxes"]), guard.satisfied, guard.budget))
        if kept:
            yield pd.DataFrame(kept)

    return reads.groupBy("provider_id").applyInPandasWithState(
        step,
        "provider_id string, at bigint, keywords array<string>, mailboxes array<string>",
        "pk string, pm string, ak string, am string, satisfied boolean, budget int",
        "append",
        GroupStateTimeout.NoTimeout,
    )


READS = "provider_id string, at bigint, kind string, field string, keywords array<string>, mailboxes array<string>, add array<string>, remove array<string>"


def run_guarded(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The believable reads of all files at ``path``, through the guarded stream to its end."""
    out, check = scratch_path(spark, "believed"), scratch_path(spark, "believed-state")
    stream = spark.readStream.schema(READS).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    query = guarded(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("provider_id string, at bigint, keywords array<string>, mailboxes array<string>").parquet(out)


class Engine:
    """One account: local state, cursor, outstanding intents and guards; a single writer."""

    def __init__(self, server: Server, page: int = 100) -> None:
        self.server, self.page = server, page
        self.local: dict[str, dict] = {}
        self.log: list[dict] = []
        self.cursor: int | None = None
        self.intents: list[dict] = []
        self.guards: dict[str, Guard] = {}
        self.reread: set[str] = set()
        self.last_error: str | None = None
        self.low: tuple[int, str] | None = None  # how far down the history was read
        self.complete = False
        self.phase = "idle"
        self.lock = threading.Lock()  # a single writer: passes of one account never overlap

    def _write(self, event: dict) -> None:
        self.log.append(event)
        i = event.get("provider_id")
        if event["type"] == "message.observed":
            self.local.setdefault(i, {"keywords": [], "mailboxes": []})
        elif event["type"] == "message.removed":
            self.local.pop(i, None)
        elif event["type"] in ("message.keywords.set", "message.mailboxes.set") and i in self.local:
            self.local[i]["keywords" if event["type"] == "message.keywords.set" else "mailboxes"] = event["values"]

    def change(self, intent: dict) -> None:
        """Record an intent and show its effect at once."""
        self.intents.append(intent | {"state": "pending", "attempts": 0})
        m = self.local.get(intent["provider_id"])
        if m is None:
            return
        if intent["op"] == "message.destroy":
            self._write({"type": "message.removed", "provider_id": intent["provider_id"]})
            return
        field = intent["op"].split(".")[0]
        after = sorted((set(m[field]) - set(intent["remove"])) | set(intent["add"]))
        self._write({"type": f"message.{field}.set", "provider_id": intent["provider_id"], "values": after})

    def outstanding(self) -> list[dict]:
        return [i for i in self.intents if i["state"] in ("pending", "inflight", "unknown")]

    def push(self) -> None:
        for intent in self.outstanding():
            intent["attempts"] += 1
            intent["state"] = "inflight"
            try:
                result = self.server.apply(intent)
            except Unreachable as e:
                intent["state"], self.last_error = "unknown", str(e)  # sent again under the same id
                continue
            intent["state"] = "settled" if result == "applied" else "rejected"
            if result == "applied" and intent["op"] != "message.destroy":
                guard = self.guards.setdefault(intent["provider_id"], Guard())
                guard.expect(intent["op"].split(".")[0], intent["add"], intent["remove"])
            else:
                self.reread.add(intent["provider_id"])

    def _take(self, ids: list[str]) -> bool:
        """Fetch and write what is believable; what the server no longer has is removed."""
        step = min(self.page, self.server.limits["fetch"])
        found = {m["provider_id"]: m for k in range(0, len(ids), step) for m in self.server.fetch(ids[k : k + step])}
        for i in ids:
            m = found.get(i)
            self.reread.discard(i)
            if m is None:
                self.guards.pop(i, None)
                if i in self.local:
                    self._write({"type": "message.removed", "provider_id": i})
                continue
            guard = self.guards.get(i)
            ok = guard is None or guard.believe(m)
            if guard is not None and guard.spent:
                del self.guards[i]
            if ok:
                if i not in self.local:
                    self._write({"type": "message.observed", "provider_id": i})
                self._write({"type": "message.keywords.set", "provider_id": i, "values": m["keywords"]})
                self._write({"type": "message.mailboxes.set", "provider_id": i, "values": m["mailboxes"]})
        return bool(ids)

    def tail(self) -> bool:
        """One page of changes; True if there may be more."""
        try:
            changes, cursor, more = self.server.changes(self.cursor or 0, self.page)
        except CursorExpired:
            self.cursor = 0  # resynchronise: everything is read again, history too
            self.reread |= set(self.local)
            self.low, self.complete = None, False
            return True
        gone = {i for kind, i in changes if kind == "destroyed"}
        live = [i for i in dict.fromkeys(i for _, i in changes) if i not in gone]
        self._take(live)
        for i in sorted(gone):
            self.guards.pop(i, None)
            if i in self.local:
                self._write({"type": "message.removed", "provider_id": i})
        if cursor != self.cursor:
            self.cursor = cursor
            self._write({"type": "sync.cursor.advanced", "collection": "messages", "cursor": str(cursor)})
        return more

    def backfill(self) -> bool:
        """One page of history below the watermark; True if there is more. Independent of the tail's cursor."""
        if self.complete:
            return False
        ids, low, done = self.server.backfill(self.low, self.page)
        self._take([i for i in ids if i not in self.local])
        self.low, self.complete = low, done
        return not done

    def verify(self) -> None:
        """Read again what a change still waits to be seen for."""
        waiting = sorted(self.reread | {i for i, g in self.guards.items() if not g.satisfied})
        if waiting:
            self._take(waiting)

    def settle(self, rounds: int = MAX_ROUNDS) -> int:
        """Push, tail, verify and backfill until nothing changes and nothing waits; returns the rounds it took."""
        with self.lock:
            try:
                return self._settle(rounds)
            finally:
                self.phase = "idle"

    def _settle(self, rounds: int) -> int:
        for n in range(1, rounds + 1):
            before = (self.cursor, len(self.log), len(self.outstanding()))
            more = True
            try:
                self.phase = "pushing"
                self.push()
                self.phase = "tailing"
                while more:
                    more = self.tail()
                self.phase = "verifying"
                self.verify()
                self.phase = "backfilling"
                self.backfill()
            except Unreachable as e:
                self.last_error = str(e)
                continue
            waiting = self.reread or any(not g.satisfied for g in self.guards.values())
            if not self.outstanding() and not waiting and before[0] == self.cursor and self.complete:
                return n
        return rounds

    def status(self) -> dict:
        return {"phase": self.phase, "outstanding": len(self.outstanding()), "last_error": self.last_error, "cursor": self.cursor, "backfilled": self.complete, "watermark": self.low}

    def snapshot(self) -> dict[str, tuple]:
        return {i: (tuple(m["keywords"]), tuple(m["mailboxes"])) for i, m in sorted(self.local.items())}
