"""A provider's change feed as a Spark source, and a small server for tests to stand behind it.

``ChangeFeed`` (format ``mail_changes``) reads a folder of JSON-lines files with rows (mod_seq, kind,
provider_id): in batch all changes after ``cursor``, as a stream with mod_seq as offset, ``page`` changes a
batch. ``startingCursor=now`` begins at the end. ``Server`` keeps messages, their changes and tombstones, and
can be told to fail in the ways a provider fails.
"""

from __future__ import annotations

import heapq
import io
import itertools
import json
import random
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from hashlib import sha256

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# The ways a provider fails, and the calls that can fail.
FAULTS = (
    "disconnect", "apply-then-fail", "duplicate-events", "reorder-batch", "expire-cursor", "rate-limit", "stale-read", "short-batch",
)
CALLS = ("mailboxes", "changes", "backfill", "fetch", "raw", "upload", "apply", "submit")
SCHEMA = "mod_seq bigint, kind string, provider_id string"
#: Changes of one input partition; a page of more is read by several tasks.
PARTITION_ROWS = 100_000


class Feed:
    """A folder of JSON-lines files, indexed by the first and last mod_seq of each.

    A file is written once and never changed, so its index entry (byte size and bounds, from reading it once) is kept; a batch opens
    only the files its offsets meet. Folders are named as Spark names them and opened with pyarrow, so executors read what they share.
    """

    def __init__(self, folder: str) -> None:
        from pyarrow import fs

        where = re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", folder))
        self.fs, self.folder = fs.FileSystem.from_uri(where) if "://" in where else (fs.LocalFileSystem(), where)
        self.index: dict[str, tuple[int, list[int]]] = {}

    def rows(self, path: str) -> Iterator[tuple]:
        with self.fs.open_input_stream(path) as f:
            for line in io.TextIOWrapper(f, encoding="utf-8"):
                if line.strip():
                    r = json.loads(line)
                    yield r["mod_seq"], r["kind"], r["provider_id"]

    def files(self) -> list[tuple[str, list[int]]]:
        """(path, sorted mod_seqs) of every file that has rows. Eight bytes a change; the rows themselves stay where they are."""
        from array import array

        from pyarrow import fs

        for info in self.fs.get_file_info(fs.FileSelector(self.folder)):
            if info.path.endswith(".jsonl") and self.index.get(info.path, (None,))[0] != info.size:
                self.index[info.path] = (info.size, array("q", sorted(r[0] for r in self.rows(info.path))))
        return [(p, seqs) for p, (_, seqs) in sorted(self.index.items()) if seqs]

    def last(self) -> int:
        return max((seqs[-1] for _, seqs in self.files()), default=0)

    def page_end(self, cursor: int, page: int) -> int:
        """The mod_seq that ends the page of ``page`` changes after the cursor; the cursor itself if there are none."""
        after = heapq.merge(*[seqs[bisect_right(seqs, cursor) :] for _, seqs in self.files()])
        end = cursor
        for end in itertools.islice(after, page):
            pass
        return end

    def parts(self, low: int, high: int) -> list[tuple[str, int, int]]:
        """(path, low, high) pieces that together hold the changes after ``low`` up to ``high``."""
        out = []
        for path, seqs in self.files():
            a, b = bisect_right(seqs, low), bisect_right(seqs, high)
            for k in range(a, b, PARTITION_ROWS):
                out.append((path, seqs[k] - 1, seqs[min(k + PARTITION_ROWS, b) - 1]))
        return out


class _Piece(InputPartition):
    def __init__(self, path: str, low: int, high: int) -> None:
        self.path, self.low, self.high = path, low, high


def _read(folder: str, piece: _Piece) -> Iterator[tuple]:
    return iter(sorted(r for r in Feed(folder).rows(piece.path) if piece.low < r[0] <= piece.high))


class _Batch(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.cursor = options["path"], int(options.get("cursor", 0))

    def partitions(self) -> list[InputPartition]:
        feed = Feed(self.folder)
        return [_Piece(*p) for p in feed.parts(self.cursor, feed.last())]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _read(self.folder, partition)


class _Stream(DataSourceStreamReader):
    """A page a batch: the offsets are planned from the index, the rows are read by the tasks."""

    def __init__(self, options: dict) -> None:
        self.folder, self.page = options["path"], int(options.get("page", 500))
        self.start, self.cursor, self._feed = options.get("startingCursor", "earliest"), None, None

    def _index(self) -> Feed:
        if self._feed is None:
            self._feed = Feed(self.folder)
        return self._feed

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_feed": None}

    def initialOffset(self) -> dict:
        return {"cursor": self._index().last() if self.start == "now" else 0}

    def latestOffset(self) -> dict:
        if self.cursor is None:
            self.cursor = self.initialOffset()["cursor"]
        self.cursor = self._index().page_end(self.cursor, self.page)
        return {"cursor": self.cursor}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.cursor = max(self.cursor or 0, end["cursor"])  # after a restart the first batch may be one of before
        return [_Piece(*p) for p in self._index().parts(start["cursor"], end["cursor"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _read(self.folder, partition)

    def commit(self, end: dict) -> None:
        pass


class ChangeFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mail_changes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


class Unreachable(Exception):
    """The call failed before the server did anything, or the answer was lost."""


class CursorExpired(Exception):
    """The server cannot tell what changed since the cursor."""


class Server:
    """A mail provider in memory: deterministic, with faults drawn from ``seed`` in order of injection."""

    def __init__(self, seed: int = 1) -> None:
        self.random = random.Random(seed)
        self.messages: dict[str, dict] = {}
        self.before: dict[str, dict] = {}
        self.mod_seq = 0
        self.results: dict[str, str] = {}
        self.rules: list[list] = []
        self.fired: list[tuple[str, str]] = []
        self.boxes: dict[str, dict] = {"inbox": {"name": "Inbox", "parent": None, "sort_order": 0}}
        self.blobs: dict[str, bytes] = {}
        self.sent: dict[str, str] = {}
        self.outbox: list[dict] = []
        self.watchers: list[Callable[[str], None]] = []
        self.limits = {"fetch": 500, "upload": 50 * 1024 * 1024}

    def inject(self, op: str, kind: str, times: int = 1, probability: float = 1.0) -> None:
        if kind not in FAULTS:
            raise ValueError(f"no such fault: {kind}")
        self.rules.append([op, kind, times, probability])

    def _fault(self, op: str, *kinds: str) -> str | None:
        for rule in self.rules:
            if rule[2] > 0 and rule[0] in (op, "*") and rule[1] in kinds and self.random.random() < rule[3]:
                rule[2] -= 1
                self.fired.append((op, rule[1]))
                return rule[1]
        return None

    def _touch(self, provider_id: str, **fields) -> None:
        self.mod_seq += 1
        old = self.messages.get(provider_id)
        if old is not None:
            self.before[provider_id] = dict(old)
        base = old or {"keywords": [], "mailboxes": [], "destroyed": False, "created": self.mod_seq}
        self.messages[provider_id] = base | fields | {"mod_seq": self.mod_seq}
        for tell in self.watchers:
            tell("messages")

    def deliver(self, provider_id: str, keywords: list[str] = (), mailboxes: list[str] = ("inbox",), raw: bytes = b"") -> None:
        self._touch(provider_id, keywords=sorted(set(keywords)), mailboxes=sorted(set(mailboxes)), blob=self._store(raw))

    def _store(self, raw: bytes) -> str:
        name = "blob-" + sha256(raw).hexdigest()
        self.blobs[name] = raw
        return name

    def watch(self, tell: Callable[[str], None]) -> Callable[[], None]:
        """``tell`` is called with the collection of every change; returns what ends that."""
        self.watchers.append(tell)
        return lambda: self.watchers.remove(tell)

    def list_mailboxes(self) -> list[dict]:
        if fault := self._fault("mailboxes", "disconnect", "rate-limit"):
            raise Unreachable(fault)
        return sorted(({"provider_id": i, **b} for i, b in self.boxes.items()), key=lambda b: (b["sort_order"], b["name"], b["provider_id"]))

    def backfill(self, watermark: tuple[int, str] | None, limit: int) -> tuple[list[str], tuple[int, str] | None, bool]:
        """Ids below the watermark (when created, id), newest first; the new watermark; whether this was all. Ties are never skipped."""
        fault = self._fault("backfill", "disconnect", "rate-limit", "short-batch")
        if fault in ("disconnect", "rate-limit"):
            raise Unreachable(fault)
        rows = sorted(((m["created"], i) for i, m in self.messages.items() if not m["destroyed"]), reverse=True)
        rows = [r for r in rows if watermark is None or r < watermark]
        page = rows[: max(1, limit // 2) if fault == "short-batch" else limit]
        return [i for _, i in page], page[-1] if page else watermark, len(page) == len(rows)

    def raw(self, provider_id: str) -> bytes:
        """The bytes of a message, untouched."""
        if fault := self._fault("raw", "disconnect", "rate-limit"):
            raise Unreachable(fault)
        m = self.messages.get(provider_id)
        if m is None or m["destroyed"] or m.get("blob") not in self.blobs:
            raise KeyError(f"resource.not_found: {provider_id}")
        return self.blobs[m["blob"]]

    def upload(self, raw: bytes) -> str:
        if fault := self._fault("upload", "disconnect", "rate-limit"):
            raise Unreachable(fault)
        if len(raw) > self.limits["upload"]:
            raise ValueError("input.invalid: larger than the provider takes")
        return self._store(raw)

    def submit(self, key: str, blob: str, sender: str, recipients: list[str]) -> str:
        """sent or rejected; a key is sent once however often it comes. A lost answer leaves it unknown to the caller."""
        if self._fault("submit", "disconnect", "rate-limit"):
            raise Unreachable("disconnect")
        if key not in self.sent:
            self.sent[key] = "sent" if blob in self.blobs and recipients else "rejected"
            if self.sent[key] == "sent":
                self.outbox.append({"blob": blob, "from": sender, "to": list(recipients)})
        if self._fault("submit", "apply-then-fail"):
            raise Unreachable("answer lost")
        return self.sent[key]

    def destroy(self, provider_id: str) -> None:
        self._touch(provider_id, keywords=[], mailboxes=[], destroyed=True)

    def changes(self, cursor: int, limit: int) -> tuple[list[tuple[str, str]], int, bool]:
        """(kind, provider_id) changes after the cursor, the new cursor, whether there are more."""
        fault = self._fault("changes", "disconnect", "rate-limit", "expire-cursor", "duplicate-events", "reorder-batch", "short-batch")
        if fault in ("disconnect", "rate-limit"):
            raise Unreachable(fault)
        if fault == "expire-cursor" and cursor > 0:
            raise CursorExpired
        rows = sorted((m["mod_seq"], i) for i, m in self.messages.items() if m["mod_seq"] > cursor)
        page = rows[: max(1, limit // 2) if fault == "short-batch" else limit]
        kinds = []
        for _, i in page:
            m = self.messages[i]
            kinds.append(("destroyed" if m["destroyed"] else "created" if m["created"] > cursor else "updated", i))
        if fault == "duplicate-events":
            kinds += kinds
        if fault == "reorder-batch":
            self.random.shuffle(kinds)
        return kinds, page[-1][0] if page else max(cursor, 0), len(page) < len(rows)

    def fetch(self, ids: list[str]) -> list[dict]:
        """Metadata of the ids that exist; the others are left out. More ids than the provider takes at once are an error."""
        if len(ids) > self.limits["fetch"]:
            raise ValueError("input.invalid: too many ids at once")
        fault = self._fault("fetch", "disconnect", "rate-limit", "stale-read")
        if fault in ("disconnect", "rate-limit"):
            raise Unreachable(fault)
        out = []
        for i in ids:
            m = self.messages.get(i)
            if m is None or m["destroyed"]:
                continue
            shown = self.before.get(i, m) if fault == "stale-read" else m
            out.append({"provider_id": i, "keywords": list(shown["keywords"]), "mailboxes": list(shown["mailboxes"])})
        return out

    def apply(self, intent: dict) -> str:
        """applied or rejected; the same intent id has one effect however often it is sent."""
        if self._fault("apply", "disconnect", "rate-limit"):
            raise Unreachable("disconnect")
        if intent["id"] not in self.results:
            self.results[intent["id"]] = self._apply(intent)
        if self._fault("apply", "apply-then-fail"):
            raise Unreachable("answer lost")
        return self.results[intent["id"]]

    def _apply(self, intent: dict) -> str:
        return {
            "keywords.change": self._change, "mailboxes.change": self._change, "message.destroy": self._destroy, "draft.save": self._save,
            "mailbox.create": self._box, "mailbox.rename": self._box, "mailbox.destroy": self._box,
        }.get(intent["op"], lambda _: "rejected")(intent)

    def _alive(self, provider_id: str | None) -> bool:
        m = self.messages.get(provider_id)
        return m is not None and not m["destroyed"]

    def _change(self, intent: dict) -> str:
        i = intent["provider_id"]
        field = intent["op"].split(".")[0]
        if not self._alive(i):
            return "rejected"
        self._touch(i, **{field: sorted((set(self.messages[i][field]) - set(intent["remove"])) | set(intent["add"]))})
        return "applied"

    def _destroy(self, intent: dict) -> str:
        """A destroy of what is gone has worked."""
        if self._alive(intent["provider_id"]):
            self.destroy(intent["provider_id"])
        return "applied"

    def _save(self, intent: dict) -> str:
        """A draft is a message of its own; the one it replaces is destroyed."""
        if intent["blob"] not in self.blobs or intent["mailbox"] not in self.boxes:
            return "rejected"
        if self._alive(intent.get("replaces")):
            self.destroy(intent["replaces"])
        self.deliver(f"draft-{intent['id']}", ["$draft"], [intent["mailbox"]], self.blobs[intent["blob"]])
        return "applied"

    def _box(self, intent: dict) -> str:
        name, what = intent.get("name"), intent["op"].split(".")[1]
        box = f"box-{intent['id']}" if what == "create" else intent["mailbox"]
        if what == "create":
            self.boxes[box] = {"name": name, "parent": intent.get("parent"), "sort_order": len(self.boxes)}
        elif box not in self.boxes:
            return "rejected"
        elif what == "rename":
            self.boxes[box] = self.boxes[box] | {"name": name}
        else:
            del self.boxes[box]
        self.mod_seq += 1
        for tell in self.watchers:
            tell("mailboxes")
        return "applied"

    def snapshot(self) -> dict[str, tuple]:
        return {i: (tuple(m["keywords"]), tuple(m["mailboxes"])) for i, m in sorted(self.messages.items()) if not m["destroyed"]}
