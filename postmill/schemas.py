"""Table schemas and value rules of the mail store."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ADDRESS = "struct<name:string,address:string>"
BLOBS = "id string, size bigint, bytes binary, created_at timestamp"
PAYLOAD = (
    "struct<message_id:string,blob_id:string,size:bigint,provider_id:string,received_at:timestamp,keywords:array<string>,"
    "mailbox_ids:array<string>,mailbox:struct<id:string,name:string,role:string>,mailbox_id:string,collection:string,cursor:string>"
)
EVENTS = f"seq bigint, account_id string, event_at timestamp, source string, type string, payload {PAYLOAD}"
ANNOTATIONS = (
    "id string, subject_kind string, subject_id string, namespace string, key string, value string, confidence double, producer string, "
    "producer_version string, input_hash string, created_at timestamp, expires_at timestamp"
)
INTENTS = (
    "id string, account_id string, created_at timestamp, op string, message_ids array<string>, add array<string>, remove array<string>, "
    "state string, attempts int, last_attempt_at timestamp, last_error string"
)

EVENT_TYPES = (
    "blob.stored", "message.observed", "message.keywords.set", "message.mailboxes.set", "message.removed",
    "mailbox.upserted", "mailbox.removed", "sync.cursor.advanced",
)
INTENT_STATES = ("pending", "inflight", "settled", "rejected", "unknown")
OUTSTANDING = ("pending", "inflight", "unknown")
MAILBOX_ROLES = ("inbox", "archive", "drafts", "sent", "trash", "junk", "all", "snoozed", "none")
SCHEMA_VERSION = 2


def value_set(values: Column) -> Column:
    """Sorted set of an array's members; null gives the empty set."""
    return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(values, F.array().cast("array<string>")))))


def valid_event(type_: Column, payload: Column) -> Column:
    """Whether an event names a known type and has the fields this type needs."""
    need = {
        "blob.stored": payload["blob_id"].isNotNull() & payload["size"].isNotNull(),
        "message.observed": payload["message_id"].isNotNull() & payload["blob_id"].isNotNull(),
        "message.keywords.set": payload["message_id"].isNotNull() & payload["keywords"].isNotNull(),
        "message.mailboxes.set": payload["message_id"].isNotNull() & payload["mailbox_ids"].isNotNull(),
        "message.removed": payload["message_id"].isNotNull(),
        "mailbox.upserted": payload["mailbox"]["id"].isNotNull(),
        "mailbox.removed": payload["mailbox_id"].isNotNull(),
        "sync.cursor.advanced": payload["collection"].isNotNull(),
    }
    out = F.lit(False)
    for name, test in need.items():
        out = F.when(type_ == name, test).otherwise(out)
    return F.coalesce(out, F.lit(False))
