"""Provider records and answers: roles, sets, patches, error kinds, outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.schemas import MAILBOX_ROLES

# Error types and HTTP states of the provider protocol, by what to do about them.
ERROR_KINDS = {
    "rateLimit": ("transient", "net.rate_limited"), "urn:ietf:params:jmap:error:limit": ("transient", "net.rate_limited"),
    "serverFail": ("transient", "provider.server_error"), "serverPartialFail": ("transient", "provider.server_error"),
    "serverUnexpected": ("transient", "provider.server_error"), "stateMismatch": ("conflict", "sync.state_mismatch"),
    "cannotCalculateChanges": ("conflict", "sync.cursor_invalid"), "tooManyChanges": ("conflict", "sync.cursor_invalid"),
    "unauthorized": ("auth", "auth.unauthenticated"), "urn:ietf:params:jmap:error:unauthorized": ("auth", "auth.unauthenticated"),
    "forbidden": ("auth", "auth.forbidden"), "accountReadOnly": ("auth", "auth.forbidden"), "urn:ietf:params:jmap:error:forbidden": ("auth", "auth.forbidden"),
    "overQuota": ("permanent", "provider.over_quota"), "notFound": ("permanent", "resource.not_found"),
    "accountNotFound": ("permanent", "provider.unsupported"), "accountNotSupportedByMethod": ("permanent", "provider.unsupported"),
    "unknownMethod": ("permanent", "provider.unsupported"), "unknownCapability": ("permanent", "provider.unsupported"),
    "unsupportedFilter": ("permanent", "provider.unsupported"), "unsupportedSort": ("permanent", "provider.unsupported"),
    "singleton": ("permanent", "provider.unsupported"), "invalidArguments": ("permanent", "input.invalid"), "invalidPatch": ("permanent", "input.invalid"),
    "invalidProperties": ("permanent", "input.invalid"), "invalidResultReference": ("permanent", "input.invalid"),
    "alreadyExists": ("permanent", "input.invalid"), "willDestroy": ("permanent", "input.invalid"), "tooLarge": ("permanent", "input.invalid"),
    "requestTooLarge": ("permanent", "input.invalid"), "urn:ietf:params:jmap:error:limit:maxSizeRequest": ("permanent", "input.invalid"),
}
UNKNOWN_ERROR = ("transient", "provider.server_error")


def _lookup(table: dict[str, str], key: Column, other: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.coalesce(key, F.lit(""))), F.lit(other))


def error_kind(type_: Column) -> Column:
    return _lookup({k: v[0] for k, v in ERROR_KINDS.items()}, type_, UNKNOWN_ERROR[0])


def error_code(type_: Column) -> Column:
    return _lookup({k: v[1] for k, v in ERROR_KINDS.items()}, type_, UNKNOWN_ERROR[1])


def http_error_kind(status: Column) -> Column:
    return F.when(status.isin(401, 403), "auth").when(status == 429, "transient").when(status >= 500, "transient").otherwise("permanent")


def outcome(is_destroy: Column, failure_type: Column) -> Column:
    """applied, rejected or unknown: a destroy of what is gone has worked; a passing failure or a conflict leaves it open."""
    return (
        F.when(failure_type.isNull() | (is_destroy & (failure_type == "notFound")), "applied")
        .when(error_kind(failure_type).isin("transient", "conflict"), "unknown")
        .otherwise("rejected")
    )


def mailbox_role(role: Column) -> Column:
    low = F.lower(role)
    return F.when(low.isin(*MAILBOX_ROLES), low).otherwise("none")


def true_keys(flags: Column) -> Column:
    """Sorted keys of a map whose value is true."""
    return F.array_sort(F.map_keys(F.map_filter(flags, lambda _, v: F.coalesce(v, F.lit(False)))))


def escape_pointer(segment: Column) -> Column:
    return F.replace(F.replace(segment, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def patch(property_: str, add: Column, remove: Column) -> Column:
    """Map of pointer to true (add) or false (remove); a value in both is added."""
    name = lambda x: F.concat(F.lit(f"{property_}/"), escape_pointer(x))
    add, remove = F.array_distinct(add), F.array_distinct(F.array_except(remove, add))
    return F.map_concat(
        F.map_from_arrays(F.transform(remove, name), F.transform(remove, lambda _: F.lit(False))),
        F.map_from_arrays(F.transform(add, name), F.transform(add, lambda _: F.lit(True))),
    )


MAILBOX_JSON = "id string, name string, parentId string, role string, sortOrder int, totalEmails int, unreadEmails int"
MESSAGE_JSON = "id string, blobId string, size bigint, receivedAt string, keywords map<string,boolean>, mailboxIds map<string,boolean>"


def remote_mailbox(json: Column) -> Column:
    """A provider's mailbox record in the fixed shape; what is absent gets its default."""
    r = F.from_json(json, MAILBOX_JSON)
    return F.struct(
        F.coalesce(r["id"], F.lit("")).alias("provider_id"), F.coalesce(r["name"], F.lit("")).alias("name"), F.nullif(r["parentId"], F.lit("")).alias("parent_provider_id"),
        mailbox_role(r["role"]).alias("role"), F.coalesce(r["sortOrder"], F.lit(0)).alias("sort_order"), r["totalEmails"].alias("reported_total"), r["unreadEmails"].alias("reported_unread"),
    )


def remote_message(json: Column) -> Column:
    r = F.from_json(json, MESSAGE_JSON)
    none = F.create_map().cast("map<string,boolean>")
    return F.struct(
        F.coalesce(r["id"], F.lit("")).alias("provider_id"), F.nullif(r["blobId"], F.lit("")).alias("provider_blob_id"), F.coalesce(r["size"], F.lit(0)).alias("size"),
        F.coalesce(r["receivedAt"], F.lit("")).alias("received_at"), true_keys(F.coalesce(r["keywords"], none)).alias("keywords"),
        true_keys(F.coalesce(r["mailboxIds"], none)).alias("mailbox_provider_ids"),
    )
