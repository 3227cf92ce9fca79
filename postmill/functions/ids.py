"""Identifier expressions: Message-ID comparison form, derived local ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def message_id_key(value: Column) -> Column:
    """Message-ID without brackets and outer blanks, in lower case; null where nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(value, r"^[\s<]+|[\s>]+$", "")), F.lit(""))


def first_message_id(values: Column) -> Column:
    """Comparison form of the first value of a Message-ID header list."""
    return message_id_key(F.get(values, F.lit(0)))


def local_message_id(account: Column, provider: Column) -> Column:
    """``m:account:provider``."""
    return F.concat_ws(":", F.lit("m"), account, provider)


def local_mailbox_id(account: Column, provider: Column) -> Column:
    """``mb:account:provider``."""
    return F.concat_ws(":", F.lit("mb"), account, provider)


def provider_id_of(local_id: Column) -> Column:
    """Inverse of the local id; colons inside the provider id are kept, other shapes give null."""
    return F.nullif(F.regexp_extract(local_id, r"^[^:]*:[^:]*:(.*)$", 1), F.lit(""))


def blob_id(content: Column) -> Column:
    """``sha256:`` and the hex digest of the bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))
