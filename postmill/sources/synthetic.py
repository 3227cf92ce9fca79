"""A synthetic mailbox of any size, made by the executors from a seed, and its way into a store through the log.

Every message is a function of its number and the seed, so any range of numbers can be made anywhere and twice alike. Persons are
drawn from a Zipf law, dates lie denser toward the end, a share of the messages answers an earlier one.

Edge cases: no messages give empty tables; shares of 0 and 1 are allowed; the same seed and size give the same rows.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.ids import blob_id
from postmill.operators import blobs

# Shares of messages and weights of mailboxes.
REPLY, ATTACHMENT, LIST, UNREAD, FLAGGED = 0.55, 0.14, 0.18, 0.07, 0.03
MAILBOXES = (("inbox", 40), ("archive", 42), ("sent", 12), ("junk", 4), ("trash", 2))
END = datetime(2026, 9, 1, 12, tzinfo=timezone.utc)
DAYS = 730
REPLY_POOL = 512


def chance(seed: int, *names: Column | str) -> Column:
    """A number from 0 to below 1 that depends on the seed and the names alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *names), 11) / F.lit(float(1 << 53))


def zipf(u: Column, size: int) -> Column:
    """Index below ``size`` for a chance: floor(size ** u) - 1, small ones far more often."""
    return F.greatest(F.lit(0), F.least(F.lit(size - 1), F.floor(F.pow(F.lit(float(size)), u)) - 1)).cast("bigint")


def weighted(u: Column, choices: tuple[tuple[str, float], ...]) -> Column:
    """The choice whose share of the weights a chance falls in."""
    total, upto, out = sum(w for _, w in choices), 0.0, F.lit(choices[-1][0])
    tests = []
    for name, w in choices[:-1]:
        upto += w
        tests.append((upto / total, name))
    for limit, name in reversed(tests):
        out = F.when(u < limit, F.lit(name)).otherwise(out)
    return out


def mailbox(spark: SparkSession, size: int, account: str = "synthetic", seed: int = 1, people: int = 400) -> DataFrame:
    """number, id, received_at, sender, mailbox, keywords, parent (number or null), list_id, bytes of ``size`` messages."""
    rows = spark.range(size).withColumnRenamed("id", "number")
    u = lambda what: chance(seed, F.lit(what), "number")
    # the square root of an even share makes later dates denser
    at = F.timestamp_seconds(F.lit(END.timestamp()) - F.lit(DAYS * 86400.0) * (1 - F.sqrt((F.col("number") + u("at")) / F.lit(float(max(size, 1))))))
    back = 1 + zipf(u("back"), REPLY_POOL)
    parent = F.when((u("reply") < REPLY) & (F.col("number") >= back), F.col("number") - back)
    made = rows.select(
        "number", F.concat(F.lit(f"m:{account}:s"), "number").alias("id"), at.alias("received_at"), F.concat(F.lit("person"), zipf(u("person"), people), F.lit("@x.test")).alias("sender"),
        weighted(u("box"), MAILBOXES).alias("mailbox"), parent.alias("parent"), F.when(u("list") < LIST, F.concat(F.lit("list"), zipf(u("which"), 12), F.lit(".x.test"))).alias("list_id"),
        F.array_compact(F.array(F.when(u("seen") >= UNREAD, F.lit("$seen")), F.when(u("flag") < FLAGGED, F.lit("$flagged")))).alias("keywords"), (u("attach") < ATTACHMENT).alias("attached"),
    )
    date = F.date_format("received_at", "EEE, d MMM yyyy HH:mm:ss")
    head = F.concat(
        F.lit("From: "), "sender", F.lit("\r\nTo: me@x.test\r\nDate: "), date, F.lit(" +0000\r\nMessage-ID: <s"), "number", F.lit("@x.test>\r\nSubject: "),
        F.when(F.col("parent").isNotNull(), F.concat(F.lit("Re: topic "), F.col("parent") % 97)).otherwise(F.concat(F.lit("topic "), F.col("number") % 97)), F.lit("\r\n"),
        F.coalesce(F.concat(F.lit("In-Reply-To: <s"), "parent", F.lit("@x.test>\r\n")), F.lit("")), F.coalesce(F.concat(F.lit("List-Id: <"), "list_id", F.lit(">\r\n")), F.lit("")),
    )
    words = F.concat_ws(" ", *[F.concat(F.lit("word"), zipf(chance(seed, F.lit(k), "number"), 40_000)) for k in range(24)])
    attached = F.concat(F.lit('Content-Type: multipart/mixed; boundary="s1"\r\n\r\n--s1\r\nContent-Type: text/plain\r\n\r\n'), words,
                        F.lit("\r\n--s1\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=a.pdf\r\nContent-Transfer-Encoding: base64\r\n\r\nQUJD\r\n--s1--\r\n"))
    body = F.when(F.col("attached"), attached).otherwise(F.concat(F.lit("Content-Type: text/plain\r\n\r\n"), words, F.lit("\r\n")))
    return made.withColumn("bytes", F.concat(head, body).cast("binary")).drop("attached")


def seeded(messages: DataFrame, account: str = "synthetic", start: int = 0) -> tuple[DataFrame, DataFrame]:
    """The blobs to store and the log entries of a synthetic mailbox: four entries a message, in order of its number."""
    spark = messages.sparkSession
    stored = blobs.put(spark.createDataFrame([], "id string, size bigint, bytes binary"), messages.select("bytes"))
    blob, nothing = blob_id(F.col("bytes")), lambda t: F.lit(None).cast(t)
    fields = {
        "message_id": "string", "blob_id": "string", "size": "bigint", "provider_id": "string", "received_at": "timestamp", "keywords": "array<string>", "mailbox_ids": "array<string>",
        "mailbox": "struct<id:string,name:string,role:string>", "mailbox_id": "string", "collection": "string", "cursor": "string",
    }

    def entry(type_: str, **given: Column) -> Column:
        payload = F.struct(*[given.get(k, nothing(t)).cast(t).alias(k) for k, t in fields.items()])
        return F.struct(F.lit(type_).alias("type"), payload.alias("payload"))

    entries = F.array(
        entry("blob.stored", blob_id=blob, size=F.length("bytes")),
        entry("message.observed", message_id=F.col("id"), blob_id=blob, provider_id=F.concat(F.lit("s"), "number"), received_at=F.col("received_at")),
        entry("message.keywords.set", message_id=F.col("id"), keywords=F.col("keywords")),
        entry("message.mailboxes.set", message_id=F.col("id"), mailbox_ids=F.array("mailbox")),
    )
    rows = messages.select("number", "received_at", F.posexplode(entries).alias("k", "e"))
    return stored, rows.select(
        (F.lit(start) + F.col("number") * 4 + F.col("k") + 1).alias("seq"), F.lit(account).alias("account_id"), F.col("received_at").alias("event_at"), F.lit("remote").alias("source"), "e.type", "e.payload"
    )
