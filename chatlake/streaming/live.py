"""A live feed of messages whose state stays bounded however long it runs.

Messages and handles are streams of signals, joined by handle. A message that was
delivered before is recognised by its id in a state that the watermark clears: redelivery
is known for as long as ``remember`` says, and no stored table is read. A message is kept
in the state of the join until its patience ends, so a handle that comes within that time
releases its messages; one that none came for is given up when the watermark passes. The
state holds the messages of ``remember`` and of the time to wait, and one row per handle
and lane.

Time here is the time of arrival (of a file, unless the caller has a better one): old
messages may arrive in any order and none is late. The clock is that of the stream that
is further on, so a feed without new handles still gives messages up. A handle with a
large share of the messages is dealt over ``lanes``; its signal goes to each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from chatlake.functions.body import with_best_text
from chatlake.functions.text import present
from chatlake.functions.time import apple_ts
from chatlake.operators.contacts import handle_user_id
from chatlake.operators.lookups import drop_blank, drop_system_rows

REMEMBER = "7 days"
PATIENCE_HOURS = 24 * 30
LANES = 16
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_CLOCK = "spark.sql.streaming.multipleWatermarkPolicy"
NOT_TOLD = "no handle within the time to wait"


def use_state_store(spark: SparkSession) -> None:
    """Keyed state lives in the store on disk, so it may exceed memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def message_signals(message: DataFrame, arrived: Column, as_of: Column | None = None) -> DataFrame:
    """Signals of source messages: those of use, with their best text."""
    rows = drop_blank(drop_system_rows(with_best_text(message.withColumn("_arrived", arrived), "contents")))
    return rows.select(
        "handle_id", F.col("_arrived").alias("arrived"), F.col("rowid").alias("message_id"), "contents",
        F.coalesce(F.col("is_from_me") != 0, F.lit(False)).alias("is_from_me"),
        apple_ts(F.col("date"), as_of).alias("created_at"))


def handle_signals(handle: DataFrame, arrived: Column) -> DataFrame:
    """Signals of handles, each with the user it stands for; names and contacts of users are looked up at rest."""
    return handle.where(present(F.col("id")) & F.col("handle_id").isNotNull()).select(
        "handle_id", arrived.alias("arrived"), handle_user_id(F.col("handle_id")).alias("user_id"))


def once_each(messages: DataFrame, remember: str = REMEMBER) -> DataFrame:
    """Each message once, as far back as ``remember`` reaches; the watermark clears the rest."""
    return messages.withWatermark("arrived", remember).dropDuplicatesWithinWatermark(["message_id", "handle_id"])


def resolved_signals(messages: DataFrame, handles: DataFrame, remember: str = REMEMBER,
                     patience_hours: float = PATIENCE_HOURS, lanes: int = LANES) -> DataFrame:
    """Messages with their user, and those given up (user NULL, with a reason)."""
    # A user stands for its handle for good, so the first signal of a handle is all that counts.
    told = handles.withWatermark("arrived", remember).dropDuplicates(["handle_id"]).select(
        F.col("handle_id").alias("told_id"), F.col("arrived").alias("told_at"), "user_id",
        F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("told_lane"))
    waiting = once_each(messages, remember).withColumn("lane", F.pmod("message_id", F.lit(lanes)).cast("int"))
    patience = F.expr(f"INTERVAL {round(patience_hours * 3_600_000_000)} MICROSECONDS")
    found = waiting.join(told, (F.col("handle_id") == F.col("told_id")) & (F.col("lane") == F.col("told_lane"))
                         & (F.col("told_at") <= F.col("arrived") + patience), "left")
    return found.select("message_id", "user_id", "contents", "is_from_me", "created_at", "handle_id",
                        F.when(F.col("user_id").isNull(), NOT_TOLD).alias("reason"))


def follow_messages(messages: DataFrame, handles: DataFrame, path: str, remember: str = REMEMBER,
                    patience_hours: float = PATIENCE_HOURS, lanes: int = LANES, interval: str | None = None) -> StreamingQuery:
    """Keep a table of outcomes current from signals of messages and of handles.

    Every batch writes its own folder with overwrite, split into resolved and
    rejected rows, so a batch that is run again replaces itself.
    """
    spark = messages.sparkSession
    use_state_store(spark)
    outcomes = resolved_signals(messages, handles, remember, patience_hours, lanes)

    def write(batch: DataFrame, batch_id: int) -> None:
        kind = F.when(F.col("reason").isNull(), "resolved").otherwise("rejected")
        batch.withColumn("outcome", kind).write.partitionBy("outcome").mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    feed = outcomes.writeStream.foreachBatch(write).outputMode("append").option(
        "checkpointLocation", f"{path}-checkpoint").trigger(**trigger)
    before = spark.conf.get(_CLOCK)
    # The query takes it along when it starts.
    spark.conf.set(_CLOCK, "max")
    try:
        return feed.start()
    finally:
        spark.conf.set(_CLOCK, before)


_STORED = ("message_id bigint, user_id string, contents string, is_from_me boolean, created_at timestamp, handle_id bigint, "
           "reason string, outcome string, batch_id bigint")


def synced_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages that found their user."""
    rows = spark.read.schema(_STORED).parquet(path)
    return rows.where("outcome = 'resolved'").select("message_id", "user_id", "contents", "is_from_me", "created_at")


def rejected_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages that were given up, and why."""
    rows = spark.read.schema(_STORED).parquet(path)
    return rows.where("outcome = 'rejected'").select("message_id", "handle_id", "contents", "is_from_me", "created_at", "reason")
