"""Streams with bounded state: redelivery, late handles, patience that ends, open conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chatlake.session import scratch_path
from chatlake.streaming import live as LV, sessions as SS
from checks.inputs import Inputs, as_of, sql_ts
from checks.registry import check
from checks.sequences import KNOWN, SEGMENTS, SYNCED

FIRST_DAY = "2024-01-01"


def _deliver(v: Inputs, rows: DataFrame, path: str, day: int) -> None:
    """Add files that arrive on a day; ``arrived`` is the clock of the stream."""
    rows.withColumn("arrived", F.expr(f"timestamp '{FIRST_DAY}' + interval {day} days")).write.mode("append").parquet(path)


def _follow(v: Inputs, messages: str, handles: str, path: str, **how) -> None:
    arrived, read = F.col("arrived"), v.spark.read.parquet
    streams = [v.spark.readStream.schema(read(p).schema).parquet(p) for p in (messages, handles)]
    LV.follow_messages(LV.message_signals(streams[0], arrived, as_of()), LV.handle_signals(streams[1], arrived), path, **how).awaitTermination()


def _live_messages(v: Inputs) -> DataFrame:
    """Ids in any order, a third of them delivered twice, a third of the handles after their messages."""
    messages, handles, path = (scratch_path(v.spark, n) for n in ("feed", "feed-handles", "live"))
    _deliver(v, v.handle.where("handle_id % 3 <> 0"), handles, 0)
    for day, part in enumerate((2, 0)):
        _deliver(v, v.message.where(F.col("rowid") % 3 == part), messages, day)
    _follow(v, messages, handles, path)
    _deliver(v, v.message.where(F.col("rowid") % 3 != 0), messages, 2)
    _deliver(v, v.handle.where("handle_id % 3 = 0"), handles, 2)
    _follow(v, messages, handles, path)
    return LV.synced_messages(v.spark, path)


def _live_rejected(v: Inputs) -> DataFrame:
    """Messages whose handle does not come within 30 days."""
    messages, handles, path = (scratch_path(v.spark, n) for n in ("feed", "feed-handles", "live"))
    _deliver(v, v.handle.where("handle_id % 3 <> 0"), handles, 0)
    _deliver(v, v.message, messages, 0)
    _follow(v, messages, handles, path, remember="1 day")
    # The clock goes on while known rows come again.
    _deliver(v, v.message.where("rowid <= 10"), messages, 40)
    _follow(v, messages, handles, path, remember="1 day")
    # The missing handles are too late now.
    _deliver(v, v.handle.where("handle_id % 3 = 0"), handles, 41)
    _follow(v, messages, handles, path, remember="1 day")
    return LV.rejected_messages(v.spark, path).drop("is_from_me")


check("live_messages", _live_messages, SYNCED + KNOWN)
check("live_rejected", _live_rejected, f"""
SELECT m.message_id, s.handle_id, m.contents, {sql_ts('m.created_at')} AS created_at, 'no handle within the time to wait' AS reason
FROM messages m JOIN message s ON s.rowid = m.message_id
WHERE s.handle_id <> 0 AND (s.handle_id % 3 = 0 OR s.handle_id NOT IN (SELECT handle_id FROM handle))""")


def _live_conversations(v: Inputs) -> DataFrame:
    """Conversations of the whole log, from a stream of updates; those the clock has not passed are open."""
    schema = v.spark.read.parquet(f"{v.sf_dir}/events.parquet").schema
    events = v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(v.sf_dir)
    rows = events.select(
        F.col("user_id").alias("chat_id"), F.expr("event_id + 1").alias("message_id"),
        F.expr("concat('w', event_id % 3)").alias("user_id"), F.col("ts").cast("timestamp").alias("created_at"))
    path = scratch_path(v.spark, "updates")
    SS.follow_conversations(rows, path).awaitTermination()
    return SS.current_conversations(v.spark, path)


check("live_conversations", _live_conversations, SEGMENTS.replace("arg_min(user_id, idx)", "'w' || ((arg_min(message_id, idx) - 1) % 3)") + f"""
SELECT chat_id, start_message_id, end_message_id, message_count, {sql_ts('start_time')} AS start_time, {sql_ts('end_time')} AS end_time,
  initiated_by, CASE WHEN epoch_us(end_time) + 172800000000 <= (SELECT epoch_us(max(ts)) FROM events) // 1000 * 1000 - 3600000000
    THEN 'closed' ELSE 'open' END AS status FROM found""")
