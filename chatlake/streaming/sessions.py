"""Conversation detection on a live stream."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from chatlake.operators.conversations import GAP_HOURS, HOUR_MICROS, MIN_MESSAGES
from chatlake.streaming.live import use_state_store

# Executors need no copy of this package: the processor travels with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stream_conversations(messages: DataFrame, gap_hours: float = GAP_HOURS, min_messages: int = MIN_MESSAGES,
                         late_by: str = "1 hour") -> DataFrame:
    """Closed conversations of a message stream (chat_id, message_id, created_at).

    A conversation comes out once the watermark has passed its end by the gap; those
    still open are not in the result.

    A session window merges rows exactly one gap apart while a pause of that
    length must split, so its gap is one microsecond shorter. The state per open
    conversation is a count and two rows.
    """
    gap = int(gap_hours * HOUR_MICROS) - 1
    row = F.struct("created_at", "message_id")
    found = messages.withWatermark("created_at", late_by).groupBy(
        "chat_id", F.session_window("created_at", f"{gap} microseconds")
    ).agg(F.count(F.lit(1)).alias("message_count"), F.min(row).alias("head"), F.max(row).alias("tail"))
    return found.where(F.col("message_count") >= min_messages).select(
        "chat_id", F.col("head.message_id").alias("start_message_id"), F.col("tail.message_id").alias("end_message_id"),
        "message_count", F.col("head.created_at").alias("start_time"), F.col("tail.created_at").alias("end_time"))


# Conversations that are still open.

_STRETCH = ["start_us", "start_id", "starter", "end_us", "end_id", "messages"]
_STRETCHES = "chat_id bigint, start_us bigint, start_id bigint, starter string, end_us bigint, end_id bigint, messages bigint"
_HELD = "start_us bigint, start_id bigint, starter string, end_us bigint, end_id bigint, messages bigint"
_UPDATES = _STRETCHES + ", status string"
_STORED = ("chat_id bigint, start_message_id bigint, end_message_id bigint, message_count bigint, start_time timestamp, "
           "end_time timestamp, initiated_by string, status string, batch_id bigint")
# What an update says, in the order in which updates of one batch count.
_STATUSES = ("open", "closed", "replaced")


def joined_stretches(stretches: pd.DataFrame, gap: int) -> pd.DataFrame:
    """Stretches of one or many chats, joined where less than ``gap`` microseconds lie between them."""
    found = stretches.sort_values(["chat_id", "start_us", "start_id"], kind="stable").reset_index(drop=True)
    reach = found.groupby("chat_id", sort=False)["end_us"].cummax()
    same = found["chat_id"].eq(found["chat_id"].shift())
    found["group"] = (~(same & (found["start_us"] - reach.shift() < gap))).cumsum()
    first = found.drop_duplicates("group")
    last = found.sort_values(["end_us", "end_id"], kind="stable").drop_duplicates("group", keep="last").sort_values("group")
    joined = first[["chat_id", "start_us", "start_id", "starter"]].reset_index(drop=True)
    joined["end_us"], joined["end_id"] = last["end_us"].to_numpy(), last["end_id"].to_numpy()
    joined["messages"] = found.groupby("group")["messages"].sum().to_numpy()
    return joined


def merged_stretches(rows: list[tuple], gap: int) -> list[tuple]:
    """As ``joined_stretches`` for the few rows of one chat, as tuples of ``_STRETCH``."""
    found: list[tuple] = []
    for row in sorted(rows, key=lambda r: r[:2]):
        if found and row[0] - found[-1][3] < gap:
            start, first, starter, *end, messages = found[-1]
            found[-1] = (start, first, starter, *max(tuple(end), row[3:5]), messages + row[5])
        else:
            found.append(row)
    return found


def _combined(gap: int):
    """Rows of a task to stretches: a busy chat sends few rows to its state."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield joined_stretches(frame, gap)[["chat_id", *_STRETCH]]
    return run


class OpenConversations(StatefulProcessor):
    """The open conversations of a chat; each change of one is an update, its end comes by timer."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _HELD)

    def _known(self) -> list[tuple]:
        return [tuple(r) for r in self.held.get()]

    def _keep(self, rows: list[tuple]) -> None:
        """A chat has one timer, that of the conversation which ends first."""
        if rows:
            self.held.put(rows)
            self.handle.registerTimer(min(self._due(r[3]) for r in rows))
        else:
            self.held.clear()

    def _due(self, end_us: int) -> int:
        """The millisecond from which on no row can join any more."""
        return -(-(int(end_us) + self.gap) // 1000)

    @staticmethod
    def _updates(key, rows: list[tuple], status: str) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=_STRETCH)
        frame.insert(0, "chat_id", int(key[0]))
        return frame.assign(status=status)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self._known()
        new = [(int(a), int(i), s, int(b), int(j), int(n)) for frame in rows
               for a, i, s, b, j, n in frame[_STRETCH].itertuples(index=False)]
        found = merged_stretches(known + new, self.gap)
        self._keep(found)
        before, starts = set(known), {r[:2] for r in found}
        if gone := [r for r in known if r[:2] not in starts]:
            yield self._updates(key, gone, "replaced")
        if changed := [r for r in found if r not in before]:
            yield self._updates(key, changed, "open")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All that the watermark has passed, not only the conversation whose timer this is.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        known = self._known()
        if over := [r for r in known if self._due(r[3]) <= now]:
            self._keep([r for r in known if self._due(r[3]) > now])
            yield self._updates(key, over, "closed")
        elif known:
            self._keep(known)

    def close(self) -> None:
        pass


def conversation_updates(messages: DataFrame, gap_hours: float = GAP_HOURS, late_by: str = "1 hour") -> DataFrame:
    """Every change of every conversation of a message stream (chat_id, message_id, user_id, created_at).

    ``status`` is open, closed (the watermark passed its end by the gap) or replaced (an
    earlier message came, so it now has another start). State holds only what is open.
    A message later than ``late_by`` may start a conversation of its own.
    """
    gap = int(gap_hours * HOUR_MICROS)
    at = F.unix_micros("created_at")
    rows = messages.where("chat_id IS NOT NULL AND created_at IS NOT NULL").select(
        F.col("chat_id").cast("bigint").alias("chat_id"), at.alias("start_us"), F.col("message_id").alias("start_id"),
        F.col("user_id").alias("starter"), at.alias("end_us"), F.col("message_id").alias("end_id"),
        F.lit(1).cast("bigint").alias("messages"))
    stretches = rows.mapInPandas(_combined(gap), _STRETCHES).withColumn("end_time", F.timestamp_micros("end_us"))
    found = stretches.withWatermark("end_time", late_by).groupBy("chat_id").transformWithStateInPandas(
        statefulProcessor=OpenConversations(gap), outputStructType=_UPDATES, outputMode="Update", timeMode="EventTime")
    return found.select(
        "chat_id", F.col("start_id").alias("start_message_id"), F.col("end_id").alias("end_message_id"),
        F.col("messages").alias("message_count"), F.timestamp_micros("start_us").alias("start_time"),
        F.timestamp_micros("end_us").alias("end_time"), F.col("starter").alias("initiated_by"), "status")


def follow_conversations(messages: DataFrame, path: str, gap_hours: float = GAP_HOURS, late_by: str = "1 hour",
                         interval: str | None = None) -> StreamingQuery:
    """Keep a table of updates current; a batch that is run again replaces its folder."""
    use_state_store(messages.sparkSession)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return conversation_updates(messages, gap_hours, late_by).writeStream.foreachBatch(write).outputMode("update").option(
        "checkpointLocation", f"{path}-checkpoint").trigger(**trigger).start()


def current_conversations(spark: SparkSession, path: str, min_messages: int = MIN_MESSAGES) -> DataFrame:
    """Conversations as they are now, open or closed; at the end of input those of the whole log."""
    updates = spark.read.schema(_STORED).parquet(path)
    order = F.array_position(F.array(*map(F.lit, _STATUSES)), F.col("status"))
    fields = ["end_message_id", "message_count", "end_time", "initiated_by", "status"]
    latest = updates.groupBy("chat_id", "start_message_id", "start_time").agg(
        F.max_by(F.struct(*fields), F.struct("batch_id", order, "message_count")).alias("now"))
    found = latest.select("chat_id", "start_message_id", "now.end_message_id", "now.message_count", "start_time",
                          "now.end_time", "now.initiated_by", "now.status")
    return found.where(F.col("status") != "replaced").where(F.col("message_count") >= min_messages)
