"""Splitting chats into conversations.

Input rows have ``chat_id, message_id, user_id, is_from_me, created_at,
contents``; rows of a chat are ordered by (created_at, message_id).

Time gaps are found without ordering the messages of a chat. Time is cut into
cells as wide as the gap. Two neighbours a whole gap apart never share a cell,
so they are the last row of one cell and the first row of the next occupied
cell. Each (chat, cell) is reduced to its count, first and last row, which
combines before the shuffle; only these small rows are ordered per chat.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from chatlake.functions.text import numbered_line
from chatlake.operators.sequences import PART_ROWS, collect_parts, group_index
from chatlake.session import settle

GAP_HOURS = 48
MIN_MESSAGES = 2
CHUNK_SIZE = 200
OVERLAP = 30
GAP_CONFIDENCE = 0.7
HOUR_MICROS = 3_600_000_000

ORDER = ["created_at", "message_id"]


def _cell(gap_hours: float) -> Column:
    width = int(gap_hours * HOUR_MICROS)
    micros = F.unix_micros("created_at")
    return F.call_function("div", micros - F.pmod(micros, F.lit(width)), F.lit(width))


# A place in a chat as one number: the time, then the message id. No time comes first.
_WIDTH, _HALF, _NO_TIME = 2**64, 2**63, -(2**62)


def _number(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(20,0)")


def _place() -> Column:
    time = F.coalesce(F.unix_micros("created_at"), F.lit(_NO_TIME)).cast("decimal(20,0)")
    return (time * _number(_WIDTH) + (F.col("message_id").cast("decimal(20,0)") + _number(_HALF))).cast("decimal(38,0)")


def _message_at(place: str) -> Column:
    return (F.pmod(F.col(place), _number(_WIDTH)) - _number(_HALF)).cast("bigint")


def _time_at(place: str) -> Column:
    micros = F.floor(F.col(place) / _number(_WIDTH)).cast("bigint")
    return F.when(micros != _NO_TIME, F.timestamp_micros(micros))


def _cells(messages: DataFrame, gap_hours: float, with_rows: bool = True) -> DataFrame:
    """One row per chat and occupied cell, numbered into conversations per chat.

    ``with_rows`` keeps the first and last row of each cell, as one number each. Only
    numbers are aggregated, which a hash aggregation does in place.
    """
    edges = [F.min(_place()).alias("head"), F.max(_place()).alias("tail")] if with_rows else []
    cells = messages.groupBy("chat_id", _cell(gap_hours).alias("cell")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), *edges)
    by_time = Window.partitionBy("chat_id").orderBy("cell")
    pause = F.unix_micros("first_at") - F.unix_micros(F.lag("last_at").over(by_time))
    up_to_here = by_time.rowsBetween(Window.unboundedPreceding, 0)
    earlier = by_time.rowsBetween(Window.unboundedPreceding, -1)
    starts = F.coalesce((F.col("pause") >= int(gap_hours * HOUR_MICROS)).cast("int"), F.lit(0))
    return (
        cells.withColumn("pause", pause).withColumn("starts", starts)
        .withColumn("segment", F.sum("starts").over(up_to_here))
        .withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    )


def gap_boundaries(messages: DataFrame, gap_hours: float = GAP_HOURS) -> DataFrame:
    """(chat_id, after_message_index, reason, confidence) where a chat pauses for ``gap_hours`` or more."""
    hours = F.bround(F.col("pause") / HOUR_MICROS, 0).cast("bigint").cast("string")
    return _cells(messages, gap_hours, with_rows=False).where("starts = 1").select(
        "chat_id", (F.col("before") - 1).alias("after_message_index"),
        F.concat(F.lit("Time gap of "), hours, F.lit(" hours")).alias("reason"),
        F.lit(GAP_CONFIDENCE).alias("confidence"),
    )


def conversation_id(chat_id: Column, start_message_id: Column) -> Column:
    return F.concat_ws(":", chat_id.cast("string"), start_message_id.cast("string"))


def _stretched(pieces: DataFrame, min_messages: int) -> DataFrame:
    """Pieces (chat_id, segment, rows, before, head, tail) put together, those long enough."""
    whole = pieces.groupBy("chat_id", "segment").agg(
        F.sum("rows").alias("message_count"), F.min("before").alias("start_index"),
        F.min("head").alias("head"), F.max("tail").alias("tail"))
    return whole.where(F.col("message_count") >= min_messages).select(
        conversation_id(F.col("chat_id"), _message_at("head")).alias("conversation_id"), "chat_id", "segment",
        _message_at("head").alias("start_message_id"), _message_at("tail").alias("end_message_id"),
        "message_count", _time_at("head").alias("start_time"), _time_at("tail").alias("end_time"), "start_index",
    )


def _started(found: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations in full: the user of the first message is fetched by its id."""
    first = found.select("chat_id", F.col("start_message_id").alias("message_id"))
    starters = messages.select("chat_id", "message_id", "user_id").join(first, ["chat_id", "message_id"]).groupBy(
        "chat_id", F.col("message_id").alias("start_message_id")).agg(F.min("user_id").alias("initiated_by"))
    return found.join(starters, ["chat_id", "start_message_id"]).select(
        "conversation_id", "chat_id", "start_message_id", "end_message_id", "message_count", "start_time", "end_time",
        F.lit(None).cast("string").alias("title"), F.lit("completed").alias("status"), "initiated_by", "start_index")


def conversations(messages: DataFrame, gap_hours: float = GAP_HOURS, min_messages: int = MIN_MESSAGES) -> DataFrame:
    """One row per conversation of at least ``min_messages`` messages, split at time gaps."""
    return _started(_stretched(_cells(messages, gap_hours), min_messages), messages)


def _cell_conversations(messages: DataFrame, gap_hours: float, min_messages: int) -> DataFrame:
    """(chat_id, cell) -> conversation: the small side of the one join that labels messages."""
    cells = _cells(messages, gap_hours)
    kept = _stretched(cells, min_messages).select("conversation_id", "chat_id", "segment", "start_index")
    return cells.select("chat_id", "cell", "segment").join(kept, ["chat_id", "segment"]).drop("segment")


def _labelled(messages: DataFrame, conversations_of: DataFrame, gap_hours: float) -> DataFrame:
    # A (chat, cell) key is unique on the right; AQE splits a hot one on the left.
    return messages.withColumn("cell", _cell(gap_hours)).join(conversations_of, ["chat_id", "cell"])


def conversation_members(messages: DataFrame, gap_hours: float = GAP_HOURS,
                         min_messages: int = MIN_MESSAGES) -> DataFrame:
    """The distinct users of each conversation."""
    # Distinct per cell first: that combines before the shuffle.
    present = messages.select("chat_id", _cell(gap_hours).alias("cell"), "user_id").distinct()
    found = _cell_conversations(messages, gap_hours, min_messages)
    return present.join(found, ["chat_id", "cell"]).select("conversation_id", "user_id").distinct()


def conversation_messages(messages: DataFrame, gap_hours: float = GAP_HOURS, min_messages: int = MIN_MESSAGES) -> DataFrame:
    """(conversation_id, message_id, sequence_number): the nested messages as rows, numbered from 1."""
    narrow = messages.select("chat_id", "message_id", "created_at")
    indexed = group_index(narrow, ["chat_id"], ORDER)
    found = _cell_conversations(messages, gap_hours, min_messages)
    return _labelled(indexed, found, gap_hours).select(
        "conversation_id", "message_id",
        (F.col("message_index") - F.col("start_index") + 1).alias("sequence_number"),
    )


def conversation_records(messages: DataFrame, gap_hours: float = GAP_HOURS, min_messages: int = MIN_MESSAGES,
                         part_rows: int = PART_ROWS) -> DataFrame:
    """Conversations in the stored shape, with their sorted users, ``part_rows`` to a row."""
    users = collect_parts(conversation_members(messages, gap_hours, min_messages), ["conversation_id"], ["user_id"],
                          F.col("user_id"), "users", part_rows)
    return conversations(messages, gap_hours, min_messages).join(users, "conversation_id").select(
        "conversation_id", "chat_id", "part", "users", F.col("start_time").alias("created_at"),
        F.col("end_time").alias("completed_at"), F.col("message_count").alias("count"),
        F.lit(None).cast("string").alias("summary"), "status", "initiated_by",
    )


def message_index(messages: DataFrame, cell: Column | None = None) -> DataFrame:
    """0-based position of each message in its chat; ``cell`` as for ``group_index``, days by default."""
    return group_index(messages, ["chat_id"], ORDER, cell=cell)


def _stretches(messages: DataFrame, boundaries: DataFrame, min_messages: int) -> DataFrame:
    """(chat_id, start_index, end_index, message_count) between boundaries, from chat sizes alone."""
    sizes = messages.groupBy("chat_id").agg((F.count(F.lit(1)) - 1).alias("last"))
    ends = boundaries.select("chat_id", "after_message_index").join(sizes, "chat_id").select(
        "chat_id", F.least("after_message_index", "last").alias("end_index"))
    ends = ends.where("end_index >= 0").unionByName(sizes.select("chat_id", F.col("last").alias("end_index")))
    # The boundaries of a chat can be as many as its messages: number them like messages.
    placed = group_index(ends.distinct(), ["chat_id"], ["end_index"], "segment")
    following = placed.select("chat_id", (F.col("segment") + 1).alias("segment"),
                              (F.col("end_index") + 1).alias("start_index"))
    stretches = placed.join(following, ["chat_id", "segment"], "left").withColumn(
        "start_index", F.coalesce("start_index", F.lit(0)))
    return stretches.withColumn("message_count", F.col("end_index") - F.col("start_index") + 1).where(
        F.col("message_count") >= min_messages).drop("segment")


def conversations_from_boundaries(messages: DataFrame, boundaries: DataFrame,
                                  min_messages: int = MIN_MESSAGES) -> DataFrame:
    """Conversations between boundaries that any annotator supplied as (chat_id, after_message_index).

    Boundaries give the index range of every stretch, so each stretch is read off
    its first and last row; the messages of a chat are never gathered.
    """
    stretches = _stretches(messages, boundaries, min_messages)
    indexed = message_index(messages.select("chat_id", "message_id", "created_at"))
    at = indexed.select("chat_id", F.col("message_index").alias("at"), _place().alias("place"))
    edges = stretches.select("chat_id", "start_index", "message_count", F.explode(
        F.array(F.col("start_index"), F.col("end_index"))).alias("at")).distinct()
    read = edges.join(at, ["chat_id", "at"]).groupBy("chat_id", "start_index", "message_count").agg(
        F.min("place").alias("head"), F.max("place").alias("tail"))
    pieces = read.select("chat_id", F.col("start_index").alias("segment"), F.col("message_count").alias("rows"),
                         F.col("start_index").alias("before"), "head", "tail")
    return _started(_stretched(pieces, min_messages), messages)


def conversation_metrics(found: DataFrame) -> DataFrame:
    minutes = (F.unix_micros("end_time") - F.unix_micros("start_time")) / 60_000_000
    return found.select("conversation_id", "chat_id", "message_count", minutes.alias("duration_minutes"))


def detector_comparison(messages: DataFrame, boundaries: DataFrame, gap_hours: float = GAP_HOURS,
                        min_messages: int = MIN_MESSAGES) -> DataFrame:
    """Boundaries and conversations per detection method."""
    segments = _cells(messages, gap_hours, with_rows=False).groupBy("chat_id", "segment").agg(
        F.sum("rows").alias("rows"), F.sum("starts").alias("starts"))
    by_time = segments.agg(
        F.coalesce(F.sum("starts"), F.lit(0)).cast("bigint").alias("boundaries"),
        F.count_if(F.col("rows") >= min_messages).alias("conversations"))
    found = _stretches(messages, boundaries, min_messages).agg(F.count(F.lit(1)))
    given = boundaries.agg(F.count(F.lit(1)).alias("boundaries")).select("boundaries", found.scalar().alias("conversations"))
    columns = ["method", "boundaries", "conversations"]
    return by_time.withColumn("method", F.lit("time_based")).select(columns).unionByName(
        given.withColumn("method", F.lit("supplied")).select(columns))


# Overlapping chunks for an annotator.

def overlapping_chunks(indexed: DataFrame, sizes: DataFrame, chunk_size: int = CHUNK_SIZE,
                       overlap: int = OVERLAP) -> DataFrame:
    """Repeat each indexed row for every chunk that covers it.

    Chunk k starts at k * (chunk_size - overlap); the last one is the first that
    reaches the end of the chat.
    """
    step = chunk_size - overlap
    last_chunk = F.when(F.col("n") <= chunk_size, F.lit(0)).otherwise(
        F.ceil((F.col("n") - chunk_size) / step)).cast("bigint")
    index = F.col("message_index")
    first = F.greatest(F.lit(0).cast("bigint"), F.ceil((index - chunk_size + 1) / step).cast("bigint"))
    final = F.least(F.floor(index / step).cast("bigint"), last_chunk)
    rows = indexed.join(sizes, "chat_id").withColumn("chunk", F.explode(F.sequence(first, final)))
    start = F.col("chunk") * step
    return rows.withColumns({"chunk_start": start, "chunk_position": index - start}).drop("n")


def chat_sizes(messages: DataFrame) -> DataFrame:
    return messages.groupBy("chat_id").agg(F.count(F.lit(1)).alias("n"))


def chunk_ranges(messages: DataFrame, chunk_size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(chat_id, chunk, chunk_start, rows) of every chunk, from the chat sizes alone."""
    step = chunk_size - overlap
    last_chunk = F.when(F.col("n") <= chunk_size, F.lit(0)).otherwise(F.ceil((F.col("n") - chunk_size) / step))
    chunks = chat_sizes(messages).select(
        "chat_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), last_chunk.cast("bigint"))).alias("chunk"))
    start = F.col("chunk") * step
    return chunks.select("chat_id", "chunk", start.alias("chunk_start"),
                         F.least(F.lit(chunk_size).cast("bigint"), F.col("n") - start).alias("rows"))


# The prompt asks for the JSON array that ``parse_boundaries`` reads.
BOUNDARY_TEMPLATE = (
    "Find where one conversation ends and the next begins in these numbered messages:\n\n{messages}\n\n"
    "Answer with a JSON array of objects with the keys after_message_index (the number of the last message "
    "of a conversation), reason and confidence (0.0 to 1.0). Answer [] when they are one conversation."
)


def boundary_prompts(messages: DataFrame, chunk_size: int = CHUNK_SIZE, overlap: int = OVERLAP,
                     template: str = BOUNDARY_TEMPLATE) -> DataFrame:
    """Prompt text per chat and chunk; a chunk holds at most ``chunk_size`` lines."""
    rows = overlapping_chunks(message_index(messages), chat_sizes(messages), chunk_size, overlap)
    line = numbered_line(F.col("chunk_position"), F.col("created_at"), F.col("is_from_me"), F.col("user_id"),
                         F.col("contents"))
    head, tail = template.split("{messages}")
    chunks = rows.groupBy("chat_id", "chunk", "chunk_start").agg(
        F.array_sort(F.collect_list(F.struct("chunk_position", line.alias("line")))).alias("_lines"))
    body = F.array_join(F.transform("_lines", lambda r: r["line"]), "\n")
    return chunks.select("chat_id", "chunk", "chunk_start", F.size("_lines").alias("rows"),
                         F.concat(F.lit(head), body, F.lit(tail)).alias("prompt"))


def shift_boundaries(parsed: DataFrame) -> DataFrame:
    """Boundaries of chunk answers (chat_id, chunk_start, boundaries) in chat positions."""
    rows = parsed.select("chat_id", "chunk_start", F.explode("boundaries").alias("b"))
    return rows.select("chat_id", (F.col("b.after_message_index") + F.col("chunk_start")).alias("after_message_index"),
                       "b.reason", "b.confidence")


# Boundaries that lie so close are one that two annotators placed differently.
TOLERANCE = 2


def reconciled_boundaries(found: DataFrame, chunk_size: int = CHUNK_SIZE, overlap: int = OVERLAP,
                          tolerance: int = TOLERANCE) -> DataFrame:
    """One boundary where neighbouring chunks give one each, within ``tolerance`` messages of each other.

    ``found`` has (chat_id, chunk, after_message_index, reason, confidence), the index in
    the chat. Two boundaries of neighbours are the same if each is the closest to the
    other; the one with more confidence stays, on a tie the one further from the edge
    of its chunk, then the earlier one. The same boundary twice in a chunk is one.
    Rows meet by chat and chunk, so a chat of any length is many small groups.
    """
    step = chunk_size - overlap
    best = F.max(F.struct("confidence", "reason"))
    index = F.col("after_message_index")
    rows = found.groupBy("chat_id", "chunk", "after_message_index").agg(best.alias("_best")).select(
        "chat_id", "chunk", "after_message_index", "_best.confidence", "_best.reason")
    start = F.col("chunk") * step
    rows = rows.withColumn("room", F.least(index - start, start + chunk_size - 1 - index))
    side = {n: rows.select("chat_id", (F.col("chunk") + int(n == "a")).alias("_at"), index.alias(f"{n}_index"), F.col("confidence").alias(
        f"{n}_confidence"), F.col("room").alias(f"{n}_room")) for n in "ab"}
    near = side["a"].join(side["b"], ["chat_id", "_at"]).where(F.abs(F.col("a_index") - F.col("b_index")) <= tolerance)
    away = F.abs(F.col("a_index") - F.col("b_index"))
    closest = {n: F.row_number().over(Window.partitionBy("chat_id", "_at", f"{n}_index").orderBy(
        away, F.desc(f"{o}_confidence"), f"{o}_index")) for n, o in ("ab", "ba")}
    same = near.withColumns({f"_{n}": c for n, c in closest.items()}).where("_a = 1 AND _b = 1")
    first_wins = F.struct("a_confidence", "a_room", -F.col("a_index")) >= F.struct("b_confidence", "b_room", -F.col("b_index"))
    beaten = same.select("chat_id", F.when(first_wins, F.col("_at")).otherwise(F.col("_at") - 1).alias("chunk"),
                         F.when(first_wins, F.col("b_index")).otherwise(F.col("a_index")).alias("after_message_index"))
    kept = rows.join(beaten.distinct(), ["chat_id", "chunk", "after_message_index"], "left_anti")
    # With wide overlaps a third chunk may give it too.
    return kept.groupBy("chat_id", "after_message_index").agg(best.alias("_best")).select(
        "chat_id", "after_message_index", "_best.reason", "_best.confidence")


def chunk_boundaries(messages: DataFrame, detect: Callable[[pd.DataFrame], pd.DataFrame], chunk_size: int = CHUNK_SIZE,
                     overlap: int = OVERLAP, tolerance: int = TOLERANCE) -> DataFrame:
    """Boundaries of every chat by a function of one chunk.

    ``detect`` gets at most ``chunk_size`` messages in order and returns rows of
    (after_message_index, reason, confidence), the index counted in the chunk; those
    outside the chunk, or after its last message, are none.
    """
    rows = overlapping_chunks(message_index(messages), chat_sizes(messages), chunk_size, overlap)

    def run(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values("chunk_position").reset_index(drop=True)
        told = detect(chunk)[["after_message_index", "reason", "confidence"]]
        told = told[(told["after_message_index"] >= 0) & (told["after_message_index"] < len(chunk) - 1)]
        return told.assign(chat_id=chunk["chat_id"][0], chunk=chunk["chunk"][0],
                           after_message_index=told["after_message_index"].astype("int64") + int(chunk["chunk_start"][0]))

    kind = messages.schema["chat_id"].dataType.simpleString()
    found = rows.groupBy("chat_id", "chunk").applyInPandas(
        run, f"chat_id {kind}, chunk bigint, after_message_index bigint, reason string, confidence double")
    # What the detector told is compared with itself, so it is kept: each chunk is shown once.
    return reconciled_boundaries(settle(found, "boundaries"), chunk_size, overlap, tolerance)
