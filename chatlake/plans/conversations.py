"""Conversation detection over every chat at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from chatlake.functions.records import parse_boundaries
from chatlake.operators import conversations as CV
from chatlake.operators.chats import in_chats


def chat_rows(messages: DataFrame, chat_messages: DataFrame) -> DataFrame:
    """Lake messages in the shape the conversation operators read."""
    return in_chats(messages, chat_messages)


def detect_conversations(messages: DataFrame, detector: Callable[[DataFrame], DataFrame] | None = None,
                         gap_hours: float = CV.GAP_HOURS, min_messages: int = CV.MIN_MESSAGES) -> DataFrame:
    """Conversations of every chat: by time gap, or by a detector.

    ``detector`` takes the messages and returns (chat_id, after_message_index);
    one that returns no rows leaves each chat whole.
    """
    if detector is None:
        return CV.conversations(messages, gap_hours, min_messages)
    return CV.conversations_from_boundaries(messages, detector(messages), min_messages)


def boundaries_from_answers(answers: DataFrame) -> DataFrame:
    """Boundaries of a table of answers (chat_id, chunk_start, answer) to the chunk prompts."""
    parsed = answers.select("chat_id", "chunk_start", parse_boundaries(F.col("answer")).alias("boundaries"))
    return CV.shift_boundaries(parsed)


def reconciled_answers(answers: DataFrame, chunk_size: int = CV.CHUNK_SIZE, overlap: int = CV.OVERLAP,
                       tolerance: int = CV.TOLERANCE) -> DataFrame:
    """As ``boundaries_from_answers``, with one boundary where two overlapping chunks answered with one each."""
    parsed = answers.select("chat_id", "chunk_start", F.explode(parse_boundaries(F.col("answer"))).alias("b"))
    found = parsed.select(
        "chat_id", F.floor(F.col("chunk_start") / (chunk_size - overlap)).alias("chunk"),
        (F.col("b.after_message_index") + F.col("chunk_start")).alias("after_message_index"), "b.reason", "b.confidence")
    return CV.reconciled_boundaries(found, chunk_size, overlap, tolerance)
