"""Projections, filters, lookups and newest-first lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chatlake.functions import text as X
from chatlake.functions.time import apple_ts, to_apple
from chatlake.operators.keys import keep_keys
from chatlake.operators.sequences import PART_ROWS, collect_parts, top_n_per_group

USER_COLUMNS = ["user_id", "first_name", "last_name", "phone_number", "email", "handle_id"]


def limited(df: DataFrame, limit: int | None) -> DataFrame:
    """None and 0 mean no limit."""
    return df.limit(limit) if limit else df


# Users. Each takes a table of wanted keys; ``wanted`` has one column.

def _matching(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    return keep_keys(df, wanted.toDF(column), [column]).select(df.columns)


def users_by_id(users: DataFrame, wanted: DataFrame) -> DataFrame:
    return _matching(users, "user_id", wanted)


def users_by_phone(users: DataFrame, wanted: DataFrame) -> DataFrame:
    """Exact spelling."""
    return _matching(users, "phone_number", wanted)


def users_by_email(users: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted address is lower-cased, the stored one is not."""
    return _matching(users, "email", wanted.toDF("e").select(F.lower("e")))


def users_by_handle(users: DataFrame, wanted: DataFrame) -> DataFrame:
    return _matching(users, "handle_id", wanted)


def all_users(users: DataFrame, limit: int | None = None) -> DataFrame:
    return limited(users.select(USER_COLUMNS), limit)


# Messages of the lake.

def newest_first() -> list[Column]:
    return [F.col("created_at").desc(), F.col("message_id").desc()]


def messages_by_id(messages: DataFrame, wanted: DataFrame) -> DataFrame:
    return _matching(messages, "message_id", wanted)


def messages_by_user(messages: DataFrame, user_id: str, limit: int | None = None) -> DataFrame:
    return limited(messages.where(F.col("user_id") == user_id).orderBy(*newest_first()), limit)


def newest_per_user(messages: DataFrame, limit: int) -> DataFrame:
    """``messages_by_user`` for every user at once."""
    return top_n_per_group(messages, ["user_id"], newest_first(), limit, "position")


def all_messages(messages: DataFrame, limit: int | None = None) -> DataFrame:
    return limited(messages.orderBy(*newest_first()), limit)


def created_after(messages: DataFrame, instant: str) -> DataFrame:
    return messages.where(F.col("created_at") > F.lit(instant).cast("timestamp"))


# Messages of the source.

def with_handle(message: DataFrame, handle: DataFrame) -> DataFrame:
    """Source messages with the identifier of their handle, NULL when there is none."""
    ids = handle.select(F.col("handle_id").alias("_h"), F.col("id").alias("handle"))
    return message.join(ids, message["handle_id"] == ids["_h"], "left").drop("_h")


def _listed(df: DataFrame) -> DataFrame:
    return df.select(
        "rowid", "guid", "handle", "text", *[apple_ts(F.col(c)).alias(c) for c in
                                             ("date", "date_read", "date_delivered")],
        (F.col("is_from_me") != 0).alias("is_from_me"), "service",
    )


def recent_messages(message: DataFrame, handle: DataFrame, limit: int = 10, include_sent: bool = True,
                    include_received: bool = True) -> DataFrame:
    wanted = F.lit(include_sent and include_received)
    if include_sent != include_received:
        wanted = (F.col("is_from_me") != 0) if include_sent else (F.col("is_from_me") == 0)
    newest = message.where(wanted).orderBy(F.desc("date"), F.desc("rowid")).limit(limit)
    return _listed(with_handle(newest, handle))


def search_messages(message: DataFrame, handle: DataFrame, term: str, limit: int = 100) -> DataFrame:
    hits = message.where(X.contains_term(F.col("text"), term))
    return _listed(with_handle(hits.orderBy(F.desc("date"), F.desc("rowid")).limit(limit), handle))


def search_any_term(message: DataFrame, terms: list[str]) -> DataFrame:
    """One row per message and matching term."""
    hits = F.array_compact(F.array(*[F.when(X.contains_term(F.col("text"), t), F.lit(t)) for t in terms]))
    return message.withColumn("term", F.explode(hits))


def contact_conversation(message: DataFrame, handle: DataFrame, identifier: str, limit: int = 50) -> DataFrame:
    """The last messages with one handle, oldest first."""
    wanted = handle.where(F.col("id") == identifier).select(F.col("handle_id").alias("_h"), F.col("id").alias("handle"))
    mine = message.join(wanted, message["handle_id"] == wanted["_h"]).drop("_h")
    newest = mine.orderBy(F.desc("date"), F.desc("rowid")).limit(limit)
    return _listed(newest).orderBy("date", "rowid")


def contact_conversations(message: DataFrame, handle: DataFrame, limit: int = 50) -> DataFrame:
    """``contact_conversation`` for every handle at once."""
    matched = with_handle(message, handle).where("handle IS NOT NULL")
    newest = top_n_per_group(matched, ["handle"], [F.desc("date"), F.desc("rowid")], limit)
    return _listed(newest)


def has_body(message: DataFrame) -> DataFrame:
    return message.where("text IS NOT NULL OR attributed_body IS NOT NULL")


def needs_recovery(message: DataFrame) -> DataFrame:
    """Blank text, a body, and nothing extracted yet."""
    return message.where(
        ~X.present(F.col("text")) & F.col("attributed_body").isNotNull() & ~X.present(F.col("extracted_text"))
    )


def drop_system_rows(message: DataFrame) -> DataFrame:
    return message.where(F.coalesce("handle_id", F.lit(0)) != 0)


def drop_blank(df: DataFrame, column: str = "contents") -> DataFrame:
    return df.where(X.not_blank(F.col(column)))


def recent_since(message: DataFrame, as_of: str, minutes: int, limit: int = 100) -> DataFrame:
    """Rows dated within ``minutes`` before ``as_of``, newest ids first, with a text preview."""
    cutoff = F.lit(as_of).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes))
    recent = message.where(F.col("date") > to_apple(cutoff)).orderBy(F.desc("rowid")).limit(limit)
    return recent.select(
        "rowid", F.left(F.coalesce("text", F.lit("")), F.lit(100)).alias("text"),
        apple_ts(F.col("date")).alias("timestamp"), (F.col("is_from_me") != 0).alias("is_from_me"), "handle_id",
    )


def topk_newest(message: DataFrame, limit: int) -> DataFrame:
    return message.orderBy(F.desc("date"), F.desc("rowid")).limit(limit)


def topk_then_asc(messages: DataFrame, limit: int) -> DataFrame:
    return messages.orderBy(*newest_first()).limit(limit).orderBy("created_at", "message_id")


def bounded_increment(message: DataFrame, mark: int, limit: int | None) -> DataFrame:
    return limited(message.where(F.col("rowid") > mark).orderBy("rowid"), limit)


# Chats.

def chats_with_users(chats: DataFrame, chat_users: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Every chat with its sorted user ids; a chat of more than ``part_rows`` users has numbered parts."""
    lists = collect_parts(chat_users, ["chat_id"], ["user_id"], F.col("user_id"), "user_ids", part_rows)
    return chats.join(lists, "chat_id", "left").select(
        "chat_id", "display_name", F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce("user_ids", F.array().cast("array<string>")).alias("user_ids"),
    )


def chat_by_id(chats: DataFrame, chat_users: DataFrame, wanted: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    return chats_with_users(
        _matching(chats, "chat_id", wanted), _matching(chat_users, "chat_id", wanted), part_rows)
