"""Source messages to lake messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chatlake.functions.body import with_best_text
from chatlake.functions.time import apple_ts
from chatlake.operators.contacts import contact_lookup, lookup_cascade
from chatlake.operators.keys import drop_keys, keep_keys
from chatlake.operators.lookups import drop_blank, drop_system_rows, has_body, limited, with_handle

MESSAGE_COLUMNS = ["message_id", "user_id", "contents", "is_from_me", "created_at"]


def message_handle_left(message: DataFrame, handle: DataFrame) -> DataFrame:
    return with_handle(message, handle).select(
        F.col("rowid").alias("message_id"), "text", "attributed_body", "handle_id", "is_from_me", "date",
        F.col("handle").alias("handle_identifier"),
    )


def _with_user(message: DataFrame, users: DataFrame) -> DataFrame:
    linked = users.where("handle_id IS NOT NULL").groupBy(F.col("handle_id").alias("_h")).agg(
        F.min("user_id").alias("_user"))
    return message.join(linked, message["handle_id"] == linked["_h"], "left")


def map_message_user(message: DataFrame, users: DataFrame) -> DataFrame:
    """Add the user of each row's handle, or a name made of the unknown handle."""
    unknown = F.concat(F.lit("unknown_user_"), F.coalesce(F.col("handle_id").cast("string"), F.lit("none")))
    mapped = _with_user(message, users).withColumn("user_id", F.coalesce("_user", unknown))
    return mapped.drop("_h", "_user")


def _lake_columns(as_of: Column | None) -> list[Column]:
    return [
        F.col("rowid").alias("message_id"), F.col("user_id"), F.col("contents"),
        F.coalesce(F.col("is_from_me") != 0, F.lit(False)).alias("is_from_me"),
        apple_ts(F.col("date"), as_of).alias("created_at"),
    ]


def normalize_messages(message: DataFrame, users: DataFrame, as_of: Column | None = None,
                       limit: int | None = None) -> DataFrame:
    """Lake messages of the whole log; rows without a known user keep a placeholder."""
    rows = has_body(message)
    rows = limited(rows.orderBy(F.desc("date"), F.desc("rowid")), limit) if limit else rows
    rows = drop_blank(with_best_text(rows, "contents"))
    return map_message_user(rows, users).select(_lake_columns(as_of))


def normalize_increment(message: DataFrame, users: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Lake messages of an increment; system rows and rows without a user are dropped."""
    return recovered_increment(with_best_text(drop_system_rows(message), "contents"), users, as_of)


def recovered_increment(recovered: DataFrame, users: DataFrame, as_of: Column | None = None) -> DataFrame:
    """``normalize_increment`` for rows whose text is already in ``contents``."""
    rows = drop_blank(drop_system_rows(recovered))
    known = _with_user(rows, users).where("_user IS NOT NULL").withColumn("user_id", F.col("_user"))
    return known.select(_lake_columns(as_of))


def incremental_sync(message: DataFrame, users: DataFrame, mark: int, limit: int | None = None,
                     as_of: Column | None = None) -> DataFrame:
    """One increment above ``mark``; ``next_mark`` is the largest id read, skipped rows included."""
    above = message.where(F.col("rowid") > mark)
    if limit:
        above = above.orderBy("rowid").limit(limit)
    next_mark = above.agg(F.max("rowid")).scalar()
    return normalize_increment(above, users, as_of).withColumn("next_mark", next_mark)


def wide_messages(message: DataFrame, handle: DataFrame, record: DataFrame, phone: DataFrame, email: DataFrame,
                  limit: int | None = None) -> DataFrame:
    """Every message with its handle and the contact's name."""
    rows = limited(message.orderBy(F.desc("date"), F.desc("rowid")), limit) if limit else message
    # Names are looked up once per handle, not once per message.
    named_handles = lookup_cascade(handle, contact_lookup(record, phone, email)).select(
        F.col("handle_id").alias("_h"), F.col("id").alias("contact_id"), F.col("id").alias("phone_email"),
        "country", F.col("service").alias("service_type"),
        "contact_first_name", "contact_last_name", "contact_full_name",
    )
    joined = rows.join(named_handles, rows["handle_id"] == named_handles["_h"], "left")
    return joined.select(
        F.col("rowid").alias("message_id"), "guid", "text", "date", "date_read", "date_delivered", "is_from_me",
        "is_read", "is_delivered", "is_sent", "service", "account", "error", "handle_id", "contact_id",
        "phone_email", "country", "service_type", "contact_first_name", "contact_last_name", "contact_full_name",
    )


def active_contacts(message: DataFrame, handle: DataFrame) -> DataFrame:
    """Identifiers that have a message, sorted."""
    return keep_keys(handle, message, ["handle_id"]).select("id").distinct().orderBy("id")


def chat_transcript(messages: DataFrame, users: DataFrame, chat_messages: DataFrame) -> DataFrame:
    names = users.select("user_id", "first_name", "last_name")
    return messages.join(chat_messages, "message_id").join(names, "user_id").select(
        "chat_id", "message_id", "first_name", "last_name", "contents", "is_from_me", "created_at")


def orphan_messages(messages: DataFrame, users: DataFrame) -> DataFrame:
    return drop_keys(messages, users, ["user_id"]).select(MESSAGE_COLUMNS)
