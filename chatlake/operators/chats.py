"""Chats, their members, names and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chatlake.functions.text import not_blank, present, strip
from chatlake.operators.contacts import one_user_per_handle
from chatlake.operators.keys import drop_keys, keep_keys
from chatlake.operators.lookups import chats_with_users
from chatlake.operators.sequences import PART_ROWS, top_n_per_group


def chat_users_build(chat_handle_join: DataFrame, users: DataFrame) -> DataFrame:
    """Members of each chat; unmapped handles and handle 0 are dropped."""
    linked = users.where("handle_id <> 0").groupBy("handle_id").agg(F.min("user_id").alias("user_id"))
    return chat_handle_join.join(linked, "handle_id").select("chat_id", "user_id").distinct()


def chat_handles_named(chat_handle_join: DataFrame, handle: DataFrame) -> DataFrame:
    return chat_handle_join.join(handle.select("handle_id", F.col("id").alias("handle_identifier")), "handle_id").select(
        "chat_id", "handle_id", "handle_identifier")


def chats_with_members(chats: DataFrame, chat_users: DataFrame) -> DataFrame:
    return keep_keys(chats, chat_users, ["chat_id"])


def chats_without_members(chats: DataFrame, chat_users: DataFrame) -> DataFrame:
    return drop_keys(chats, chat_users, ["chat_id"])


# Histories.

def in_chats(messages: DataFrame, chat_messages: DataFrame) -> DataFrame:
    return messages.join(chat_messages, "message_id").select(
        "chat_id", "message_id", "user_id", "contents", "is_from_me", "created_at", "message_date")


def messages_in_chat(messages: DataFrame, chat_messages: DataFrame, chat_id: int, limit: int | None = None) -> DataFrame:
    rows = in_chats(messages, chat_messages.where(F.col("chat_id") == chat_id))
    rows = rows.orderBy(F.desc("message_date"), F.desc("message_id"))
    return rows.limit(limit) if limit else rows


def newest_per_chat(messages: DataFrame, chat_messages: DataFrame, limit: int) -> DataFrame:
    """``messages_in_chat`` with a limit, for every chat at once."""
    # Pick the rows on the narrow junction table, then fetch only those messages.
    newest = top_n_per_group(chat_messages, ["chat_id"], [F.desc("message_date"), F.desc("message_id")], limit)
    return in_chats(messages, newest)


def chat_history(messages: DataFrame, chat_messages: DataFrame, chat_id: int | str | None = None) -> DataFrame:
    """Contents, direction and time, oldest first; all chats when no chat is named."""
    if chat_id is not None:
        chat_messages = chat_messages.where(F.col("chat_id") == int(chat_id))
    ordered = in_chats(messages, chat_messages).orderBy("chat_id", "message_date", "message_id")
    return ordered.select("chat_id", "message_id", "contents", "is_from_me", "created_at")


def chats_for_messages(chats: DataFrame, chat_messages: DataFrame, wanted: DataFrame) -> DataFrame:
    return keep_keys(chat_messages, wanted.toDF("message_id"), ["message_id"]).join(chats, "chat_id").select(
        "message_id", "chat_id", "display_name", "message_date")


def chats_for_users(chats: DataFrame, chat_users: DataFrame, wanted: DataFrame) -> DataFrame:
    """The chats of each wanted user with their member counts.

    Member lists are not repeated per user: that would be every pair of members.
    ``chats_with_users`` has each list once.
    """
    mine = keep_keys(chat_users, wanted.toDF("user_id"), ["user_id"])
    sizes = chat_users.groupBy("chat_id").agg(F.count(F.lit(1)).alias("members"))
    return mine.join(chats.join(sizes, "chat_id"), "chat_id").select("user_id", "chat_id", "display_name", "members")


def chats_for_user(chats: DataFrame, chat_users: DataFrame, user_ids: str | list[str],
                   part_rows: int = PART_ROWS) -> DataFrame:
    """The chats of one user, or of some, each once with its full sorted member list, ``part_rows`` to a row."""
    wanted = [user_ids] if isinstance(user_ids, str) else list(user_ids)
    mine = chat_users.where(F.col("user_id").isin(wanted))
    return chats_with_users(keep_keys(chats, mine, ["chat_id"]), keep_keys(chat_users, mine, ["chat_id"]), part_rows)


def chat_users_details(chat_users: DataFrame, users: DataFrame) -> DataFrame:
    details = chat_users.join(users, "user_id")
    return details.select(
        "chat_id", "user_id", "first_name", "last_name", "phone_number", "email", "handle_id"
    ).orderBy("chat_id", "first_name", "last_name", "user_id")


# Counts and choice by name.

def message_counts(chats: DataFrame, chat_messages: DataFrame) -> DataFrame:
    counts = chat_messages.groupBy("chat_id").agg(F.count("message_id").alias("message_count"))
    return chats.join(counts, "chat_id", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)))


def chats_by_display_name(chats: DataFrame, chat_messages: DataFrame, name: str | None = None) -> DataFrame:
    """Chats of a name (or of every name), busiest first."""
    wanted = chats if name is None else chats.where(F.col("display_name") == name)
    return message_counts(wanted, chat_messages).orderBy("display_name", F.desc("message_count"), "chat_id")


def busiest_chats(chat_messages: DataFrame, at_least: int) -> DataFrame:
    counts = chat_messages.groupBy("chat_id").agg(F.count(F.lit(1)).alias("message_count"))
    return counts.where(F.col("message_count") >= at_least).orderBy(F.desc("message_count"), "chat_id")


def best_chat_for_name(chats: DataFrame, chat_messages: DataFrame, chat_users: DataFrame) -> DataFrame:
    """Per name the busiest chat (lowest id on a tie) and its first user."""
    first_user = chat_users.groupBy("chat_id").agg(F.min("user_id").alias("user_id"))
    best = message_counts(chats, chat_messages).groupBy("display_name").agg(
        F.min(F.struct((-F.col("message_count")).alias("order"), "chat_id")).alias("_best"))
    picked = best.select("display_name", "_best.chat_id", (-F.col("_best.order")).alias("message_count"))
    return picked.join(first_user, "chat_id", "left").select(
        "display_name", "chat_id", "user_id", "message_count",
        F.when(F.col("user_id").isNull(), "no_users").otherwise("ok").alias("status"))


# Display names.

MAX_NAME_PARTS = 3


def generated_names(chats: DataFrame, chat_handle_join: DataFrame, handle: DataFrame, users: DataFrame) -> DataFrame:
    """A name per chat from up to three members: known people first, then bare handles."""
    members = chat_handles_named(chat_handle_join, handle).join(one_user_per_handle(users), "handle_id", "left")
    first, last = F.col("first_name"), F.col("last_name")
    both = present(first) & present(last)
    person = strip(F.concat(first, F.lit(" "), last))
    known = (
        F.when(both, F.nullif(person, F.lit("")))
        .when(not_blank(F.col("phone_number")), strip(F.col("phone_number")))
        .when(not_blank(F.col("email")), strip(F.col("email")))
    )
    parts = members.select(
        "chat_id", "handle_id", known.isNull().cast("int").alias("bare"),
        F.coalesce(known, F.col("handle_identifier")).alias("label"),
    )
    shown = top_n_per_group(parts, ["chat_id"], [F.col("bare"), F.col("handle_id")], MAX_NAME_PARTS)
    names = shown.groupBy("chat_id").agg(
        F.array_sort(F.collect_list(F.struct("bare", "handle_id", "label"))).alias("_shown"))
    sizes = members.groupBy("chat_id").agg(F.count(F.lit(1)).alias("_members"))
    joined = F.array_join(F.transform("_shown", lambda p: p["label"]), ", ")
    more = F.when(F.col("_members") > F.size("_shown"), F.lit("...")).otherwise(F.lit(""))
    generated = names.join(sizes, "chat_id").select("chat_id", F.concat(joined, more).alias("_name"))
    fallback = F.concat(F.lit("Chat "), F.col("chat_id").cast("string"))
    return chats.select("chat_id").join(generated, "chat_id", "left").select(
        "chat_id", F.coalesce("_name", fallback).alias("generated_name"))


def _needs_name(name: Column) -> Column:
    return ~not_blank(name) | name.startswith("Chat ")


def enhance_display_names(chats: DataFrame, chat_handle_join: DataFrame, handle: DataFrame, users: DataFrame) -> DataFrame:
    """Chats with generated names where theirs is blank or a placeholder; ``outcome`` says what happened."""
    names = generated_names(chats, chat_handle_join, handle, users)
    name, new = F.col("display_name"), F.col("generated_name")
    better = _needs_name(name) & ~name.eqNullSafe(new) & ~new.startswith("Chat ")
    outcome = F.when(better, "updated").when(_needs_name(name), "skipped").otherwise("kept")
    return chats.join(names, "chat_id").select(
        "chat_id", F.when(better, new).otherwise(name).alias("display_name"), outcome.alias("outcome"))


def display_name_stats(enhanced: DataFrame) -> DataFrame:
    return enhanced.agg(
        F.count_if(F.col("outcome") != "kept").alias("chats_checked"),
        F.count_if(F.col("outcome") == "updated").alias("chats_updated"),
        F.count_if(F.col("outcome") == "skipped").alias("chats_skipped"),
    )


def chat_users_stats(chat_handle_join: DataFrame, users: DataFrame, chats: DataFrame) -> DataFrame:
    linked = users.where("handle_id <> 0").select("handle_id")
    mapped = keep_keys(chat_handle_join, linked, ["handle_id"])
    built = chat_users_build(chat_handle_join, users)

    def count(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1))).scalar()

    return chat_handle_join.agg(F.count(F.lit(1)).alias("total_relationships_found")).select(
        "total_relationships_found", count(mapped).alias("relationships_mapped"),
        count(built).alias("relationships_created"), count(chats_with_members(chats, built)).alias("chats_with_users"),
        count(chats_without_members(chats, built)).alias("chats_without_users"),
    )


def chat_samples(chats: DataFrame, chat_users: DataFrame, users: DataFrame, limit: int = 5) -> DataFrame:
    """Member details of the first chats by id, one row per member."""
    first = chats.orderBy("chat_id").limit(limit)
    members = chat_users.join(users, "user_id").select(
        "chat_id", "user_id", F.concat("first_name", F.lit(" "), "last_name").alias("name"),
        F.col("phone_number").alias("phone"), "email")
    return first.join(members, "chat_id", "left")
