"""Build the lake from the source tables."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chatlake import schemas
from chatlake.operators import chats as CH, contacts as CT, messages as M, quality as Q
from chatlake.session import scratch_path
from chatlake.sources import readers as R, sinks as S


@dataclass
class Sources:
    message: DataFrame
    handle: DataFrame
    chat: DataFrame
    chat_message_join: DataFrame
    chat_handle_join: DataFrame
    record: DataFrame
    phone: DataFrame
    email: DataFrame


@dataclass
class Lake:
    users: DataFrame
    chats: DataFrame
    chat_users: DataFrame
    messages: DataFrame
    chat_messages: DataFrame


TABLES = {
    "users": schemas.USERS, "chats": schemas.CHATS, "chat_users": schemas.CHAT_USERS,
    "messages": schemas.MESSAGES, "chat_messages": schemas.CHAT_MESSAGES,
}


def contacts_of(src: Sources) -> DataFrame:
    return CT.extract_contacts(src.record, src.phone, src.email)


def plan_lake(src: Sources, as_of: Column | None = None) -> Lake:
    """The lake tables as plans; nothing runs yet."""
    users = CT.build_users(src.handle, contacts_of(src))
    chats = R.scan_chats(src.chat)
    named = CH.enhance_display_names(chats, src.chat_handle_join, src.handle, users)
    return Lake(
        users=users,
        chats=named.select("chat_id", "display_name"),
        chat_users=CH.chat_users_build(src.chat_handle_join, users),
        messages=M.normalize_messages(src.message, users, as_of),
        chat_messages=R.scan_chat_messages(src.chat_message_join, as_of),
    )


def read_lake(spark: SparkSession, root: str) -> Lake:
    return Lake(**{name: spark.read.schema(schema).parquet(f"{root}/{name}") for name, schema in TABLES.items()})


def build_lake(src: Sources, root: str | None = None, as_of: Column | None = None) -> Lake:
    """Write every lake table once, in order of need; later tables read the written users."""
    spark = src.message.sparkSession
    root = root or scratch_path(spark, "lake")
    S.overwrite(CT.build_users(src.handle, contacts_of(src)), f"{root}/users")
    users = spark.read.schema(schemas.USERS).parquet(f"{root}/users")
    chats = R.scan_chats(src.chat)
    named = CH.enhance_display_names(chats, src.chat_handle_join, src.handle, users)
    S.overwrite(named.select("chat_id", "display_name"), f"{root}/chats")
    S.overwrite(CH.chat_users_build(src.chat_handle_join, users), f"{root}/chat_users")
    S.overwrite(M.normalize_messages(src.message, users, as_of), f"{root}/messages")
    S.overwrite(R.scan_chat_messages(src.chat_message_join, as_of), f"{root}/chat_messages")
    return read_lake(spark, root)


def bucket_messages(lake: Lake, root: str, buckets: int, prefix: str = "lake") -> Lake:
    """The lake with messages and their chat links bucketed by message, for histories without a shuffle.

    ``buckets`` should give files of a few hundred megabytes.
    """
    messages = S.save_bucketed(lake.messages, f"{prefix}_messages", f"{root}/messages_bucketed", "message_id", buckets)
    links = S.save_bucketed(lake.chat_messages, f"{prefix}_chat_messages", f"{root}/chat_messages_bucketed", "message_id", buckets)
    return replace(lake, messages=messages, chat_messages=links)


def lake_report(lake: Lake) -> DataFrame:
    """Row count per lake table."""
    counts = None
    for f in fields(lake):
        one = getattr(lake, f.name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(f.name).alias("table_name"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def build_report(src: Sources, lake: Lake) -> DataFrame:
    """Migrated rows and coverage of one build."""
    coverage = Q.migration_coverage(src.message, lake.messages)
    return coverage.select(
        "*", Q.rows_of(lake.chats).alias("chats_migrated"),
        Q.rows_of(lake.chat_messages).alias("chat_messages_migrated"),
        Q.rows_of(lake.chat_users).alias("relationships_created"))
