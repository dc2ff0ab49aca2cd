"""Source tables with explicit schemas, and the shapes the lake is built from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from chatlake.functions.body import with_best_text
from chatlake.functions.text import not_blank, text_source
from chatlake.functions.time import apple_ts
from chatlake.operators.lookups import limited


def read_table(spark: SparkSession, path: str | list[str], schema: T.StructType, fmt: str = "parquet",
               **options) -> DataFrame:
    """One table from one or many paths; unreadable files are skipped when asked for."""
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


def read_sources(spark: SparkSession, paths: list[str], schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """All copies of one address-book table, tagged with the folder they came from."""
    body = T.StructType([f for f in schema.fields if f.name != "source"])
    rows = read_table(spark, paths, body, fmt, ignoreCorruptFiles="true")
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return rows.select(folder.alias("source"), *body.fieldNames())


def scan_messages(message: DataFrame, limit: int | None = None) -> DataFrame:
    """The message log with the best text of each row and where it came from, newest first."""
    text, body = F.col("text"), F.col("attributed_body")
    rows = message if not limit else limited(message.orderBy(F.desc("date"), F.desc("rowid")), limit)
    return with_best_text(rows, "extracted_text").select(
        "rowid", "guid", "text", "extracted_text", "handle_id", "date", "date_read",
        F.coalesce(F.col("is_from_me") != 0, F.lit(False)).alias("is_from_me"), "service",
        body.isNotNull().alias("has_attributed_body"),
        text_source(text, body, F.col("extracted_text")).alias("text_source"),
    )


def scan_handles(handle: DataFrame) -> DataFrame:
    return handle.select("handle_id", "id").orderBy("handle_id")


def scan_chats(chat: DataFrame) -> DataFrame:
    """Chats; a blank name becomes ``Chat {id}``."""
    fallback = F.concat(F.lit("Chat "), F.col("chat_id").cast("string"))
    name = F.when(not_blank(F.col("display_name")), F.col("display_name")).otherwise(fallback)
    return chat.select("chat_id", name.alias("display_name"))


def scan_chat_messages(chat_message_join: DataFrame, as_of: Column | None = None) -> DataFrame:
    return chat_message_join.select(
        "chat_id", "message_id", apple_ts(F.col("message_date"), as_of).alias("message_date")
    )


def scan_chat_handles(chat_handle_join: DataFrame) -> DataFrame:
    return chat_handle_join.select("chat_id", "handle_id")


def scan_accounts(account: DataFrame) -> DataFrame:
    return account.select("account_type", "display_name", "external_identifier")


def message_view(messages: DataFrame) -> DataFrame:
    """Lake messages under the source's column names."""
    return messages.select(
        F.col("message_id").alias("rowid"), "message_id", "user_id", F.col("contents").alias("text"),
        F.lit(None).cast("binary").alias("attributed_body"), F.lit(0).cast("bigint").alias("handle_id"),
        F.col("created_at").alias("date"), F.lit(None).cast("bigint").alias("date_read"), "is_from_me",
        F.lit("iMessage").alias("service"), F.lit(None).cast("string").alias("guid"),
    )
