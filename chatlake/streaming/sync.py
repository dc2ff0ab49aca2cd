"""Incremental sync of a growing source log into the lake.

The stream's checkpoint knows which files were read; ids may arrive in any order.
Every batch writes into its own folders with overwrite, so a replayed batch replaces
itself. Rows that earlier batches stored, or hold as pending, are recognised by id and
not stored again. Rows whose handle is not known yet wait in ``pending``; every batch
tries them again with the handles and contacts as they are then.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from chatlake import schemas
from chatlake.functions.body import with_best_text
from chatlake.operators.contacts import resolve_handle_ids
from chatlake.operators.keys import drop_keys
from chatlake.operators.lookups import drop_blank, drop_system_rows
from chatlake.operators.messages import recovered_increment
from chatlake.operators.quality import notification_rows

BatchHook = Callable[[DataFrame, int], None]
# A table, or how to read it anew: a table that grows must be read by every batch.
Reader = DataFrame | Callable[[], DataFrame]
# Files of one batch unless the caller says otherwise, so that a first run is no single batch.
FILES_PER_BATCH = 1000


def _read(table: Reader) -> DataFrame:
    return table() if callable(table) else table


@dataclass
class SyncTarget:
    """Folders of the tables one sync keeps current."""

    root: str
    tables: dict = field(default_factory=lambda: {
        "messages": schemas.MESSAGES, "users": schemas.USERS, "pending": schemas.PENDING,
        "progress": schemas.SYNC_PROGRESS})

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read(self, spark: SparkSession, table: str, before_batch: int | None = None) -> DataFrame:
        """A synced table; ``before_batch`` leaves out that batch and later ones."""
        schema = self.tables[table]
        if not _exists(spark, self.path(table)):
            return spark.createDataFrame([], schema)
        stored = [f for f in schema.fields if f.name != "batch_id"]
        partitioned = T.StructType(stored).add("batch_id", T.LongType())
        rows = spark.read.schema(partitioned).parquet(self.path(table))
        if before_batch is not None:
            rows = rows.where(F.col("batch_id") < before_batch)
        return rows.select(schema.fieldNames())

    def read_batch(self, spark: SparkSession, table: str, batch_id: int) -> DataFrame:
        """What one batch wrote; empty if there is no such batch."""
        path, schema = f"{self.path(table)}/batch_id={batch_id}", self.tables[table]
        return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)

    def write_batch(self, df: DataFrame, table: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path(table)}/batch_id={batch_id}")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def sync_state(spark: SparkSession, target: SyncTarget) -> DataFrame:
    """Latest mark and status with cumulative counts, from the progress table."""
    progress = target.read(spark, "progress")
    return progress.agg(
        F.max("last_rowid").alias("last_processed_rowid"), F.max("synced_at").alias("last_sync_timestamp"),
        F.coalesce(F.sum("rows_synced"), F.lit(0)).alias("total_messages_processed"),
        F.coalesce(F.max_by("sync_status", "batch_id"), F.lit("idle")).alias("sync_status"),
        F.min("synced_at").alias("created_at"), F.max("synced_at").alias("updated_at"))


def notify_rows(users: DataFrame, shown: int = 5) -> Callable[[DataFrame], DataFrame]:
    """Default notification: the first new rows as a table."""
    return lambda new_rows: notification_rows(new_rows, users, shown)


def _record(spark: SparkSession, target: SyncTarget, batch_id: int, read: int, synced: int, last: int | None) -> None:
    progress = spark.range(1).select(
        F.lit(read).cast("bigint").alias("rows_read"), F.lit(synced).cast("bigint").alias("rows_synced"),
        F.lit(last).cast("bigint").alias("last_rowid"), F.lit("idle").alias("sync_status"),
        F.current_timestamp().alias("synced_at"))
    target.write_batch(progress.coalesce(1), "progress", batch_id)


def _unseen(rows: DataFrame, target: SyncTarget, waiting: DataFrame, batch_id: int, low: int, high: int) -> DataFrame:
    """Rows that no earlier batch stored or holds; stored ids outside the range of the batch are not read."""
    stored = target.read(rows.sparkSession, "messages", batch_id).select(F.col("message_id").alias("rowid"))
    seen = stored.unionByName(waiting.select("rowid"))
    return drop_keys(rows, seen.where(F.col("rowid").between(low, high)), ["rowid"])


def sync_batch(batch: DataFrame, batch_id: int, target: SyncTarget, handle: Reader, contacts: Reader,
               base_users: DataFrame, as_of: Column | None = None, start_at: int | None = None,
               on_new_messages: BatchHook | None = None) -> None:
    """Apply one batch: leave out what is stored, create users, write messages and what must wait.

    ``start_at`` leaves out ids up to it, for a caller who wants no backlog. The messages
    written are those of the batch and those that waited for their handle until now.
    """
    spark = batch.sparkSession
    rows = batch if start_at is None else batch.where(F.col("rowid") > start_at)
    rows = with_best_text(rows, "contents").select(schemas.PENDING.fieldNames()).dropDuplicates(["rowid"]).persist()
    waiting = target.read_batch(spark, "pending", batch_id - 1)
    try:
        read, low, last = rows.agg(F.count(F.lit(1)), F.min("rowid"), F.max("rowid")).first()
        new = _unseen(rows, target, waiting, batch_id, low, last) if read else rows
        open_rows = drop_blank(drop_system_rows(new.unionByName(waiting)))
        known = base_users.unionByName(target.read(spark, "users", batch_id))
        linked = known.where("handle_id IS NOT NULL")
        new_ids = drop_keys(open_rows.select("handle_id").distinct(), linked, ["handle_id"])
        # Most batches bring no new handle; those never touch the contacts.
        if not new_ids.isEmpty():
            created = resolve_handle_ids(new_ids, _read(handle), _read(contacts)).select(schemas.USERS.fieldNames())
            target.write_batch(created, "users", batch_id)
            known = known.unionByName(target.read_batch(spark, "users", batch_id))
        target.write_batch(recovered_increment(open_rows, known, as_of), "messages", batch_id)
        unknown = drop_keys(open_rows, known.where("handle_id IS NOT NULL"), ["handle_id"])
        target.write_batch(unknown, "pending", batch_id)
        # Counted from the footers of the files just written.
        synced = target.read_batch(spark, "messages", batch_id).count()
        _record(spark, target, batch_id, read, synced, last)
        if on_new_messages is not None and read:
            try:
                on_new_messages(new.withColumnRenamed("contents", "extracted_text"), synced)
            except Exception as error:  # a failing hook must not fail the batch
                print(f"new-message hook failed: {error}")
    finally:
        rows.unpersist()


def latest_rowid(message: DataFrame) -> int:
    """Where to start when the backlog is to be skipped."""
    return message.agg(F.max("rowid")).first()[0] or 0


def start_sync(spark: SparkSession, source: str, target: SyncTarget, handle: Reader, contacts: Reader,
               base_users: DataFrame | None = None, interval: str | None = None, max_files: int = FILES_PER_BATCH,
               start_at: int | None = None, as_of: Column | None = None, on_new_messages: BatchHook | None = None,
               path_filter: str = "*.parquet", transform: Callable[[DataFrame], DataFrame] | None = None,
               source_schema=None) -> StreamingQuery:
    """Follow a folder of message files; once through what is there, or every ``interval``.

    ``handle`` and ``contacts`` are tables, or functions that read them; a function is
    called by every batch and so sees what was added. The checkpoint lives beside the
    tables: batch numbers name their folders, so a target must never be followed with
    another checkpoint.
    """
    reader = spark.readStream.schema(source_schema or schemas.MESSAGE).option("pathGlobFilter", path_filter)
    rows = reader.option("maxFilesPerTrigger", max_files).parquet(source)
    rows = transform(rows) if transform else rows
    users = base_users if base_users is not None else spark.createDataFrame([], schemas.USERS)

    def apply(batch: DataFrame, batch_id: int) -> None:
        sync_batch(batch, batch_id, target, handle, contacts, users, as_of, start_at, on_new_messages)

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    checkpoint = target.path("checkpoint")
    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**trigger).start()
