"""Keyed writes over plain Parquet tables.

Each function returns the rows to write; ``overwrite``/``append``/``publish`` do
the writing. A table is never overwritten while it is being read: updates and
deletes go to a new version folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from chatlake.operators.keys import drop_keys, keep_keys


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def publish(df: DataFrame, root: str, version: int) -> str:
    """Write a whole new version of a table beside the old ones."""
    path = f"{root}/version={version}"
    overwrite(df, path)
    return path


def save_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` as a table bucketed and sorted by ``key``.

    Two tables with the same key and bucket count join without a shuffle.
    """
    # One task per bucket, so that a bucket is one file.
    spread = df.repartition(buckets, key)
    spread.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def read_version(spark: SparkSession, root: str, version: int, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{root}/version={version}")


def insert_ignore(existing: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``batch`` whose key is new, one per key (the smallest row wins)."""
    rest = [c for c in batch.columns if c not in keys]
    # min(struct) combines before the shuffle, unlike a window over each key.
    one = batch.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")) if rest else batch.dropDuplicates(keys)
    if rest:
        one = one.select(*keys, "_row.*").select(batch.columns)
    return drop_keys(one, existing, keys).select(batch.columns)


def insert_strict(existing: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The whole batch, or nothing when one of its keys is repeated or taken."""
    repeated = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(keys)
    taken = keep_keys(batch, existing, keys).select(keys)
    return batch.where(~repeated.unionByName(taken).exists())


def append_strict(batch: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the whole batch to the table at ``path``, or nothing; the table as it is then."""
    spark = batch.sparkSession
    append(insert_strict(spark.read.schema(batch.schema).parquet(path), batch, keys), path)
    return spark.read.schema(batch.schema).parquet(path)


def append_users(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Users have no key: duplicates are allowed."""
    return existing.unionByName(batch)


def update_by_key(target: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """Set ``column`` where ``updates`` holds the key; ``matched`` tells which rows. A key given twice fails."""
    once = F.when(F.count(F.lit(1)) == 1, F.first(column)).otherwise(
        F.raise_error(F.concat(F.lit("update given twice for key "), F.col(key).cast("string"))))
    new = updates.groupBy(key).agg(once.alias("_new")).withColumnRenamed(key, "_key")
    joined = target.join(new, target[key] == new["_key"], "left")
    return joined.select(
        *[F.when(F.col("_key").isNotNull(), F.col("_new")).otherwise(F.col(c)).alias(c) if c == column else c
          for c in target.columns],
        F.col("_key").isNotNull().alias("matched"),
    )


def delete_by_key(target: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return drop_keys(target, gone, keys)
