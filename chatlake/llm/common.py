"""Input shape and intermediate tables shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chatlake.session import scratch_path, settle

_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: str | Column) -> DataFrame:
    """The columns an operator works on, under fixed names, so that no other column can clash."""
    return docs.select(
        docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"),
        *[(docs[c] if isinstance(c, str) else c).alias(name) for name, c in more.items()],
    )


def wrapped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row whole in ``row``, beside its id, text and mark (hash of the text): no column of its own can clash."""
    return docs.select(F.struct("*").alias("row"), docs[id_col].cast("bigint").alias("id"),
                       docs[text_col].cast("string").alias("text"), F.xxhash64(docs[text_col]).alias("mark"))


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write are freed when it ends, as nothing reads them again."""
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)


def settled(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    The shuffle files of that write are freed; a lost executor then costs the tasks
    that read the written table.
    """
    with _shuffles_freed(df.sparkSession):
        return settle(df, label)


def bucketed(df: DataFrame, label: str, column: str, buckets: int = 1) -> DataFrame:
    """As ``settled``, with rows dealt to files by ``column``, so that grouping by it later moves none of them.

    With fewer buckets than the session has shuffle partitions Spark would deal them anew.
    """
    spark, name = df.sparkSession, f"chatlake_{uuid.uuid4().hex}"
    buckets = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with _shuffles_freed(spark):
        df.write.bucketBy(buckets, column).option("path", scratch_path(spark, label)).format("parquet").saveAsTable(name)
    found = spark.table(name)
    # The files stay; only the name goes.
    spark.sql(f"DROP TABLE {name}")
    return found


def hashed_to(column: Column | str, parts: int) -> Column:
    """A number from 0 to ``parts`` - 1 that depends on the values only."""
    columns = [column] if isinstance(column, (str, Column)) else column
    return F.pmod(F.xxhash64(*columns), F.lit(parts)).cast("int")
