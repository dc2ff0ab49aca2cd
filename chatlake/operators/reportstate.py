"""Reports kept current by what arrives: one small row of mergeable state per batch and group.

Counts add up, extremes are taken again, distinct values are HyperLogLog sketches that unite.
A new batch is read once and writes its own state; the report is made from the states alone,
so its cost grows with the number of batches, and ``compact`` folds those into one.

A batch that comes again replaces its own state, so replays change nothing. Batches are of
appended rows: a row that changes must come in the batch that held it. An empty batch writes no
state for a grouped report and a row of zeros otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from chatlake.functions.text import present
from chatlake.operators import quality as Q
from chatlake.session import path_exists

# 2^14 registers: a relative standard error of 1.04 / 128, about 0.8 %, in 16 KB at most.
SKETCH_BITS = 14
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def _same(df: DataFrame) -> DataFrame:
    return df


@dataclass(frozen=True)
class Report:
    """What is kept of a batch, and how the report follows from it.

    ``counts`` are conditions whose rows are counted (NULL counts as false), ``distinct`` columns whose
    different values are estimated, ``lowest`` and ``highest`` columns; ``by`` are the groups.
    """
    counts: Callable[[], dict[str, Column]]
    distinct: dict[str, str] = field(default_factory=dict)
    lowest: dict[str, str] = field(default_factory=dict)
    highest: dict[str, str] = field(default_factory=dict)
    by: tuple[str, ...] = ()
    prepare: Callable[[DataFrame], DataFrame] = _same
    finish: Callable[[DataFrame], DataFrame] = _same


def batch_state(rows: DataFrame, report: Report) -> DataFrame:
    """The state of some rows: one row per group, in one pass with partial aggregation."""
    prepared = report.prepare(rows)
    return prepared.groupBy(*report.by).agg(
        *[F.count_if(c).alias(name) for name, c in report.counts().items()],
        *[F.min(c).alias(name) for name, c in report.lowest.items()],
        *[F.max(c).alias(name) for name, c in report.highest.items()],
        *[F.hll_sketch_agg(c, F.lit(SKETCH_BITS)).alias(name) for name, c in report.distinct.items()])


def merged_state(states: DataFrame, report: Report) -> DataFrame:
    """States of parts to the state of the whole; a state again, so it can be merged further."""
    return states.groupBy(*report.by).agg(
        *[F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias(name) for name in report.counts()],
        *[F.min(name).alias(name) for name in report.lowest], *[F.max(name).alias(name) for name in report.highest],
        *[F.hll_union_agg(name).alias(name) for name in report.distinct])


def finished(state: DataFrame, report: Report) -> DataFrame:
    """The report of a merged state."""
    # A sketch of no rows may be NULL.
    estimated = state.withColumns({n: F.coalesce(F.hll_sketch_estimate(n), F.lit(0)) for n in report.distinct})
    return report.finish(estimated)


def record(rows: DataFrame, report: Report, root: str, batch: int) -> None:
    """Write the state of a batch, in place of any that it wrote before; one small file."""
    batch_state(rows, report).coalesce(1).write.mode("overwrite").parquet(f"{root}/states/batch={batch}")


def _schema(rows: DataFrame, report: Report) -> T.StructType:
    return T.StructType(list(batch_state(rows, report).schema.fields))


def _numbered(schema: T.StructType, column: str) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(column, T.LongType())])


def _last_fold(spark: SparkSession, root: str, schema: T.StructType) -> int | None:
    if not path_exists(spark, f"{root}/folds"):
        return None
    return spark.read.schema(_numbered(schema, "upto")).parquet(f"{root}/folds").agg(F.max("upto")).first()[0]


def _states(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """States that count now, with ``batch``: the last fold, and the batches after it."""
    fields = schema.fieldNames()
    batches = spark.read.schema(_numbered(schema, "batch")).parquet(f"{root}/states")
    last = _last_fold(spark, root, schema)
    if last is None:
        return batches
    fold = spark.read.schema(schema).parquet(f"{root}/folds/upto={last}").select(*fields, F.lit(last).cast("bigint").alias("batch"))
    return fold.unionByName(batches.where(F.col("batch") > last))


def current_report(rows: DataFrame, report: Report, root: str) -> DataFrame:
    """The report over all batches; ``rows`` gives the types only and is not read."""
    return finished(merged_state(_states(rows.sparkSession, root, _schema(rows, report)), report), report)


def compact(rows: DataFrame, report: Report, root: str, upto: int) -> None:
    """Fold the states of all batches up to ``upto`` into one, beside the folds before it.

    Batches up to there must not come again; their folders under ``states`` are not read any more.
    """
    spark, schema = rows.sparkSession, _schema(rows, report)
    last = _last_fold(spark, root, schema)
    if last is None or upto > last:
        known = _states(spark, root, schema).where(F.col("batch") <= upto)
        merged_state(known, report).coalesce(1).write.mode("overwrite").parquet(f"{root}/folds/upto={upto}")


def follow_report(stream: DataFrame, report: Report, root: str):
    """Record every micro-batch of a stream of appended rows; the started query."""
    def write(rows: DataFrame, batch: int) -> None:
        record(rows, report, root, batch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(
        availableNow=True).start()


def recomputed(rows: DataFrame, report: Report) -> DataFrame:
    """The report over all rows at once, by the same state."""
    return finished(batch_state(rows, report), report)


# The reports.

USERS = Report(
    counts=lambda: {"total_users": F.lit(True), "users_with_phone": present(F.col("phone_number")),
                    "users_with_email": present(F.col("email"))},
    finish=Q.with_users_of_both)

SOURCE = Report(
    counts=lambda: {"message_count": F.lit(True)}, distinct={"contact_count": "handle_id"},
    lowest={"earliest_message": "date"}, highest={"latest_message": "date"})

TEXTS = Report(
    counts=lambda: {"total_messages": F.lit(True), "has_text_column": F.col("t"), "null_text_column": ~F.col("t"),
                    "has_attributed_body": F.col("b"), "needs_decoding": F.col("n"), "recoverable_messages": F.col("d")},
    prepare=Q.text_flags, finish=Q.with_text_rates)

BODIES = Report(
    counts=lambda: {"success_count": F.col("ok"), "failure_count": ~F.col("ok"), "total_attempts": F.lit(True)},
    prepare=Q.decode_flags, finish=Q.with_decode_rate)


def _scope() -> dict[str, Column]:
    text, body = present(F.col("text")), F.col("attributed_body").isNotNull()
    return {"total_messages": F.lit(True), "has_text_column": text, "needs_migration": ~text & body,
            "no_attributed_body": ~body, "already_migrated": present(F.col("extracted_text"))}


def _recovery() -> dict[str, Column]:
    text, body, done = present(F.col("text")), F.col("attributed_body").isNotNull(), present(F.col("extracted_text"))
    return {"total_messages": F.lit(True), "has_text": text, "has_extracted_text": done,
            "messages_recovered": ~text & done, "still_missing_text": ~text & ~done & body}


SCOPE = Report(counts=_scope, finish=Q.with_remaining)
RECOVERY = Report(counts=_recovery, finish=Q.with_recovery_rates)

WIDE = Report(
    counts=lambda: {"total_messages": F.lit(True), "sent_messages": F.col("is_from_me") != 0,
                    "received_messages": F.col("is_from_me") == 0},
    distinct={"unique_contacts": "phone_email"})
SERVICES = Report(counts=lambda: {"messages": F.lit(True)}, by=("service_type",))
ELIGIBLE = Report(counts=lambda: {
    "source_messages": F.lit(True),
    "eligible_messages": F.col("text").isNotNull() | F.col("attributed_body").isNotNull()})
