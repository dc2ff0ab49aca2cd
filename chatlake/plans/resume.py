"""Text recovery that goes on where it stopped.

Row ids are cut into ranges of ``range_rows`` ids. A run first reads ids alone and compares every
range (rows, and a mark over their ids and versions) with what the table of finished ranges
holds; only ranges that are new or have changed are opened. Ranges are worked off in lanes of
``lane_ranges`` neighbouring ranges. Neighbouring lanes share a job and a commit, so that a run has
about ``jobs`` jobs however many lanes it opens and scans the log no more often: texts first, then the
entry that calls the ranges finished. A run that is cut off loses one job at most, which is one lane or
about the ``jobs``-th part of the open rows; a range done twice replaces its own folder.

Rows without an id take no part and stay as they are; of rows with one id, the largest text found counts.
A row whose contents change is seen only if ``version``, a cheap column, changes too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chatlake.functions.body import with_decoded
from chatlake.functions.text import not_blank, present, strip
from chatlake.operators.keys import drop_keys
from chatlake.plans.recovery import with_extracted_column
from chatlake.session import path_exists, settle

RANGE_ROWS = 1_000_000
LANE_RANGES = 100
JOBS = 16
_TEXTS = "rowid bigint, found string, range bigint"
_FINISHED = "range bigint, rows bigint, mark bigint, run bigint"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, empty if it does not exist yet."""
    if path_exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def _folder(root: str, range_rows: int) -> str:
    """Ranges of another size are another work list."""
    return f"{root}/ranges-of-{range_rows}"


def _ranges(message: DataFrame, version: Column | None, range_rows: int) -> DataFrame:
    """range, rows, mark: from the id and the version alone."""
    mark = F.bit_xor(F.xxhash64("rowid", version if version is not None else F.lit(0)))
    ids = message.where(F.col("rowid").isNotNull()).withColumn("range", _range(range_rows))
    return ids.groupBy("range").agg(F.count(F.lit(1)).alias("rows"), mark.alias("mark"))


def _floor_div(column: str, size: int) -> Column:
    return F.expr(f"({column} - pmod({column}, {size})) div {size}")


def _range(range_rows: int) -> Column:
    return _floor_div("rowid", range_rows)


def finished_ranges(spark: SparkSession, root: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """range, rows, mark, run: the last entry of every range."""
    entries = _table(spark, f"{_folder(root, range_rows)}/finished", _FINISHED)
    return entries.groupBy("range").agg(F.max_by(F.struct("rows", "mark"), "run").alias("_last"), F.max("run").alias("run")).select(
        "range", "_last.rows", "_last.mark", "run")


def open_ranges(message: DataFrame, root: str, version: Column | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Ranges still to be worked off: new, or not as they were when they were finished."""
    done = finished_ranges(message.sparkSession, root, range_rows)
    return drop_keys(_ranges(message, version, range_rows), done, ["range", "rows", "mark"])


def _shared_jobs(lanes: list[tuple[int, int]], jobs: int) -> list[tuple[int, int]]:
    """(first, last) lane of every job, from (lane, rows) in order: a job takes lanes until it has its share of the rows."""
    share = sum(rows for _, rows in lanes) / max(1, jobs)
    found, held = [], None
    for lane, rows in lanes:
        if held is None or held >= share:
            found.append((lane, lane))
            held = 0
        found[-1], held = (found[-1][0], lane), held + rows
    return found


def recover_texts(message: DataFrame, root: str, version: Column | None = None, range_rows: int = RANGE_ROWS,
                  lane_ranges: int = LANE_RANGES, lanes: int | None = None, jobs: int = JOBS) -> int:
    """Work off what is open, at most ``lanes`` lanes of it if given; the number of lanes worked off.

    Bodies of finished ranges are not read.
    """
    spark = message.sparkSession
    lane = _floor_div("range", lane_ranges)
    work = settle(open_ranges(message, root, version, range_rows).withColumn("lane", lane), "open-ranges")
    run = finished_ranges(spark, root, range_rows).agg(F.max("run")).first()[0]
    # One row per lane of 100 million ids by default.
    todo = [(r["lane"], r["rows"]) for r in work.groupBy("lane").agg(F.sum("rows").alias("rows")).orderBy("lane").collect()][:lanes]
    for place, (first, last) in enumerate(_shared_jobs(todo, jobs)):
        mine = work.where(F.col("lane").between(first, last))
        _write_lanes(message, mine, root, first, last, range_rows, lane_ranges)
        entry = mine.select("range", "rows", "mark", F.lit((run or 0) + 1 + place).cast("bigint").alias("run"))
        entry.coalesce(1).write.mode("append").parquet(f"{_folder(root, range_rows)}/finished")
    return len(todo)


def _write_lanes(message: DataFrame, work: DataFrame, root: str, first: int, last: int, range_rows: int, lane_ranges: int) -> None:
    """Texts of the open ranges of neighbouring lanes, each range in a folder of its own."""
    ids = lane_ranges * range_rows
    # The bounds reach the scan.
    near = with_extracted_column(message).where((F.col("rowid") >= first * ids) & (F.col("rowid") < (last + 1) * ids))
    open_rows = near.withColumn("range", _range(range_rows)).join(work.select("range"), "range", "left_semi")
    wanted = F.when(~present(F.col("text")) & ~present(F.col("extracted_text")), F.col("attributed_body"))
    texts = with_decoded(open_rows.select("rowid", "range", "text", "extracted_text", "attributed_body"), wanted)
    found = F.when(not_blank(F.col("decoded")), strip(F.col("decoded")))
    # The first row of a range holds no text, so that a range without any text replaces its folder too.
    rows = texts.select("rowid", found.alias("found"), "range").where("found IS NOT NULL").unionByName(
        work.select(F.lit(None).cast("bigint").alias("rowid"), F.lit(None).cast("string").alias("found"), "range"))
    # Rows of a range move together, so that a range is one file whatever the order of the log.
    rows.repartition("range").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("range").parquet(
        f"{_folder(root, range_rows)}/texts")


def recovered_message(message: DataFrame, root: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The log with ``extracted_text`` filled from the texts found so far; as ``recover_text`` once nothing is open."""
    texts = _table(message.sparkSession, f"{_folder(root, range_rows)}/texts", _TEXTS)
    found = texts.where("rowid IS NOT NULL").groupBy(F.col("rowid").alias("_id")).agg(F.max("found").alias("_found"))
    rows = with_extracted_column(message)
    joined = rows.join(found, F.col("rowid") == F.col("_id"), "left")
    wanted = ~present(F.col("text")) & ~present(F.col("extracted_text")) & F.col("_found").isNotNull()
    filled = F.when(wanted, F.col("_found")).otherwise(F.col("extracted_text"))
    return joined.withColumn("extracted_text", filled).select(rows.columns)
