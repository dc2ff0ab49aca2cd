"""Text recovery that is cut off, goes on, and reads nothing twice."""

import pytest
from pyspark.sql import functions as F

from chatlake.functions.body import encode_body
from chatlake.plans import recovery as RV, resume as RE
from chatlake.session import scratch_path

HOW = {"range_rows": 100, "lane_ranges": 2}


@pytest.fixture(scope="module")
def log(spark):
    said = F.concat(F.lit("said "), F.col("id"))
    # Ids are dense up to 300, then sparse, and some are negative or missing; some bodies cannot be read.
    ids = spark.range(900).withColumn("rowid", F.expr("CASE WHEN id < 300 THEN id - 50 WHEN id = 899 THEN NULL ELSE id * 7 END"))
    return ids.select(
        "rowid", F.when(F.col("id") % 3 == 0, said).when(F.col("id") % 3 == 1, "").alias("text"),
        F.when(F.col("id") % 11 == 0, F.lit(bytearray(b"\x00\x01\x02\x03"))).when(F.col("id") % 5 != 0, encode_body(said)).alias("attributed_body"),
        F.when(F.col("id") % 13 == 0, "from before").alias("extracted_text"),
        F.lit(0).alias("edited")).cache()


def result(message, root):
    return sorted(map(str, RE.recovered_message(message, root, HOW["range_rows"]).collect()))


def unreadable(message):
    return message.withColumn("attributed_body", F.raise_error(F.lit("body read")).cast("binary"))


def wanted(log):
    # A row without an id has nothing to be found by.
    rows = RV.recover_text(log)
    before = log.select(F.col("rowid").alias("r"), F.col("extracted_text").alias("before"))
    lost = log.where("rowid IS NULL")
    assert before.where("r IS NULL").count() == 1
    return sorted(map(str, rows.where("rowid IS NOT NULL").unionByName(lost).collect()))


def test_all_at_once(spark, log):
    root = scratch_path(spark, "recovery")
    assert RE.recover_texts(log, root, **HOW) > 5
    assert result(log, root) == wanted(log)
    # A second run reads no body.
    assert RE.recover_texts(unreadable(log), root, **HOW) == 0
    assert RE.open_ranges(log, root, None, 100).count() == 0


def test_interrupted_run_goes_on(spark, log):
    root = scratch_path(spark, "recovery")
    broken = log.withColumn("attributed_body", F.when(F.col("rowid") == 3500, F.raise_error(F.lit("lost")).cast("binary")).otherwise(
        F.col("attributed_body")))
    with pytest.raises(Exception, match="lost"):
        RE.recover_texts(broken, root, **HOW)
    done = [r["range"] for r in RE.finished_ranges(spark, root, 100).collect()]
    assert done and max(done) < 35
    # Bodies of what was finished are not read again.
    kept = log.withColumn("attributed_body", F.when(F.col("rowid") < (max(done) + 1) * 100, F.raise_error(F.lit("read")).cast("binary")).otherwise(
        F.col("attributed_body")))
    RE.recover_texts(kept, root, **HOW)
    assert result(log, root) == wanted(log)


def test_jobs_do_not_grow_with_the_lanes(spark, log):
    root = scratch_path(spark, "recovery")
    found = RE.recover_texts(log, root, range_rows=10, lane_ranges=1, jobs=4)
    assert found > 300
    assert 1 < RE.finished_ranges(spark, root, 10).select("run").distinct().count() <= 5
    assert sorted(map(str, RE.recovered_message(log, root, 10).collect())) == wanted(log)


def test_lanes_of_a_job_hold_their_share_of_the_rows():
    assert RE._shared_jobs([], 4) == []
    assert RE._shared_jobs([(-1, 5), (0, 5), (3, 5), (9, 5)], 2) == [(-1, 0), (3, 9)]
    assert RE._shared_jobs([(0, 100), (1, 1), (2, 1), (3, 1)], 3) == [(0, 0), (1, 3)]
    assert RE._shared_jobs([(i, 1) for i in range(6)], 16) == [(i, i) for i in range(6)]


def test_lanes_one_by_one(spark, log):
    root, runs = scratch_path(spark, "recovery"), 0
    while RE.recover_texts(log.where("rowid < 1500"), root, lanes=1, **HOW):
        runs += 1
    # Ids from -50 to 249 lie in the lanes -1, 0 and 1 of 200 ids each.
    assert runs == 3 and result(log.where("rowid < 1500"), root) == wanted_part(log)


def wanted_part(log):
    return sorted(map(str, RV.recover_text(log.where("rowid < 1500")).collect()))


def test_new_and_changed_rows_reopen_their_range_only(spark, log):
    root = scratch_path(spark, "recovery")
    edited = F.col("edited")
    RE.recover_texts(log.where("rowid <> 42"), root, edited, **HOW)
    assert [r["range"] for r in RE.open_ranges(log, root, edited, 100).collect()] == [0]
    assert RE.recover_texts(log, root, edited, **HOW) == 1
    changed = log.withColumn("hit", F.col("rowid") == 147).select(
        "rowid", "text", F.when(F.col("hit"), F.lit(None).cast("binary")).otherwise(F.col("attributed_body")).alias("attributed_body"),
        "extracted_text", F.when(F.col("hit"), 1).otherwise(0).alias("edited"))
    assert [r["range"] for r in RE.open_ranges(changed, root, edited, 100).collect()] == [1]
    RE.recover_texts(changed, root, edited, **HOW)
    assert result(changed, root) == wanted(changed)
    # As it was before counts as changed once more.
    assert RE.recover_texts(log, root, edited, **HOW) == 1 and result(log, root) == wanted(log)


def test_a_range_whose_bodies_go(spark, log):
    root = scratch_path(spark, "recovery")
    few = log.where("rowid BETWEEN 0 AND 99")
    RE.recover_texts(few, root, F.col("edited"), **HOW)
    bare = few.withColumn("attributed_body", F.lit(None).cast("binary")).withColumn("edited", F.lit(1))
    RE.recover_texts(bare, root, F.col("edited"), **HOW)
    assert result(bare, root) == sorted(map(str, RV.recover_text(bare).collect()))


def test_empty_log(spark, log):
    root = scratch_path(spark, "recovery")
    assert RE.recover_texts(log.where("false"), root, **HOW) == 0 and result(log.where("false"), root) == []
    assert result(log, root) == sorted(map(str, log.collect()))
