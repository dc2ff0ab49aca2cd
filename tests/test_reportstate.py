"""State of batches merges to the report of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from chatlake import schemas
from chatlake.operators import quality as Q, reportstate as RS
from chatlake.session import scratch_path

SCHEMA = "rowid bigint, handle_id bigint, date bigint, service_type string, text string, attributed_body binary"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    # A third of all rows are of one handle and one service.
    data = [(i, 7 if i % 3 == 0 else rng.randrange(900), rng.randrange(10**6), "hot" if i % 3 == 0 else rng.choice(["a", "b", None]),
             rng.choice([None, "", "x", "hi"]), rng.choice([None, b"", b"ab", b"longer words here"])) for i in range(3000)]
    return spark.createDataFrame(data, SCHEMA).repartition(5).cache()


@pytest.mark.parametrize("name", ["SOURCE", "TEXTS", "SERVICES"])
def test_merged_is_recomputed(spark, rows, name):
    report, root = getattr(RS, name), scratch_path(spark, "state")
    bounds = [0, 10, 10, 900, 2999, 3000]  # one batch is empty, one has a single row
    for number, (low, high) in enumerate(zip(bounds, bounds[1:])):
        RS.record(rows.where((F.col("rowid") >= low) & (F.col("rowid") < high)), report, root, number)
    wanted = sorted(map(str, RS.recomputed(rows, report).collect()))
    assert sorted(map(str, RS.current_report(rows, report, root).collect())) == wanted
    for upto in (1, 3, 2):  # folding again, or less, changes nothing
        RS.compact(rows, report, root, upto)
        assert sorted(map(str, RS.current_report(rows, report, root).collect())) == wanted
    # A batch after the fold may come again.
    RS.record(rows.where("rowid = 2999"), report, root, 4)
    assert sorted(map(str, RS.current_report(rows, report, root).collect())) == wanted


def test_as_the_report_of_all_rows(rows):
    assert RS.recomputed(rows, RS.TEXTS).collect() == Q.text_extraction_stats(rows).collect()
    assert RS.recomputed(rows, RS.BODIES).collect() == Q.decode_stats(rows).collect()
    exact, near = Q.source_stats(rows).first(), RS.recomputed(rows, RS.SOURCE).first()
    assert exact["message_count"] == near["message_count"] and exact["earliest_message"] == near["earliest_message"]
    assert abs(exact["contact_count"] - near["contact_count"]) <= 4 * RS.SKETCH_ERROR * exact["contact_count"]


def test_sketches_of_many_values(spark):
    rows = spark.range(400_000).select(F.col("id").alias("handle_id"), F.col("id").alias("date"))
    state = RS.batch_state(rows, RS.SOURCE).unionByName(RS.batch_state(rows.where("handle_id < 200000"), RS.SOURCE))
    found = RS.finished(RS.merged_state(state, RS.SOURCE), RS.SOURCE).first()
    assert abs(found["contact_count"] - 400_000) <= 4 * RS.SKETCH_ERROR * 400_000 and found["message_count"] == 600_000


def test_no_rows(spark):
    none, root = spark.createDataFrame([], SCHEMA), scratch_path(spark, "state")
    RS.record(none, RS.SOURCE, root, 0)
    assert RS.current_report(none, RS.SOURCE, root).first().asDict() == {
        "message_count": 0, "contact_count": 0, "earliest_message": None, "latest_message": None}
    users = spark.createDataFrame([("u", "", None, "", "a@b.c", None)], schemas.USERS)
    assert RS.recomputed(users, RS.USERS).collect() == Q.user_stats(users).collect()


def test_a_batch_reads_itself_only(spark, rows):
    """The state of later batches is written without the rows of earlier ones."""
    root = scratch_path(spark, "state")
    RS.record(rows.where("rowid < 1500"), RS.ELIGIBLE, root, 0)
    late = rows.where("rowid >= 1500")
    RS.record(late, RS.ELIGIBLE, root, 1)
    unreadable = rows.withColumn("text", F.raise_error(F.lit("read again")).cast("string"))
    found = RS.current_report(unreadable, RS.ELIGIBLE, root).first()
    assert found.asDict() == RS.recomputed(rows, RS.ELIGIBLE).first().asDict()


def test_stream_goes_on(spark, rows):
    feed, root = scratch_path(spark, "feed"), scratch_path(spark, "state")
    for part in (0, 1):
        rows.where(F.col("rowid") % 2 == part).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(feed)
        RS.follow_report(stream, RS.SERVICES, root).awaitTermination()
    assert sorted(map(str, RS.current_report(rows, RS.SERVICES, root).collect())) == sorted(
        map(str, rows.groupBy("service_type").agg(F.count(F.lit(1)).alias("messages")).collect()))
