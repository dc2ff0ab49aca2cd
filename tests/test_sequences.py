import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chatlake.operators import sequences as SQ


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows and many of its rows share one instant."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        key = 0 if i % 3 == 0 else rng.randrange(1, 60)
        rows.append((key if key != 59 else None, 5 if key == 0 and i % 2 else rng.randrange(1000), i))
    return rows, spark.createDataFrame(rows, "k bigint, t bigint, id bigint").repartition(8)


def expected_index(rows):
    groups = defaultdict(list)
    for k, t, i in rows:
        groups[k].append((t, i))
    return {(k, i): n for k, members in groups.items() for n, (t, i) in enumerate(sorted(members))}


@pytest.mark.parametrize("cell", [None, "0", "t", "floor(t / 100)"])
def test_group_index_in_any_cells(skewed, cell):
    rows, df = skewed
    got = SQ.group_index(df, ["k"], ["t", "id"], "n", cell and F.expr(cell)).collect()
    assert {(r["k"], r["id"]): r["n"] for r in got} == expected_index(rows)
    assert len(got) == len(rows) and set(got[0].asDict()) == {"k", "t", "id", "n"}


@pytest.mark.parametrize("expression", ["timestamp_seconds(t * 40000)", "lpad(cast(t as string), 5, 'é')", "t > 500", "t", "if(t < 9, null, t)"])
def test_cells_never_decrease(skewed, expression):
    rows, df = skewed
    df = df.withColumn("t", F.expr(expression))
    w = "partition by k order by t, id"
    got = SQ.group_index(df, ["k"], ["t", "id"], "n").withColumn("m", F.expr(f"row_number() over ({w}) - 1"))
    assert got.where("n <> m").count() == 0 and got.count() == len(rows)


def test_no_job_runs_while_a_plan_is_made(spark, skewed):
    rows, df = skewed
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    SQ.collect_parts(df, ["k"], ["t", "id"], F.col("id"), "ids")
    SQ.top_n_per_group(df, ["k"], [F.desc("t")], 5)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before


def test_top_n(skewed):
    rows, df = skewed
    got = SQ.top_n_per_group(df, ["k"], [F.desc("t"), F.desc("id")], 7, "rank").collect()
    groups = defaultdict(list)
    for k, t, i in rows:
        groups[k].append((t, i))
    want = {(k, i): n for k, m in groups.items() for n, (t, i) in enumerate(sorted(m, reverse=True)[:7], 1)}
    assert {(r["k"], r["id"]): r["rank"] for r in got} == want


def test_collect_parts_keeps_everything(skewed):
    rows, df = skewed
    got = SQ.collect_parts(df, ["k"], ["t", "id"], F.col("id"), "ids", part_rows=40).collect()
    assert max(len(r["ids"]) for r in got) <= 40
    joined = defaultdict(list)
    for r in sorted(got, key=lambda r: r["part"]):
        joined[r["k"]] += r["ids"]
    index = expected_index(rows)
    assert all(index[(k, i)] == n for k, ids in joined.items() for n, i in enumerate(ids))
    assert sum(map(len, joined.values())) == len(rows)
