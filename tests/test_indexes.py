"""Answers from an index equal those of looking at everything."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatlake.operators import indexes as IX, retrieval as RT


@pytest.fixture(scope="module")
def texts(spark):
    """A third of the documents hold one word only; common and rare words; empty and NULL texts."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, "the " * rng.randint(1, 9) if i % 3 == 0 else " ".join(rng.choices(words, weights, k=rng.randint(1, 60)) + ["The"]))
            for i in range(900)]
    rows += [(900, None), (901, ""), (902, "État d'état W1"), (903, "w1 w1 w1"), (904, "w1 w1 w1"), (904, "w1 w1 w1")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.mark.parametrize("block_docs, first_blocks", [(2048, 4), (20, 1)])
def test_bm25_of_many_queries_as_of_one(spark, texts, block_docs, first_blocks):
    index = IX.build_text_index(texts, block_docs=block_docs)
    asked = ["w1 the", "w250 w3", "ÉTAT", "missing", "", "w0 w1 w2 w3", "the", None, "w299"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id bigint, text string")
    found = IX.bm25_search(index, queries, 7, first_blocks).collect()
    for i, text in enumerate(asked):
        if text:
            want = [(r["id"], r["rank"], round(r["score"], 9)) for r in RT.bm25_topk(texts, text, 7).orderBy("rank").collect()]
            assert sorted(((r["id"], r["rank"], round(r["score"], 9)) for r in found if r["query_id"] == i), key=lambda r: r[1]) == want
    assert {r["query_id"] for r in found} == {0, 1, 2, 5, 6, 8}


def test_blocks_below_the_bar_are_not_read(spark, texts):
    index = IX.build_text_index(texts, block_docs=20)
    read = []
    plain = IX._scores
    try:
        IX._scores = lambda i, wanted, p: read.append(wanted.select("query_id", "block").distinct().count()) or plain(i, wanted, p)
        IX.bm25_search(index, spark.createDataFrame([(1, "w0 w7")], "query_id bigint, text string"), 3).collect()
    finally:
        IX._scores = plain
    blocks = index.postings.where("term IN ('w0', 'w7')").select("block").distinct().count()
    assert sum(read) < blocks


def test_an_empty_text_index(spark, texts):
    index = IX.build_text_index(texts.limit(0))
    queries = spark.createDataFrame([(1, "w1")], "query_id bigint, text string")
    assert IX.bm25_search(index, queries).collect() == []


@pytest.fixture(scope="module")
def vectors(spark):
    """A third of the vectors is one vector; others lie around some centres; some are unfit."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[0] if i % 3 == 0 else centres[i % 30] + 0.4 * rng.normal(size=16)).tolist()) for i in range(3000)]
    rows += [(3000, [0.0] * 16), (3001, None), (3002, [1.0] * 3), (3003, [None] + [1.0] * 15), (3004, [float("nan")] * 16), (None, [1.0] * 16)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


def by_hand(rows, queries, limit):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
            if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    ids, matrix = np.array([i for i, _ in good]), np.array([v / np.linalg.norm(v) for _, v in good])
    out = {}
    for q, v in queries:
        scores = matrix @ (v / np.linalg.norm(v))
        order = np.lexsort((ids, -np.round(scores, 9)))[:limit]
        out[q] = [(int(ids[i]), round(float(scores[i]), 6)) for i in order]
    return out


def asked(vectors):
    return vectors.where("vec_id % 37 = 1 AND vec_id < 3000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@pytest.mark.parametrize("block", [1024, 20])
def test_exact_search(vectors, block):
    queries = asked(vectors)
    rows = [(r[0], r[1]) for r in vectors.collect()]
    want = by_hand(rows, [(r[0], np.array(r[1])) for r in queries.collect()], 5)
    found = IX.cosine_exact(vectors, queries, 5, query_block=block).orderBy("query_id", "rank").collect()
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 6)))
    assert {q: [s for _, s in v] for q, v in got.items()} == {q: [s for _, s in v] for q, v in want.items()}
    assert all(v[0][1] == 1.0 for v in got.values())


def test_cells_find_nearly_all(vectors):
    queries = asked(vectors)
    index = IX.build_vector_index(vectors, part_vectors=100)
    assert index.cells.select("id").distinct().count() == 3000
    assert index.cells.groupBy("cell", "part").count().agg(F.max("count")).first()[0] < 200  # the hot cell is cut
    exact = {(r["query_id"], r["rank"]): r["score"] for r in IX.cosine_exact(vectors, queries, 10).collect()}
    found = {(r["query_id"], r["rank"]): r["score"] for r in IX.cosine_search(index, queries, 10, probes=8).collect()}
    assert found.keys() == exact.keys()
    assert sum(abs(found[k] - exact[k]) < 1e-9 for k in exact) >= 0.9 * len(exact)


def test_an_empty_vector_index(vectors):
    none = vectors.limit(0)
    assert IX.cosine_search(IX.build_vector_index(none), asked(vectors)).collect() == []
    assert IX.cosine_exact(none, asked(vectors)).collect() == [] == IX.cosine_exact(vectors, asked(vectors).limit(0)).collect()


def test_placed_vectors_leave_a_task_in_bounded_batches():
    rng = np.random.default_rng(4)
    rows, centres = rng.normal(size=(3000, 8)), rng.normal(size=(500, 8))
    rows[7] = 0
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(rows.tolist())], ["id", "vector"])
    sent = list(IX._placed(centres, IX.MOST_CELLS, "id")([batch]))
    assert max(b.num_rows for b in sent) <= IX.SENT
    table = pa.Table.from_batches(sent)
    assert table.num_rows == 2999 * 500
    pairs = set(zip(table.column("cell").to_pylist(), table.column("id").to_pylist()))
    assert pairs == {(c, i) for c in range(500) for i in range(3000) if i != 7}
    assert np.allclose(table.column("vector")[0].as_py(), rows[0] / np.linalg.norm(rows[0]))


def test_blocks_of_queries_find_the_same(spark):
    rng = np.random.default_rng(5)
    held = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(300)], "vec_id bigint, embedding array<double>")
    asked = held.where("vec_id < 60").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    index = IX.build_vector_index(held, cells=6, part_vectors=40)
    one, many = (sorted((r["query_id"], r["id"], r["rank"]) for r in IX.cosine_search(index, asked, 5, probes=6, shown=n).collect())
                 for n in (1000, 7))
    assert one == many and len(one) == 300


def test_terms_move_to_their_postings_once(spark):
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.concat(F.lit("w"), i * 31 % (F.col("id") + 200))), " ")
    texts = spark.range(400).select(F.col("id").alias("doc_id"), words.alias("text"))
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def moved():
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = moved()
    index = IX.build_text_index(texts)
    pairs = texts.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("term")).count()
    assert index.postings.select(F.sum(F.size("docs"))).first()[0] == pairs
    # Each (document, term) moves once; what is counted here beside it is terms and their sums.
    assert moved() - before < 1.5 * pairs
