import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chatlake.operators import retrieval as RT

TEXTS = ["The cat sat on the mat", "cat cat dog", "Ein Hund, the end", "", "état d'état", "concatenate the CAT-scan"]


def brute_force(texts, query):
    docs = [re.findall(r"[^\W_]+", t.lower()) for t in texts]
    mean, scores = sum(map(len, docs)) / len(docs), {}
    for i, words in enumerate(docs):
        score = 0.0
        for term in dict.fromkeys(re.findall(r"[^\W_]+", query.lower())):
            df, tf = sum(term in d for d in docs), Counter(words)[term]
            idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
            score += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
        if score:
            scores[i] = score
    return sorted(scores.items(), key=lambda kv: (-kv[1], kv[0]))


@pytest.mark.parametrize("query", ["cat the", "ÉTAT", "missing", "", "dog cat Hund"])
def test_bm25_matches_brute_force(spark, query):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    got = [(r["id"], r["score"]) for r in RT.bm25_topk(docs, query, 10).orderBy("rank").collect()]
    want = brute_force(TEXTS, query)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want])


def test_cosine(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [3.0, 3.0]), (4, [0.0, 0.0]), (5, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = RT.cosine_topk(df, [1.0, 0.0], 3).orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 5, 3] and got[2]["score"] == pytest.approx(math.sqrt(0.5))


def test_fusion(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id bigint, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id bigint, rank int")
    got = RT.hybrid_rrf(a, b, 2).orderBy("rank").collect()
    assert [r["id"] for r in got] == [2, 1] and got[0]["score"] == pytest.approx(1 / 61 + 1 / 62)


@pytest.fixture
def star(spark):
    """A hub with many leaves, and a chain away from it."""
    edges = [("hub", f"leaf{i}") for i in range(50)] + [("leaf0", "far1"), ("far2", "far1"), ("far2", "far3")]
    return spark.createDataFrame(edges, "source string, target string")


def test_hops(spark, star):
    center = spark.createDataFrame([("far1",)], "node string")
    got = {r["node"]: r["hops"] for r in RT.hops_from(star, center, 3).collect()}
    assert got["far1"] == 0 and got["leaf0"] == got["far2"] == 1 and got["hub"] == got["far3"] == 2 and got["leaf7"] == 3
    assert len(got) == 5 + 49  # all other leaves are three steps away


def test_rerank(spark, star):
    hits = spark.createDataFrame([(1, "leaf9", 9.0, 1), (2, "far3", 8.0, 2), (3, "hub", 7.0, 3), (4, "nowhere", 6.0, 4)],
                                 "id bigint, node string, score double, rank int")
    center = spark.createDataFrame([("hub",)], "node string")
    got = RT.graph_distance_rerank(hits, star, center, 2).orderBy("rank").collect()
    assert [r["id"] for r in got] == [3, 1, 2, 4]
    auto = RT.auto_center_rerank(hits, star, 2).orderBy("rank").collect()
    assert [r["id"] for r in auto] == [1, 3, 2, 4]
    assert RT.auto_center_rerank(hits.limit(0), star).count() == 0


def test_many_queries_as_each_alone(spark, star):
    hits = [(1, 1, "leaf9", 9.0, 1), (1, 2, "far3", 8.0, 2), (1, 3, "hub", 7.0, 3), (1, 4, "nowhere", 6.0, 4),
            (2, 1, "far3", 5.0, 1), (2, 2, "hub", 4.0, 2), (3, 7, "nowhere", 1.0, 1), (4, 1, "hub", 1.0, 1), (4, 2, "leaf3", 0.5, 2)]
    schema = "query_id bigint, id bigint, node string, score double, rank int"
    table = spark.createDataFrame(hits, schema)
    # A third of the queries and more start at the hub.
    center = spark.createDataFrame([(1, "hub"), (2, "hub"), (3, "hub"), (4, "far2")], "query_id bigint, node string")
    for limit in (None, 2):
        given = RT.rerank_by_query(table, star, center, 2, limit).collect()
        auto = RT.rerank_by_query(table, star, None, 2, limit).collect()
        for q in (1, 2, 3, 4):
            own = table.where(F.col("query_id") == q).drop("query_id")
            plain = lambda rows: sorted(tuple(r) for r in rows)
            one = RT.graph_distance_rerank(own, star, center.where(F.col("query_id") == q).select("node"), 2, limit).collect()
            assert plain(r[1:] for r in given if r["query_id"] == q) == plain(one)
            assert plain(r[1:] for r in auto if r["query_id"] == q) == plain(RT.auto_center_rerank(own, star, 2, limit).collect())
    a = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 5, 1)], "query_id bigint, id bigint, rank int")
    b = spark.createDataFrame([(1, 2, 1), (1, 3, 2)], "query_id bigint, id bigint, rank int")
    fused = RT.hybrid_rrf_by_query(a, b, 2).collect()
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in fused) == [(1, 1, 2), (1, 2, 1), (2, 1, 5)]


def test_formats(spark):
    hits = spark.createDataFrame([("u", "f")], "uuid string, fact string")
    row = RT.format_hits(hits).first()
    assert row["fact"] == "f" and row["valid_at"] is None and len(row) == len(RT.HIT_FIELDS)
    nodes = spark.createDataFrame([("u", "n", "x" * 101, ["a", "b"], None)],
                                  "uuid string, name string, summary string, labels array<string>, created_at timestamp")
    node = RT.format_nodes(nodes).first()
    assert node["summary"] == "x" * 100 + "..." and node["labels"] == "a, b"


def test_episodes(spark):
    rows = spark.createDataFrame([("a", "t", "text", None, None), ("b", "{}", "json", "given", None)],
                                 "name string, content string, type string, description string, reference_time timestamp")
    got = RT.episodes(rows, F.lit("2024-01-01").cast("timestamp")).collect()
    assert [r["source_description"] for r in got] == ["text episode", "given"] and got[0]["reference_time"] is not None
    structured = rows.withColumn("content", F.struct("name"))
    assert RT.episodes(structured).first()["episode_body"] == '{"name":"a"}'
