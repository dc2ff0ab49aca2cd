"""Ranking facts and vectors for one query, fusing and reranking for one or many.

Keyword score: BM25 (Robertson & Zaragoza 2009). Fusion: reciprocal rank fusion
(Cormack, Clarke & Buettcher 2009).
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from chatlake.operators.sequences import group_index, top_n_per_group
from chatlake.session import settle

K1 = 1.2
B = 0.75
RRF_K = 60
TOKEN = r"[\p{L}\p{N}]+"


def episodes(items: DataFrame, as_of: Column | None = None) -> DataFrame:
    """(name, content, type, description, reference_time) in one shape.

    Text and JSON episodes have default descriptions; structured content becomes
    JSON text; a missing time is ``as_of``.
    """
    kind, content = F.col("type"), F.col("content")
    if dict(items.dtypes)["content"] != "string":
        content = F.to_json(content)
    described = F.coalesce("description", F.concat(kind, F.lit(" episode")))
    fallback = F.lit(None).cast("timestamp") if as_of is None else as_of
    return items.select("name", content.alias("episode_body"), kind.alias("source"),
                        described.alias("source_description"),
                        F.coalesce("reference_time", fallback).alias("reference_time"))


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _occurrences(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda word: word == F.lit(term)))


def term_counts(documents: DataFrame, terms: list[str], id_column: str, text_column: str) -> DataFrame:
    """(id, length, tf0, tf1, ...): words of each text and how often each term is one of them."""
    edge = TOKEN[:-1]
    wanted = f"(?<!{edge})(?:{'|'.join(terms)})(?!{edge})"
    lowered = documents.select(F.col(id_column).alias("id"), F.lower(F.col(text_column)).alias("_text"))
    found = lowered.select("id", F.size(_found(F.col("_text"), TOKEN)).alias("length"),
                           _found(F.col("_text"), wanted).alias("_hits"))
    return found.select("id", "length", *[_occurrences("_hits", t).alias(f"tf{i}") for i, t in enumerate(terms)])


def bm25_topk(documents: DataFrame, query: str, limit: int = 10, id_column: str = "doc_id",
              text_column: str = "text") -> DataFrame:
    """The best documents for the words of ``query``.

    Each text is read once: its counts go to a narrow scratch table, from which
    both the one-row statistics and the scores are taken.
    """
    terms = list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))
    if not terms:
        return _top(documents.select(F.col(id_column).alias("id"), F.lit(0.0).alias("score")).where("false"), limit)
    counted = settle(term_counts(documents, terms, id_column, text_column), "terms")
    stats = counted.agg(
        F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"),
        *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    score: Column = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), stats[f"df{i}"]
        idf = math.log(1.0 + (stats["n"] - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * F.col("length") / F.lit(stats["mean"] or 1.0))
        score = score + F.lit(idf) * tf * (K1 + 1) / (tf + norm)
    return _top(counted.select("id", score.alias("score")).where("score > 0"), limit)


def cosine_topk(vectors: DataFrame, query: list[float], limit: int = 10, id_column: str = "vec_id",
                vector_column: str = "embedding") -> DataFrame:
    """The vectors closest to ``query``: one pass and a top-k merge."""
    def dot(a: Column, b: Column) -> Column:
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)

    own = F.col(vector_column)
    wanted = F.array(*[F.lit(float(x)) for x in query])
    length = sum(float(x) ** 2 for x in query) ** 0.5
    # A step of its own, so that each sum is taken once per vector.
    products = vectors.select(F.col(id_column).alias("id"), dot(own, wanted).alias("product"),
                              (F.sqrt(dot(own, own)) * F.lit(length)).alias("sizes"))
    scored = products.select("id", F.when(F.col("sizes") > 0, F.col("product") / F.col("sizes")).alias("score"))
    return _top(scored.where("score IS NOT NULL"), limit)


def _top(scored: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best rows with their rank; the window sees only those rows."""
    best = scored.orderBy(F.desc("score"), "id").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def hybrid_rrf(by_keyword: DataFrame, by_meaning: DataFrame, limit: int = 5) -> DataFrame:
    """Fuse two ranked lists."""
    both = by_keyword.select("id", "rank").unionByName(by_meaning.select("id", "rank"))
    fused = both.groupBy("id").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"))
    return _top(fused, limit)


def hops_from(edges: DataFrame, center: DataFrame, max_hops: int, wanted: DataFrame | None = None) -> DataFrame:
    """(node, hops) within ``max_hops`` of the centre nodes, edges taken both ways.

    Only the nodes of the last hop are extended, and only they are written. The walk
    ends when a hop finds nothing new, or when all ``wanted`` nodes are reached.
    """
    both_ways = edges.select("source", "target").unionByName(
        edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    both_ways = settle(both_ways.distinct(), "edges")
    frontier = settle(center.toDF("node").distinct(), "hop")
    reached = frontier.withColumn("hops", F.lit(0))
    for hop in range(1, max_hops + 1):
        if wanted is not None and wanted.join(reached, "node", "left_anti").isEmpty():
            break
        # The frontier is unique on the key, so AQE can split the edges of a hub.
        step = both_ways.join(frontier, both_ways["source"] == frontier["node"], "left_semi").select(
            F.col("target").alias("node")).distinct()
        frontier = settle(step.join(reached, "node", "left_anti"), "hop")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier.withColumn("hops", F.lit(hop)))
    return reached


def graph_distance_rerank(hits: DataFrame, edges: DataFrame, center: DataFrame, max_hops: int = 3,
                          limit: int | None = None) -> DataFrame:
    """Hits (id, node, score, rank) by distance from the centre, all or the ``limit`` best; out of reach comes last."""
    near = hops_from(edges, center, max_hops, hits.select("node").distinct())
    rows = hits.join(near, "node", "left").select("id", "node", "score", F.col("rank").alias("search_rank"), "hops")
    # Distance, then rank in the search, as one number: positions are counted in parallel.
    hops = F.coalesce("hops", F.lit(max_hops + 1)).cast("bigint")
    placed = rows.withColumn("_place", hops * (1 << 40) + F.col("search_rank")).withColumn("_all", F.lit(0))
    if limit is not None:
        placed = placed.orderBy("_place").limit(limit)
    return group_index(placed, ["_all"], ["_place"], "rank").withColumn("rank", F.col("rank") + 1).drop("_all", "_place")


def auto_center_rerank(hits: DataFrame, edges: DataFrame, max_hops: int = 3, limit: int | None = None) -> DataFrame:
    """Rerank around the source node of the best hit; no hit gives no row."""
    hits = settle(hits, "hits")
    center = hits.where("rank = 1").select("node")
    return graph_distance_rerank(hits, edges, center, max_hops, limit)


# The same for a table of queries: every step is keyed by query.

def hybrid_rrf_by_query(by_keyword: DataFrame, by_meaning: DataFrame, limit: int = 5) -> DataFrame:
    """Fuse two ranked lists (query_id, id, rank) of many queries."""
    keys = ["query_id", "id"]
    both = by_keyword.select(*keys, "rank").unionByName(by_meaning.select(*keys, "rank"))
    fused = both.groupBy(*keys).agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"))
    return top_n_per_group(fused, ["query_id"], [F.desc("score"), F.col("id")], limit, "rank")


def hops_by_query(edges: DataFrame, centers: DataFrame, max_hops: int, wanted: DataFrame | None = None) -> DataFrame:
    """(query_id, node, hops) within ``max_hops`` of each query's centres (query_id, node), edges taken both ways.

    All queries walk together, one join per hop; a query whose ``wanted`` nodes are all
    reached, or that finds nothing new, walks no further.
    """
    both_ways = edges.select("source", "target").unionByName(
        edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    both_ways = settle(both_ways.distinct(), "edges")
    keys = ["query_id", "node"]
    frontier = settle(centers.select(*keys).distinct(), "hop")
    reached = frontier.withColumn("hops", F.lit(0))
    for hop in range(1, max_hops + 1):
        if wanted is not None:
            missing = wanted.select(*keys).join(reached, keys, "left_anti").select("query_id").distinct()
            frontier = settle(frontier.join(missing, "query_id", "left_semi"), "hop")
        if frontier.isEmpty():
            break
        step = frontier.join(both_ways, F.col("node") == F.col("source")).select("query_id", F.col("target").alias("node")).distinct()
        frontier = settle(step.join(reached, keys, "left_anti"), "hop")
        reached = reached.unionByName(frontier.withColumn("hops", F.lit(hop)))
    return reached


def rerank_by_query(hits: DataFrame, edges: DataFrame, centers: DataFrame | None = None, max_hops: int = 3,
                    limit: int | None = None) -> DataFrame:
    """Hits (query_id, id, node, score, rank) of every query by distance from its centres.

    Without ``centers`` each query walks from the node of its best hit. Hits out of
    reach come last; ``limit`` keeps the best of every query.
    """
    hits = settle(hits.select("query_id", "id", "node", "score", "rank"), "hits")
    if centers is None:
        centers = hits.where("rank = 1")
    near = hops_by_query(edges, centers, max_hops, hits.select("query_id", "node").distinct())
    rows = hits.join(near, ["query_id", "node"], "left").select(
        "query_id", "id", "node", "score", F.col("rank").alias("search_rank"), "hops")
    hops = F.coalesce("hops", F.lit(max_hops + 1)).cast("bigint")
    placed = rows.withColumn("_place", hops * (1 << 40) + F.col("search_rank"))
    if limit is not None:
        placed = top_n_per_group(placed, ["query_id"], [F.col("_place")], limit)
    return group_index(placed, ["query_id"], ["_place"], "rank").withColumn("rank", F.col("rank") + 1).drop("_place")


HIT_FIELDS = {
    "uuid": "string", "fact": "string", "source_node_uuid": "string", "target_node_uuid": "string",
    "created_at": "timestamp", "name": "string", "group_id": "string", "valid_at": "timestamp",
    "invalid_at": "timestamp",
}


def format_hits(hits: DataFrame) -> DataFrame:
    """All hit fields; missing ones are NULL."""
    return hits.select(*[
        (F.col(f) if f in hits.columns else F.lit(None)).cast(t).alias(f) for f, t in HIT_FIELDS.items()])


def format_nodes(nodes: DataFrame, width: int = 100) -> DataFrame:
    """Node fields with a shortened summary and the labels as one text."""
    summary = F.col("summary")
    short = F.when(F.length(summary) > width, F.concat(F.left(summary, F.lit(width)), F.lit("..."))).otherwise(summary)
    attributes = F.col("attributes") if "attributes" in nodes.columns else F.lit("{}")
    return nodes.select("uuid", "name", short.alias("summary"), F.array_join("labels", ", ").alias("labels"),
                        "created_at", attributes.alias("attributes"))
