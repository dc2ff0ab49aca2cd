"""Stored indexes that answer whole tables of queries: an inverted index of texts, cells of vectors.

Text index. One pass over the texts writes how often each document has each term, counted
inside its row, so that a term of a document moves once, to its posting. Documents are
dealt over blocks, and a posting row holds the documents of one term in one block, sorted
by term, so a query reads the rows of its own terms only. Each row carries the most that its term can add to a score in its block.
The sum over the terms of a query bounds the block; the blocks with the highest bounds are
scored first, and of the others only those whose bound reaches the score that the last
of the best then has. So the result is that of scoring every document.

Vector index. Coarse cells are trained by k-means on a bounded sample; every vector is
stored in the cell it is closest to. A query looks at its ``probes`` closest cells.
``cosine_exact`` compares every query with every vector instead, in blocks of queries.
A cell or a block of any size is cut into parts of bounded size.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from chatlake.operators.retrieval import B, K1, TOKEN
from chatlake.operators.sequences import top_n_per_group
from chatlake.session import settle

# Documents of a block, on average, and blocks of a query that are scored before any is skipped.
BLOCK_DOCS = 2048
FIRST_BLOCKS = 4
# Query terms that are also pushed down to the files; more are only joined.
PUSHED_TERMS = 2000
# Vectors that train the cells, cells at most, vectors of a part, and queries compared at once.
SAMPLE = 100_000
MOST_CELLS = 4096
PART_VECTORS = 16_384
QUERY_BLOCK = 1024
# Rows that a task places at once, rows with their cell that it sends on at once, and queries that one part of a cell is shown.
PLACED = 1024
SENT = 16_384
SHOWN = 65_536

# Executors need no copy of this package: the functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# Texts.

@dataclass(frozen=True)
class TextIndex:
    """``postings`` (term, block, most, docs), ``terms`` (term, df); n documents of ``mean`` words."""

    postings: DataFrame
    terms: DataFrame
    n: int
    mean: float


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _counted(rows: DataFrame) -> DataFrame:
    """Sorted ``words`` of each row as ``found``, an array of (term, tf), and their number as ``length``."""
    # A term begins where the word before is another.
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: (i == 0) | (F.get("words", i) != F.get("words", i - 1)))
    begun = rows.withColumn("starts", F.when(F.size("words") > 0, starts)).withColumn("length", F.size("words"))
    ends = F.concat(F.slice("starts", 2, F.size("words")), F.array("length"))
    term = F.zip_with("starts", ends, lambda i, end: F.struct(F.get("words", i).alias("term"), (end - i).cast("bigint").alias("tf")))
    return begun.withColumn("found", F.when(F.size("words") > 0, term)).drop("words", "starts")


def build_text_index(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                     block_docs: int = BLOCK_DOCS) -> TextIndex:
    """Read the texts once; every row is a document; a NULL text has no words and no length."""
    words = documents.select(F.col(id_column).cast("bigint").alias("id"), F.monotonically_increasing_id().alias("row"),
                             F.array_sort(_tokens(F.col(text_column))).alias("words"))
    counts = settle(_counted(words), "term_counts")
    sizes = counts.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    n, mean = sizes["n"], sizes["mean"] or 1.0
    block = F.pmod(F.xxhash64("row"), F.lit(max(1, math.ceil(n / block_docs)))).cast("int")
    keys = ["row", "id", "length"]
    rows = counts.select(block.alias("block"), *keys, F.explode("found").alias("found")).select("found.term", "block", *keys, "found.tf")
    # Sorted by term, so that the files tell which of them hold a term. Grouping takes the rows as they were dealt.
    dealt = rows.repartitionByRange("term", "block").sortWithinPartitions("term", "block")
    part = _part(F.col("tf"), F.col("length"), mean)
    postings = settle(dealt.groupBy("term", "block").agg(
        F.max(part).alias("most"), F.collect_list(F.struct(*keys, "tf")).alias("docs")).sortWithinPartitions("term", "block"), "postings")
    terms = settle(postings.groupBy("term").agg(F.sum(F.size("docs")).alias("df")), "terms")
    return TextIndex(postings, terms, n, mean)


def _part(tf: Column, length: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean)))


def _scores(index: TextIndex, wanted: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, row, id, score) of the documents in the wanted (query_id, term, block, idf)."""
    found = postings.select("term", "block", F.explode("docs").alias("doc")).join(wanted, ["term", "block"])
    part = F.col("idf") * _part(F.col("doc.tf"), F.col("doc.length"), index.mean)
    parts = found.select("query_id", F.col("doc.row").alias("row"), F.col("doc.id").alias("id"), "term", part.alias("part"))
    # Added in the order of the terms, so that equal documents have equal scores to the last digit.
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("term", "part"))), F.lit(0.0), lambda score, p: score + p["part"])
    return parts.groupBy("query_id", "row", "id").agg(total.alias("score"))


def bm25_search(index: TextIndex, queries: DataFrame, limit: int = 10, first_blocks: int = FIRST_BLOCKS) -> DataFrame:
    """(query_id, id, score, rank): the best documents for every query (query_id, text); ties go to the smaller id."""
    asked = queries.select("query_id", F.explode(F.array_distinct(_tokens(F.col("text")))).alias("term"))
    idf = F.log(1.0 + (F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = settle(asked.join(index.terms, "term").select("query_id", "term", idf.alias("idf")), "query_terms")
    postings = index.postings
    some = [r["term"] for r in asked.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    if len(some) <= PUSHED_TERMS:
        postings = postings.where(F.col("term").isin(some))
    heads = postings.select("term", "block", "most").join(asked, "term").select(
        "query_id", "term", "block", "idf", (F.col("idf") * F.col("most")).alias("most"))
    heads = settle(heads, "heads")
    bounds = heads.groupBy("query_id", "block").agg(F.sum("most").alias("bound"))
    first = settle(top_n_per_group(bounds, ["query_id"], [F.desc("bound"), F.col("block")], first_blocks), "first_blocks")
    order = [F.desc("score"), F.col("id"), F.col("row")]
    wanted = heads.drop("most").join(first.select("query_id", "block"), ["query_id", "block"])
    best = settle(top_n_per_group(_scores(index, wanted, postings), ["query_id"], order, limit), "first_best")
    bar = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= limit, F.min("score")).otherwise(0.0).alias("bar"))
    # A hair below the bar, as sums in another order may differ in the last digit.
    left = bounds.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti").join(bar, "query_id").where(
        F.col("bound") >= F.col("bar") * (1 - 1e-9))
    more = _scores(index, heads.drop("most").join(left.select("query_id", "block"), ["query_id", "block"]), postings)
    return top_n_per_group(best.unionByName(more), ["query_id"], order, limit, "rank").drop("row")


# Vectors.

_FOUND = "query_id bigint, id bigint, score double"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles; NULL where a row is missing, has another length or holds no number."""
    out = np.full((len(column), width), np.nan)
    for i, row in enumerate(column.to_pylist()):
        if row is not None and len(row) == width:
            out[i] = [np.nan if x is None else x for x in row]
    return out


def _lists(rows: np.ndarray) -> pa.Array:
    """Rows as a list column, without an object for every number."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))


def _stacked(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    """Lists of one length, none of them missing, as a matrix."""
    flat = [np.asarray(chunk.flatten()) for chunk in column.chunks]
    return np.concatenate(flat).reshape(rows, -1)


def _units(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by their length, and which of them have one."""
    size = np.sqrt((rows * rows).sum(axis=1))
    fine = np.isfinite(size) & (size > 0)
    return rows / np.where(fine, size, 1.0)[:, None], fine


class _Best:
    """The best ``limit`` of all that is shown, per query; ties go to the smaller id."""

    def __init__(self, queries: int, limit: int):
        self.limit = limit
        self.scores, self.ids = np.full((queries, 0), -np.inf), np.zeros((queries, 0), np.int64)

    def show(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.concatenate([self.scores, scores], axis=1)
        ids = np.concatenate([self.ids, np.broadcast_to(ids, (len(scores), len(ids)))], axis=1)
        order = np.lexsort((ids, -scores), axis=1)[:, : self.limit]
        self.scores, self.ids = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)

    def rows(self, query_ids: np.ndarray) -> pa.RecordBatch:
        width = self.scores.shape[1]
        seen = np.isfinite(self.scores).ravel()
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(query_ids, width)[seen]), pa.array(self.ids.ravel()[seen]), pa.array(self.scores.ravel()[seen])],
            ["query_id", "id", "score"])


def _compare(query_ids: np.ndarray, queries: np.ndarray, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(queries), limit)
        for batch in batches:
            # A few thousand vectors at a time, so that a table of scores stays small.
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                rows, fine = _units(_matrix(part.column("vector"), queries.shape[1]))
                ids = np.asarray(part.column("id"))[fine]
                best.show(queries @ rows[fine].T, ids)
        yield best.rows(query_ids)
    return run


def _as_vectors(table: DataFrame, id_column: str, vector_column: str, name: str) -> DataFrame:
    rows = table.select(F.col(id_column).cast("bigint").alias(name), F.col(vector_column).cast("array<double>").alias("vector"))
    return rows.where(F.col(name).isNotNull() & F.col("vector").isNotNull())


def cosine_exact(vectors: DataFrame, queries: DataFrame, limit: int = 10, id_column: str = "vec_id",
                 vector_column: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, score, rank): for each query (query_id, vector) the closest of all vectors.

    Queries go to the tasks in blocks of ``query_block``; each task keeps the best of
    what it reads. Vectors without a length, of another length or with missing
    components take no part, as queries neither.
    """
    rows = _as_vectors(vectors, id_column, vector_column, "id")
    asked = settle(_as_vectors(queries, "query_id", "vector", "query_id").dropDuplicates(["query_id"]), "queries")
    blocks = max(1, math.ceil(asked.count() / query_block))
    found = None
    for i in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).orderBy("query_id").toArrow()
        width = max((len(v) for v in block.column("vector").to_pylist()), default=0)
        units, fine = _units(_matrix(block.column("vector"), width)) if width else (np.zeros((0, 0)), np.zeros(block.num_rows, bool))
        ids = np.asarray(block.column("query_id"))[fine]
        one = rows.mapInArrow(_compare(ids, units[fine], limit), _FOUND)
        found = one if found is None else found.unionByName(one)
    return top_n_per_group(found, ["query_id"], [F.desc("score"), F.col("id")], limit, "rank")


@dataclass(frozen=True)
class VectorIndex:
    """``cells`` (cell, part, id, vector of length 1) and the centres of the cells."""

    cells: DataFrame
    parts: DataFrame
    centres: np.ndarray


def _placed(centres: np.ndarray, probes: int, name: str):
    """Rows of (name, vector) with their ``probes`` closest cells and the vector at length 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PLACED):
                part = batch.slice(start, PLACED)
                rows, fine = _units(_matrix(part.column("vector"), centres.shape[1]))
                rows, ids = rows[fine], np.asarray(part.column(name))[fine]
                cells = np.argsort(-(rows @ centres.T), axis=1, kind="stable")[:, :probes]
                step = max(1, SENT // cells.shape[1])
                for i in range(0, len(ids), step):
                    near = cells[i: i + step]
                    at = np.repeat(np.arange(i, i + len(near)), near.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(near.ravel().astype(np.int32)), pa.array(ids[at]), _lists(rows[at])], ["cell", name, "vector"])
    return run


def build_vector_index(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
                       cells: int | None = None, sample: int = SAMPLE, part_vectors: int = PART_VECTORS) -> VectorIndex:
    """Train cells on at most ``sample`` vectors, chosen by the hash of their id, and store every vector in its cell."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = _as_vectors(vectors, id_column, vector_column, "id")
    n = rows.count()
    if cells is None:
        cells = min(MOST_CELLS, max(1, round(math.sqrt(n))))
    # The usual number of components; vectors of another are no vectors of this table.
    width = (rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first() or [1])[0]
    size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x))
    sound = rows.where(F.size("vector") == width).withColumn("size", size).where((F.col("size") > 0) & (F.col("size") < float("inf")))
    drawn = sound.orderBy(F.xxhash64("id"), "id").limit(sample).select(
        array_to_vector(F.transform("vector", lambda x: x / F.col("size"))).alias("features"))
    drawn = settle(drawn, "sample")
    if drawn.isEmpty():
        centres = np.zeros((1, width))
    else:
        centres = np.array(KMeans(k=max(2, cells), seed=1, maxIter=10, initSteps=2).fit(drawn).clusterCenters())
    placed = settle(rows.mapInArrow(_placed(centres, 1, "id"), "cell int, id bigint, vector array<double>"), "cells")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("held"))
    parts = settle(sizes.select("cell", F.ceil(F.col("held") / part_vectors).cast("int").alias("parts")), "parts")
    dealt = placed.join(F.broadcast(parts), "cell")  # one row per cell, of which there are at most MOST_CELLS
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    return VectorIndex(settle(dealt.select("cell", part, "id", "vector"), "vector_index"), parts, centres)


def _probe(limit: int):
    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        if not held.num_rows or not asked.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        rows, queries = (_stacked(t.column("vector"), t.num_rows) for t in (held, asked))
        ids, query_ids = np.asarray(held.column("id")), np.asarray(asked.column("query_id"))
        found = []
        for i in range(0, len(queries), QUERY_BLOCK):
            best = _Best(len(queries[i: i + QUERY_BLOCK]), limit)
            for j in range(0, len(rows), 2048):
                best.show(queries[i: i + QUERY_BLOCK] @ rows[j: j + 2048].T, ids[j: j + 2048])
            found.append(best.rows(query_ids[i: i + QUERY_BLOCK]))
        return pa.Table.from_batches(found)
    return run


def cosine_search(index: VectorIndex, queries: DataFrame, limit: int = 10, probes: int = 16, shown: int = SHOWN) -> DataFrame:
    """(query_id, id, score, rank): for each query (query_id, vector) the closest vectors of its closest cells.

    A part of a cell meets about ``shown`` queries at once; with more queries it is read by several tasks.
    """
    asked = settle(_as_vectors(queries, "query_id", "vector", "query_id").dropDuplicates(["query_id"]), "queries")
    blocks = max(1, math.ceil(asked.count() / shown))
    asked = asked.mapInArrow(_placed(index.centres, probes, "query_id"), "cell int, query_id bigint, vector array<double>")
    asked = asked.join(F.broadcast(index.parts), "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), "query_id", "vector")
    cells = index.cells.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["cell", "part", "block"]
    found = cells.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_probe(limit), _FOUND)
    return top_n_per_group(found, ["query_id"], [F.desc("score"), F.col("id")], limit, "rank")
