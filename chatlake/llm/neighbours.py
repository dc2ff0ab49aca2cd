"""Nearest neighbours by collision counting on single random projections.

Vectors are dealt into blocks by a hash of their id. In a block every projection is cut
into cells of equally many vectors; a query looks at the window of cells around its own
value, first narrow, then wider (virtual rehashing: a wider window is the union of
neighbouring cells, so nothing is hashed again). How many windows a vector falls into is
its count of collisions. Vectors above the threshold
are verified by their true inner product. Windows are set by a radius: a vector at that
distance falls into a window with probability 0.87, so with the threshold at 0.8 of all
projections it is verified with probability 0.95, and nearer ones more surely. A query
ends when its k-th neighbour found lies within the radius, or when all are verified.
Blocks are searched in rounds, each of eight times as many as the one before. After the
first round a query brings the k-th score found so far, so its radius is known: one count
settles a block, and only vectors at least that near leave it.
Blocks hold every vector, none is sampled; the nearest of a block are merged with those
of the others.

Queries go to blocks in groups of bounded size, so a task holds one block and one group.

The largest inner product becomes the smallest distance when every vector gets one more
coordinate that brings its length to that of the longest; queries get 0 there.

Results by case: vectors that are NULL, zero or hold a NULL or non-finite component, or
whose id is NULL or length differs from the longest common one, take no part; a query is
no neighbour of itself; ties go to the smaller id; of rows with one id, the first in
the order of components counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from chatlake.llm.common import hashed_to, settled

PROJECTIONS = 64
BLOCK_ROWS = 8192
QUERY_ROWS = 4096
# Half a window at radius 1, in standard deviations of a projected unit vector; share of windows to be met.
HALF_WINDOW = 1.5
THRESHOLD = 0.8
WIDER = 1.15
# Cells of a projection; their numbers fit a byte.
CELLS = 256
# Blocks of a round, as a multiple of the round before.
ROUND_GROWTH = 8
# Vectors of a block from which a query guesses its first radius.
GUESS_ROWS = 256
SEED = 3


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) with v an array of finite doubles, not all zero; one row per id."""
    rows = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(finite & nonzero)
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def projections(dimensions: int, count: int = PROJECTIONS) -> np.ndarray:
    """Random orthogonal directions, in groups of as many as there are dimensions."""
    rng, parts = np.random.default_rng(SEED), []
    while sum(p.shape[1] for p in parts) < count:
        parts.append(np.linalg.qr(rng.standard_normal((dimensions, dimensions)))[0])
    return np.hstack(parts)[:, :count]


class Block:
    """Vectors of a block with their cell in every projection."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.longest = ids[order], vectors[order], longest
        spare = np.sqrt(np.maximum(0, longest**2 - (self.vectors**2).sum(axis=1)))
        self.basis = projections(vectors.shape[1] + 1)
        values = np.hstack([self.vectors, spare[:, None]]) @ self.basis
        self.edges = np.sort(values, axis=0)[np.arange(1, CELLS) * len(ids) // CELLS].T.copy()
        self.cells = np.stack([np.searchsorted(e, v, "right") for e, v in zip(self.edges, values.T)]).astype(np.uint8)
        self._moved, self._inside = np.empty_like(self.cells), np.empty(self.cells.shape, bool)

    def collisions(self, centre: np.ndarray, half: float) -> np.ndarray:
        """For every vector, in how many windows of that half width, rounded up to whole cells, it falls."""
        low = np.count_nonzero(self.edges <= (centre - half)[:, None], axis=1)
        high = np.count_nonzero(self.edges <= (centre + half)[:, None], axis=1)
        # Cells below the window wrap round to high numbers.
        np.subtract(self.cells, low.astype(np.uint8)[:, None], out=self._moved)
        np.less_equal(self._moved, (high - low).astype(np.uint8)[:, None], out=self._inside)
        return np.add.reduce(self._inside.view(np.uint8), axis=0, dtype=np.uint8)

    def nearest(self, query_id: int, query: np.ndarray, k: int, least: float | None = None) -> list[tuple[int, float]]:
        """The k best (vec_id, inner product) that are found, best first; given ``least``, of those that reach it."""
        length = query @ query + self.longest**2
        centre = query @ self.basis[:-1]
        shortest = 1e-7 * self.longest
        if least is None:
            step = max(1, len(self.ids) // GUESS_ROWS)
            guess = np.sort(self.vectors[::step] @ query)[::-1]
            radius = np.sqrt(max(0.0, length - 2 * guess[min(len(guess) - 1, k // step)]))
        else:
            radius = np.sqrt(max(0.0, length - 2 * least))
        radius = max(radius, shortest)
        seen, products = np.zeros(len(self.ids), bool), np.full(len(self.ids), -np.inf)
        while True:
            hits = self.collisions(centre, HALF_WINDOW * radius / np.sqrt(len(self.basis)))
            new = np.flatnonzero((hits >= THRESHOLD * len(centre)) & ~seen)
            seen[new] = True
            products[new] = np.where(self.ids[new] == query_id, -np.inf, self.vectors[new] @ query)
            if least is not None or seen.all():
                break
            if np.isfinite(products).sum() >= k:
                farthest = np.sqrt(max(0.0, length - 2 * np.partition(products, -k)[-k]))
                if farthest <= radius:
                    break
            radius *= WIDER
        # Products of a whole block may differ in the last bits for equal vectors; those that count are taken again row by row.
        bound = np.partition(products, -k)[-k] if len(products) > k else -np.inf
        bound = max(bound, -np.inf if least is None else least)
        near = np.flatnonzero((products >= bound - 1e-9 * self.longest**2) & np.isfinite(products))
        scores = np.einsum("ij,j->i", self.vectors[near], query)
        best = np.lexsort((self.ids[near], -scores))[:k]
        return [(int(self.ids[near[b]]), float(scores[b])) for b in best if least is None or scores[b] >= least]


_FOUND = "query_id bigint, vec_id bigint, score double"


def _search(longest: float, k: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(queries):
            block = Block(vectors["vec_id"].to_numpy(), np.stack(vectors["v"].to_numpy()), longest)
            for query_id, query, least in zip(queries["query_id"].tolist(), queries["query"], queries["least"].tolist()):
                found = block.nearest(query_id, np.asarray(query), k, None if pd.isna(least) else least)
                out += [(query_id, *f) for f in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
    return run


def nearest_neighbours(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id",
                       vector_col: str = "embedding", block_rows: int = BLOCK_ROWS,
                       query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: per query the k found with the largest inner product.

    Queries are the rows whose id is divisible by ``every``; all rows are candidates.
    """
    held = settled(usable(vectors, id_col, vector_col), "vectors")
    sizes = held.groupBy(F.size("v").alias("size")).agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("longest"))
    commonest = sizes.orderBy(F.desc("rows"), F.desc("size")).first()
    if commonest is None:
        return held.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    held = held.where(F.size("v") == commonest["size"])
    blocks, groups = -(-commonest["rows"] // block_rows), -(-commonest["rows"] // (every * query_rows))
    dealt = held.withColumn("block", hashed_to("vec_id", blocks)).withColumn(
        "group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    queries = held.where(F.col("vec_id") % every == 0).select(
        F.col("vec_id").alias("query_id"), F.col("v").alias("query"), hashed_to([F.lit(1), F.col("vec_id")], groups).alias("group"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best, first, count = None, 0, 1
    while first < blocks:
        last = min(blocks, first + count) - 1
        if best is None:
            asked = queries.withColumn("least", F.lit(None).cast("double"))
        else:
            best = settled(best, "found")
            asked = queries.join(best.where(F.col("rank") == k).select("query_id", F.col("score").alias("least")), "query_id", "left")
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(first), F.lit(last))))
        here = dealt.where(F.col("block").between(first, last))
        found = here.groupBy("block", "group").cogroup(asked.groupBy("block", "group")).applyInPandas(
            _search(commonest["longest"], k), _FOUND)
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        first, count = last + 1, count * ROUND_GROWTH
    return best
