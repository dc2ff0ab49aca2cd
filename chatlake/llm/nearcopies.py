"""Near copies: MinHash bands propose pairs, odd sketches thin them, full sets decide.

Documents with equal shingle sets are one class, and only one row per class goes on.
Its MinHash values form bands; classes that agree on a band share a bucket. Another
sample of the set, the smallest shingle in each of 2,048 cells, is folded into a bitmap
by parity: a bit says whether an odd number of samples fell on it, so the population
count of the exclusive or of two bitmaps estimates how many samples differ. Pairs whose
estimate is far from the threshold are dropped; the intersection and union of the full
sets decide on the rest.

No bucket is expanded into pairs. Each bucket first links its members to one of them, in
``ROUNDS`` rounds. That pivot is the member with the most company over all its buckets:
the original of many edited copies is closer to each than they are to each other. A
member already in the pivot's component is not compared again. What is left are buckets that still hold several components: members
outside the largest of them are compared with the members of other components by a join
on the bucket, in which the sketch is part of the condition. So every pair that shares a
bucket is compared or known to be connected.

Results by case: NULL and empty texts have no shingles and link with nothing; a text
with fewer words than a shingle is one shingle; rows that share a doc_id are one
document; a NULL doc_id takes no part (component NULL, kept).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chatlake.llm.common import settled, texts
from chatlake.llm.components import components
from chatlake.llm.wordhash import Words, mixed, shingle_hashes, slices

SHINGLE = 5
BANDS, BAND_ROWS = 24, 5
CELLS = 2048
SKETCH_BITS = 2048
ROUNDS = 2

_ODD = np.random.default_rng(11).integers(0, 2**64, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)
_MARK = np.uint64(0xD6E8FEB86659FD93)


def shingle_set(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingles; fewer words than ``size`` are one shingle."""
    return np.unique(shingle_hashes(words, min(size, len(words)))) if len(words) else words


def min_hashes(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values (rows x permutations) of non-empty sets that start at ``first``."""
    out = np.empty((len(first), len(_ODD)), np.uint64)
    for i, odd in enumerate(_ODD):
        out[:, i] = np.minimum.reduceat(sets * odd, first)
    return out


def odd_sketches(sets: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Parity bitmaps (rows x words) over the smallest shingle of each cell."""
    row = np.repeat(np.arange(len(first)), sizes)
    cell = (sets >> np.uint64(64 - int(np.log2(CELLS)))).astype(np.int64)
    # Sets are sorted, so the first of a run of equal cells is the smallest.
    lead = np.ones(len(sets), bool)
    lead[1:] = (cell[1:] != cell[:-1]) | (row[1:] != row[:-1])
    bit = (mixed(sets[lead] ^ _MARK) >> np.uint64(64 - int(np.log2(SKETCH_BITS)))).astype(np.int64)
    flips = np.bincount(row[lead] * SKETCH_BITS + bit, minlength=len(first) * SKETCH_BITS) & 1
    words = np.packbits(flips.astype(np.uint8).reshape(len(first), SKETCH_BITS), axis=1)
    return words.view(np.int64)


def _sets_of(part: pa.RecordBatch) -> list[np.ndarray]:
    words = Words(part.column("text"))
    hashes = words.hashes(lower=True)
    return [shingle_set(hashes[a:b]) for a, b in zip(words.first[:-1], words.first[1:])]


_SIGNED = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, sketch array<bigint>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    band = np.arange(1, BANDS + 1, dtype=np.uint64) * _MARK
    for batch in batches:
        for part in slices(batch, "text"):
            found = _sets_of(part)
            sizes = np.array([len(x) for x in found], np.int64)
            full = np.flatnonzero(sizes)
            bands = np.zeros((len(found), BANDS), np.int64)
            sketch = np.zeros((len(found), SKETCH_BITS // 64), np.int64)
            names = np.zeros((2, len(found)), np.uint64)
            if len(full):
                sets = np.concatenate(found)
                first = (np.cumsum(sizes) - sizes)[full]
                rows = min_hashes(sets, first).reshape(len(full), BANDS, BAND_ROWS)
                key = np.repeat(band[None], len(full), axis=0)
                for i in range(BAND_ROWS):
                    key = mixed(key * _MARK + rows[:, :, i])
                bands[full] = key.view(np.int64)
                sketch[full] = odd_sketches(sets, first, sizes[full])
                names[0, full] = np.add.reduceat(mixed(sets), first)
                names[1, full] = np.add.reduceat(mixed(sets ^ _MARK), first)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                     for x in (bands, sketch)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes), *(pa.array(n.view(np.int64)) for n in names), *lists],
                [c.split()[0] for c in _SIGNED.split(", ")])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            found = [x.view(np.int64) for x in _sets_of(part)]
            sizes = np.cumsum([0, *map(len, found)])
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["node", "shingles"])


def plausible(percent: int) -> Column:
    """True unless sizes or sketches (n_a, n_b, ...) are far from a similarity of ``percent``."""
    share = percent / 100
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    odd = sum((F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(SKETCH_BITS // 64)),
              F.lit(0))
    differ = -SKETCH_BITS / 2 * F.log(1 - 2 * F.least(odd, F.lit(SKETCH_BITS // 2 - 1)) / SKETCH_BITS)
    # At the threshold: shingles of both, the cells they take, and those cells that hold one alone.
    union = (F.col("n_a") + F.col("n_b")) / (1 + share)
    taken, alone = CELLS * (1 - F.exp(-union / CELLS)), union * F.exp(-union / CELLS)
    # The smallest shingle of a cell is not shared: one sample differs, or two if the other set is there too.
    expected = (1 - share) * (2 * taken - alone)
    spread = 4 * share * (1 - share) * taken * (1 - taken / union) + expected * expected / SKETCH_BITS
    return sizes & (differ <= expected + 5 * F.sqrt(spread) + 2)


def _about(nodes: DataFrame, side: str) -> DataFrame:
    return nodes.select(F.col("node").alias(side), *[
        F.col(c).alias(f"{n}_{side}") for c, n in (("n_shingles", "n"), ("sketch", "sketch"))])


class _Linker:
    """Decides candidate pairs (a, b) of nodes by their full sets."""

    def __init__(self, rows: DataFrame, nodes: DataFrame, percent: int):
        self.rows, self.nodes, self.percent = rows, nodes, percent

    def likely(self, pairs: DataFrame) -> DataFrame:
        wide = pairs.join(_about(self.nodes, "a"), "a").join(_about(self.nodes, "b"), "b")
        return wide.where(plausible(self.percent)).select("a", "b")

    def links(self, pairs: DataFrame) -> DataFrame:
        pairs = settled(pairs.distinct(), "pairs")
        used = pairs.select(F.col("a").alias("used")).union(pairs.select("b")).distinct()
        texts_used = self.rows.join(used, F.col("doc_id") == F.col("used"), "left_semi")
        sets = settled(texts_used.mapInArrow(_full_sets, "node bigint, shingles array<bigint>"), "sets")
        left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
        right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
        shared = F.size(F.array_intersect("set_a", "set_b"))
        close = 100 * shared >= self.percent * (F.size("set_a") + F.size("set_b") - shared)
        return settled(pairs.join(left, "a").join(right, "b").where(close & (shared > 0)).select("a", "b"), "links")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked whose shingle sets have an intersection of at least
    ``percent`` hundredths of their union; component_id is the smallest doc_id reachable.
    """
    rows = texts(docs, id_col, text_col)
    signed = settled(rows.mapInArrow(_sign, _SIGNED), "sketches")
    named = signed.where("n_shingles > 0 and doc_id is not null")
    key = ["set_a", "set_b", "n_shingles"]
    classes = named.groupBy(*key).agg(F.min("doc_id").alias("node"))
    placed = signed.select("doc_id", *key).join(classes, key, "left")
    # A row without an id is like others but belongs to none.
    member = settled(placed.withColumn("node", F.when(F.col("doc_id").isNotNull(), F.col("node"))), "members")
    # Rows of one document may be of several classes.
    several = member.where("node is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    own = member.where("node is not null").select("doc_id", "node").distinct().join(
        several.where("a <> b"), "doc_id").select("a", F.col("node").alias("b")).where("a <> b")
    nodes = settled(named.join(classes.select(F.col("node").alias("doc_id"), *key), ["doc_id", *key]).withColumnRenamed(
        "doc_id", "node").select("node", "n_shingles", "bands", "sketch").dropDuplicates(
            ["node", "n_shingles", "sketch"]), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("bucket")).distinct()
    shared = banded.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    buckets = settled(banded.join(shared.where("low < high").select("bucket"), "bucket"), "buckets")

    linker = _Linker(rows, nodes, percent)
    links, mixed_buckets, found = own, buckets.withColumn("component", F.col("node")), None
    for _ in range(ROUNDS):
        pivots = _pivots(mixed_buckets)
        pairs = mixed_buckets.join(pivots, "bucket").where(F.col("component") != F.col("pivot_component"))
        pairs = pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
        links = settled(links.unionByName(linker.links(linker.likely(pairs.distinct()))), "links")
        found = settled(components(links), "components")
        mixed_buckets = settled(_mixed(buckets, found), "mixed")
    links = links.unionByName(linker.links(_rest(mixed_buckets, nodes, percent)))
    found = components(links)
    named = member.join(found, "node", "left").withColumn("component_id", F.coalesce("component", "node", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return named.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def _pivots(members: DataFrame) -> DataFrame:
    """(bucket, pivot, pivot_component): the member with the most company, the smallest of equals."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    company = members.join(sizes, "bucket").groupBy("node").agg(F.sum("size").alias("company"))
    # Company, then the smaller node: one number, which is combined before the shuffle.
    width = F.lit(str(2**64)).cast("decimal(20,0)")
    place = (F.col("company").cast("decimal(18,0)") * width - F.col("node").cast("decimal(20,0)")).cast("decimal(38,0)")
    ranked = members.join(company, "node").select("bucket", "node", "component", place.alias("place"))
    best = ranked.groupBy("bucket").agg(F.max("place").alias("place"))
    found = ranked.join(best, ["bucket", "place"]).groupBy("bucket").agg(
        F.min("node").alias("pivot"), F.min("component").alias("pivot_component"))
    return found


def _mixed(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, each with its component."""
    placed = buckets.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return placed.join(several.where("low < high").select("bucket"), "bucket")


def _rest(mixed_buckets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Plausible pairs of different components in a bucket, one side outside its largest component."""
    sizes = mixed_buckets.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("members"))
    largest = sizes.groupBy("bucket").agg(
        F.max_by("component", F.struct("members", "component")).alias("largest"))
    placed = settled(mixed_buckets.join(largest, "bucket").join(
        nodes.select("node", "n_shingles", "sketch"), "node"), "rest")
    sides = {s: placed.select("bucket", F.col("node").alias(s), F.col("component").alias(f"component_{s}"), F.col(
        "n_shingles").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"),
        (F.col("component") != F.col("largest")).alias(f"outside_{s}")) for s in "ab"}
    once = F.col("outside_a") & (~F.col("outside_b") | (F.col("a") < F.col("b")))
    apart = F.col("component_a") != F.col("component_b")
    pairs = sides["a"].where("outside_a").join(
        sides["b"], (sides["a"]["bucket"] == sides["b"]["bucket"]) & once & apart & plausible(percent))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
