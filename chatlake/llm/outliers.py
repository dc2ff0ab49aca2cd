"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

Every document becomes a vector of four transformed statistics. Per language and
source the minimum covariance determinant is approached by concentration steps: each
step takes the ``share`` of rows nearest to the current centre and estimates centre
and covariance anew from them alone, so junk cannot widen its own limits. Steps start
from mean and covariance and from median and median absolute deviation, and go on until
the determinant stops falling; the estimate with the smallest one is used. A step is one
aggregation over (group, distance class), which combines before the shuffle however
large a group is; centres and covariances are one row per group. A document is rejected
when its squared Mahalanobis distance exceeds the chi-square quantile at ``confidence``.

Groups with fewer than ``smallest`` documents are estimated together; when those are
still too few, none of them is rejected by distance. Variances have a floor, the
resolution below which a difference is not worth a rejection, so a statistic that is
the same in all documents does no harm.

``n_stutters`` counts words equal to the word before them.

Results by case: NULL and empty texts have no words and fail the fixed limits; NULL
languages and sources form groups of their own; repeated rows each get their row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from chatlake.llm.common import settled, texts
from chatlake.llm.wordhash import Words, shingle_hashes, slices

MIN_WORDS = 20
REPEAT_WINDOW = 8
REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
# Standard deviations below which a statistic is taken to vary, in transformed units.
FLOORS = (0.35, 0.35, 0.12, 0.12)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stutters")
_CLASSES_PER_E = 32
_CELLS_PER_E = 1024
# Concentration ends when the determinant falls by a smaller share than this.
LEAST_FALL = 1e-3

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _measures(batch: pa.RecordBatch) -> list[np.ndarray]:
    words = Words(batch.column("text"))
    rows = batch.num_rows
    counts, row = words.counts(), words.row_of_word()
    lead = (words.data & 0xC0) != 0x80  # the first byte of each code point
    before = np.concatenate([[0], np.cumsum(lead)])
    chars = before[words.ends] - before[words.starts]
    word_chars = np.bincount(row, chars, rows).astype(np.int64)
    marks = np.concatenate([[0], np.cumsum(_SYMBOL[words.data])])
    symbols = marks[words.rows[1:]] - marks[words.rows[:-1]]
    lines = np.array([_repeated_lines(t) for t in batch.column("text").to_pylist()], np.int64)
    hashes = words.hashes()
    windows = shingle_hashes(hashes, REPEAT_WINDOW)
    # Windows over the end of a row belong to no document.
    inside = row[: len(windows)] == row[REPEAT_WINDOW - 1:] if len(windows) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    order = np.lexsort((windows[at], row[at]))
    own, held = row[at][order], windows[at][order]
    same = (own[1:] == own[:-1]) & (held[1:] == held[:-1]) if len(at) else np.zeros(0, bool)
    twice = np.zeros(len(at), bool)
    if len(at):
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
    covered = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(covered, at[twice], 1)
    np.add.at(covered, at[twice] + REPEAT_WINDOW, -1)
    repeated = np.bincount(row, np.cumsum(covered[:-1]) > 0, rows).astype(np.int64)
    stutters = np.bincount(row[1:], (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1]), rows).astype(np.int64)
    return [counts.astype(np.int64), word_chars, symbols.astype(np.int64), lines, repeated, stutters]


def _repeated_lines(text: str | None) -> int:
    if not text or "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            found = _measures(part)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("group"), *map(pa.array, found)], ["doc_id", "group", *MEASURES])


def _statistics() -> list[Column]:
    """Transformed so that ordinary documents lie roughly in a ball."""
    words = F.greatest("n_words", F.lit(1))
    return [
        F.col("word_chars") / words,
        F.log1p(100 * F.col("n_symbols") / words),
        F.log1p(F.col("n_dup_lines").cast("double")) / 4,
        F.sqrt((F.col("n_repeat_words") + F.col("n_stutters")) / words),
    ]


def chi_square_4(probability: float) -> float:
    """Quantile of the chi-square distribution with four degrees of freedom."""
    low, high = 0.0, 1000.0
    while high - low > 1e-10:
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - math.exp(-mid / 2) * (1 + mid / 2) < probability else (low, mid)
    return high


def _consistency(share: float) -> float:
    """Factor by which the covariance of the nearest ``share`` of normal rows is too small."""
    x = chi_square_4(share)
    return share / (1 - math.exp(-x / 2) * (1 + x / 2 + x * x / 8))


PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]
_PARAMETERS = "group string, start int, centre array<double>, inverse array<double>, determinant double"


def _estimates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Centre and covariance of the sums of ``rows`` nearest of ``all_rows``."""
    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            centre = np.array([getattr(r, f"s{i}") for i in range(4)]) / r.rows
            cov = np.zeros((4, 4))
            for i, j in PAIRS:
                cov[i, j] = cov[j, i] = getattr(r, f"p{i}{j}") / r.rows - centre[i] * centre[j]
            scale = 1.0 if r.rows == r.all_rows else _consistency(r.rows / r.all_rows)
            cov = scale * cov + np.diag(np.square(FLOORS))
            # Rounded, so that the order in which sums were added leaves no trace.
            out.append((r.group, r.start, np.round(centre, 9).tolist(), np.round(np.linalg.inv(cov), 9).ravel().tolist(),
                        float(f"{np.linalg.det(cov):.9g}")))
        yield pd.DataFrame(out, columns=["group", "start", "centre", "inverse", "determinant"])


def _distance() -> Column:
    apart = [F.col("x")[i] - F.col("centre")[i] for i in range(4)]
    return reduce(lambda a, b: a + b, (apart[i] * apart[j] * F.col("inverse")[4 * i + j]
                                       for i in range(4) for j in range(4)))


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(4)],
        *[F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}{j}") for i, j in PAIRS])


def _middle(cells: DataFrame, value: str) -> DataFrame:
    """group, dim, middle: the median of ``value`` over (group, dim, value, rows)."""
    w = f"partition by group, dim order by {value} rows between unbounded preceding and current row"
    return cells.withColumn("upto", F.expr(f"sum(rows) over ({w})")).withColumn(
        "all_rows", F.expr("sum(rows) over (partition by group, dim)")).where("2 * upto >= all_rows").groupBy(
            "group", "dim").agg(F.min(value).alias("middle"))


def median_start(vectors: DataFrame) -> DataFrame:
    """Estimates from the median and the median absolute deviation of each statistic."""
    # Counts of narrow cells, some thousands per group at most, so that no group is sorted.
    cells = vectors.select("group", F.posexplode("x").alias("dim", "v")).groupBy(
        "group", "dim", F.round(F.asinh("v") * _CELLS_PER_E).alias("cell")).agg(F.count(F.lit(1)).alias("rows"))
    cells = settled(cells.withColumn("value", F.sinh(F.col("cell") / _CELLS_PER_E)), "cells")
    middles = _middle(cells, "value")
    apart = cells.join(middles, ["group", "dim"]).withColumn("apart", F.abs(F.col("value") - F.col("middle")))
    spreads = _middle(apart.drop("middle"), "apart").withColumnRenamed("middle", "spread")
    held = middles.join(spreads, ["group", "dim"]).groupBy("group").agg(*[
        F.max(F.when(F.col("dim") == i, F.col(c))).alias(f"{c}{i}") for i in range(4) for c in ("middle", "spread")])
    # The deviation of normal rows is 1.4826 times the median absolute one.
    inverse = [F.round(1 / (F.pow(1.4826 * F.col(f"spread{i}"), 2) + FLOORS[i] ** 2), 9) if i == j else F.lit(0.0)
               for i in range(4) for j in range(4)]
    return held.select(
        "group", F.lit(1).alias("start"), F.array(*[F.round(f"middle{i}", 9) for i in range(4)]).alias("centre"),
        F.array(*inverse).alias("inverse"))


def robust_estimates(vectors: DataFrame, share: float) -> DataFrame:
    """group, centre, inverse covariance from (group, x) rows: the least determinant from both starts."""
    sums = [f"s{i}" for i in range(4)] + [f"p{i}{j}" for i, j in PAIRS]
    totals = [F.sum(c).alias(c) for c in ("rows", *sums)]
    names = ["group", "start", "centre", "inverse"]
    plain = _sums(vectors, "group").withColumn("start", F.lit(0)).withColumn("all_rows", F.col("rows"))
    # What a start itself estimates is not of the nearest rows and is no result.
    latest = settled(plain.mapInPandas(_estimates, _PARAMETERS).select(*names).unionByName(median_start(vectors))
                     .withColumn("determinant", F.lit(math.inf)).withColumn("falls", F.lit(True)), "estimates")
    every = []
    while latest.where("falls").limit(1).count():
        falling = latest.where("falls").withColumnRenamed("determinant", "last")
        near = vectors.join(falling, "group").withColumn(
            "class", F.floor(F.log(_distance() + 1e-6) * _CLASSES_PER_E))
        classes = settled(_sums(near, "group", "start", "class"), "classes")
        # A few hundred distance classes per group, whatever its size.
        w = "partition by group, start order by class rows between unbounded preceding and 1 preceding"
        placed = classes.withColumn("nearer", F.coalesce(F.expr(f"sum(rows) over ({w})"), F.lit(0)))
        sizes = classes.groupBy("group", "start").agg(F.sum("rows").alias("all_rows"))
        subset = placed.join(sizes, ["group", "start"]).where(F.col("nearer") < share * F.col("all_rows"))
        found = subset.groupBy("group", "start", "all_rows").agg(*totals).mapInPandas(_estimates, _PARAMETERS)
        latest = settled(found.join(falling.select("group", "start", "last"), ["group", "start"]).withColumn(
            "falls", F.col("determinant") < (1 - LEAST_FALL) * F.col("last")).drop("last"), "estimates")
        every.append(latest)
    best = reduce(DataFrame.unionByName, every).groupBy("group").agg(
        F.min(F.struct("determinant", "start", "centre", "inverse")).alias("best"))
    return settled(best.select("group", "best.centre", "best.inverse"), "estimates")


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                     source_col: str = "source", share: float = 0.5,
                     confidence: float = 0.999, smallest: int = 50) -> DataFrame:
    """One row per input row: doc_id, the measures, base_failed, kept, distance (squared; NULL where not judged)."""
    rows = texts(docs, id_col, text_col, group=F.to_json(F.struct(docs[lang_col], docs[source_col])))
    measured = settled(
        rows.mapInArrow(_measure, "doc_id bigint, group string, " + ", ".join(f"{m} bigint" for m in MEASURES))
        .withColumn("x", F.array(*_statistics()))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
            100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))), "measures")
    judged = measured.where("n_words > 0")
    sizes = judged.groupBy("group").agg(F.count(F.lit(1)).alias("members"))
    few = F.col("members") < smallest
    grouped = measured.join(sizes, "group", "left").withColumn(
        "group", F.when(F.col("members").isNull() | few, F.lit("few")).otherwise(F.col("group"))).drop("members")
    vectors = settled(grouped.where("n_words > 0").select("group", "x"), "vectors")
    # Too few rows in the pooled group: no estimate, hence no distance.
    enough = sizes.groupBy(F.when(few, F.lit("few")).otherwise(F.col("group")).alias("group")).agg(
        F.sum("members").alias("members")).where(F.col("members") >= smallest).select("group")
    estimates = robust_estimates(vectors, share).join(enough, "group", "left_semi")
    limit = chi_square_4(confidence)
    judged = grouped.join(estimates, "group", "left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= limit)
    return judged.withColumn("kept", kept).select("doc_id", *MEASURES, "base_failed", "kept", "distance")
