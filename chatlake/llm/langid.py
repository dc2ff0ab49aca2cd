"""Language identification by error-correcting output codes.

Each language has a codeword. For each bit a binary classifier on hashed byte
n-grams tells the languages whose codeword has that bit from the others: a naive
Bayes classifier, whose counts Spark sums over all training rows. Every segment of a text
gives a squashed vote per bit, and the mean of the votes is the margin. The margins of
all bits are decoded by loss: the language whose codeword costs least under the
logistic loss is chosen, so a bit that is unsure weighs little and a wrong bit is
corrected by the rest. A result is ambiguous when the second-best codeword costs
nearly as little.

What reaches the driver is one row per language and n-gram hash, at most
``BUCKETS`` per language whatever the corpus holds.

Results by case: NULL texts and texts without a letter are ``und`` with score 0;
without any labelled row every text is ``und``; repeated rows each get their row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chatlake.llm.common import texts
from chatlake.llm.wordhash import slices, text_bytes

ORDERS = (1, 2, 3)
BUCKETS = 1 << 14
# Bytes whose n-grams give one vote per bit.
SEGMENT = 96
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_BASE = np.uint64(0x9E3779B97F4A7C15)
# ASCII letters in lower case, other ASCII bytes as a space; bytes of other letters stay.
_FOLDED = np.array([b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256)], np.uint8)


def codewords(languages: int) -> np.ndarray:
    """Rows of +1 and -1. Few languages: every split of them once; many: random rows far apart."""
    if languages <= 7:
        splits = range(1, 2 ** max(languages - 1, 1))
        columns = [[1 if i == 0 or not (s >> (i - 1)) & 1 else -1 for i in range(languages)] for s in splits]
        return np.array(columns, np.float64).T.reshape(languages, -1)
    bits, rng = int(np.ceil(10 * np.log2(languages))), np.random.default_rng(7)
    best, apart = None, -1
    for _ in range(64):
        rows = rng.choice([-1.0, 1.0], (languages, bits))
        nearest = min(int((rows[i] != rows[i + 1:]).sum(axis=1).min()) for i in range(languages - 1))
        if nearest > apart and (np.abs(rows.sum(axis=0)) < languages).all():
            best, apart = rows, nearest
    return best


def _grams(data: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: bucket of every n-gram within a row, and where it starts."""
    data = _FOLDED[data].astype(np.uint64)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    shift = np.uint64(64 - int(np.log2(BUCKETS)))
    for n in ORDERS:
        count = len(data) - n + 1
        if count <= 0:
            continue
        key = np.full(count, n, np.uint64)
        for i in range(n):
            key = (key << np.uint64(8)) | data[i: i + count]
        inside = np.flatnonzero(row[:count] == row[n - 1:])
        yield ((key * _BASE) >> shift).astype(np.int64)[inside], inside


def _gram_counts(languages: list[str]):
    number = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * BUCKETS)
        for batch in batches:
            for part in slices(batch, "text"):
                lang = np.array([number[x] for x in part.column("lang").to_pylist()], np.int64)
                data, rows = text_bytes(part.column("text"))
                row = np.repeat(np.arange(part.num_rows), np.diff(rows))
                for bucket, at in _grams(data, rows):
                    total += np.bincount(lang[row[at]] * BUCKETS + bucket, minlength=len(total))
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [pa.array(at // BUCKETS, pa.int32()), pa.array(at % BUCKETS, pa.int32()), pa.array(total[at].astype(np.int64))],
                ["language", "bucket", "n"])
    return run


@dataclass(frozen=True)
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits: log odds of bit set against not set


def train(labelled: DataFrame) -> Model:
    """From rows (text, lang) with non-null lang; every row counts."""
    languages = sorted(r[0] for r in labelled.groupBy("lang").count().select("lang").collect())
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros((BUCKETS, 0)))
    counts = np.zeros((len(languages), BUCKETS))
    found = labelled.select("text", "lang").mapInArrow(_gram_counts(languages), "language int, bucket int, n bigint")
    for r in found.groupBy("language", "bucket").agg(F.sum("n").alias("n")).toArrow().to_batches():
        counts[np.asarray(r.column(0)), np.asarray(r.column(1))] = np.asarray(r.column(2))
    shares = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    codes = codewords(len(languages))
    weights = np.zeros((BUCKETS, codes.shape[1]))
    for bit in range(codes.shape[1]):
        of = codes[:, bit] > 0
        if of.any() and not of.all():
            weights[:, bit] = np.log(shares[of].mean(axis=0)) - np.log(shares[~of].mean(axis=0))
    return Model(languages, codes, weights)


def decode(margins: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword, its share of the likelihood, and whether another is nearly as near."""
    loss = np.logaddexp(0, -margins[:, None, :] * codes[None]).sum(axis=2)
    order = np.argsort(loss, axis=1, kind="stable")
    rows = np.arange(len(loss))
    share = np.exp(loss.min(axis=1, keepdims=True) - loss)
    score = share[rows, order[:, 0]] / share.sum(axis=1)
    return order[:, 0], score, score < 0.6


def _predict(model: Model):
    bits = model.codes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                strings = part.column("text").to_pylist()
                rows = len(strings)
                data, bounds = text_bytes(part.column("text"))
                # Segments vote, so a foreign passage weighs by its length and not by its odd letters.
                sizes = np.diff(bounds)
                segments = -(-sizes // SEGMENT)
                row = np.repeat(np.arange(rows), sizes)
                first = np.concatenate([[0], np.cumsum(segments)])
                segment = first[row] + (np.arange(len(data)) - bounds[row]) // SEGMENT
                votes = np.zeros((int(first[-1]), bits))
                for bucket, at in _grams(data, bounds):
                    for bit in range(bits):
                        votes[:, bit] += np.bincount(segment[at], model.weights[bucket, bit], len(votes))
                of = np.repeat(np.arange(rows), segments)
                margins = np.array([np.bincount(of, np.tanh(votes[:, bit] / 8), rows) for bit in range(bits)]).T
                margins = 6 * margins.reshape(rows, bits) / np.maximum(segments, 1)[:, None]
                known = np.array([bool(t and bits and _LETTER.search(t)) for t in strings], bool)
                if bits:
                    best, score, unsure = decode(margins, model.codes)
                else:
                    best, score, unsure = np.zeros(rows, int), np.zeros(rows), np.zeros(rows, bool)
                names = [model.languages[b] if k else UNDETERMINED for b, k in zip(best, known)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()),
                     pa.array(np.where(known, score, 0.0)), pa.array(np.where(known, unsure, True))],
                    ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])
    return run


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, ambiguous.

    Rows where ``held_out`` is true or the language is NULL teach nothing.
    """
    rows = texts(docs, id_col, text_col, lang=lang_col, held_out=F.coalesce(held_out, F.lit(False)))
    model = train(rows.where(~F.col("held_out") & F.col("lang").isNotNull()))
    return rows.select("doc_id", "text", "held_out").mapInArrow(
        _predict(model), "doc_id bigint, held_out boolean, lang_pred string, score double, ambiguous boolean")
