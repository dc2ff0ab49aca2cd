"""BPE encoding and decoding over a table of distinct words.

Words are the runs between ASCII white space: the tokenizer drops white space before it
merges, and neither its normaliser nor its special tokens reach across a space, so a
word has the same ids wherever it stands. Every distinct word of the corpus is encoded
once.

Ids return to their places in two ways. The ``frequent`` most frequent words (of at most
``WORD_BYTES`` bytes, hence a table of bounded size) go to all tasks as sorted 64-bit
hashes with their ids, and a text becomes a compact string of their numbers. The other
words, one row per text and distinct word, are joined by word and come back by the number of the
text's row, as entries of a few bytes; the texts themselves are written by that number and do
not move again.
A hot word is therefore never a join key. A frequent word whose hash any other word of
the corpus shares is taken off the frequent ones, so a hash never decides wrongly.

Ids become pieces through the id-to-piece table, which has one row per id of the
vocabulary, whatever the corpus holds, and is looked up where a text is put together.

Results by case: NULL and empty texts have no ids (the digests are those of the
empty string); repeated rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from chatlake.llm.common import bucketed, settled, texts
from chatlake.llm.wordhash import Words, slices

FREQUENT = 1 << 20
WORD_BYTES = 64
# Distinct words a worker gathers before it passes their counts on.
GATHERED = 300_000
# Words whose codes lie in one file.
BUCKET_WORDS = 4_000_000


def words_of(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8; bytes, unlike strings, are split at ASCII white space alone."""
    return text.split()


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    # Tasks share the machine already; threads per task would only wait for each other.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if tokenizer.decoder is not None:
        raise ValueError("pieces are joined by spaces, as a tokenizer without a decoder does")
    return tokenizer


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """Every id of the vocabulary and its piece: as many rows as the tokenizer has ids."""
    tokenizer = _tokenizer(path)
    rows = [(i, tokenizer.id_to_token(i)) for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
    return spark.createDataFrame([r for r in rows if r[1] is not None], "id int, piece string")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def table() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for part in slices(batch, "text"):
            for text in part.column("text").cast(pa.binary()).to_pylist():
                if text:
                    counts.update(words_of(text))
            if len(counts) > GATHERED:
                yield table()
                counts.clear()
    if counts:
        yield table()


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            encoded = [e.ids for e in tokenizer.encode_batch_fast(batch.column("word").to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n"), pa.array(encoded, pa.list_(pa.int32()))], ["word", "n", "ids"])
    return run


def word_table(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """word, n (occurrences), ids of every distinct word; one shuffle, on the word."""
    counted = docs.mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(_encode(tokenizer_path), "word string, n bigint, ids array<int>")


class Frequent(NamedTuple):
    """Words by number: sorted hashes with the number of each, and the ids of all in a row."""

    hashes: np.ndarray
    numbers: np.ndarray
    ids: np.ndarray
    starts: np.ndarray


def _found(ordered: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` are in ``ordered``, and where."""
    if not len(ordered):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
    return ordered[at] == wanted, at


def _hashes_of(words: pa.Array) -> np.ndarray:
    return Words(words).hashes()  # each is one word


def _sharing(hashes: np.ndarray):
    """Hashes of frequent words that some other word has as well."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = _hashes_of(batch.column("word"))
                shared = own[_found(hashes, own)[0]]
                yield pa.RecordBatch.from_arrays([pa.array(shared.view(np.int64))], ["hash"])
    return run


def most_frequent(table: DataFrame, limit: int) -> tuple[Frequent, DataFrame]:
    """At most ``limit`` words of bounded length that occur most, and the rows of all other words.

    The frequency from which on they fit is read off a table of a few hundred
    classes, so no more rows than those asked for reach the driver.
    """
    short = F.octet_length("word") <= WORD_BYTES
    frequency = F.floor(F.log2("n") * 16)
    classes = sorted(table.where(short).groupBy(frequency.alias("class")).count().collect(), reverse=True)
    held, least = 0, None
    for row in classes:
        held += row["count"]
        if held > limit:
            break
        least = row["class"]
    chosen = short & (frequency >= least) if least is not None else F.lit(False)
    found = table.where(chosen).select("word", "n", "ids").toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    found = found.combine_chunks()
    lists = found.column("ids").combine_chunks()
    hashes = _hashes_of(found.column("word").combine_chunks()) if found.num_rows else np.zeros(0, np.uint64)
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    rest = table.where(~chosen)
    clashes = {r["hash"] for r in rest.select("word").mapInArrow(_sharing(hashes), "hash bigint").collect()}
    clashes |= set(hashes[1:][hashes[1:] == hashes[:-1]].view(np.int64).tolist())
    alone = ~np.isin(hashes.view(np.int64), list(clashes)) if clashes else np.ones(len(hashes), bool)
    starts = np.asarray(lists.offsets).astype(np.int32) if found.num_rows else np.zeros(1, np.int32)
    ids = np.asarray(lists.values).astype(np.int32) if found.num_rows else np.zeros(0, np.int32)
    ids = ids.astype(np.uint16) if not len(ids) or ids.max() < 1 << 16 else ids
    frequent = Frequent(hashes[alone], order[alone].astype(np.int32), ids, starts)
    # A frequent word that shares its hash is looked up like a rare one.
    return frequent, table if clashes else rest


def packed(numbers: np.ndarray) -> bytes:
    """Numbers in two bytes below 0xFF00; larger ones add two, those from 0xFF0000 on four.

    The first two bytes of a larger number are 0xFF00 and its third byte, or 0xFFFF.
    """
    high = np.minimum(numbers >> 16, 0xFF)
    wide = numbers >= 0xFF00
    parts = (np.array([len(numbers)], "<u4"), np.where(wide, 0xFF00 | high, numbers).astype("<u2"),
             (numbers[wide] & 0xFFFF).astype("<u2"), (numbers[wide & (high == 0xFF)] >> 16).astype("<u2"))
    return b"".join(p.tobytes() for p in parts)


def unpacked(data: bytes) -> np.ndarray:
    count = int(np.frombuffer(data, "<u4", 1)[0])
    raw = np.frombuffer(data, "<u2", offset=4).astype(np.int64)
    out, extra = raw[:count], raw[count:]
    wide = np.flatnonzero(out >= 0xFF00)
    high, low, top = out[wide] & 0xFF, extra[: len(wide)], extra[len(wide):]
    high[high == 0xFF] = top
    out[wide] = low | (high << 16)
    return out


def _unit(size: int) -> np.dtype:
    """What an id of a vocabulary of that size takes in an entry."""
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def _entries(unit: np.dtype):
    """Rare words of texts as short byte strings: place (four bytes), ids."""
    head = 4 // unit.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("ids")
                sizes = np.diff(np.asarray(ids.offsets))
                ends = np.cumsum(sizes + head)
                starts = ends - sizes - head
                data, heads = np.empty(int(ends[-1]), unit), np.zeros(int(ends[-1]), bool)
                places = np.asarray(batch.column("place")).astype("<u4").view(unit).reshape(-1, head)
                for i in range(head):
                    data[starts + i], heads[starts + i] = places[:, i], True
                data[~heads] = np.asarray(ids.flatten())
                offsets = np.append(0, ends * unit.itemsize).astype(np.int32)
                entries = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([batch.column("row"), entries], ["row", "entry"])
    return run


def _own_ids(entries: pa.Array, unit: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of one text in a row, and by place where its ids start there and how many they are."""
    head = 4 // unit.itemsize
    if entries is None or not len(entries):
        return np.zeros(0, unit), np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.frombuffer(entries.buffers()[1], np.int32)[entries.offset: entries.offset + len(entries) + 1].astype(np.int64)
    data = np.frombuffer(entries.buffers()[2], np.uint8)[offsets[0]: offsets[-1]].view(unit)
    bounds = (offsets - offsets[0]) // unit.itemsize
    places = data[bounds[:-1, None] + np.arange(head)].view("<u4").ravel()
    starts, sizes = np.empty(len(places), np.int64), np.empty(len(places), np.int64)
    starts[places], sizes[places] = bounds[:-1] + head, np.diff(bounds) - head
    return data, starts, sizes


def _codes(frequent: Frequent):
    """Texts as numbers of frequent words; other words get the numbers after those, text by text."""
    # Only what a stage needs is sent to its tasks.
    known, ordered, number = len(frequent.starts) - 1, frequent.hashes, frequent.numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                # A hash is looked up once per slice.
                kinds, distinct = pd.factorize(words.hashes())
                here, at = _found(ordered, distinct)
                numbers_of = np.full(len(distinct), -1, np.int64)
                numbers_of[here] = number[at[here]]
                numbers = numbers_of[kinds]
                places = np.flatnonzero(numbers < 0)
                data, bounds = words.data.tobytes(), np.searchsorted(places, words.first).tolist()
                spans = list(zip(words.starts[places].tolist(), words.ends[places].tolist()))
                codes, rest, ends = [], [], [0]
                for a, b, first, last in zip(words.first[:-1], words.first[1:], bounds, bounds[1:]):
                    rare: dict[bytes, int] = {}
                    numbers[places[first:last]] = [known + rare.setdefault(data[x:y], len(rare)) for x, y in spans[first:last]]
                    codes.append(compress(packed(numbers[a:b])))
                    rest += rare
                    ends.append(len(rest))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rest, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(codes, pa.binary()), lists],
                                                 ["doc_id", "row", "codes", "rare"])
    return run


_OUT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _assemble(frequent: Frequent, pieces: list[str], with_texts: bool):
    frequent_ids, frequent_starts = frequent.ids, frequent.starts
    decimals, unit = [str(i) for i in range(len(pieces))], _unit(len(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                rows, part = [], batch.slice(first, 64)
                for doc_id, codes, rare in zip(part.column("doc_id").to_pylist(), part.column("codes").to_pylist(), part.column("rare")):
                    numbers = unpacked(decompress(codes))
                    own, own_starts, own_sizes = _own_ids(rare.values, unit)
                    starts, sizes = _bounds(frequent_starts, own_starts, own_sizes, numbers)
                    ends = np.cumsum(sizes)
                    at = np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
                    common = at < len(frequent_ids)
                    if common.all():
                        ids = frequent_ids[at]
                    else:
                        ids = np.empty(len(at), np.int32)
                        ids[common] = frequent_ids[at[common]]
                        ids[~common] = own[at[~common] - len(frequent_ids)]
                    chosen = ids.tolist()
                    ids_text = " ".join([decimals[i] for i in chosen])
                    decoded = " ".join([pieces[i] for i in chosen])
                    rows.append((doc_id, len(chosen), hashlib.sha256(ids_text.encode()).hexdigest(),
                                 hashlib.sha256(decoded.encode()).hexdigest(), *((ids_text, decoded) if with_texts else ())))
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), *[pa.string()] * 4))]
                    yield pa.RecordBatch.from_arrays(
                        columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])
    return run


def _bounds(frequent_starts: np.ndarray, own_starts: np.ndarray, own_sizes: np.ndarray,
            numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the ids of each word start in the frequent ids followed by the text's own, and how many they are."""
    known = len(frequent_starts) - 1
    if not len(own_starts):
        starts = frequent_starts[numbers].astype(np.int64)
        return starts, frequent_starts[numbers + 1] - starts
    rare = numbers >= known
    starts, sizes = np.empty_like(numbers), np.empty_like(numbers)
    common = numbers[~rare]
    starts[~rare] = frequent_starts[common]
    sizes[~rare] = frequent_starts[common + 1] - frequent_starts[common]
    starts[rare], sizes[rare] = int(frequent_starts[-1]) + own_starts[numbers[rare] - known], own_sizes[numbers[rare] - known]
    return starts, sizes


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                  frequent: int = FREQUENT, with_texts: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, unless left out, ids and decoded.

    ``ids`` are the decimal ids joined by spaces, ``decoded`` the pieces of those ids
    joined by spaces.
    """
    rows = texts(docs, id_col, text_col)
    # Written by word, so that only the rare words of texts move to it later.
    table = bucketed(word_table(rows, tokenizer_path), "words", "word")
    top, others = most_frequent(table, frequent)
    pieces = piece_table(docs.sparkSession, tokenizer_path).orderBy("id").toArrow()
    by_id = [""] * (pieces.column("id")[-1].as_py() + 1)
    for i, piece in zip(pieces.column("id").to_pylist(), pieces.column("piece").to_pylist()):
        by_id[i] = piece
    words = table.agg(F.sum("n")).first()[0] or 0
    # Texts are coded once and written by the number of their row, so that they wait there for the ids of their rare words.
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    coded = bucketed(numbered.mapInArrow(_codes(top), "doc_id bigint, row bigint, codes binary, rare array<string>"),
                     "codes", "row", max(8, min(100_000, words // BUCKET_WORDS)))
    rare = coded.select("row", F.posexplode("rare").alias("place", "word"))
    found = rare.join(others.select("word", "ids"), "word").select("row", "place", "ids")
    found = settled(found.mapInArrow(_entries(_unit(len(by_id))), "row bigint, entry binary"), "rare_words")
    by_text = found.groupBy(F.col("row").alias("found_row")).agg(F.collect_list("entry").alias("rare"))
    joined = coded.select("doc_id", "row", "codes").join(by_text, F.col("row") == F.col("found_row"), "left")
    out = _OUT + (", ids string, decoded string" if with_texts else "")
    return joined.select("doc_id", "codes", "rare").mapInArrow(_assemble(top, by_id, with_texts), out)
