"""Alignment of two tokenizers: which token of one ends where a token of the other ends.

Both encode the same bytes (a space and the text). Where tokens of both end together the
text is cut into groups, and the two tokens that end there are linked. A link's strength
is how many links of the corpus hold the same pair of ids; it is the best of its second
id if no pair with that id has more.

Pairs are counted as an external sort counts them. A task gathers links up to
``RUN_LINKS``, sorts them by second id, first id and document, and writes them as one run
of zstd-compressed columns per radix, a hash of the second id: the pairs with their
totals, and the pair-document records. Per radix a heap merges the pairs of all runs (of
at most ``FAN_IN`` at once; more are first merged in groups). As pairs come in order of
the second id, its largest count is known when the next id comes, and at that moment the
counts of its pairs stream back, each to the runs that hold it. A run then adds them up
per document. In a run a pair is one entry however often it occurs, so no pair of ids can
be a hot key, and no task reads more than a run or the pairs of a radix.

Results by case: NULL and empty texts, and texts whose bytes do not come back from both
tokenizers, have no tokens (all figures 0, no digest); repeated rows each get their row
and each count; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import os
from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from chatlake.llm.common import settled, texts
from chatlake.llm.wordhash import slices

RUN_LINKS = 4 << 20
RUN_DOCS = 1 << 16
RADIXES = 64
FAN_IN = 256
_MARK = "▁"
# Pairs of a run that a merge holds as Python numbers at once.
_AHEAD = 4096
_FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
_HELD = ("run bigint, radix int, pairs binary, totals binary, places binary, docs binary, counts binary, "
         "place int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string")
_ANSWERS = "run bigint, radix int, strengths binary, best binary"
_OUT = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in _FIGURES) + ", groups_sha256 string"


def squeezed(values: np.ndarray, kind: str = "<u4") -> bytes:
    """Whole numbers as zstd, byte by byte of their width."""
    planes = np.ascontiguousarray(values, kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def widened(data: bytes, kind: str = "<u4") -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _byte_letters() -> dict[str, int]:
    """Fixed rule: byte-level vocabularies write printable bytes as themselves, others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokens:
    """Bytes and decimals of the ids of one tokenizer, by id."""

    def __init__(self, meaning: list[bytes], last: str):
        self.meaning = meaning
        self.sizes = np.array([len(m) for m in meaning], np.int64)
        if len(self.sizes) and not self.sizes.min():
            raise ValueError("a token without bytes ends nowhere of its own")
        # Decimals by id, with what follows inside a group and at its end.
        self.said = np.array([f"{i}{after}" for i in range(len(meaning)) for after in (",", last)], object)

    def spells(self, ids: list[int], data: bytes) -> bool:
        meaning = self.meaning
        return b"".join([meaning[i] for i in ids]) == data


class Aligner:
    """Encodes texts with both tokenizers and cuts them where tokens of both end."""

    def __init__(self, first_path: str, second_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        # Tasks share the machine already; threads per task would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.first = Tokenizer.from_file(first_path)
        self.first.no_truncation()
        self.first.no_padding()
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=second_path)
        letters = _byte_letters()
        entries = [self.first.id_to_token(i) for i in range(self.first.get_vocab_size(with_added_tokens=True))]
        added = {t.content for t in self.first.get_added_tokens_decoder().values()}
        self.a = Tokens([e.encode() if e in added else bytes(letters[c] for c in e) for e in entries], "|")
        pieces = [(i, self.second.id_to_piece(i)) for i in range(self.second.get_piece_size())]
        self.b = Tokens([bytes([int(p[3:-1], 16)]) if self.second.is_byte(i) else p.replace(_MARK, " ").encode()
                         for i, p in pieces], ";")

    def encode(self, strings: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both for each text; none for texts that either does not spell again."""
        first = self.first.encode_batch_fast([" " + t for t in strings], add_special_tokens=False)
        second = self.second.encode(strings, num_threads=1)
        out = []
        for text, a, b in zip(strings, (e.ids for e in first), second):
            data = b" " + text.encode()
            fits = bool(text) and self.a.spells(a, data) and self.b.spells(b, data)
            out.append((a, b) if fits else ([], []))
        return out

    def align(self, strings: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links, digest) per text; then pair key and text number per link."""
        encoded = self.encode(strings)
        n_a, n_b = (np.array([len(e[i]) for e in encoded], np.int64) for i in (0, 1))
        a = np.fromiter((i for e in encoded for i in e[0]), np.int64, int(n_a.sum()))
        b = np.fromiter((i for e in encoded for i in e[1]), np.int64, int(n_b.sum()))
        # Both spell the same bytes, so ends can be counted through all texts.
        ends_a, ends_b = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        size = int(ends_a[-1]) + 1 if len(a) else 1
        met_a, met_b = np.zeros(size, bool), np.zeros(size, bool)
        met_a[ends_a] = met_b[ends_b] = True
        cut_a, cut_b = met_b[ends_a], met_a[ends_b]
        last_a, last_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
        text_of = np.repeat(np.arange(len(strings)), n_a)[last_a]
        links = np.bincount(text_of, minlength=len(strings))
        # A group is its first tokens, then its second ones.
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        before = np.concatenate([np.zeros(1, np.int64), last_b + 1])
        said = np.empty(len(a) + len(b), object)
        said[np.arange(len(a)) + before[group_a]] = self.a.said[2 * a + cut_a]
        said[np.arange(len(b)) + (last_a + 1)[group_b] if len(b) else np.zeros(0, np.int64)] = self.b.said[2 * b + cut_b]
        told, at = [], 0
        for own_a, own_b, own in zip(n_a.tolist(), n_b.tolist(), links.tolist()):
            digest = ""
            if own_a:
                digest = hashlib.sha256("".join(said[at: at + own_a + own_b].tolist())[:-1].encode()).hexdigest()
            at += own_a + own_b
            told.append((own_a, own_b, own, own, digest))
        return told, b[last_b] * len(self.a.meaning) + a[last_a], text_of


@cache
def aligner(first_path: str, second_path: str) -> Aligner:
    return Aligner(first_path, second_path)


def radix_of(ids: np.ndarray, radixes: int) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)) * np.uint64(radixes) >> np.uint64(32)).astype(np.int64)


def _rows(fields: str, **columns) -> pa.RecordBatch:
    """A batch under a Spark schema, with NULL in columns that are not given."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    split = [f.split() for f in fields.split(", ")]
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[n], kinds[k]) if n in columns else pa.nulls(size, kinds[k]) for n, k in split], [n for n, _ in split])


def sorted_run(run: int, keys: np.ndarray, docs: np.ndarray, n_docs: int, first_ids: int, radixes: int) -> Iterator[pa.RecordBatch]:
    """One row per radix: pairs in order with totals, documents per pair, and documents with counts."""
    pairs, which, totals = np.unique(keys, return_inverse=True, return_counts=True)
    records, counts = np.unique(which * np.int64(n_docs) + docs, return_counts=True)
    owner, doc = records // n_docs, records % n_docs
    radix = radix_of(pairs // first_ids, radixes)
    order, record_order = np.argsort(radix, kind="stable"), np.argsort(radix[owner], kind="stable")
    places = np.bincount(owner, minlength=len(pairs))
    bounds = np.searchsorted(radix[order], np.arange(radixes + 1))
    record_bounds = np.searchsorted(radix[owner][record_order], np.arange(radixes + 1))
    for r in range(radixes):
        mine, own = order[bounds[r]: bounds[r + 1]], record_order[record_bounds[r]: record_bounds[r + 1]]
        if len(mine):
            yield _rows(_HELD, run=[run], radix=[r], pairs=[squeezed(np.diff(pairs[mine], prepend=0), "<u8")],
                        totals=[squeezed(totals[mine], "<u8")], places=[squeezed(places[mine])], docs=[squeezed(doc[own])],
                        counts=[squeezed(counts[own])])


def _gather(first_path: str, second_path: str, run_links: int, radixes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(first_path, second_path)
        # Unique within the one job that writes the runs; what is read later is the written table.
        numbers = count(TaskContext.get().partitionId() << 24)
        current, n_docs, held = next(numbers), 0, 0
        keys: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        for batch in batches:
            for part in slices(batch, "text"):
                told, found, text_of = both.align([t or "" for t in part.column("text").to_pylist()])
                n_a, n_b, n_groups, n_links, digests = zip(*told)
                yield _rows(_HELD, run=[current] * len(told), place=range(n_docs, n_docs + len(told)),
                            doc_id=part.column("doc_id").to_pylist(), n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_links,
                            groups_sha256=digests)
                keys.append(found)
                docs.append(text_of + n_docs)
                n_docs, held = n_docs + len(told), held + len(found)
                if held >= run_links or n_docs >= RUN_DOCS:
                    yield from sorted_run(current, np.concatenate(keys), np.concatenate(docs), n_docs, len(both.a.meaning), radixes)
                    current, n_docs, held, keys, docs = next(numbers), 0, 0, [], []
        if held:
            yield from sorted_run(current, np.concatenate(keys), np.concatenate(docs), n_docs, len(both.a.meaning), radixes)
    return run


def _merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int, list[int]]]:
    """(pair, total, runs that hold it) in order of the pairs, from runs of sorted pairs and totals."""
    def stream(number: int, pairs: np.ndarray, totals: np.ndarray) -> Iterator[tuple[int, int, int]]:
        for i in range(0, len(pairs), _AHEAD):
            yield from zip(pairs[i: i + _AHEAD].tolist(), [number] * _AHEAD, totals[i: i + _AHEAD].tolist())

    pair, total, holders = None, 0, []
    for key, number, n in heapq.merge(*(stream(i, *run) for i, run in enumerate(runs))):
        if key != pair:
            if holders:
                yield pair, total, holders
            pair, total, holders = key, 0, []
        total += n
        holders.append(number)
    if holders:
        yield pair, total, holders


def _opened(rows: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.cumsum(widened(p, "<u8").astype(np.int64)), widened(t, "<u8"))
            for p, t in zip(rows.column("pairs").to_pylist(), rows.column("totals").to_pylist())]


def _count(first_ids: int):
    """Merge the runs of a radix; strengths and bests go back to every run in its own order."""
    def run(rows: pa.Table) -> pa.Table:
        runs = _opened(rows)
        strengths: list[list[int]] = [[] for _ in runs]
        bests: list[list[bool]] = [[] for _ in runs]
        second, same = -1, []

        def tell() -> None:
            top = max(total for total, _ in same)
            for total, holders in same:
                for number in holders:
                    strengths[number].append(total)
                    bests[number].append(total == top)

        for pair, total, holders in _merged(runs):
            if pair // first_ids != second:
                if same:
                    tell()
                second, same = pair // first_ids, []
            same.append((total, holders))
        if same:
            tell()
        return pa.Table.from_batches([_rows(
            _ANSWERS, run=rows.column("run").to_pylist(), radix=rows.column("radix").to_pylist(),
            strengths=[squeezed(np.array(s), "<u8") for s in strengths], best=[squeezed(np.array(s), "u1") for s in bests])])
    return run


_NODES = "run bigint, radix int, pairs binary, totals binary"


def _combine(rows: pa.Table) -> pa.Table:
    """One run of the pairs of several."""
    found = [(pair, total) for pair, total, _ in _merged(_opened(rows))]
    pairs, totals = (np.array(x, np.int64) for x in zip(*found))
    return pa.Table.from_batches([_rows(
        _NODES, run=[rows.column("parent")[0].as_py()], radix=[rows.column("radix")[0].as_py()],
        pairs=[squeezed(np.diff(pairs, prepend=0), "<u8")], totals=[squeezed(totals, "<u8")])])


def _passed_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A run's share of the answers that the run it was merged into got."""
    for batch in batches:
        for row in batch.to_pylist():
            own, of = (np.cumsum(widened(row[c], "<u8").astype(np.int64)) for c in ("pairs", "of_pairs"))
            at = np.searchsorted(of, own)
            yield _rows(_ANSWERS, run=[row["run"]], radix=[row["radix"]], strengths=[squeezed(widened(row["strengths"], "<u8")[at], "<u8")],
                        best=[squeezed(widened(row["best"], "u1")[at], "u1")])


def pair_strengths(runs: DataFrame, first_ids: int, fan_in: int = FAN_IN) -> DataFrame:
    """Answers (run, radix, strengths, best) for runs (run, radix, pairs, totals), pair by pair in their order."""
    level, levels = runs.select("run", "radix", "pairs", "totals"), []
    while (held := level.select("run").distinct().count()) > fan_in:
        groups = math.ceil(held / fan_in)
        level = level.withColumn("parent", F.pmod(F.xxhash64("run"), F.lit(groups)))
        levels.append(level)
        merged = level.select("run", "radix", "parent", "pairs", "totals").groupBy("radix", "parent").applyInArrow(_combine, _NODES)
        level = settled(merged, "merged_pairs")
    answers = level.groupBy("radix").applyInArrow(_count(first_ids), _ANSWERS)
    for below in reversed(levels):
        of = level.select(F.col("run").alias("parent"), "radix", F.col("pairs").alias("of_pairs")).join(
            answers.withColumnRenamed("run", "parent"), ["parent", "radix"])
        answers = below.join(of, ["parent", "radix"]).select("run", "radix", "pairs", "of_pairs", "strengths", "best").mapInArrow(
            _passed_down, _ANSWERS)
        level = below
    return answers


def _add_up(parts: pa.Table, docs: pa.Table) -> pa.Table:
    """Sums of a run's strengths per document, beside what is known of the documents."""
    n_best, sums = (np.zeros(docs.num_rows, np.int64) for _ in range(2))
    answers = {r["radix"]: r for r in parts.select(["radix", "strengths", "best"]).to_pylist() if r["strengths"] is not None}
    for r in parts.select(["radix", "places", "docs", "counts"]).to_pylist():
        if r["docs"] is not None:
            places, doc, counts = (widened(r[c]) for c in ("places", "docs", "counts"))
            counts, answer = counts.astype(np.int64), answers[r["radix"]]
            np.add.at(sums, doc, counts * np.repeat(widened(answer["strengths"], "<u8").astype(np.int64), places))
            np.add.at(n_best, doc, counts * np.repeat(widened(answer["best"], "u1").astype(np.int64), places))
    place = np.asarray(docs.column("place"))
    kept = {c: docs.column(c).to_pylist() for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    return pa.Table.from_batches([_rows(_OUT, **kept, n_best=n_best[place], count_sum=sums[place])])


def align(docs: DataFrame, first_path: str, second_path: str, id_col: str = "doc_id", text_col: str = "text",
          run_links: int = RUN_LINKS, radixes: int = RADIXES, fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``first_path`` is a byte-level tokenizer file, which encodes a space and the text;
    ``second_path`` a sentencepiece model, which puts the space there itself. The
    digest is of the ids of all groups: ``a1,a2|b1;a3|b2,b3``.
    """
    held = settled(texts(docs, id_col, text_col).mapInArrow(_gather(first_path, second_path, run_links, radixes), _HELD), "pair_runs")
    runs = held.where("radix IS NOT NULL")
    answers = pair_strengths(runs, len(aligner(first_path, second_path).a.meaning), fan_in)
    parts = runs.select("run", "radix", "places", "docs", "counts").unionByName(answers, allowMissingColumns=True)
    known = held.where("place IS NOT NULL").select(F.col("run").alias("of_run"), "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return parts.groupBy("run").cogroup(known.groupBy("of_run")).applyInArrow(_add_up, _OUT)
