"""Repeated passages across documents, by compaction of a token de Bruijn graph.

An edge of the graph is a window of ``WINDOW`` consecutive words, from its first to its
last words but one. Only edges of several documents matter, so windows are thinned
first: every window is represented by the ``ANCHOR``-word run in it that hashes lowest,
which equal windows share, and only windows whose anchor occurs in several documents
become edges. Each edge learns its source, the first place of the smallest document
that holds it. Edges that follow each other both in a document and in its source lie on
a path without branches; a join of every edge with its predecessor finds where paths
begin, and the rest of a path is compacted into one span with source coordinates.
Words at both ends of every span are compared by digest, so window hashes alone are never
taken for proof: if a span differs from its source, words with equal hashes have met, and
the search is made anew with hashes of another kind.

A document with the same words as an earlier one takes no part in the graph: if it has
a window at all, all its words go. Rows of the aggregation are windows, combined before
the shuffle; joins on a hot window or a hot source document split.

Results by case: NULL and empty texts have no words; texts shorter than a window lose
nothing; rows that share a doc_id do not remove each other's words; a NULL doc_id is
neither a source nor cleaned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from chatlake.llm.common import settled, texts
from chatlake.llm.wordhash import Words, mixed, slices, window_hashes

WINDOW = 50
ANCHOR = 20
_OTHER = np.uint64(0xA0761D6478BD642F)
# Spans of one source document that are compared beside one copy of its text.
SOURCE_SPANS = 4096
# Searches with other hashes before the job gives up; words that collide in two kinds are not to be expected.
SEARCHES = 3
# A document may have rows with several texts: a row is known by its id and its text's hash.
KEY = ["doc_id", "mark"]


def anchors_of(runs: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """For every window, where the lowest of its ``anchor``-word runs starts; ``runs`` are all their hashes."""
    span = window - anchor + 1
    count = len(runs) - span + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    # Running minimum with the first of equals, by doubling the reach.
    best, place, reach = runs, np.arange(len(runs)), 1
    while reach < span:
        step = min(reach, span - reach)
        later = best[step:] < best[:-step]
        place = np.where(later, place[step:], place[:-step])
        best = np.where(later, best[step:], best[:-step])
        reach += step
    return place[:count]


def _joined(words: Words, at: slice | np.ndarray) -> bytes:
    """The chosen words with one space between them."""
    return b" ".join(words.data[a:b].tobytes() for a, b in zip(words.starts[at], words.ends[at]))


def _signed(digits: str) -> int:
    value = int(digits, 16)
    return value - (1 << 64) if value >> 63 else value


def _batch(rows: list[tuple], schema: str, kinds: tuple) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


_DOCUMENTS = ("doc_id bigint, mark bigint, n_words bigint, words_a bigint, words_b bigint, "
              "all_sha256 string, anchors array<bigint>")


def _summarise(window: int, anchor: int, seed: int = 0):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, rows = Words(part.column("text")), []
                hashes = words.hashes(seed=seed)
                for doc_id, mark, a, b in zip(part.column("doc_id").to_pylist(), part.column("mark").to_pylist(),
                                              words.first[:-1], words.first[1:]):
                    digest = hashlib.sha256(_joined(words, slice(a, b))).hexdigest()
                    runs = window_hashes(hashes[a:b], anchor)
                    at = np.unique(anchors_of(runs, window, anchor))
                    rows.append((doc_id, mark, b - a, _signed(digest[:16]), _signed(digest[16:32]), digest,
                                 np.unique(runs[at]).view(np.int64)))
                yield _batch(rows, _DOCUMENTS, (*[pa.int64()] * 5, pa.string(), pa.list_(pa.int64())))
    return run


_EDGES = "doc_id bigint, mark bigint, at bigint, edge_a bigint, edge_b bigint"


def _edges(window: int, anchor: int, seed: int = 0):
    """Windows of a document whose anchor is among its shared ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                hashes = words.hashes(seed=seed)
                for doc_id, mark, shared, a, b in zip(*(part.column(c).to_pylist() for c in KEY),
                                                      part.column("shared"), words.first[:-1], words.first[1:]):
                    own = hashes[a:b]
                    runs = window_hashes(own, anchor)
                    at = np.flatnonzero(np.isin(
                        runs.view(np.int64)[anchors_of(runs, window, anchor)], np.asarray(shared.values)))
                    if len(at):
                        first, second = window_hashes(own, window), window_hashes(mixed(own ^ _OTHER), window)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), doc_id)), pa.array(np.full(len(at), mark)), pa.array(at),
                             pa.array(first[at].view(np.int64)), pa.array(second[at].view(np.int64))],
                            [*KEY, "at", "edge_a", "edge_b"])
    return run


def compacted(edges: DataFrame) -> DataFrame:
    """Spans (KEY, start, edges, source, source_start) from edges (KEY, at, source, source_at).

    A path begins at every edge without a predecessor in both texts; the beginning
    nearest before an edge is that of its path.
    """
    step = ["at", "source", "source_at"]
    before = edges.select(*KEY, (F.col("at") + 1).alias("at"), "source", (F.col("source_at") + 1).alias("source_at"),
                          F.lit(True).alias("follows"))
    placed = edges.join(before, [*KEY, *step], "left")
    begins = F.when(F.col("follows"), 0).otherwise(1)
    numbered = placed.withColumn("path", F.sum(begins).over(Window.partitionBy(*KEY).orderBy("at")))
    return numbered.groupBy(*KEY, "path").agg(
        F.min("at").alias("start"), F.count(F.lit(1)).alias("edges"), F.min("source").alias("source"),
        F.min("source_at").alias("source_start")).drop("path")


def _digest(words: Words, first: int, begin: int, length: int) -> str:
    return hashlib.blake2b(_joined(words, slice(first + begin, first + begin + length)), digest_size=16).hexdigest()


_CLEANED = ("doc_id bigint, mark bigint, n_removed bigint, kept_sha256 string, "
            "digests array<struct<start: bigint, digest: string>>")


def _clean(window: int, with_text: bool):
    """What is left of a document, and the digests of its spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, rows = Words(part.column("text")), []
                for doc_id, mark, spans, a, b in zip(*(part.column(c).to_pylist() for c in (*KEY, "spans")),
                                                     words.first[:-1], words.first[1:]):
                    gone = np.zeros(b - a + 1, np.int64)
                    for s in spans:
                        gone[s["start"]] += 1
                        gone[s["start"] + s["edges"] + window - 1] -= 1
                    kept = a + np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                    text = _joined(words, kept)
                    digests = [{"start": s["start"], "digest": _digest(words, a, s["start"], s["edges"] + window - 1)}
                               for s in spans]
                    rows.append((doc_id, mark, b - a - len(kept), hashlib.sha256(text).hexdigest(), digests,
                                 *([text.decode()] if with_text else [])))
                pairs = pa.list_(pa.struct([("start", pa.int64()), ("digest", pa.string())]))
                names = "doc_id, mark, n_removed, kept_sha256, digests" + (", kept_text" if with_text else "")
                yield _batch(rows, names, (*[pa.int64()] * 3, pa.string(), pairs, pa.string()))
    return run


def _source_digests(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, rows = Words(part.column("text")), []
                for spans, a in zip(part.column("spans").to_pylist(), words.first):
                    rows += [(s["doc_id"], s["mark"], s["start"], _digest(words, a, s["source_start"], s["edges"] + window - 1))
                             for s in spans]
                yield _batch(rows, "doc_id, mark, start, digest", (*[pa.int64()] * 3, pa.string()))
    return run


def _shared_anchors(held: DataFrame) -> DataFrame:
    """Per document (KEY) the anchors that other documents have too."""
    anchors = held.select(*KEY, F.explode("anchors").alias("anchor"))
    several = anchors.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = anchors.join(several.where("low < high").select("anchor"), "anchor")
    return shared.groupBy(*KEY).agg(F.collect_set("anchor").alias("shared"))


def _sourced(edges: DataFrame) -> DataFrame:
    """Edges with a source in a smaller document: the first place of the smallest."""
    # One number orders by document, then place, so that the minimum is combined before the shuffle.
    width = F.lit(2**40).cast("decimal(38,0)")
    place = (F.col("doc_id").cast("decimal(20,0)") * F.lit(2**40).cast("decimal(14,0)") + F.col("at")).cast("decimal(38,0)")
    first = edges.groupBy("edge_a", "edge_b").agg(F.min(place).alias("place"), F.max("doc_id").alias("last"))
    source = F.floor(F.col("place") / width).cast("bigint")
    first = first.withColumn("source", source).where("last > source").select(
        "edge_a", "edge_b", "source", (F.col("place") - F.col("source") * width).cast("bigint").alias("source_at"))
    # Written, so that the join below has a shuffle of its own on both sides and a hot window can be split at run time.
    first = settled(first, "sources")
    return edges.join(first, ["edge_a", "edge_b"]).where("doc_id > source").select(
        *KEY, "at", "source", "source_at").distinct()


def _checked(spans: DataFrame, cleaned: DataFrame, involved: DataFrame, window: int) -> DataFrame:
    """Spans whose words differ from those at their source coordinates."""
    mine = cleaned.select(*KEY, F.explode("digests").alias("own")).select(*KEY, "own.start", "own.digest")
    # The spans of a hot source are dealt over as many rows as they need.
    sizes = spans.groupBy(F.col("source").alias("source_id")).agg(
        F.ceil(F.count(F.lit(1)) / SOURCE_SPANS).cast("bigint").alias("parts"))
    part = F.pmod(F.xxhash64(*KEY, "start"), F.col("parts"))
    lists = spans.join(sizes, F.col("source") == F.col("source_id")).groupBy("source_id", part.alias("part")).agg(
        F.collect_list(F.struct(*KEY, "start", "edges", "source_start")).alias("spans"))
    sources = involved.join(lists, F.col("doc_id") == F.col("source_id")).select("text", "spans")
    theirs = sources.mapInArrow(_source_digests(window), "doc_id bigint, mark bigint, start bigint, digest string")
    return mine.join(theirs, [*KEY, "start", "digest"], "left_anti")


_SAME = ["words_a", "words_b", "n_words"]


def _searched(rows: DataFrame, window: int, anchor: int, with_text: bool, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """Summaries, first holders of equal word sequences, cleaned documents, and whether any span differs from its source."""
    summary = settled(rows.mapInArrow(_summarise(window, anchor, seed), _DOCUMENTS), "documents")
    named = summary.where("doc_id is not null")
    first = named.groupBy(*_SAME).agg(F.min("doc_id").alias("first_id"))
    firsts = first.where(F.col("n_words") >= window).withColumnRenamed("first_id", "doc_id")
    held = named.join(firsts, ["doc_id", *_SAME], "left_semi")
    shared = settled(_shared_anchors(held.select(*KEY, "anchors")), "shared")
    # The one time that whole texts move; documents that share nothing stay behind.
    involved = settled(rows.join(shared, KEY).select(*KEY, "text", "shared"), "involved")
    edges = settled(involved.mapInArrow(_edges(window, anchor, seed), _EDGES), "edges")
    spans = settled(compacted(settled(_sourced(edges), "sourced")), "spans")
    lists = spans.groupBy(*KEY).agg(F.collect_list(F.struct("start", "edges")).alias("spans"))
    cleaned = settled(involved.join(lists, KEY).select(*KEY, "text", "spans").mapInArrow(
        _clean(window, with_text), _CLEANED + (", kept_text string" if with_text else "")).dropDuplicates(KEY), "cleaned")
    differ = _checked(spans, cleaned, involved, window).limit(1).count() > 0
    return summary, first, cleaned, differ


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, and kept_text if asked.

    A word goes when a window of ``window`` words that covers it also starts in a
    document with a smaller doc_id. ``kept_text`` is the kept words joined by one
    space, NULL for a document that lost nothing.
    """
    rows = texts(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    for seed in range(SEARCHES):
        summary, first, cleaned, differ = _searched(rows, window, anchor, with_text, seed)
        if not differ:
            break
    else:
        raise RuntimeError("spans differ from the words at their source coordinates, whatever the hash")
    none = hashlib.sha256(b"").hexdigest()
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= window)
    kept = [F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []
    found = summary.drop("anchors").join(first, _SAME, "left").join(cleaned.drop("digests"), KEY, "left")
    return found.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(copy, F.lit(none)).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"), *kept,
        *(["mark"] if with_text else []))
