"""Best-fit packing of tokenised documents into sequences, by bin completion.

Lengths are whole numbers up to the capacity, so a table of how many pieces have
each length (``capacity`` rows at most, however many documents there are) holds all
that packing depends on. The plan is made on that table. First a few plans are made
without turning back: around the largest length left, the filling with the least waste
(which totals the smaller lengths can still reach is known exactly), as often as the counts
allow. Where the best of them misses the lower bound, bin completion starts from it: the
sequence of the largest length left is branched on its undominated fillings, least waste
first, each as often as possible and then less often; a branch is cut off when the lower
bound of what is left cannot beat the best plan, or the same counts were left before with
no more sequences. The search ends when the bound is met, when nothing is left to try (the
plan is then the best there is), or after ``nodes`` steps; with ``nodes=None`` it goes on
until one of the first two holds.

Pieces then take places by their rank within their length. Ranks come from counts
per (length, bucket), with buckets by hash, so a length that a third of all pieces
have is numbered by many tasks.

Results by case: NULL and empty texts are one piece holding the end token alone;
repeated rows are packed each for itself; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from chatlake.llm.common import hashed_to, settled, texts
from chatlake.llm.wordhash import slices

CAPACITY = 1024
END_ID = 2
# Parts in which the pieces of one length are numbered.
BUCKETS = 512
# Steps of the search for a better plan, each well under a millisecond on most tables.
NODES = 20_000
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_PLACED = _PIECES + ", sequence_id bigint, offset bigint"


# Fixed value: how byte-level BPE cuts text before it merges.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# White space or letters on which the two libraries might not agree.
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa1-\u024f]")


def _byte_letters() -> dict[str, int]:
    """Fixed rule: byte-level vocabularies write printable bytes as themselves, others from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}


def _parts_below(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What merging by rank leaves of a vocabulary entry before the entry itself is formed."""
    parts, own = [piece[i: i + 1] for i in range(len(piece))], ranks[piece]
    while len(parts) > 2:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], own), i) for i in range(len(parts) - 1))
        if rank >= own:
            break
        parts[at: at + 2] = [parts[at] + parts[at + 1]]
    return parts


@cache
def merges_by_rank(path: str) -> bool:
    """Whether merging by id gives the ids of this file for every text.

    So it is if texts are cut by the usual pattern alone, merges come in the order of
    their ids, and every entry falls apart into just the two parts that its merge
    names: then a pair is joined by rank exactly when the file joins it.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    plain = (spec["normalizer"] is None and spec["post_processor"] is None and cut.get("type") == "ByteLevel"
             and cut.get("use_regex", True) and not cut.get("add_prefix_space") and model.get("type", "BPE") == "BPE"
             and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
                                                "byte_fallback", "ignore_merges")))
    added = {t["content"] for t in spec["added_tokens"]}
    letters = _byte_letters()
    entries = {p: i for p, i in model["vocab"].items() if p not in added}
    if not plain or any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return False
    if not all(c in letters for p in entries for c in p) or not all(c in entries for c in letters):
        return False
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [entries.get(a + b, -1) for a, b in pairs]
    if ids != sorted(set(ids)) or len(ids) + 256 != len(entries) or min(ids, default=0) < 0:
        return False
    spelled = {p: bytes(letters[c] for c in p) for p in entries}
    ranks = {spelled[p]: i for p, i in entries.items()}
    return all(_parts_below(spelled[a + b], ranks) == [spelled[a], spelled[b]] for a, b in pairs)


def _rank_encoder(tokenizer):
    """The same vocabulary for the library that merges by rank: ids are the order of merges."""
    import tiktoken

    byte = _byte_letters()
    added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    ranks = {bytes(byte[c] for c in piece): i for piece, i in tokenizer.get_vocab().items() if piece not in added}
    return tiktoken.Encoding("ranks", pat_str=_CUT, mergeable_ranks=ranks, special_tokens=added)


class TextEncoder:
    """Ids of whole texts from a byte-level BPE file.

    Where the file merges by rank, texts of usual letters are encoded by the library
    that does so, which is several times as fast; other texts, and those whose runs of
    white space are too long for it, by the file's own one.
    """

    def __init__(self, path: str, by_rank: bool):
        from tokenizers import Tokenizer

        # Tasks share the machine already; threads per task would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.ranked = _rank_encoder(self.tokenizer) if by_rank else None

    def _own(self, strings: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _by_rank(self, text: str) -> np.ndarray | None:
        if self.ranked is None or _UNUSUAL.search(text):
            return None
        try:
            return self.ranked.encode_to_numpy(text, allowed_special="all").astype("<u4")
        except ValueError:  # its pattern gives up on very long runs of white space
            return None

    def encode(self, strings: list[str]) -> list[np.ndarray]:
        """32-bit ids of each text."""
        found = [self._by_rank(t) for t in strings]
        others = iter(self._own([t for t, ids in zip(strings, found) if ids is None]))
        return [next(others) if ids is None else ids for ids in found]


@cache
def _encoder(path: str, by_rank: bool) -> TextEncoder:
    return TextEncoder(path, by_rank)


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document: the first takes what the full ones leave."""
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def _tokenise(path: str, by_rank: bool, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(path, by_rank), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                rows: list[tuple] = []
                encoded = encoder.encode([t or "" for t in part.column("text").to_pylist()])
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoded):
                    ids, start = ids.tobytes() + end, 0
                    for piece, length in enumerate(cut_lengths(len(ids) // 4, capacity)):
                        rows.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start: 4 * (start + length)])))
                        start += length
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                                 ["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32."""
    by_rank = merges_by_rank(tokenizer_path)  # read once here, not in every worker
    return texts(docs, id_col, text_col).mapInArrow(_tokenise(tokenizer_path, by_rank, end_id, capacity), _PIECES)


def reachable(sizes: list[int], left: np.ndarray, room: int) -> list[int]:
    """By position in ``sizes`` (largest first): the totals up to ``room`` of pieces from there on, as bits."""
    within = (1 << (room + 1)) - 1
    sums = [1]
    for size in reversed(sizes):
        bits, copies, step = sums[-1], min(int(left[size]), room // size), 1
        while copies:
            # Any number of copies is a sum of these steps.
            step = min(step, copies)
            bits |= bits << (size * step) & within
            copies -= step
            step *= 2
        sums.append(bits)
    return sums[::-1]


def best_filling(left: np.ndarray, room: int, order: int = 0) -> list[int]:
    """Lengths that fill ``room`` best, largest first, from those with ``left`` > 0.

    Lengths are branched on from the largest down, with as many copies as possible
    first. ``reachable`` bounds the waste of a branch exactly, so every branch that
    cannot reach the least waste is pruned before it is entered. ``order`` skips that
    many of the largest lengths where the rest wastes no more.
    """
    sizes = np.flatnonzero(left[: room + 1])[::-1].tolist()
    sums = reachable(sizes, left, room)
    rest = sums[0].bit_length() - 1  # the fullest total there is
    first = min(order, len(sizes))
    while not sums[first] >> rest & 1:
        first -= 1
    filling: list[int] = []
    for i in range(first, len(sizes)):
        size = sizes[i]
        copies = min(int(left[size]), rest // size)
        while not sums[i + 1] >> (rest - copies * size) & 1:
            copies -= 1
        filling += [size] * copies
        rest -= copies * size
        if not rest:
            break
    return filling


def _completion(counts: np.ndarray, capacity: int, order: int) -> list[tuple[int, list[int]]]:
    left = counts.copy()
    plan: list[tuple[int, list[int]]] = []
    while (held := np.flatnonzero(left)).size:
        largest = int(held[-1])
        left[largest] -= 1
        filling = [largest, *best_filling(left, capacity - largest, order)]
        left[largest] += 1
        lengths, copies = np.unique(filling, return_counts=True)
        times = int((left[lengths] // copies).min())
        left[lengths] -= times * copies
        plan.append((times, filling))
    return plan


def fewest_possible(counts: np.ndarray, capacity: int) -> int:
    """Lower bound on sequences: all tokens, and lengths too long to share (with what cannot join them)."""
    counts = np.asarray(counts, np.int64)
    rows = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(counts * np.arange(len(counts)))])
    middle = capacity // 2 + 1
    # By the least length that counts as small: longer ones than the rest of a sequence share with none of these.
    small = np.arange(middle)
    top = capacity + 1 - small
    half = rows[top] - rows[middle]
    spare = half * capacity - (tokens[top] - tokens[middle])
    more = np.maximum(0, -(-(tokens[middle] - tokens[small] - spare) // capacity))
    return max(-(-int(tokens[-1]) // capacity), int((rows[-1] - rows[top] + half + more).max()))


def _exact_fillings(sizes: list[int], sums: list[int], left: np.ndarray, total: int) -> Iterator[tuple[list[int], int, int] | None]:
    """Every filling of just ``total``, largest lengths first, with its sums of one or more and of two or more pieces.

    None stands for a branch that is dominated already: two or more of its pieces add up
    to a length that it leaves out, which could take their place.
    """
    def fill(start: int, rest: int, ones: int, twos: int, spare: int, filling: list[int]):
        if not rest:
            yield filling, ones, twos
            return
        for i in range(start, len(sizes)):
            if not sums[i] >> rest & 1:
                return
            size = sizes[i]
            for copies in range(min(int(left[size]), rest // size), 0, -1):
                if not sums[i + 1] >> (rest - copies * size) & 1:
                    continue
                one, two = ones, twos
                for _ in range(copies):
                    two, one = two | one << size, one | one << size | 1 << size
                out = spare | (1 << size if left[size] > copies else 0)
                if two & out:
                    yield None
                else:
                    yield from fill(i + 1, rest - copies * size, one, two, out, filling + [size] * copies)
            spare |= 1 << size

    return fill(0, total, 0, 0, 0, [])


def undominated_fillings(left: np.ndarray, room: int) -> Iterator[list[int] | None]:
    """Fillings of ``room``, least waste first, none of which another one dominates.

    A filling is dominated if a length that it leaves out could take the place of none or
    some of its pieces that add up to no more, within the room. None stands for a step
    that found a dominated one.
    """
    sizes = np.flatnonzero(left[: room + 1])[::-1].tolist()
    sums = reachable(sizes, left, room)
    for total in range(room, -1, -1):
        if not sums[0] >> total & 1:
            continue
        slack = room - total
        for found in _exact_fillings(sizes, sums, left, total):
            if found is None:
                yield None
                continue
            filling, _, twos = found
            # Sums from ``size`` - ``slack`` to ``size``; a single piece must be smaller to count.
            single = sum(1 << n for n in set(filling))
            window = (1 << slack + 1) - 1
            dominated = any(
                size <= slack or twos >> size - slack & window or single >> size - slack & window >> 1
                for size in sizes if left[size] > filling.count(size))
            yield None if dominated else filling


def _completions(left: np.ndarray, capacity: int) -> Iterator[tuple[int, list[int]] | None]:
    """(times, lengths) choices for the sequences of the largest length left."""
    largest = int(np.flatnonzero(left)[-1])
    others = left.copy()
    others[largest] -= 1
    for rest in undominated_fillings(others, capacity - largest):
        if rest is None:
            yield None
            continue
        filling = [largest, *rest]
        lengths, copies = np.unique(filling, return_counts=True)
        for times in range(int((left[lengths] // copies).min()), 0, -1):
            yield times, filling


def _bin_completion(counts: np.ndarray, capacity: int, best: list[tuple[int, list[int]]], least: int,
                    nodes: int | None) -> list[tuple[int, list[int]]]:
    """The best plan found by branching on undominated fillings, from ``best`` on."""
    fewest, spent = sum(t for t, _ in best), 0
    seen: dict[bytes, int] = {}
    path: list[tuple[int, list[int]]] = []
    open_nodes = [(counts, 0, _completions(counts, capacity))]
    while open_nodes and fewest > least and (nodes is None or spent < nodes):
        left, used, choices = open_nodes[-1]
        spent += 1
        try:
            choice = next(choices)
        except StopIteration:
            open_nodes.pop()
            if path:
                path.pop()
            continue
        if choice is None:
            continue
        times, filling = choice
        rest, total = left.copy(), used + times
        np.subtract.at(rest, filling, times)
        if not rest.any():
            if total < fewest:
                best, fewest = [*path, choice], total
            continue
        mark = rest.tobytes()
        if total + fewest_possible(rest, capacity) >= fewest or seen.get(mark, total + 1) <= total:
            continue
        seen[mark] = total
        open_nodes.append((rest, total, _completions(rest, capacity)))
        path.append(choice)
    return best


def plan_packing(counts: np.ndarray, capacity: int = CAPACITY, tries: int = 4,
                 nodes: int | None = NODES) -> list[tuple[int, list[int]]]:
    """(times, lengths) patterns that use every piece; ``counts[n]`` pieces have length n.

    ``tries`` plans are made without turning back; if the best of them misses the lower
    bound, bin completion goes on from it for ``nodes`` steps, or to its end (None).
    """
    counts = np.asarray(counts, np.int64)
    if not counts.any():
        return []
    least, best = fewest_possible(counts, capacity), None
    for order in range(max(1, tries)):
        plan = _completion(counts, capacity, order)
        if best is None or sum(t for t, _ in plan) < sum(t for t, _ in best):
            best = plan
        if sum(t for t, _ in best) <= least:
            return best
    return _bin_completion(counts, capacity, best, least, nodes)


def _places(plan: list[tuple[int, list[int]]], capacity: int) -> dict[int, np.ndarray]:
    """By length: rows of first rank, copies per sequence, first sequence, first offset."""
    used = np.zeros(capacity + 1, np.int64)
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for times, filling in plan:
        offset = 0
        for length, copies in zip(*(x.tolist() for x in np.unique(filling, return_counts=True))):
            rows.setdefault(length, []).append((int(used[length]), copies, sequence, offset))
            used[length] += times * copies
            offset += length * copies
        sequence += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def _place(places: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.asarray(batch.column("length"))
            rank = np.asarray(batch.column("rank"))
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for n in np.unique(length):
                mine, table = length == n, places[int(n)]
                row = table[np.searchsorted(table[:, 0], rank[mine], "right") - 1]
                within = rank[mine] - row[:, 0]
                sequence[mine] = row[:, 2] + within // row[:, 1]
                offset[mine] = row[:, 3] + within % row[:, 1] * n
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)],
                                             [f.split()[0] for f in _PLACED.split(", ")])
    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS, tries: int = 4,
         nodes: int | None = NODES) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32)."""
    held = settled(pieces.withColumn("bucket", hashed_to(["doc_id", "piece", "ids_crc32"], buckets)), "pieces")
    counts = held.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    # capacity x buckets rows at most, whatever the input.
    counts = settled(counts, "lengths")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("rows").alias("rows")).collect():
        histogram[row["length"]] = row["rows"]
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "bucket", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = held.withColumn("row", F.row_number().over(within) - 1)
    # The window has already dealt the pieces by these keys; only the counts move.
    ranked = numbered.join(bases, ["length", "bucket"]).withColumn("rank", F.col("row") + F.col("base"))
    places = _places(plan_packing(histogram, capacity, tries, nodes), capacity)
    return ranked.drop("row", "base", "bucket").mapInArrow(_place(places), _PLACED)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and ``end_id``; only documents above ``capacity``
    tokens are cut. Sequences are filled without gaps.
    """
    return pack(token_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id), capacity)
