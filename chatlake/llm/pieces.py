"""SentencePiece encoding and decoding over a table of distinct marked words.

In the model's own form a text is its characters with a marker for every space and one
in front. Where no piece of the vocabulary has a marker behind another character, no
merge reaches from one marked word (its markers and what follows up to the next ones)
into the next: its ids are the same wherever it stands. So each distinct marked word of
the corpus is segmented once. For a model with such pieces the whole text is one word.

Texts are read in blocks of about ``BLOCK_BYTES``. A block numbers its distinct words, so
a text becomes a list of numbers, and a word meets the table once per block, however
often it occurs: no word can be a hot key. Words are dealt by hash (``radix``); a task
segments the distinct words of a radix and answers every block with their ids in order.
Blocks then put the ids back by position. Radixes grow with the bytes of the input, so
that neither a block nor a radix outgrows a task.

Ids become text through the id-to-piece table, one entry per id of the vocabulary.

Results by case: NULL and empty texts have no ids (the digests are those of the empty
string); a text without spaces is one word of any length; repeated rows each get their
row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from chatlake.llm.common import bucketed, texts
from chatlake.llm.wordhash import slices

# Text that is numbered together, and the distinct words that end a block before that.
BLOCK_BYTES = 32 << 20
BLOCK_WORDS = 1 << 20
# Text bytes per radix of the word table, and words and texts per row that is dealt.
RADIX_BYTES = 16 << 20
ROW_WORDS = 4096
# Spark's own limit on the files that blocks are dealt to; beyond it a file has several blocks.
MOST_BUCKETS = 100_000
ROW_DOCS = 256
_MARK = "▁"
_WORD = re.compile(f"{_MARK}({_MARK}*[^{_MARK}]*)")
# Fixed value: how the library writes an unknown piece.
_UNKNOWN = " ⁇ "
_BLOCKS = ("block bigint, radix int, part int, numbers binary, words binary, lengths binary, "
           "doc_ids array<bigint>, sizes binary, codes binary")
_ANSWERS = "block bigint, radix int, part int, sizes binary, ids binary"
_OUT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
_OUT_TEXTS = _OUT + ", ids array<int>, decoded string"


class Model:
    """A model, the same without the marker in front, and what its ids stand for."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as schema

        spec = schema.ModelProto()
        with open(path, "rb") as file:
            spec.ParseFromString(file.read())
        how = spec.normalizer_spec
        if (how.precompiled_charsmap or how.remove_extra_whitespaces or not how.add_dummy_prefix
                or not how.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix):
            raise ValueError("words are cut from texts as they are: a model that normalises them is refused")
        how.add_dummy_prefix = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        kinds = schema.ModelProto.SentencePiece
        self.alone = all(_MARK not in p.piece.lstrip(_MARK) for p in spec.pieces)
        self.meaning = [
            bytes([int(p.piece[3:-1], 16)]) if p.type == kinds.BYTE else b"" if p.type == kinds.CONTROL
            else _UNKNOWN.encode() if p.type == kinds.UNKNOWN else p.piece.replace(_MARK, " ").encode()
            for p in spec.pieces]

    def words(self, text: str) -> list[str]:
        """Marked words of a text, each without its first marker."""
        if not text:
            return []
        if not self.alone:
            return [text.replace(" ", _MARK)]
        if _MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return _WORD.findall(_MARK + text.replace(" ", _MARK))

    def segment(self, words: list[str]) -> list[list[int]]:
        return self.bare.encode([_MARK + w for w in words], num_threads=1)


@cache
def model_at(path: str) -> Model:
    return Model(path)


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers below 2**32, compressed byte by byte of their width."""
    planes = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor().compress(planes.tobytes())


def widened(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _number(path: str, radixes: int):
    """Texts to numbers of the distinct words of their block."""
    names = [f.split()[0] for f in _BLOCKS.split(", ")]
    kinds = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 3, pa.list_(pa.int64()), *[pa.binary()] * 2)

    def rows(block: int, numbers: dict[str, int], ids: list, codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        dealt: dict[int, list[str]] = defaultdict(list)
        for word in numbers:
            dealt[zlib.crc32(word.encode()) % radixes].append(word)
        for radix, words in dealt.items():
            words.sort()  # neighbours then begin alike, which packs better
            for i in range(0, len(words), ROW_WORDS):
                part = words[i: i + ROW_WORDS]
                row = (block, radix, i // ROW_WORDS, squeezed(np.array([numbers[w] for w in part])),
                       zstandard.ZstdCompressor().compress("".join(part).encode()),
                       squeezed(np.array([len(w) for w in part])), None, None, None)
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)
        for i in range(0, len(ids), ROW_DOCS):
            part = codes[i: i + ROW_DOCS]
            row = (block, *[None] * 5, ids[i: i + ROW_DOCS], squeezed(np.array([len(c) for c in part])),
                   squeezed(np.concatenate(part)))
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path)
        # Unique within the one job that writes the blocks; what is read later is the written table.
        blocks = count(TaskContext.get().partitionId() << 24)
        numbers: dict[str, int] = defaultdict(count().__next__)
        ids, codes, held = [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    words = model.words(text or "")
                    ids.append(doc_id)
                    codes.append(np.fromiter(map(numbers.__getitem__, words), "<u4", len(words)))
                held += part.nbytes
                if held > BLOCK_BYTES or len(numbers) > BLOCK_WORDS:
                    yield from rows(next(blocks), numbers, ids, codes)
                    numbers, ids, codes, held = defaultdict(count().__next__), [], [], 0
        if ids:
            yield from rows(next(blocks), numbers, ids, codes)
    return run


def _segment(path: str):
    """The distinct-word table of a radix, built as its words come; every block gets its answers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, radix, known = model_at(path), None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                block, own, part, packed, lengths = (
                    batch.column(c)[i].as_py() for c in ("block", "radix", "part", "words", "lengths"))
                joined, ends = zstandard.ZstdDecompressor().decompress(packed).decode(), np.cumsum(widened(lengths)).tolist()
                words = [joined[a:b] for a, b in zip([0, *ends], ends)]
                if own != radix:
                    radix, known = own, {}
                new = [w for w in words if w not in known]
                known.update(zip(new, model.segment(new)))
                found = [known[w] for w in words]
                row = (block, own, part, squeezed(np.array([len(x) for x in found])),
                       squeezed(np.fromiter((i for x in found for i in x), "<u4")))
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)],
                                                 [f.split()[0] for f in _ANSWERS.split(", ")])
    return run


def _restore(path: str, with_texts: bool):
    """Ids of a block's words back to their places in its texts."""
    def run(held: pa.Table, answers: pa.Table) -> pa.Table:
        meaning = model_at(path).meaning
        decimals = [str(i) for i in range(len(meaning))]
        rows = held.select(["radix", "part", "numbers", "doc_ids", "sizes", "codes"]).to_pylist()
        numbered = {(r["radix"], r["part"]): widened(r["numbers"]) for r in rows if r["numbers"] is not None}
        words = sum(map(len, numbered.values()))
        lists: list[list[int]] = [[]] * words
        listed, said, sizes = [""] * words, [b""] * words, np.zeros(words, np.int64)
        for radix, part, lengths, ids in zip(*(answers.column(c).to_pylist() for c in ("radix", "part", "sizes", "ids"))):
            numbers, lengths, ids = numbered[radix, part], widened(lengths), widened(ids)
            sizes[numbers] = lengths
            ids, done = ids.tolist(), 0
            for number, length in zip(numbers.tolist(), lengths.tolist()):
                own = ids[done: done + length]
                done += length
                listed[number] = ",".join([decimals[i] for i in own])
                said[number] = b"".join([meaning[i] for i in own])
                if with_texts:
                    lists[number] = own
        out: list[tuple] = []
        for row in rows:
            if row["codes"] is None:
                continue
            codes, done = widened(row["codes"]), 0
            for doc_id, length in zip(row["doc_ids"], widened(row["sizes"]).tolist()):
                own = codes[done: done + length]
                done += length
                places = own.tolist()
                # The marker in front of the text is no character of it; texts of whole words are valid UTF-8.
                decoded = b"".join([said[c] for c in places])[1:]
                ids = ",".join([listed[c] for c in places])
                told = (doc_id, int(sizes[own].sum()), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest())
                out.append((*told, [i for c in places for i in lists[c]], decoded.decode()) if with_texts else told)
        fields = [f.split() for f in (_OUT_TEXTS if with_texts else _OUT).split(", ")]
        kinds = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
        columns = list(zip(*out)) or [()] * len(fields)
        return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])
    return run


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                  with_texts: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded.

    Digests are of the decimal ids joined by commas and of the decoded text.
    """
    rows = texts(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    radixes = max(8, math.ceil(size / RADIX_BYTES))
    blocks = rows.mapInArrow(_number(model_path, radixes), _BLOCKS)
    # Written by block, so that the texts wait where they are for the ids of their words.
    held = bucketed(blocks, "piece_blocks", "block", min(radixes, MOST_BUCKETS))
    words = held.where("radix IS NOT NULL").select("block", "radix", "part", "words", "lengths")
    answers = words.repartition("radix").sortWithinPartitions("radix").mapInArrow(_segment(model_path), _ANSWERS)
    coded = held.drop("words", "lengths")
    return coded.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _restore(model_path, with_texts), _OUT_TEXTS if with_texts else _OUT)
