"""Token counts of whole texts, huge documents by overlapping chunks.

A document of at most ``chunk`` characters is encoded as it is. A longer one is cut
into chunks that overlap by ``overlap`` characters on either side of each cut; the
chunks spread over tasks and are encoded with the offsets of their tokens. In the
overlap of two neighbours the first token boundary that is *proven stable* is the
splice point: no vocabulary piece equals any substring that crosses it, so no merge
can ever cross it and the tokens on either side do not depend on the other side.
Both neighbours must report the same point. Where an overlap holds none, the
document is cut again with an overlap and a chunk four times as wide, at last as a
single chunk, so the count is exact for any text.

Results by case: NULL and empty text have 0 bytes and 0 tokens; repeated rows each
get their row; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from chatlake.llm.common import settled, texts
from chatlake.llm.wordhash import slices

CHUNK = 65_536
OVERLAP = 256
_SPACE = "▁"
_HUGE = "doc_id bigint, text_hash bigint, chunk int, start bigint, body string, head int, tail int"
_SPLICED = "doc_id bigint, text_hash bigint, chunk int, tokens bigint, left bigint, right bigint"


@cache
def _model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, frozenset(model.id_to_piece(i) for i in range(model.get_piece_size()))


def stable_boundary(text: str, at: int, pieces: frozenset[str], longest: int) -> bool:
    """True if no piece equals a substring of ``text`` that crosses position ``at``."""
    text = text[max(0, at - longest): at + longest]
    at = min(at, longest)
    if text[at - 1] not in pieces or text[at] not in pieces:
        return False  # an unknown character may be joined with its neighbour
    for begin in range(max(0, at - longest + 1), at):
        for end in range(at + 1, min(len(text), begin + longest) + 1):
            if text[begin:end] in pieces:
                return False
    return True


def _ends(model, text: str) -> list[int]:
    """Character position at which each token of ``text`` ends."""
    held = text.encode()
    places = {}
    done = 0
    for i, c in enumerate(text):
        done += len(c.encode())
        places[done] = i + 1
    places[0] = 0
    return [places.get(p.end, -1) for p in model.encode(text, return_type="proto").pieces] if held else []


def splice_points(path: str, body: str, head: int, tail: int) -> tuple[int, int, int]:
    """Tokens between the splice points in the first ``head`` and the last ``tail`` characters.

    The points come back as positions in ``body``, -1 where there is none; no
    overlap on a side (0) means that the document begins or ends there.
    """
    model, pieces = _model(path)
    longest = max(map(len, pieces))
    plain = body.replace(" ", _SPACE)
    ends = _ends(model, body)
    last_token = {end: i for i, end in enumerate(ends)}

    def first_stable(begin: int, end: int) -> int:
        for at in range(begin + longest, end - longest + 1):
            if at in last_token and stable_boundary(plain, at, pieces, longest):
                return at
        return -1

    left = first_stable(0, head) if head else 0
    right = first_stable(len(body) - tail, len(body)) if tail else len(body)
    if left < 0 or right < 0:
        return 0, left, right
    before = last_token[left] + 1 if left else 0
    return (last_token[right] + 1 if tail else len(ends)) - before, left, right


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, mark, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for i, at in enumerate(range(0, len(text), chunk)):
                    begin, end = max(0, at - overlap), min(len(text), at + chunk + overlap)
                    last = at + chunk >= len(text)
                    row = [key, mark, i, begin, text[begin:end], min(2 * overlap, at + overlap) if at else 0,
                           0 if last else end - (at + chunk - overlap)]
                    # Spark's own type names, so that one row is one small batch.
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row[0]], pa.int64()), pa.array([row[1]], pa.int64()), pa.array([row[2]], pa.int32()),
                         pa.array([row[3]], pa.int64()), pa.array([row[4]]), pa.array([row[5]], pa.int32()),
                         pa.array([row[6]], pa.int32())],
                        ["doc_id", "text_hash", "chunk", "start", "body", "head", "tail"])
    return run


def _splice(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            for r in batch.to_pylist():
                tokens, left, right = splice_points(path, r["body"], r["head"], r["tail"])
                rows.append((r["doc_id"], r["text_hash"], r["chunk"], tokens,
                             r["start"] + left if left >= 0 else -1, r["start"] + right if right >= 0 else -1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(
                    zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "text_hash", "chunk", "tokens", "left", "right"])
    return run


def _whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = _model(path)
        for batch in batches:
            for part in slices(batch, "text"):
                encoded = model.encode([t or "" for t in part.column("text").to_pylist()], num_threads=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_bytes"), pa.array([len(x) for x in encoded], pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens"])
    return run


def _spliced(huge: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """Tokens per huge document, and whether neighbours agree on every splice point."""
    # Chunks of one document go to different tasks.
    pieces = huge.mapInArrow(_cut(chunk, overlap), _HUGE).repartition("doc_id", "text_hash", "chunk")
    keys = ["doc_id", "text_hash"]
    chunks = pieces.mapInArrow(_splice(path), _SPLICED)
    following = F.lead("left").over(Window.partitionBy(*keys).orderBy("chunk"))
    agreed = (F.col("left") >= 0) & (F.col("right") >= 0) & (F.coalesce(following, "right") == F.col("right"))
    return chunks.withColumn("agreed", agreed).groupBy(*keys).agg(
        F.sum("tokens").alias("n_tokens"), F.bool_and("agreed").alias("agreed"))


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    Tokens are those of the sentencepiece model at ``model_path`` without begin or
    end tokens. A model that normalises texts is refused: its offsets would differ.
    """
    model, _ = _model(model_path)
    probe = "a  ﬁÅ ① b "
    if model.normalize(probe) != _SPACE + probe.replace(" ", _SPACE):
        raise ValueError("chunks need a model that leaves texts as they are")
    rows = texts(docs, id_col, text_col).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"))
    long_text = F.coalesce(F.char_length("text"), F.lit(0)) > chunk
    counted = rows.where(~long_text).mapInArrow(_whole(model_path), "doc_id bigint, n_bytes bigint, n_tokens bigint")
    huge = rows.where(long_text).withColumn("text_hash", F.xxhash64("text"))
    keys = ["doc_id", "text_hash"]
    # Equal rows are cut once; their number is restored by the join below.
    pending = huge.dropDuplicates(keys).select(*keys, "text")
    done = None
    while True:
        results = settled(_spliced(pending, model_path, chunk, overlap), "splices")
        fine = results.where("agreed")
        done = fine if done is None else done.unionByName(fine)
        failed = results.where(~F.col("agreed")).select(*[F.col(k).alias(f"failed_{k}") for k in keys])
        if failed.isEmpty():
            break
        chunk, overlap = 4 * chunk, 4 * overlap
        same = F.col("doc_id").eqNullSafe(F.col("failed_doc_id")) & (F.col("text_hash") == F.col("failed_text_hash"))
        pending = pending.join(failed, same, "left_semi")
    totals = done.select(*[F.col(k).alias(f"done_{k}") for k in keys], "n_tokens")
    same = F.col("doc_id").eqNullSafe(F.col("done_doc_id")) & (F.col("text_hash") == F.col("done_text_hash"))
    spliced = huge.select(*keys, "n_bytes").join(totals, same).select("doc_id", "n_bytes", "n_tokens")
    return counted.unionByName(spliced).withColumn("over_limit", F.col("n_tokens") > limit)
