"""Personal data by bootstrapping: sure matches teach contexts, contexts find the rest.

Base spans are those of fixed patterns and checks; they are the seeds. The one or two
words before a span form its lexical patterns. Patterns with enough distinct known
instances are looked for in all texts, where they also precede other things: words, which
count against them, and strings that look like identifiers, which become candidates. On
the graph of patterns and instances, rounds of scoring alternate: a pattern is worth the
share of its instances that are known (with a deduction for small numbers), a candidate
the chance that not all of its confident patterns are wrong. Candidates above the bar
whose form fits the kind become known: in the next round they count for the patterns that
have them, and patterns that now have enough known instances join in. Rounds end when
nothing new is found.

Copies of a text do not add up: instances and seeds count once per distinct string.
Candidates and their patterns meet by a join, whatever the number of patterns. The words
after patterns are counted for those that precede a candidate, in passes over the texts
with about ``PATTERNS`` patterns each, which bounds the table that tasks hold.

Results by case: NULL and empty texts have no spans; repeated rows each get their row;
added spans never overlap base spans; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from chatlake.llm.common import settled, texts, wrapped
from chatlake.llm.wordhash import slices

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Those of mails and addresses are matched run by run
# (``_emails``, ``_addresses``), as searching them from every place of a long run takes its square.
BASE = {
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
# Distinct seeds a pattern needs, the patterns looked for in one pass, the bars, and the rounds.
LEAST_SEEDS = 4
PATTERNS = 20_000
PATTERN_BAR = 0.5
INSTANCE_BAR = 0.8
ROUNDS = 3

_NOT_DIGIT = re.compile(r"[^0-9]")
# Spaced groups of digits, or a string of identifier characters; six characters at least.
_CANDIDATE = re.compile(r"\(?[0-9][0-9() .-]{5,}[0-9]|[A-Za-z0-9@][A-Za-z0-9@._:/+-]{4,}[A-Za-z0-9]")
_SIGN = re.compile(r"[0-9@]")
_EDGE = ".,;:!?()[]\"'"
_WORDLIKE = re.compile(r"\w")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _holds(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in found.split("."))
    digits = _NOT_DIGIT.sub("", found)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


_LOCAL = re.compile(r"[A-Za-z0-9._%+-]++")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: what is left of a run of local characters, an @ behind it, and a domain."""
    found, done = [], 0
    if "@" not in text:
        return found
    for run in _LOCAL.finditer(text):
        end = run.end()
        if end > done and text.startswith("@", end) and (domain := _DOMAIN.match(text, end + 1)):
            found.append((max(run.start(), done), domain.end()))
            done = domain.end()
    return found


def _addresses(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: four numbers after four of a run of numbers with single dots."""
    found = []
    for run in _DOTTED.finditer(text):
        at, numbers = run.start(), run.group().split(".")
        for i in range(0, len(numbers) - 3, 4):
            size = sum(map(len, numbers[i: i + 4])) + 3
            found.append((at, at + size))
            at += size + 1
    return found


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    if not text:
        return []
    spans = {"email": _emails(text), "ip": _addresses(text)}
    spans |= {kind: [m.span() for m in pattern.finditer(text)] for kind, pattern in BASE.items()}
    return [(kind, a, b) for kind in KINDS for a, b in spans[kind] if _holds(kind, text[a:b])]


def _words(parts: list[str]) -> list[str]:
    """Tokens without the punctuation around them; punctuation alone is none."""
    return [w for w in (p.strip(_EDGE) for p in parts) if _WORDLIKE.search(w)]


def patterns_before(text: str, start: int) -> list[str]:
    """The word before ``start``, and the two words before it; punctuation alone is no word."""
    reach = 64
    while True:
        begin = max(0, start - reach)
        parts = text[begin:start].split()
        if begin and parts and not text[begin - 1].isspace() and not text[begin].isspace():
            parts = parts[1:]  # its beginning is further left
        words = _words(parts)
        if len(words) >= 2 or not begin:
            last = [w.lower() for w in words[-2:]]
            return [last[-1], " ".join(last)][: len(last)] if last else []
        reach *= 4


def render(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


_SPANS = "array<struct<kind: string, start: int, end: int>>"
_BASE = (f"doc_id bigint, mark bigint, spans {_SPANS}, seeds array<struct<kind: string, value: string, pattern: string>>, "
         "candidates array<struct<start: int, end: int, value: string, patterns: array<string>>>")
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_SEED_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string()), ("pattern", pa.string())]))
_CANDIDATE_TYPE = pa.list_(pa.struct([
    ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))]))


def _candidates(text: str | None, taken: list[tuple[str, int, int]]) -> list[dict]:
    """Strings that look like identifiers outside the spans ``taken``, with the patterns before them."""
    found = []
    starts = sorted(a for _, a, _ in taken)
    reach = list(accumulate((b for _, _, b in sorted(taken, key=lambda s: s[1])), max))
    for m in _CANDIDATE.finditer(text or ""):
        before = bisect_left(starts, m.end())  # spans that begin before it ends
        if _SIGN.search(m.group()) and not (before and reach[before - 1] > m.start()):
            patterns = patterns_before(text, m.start())
            if patterns:
                found.append({"start": m.start(), "end": m.end(), "value": m.group(), "patterns": patterns})
    return found


def _find_base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            spans, seeds, candidates = [], [], []
            for text in part.column("text").to_pylist():
                found = base_spans(text)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                seeds.append([{"kind": k, "value": text[a:b], "pattern": p}
                              for k, a, b in found for p in patterns_before(text, a)])
                candidates.append(_candidates(text, found))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("mark"), pa.array(spans, _SPAN_TYPE), pa.array(seeds, _SEED_TYPE),
                 pa.array(candidates, _CANDIDATE_TYPE)], ["doc_id", "mark", "spans", "seeds", "candidates"])


def _count(patterns: frozenset[str]):
    """Numbers of words that follow the patterns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words: Counter[str] = Counter()
                for text in part.column("text").to_pylist():
                    if not text:
                        continue
                    tokens = _words(text.lower().split())
                    words.update(a for a, b in zip(tokens, tokens[1:]) if a in patterns and not _SIGN.search(b))
                    words.update(f"{a} {b}" for a, b, c in zip(tokens, tokens[1:], tokens[2:])
                                 if f"{a} {b}" in patterns and not _SIGN.search(c))
                if words:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], ["pattern", "words"])
    return run


def words_after(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, words: how many words follow each of ``patterns`` (a written table) in the texts."""
    counts = patterns.select("pattern", F.lit(0).cast("bigint").alias("words")).limit(0)
    passes = -(-patterns.count() // PATTERNS)
    for i in range(passes):
        block = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(passes)) == i)
        wanted = frozenset(block.toArrow().column(0).to_pylist())
        found = rows.mapInArrow(_count(wanted), "pattern string, words bigint")
        counts = counts.unionByName(settled(found.groupBy("pattern").agg(F.sum("words").alias("words")), "words"))
    return counts


def _fits() -> Column:
    """Whether a candidate has the form of the kind."""
    digits = F.length(F.regexp_replace("value", "[^0-9]", ""))
    return (
        F.when(F.col("kind") == "email", F.col("value").contains("@"))
        .when(F.col("kind") == "ip", (digits >= 4) & (F.size(F.split("value", "[.:]")) >= 4))
        .when(F.col("kind") == "card", digits >= 12).otherwise((digits >= 7) & ~F.col("value").rlike("[A-Za-z@]")))


def _bootstrap(rows: DataFrame, seeds: DataFrame, places: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(value, kind) of the candidates that the graph of patterns and instances makes known, and the patterns looked for."""
    graph = settled(places.select("pattern", "value").distinct(), "graph")
    others = settled(graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("candidates")), "others")
    own = settled(seeds.groupBy("pattern").agg(F.count_distinct("value").alias("seed_values")), "seed_values")
    # Only patterns that precede a candidate can make one known.
    seeds = settled(seeds.join(others.select("pattern"), "pattern", "left_semi"), "leading_seeds")
    known, totals, found, size = seeds.select("pattern", "kind", "value"), None, None, -1
    for _ in range(rounds):
        enough = known.groupBy("pattern").agg(F.count_distinct("value").alias("values")).where(F.col("values") >= LEAST_SEEDS)
        new = enough.select("pattern") if totals is None else enough.select("pattern").join(totals, "pattern", "left_anti")
        new = settled(new, "new_patterns")
        if totals is None or not new.isEmpty():
            more = new.join(words_after(rows, new), "pattern", "left").join(others, "pattern", "left").join(own, "pattern", "left")
            parts = [F.coalesce(c, F.lit(0)) for c in ("seed_values", "words", "candidates")]
            more = settled(more.select("pattern", (parts[0] + parts[1] + parts[2]).alias("total")), "totals")
            totals = more if totals is None else totals.unionByName(more)
        right = known.groupBy("pattern", "kind").agg(F.count_distinct("value").alias("right"))
        worth = right.join(totals, "pattern").withColumn("worth", (F.col("right") - 1) / (F.col("total") + 1)).where(
            (F.col("right") >= LEAST_SEEDS) & (F.col("worth") >= PATTERN_BAR)).select("pattern", "kind", "worth")
        scored = graph.join(worth, "pattern").where(_fits()).groupBy("value", "kind").agg(
            (1 - F.exp(F.sum(F.log1p(-F.least("worth", F.lit(0.999)))))).alias("score"))
        best = scored.groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("score"))
        found = settled(best.where(F.col("score") >= INSTANCE_BAR).select("value", "kind"), "instances")
        before, size = size, found.count()
        if size == max(before, 0):
            break
        known = seeds.select("pattern", "kind", "value").unionByName(
            graph.join(found, "value").select("pattern", "kind", "value"))
    return found, totals.select("pattern")


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: doc_id, mark (hash of the text), base spans, all spans.

    Spans are arrays of (kind, start, end) in code points, end exclusive.
    """
    rows = texts(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    base = settled(rows.mapInArrow(_find_base, _BASE), "base")
    seeds = settled(base.select(F.explode("seeds").alias("s")).select("s.pattern", "s.kind", "s.value").distinct(), "seeds")
    places = base.select("doc_id", "mark", F.explode("candidates").alias("c")).select(
        "doc_id", "mark", "c.start", "c.end", "c.value", F.explode("c.patterns").alias("pattern"))
    found, patterns = _bootstrap(rows, seeds, places, rounds)
    added = places.join(found, "value").join(patterns, "pattern", "left_semi").select(
        "doc_id", "mark", "kind", "start", "end").distinct()
    lists = added.groupBy(F.col("doc_id").alias("added_id"), F.col("mark").alias("added_mark")).agg(
        F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    same = F.col("doc_id").eqNullSafe(F.col("added_id")) & (F.col("mark") == F.col("added_mark"))
    return base.join(lists, same, "left").select(
        "doc_id", "mark", F.col("spans").alias("base"),
        F.concat("spans", F.coalesce("added", F.array().cast(_SPANS))).alias("spans"))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, every = ([[(s["kind"], s["start"], s["end"]) for s in spans] for spans in batch.column(c).to_pylist()]
                       for c in ("base", "spans"))
        counts = [pa.array([sum(s[0] == kind for s in spans) for spans in base], pa.int64()) for kind in KINDS]
        digests = [hashlib.sha256(render(spans).encode()).hexdigest() for spans in base]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array(map(render, every), pa.string())],
            ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def report(found: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, their digest, and all spans as text, from ``find_personal``."""
    return found.mapInArrow(
        _describe, "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    parts, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            parts += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def mask_texts(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of ``find_personal`` masked in their texts; other columns stay."""
    hits = found.where(F.size("spans") > 0).dropDuplicates(["doc_id", "mark"]).select(
        F.col("doc_id").alias("found_id"), F.col("mark").alias("found_mark"), "spans")
    same = F.col("id").eqNullSafe(F.col("found_id")) & (F.col("mark") == F.col("found_mark"))
    joined = wrapped(docs, id_col, text_col).join(hits, same, "left").select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, spans = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
            new = [masked(t, [(s["kind"], s["start"], s["end"]) for s in found]) if found else t
                   for t, found in zip(text, spans)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(new, pa.string())], ["row", "text"])

    changed = joined.mapInArrow(run, T.StructType([T.StructField("row", docs.schema), T.StructField("text", T.StringType())]))
    return changed.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
