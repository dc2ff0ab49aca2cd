"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insults by a lexicon learned from labels, and threat verbs,
auxiliaries, targets, negations and reporting verbs by short fixed lists. Five
sequential transducers read the symbols of a clause one after another, each adding
its mark to what the one before wrote: reported speech, negation, target, threat,
insult. Their composition is one automaton, and the weights on its arcs add up to
the features of a text: insults asserted, negated, reported or aimed at a target,
and threats. A logistic curve turns features into a score.

Training rows are those of the ``LABELLED_ROWS`` labelled ids that hash lowest. The
lexicon is learned in two passes over them. The first counts in how
many labelled texts each word and each word beginning occurs; all that are more
frequent in toxic texts go on. The second takes one neighbourhood of a candidate from each
text, the one that hashes lowest, and counts the distinct ones: copies of one text, edited
or not, agree on it, and a long text has one like any other, so words that only sit in a
much-copied or long toxic text gain nothing. The curve is fitted on the same rows.

Results by case: NULL and empty texts have no features and get the score of an
ordinary text; without labels the fixed lists alone decide; several labels of one
document count as toxic if one of them says so; repeated rows each get their row.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chatlake.llm.common import settled, texts
from chatlake.llm.wordhash import slices

LABELLED_ROWS = 50_000
# Labelled texts a candidate must be in, and those of different origin among them.
LEAST_TEXTS = 3
LEAST_PLACES = 4
STEMS = (4, 5, 6, 7)
# Forms that chance alone may add to the lexicon (a bound), and how much more frequent a form is in toxic texts.
ACCIDENT = 3.0
LEAST_RATIO = 20
GATHERED = 200_000

# Common words of the languages at hand.
THREAT_WORDS = frozenset("kill hurt shoot stab murder töten umbringen erschiessen tuer frapper matar golpear".split())
AUXILIARIES = frozenset("will gonna shall must werde wirst vais voy".split())
TARGETS = frozenset("you your yourself u du dich dir dein toi vous usted ti tú".split())
NEGATIONS = frozenset("not never isn aren nicht kein keine pas jamais nunca".split())
REPORTS = frozenset("said says wrote claimed quoted sagte schrieb écrit dijo escribió".split())

_CLAUSE = re.compile(r"[.!?;\n]+")
_WORD = re.compile(r"[^\W\d_]+")
FEATURES = ("asserted", "negated", "reported", "targeted", "threats")
# Where the fit starts, and where it stays if labels say nothing.
PRIOR = np.array([1.0, -0.3, 0.3, 0.3, 3.0])
PRIOR_BIAS = -3.0


class Transducer:
    """A sequential transducer: ``step(state, symbol)`` gives the next state and the output."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, other: "Transducer") -> "Transducer":
        """Composition: ``other`` reads what this one writes."""
        def step(state, symbol):
            mine, written = self.step(state[0], symbol)
            theirs, out = other.step(state[1], written)
            return (mine, theirs), out
        return Transducer((self.start, other.start), step)

    def table(self, symbols) -> dict:
        """All arcs reachable from the start, so that running it is one lookup per word."""
        arcs, open_states = {}, [self.start]
        while open_states:
            state = open_states.pop()
            if state in arcs:
                continue
            arcs[state] = {s: self.step(state, s) for s in symbols}
            open_states += [target for target, _ in arcs[state].values()]
        return arcs


def _marking(name: str, lasting: int | None) -> Transducer:
    """Marks what follows a ``name`` symbol: for ``lasting`` words, or to the end of the clause."""
    def step(left, symbol):
        kind, marks = symbol
        if kind == name:
            return (lasting or 1), (kind, marks)
        if left:
            return (left - 1 if lasting else left), (kind, marks | {name})
        return left, (kind, marks)
    return Transducer(0, step)


def _threatening(state, symbol):
    """An auxiliary, then a threat verb within four words, asserted: one threat."""
    kind, marks = symbol
    if kind == "auxiliary":
        return 4, (kind, marks)
    if kind == "threat" and state:
        return 0, ("threatened", marks)
    return max(0, state - 1), (kind, marks)


def _weighing(state, symbol):
    """The feature that a symbol adds to, or None."""
    kind, marks = symbol
    if kind not in ("insult", "threatened"):
        return state, None
    if "report" in marks:
        return state, "reported"
    if "negation" in marks:
        return state, "negated"
    if kind == "threatened":
        return state, "threats"
    return state, "targeted" if "target" in marks else "asserted"


KINDS = ("other", "insult", "threat", "auxiliary", "target", "negation", "report")
GRAMMAR = (
    _marking("report", None).then(_marking("negation", 3)).then(_marking("target", None))
    .then(Transducer(0, _threatening)).then(Transducer(0, _weighing))
)
ARCS = GRAMMAR.table([(k, frozenset()) for k in KINDS])
_SYMBOLS = {k: (k, frozenset()) for k in KINDS}
_FIXED = {w: k for k, words in (("threat", THREAT_WORDS), ("auxiliary", AUXILIARIES), ("target", TARGETS),
                                ("negation", NEGATIONS), ("report", REPORTS)) for w in words}


def forms(word: str) -> list[str]:
    """A word and its beginnings, as the lexicon knows them."""
    return [word, *(f"{word[:n]}-" for n in STEMS if len(word) > n)]


def insult_weight(word: str, lexicon: dict[str, float]) -> float:
    return max((lexicon[f] for f in forms(word) if f in lexicon), default=0.0)


def clause_features(text: str | None, lexicon: dict[str, float]) -> np.ndarray:
    """Weights that the grammar adds up over the clauses of a text."""
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    folded = text.lower()
    known: dict[str, float] = {}
    for word in set(_WORD.findall(folded)):
        if weight := insult_weight(word, lexicon):
            known[word] = weight
        elif _FIXED.get(word) == "threat":
            known[word] = 0.0
    if not known:
        return out  # no clause can match
    for clause in _CLAUSE.split(folded):
        words = _WORD.findall(clause)
        if known.keys().isdisjoint(words):
            continue
        state = GRAMMAR.start
        for word in words:
            weight = known.get(word, 0.0)
            kind = "insult" if weight else _FIXED.get(word, "other")
            state, feature = ARCS[state][_SYMBOLS[kind]]
            if feature:
                out[FEATURES.index(feature)] += weight or 1.0
    return np.minimum(out, 12.0)


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    weights: np.ndarray
    bias: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights + self.bias, -30, 30)))


# Stands for every text in the counts of forms; no form is empty.
_ALL = ""


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts per form and label, summed per part of a task."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def table() -> pa.RecordBatch:
        seen = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.string()), *(pa.array([c[f] for f in seen], pa.int64()) for c in counts)],
            ["form", "clean", "toxic"])

    for batch in batches:
        for part in slices(batch, "text"):
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                words = set(_WORD.findall((text or "").lower()))
                counts[toxic].update({f for w in words for f in forms(w)})
                counts[toxic][_ALL] += 1
            if len(counts[0]) + len(counts[1]) > GATHERED:
                yield table()
                for c in counts:
                    c.clear()
    if counts[0] or counts[1]:
        yield table()


def _places(candidates: frozenset[str]):
    """One row per candidate form and text of a slice, with the lowest-hashing neighbourhood; equal rows once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = set()
                for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                    words = ["", *_WORD.findall((text or "").lower()), ""]
                    held = {w: [f for f in forms(w) if f in candidates] for w in set(words[1:-1])}
                    lowest: dict[str, tuple[int, str]] = {}
                    for i, word in enumerate(words[1:-1], 1):
                        if held[word]:
                            place = f"{words[i - 1]} {words[i + 1]}"
                            mark = (zlib.crc32(place.encode()), place)
                            for form in held[word]:
                                if form not in lowest or mark < lowest[form]:
                                    lowest[form] = mark
                    found.update((form, place, toxic) for form, (_, place) in lowest.items())
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.string(), pa.int32()))],
                        ["form", "place", "toxic"])
    return run


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Log odds of the forms that mark toxic texts, from rows (text, toxic)."""
    counted = labelled.mapInArrow(_occurrences, "form string, clean bigint, toxic bigint").groupBy("form").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = settled(counted, "forms")
    tested = counted.where(F.col("toxic") + F.col("clean") >= LEAST_TEXTS).count()
    whole = counted.where(F.col("form") == _ALL).first()
    if whole is None or not whole["toxic"] or not whole["clean"]:
        return {}
    usual = whole["toxic"] / (whole["toxic"] + whole["clean"])
    # As many forms as a bounded number of labelled texts holds.
    likely = counted.where((F.col("toxic") >= LEAST_TEXTS) & (F.col("toxic") > F.col("clean")) & (F.col("form") != _ALL))
    candidates = frozenset(likely.select("form").toArrow().column(0).to_pylist())
    if not candidates:
        return {}
    places = labelled.mapInArrow(_places(candidates), "form string, place string, toxic int").distinct()
    odds = places.groupBy("form").agg(
        F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean"))
    # Chernoff's bound on how likely so many toxic texts are by chance, for as many forms as were looked at.
    n, share = F.col("toxic") + F.col("clean"), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    clean_part = F.when(F.col("clean") > 0, (1 - share) * F.log((1 - share) / (1 - usual))).otherwise(0.0)
    surprise = n * (share * F.log(share / usual) + clean_part)
    chosen = odds.where((F.col("toxic") >= LEAST_PLACES) & (F.col("toxic") >= LEAST_RATIO * F.col("clean"))
                        & (surprise >= float(np.log(max(1, tested) / ACCIDENT))))
    # At most as many rows as there were candidates.
    return {r["form"]: round(float(np.log((r["toxic"] + 0.5) / (r["clean"] + 0.5))), 6) for r in chosen.collect()}


def fit(features: np.ndarray, toxic: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression held near the prior weights; a weight no row has stays there."""
    x = np.hstack([features, np.ones((len(features), 1))])
    prior = np.append(PRIOR, PRIOR_BIAS)
    hold = np.append(np.full(len(PRIOR), 1.0), 0.1)
    weights = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (toxic - p) - hold * (weights - prior)
        curvature = (x * (p * (1 - p))[:, None]).T @ x + np.diag(hold)
        move = np.linalg.solve(curvature, gradient)
        weights += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return weights[:-1], float(weights[-1])


def _features(lexicon: dict[str, float], keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [clause_features(t, lexicon) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))],
                    [*keep, "features"])
    return run


def train(labelled: DataFrame) -> Model:
    """From rows (text, toxic), of which there is a bounded number."""
    lexicon = learn_lexicon(labelled)
    rows = labelled.select("text", "toxic").mapInArrow(_features(lexicon, ("toxic",)), "toxic int, features array<double>").toArrow()
    if not rows.num_rows:
        return Model(lexicon, PRIOR, PRIOR_BIAS)
    features = np.array(rows.column("features").to_pylist())
    return Model(lexicon, *fit(features, np.asarray(rows.column("toxic"), dtype=np.float64)))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _features(model.lexicon, ("doc_id", "held_out"))(batches):
            scores = np.round(model.scores(np.array(batch.column("features").to_pylist()).reshape(-1, len(FEATURES))), 9)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores),
                 pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
    return run


def _model(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str, text_col: str, toxic_col: str) -> Model:
    rows = texts(docs, id_col, text_col, held_out=F.coalesce(held_out, F.lit(False)))
    marks = labels.select(labels[id_col].cast("bigint").alias("doc_id"), labels[toxic_col].cast("int").alias("toxic"))
    marks = marks.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # A bounded number of narrow rows, so no text moves.
    marks = marks.where(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS)
    return train(rows.where(~F.col("held_out")).join(F.broadcast(marks), "doc_id").select("text", "toxic"))


def score_documents(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id",
                    text_col: str = "text", toxic_col: str = "toxic") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted. Rows held out teach nothing."""
    model = _model(docs, labels, held_out, id_col, text_col, toxic_col)
    rows = texts(docs, id_col, text_col, held_out=F.coalesce(held_out, F.lit(False)))
    return rows.mapInArrow(_score(model), "doc_id bigint, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id",
                  text_col: str = "text", toxic_col: str = "toxic", bar: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``bar``, with all their columns; no row moves."""
    model = _model(docs, labels, held_out, id_col, text_col, toxic_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                rows = np.array([clause_features(t, model.lexicon) for t in part.column(text_col).to_pylist()])
                yield part.filter(pa.array(model.scores(rows.reshape(-1, len(FEATURES))) < bar))

    return docs.mapInArrow(run, docs.schema)
