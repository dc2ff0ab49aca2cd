import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from chatlake.llm import nearcopies, repeats
from chatlake.llm.wordhash import Words
from chatlake.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    words = [w.translate(LOWER) for w in WORD.findall(text or "")]
    size = min(5, len(words))
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1)) if words else frozenset()


def groups(rows):
    """Smallest id reachable through links of all pairs; rows of one id are one document."""
    sets = [(i, shingles(t)) for i, t, *_ in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return {i: root(i) for i in parent}


def edited(rng, words, share):
    return [rng.choice("uvwxyz") * 3 if rng.random() < share else w for w in words]


def test_groups_of_near_copies(documents, messy_rows):
    rng = random.Random(4)
    rows = list(messy_rows)
    for group in range(6):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([30, 90, 300]))]
        # A chain: each copy is like the one before it, the ends are not alike.
        for _ in range(12):
            rows.append((100 + len(rows), " ".join(words), "en", "s"))
            words = edited(rng, words, 0.012)
    rng.shuffle(rows)
    expected = groups(rows)
    found = nearcopies.near_copies(documents(rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.component_id == (expected[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    sizes = {i: len(shingles(t)) for i, t, *_ in rows}
    assert all(r.n_shingles == sizes[r.doc_id] for r in found if r.doc_id is not None)


def test_sketches_keep_similar_pairs_and_rule_out_others(spark):
    rng = np.random.default_rng(8)
    rows = []
    for size in (1, 3, 20, 200, 3000, 20_000):
        for share in [0.02, 0.05, 0.075] * 8 + [0.4] * 4:
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            kept = a[: len(a) - round(share * size)]
            b = np.unique(np.concatenate([kept, rng.integers(0, 2**64, round(share * size), dtype=np.uint64)]))
            shared = len(np.intersect1d(a, b))
            similar = 100 * shared >= 85 * (len(a) + len(b) - shared)
            (x,), (y,) = (nearcopies.odd_sketches(s, np.array([0]), np.array([len(s)])) for s in (a, b))
            rows.append((len(a), len(b), x.tolist(), y.tolist(), similar))
    pairs = spark.createDataFrame(rows, "n_a bigint, n_b bigint, sketch_a array<bigint>, sketch_b array<bigint>, similar boolean")
    found = {(r.similar, r.n_a >= 200, r.likely) for r in pairs.withColumn("likely", nearcopies.plausible(85)).collect()}
    assert (True, True, True) in found and (False, True, False) in found
    assert not found & {(True, True, False), (True, False, False), (False, True, True)}


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, j) for j in range(101, 140)] + [(200, 200)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert found == {**{i: 0 for i in range(61)}, **{j: 100 for j in range(100, 140)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def left_over(rows, window):
    first = {}
    for i, t, *_ in rows:
        words = WORD.findall(t or "")
        for j in range(len(words) - window + 1):
            if i is not None:
                key = tuple(words[j:j + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t, *_ in rows:
        words = WORD.findall(t or "")
        gone = set()
        for j in range(len(words) - window + 1):
            if i is not None and first[tuple(words[j:j + window])] < i:
                gone.update(range(j, j + window))
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_repeated_passages_go(documents, messy_rows):
    rng = random.Random(6)
    passages = [[f"p{rng.randrange(50)}" for _ in range(rng.randint(4, 40))] for _ in range(8)]
    rows = list(messy_rows)
    for i in range(60):
        parts = rng.choices(passages, k=3) + [[f"q{rng.randrange(30)}" for _ in range(5)]]
        rng.shuffle(parts)
        rows.append((200 - i, " ".join(w for p in parts for w in p), "en", "s"))
    rows += [(300, "loop " * 200, "en", "s"), (299, "loop " * 90, "en", "s"), (23, "another text of the same id " * 9, "en", "s")]
    for window, anchor in ((6, 3), (50, 20)):
        found = repeats.remove_repeats(documents(rows), window=window, anchor=anchor, with_text=True).collect()
        assert sorted(map(repr, (tuple(r)[:4] for r in found))) == sorted(map(repr, left_over(rows, window)))
        for r in found:
            if r.n_removed:
                assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_a_span_that_differs_from_its_source_stops_the_job(documents, monkeypatch):
    rows = [(1, "a b c d e f g h", None, None), (2, "x a b c d e f g", None, None)]
    monkeypatch.setattr(repeats, "_checked", lambda *a: documents([(1, "different", None, None)]))
    try:
        repeats.remove_repeats(documents(rows), window=4, anchor=2)
    except RuntimeError as e:
        assert "source" in str(e)
    else:
        raise AssertionError("accepted")


def test_words_that_collide_are_told_apart(documents):
    # Two words of 2,048 letters whose hash by powers of an odd number is equal, whatever the letters count for.
    turns = [bin(i).count("1") % 2 for i in range(2048)]
    one, other = ("".join("ab"[t ^ flip] for t in turns) for flip in (0, 1))
    first, second = Words(pa.array([one, other])).hashes()
    assert first == second and len(set(Words(pa.array([one, other])).hashes(seed=1).tolist())) == 2
    tail = " ".join(f"w{i}" for i in range(7))
    rows = [(1, f"{one} {tail}", None, None), (2, f"{other} {tail}", None, None), (3, f"x {other} {tail}", None, None),
            (4, f"{tail} y", None, None)]
    found = repeats.remove_repeats(documents(rows), window=6, anchor=3).collect()
    assert sorted(map(repr, (tuple(r)[:4] for r in found))) == sorted(map(repr, left_over(rows, 6)))


def test_spans_of_a_hot_source_are_dealt_over_rows(documents, monkeypatch):
    monkeypatch.setattr(repeats, "SOURCE_SPANS", 3)
    passage = " ".join(f"p{i}" for i in range(9))
    rows = [(i, f"a{i} {passage} b{i} {passage} c{i}", None, None) for i in range(40)]
    found = repeats.remove_repeats(documents(rows), window=6, anchor=3).collect()
    assert sorted(map(repr, (tuple(r)[:4] for r in found))) == sorted(map(repr, left_over(rows, 6)))


def test_empty_tables(documents):
    assert nearcopies.near_copies(documents([])).count() == 0
    assert repeats.remove_repeats(documents([])).count() == 0
    lone = documents([(None, None, None, None), (1, None, None, None)])
    assert {(r.component_id, r.kept) for r in nearcopies.near_copies(lone).collect()} == {(None, True), (1, True)}
    assert {r.n_removed for r in repeats.remove_repeats(lone).collect()} == {0}
