import numpy as np

from chatlake.llm.neighbours import Block, nearest_neighbours


def exact(rows, every, k):
    out = {}
    for q, v in rows.items():
        if q % every == 0:
            scores = sorted((-float(np.dot(v, w)), i) for i, w in rows.items() if i != q)
            out[q] = [i for _, i in scores[:k]]
    return out


def table(spark, rows, more=()):
    return spark.createDataFrame([(i, v.tolist(), 1) for i, v in rows.items()] + list(more),
                                 "vec_id bigint, embedding array<float>, label int")


def test_recall_order_and_scores(spark):
    rng = np.random.default_rng(5)
    rows = {i: (rng.standard_normal(24) * rng.uniform(0.5, 2)).astype(np.float32).astype(float) for i in range(1500)}
    rows[77] = rows[40].copy()  # a tie
    found = nearest_neighbours(table(spark, rows), every=20, k=10, block_rows=400, query_rows=30).collect()
    expected, got = exact(rows, 20, 10), {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert abs(r.score - float(np.dot(rows[r.query_id], rows[r.vec_id]))) < 1e-9
    hits = sum(len({i for i, _ in got[q]} & set(e)) for q, e in expected.items())
    assert got.keys() == expected.keys() and hits >= 0.95 * 10 * len(expected)
    for q, near in got.items():
        assert near == sorted(near, key=lambda x: (-x[1], x[0])) and q not in [i for i, _ in near] and len(near) == 10


def test_unusable_vectors_take_no_part(spark):
    rows = {i: np.array([1.0, i, 0.0]) for i in range(6)}
    bad = [(20, None, 1), (40, [0.0, 0.0, 0.0], 1), (60, [1.0, None, 2.0], 1), (80, [1.0, float("nan"), 1.0], 1),
           (100, [float("inf"), 1.0, 1.0], 1), (120, [1.0], 1), (None, [1.0, 1.0, 1.0], 1), (0, [1.0, 0.0, 0.0], 1), (140, [], 1)]
    found = nearest_neighbours(table(spark, rows, bad)).collect()
    assert {r.query_id for r in found} == {0}
    # All candidates if there are fewer than asked for; all tie, so the smaller ids come first.
    assert [(r.rank, r.vec_id) for r in sorted(found, key=lambda r: r.rank)] == [(i, i) for i in range(1, 6)]


def test_empty_and_lone(spark):
    assert nearest_neighbours(table(spark, {})).count() == 0
    assert nearest_neighbours(table(spark, {0: np.ones(3)})).count() == 0


def test_a_known_score_settles_a_block_in_one_count():
    rng = np.random.default_rng(9)
    vectors = rng.standard_normal((3000, 32))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    block, counted = Block(np.arange(3000), vectors, 1.0), []
    count = block.collisions
    block.collisions = lambda *window: counted.append(1) or count(*window)
    for q in range(40):
        scores = np.delete(np.einsum("ij,j->i", vectors, vectors[q]), q)
        least = np.sort(scores)[-5]
        counted.clear()
        found = block.nearest(q, vectors[q], 20, least)
        # Only what reaches the score leaves the block, that score itself included.
        assert len(counted) == 1 and len(found) <= 5 and all(s >= least for _, s in found)
        assert len(found) >= 4


def test_copies_in_blocks_of_different_rounds_tie_by_id(spark):
    rng = np.random.default_rng(2)
    rows = {i: rng.standard_normal(48).astype(np.float32).astype(float) for i in range(200)}
    for i in range(200, 1200):
        rows[i] = rows[20].copy()
    found = nearest_neighbours(table(spark, rows), every=20, k=10, block_rows=100).where("query_id = 20").collect()
    assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"])] == list(range(200, 210))
    assert len({r.score for r in found}) == 1
