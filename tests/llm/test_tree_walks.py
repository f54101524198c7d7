import numpy as np
import pytest

from notewell.llm import ann


def crowded(n=3000, dim=12, seed=5):
    """Vectors around 40 centres; every tenth one three times, under numbers of its own."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim)) * 3
    points = centres[rng.integers(0, 40, n)] + rng.normal(size=(n, dim)) * 0.7
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    rows += [(n + 2 * i + k, points[10 * i].tolist()) for i in range(n // 10) for k in range(2)]
    return rows


def brute(rows, every, k):
    ids, m = np.array([i for i, _ in rows]), ann.unit(np.array([v for _, v in rows]))
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = (m * m[i]).sum(axis=1)
        score[i] = -np.inf
        out[int(ids[i])] = [(int(ids[j]), score[j]) for j in np.lexsort((ids, -score))[:k]]
    return out


def test_the_walk_prunes_and_meets_the_target():
    rows = crowded()
    points = np.array([v for _, v in rows])
    tree = ann.fit(points, len(rows), 5, leaf_rows=32)
    assert tree.leaves > 50 and tree.visits < tree.leaves / 3
    assert sorted(tree.walk(ann.unit(points)[0])) == list(range(tree.leaves))
    leaf = tree.leaf_of(ann.unit(points))
    assert all(next(tree.walk(p)) >= 0 for p in ann.unit(points)[:5]) and len(np.unique(leaf)) == tree.leaves


@pytest.mark.parametrize("members, queries", [(16_384, 1024), (64, 8)])
def test_many_leaves_shelves_and_parties(spark, monkeypatch, members, queries):
    monkeypatch.setattr(ann, "MEMBERS_A_BLOCK", members)
    monkeypatch.setattr(ann, "QUERIES_A_BLOCK", queries)
    rows = crowded()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    found = {}
    for r in ann.nearest(table, 25, leaf_rows=32).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    wanted = brute(rows, 25, 5)
    assert found.keys() == wanted.keys() and all(len(x) == 5 for x in found.values())
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in wanted[q]}) for q in wanted)
    assert hits >= 0.9 * 5 * len(wanted)
    # Equal vectors have equal scores, and the smaller number comes first.
    assert all((-a[1], a[0]) < (-b[1], b[0]) for x in found.values() for a, b in zip(x, x[1:], strict=False))


def test_shelves_are_bounded():
    shelf, blocks = ann._shelves([5, 0, 5, 30, 1, 9, 9, 0], 10)
    assert shelf == [0, 0, 0, 1, 2, 2, 3, 3] and blocks == [1, 3, 1, 1]
    assert ann._shelves([0], 10) == ([0], [1])
