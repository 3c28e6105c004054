"""Hard negatives against all scores."""

import numpy as np
import pytest

import oracle
from encoscope.llm import negatives, queries
from encoscope.plans import Registered

SF = "/root/testdata/sf0.01"


def plain_negatives(rows):
    held = [(i, a, [int(np.floor(256 * x)) for x in v]) for i, v, a in rows if None not in (i, v, a) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    anchors = {}
    for i, a, w in sorted(held, reverse=True):
        if i % 100 == 0:
            anchors[i] = (a, w)
    for anchor, (a, w) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(w, v)), i, b) for i, b, v in held if i != anchor)
        for s, positive, _ in [x for x in scored if x[2] == a][:5]:
            fit = [(-t, i) for t, i, b in scored if b != a and -30 * s <= -100 * t <= -90 * s]
            out += [(anchor, positive, n + 1, i, -s, t) for n, (t, i) in enumerate(fit[:10])]
    return sorted(out)


def mined(spark, rows, **more):
    table = spark.createDataFrame([(i, v, a, 1, 2.0) for i, v, a in rows], "vec_id long, embedding array<double>, label int, score int, low double")
    return sorted(tuple(r) for r in negatives.hard_negatives(table, **more).collect())


def clustered(seed, n, dims, classes=5):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(classes, dims))
    labels = rng.integers(0, classes, n)
    values = middles[labels] + rng.normal(scale=0.7, size=(n, dims))
    return [(int(i), [float(x) for x in v], int((a + (i % 3 == 0)) % classes)) for i, (v, a) in enumerate(zip(values, labels))]


def test_query_agrees_with_sql(spark):
    item = Registered(queries.QUERIES["op11_hard_negatives"], queries.SQL["op11_hard_negatives"])
    assert oracle.difference(spark, "op11_hard_negatives", item, oracle.connect(SF), SF) is None


@pytest.mark.parametrize(("tree", "leaf", "group"), [(4096, 64, 1 << 25), (100, 8, 1 << 12), (16, 4, 1 << 10)])
def test_all_windows(spark, monkeypatch, tree, leaf, group):
    monkeypatch.setattr(negatives, "TREE_ROWS", tree)
    monkeypatch.setattr(negatives, "LEAF_ROWS", leaf)
    monkeypatch.setattr(negatives, "GROUP_BYTES", group)
    monkeypatch.setattr(negatives, "QUERY_ROWS", 3)
    rows = clustered(1, 700, 6)
    rows += [(1000 + k, rows[100][1], 3) for k in range(300)]  # a large group of copies, all ties
    want = plain_negatives(rows)
    assert len({r[0] for r in want}) > 5 and mined(spark, rows) == want


def test_odd_rows(spark):
    rows = clustered(2, 220, 3)
    odd = [(None, [1.0] * 3, 1), (300, None, 1), (400, [1.0, None, 1.0], 1), (500, [1.0, float("nan"), 0.0], 2), (600, [float("inf"), 0.0, 0.0], 2)]
    odd += [(700, [1.0, 1.0, 1.0], None), (800, [], 1), (900, [2.0], 2), (901, [2.0, 1.0], 1), (902, [0.0, 0.0, 0.0], 1), (1000, [-0.5, -0.5, -0.5], -4)]
    odd += [(1100, [3.0, 1.0, 1.0, 5.0], 2)] * 3 + [(5, rows[5][1], 4), (7, rows[7][1], rows[7][2])]
    assert mined(spark, rows + odd) == plain_negatives(rows + odd)
    assert mined(spark, []) == [] and mined(spark, odd[:2]) == []
    one_label = [(i, v, 1) for i, v, _ in rows]
    assert mined(spark, one_label) == []


def test_one_row_a_label(spark):
    assert mined(spark, [(100, [1.0], 1), (101, [1.0], 2)]) == []
    got = mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2), (3, [0.9], 2), (4, [0.95], 2), (5, [0.2], 2)])
    assert [(r[1], r[2], r[3]) for r in got] == [(1, 1, 3), (1, 2, 2)]


def test_bounds_hold_and_prune():
    rows = clustered(3, 2000, 4)
    ids, labels = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    weights = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64)
    tree = negatives.CoverTree(ids, labels, weights)
    asked = weights[::40].astype(np.float64)
    up, down = tree.bounds(asked, np.arange(len(tree.first)))
    scores = weights[::40] @ tree.weights.T
    for node in np.flatnonzero(tree.is_leaf):
        inside = scores[:, tree.begin[node] : tree.end[node]]
        assert (inside <= up[:, [node]]).all() and (inside >= down[:, [node]]).all()
    for node in np.flatnonzero(~tree.is_leaf):  # a level's balls cover its rows, and centres are apart
        children = np.arange(tree.first[node], tree.last[node])
        gaps = np.linalg.norm(tree.centres[children][:, None] - tree.centres[children][None], axis=2)
        assert tree.radius[children].max() <= gaps[~np.eye(len(children), dtype=bool)].min() + 1e-6
    best = negatives.Best(len(asked), 5)
    queries = negatives.Queries(ids[::40], labels[::40], weights[::40], np.full(len(asked), -(1 << 62)), np.full(len(asked), 1 << 62))
    assert negatives.search(tree, queries, best, True) < 0.5 * scores.size


def test_too_large_scores_are_an_error():
    with pytest.raises(OverflowError):
        negatives.exact_products(np.full((1, 4), 1 << 31), np.full((1, 4), 1 << 31))
    far = np.array([[(1 << 29) + 1, 3]])
    assert negatives.exact_products(far, far)(np.array([0]), slice(0, 1)).tolist() == [[((1 << 29) + 1) ** 2 + 9]]
