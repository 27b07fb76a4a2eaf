"""Hard negatives: mining against brute force, and the tree's radii and pruning."""

import math

import numpy as np
import pytest

from mealgrid.llm import negatives
from mealgrid.llm.negatives import CoverTree
from tests.llm.cases import rows

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, x string, shard string, block string, item string"


def frame(spark, items):
    return spark.createDataFrame([(i, v, label, *["z"] * 5) for i, v, label in items], SCHEMA).repartition(3)


def brute(items):
    """(anchor, positive, rank, negative, positive's score, negative's score) of (id, vector, label) rows."""
    part = []
    for i, v, label in items:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(256 * float(np.float32(x))) for x in v]
        part.append((i, (label + 1) % 10 if i % 7 == 0 else label, whole))
    out = []
    anchors = {}
    for i, label, v in part:
        if i % 50 == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    for i, (label, v) in anchors.items():
        others = [(j, other, sum(a * b for a, b in zip(v, w))) for j, other, w in part if j != i]
        others.sort(key=lambda r: (-r[2], r[0]))
        for p, _, s in [r for r in others if r[1] == label][:5]:
            found = [r for r in others if r[1] != label and 50 * s <= 100 * r[2] <= 95 * s][:3]
            out += [(i, p, k, n, s, t) for k, (n, _, t) in enumerate(found, 1)]
    return sorted(out, key=repr)


def clustered(n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    return [(i, (centres[i % 12] + 0.2 * rng.normal(size=8)).astype("float32").tolist(), int(rng.integers(0, 10))) for i in range(n)]


@pytest.mark.parametrize("shard,block", [(4096, 512), (40, 3)])
def test_mined_equals_brute_force(spark, shard, block):
    items = clustered(600)
    assert rows(negatives.mined(frame(spark, items), shard=shard, block=block)) == brute(items)


def test_awkward_rows(spark):
    one = [1.0, 0.5, 0.25]
    items = [
        (0, one, 1), (1, one, 1), (2, one, 1), (2, one, 1), (3, [0.9, 0.5, 0.2], 2), (4, [0.9, 0.5, 0.2], 2), (4, [0.9, 0.5, 0.2], 2),
        (50, one, 3), (50, [0.5], 2), (51, [0.5, 0.1], 2), (100, [], 1), (101, [], 1), (102, [], 2), (150, [-1.0, 0.0], 4), (151, [1.0, 0.0], 4),
        (None, one, 1), (5, None, 1), (6, one, None), (8, [1.0, None], 2), (9, [float("nan")], 2), (10, [float("inf")], 2), (200, [3e3, 7e6], 5),
        (201, [3e3, 7e6], 5), (202, [2.9e3, 6e6], 6), (7, one, 9),
    ]
    assert rows(negatives.mined(frame(spark, items))) == brute(items)
    assert negatives.mined(frame(spark, [])).collect() == []


def test_many_equal_rows(spark):
    items = [(0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.75, 0.75], 3)] + [(9, [0.8, 0.8], 2)] * 3000
    assert rows(negatives.mined(frame(spark, items), shard=500)) == brute(items)


def test_tree_covers_and_prunes():
    rng = np.random.default_rng(2)
    points = np.floor(256 * (rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] + 0.05 * rng.normal(size=(4000, 16))))
    tree = CoverTree.unpacked(CoverTree.of(np.arange(4000), np.zeros(4000, "int64"), points).packed())
    assert sorted(tree.ids.tolist()) == list(range(4000))
    lift = np.sqrt(np.maximum((points**2).sum(axis=1).max() - (tree.points**2).sum(axis=1), 0))

    def rows_of(v):
        if tree.leaf[v]:
            return list(range(tree.first[v], tree.last[v]))
        return [r for c in range(tree.first[v], tree.last[v]) for r in rows_of(c)]

    centre_lift = np.sqrt(np.maximum((points**2).sum(axis=1).max() - (tree.centres**2).sum(axis=1), 0))
    for v in range(len(tree.radii)):
        r = rows_of(v)
        far = np.sqrt(((tree.points[r] - tree.centres[v]) ** 2).sum(axis=1) + (lift[r] - centre_lift[v]) ** 2)
        assert far.max() <= tree.radii[v] + 1e-6
    asked = points[:20]
    low, high = np.full((20, 1), -np.inf), np.full((20, 1), np.inf)
    a, _, ids, score, verified = tree.search(np.arange(20), np.zeros(20, "int64"), asked, low, high, 5, True)
    for i in range(20):
        every = points @ asked[i]
        want = [j for j in np.lexsort((np.arange(4000), -every)) if j != i][:5]
        assert sorted(zip((-score[a == i]).tolist(), ids[a == i].tolist())) == [(-int(every[j]), j) for j in want]
    assert verified < 0.2 * 20 * 4000


def test_a_leaf_meets_its_anchors_in_one_product(monkeypatch):
    rng = np.random.default_rng(5)
    points = np.floor(256 * rng.normal(size=(600, 16)))
    tree = CoverTree.of(np.arange(600), rng.integers(0, 3, 600), points)
    calls, plain = [], negatives.scores
    monkeypatch.setattr(negatives, "scores", lambda a, b: calls.append((a.shape, b.shape)) or plain(a, b))
    low, high = np.full((100, 2), [-np.inf, 0.0]), np.full((100, 2), [np.inf, 1e6])
    own, label = np.arange(100), tree.labels[np.argsort(tree.ids)][:100]
    a, w, ids, score, verified = tree.search(own, label, points[:100], low, high, 5, False)
    # Points are never copied for each anchor that looks at them, and few steps are taken.
    assert all(len(b) == 2 for _, b in calls) and len(calls) <= 6 * int(tree.leaf.sum())
    assert verified == sum(a[0] * b[0] for a, b in calls)
    all_labels, want = tree.labels[np.argsort(tree.ids)], []
    for i in range(100):
        ranked = sorted((-int(points[i] @ points[j]), j) for j in range(600) if all_labels[j] != all_labels[i])
        for window, least in enumerate((-np.inf, 0.0)):
            want += [(i, window, j, -s) for s, j in [r for r in ranked if least <= -r[0] <= (np.inf, 1e6)[window]][:5]]
    assert sorted(zip(a.tolist(), w.tolist(), ids.tolist(), score.tolist())) == sorted(want)
