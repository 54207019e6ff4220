"""Quadtree cuts and point features against plain versions."""

import heapq
import random
import struct

import numpy as np
import pytest

from strataframe.operators import clouds
from strataframe.operators import quadtree as Q


def morton(x, y):
    return sum(((x >> i) & 1) << 2 * i | ((y >> i) & 1) << 2 * i + 1 for i in range(31))


def fit(points):
    p = np.array(points)
    if len(p) < 2:
        return 0.0
    spread = ((p[:, 2] - p[:, 2].mean()) ** 2).sum()
    c = p[:, :2] - p[:, :2].mean(0)
    if len(p) < 3 or np.linalg.det(c.T @ c) <= 1e-6 * (c[:, 0] ** 2).sum() * (c[:, 1] ** 2).sum():
        return spread
    a = np.c_[c, np.ones(len(p))]
    return ((p[:, 2] - a @ np.linalg.lstsq(a, p[:, 2], rcond=None)[0]) ** 2).sum()


def plain_cut(cells, budget):
    """cells: {(kx, ky): (x, y, z)}; by a priority queue."""
    nodes, level = {}, 0
    edge = {k: any((k[0] + i, k[1] + j) not in cells for i in (-1, 0, 1) for j in (-1, 0, 1)) for k in cells}
    now = {morton(*k): [k] for k in cells}
    while True:
        nodes |= {(level, c): ks for c, ks in now.items()}
        if len(now) <= 1:
            break
        up = {}
        for c, ks in now.items():
            up.setdefault(c >> 2, []).extend(ks)
        now, level = up, level + 1
    kids = lambda n: [(n[0] - 1, n[1] * 4 + i) for i in range(4) if (n[0] - 1, n[1] * 4 + i) in nodes]
    res = {n: fit([cells[k] for k in ks]) for n, ks in nodes.items()}
    is_edge = lambda n: any(edge[k] for k in nodes[n])
    active, count, queue, full = {(level, c) for c in now}, len(now), [], False

    def push(n):
        if n[0] and not is_edge(n) and len(kids(n)) > 1:
            gain = round(max(0.0, res[n] - sum(map(res.get, kids(n)))) / (len(kids(n)) - 1), 9)
            heapq.heappush(queue, (-gain, -n[0], -n[1], n))

    for lev in range(level, 0, -1):
        for n in sorted((n for n in active if n[0] == lev and is_edge(n)), key=lambda n: -n[1]):
            if count + len(kids(n)) - 1 > budget:
                full = True
                break
            count += len(kids(n)) - 1
            active = active - {n} | set(kids(n))
        if full:
            break
    for n in active if not full else ():
        push(n)
    while queue:
        gain, *_, n = heapq.heappop(queue)
        if gain >= 0 or count + len(kids(n)) - 1 > budget:
            break
        count += len(kids(n)) - 1
        active = active - {n} | set(kids(n))
        for k in kids(n):
            push(k)
    return sorted((n[0], n[1], len(nodes[n])) for n in active)


@pytest.mark.parametrize("budget", [1, 3, 40, 90, 140, 1000])
def test_the_cut_is_that_of_a_priority_queue(spark, monkeypatch, budget):
    rng = random.Random(3)
    cells = {(i, j): (i + 0.5, j + 0.5, round(rng.random() * 4 * (i > 7) + (i * 0.5 if j < 6 else 20), 3)) for i in range(15) for j in range(13) if (i, j) not in ((7, 7), (8, 7))}
    points = spark.createDataFrame([(x + 100, y - 40, z) for x, y, z in cells.values()] + [(float("nan"), 0.0, 0.0), (1.0, 1.0, None)], "x double, y double, z double")
    leaves = Q.leaves(points, 1.0, 100.0, -40.0)
    want = plain_cut(cells, budget)
    for ordered in (20_000, 5):  # the second: every cut is found by histograms
        monkeypatch.setattr(Q, "ORDERED", ordered)
        got = Q.cut(leaves, budget, 100.0, -40.0).collect()
        assert sorted((r["level"], r["code"], r["n"]) for r in got) == want, ordered
        assert len(got) <= max(1, budget) and all(100 <= r["x"] <= 115 for r in got)


def test_an_empty_terrain(spark):
    none = Q.leaves(spark.createDataFrame([], "x double, y double, z double"), 1.0, 0.0, 0.0)
    assert Q.cut(none, 10).count() == 0 == Q.levels(none).count()


def plain_features(points, scales=clouds.SCALES):
    p = np.array(points)
    o = p - p.min(0)
    out = []
    for k in range(len(p)):
        row = []
        for s in scales:
            v = np.floor(o / s)
            near = o[(np.abs(v - v[k]) <= 1).all(1)]
            values, vectors = np.linalg.eigh(np.cov(near.T, bias=True)) if len(near) > 1 else (np.zeros(3), np.eye(3))
            small, middle, large = np.maximum(values, 0)
            if len(near) >= 4 and large > 1e-12:
                n = vectors[:, 0] * (-1 if vectors[2, 0] < 0 else 1)
                row += [(large - middle) / large, (middle - small) / large, small / large, 1 - n[2], (o[k] - near.mean(0)) @ n / s]
            else:
                row += [-1.0] * 5
            row += [(o[k, 2] - near[:, 2].min()) / s, (near[:, 2].max() - o[k, 2]) / s]
        out.append(row)
    return np.array(out)


def test_point_features(spark):
    rng = np.random.default_rng(1)
    p = np.r_[rng.uniform(0, 9, (150, 3)) * [1, 1, 0.2] + [0, 0, 1], rng.uniform(0, 1, (40, 3)) * [0.1, 0.1, 6], [[50.0, 50, 50], [70, 70, 0]]] + [1e6, -2e6, 300]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)] + [(999, float("nan"), 0.0, 0.0), (998, None, 1.0, 1.0)], "point long, x double, y double, z double").repartition(3)
    names = [f"{c}_{k}" for k in range(4) for c in clouds.PER_SCALE]
    got = clouds.point_features(df).orderBy("point").collect()
    assert [r["point"] for r in got] == list(range(len(p))) and [got[0][c] for c in "xyz"] == p[0].tolist()
    assert np.allclose(np.array([[r[c] for c in names] for r in got]), plain_features(p), atol=1e-5)
    assert clouds.point_features(df.where("false")).count() == 0


def plain_vote(forest_trees, row, classes):
    votes = [0] * classes
    for nodes, leaves in forest_trees:
        n = nodes[0]
        for _ in range(len(nodes)):
            if n[0] == clouds.LEAF:
                break
            n = nodes[n[1] if np.float32(row[n[0]]) <= np.float32(n[3]) else n[2]]
        if n[0] == clouds.LEAF:
            votes = [v + int(w) for v, w in zip(votes, leaves[n[1]], strict=True)]
    return max(range(classes), key=lambda c: (votes[c], -c))


def packed(features, classes, trees):
    out = clouds.MAGIC + struct.pack("<BBH", features, classes, len(trees))
    for nodes, leaves in trees:
        out += struct.pack("<HH", len(nodes), len(leaves)) + b"".join(struct.pack("<BHHf", *n) for n in nodes) + bytes(w for row in leaves for w in row)
    return out


def test_the_forest_and_its_file(spark):
    rng = random.Random(8)

    def grow(nodes, leaves, depth):
        at = len(nodes)
        nodes.append(None)
        if depth == 0 or rng.random() < 0.2:
            leaves.append([rng.randrange(256) for _ in range(3)])
            nodes[at] = (clouds.LEAF, len(leaves) - 1, 0, 0.0)
        else:
            f, t = rng.randrange(4), rng.uniform(-1, 1)
            left = grow(nodes, leaves, depth - 1)
            nodes[at] = (f, left, grow(nodes, leaves, depth - 1), t)
        return at

    trees = []
    for _ in range(15):
        nodes, leaves = [], []
        grow(nodes, leaves, 5)
        trees.append((nodes, leaves))
    trees.append(([(0, 0, 0, 9.0)], [[1, 1, 1]]))  # leads round and votes for nothing
    data = packed(4, 3, trees)
    forest = clouds.Forest.parse(data)
    rows = [[rng.uniform(-1.2, 1.2) for _ in range(4)] for _ in range(400)]
    want = [plain_vote(trees, r, 3) for r in rows]
    assert forest.predict(np.array(rows)).tolist() == want
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k long, a double, b double, c double, d double").repartition(3)
    assert [r["cls"] for r in clouds.classify(df, ["a", "b", "c", "d"], forest).orderBy("k").collect()] == want
    bad = {"cut short": data[:-1], "goes on": data + b"x", "unknown": b"IRF2" + data[4:], "9 classes": packed(4, 9, []), "nowhere": packed(4, 3, [([(7, 0, 0, 0.0)], [])])}
    for text, content in bad.items():
        with pytest.raises(ValueError, match=text):
            clouds.Forest.parse(content)
    with pytest.raises(ValueError, match="nowhere|empty"):
        clouds.Forest.parse(packed(4, 3, [([], [])]))
