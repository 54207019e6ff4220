"""Lists, chains, arrangements, overlaps and rays against plain versions and known areas."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.operators import lists, surfaces

CORNERS = ", ".join(f"{p}{c} double" for p in "abc" for c in "xyz")


def test_lists_and_rings_are_ranked(spark):
    rng = random.Random(4)
    prev, want, at = {}, {}, 0
    for n, ring in [(1, False), (1, True), (2, True), (3, False), (7, True), (33, False), (64, True), (100, False)]:
        ids = list(range(at, at + n))
        rng.shuffle(ids)
        at += n
        if ring:
            k = ids.index(min(ids))
            ids = ids[k:] + ids[:k]
        for i, e in enumerate(ids):
            prev[e] = ids[i - 1] if i or ring else None
            want[e] = (ids[0], i, ring)
    df = spark.createDataFrame([(e, p, e) for e, p in prev.items()], "elem long, prev long, key long")
    assert {r["elem"]: (r["head"], r["rank"], r["closed"]) for r in lists.ranked(df).collect()} == want
    assert lists.ranked(df.where("false")).count() == 0


def plain_chains(segments, tol):
    q = lambda x, y: (round(x / tol), round(y / tol))
    segs = [(q(*s[:2]), q(*s[2:])) for s in segments if q(*s[:2]) != q(*s[2:])]
    ends = {}
    for i, (a, b) in enumerate(segs):
        ends.setdefault(a, []).append((b, i, 0))
        ends.setdefault(b, []).append((a, i, 1))
    mate = {}
    for at in ends.values():
        at.sort()
        for (_, i, e), (_, j, f) in zip(at[::2], at[1::2]):
            mate[i, e], mate[j, f] = (j, f), (i, e)
    out, seen = [], set()
    for i in range(len(segs)):
        if i in seen:
            continue
        walk, now, closed = [], (i, 0), False
        while now not in walk:
            walk.append(now)
            before = mate.get(now)
            if before is None:
                break
            now = (before[0], 1 - before[1])
        else:
            closed = True
        if closed:
            pts = [segs[a][e] for a, e in reversed(walk)]
            seen |= {a for a, _ in walk}
            k = min(range(len(pts)), key=lambda j: pts[j])
            pts = pts[k:] + pts[:k]
            pts = min(pts, [pts[0], *pts[:0:-1]]) if len(pts) > 1 else pts
            out.append((True, pts))
            continue
        now, pts = walk[-1], []
        while True:
            a, e = now
            seen.add(a)
            pts.append(segs[a][e])
            after = mate.get((a, 1 - e))
            if after is None:
                pts.append(segs[a][1 - e])
                break
            now = after
        out.append((False, min(pts, pts[::-1])))
    return sorted(out)


def chains_of(spark, segments, tol=1e-6):
    df = spark.createDataFrame([(5.0, *map(float, s)) for s in segments], "level double, x1 double, y1 double, x2 double, y2 double").repartition(3)
    got = {}
    for r in surfaces.chain_segments(df, tol).orderBy("chain", "place").collect():
        got.setdefault((r["chain"], r["closed"]), []).append((round(r["x"] / tol), round(r["y"] / tol)))
    return sorted((closed, pts) for (_, closed), pts in got.items())


def test_chains(spark):
    line = [(i, i * i, i + 1, (i + 1) ** 2) for i in range(40)]
    ring = [(10 + math.cos(t), -5 + math.sin(t)) for t in np.linspace(0, 2 * math.pi, 24)[:-1]]
    ring = [(*a, *b) for a, b in zip(ring, ring[1:] + ring[:1])]
    cross = [(100, 100, 101, 101), (101, 101, 102, 100), (101, 101, 100, 102), (101, 101, 102, 102), (101, 101, 101, 105)]
    rng = random.Random(2)
    segments = [s if rng.random() < 0.5 else (*s[2:], *s[:2]) for s in line + ring + cross + [(7, 7, 7, 7), (50, 50, 51, 51)]]
    rng.shuffle(segments)
    got = chains_of(spark, segments)
    assert got == plain_chains(segments, 1e-6)
    assert [len(p) for c, p in got if c] == [23] and max(len(p) for c, p in got if not c) == 41


def area(face):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(face, face[1:] + face[:1])) / 2


def faces_of(spark, segments, size=2.0):
    df = spark.createDataFrame([tuple(map(float, s)) for s in segments], "x1 double, y1 double, x2 double, y2 double")
    got = {}
    for r in surfaces.arrangement(df, size).orderBy("face", "place").collect():
        got.setdefault((r["face"], r["area"]), []).append((r["x"], r["y"]))
    assert all(area(p) == pytest.approx(a) for (_, a), p in got.items())
    return sorted(round(a, 6) for _, a in got)


def test_arrangements(spark):
    square = [(0, 0, 6, 0), (6, 0, 6, 6), (6, 6, 0, 6), (0, 6, 0, 0)]
    assert faces_of(spark, square) == [36.0]
    lattice = [(x, -1, x, 7) for x in range(7)] + [(-1, y, 7, y) for y in range(7)]
    assert faces_of(spark, lattice) == [1.0] * 36
    # diagonals, a repeated edge, a T, a hanging line and a separate square inside
    cuts = square + [(0, 0, 6, 6), (6, 0, 0, 6), (0, 0, 3, 0), (3, 3, 3, 0), (3, 4, 3, 5)]
    assert faces_of(spark, cuts) == [4.5, 4.5, 9.0, 9.0, 9.0]
    assert faces_of(spark, square + [(1, 1, 2, 1), (2, 1, 2, 2), (2, 2, 1, 2), (1, 2, 1, 1)]) == [1.0, 36.0]
    assert faces_of(spark, [(0, 0, 5, 5), (5, 5, 9, 0)]) == []
    # a long zig-zag ring
    n = 60
    top = [(i, 2 + i % 2) for i in range(n)]
    ring = top + [(n - 1, 0), (0, 0)]
    assert faces_of(spark, [(*a, *b) for a, b in zip(ring, ring[1:] + ring[:1])]) == [pytest.approx(2.5 * (n - 1))]


def mesh(spark, triangles):
    return spark.createDataFrame([(i, *[float(v) for p in t for v in p]) for i, t in enumerate(triangles)], "face long, " + CORNERS)


def grid(n, size, height, flip=False):
    p = lambda i, j: (i * size / n, j * size / n, height(i * size / n, j * size / n))
    out = []
    for i in range(n):
        for j in range(n):
            a, b, c, d = p(i, j), p(i + 1, j), p(i + 1, j + 1), p(i, j + 1)
            out += [(a, b, d), (b, d, c)] if flip else [(a, b, c), (a, c, d)]
    return out


def test_overlaps_of_known_areas(spark):
    a, b = mesh(spark, [((0, 0, 1), (4, 0, 1), (0, 4, 1))]), mesh(spark, [((4, 4, 0), (0, 4, 0), (4, 0, 0)), ((0, 0, 0), (2, 0, 4), (0, 2, 0)), ((9, 9, 9), (9, 9, 0), (8, 9, 1))])
    got = {r["lower"]: r for r in surfaces.triangle_overlaps(a, b, 3.0).collect()}
    assert set(got) == {1}
    r = got[1]
    # z = 2x over a triangle of area 2: higher than 1 where x > 0.5
    assert r["area"] == pytest.approx(2.0) and (r["low"], r["high"]) == pytest.approx((-3.0, 1.0))
    assert r["above"] - r["below"] == pytest.approx(2.0 - 2 * 2 / 3 * 2)
    for cellsize in (0.7, 50.0):
        u, v = mesh(spark, grid(5, 10.0, lambda x, y: 3 + x * 0.5)), mesh(spark, grid(7, 10.0, lambda x, y: y * 0.8, True))
        t = surfaces.triangle_overlaps(u, v, cellsize)
        sums = t.agg(F.sum("area"), F.sum(F.col("above") - F.col("below")), F.min("low"), F.max("high")).first()
        assert tuple(sums) == pytest.approx((100.0, 100 * (3 + 2.5 - 4.0), -5.0, 8.0))
        assert t.groupBy("upper", "lower").count().where("count > 1").count() == 0


def test_rays_hit_what_plain_ones_do(spark):
    rng = np.random.default_rng(3)
    tri = rng.uniform(0, 20, (200, 1, 3)) + rng.uniform(-4, 4, (200, 3, 3))
    tri[:5, :, 0] = tri[:5, :1, 0]  # upright ones
    rays = np.c_[rng.uniform(0, 20, (80, 3)), rng.uniform(-15, 15, (80, 3))]
    rays[:20, 3:5] = 0
    rays[20:30, 4] = 0
    rays[79, 3:] = 0
    want = {}
    for k, r in enumerate(rays):
        o, d = r[:3], r[3:]
        for f, (a, b, c) in enumerate(tri):
            m = np.c_[-d, b - a, c - a]
            if abs(np.linalg.det(m)) > 1e-12:
                t, u, v = np.linalg.solve(m, o - a)
                if 0 <= t <= 1 and u >= 0 and v >= 0 and u + v <= 1:
                    want[k] = min(want.get(k, (9, 0)), (t, f))
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rays)] + [(900, 1.0, float("nan"), 0.0, 1.0, 1.0, 1.0), (901, None, 1.0, 0.0, 1.0, 1.0, 1.0)], "ray long, ox double, oy double, oz double, dx double, dy double, dz double")
    for size in (1.5, 7.0, 100.0):
        got = {r["ray"]: (r["t"], r["face"]) for r in surfaces.ray_hits(df, mesh(spark, tri), size).collect()}
        assert set(got) == set(want) and len(want) > 20
        assert all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0]) for k in want)
