"""Centroid clustering, conversation repair and toxicity against plain versions; rows that share an id, whatever they hold."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataframe.llm import centroids, contamination, langid, lines, mixing, rulestats, sharding, toxicity, turns

from .conftest import words


def lloyd(vectors, k, rounds, seed=3):
    """(id, integer vector) -> assignment, squared distance, centroids; exact."""
    order = sorted(vectors, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[1]))
    points = [list(v) for _, v in order[:k]]
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for r in range(rounds + 1):
        at = [min(range(len(points)), key=lambda j: (dist(v, points[j]), j)) for _, v in vectors]
        if r == rounds:
            break
        for j in range(len(points)):
            mine = [v for (_, v), a in zip(vectors, at, strict=True) if a == j]
            if mine:
                points[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return at, [dist(v, points[a]) for (_, v), a in zip(vectors, at, strict=True)], points


@pytest.mark.parametrize("spread", [1, 3, 40])
def test_clusters_are_plain_lloyd(spark, spread):
    rng = random.Random(spread)
    vectors = [(i, [rng.randrange(-spread, spread + 1) for _ in range(3)]) for i in range(150)]
    vectors += [(3, vectors[3][1]), (None, vectors[4][1]), (7, [0, 0, 0])]  # repeated rows, ids and ties
    df = spark.createDataFrame([(i, [float(x) for x in v], "x") for i, v in vectors], "vec_id long, embedding array<double>, v string").repartition(3)
    out, points = centroids.cluster(df, k=6, rounds=5, dims=3, scale=1.0)
    at, d, want = lloyd(vectors, 6, 5)
    assert points.tolist() == want
    got = sorted((r["vec_id"] or -1, tuple(r["v"]), r["cluster"]) for r in out.collect())
    assert got == sorted((i or -1, tuple(v), a) for (i, v), a in zip(vectors, at, strict=True))
    rows = centroids.digest(out, points).collect()
    assert sorted(r["distance"] for r in rows) == sorted(d) and {r["inertia"] for r in rows} == {sum(d)}
    for r in rows:
        assert r["cluster_inertia"] == sum(x for x, a in zip(d, at, strict=True) if a == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, want[r["cluster"]])).encode()).hexdigest()


def test_the_search_skips_and_never_errs():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(m, 30, (400, 8)) for m in (0, 400, 900, 1500, 2200)]).astype(np.int64)
    points = x[rng.choice(len(x), 12, replace=False)].copy()
    centres = centroids.Centres(points)
    at, up, low = centroids.assign_all(x, centres)
    taken = 0
    for _ in range(8):
        points = points.copy()
        for a in np.unique(at):
            points[a] = x[at == a].sum(0) // (at == a).sum()
        centres = centroids.Centres(points, centres)
        at, up, low, n = centroids.exponion(x, at, up, low, centres)
        taken += n
        d = ((x[:, None] - points[None]) ** 2).sum(2)
        assert (at == d.argmin(1)).all()
        assert (up >= np.sqrt(d[np.arange(len(x)), at])).all() and (low <= np.sqrt(np.sort(d, 1)[:, 1])).all()
    assert taken < 0.5 * 8 * len(x) * len(points)


def test_vectors_that_take_no_part(spark):
    good = [[float(i), 2.0] for i in range(5)]
    bad = [None, [], [1.0], [1.0, 2.0, 3.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0]]
    df = spark.createDataFrame([(i, e, 0) for i, e in enumerate(good + bad + [[1e300, -1e300]])], "vec_id long, embedding array<double>, cluster int")
    out, points = centroids.cluster(df, k=8, rounds=3, dims=2, scale=1.0)
    assert sorted(r["vec_id"] for r in centroids.digest(out, points).collect()) == [0, 1, 2, 3, 4, 12] and len(points) == 6
    assert max(max(map(abs, r["v"])) for r in out.collect()) == centroids.LIMIT
    none, points = centroids.cluster(df.where("vec_id > 100"), k=8, rounds=3, dims=2)
    assert centroids.digest(none, points).count() == 0


WORD_CHAR = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def repaired(rows):
    """Faults and the best edits by trying all of them: rows (turn, role, text) in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        chars = WORD_CHAR.findall(text)
        faults.append("blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else None)
        seen.add((role, text))
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    best = None
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for edits in itertools.product(("K", "user", "assistant", "D"), repeat=len(rows)):
            cost, audit, made = 0, "", []
            for i, gap in enumerate(gaps):
                cost, audit, made = cost + 3 * len(gap), audit + "I" * len(gap), made + [(r, "") for r in gap]
                if i == len(rows):
                    continue
                _, role, text = rows[i]
                if edits[i] == "D":
                    cost, audit = cost + 4, audit + "D"
                    continue
                if faults[i] in ("blank", "duplicate"):
                    cost = 10**9
                cost += 3 * (faults[i] == "truncated") + 3 * (edits[i] != "K")
                audit += "K" if edits[i] == "K" else "R"
                made = made + [(role if edits[i] == "K" else edits[i], text)]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in made)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, made)
    pairs = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    known = [t for t, *_ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], pairs, *best[:2], "\n".join(f"{r}:{t}" for r, t in best[2]))


def test_repair_is_the_best_of_all_edits(spark):
    rng = random.Random(5)
    rows = []
    for conv in [*range(40), None]:
        for _ in range(rng.randrange(0, 3) if conv else 3):
            rows.append((conv, rng.choice([0, 1, 2, 5, None]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(["Yes.", "no", "Why? ", "\x0b \n", "", None, "Yes.", "Ünd!\t"])))
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, cost int").repartition(3)
    got = {r["conv_id"]: tuple(r)[1:] for r in turns.digest(turns.repair(turns.damage(df))).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, result in got.items():
        want = repaired(damaged([r for r in rows if r[0] == conv]))
        assert result == (*want[:-1], hashlib.sha256(want[-1].encode()).hexdigest()), conv
    assert turns.digest(turns.repair(turns.damage(df.where("false")))).count() == 0


def test_a_long_conversation_and_extreme_turns(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(3000)] + [(2, -(2**63), "user", "a."), (2, 2**63 - 1, "assistant", "b.")]
    got = {r["conv_id"]: r for r in turns.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1]["audit"] == "K" * 3000 and got[1]["cost"] == 0 and [tuple(t) for t in got[1]["repaired"]] == [r[2:] for r in rows[:3000]]
    assert got[2]["audit"] == "KK" and got[2]["gaps"] is None


@pytest.fixture(scope="module")
def net():
    rng = random.Random(2)
    bad = ["scoundrel", "villainous", "villainy"]
    rows = []
    for i in range(240):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 90))]
        for _ in range(3 if i % 2 else 0):
            w[rng.randrange(len(w))] = rng.choice(bad)
        ids, at = toxicity.tokens(pa.array([" ".join(w)]))
        rows.append((ids, i % 2, 1.0, ("en", "de")[i % 3 == 0]))
    return toxicity.fit(rows)


def plain_score(net, text, least=0.3):
    """One text at a time, word by word."""
    found = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text)) if w]
    if not found:
        z, lang = net.u0, net.langs.shape[1]
    else:
        ids = np.concatenate([toxicity.tokens(pa.array([w]))[0] for w in found])
        rows = net.index[ids]
        x = [sum(net.embed[r].astype(float) for r in row) for row in rows]
        h = []
        for k in toxicity.WIDTHS:
            acts = [sum(x[i + p] @ net.w[k][p] for p in range(k) if i + p < len(x)) for i in range(len(x))]
            h += list(np.maximum(np.max(acts, 0) + net.b[k], 0))
        s = [np.maximum(v @ net.v + net.c, 0) for v in x]
        for k in toxicity.WIDE:
            h += list(np.max([np.sum(s[i : i + k], 0) for i in range(len(s))], 0))
        z = float(np.dot(h, net.u) + net.u0)
        votes = net.langs[rows[:, 0]].astype(float).sum(0)
        lang = int(votes.argmax()) if votes.any() else len(votes)
    return 1 / (1 + np.exp(-((z - net.shift[lang]) / net.temp + np.log(least / (1 - least)))))


def test_toxicity_scores_are_the_plain_ones(net):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(n)) for n in (1, 2, 3, 17, 70, 400)]
    texts += [t + " You Villainous, scoundrel! villainy " + t for t in texts] + ["", "!! ...", "Ünïcode ß", None]
    ids, at = toxicity.tokens(pa.array(texts, pa.string()))
    got = net.score(ids, at, 0.3)
    assert np.allclose(got, [plain_score(net, t or "") for t in texts], atol=1e-4)
    assert (got[6:12] >= 0.3).all() and (got[[3, 4, 5]] < 0.3).all()
    # cutting long texts changes nothing
    whole = net.features(net.index[ids], at)
    for most in (64, 100, 333):
        part = net.features(net.index[ids], at, most)
        assert np.allclose(whole[0], part[0], atol=1e-4) and np.allclose(whole[1], part[1])


def test_gradients_are_those_of_the_loss(monkeypatch):
    """A step along each gradient lowers the loss as the finite difference says: training must end far below the start."""
    rng = np.random.default_rng(1)
    index = np.arange(40, dtype=np.int32)
    net = toxicity.Net(index, rng.normal(0, 0.3, (40, toxicity.DIMS)).astype(np.float32)).start()
    net.embed[0] = 0
    net.langs = np.zeros((40, 0), np.float32)
    texts = [np.stack([rng.integers(1, 40, 30)] + [np.zeros(30, int)] * 3, 1).astype(np.int32) for _ in range(60)]
    y = np.array([float((t[:, 0] == 5).any()) for t in texts], np.float32)

    def loss():
        z = np.array([net.logits(t, np.array([0, len(t)]))[0][0] for t in texts])
        return float(np.mean(np.logaddexp(0, z) - y * z))

    before = loss()
    toxicity.learn(net, texts, y, epochs=60)
    assert loss() < 0.3 * before


def test_toxicity_of_unseen_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.score_toxicity(docs, labels).where("held_out").join(labels.where("toxic IS NOT NULL"), "doc_id")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.85 * (n[1, 1] + n[1, 0]) and n[0, 1] <= 0.03 * (n[0, 0] + n[0, 1])


def test_toxicity_of_hard_rows(spark, hard, none):
    labels = spark.createDataFrame([(5, 1, 0, "x"), (9, None, 1, "y"), (1, 1, 1, "z"), (None, 1, 1, "n"), (5, 0, 1, "w")], "doc_id long, quality int, toxic int, text string")
    out = toxicity.score_toxicity(hard, labels).collect()
    assert len(out) == hard.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert toxicity.score_toxicity(hard, labels.where("false")).count() == hard.count()


def same_id(spark, n, text):
    return spark.createDataFrame([(None, text(i), "xx", "b") for i in range(n)] + [(i, words(12, i % 50), "en", "a") for i in range(n // 3)], "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("text", [lambda i: "zz yy " + words(8, i % 500), lambda i: words(10, 1)], ids=["texts differ", "equal rows"])
def test_ten_thousand_rows_of_one_id(spark, text):
    docs = same_id(spark, 9000, text)
    mix = mixing.pareto_mix(docs).groupBy("source", "target").agg(F.sum("taken").alias("taken"), F.max("copies").alias("most")).collect()
    for r in mix:
        assert abs(r["taken"] - r["target"]) <= 12 and r["most"] <= 2, r
    copies = mixing.take_copies(docs.withColumn("size", F.lit("s")))
    got = {r["source"]: r["n"] for r in copies.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    assert all(abs(got.get(r["source"], 0) - r["target"]) <= 12 for r in mix)
    model = langid.train(docs.select("doc_id", "text", "lang"), fit_rows=100)
    assert model.langs == ["en", "xx"]
    shards = sharding.interleave(docs, 24, per_bucket=256).groupBy("shard", "source").count().collect()
    assert len(shards) == 48 and max(r["count"] for r in shards if r["source"] == "b") - min(r["count"] for r in shards if r["source"] == "b") <= 2


def test_every_tree_draws_from_all_different_rows(spark):
    rows = [(None, 100, 500, 0, 0, 0)] * 6000 + [(i, 100 + i, 500 + i, i % 7, i % 3, 0) for i in range(600)]
    samples = rulestats.tree_samples(spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{s} long" for s in rulestats.STATS)))
    assert [len(x) for x in samples] == [rulestats.TREE_ROWS] * rulestats.TREES
    assert all((x[:, 0] == 100).sum() <= 2 for x in samples)


def test_a_language_fits_exactly_the_least_rows(spark):
    docs = spark.createDataFrame([(i // 3, f"text {i // 2} " + words(5, i), ("de", "en", None)[i % 3]) for i in range(600)], "doc_id long, text string, lang string")
    seen = {}
    fit = langid.fit
    try:
        langid.fit = lambda rows, df, n, **k: seen.setdefault("rows", rows) and fit(rows, df, n, **k)
        langid.train(docs, fit_rows=150)
        assert sorted(r[0] for r in seen.pop("rows")) == ["de"] * 150 + ["en"] * 150
        langid.train(docs, fit_rows=900)
        assert len(seen.pop("rows")) == 400
        langid.train(docs.withColumn("lang", F.concat(F.lit("l"), F.col("doc_id"))), fit_rows=3, most_langs=7)
        assert len({r[0] for r in seen.pop("rows")}) == 7
    finally:
        langid.fit = fit


def test_a_large_benchmark_is_joined(spark, hard):
    bench = spark.createDataFrame([("a", words(40, 1)), ("b", words(12, 1)), (None, "two words"), ("e", ""), ("n", None), *[(f"c{i}", words(10, 1)) for i in range(300)]], "item_id string, text string")
    key = lambda r: (str(r["doc_id"]), r["text"] or "", r["__n_words"], r["__n_hit"], r["__items"], [tuple(x) for x in r["__spans"]])
    small = sorted(map(key, contamination.find_contamination(hard, bench).collect()))
    large = sorted(map(key, contamination.find_contamination(hard, bench, block_words=3).collect()))
    assert small == large and len(small) == hard.count() and sum(r[3] > 0 for r in small) >= 6
    clash = hard.withColumn("__row", F.lit("r")).withColumn("at", F.lit("x")).withColumn("items", F.lit("y")).withColumn("__hit_row", F.lit("z"))
    out = contamination.find_contamination(clash.select(*[c for c in clash.columns if c not in ("at", "items", "__hit_row")]), bench, block_words=3)
    assert out.where("__row = 'r'").count() == hard.count()


@pytest.mark.parametrize("short", [2048, 0])
def test_near_takes_time_by_length(monkeypatch, short):
    import time

    monkeypatch.setattr(lines, "_SHORT", short)
    rng = random.Random(3)
    for _ in range(300):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(120)))
        b = list(a)
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = rng.choice(["", "a", "c"])
        b = "".join(b)
        for edits in (1, 2, 3):
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                row = _next_row(row, x, b, i)
            assert lines.near(a, b, edits) == (row[-1] <= edits)
    long = "".join(rng.choice("abcdefgh") for _ in range(1_000_000))
    began = time.time()
    assert lines.near("x" + long + "y", "y" + long + "z") and not lines.near("x" + long[:400_000] + "q" + long[400_001:] + "y", "y" + long + "zz")
    assert time.time() - began < 20


def _next_row(row, x, b, i):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out
