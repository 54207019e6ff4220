"""Columns that clash with the operators' own names come back by value; plain Python versions of ranked and scored results."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strataframe.llm import common, contamination, jaccard, langid, mixing, quality, rulestats, secrets, sharding

from .conftest import words
from .test_operators import rows

CLASHES = ["score", "lang_pred", "held_out", "__score", "__items", "__n_hit", "__spans", "___items", "__id", "__key", "__text_key", "__copies", "__nth", "__row", "__lang_pred", "copies", "size", "rank", "u"]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def clashing(spark):
    texts = ["Das ist ein Text " + words(30, 1), "This is a text " + words(30, 2), "This is a text " + words(30, 2), words(80, 5), words(80, 5) + " x", "²", "½ 12", None]
    docs = spark.createDataFrame([(i, t, ("de", "en")[i % 2], ("a", "b")[i % 2], i) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.concat(F.lit(f"{c} of "), F.col("doc_id")).alias(c) for c in CLASHES])


def test_every_stage_returns_clashing_columns_by_value(spark, clashing):
    columns = clashing.columns
    whole = {r["doc_id"]: tuple(r) for r in clashing.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, SF)
        assert out.columns == columns and out.schema == clashing.schema, name
        got = out.collect()
        assert got and all(tuple(r) == whole[r["doc_id"]] for r in got), name
    assert corpus_pipeline.STAGES[-1][1](spark, clashing, SF).count() == len(whole)


def test_other_entry_points_return_them_too(spark, clashing):
    bench = spark.createDataFrame([("q", words(12, 5))], "item_id string, text string")
    whole = {r["doc_id"]: r for r in clashing.collect()}
    cut = contamination.remove_spans(clashing, bench).collect()
    assert len(cut) == len(whole) and all(tuple(r)[2:] == tuple(whole[r["doc_id"]])[2:] for r in cut)
    assert {r["doc_id"] for r in cut if r["text"] != whole[r["doc_id"]]["text"]} == {3, 4}
    found, _ = secrets.scan_versions(clashing)
    assert all(r[c] == whole[r["doc_id"]][c] for r in found.collect() for c in CLASHES)


def test_number_signs_are_no_letters(spark):
    texts = ["²", "½ 12", "Ⅷ ①", "12 %", "", None, "ª", "5 é", "日本"]
    assert langid.has_letter(pa.array(texts)).tolist() == [any(map(str.isalpha, t or "")) for t in texts]
    train = [(100 + i, ("der die das und ist " if i % 2 else "the and of is to ") + words(5, i), ("de", "en")[i % 2 == 0]) for i in range(60)]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] + train, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs).where("doc_id < 100").collect()}
    assert [got[i][0] == "und" for i in range(len(texts))] == [True] * 6 + [False] * 3
    assert all(s == 0 for p, s in got.values() if p == "und")


def test_predictions_are_the_model_s_formula(spark, monkeypatch):
    """The plain version: mean weight over all 1- to 3-grams, softmax at the model's temperature, one text at a time."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs.select("doc_id", "text", "lang"), fit_rows=40)
    out = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    for r in docs.limit(40).collect():
        points = np.array([ord(c) + 32 if "A" <= c <= "Z" else ord(c) for c in r["text"]], np.uint32)
        bag = langid.bag(points)
        z = model.table[bag].astype(float).sum(0) * langid.SCALE / max(1, len(bag)) / model.temp
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        got = out[r["doc_id"]]
        assert got["lang_pred"] == model.langs[int(p.argmax())] and got["score"] == pytest.approx(p.max(), abs=1e-6)


def test_votes_are_the_nearest_by_cosine(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    space = quality.fit(docs, labels.where(langid.fold(F.col("doc_id"), 5) != 0), 60)
    out = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, labels, fit_rows=60).collect()}
    for r in docs.orderBy("doc_id").limit(60).collect():
        v = space.unit(space.weighted(quality.term_counts(pa.array([r["text"]]))) @ space.basis)[0]
        near = sorted(((float(v @ x), float(y), float(w)) for x, y, w in zip(space.vectors, space.labels, space.weight)), reverse=True)[: space.k]
        vote = [(quality.vote(max(c, 0.0)) * w, y) for c, y, w in near]
        total = sum(x for x, _ in vote)
        want = sum(x * y for x, y in vote) / total if total else space.prior
        assert out[r["doc_id"]] == pytest.approx(want, abs=2e-3)


def test_verdicts_are_paths_and_a_threshold(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = rulestats.quality_rules(docs, labels).collect()
    stats = {r["doc_id"]: [r[s] for s in rulestats.STATS] for r in got}
    failed = {d: s[0] < 10 or 100 * s[4] > 20 * s[0] for d, s in stats.items()}
    assert all(r["base_failed"] == failed[r["doc_id"]] for r in got)
    named = spark.createDataFrame([(d, *s) for d, s in stats.items() if not failed[d]], "doc_id long, " + ", ".join(f"{s} long" for s in rulestats.STATS))
    forest = rulestats.IsolationForest(np.zeros((0, 4)), samples=[rulestats.features(x) for x in rulestats.tree_samples(named) if len(x)])

    def path(tree, x):
        feature, cut, left, right = tree
        at = 0
        while feature[at] >= 0:
            at = left[at] if x[feature[at]] < cut[at] else right[at]
        return cut[at]

    norm = float(forest._rest(forest.rows))
    score = {d: 2 ** (-np.mean([path(t, rulestats.features(np.array([s]))[0]) for t in forest.trees]) / norm) for d, s in list(stats.items())[:60]}
    assert all(r["anomaly"] == pytest.approx(score[r["doc_id"]], abs=1e-9) for r in got if r["doc_id"] in score)
    known = {r[0]: r[1] for r in labels.where("quality IS NOT NULL").select("doc_id", "quality").collect()}
    good = sorted(int(r["anomaly"] * 2000) for r in got if known.get(r["doc_id"]) == 1 and not r["base_failed"])
    bad = [int(r["anomaly"] * 2000) for r in got if known.get(r["doc_id"]) == 0 and not r["base_failed"]]
    cut = next(c for c in range(2002) if sum(x >= c for x in good) <= 0.01 * len(good))
    if sum(x >= cut for x in bad) / max(1, len(bad)) <= sum(x >= cut for x in good) / len(good):
        cut = 10**6
    assert all(r["kept"] == (not r["base_failed"] and int(r["anomaly"] * 2000) < cut) for r in got)


def unit(seed, doc_id):
    return int(hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2.0**52


@pytest.mark.parametrize("per_bucket", [1, 7, 4096])
def test_shards_are_brute_force(spark, per_bucket):
    docs = [(i, None if i % 17 == 0 else words(i % 9, i), (None, "a", "b", "c")[(i * i) % 4]) for i in range(300)]
    by = {}
    for d, t, s in docs:
        by.setdefault(s, []).append((unit("shards", d), d))
    ranked = []
    for s, mine in by.items():
        for r, (_, d) in enumerate(sorted(mine)):
            ranked.append(((r + 0.5) / len(mine), s is None, s or "", r, d))
    ranked.sort()
    n, k = len(ranked), 24
    want = []
    for at, (*_, d) in enumerate(ranked):
        shard = at * k // n
        raw = (docs[d][1] or "").encode()
        want.append((d, len(raw) + 8, zlib.crc32(raw), shard, at - -(-shard * n // k)))
    got = rows(sharding.interleave(spark.createDataFrame(docs, "doc_id long, text string, source string"), k, per_bucket=per_bucket), "doc_id", "size", "text_crc32", "shard", "slot")
    assert got == sorted(want)


def test_a_ledger_is_kept_between_scans(spark, tmp_path):
    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    one = spark.createDataFrame([("a", 1, "token=abcdefgh"), ("b", 1, "clean"), ("e", 1, None)], "path string, version int, text string")
    two = spark.createDataFrame([("a", 1, "token=abcdefgh"), ("a", 2, "clean"), ("c", 1, "secret=12345678")], "path string, version int, text string")
    assert {r["path"]: len(r["spans"]) for r in ledger.scan(one).collect()} == {"a": 1, "b": 0, "e": 0}
    assert ledger.read().count() == 3
    got = secrets.Ledger(spark, ledger.path).scan(two)
    assert {(r["path"], r["version"]): len(r["spans"]) for r in got.collect()} == {("a", 1): 1, ("a", 2): 0, ("c", 1): 1}
    assert ledger.read().count() == 4
    ledger.scan(two)
    assert ledger.read().count() == 4
    ledger.scan(two, rule_version="next")
    assert ledger.read().count() == 7


def test_a_text_of_very_many_secrets(spark):
    n = 3000
    text = " ".join(f"token=abcdefgh{i}" for i in range(n))
    got = secrets.digest(secrets.scan_versions(spark.createDataFrame([(1, text)], "doc_id long, text string"))[0]).first()
    assert got["n_assign"] == n and got["spans"].startswith("assign:0:15,assign:16:31")


def test_native_plans_hold_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (mixing.pareto_mix(docs), mixing.take_copies(docs), secrets.scan_versions(docs)[0]):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "InArrow", "InPandas", "Scan ExistingRDD")), plan


def test_the_shared_folder_must_be_named_on_a_cluster(spark):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(400)]
    got = common.components(spark.createDataFrame(edges, "u long, v long"))
    assert rows(got.select("comp").distinct()) == [(0,)] and got.count() == 401


def test_only_one_of_each_near_copy_is_left(clashing):
    assert [r[0] for r in rows(jaccard.keep_first(clashing).select("doc_id"))] == [0, 1, 3, 5, 6, 7]
