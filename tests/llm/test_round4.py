"""What the reviewer's third round found in the text operators."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataframe.llm import jaccard, lines, toxicity

from . import brute
from .conftest import words


def test_toxicity_thresholds_come_from_all_labelled_rows(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["bad", "worse"] if k % 5 == 0 else ["fine", "good"], 1)) + " " + " ".join(rng.choice(["a", "b", "c", "bad"], 12)) for k in range(300)]
    ids = [toxicity.tokens(pa.array([t])) for t in texts]
    net = toxicity.fit([(i[0], int(k % 5 == 0), 1.0, None) for k, i in enumerate(ids[:60])])
    rows = [(t, int(k % 5 == 0), float(k)) for k, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[70], ("", 1, 900.0), (" ?", 0, 901.0)], "text string, y int, u double").repartition(3)
    assert toxicity.calibrate_on_all(net, df, [float(k) for k in range(45)], {0: 240, 1: 60}, 0.3) == 255
    z = np.array([net.logits(net.index[i], at)[0][0] for i, at in ids[45:]])
    y, z = np.array([r[1] for r in rows[45:]], float), (np.floor(z * 256) + 0.5) / 256
    want = toxicity.threshold(z, y, np.where(y > 0, 60 / y.sum(), 240 / (1 - y).sum()))
    assert np.allclose(net.shift, want)


def test_labelled_texts_meet_their_labels_as_numbers(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["bad", "worse"] if k % 4 == 0 else ["fine", "good"], 1)) + " " + " ".join(rng.choice(["a", "b", "c", "bad"], 9)) for k in range(240)]
    fits = [toxicity.tokens(pa.array([t]))[0] for t in texts[:40]]
    nets = [toxicity.fit([(i, int(k % 4 == 0), 1.0, None) for k, i in enumerate(fits)]) for _ in range(2)]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, "bad"), (238, None)], "doc_id long, text string").repartition(3)
    known = spark.createDataFrame([(k, int(k % 4 == 0), float(k)) for k in range(0, 240, 2)] + [(999, 1, 999.0)], "__id long, y int, u double")
    joined = docs.join(known, docs["doc_id"] == known["__id"]).where("text IS NOT NULL").select("text", "y", "u")
    sizes, fitted = {0: 60, 1: 60}, [float(k) for k in range(0, 30, 2)]
    assert toxicity.calibrate_on_all(nets[0], joined, fitted, sizes, 0.3) == toxicity.calibrate_on_all(nets[1], docs, fitted, sizes, 0.3, known) == 105
    assert np.array_equal(nets[0].shift, nets[1].shift) and nets[0].temp == nets[1].temp
    scored = toxicity.labelled_logits(nets[0], docs, known, 121)
    assert sorted(scored.columns) == ["h", "lang", "u", "y", "z"]
    plan = scored._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    assert "text" not in plan.children().head().output().mkString(" ")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def edited(n, seed, most, base=150):
    """n copies of a text, not itself among them, each with 1 to `most` words changed at places of its own."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        w = words(base, seed).split()
        for p in rng.choice(base, int(rng.integers(1, most + 1)), replace=False):
            w[int(p)] = f"e{k}p{p}"
        out.append(" ".join(w))
    return out


def dealt_rows(monkeypatch):
    counts, was = [], jaccard._dealt

    def dealt(lists, block):
        out = was(lists, block)
        counts.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "_dealt", dealt)
    return counts


def test_only_what_may_still_link_is_dealt_to_blocks(spark, monkeypatch):
    counts = dealt_rows(monkeypatch)
    docs = list(enumerate(edited(300, 6, 5) + [words(40, 7)]))
    got = jaccard.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), block=16)
    assert rows(got) == brute.jaccard_components(docs)
    assert sum(counts) <= 12 * len(docs)


@pytest.mark.parametrize(("stars", "short", "block"), [(0, 1, 5), (1, 2, 7), (2, 4, 8), (1, 10_000, 3)])
def test_sizes_that_differ_are_searched_in_every_way(spark, stars, short, block):
    base = words(120, 9).split()
    docs = list(enumerate([" ".join(t.split()[: 100 + 5 * (k % 11)]) for k, t in enumerate(edited(70, 8, 3))] + [" ".join(base[k : k + 60 + k]) for k in range(25)]))
    got = rows(jaccard.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), star_rounds=stars, short=short, block=block))
    assert got == brute.jaccard_components(docs)


def test_lines_with_a_word_are_found_without_sums_over_bytes(spark, monkeypatch):
    texts = ["", "\n\n", " \t\n\x0b\x0c\r\n", "a", "a\n", "\n\na\n \n\nb", None, "\u00a0\n\x1c\n\x85", "", "\u00fcn\n\n \u65e5\n ", "  x  "]
    want = [(i, n) for i, t in enumerate(texts) for n, x in enumerate((t or "").encode().split(b"\n")) if x.split()]
    sums = []
    monkeypatch.setattr(lines.np, "cumsum", lambda x, *a, was=np.cumsum, **k: sums.append(len(x)) or was(x, *a, **k))
    some = lines.Lines(pa.array(texts * 5))
    assert list(zip(some.text.tolist(), some.number.tolist(), strict=True)) == [(i + len(texts) * k, n) for k in range(5) for i, n in want]
    assert max(sums) <= len(some.per_text)
    monkeypatch.undo()
    got = rows(lines.line_dedup(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")))
    assert got == brute.line_dedup([*enumerate(texts)], near=lines.near)


@pytest.mark.parametrize(("stars", "short", "block"), [(0, 10_000, 8), (0, 1, 8)])
def test_a_query_of_many_partners_is_searched_in_parts(spark, monkeypatch, stars, short, block):
    together, was = [], jaccard._verify

    def verify(pairs, sets, percent):
        groups = pairs.groupBy("a", "parts", F.pmod(F.xxhash64("b"), F.col("parts"))).count()
        together.append(groups.agg(F.max("count")).first()[0] or 0)
        return was(pairs, sets, percent)

    monkeypatch.setattr(jaccard, "_verify", verify)
    monkeypatch.setattr(jaccard, "_PER_NODE", 10_000)
    docs = list(enumerate(edited(90, 11, 3)))
    got = jaccard.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), star_rounds=stars, short=short, block=block)
    assert rows(got) == brute.jaccard_components(docs)
    assert together and 1 < max(together) <= 3 * block


def test_shingles_are_made_of_slices_of_a_batch(monkeypatch):
    sizes, was = [], jaccard.words

    def counted(column, **how):
        sizes.append(sum(len(x.as_py() or "") for x in column))
        return was(column, **how)

    monkeypatch.setattr(jaccard, "words", counted)
    texts = [words(40_000, k) for k in range(12)] + [None, "", "one two"]
    got = list(jaccard._fresh(pa.array(texts), 5, set()))
    assert max(sizes) <= 1 << 21 < sum(sizes)
    whole, at, names = jaccard._sets(pa.array(texts), 5)
    want = [whole[a:b] for a, b, n in zip(at[:-1], at[1:], names, strict=True) if n is not None]
    assert len(got) == len(want) and all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
