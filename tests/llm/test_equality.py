"""What equals what is decided by names that no arrangement of bytes or words cancels out."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataframe.llm import jaccard, lines, rulestats, substrings, tokens

from . import brute
from .conftest import words
from .test_operators import rows


def thue_morse(n, a, b):
    """The first n places of the Thue-Morse sequence over a and b, and of its complement."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return [(a, b)[x] for x in bits], [(b, a)[x] for x in bits]


TEXTS = ["".join(x) for x in thue_morse(2048, "a", "b")]
PASSAGES = [" ".join(x) for x in thue_morse(2048, "red", "blue")]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_hashes_of_thue_morse_texts_differ():
    w = tokens.words(pa.array([*TEXTS, *PASSAGES]))
    assert len(set(w.hash[:2].tolist())) == 2
    a, b = (w.hash[w.at[i] : w.at[i + 1]] for i in (2, 3))
    for k in (5, 50, 2048):
        assert tokens.windows(a, k)[0] != tokens.windows(b, k)[0]
    assert len(set(jaccard.node_of(tokens.shingle_set(h, 2048)) for h in (a, b))) == 2


@pytest.mark.parametrize("k", [1, 2, 3, 5, 7, 8, 50])
def test_windows_are_equal_where_words_are(k):
    rng = np.random.default_rng(k)
    seq = rng.integers(0, 3, 400).tolist()
    h = np.array([11, 22, 33], np.uint64)[seq]
    got = tokens.windows(h, k)
    assert len(got) == len(seq) - k + 1
    names = {}
    for i, x in enumerate(got.tolist()):
        assert names.setdefault(tuple(seq[i : i + k]), x) == x
    assert len(set(names.values())) == len(names)


def test_long_stretches_and_seeds():
    data = np.frombuffer(("x" * 300 + "y" + "x" * 300).encode(), np.uint8)
    at = np.array([0, 1, 301, 0, 0])
    end = np.array([300, 301, 601, 128, 129])
    h = tokens._hash(data, at, end)
    assert h[0] == h[2] and len(set(h.tolist())) == 4
    assert not (h == tokens._hash(data, at, end, seed=1)).any()


def test_lines(spark):
    got = rows(lines.line_dedup(table(spark, TEXTS)), "doc_id", "n_removed")
    assert got == [(0, 0), (1, 0)]


def test_documents(spark):
    got = rows(jaccard.jaccard_classes(table(spark, [*TEXTS, *PASSAGES])), "doc_id", "component_id")
    assert got == [(d, c) for d, _, c in brute.jaccard_components(list(enumerate([*TEXTS, *PASSAGES])))]
    assert got[1] == (1, 1)


def test_windows_of_documents(spark):
    one = words(60, 3).split()
    two = one[:31] + ["other"] + one[32:]
    texts = [" ".join(one), " ".join(two), *PASSAGES]
    assert rows(substrings.substring_dedup(table(spark, texts))) == brute.window_dedup(list(enumerate(texts)))


def test_repeated_windows_within_a_text(spark):
    text = " ".join(PASSAGES)
    w = text.split()
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    want = len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)})
    assert rulestats.rule_statistics(table(spark, [text])).first()["n_repeat_words"] == want


# groups that would be quadratic


def group(n, seed, base=45, places=9, edits=2):
    """n near copies of a text, each with up to `edits` words changed at one of a few places, so that many share a change."""
    rng = np.random.default_rng(seed)
    w = words(base, seed).split()
    out = []
    for _ in range(n):
        mine = list(w)
        for p in rng.choice(places, int(rng.integers(0, edits + 1)), replace=False):
            mine[int(p) * 5] = f"v{rng.integers(0, 4)}"
        out.append(" ".join(mine))
    return out


def test_a_group_of_two_thousand_near_copies(spark):
    docs = list(enumerate(group(2000, 8, places=40 // 5)))
    got = rows(jaccard.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)))
    assert got == brute.jaccard_components(docs)


@pytest.mark.parametrize(("stars", "short", "block"), [(0, 1, 5), (1, 2, 7), (2, 4, 256), (0, 10_000, 3)])
def test_every_way_to_search_a_list(spark, stars, short, block):
    docs = list(enumerate(group(90, 1) + group(70, 2, edits=3) + group(30, 3, base=4, places=1, edits=1)))
    got = rows(jaccard.jaccard_classes(table(spark, [t for _, t in docs]), star_rounds=stars, short=short, block=block))
    assert got == brute.jaccard_components(docs)


def test_crowded_blocks_are_searched_whole(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_PER_NODE", 0)
    docs = list(enumerate(group(60, 4, edits=3) + group(40, 5)))
    got = rows(jaccard.jaccard_classes(table(spark, [t for _, t in docs]), star_rounds=0, short=1, block=8))
    assert got == brute.jaccard_components(docs)


def template_lines(n, seed):
    rng = np.random.default_rng(seed)
    return [f"Page {i} of the register of deeds, folio {rng.integers(0, 10**5)}" for i in range(n)] + [f"Order no. {i} has been confirmed and sent" for i in range(n)]


@pytest.mark.parametrize(("short", "block"), [(32, 512), (2, 7), (10_000, 512)])
def test_template_lines_are_brute_force(spark, short, block):
    all_lines = template_lines(150, 2)
    docs = [(i, "\n".join(all_lines[i::25])) for i in range(25)]
    got = rows(lines.line_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), short=short, block=block))
    assert got == brute.line_dedup(docs, near=lines.near)
    assert sum(r[3] for r in got) > 100


def test_template_lines_make_no_pairs(spark):
    docs = spark.createDataFrame([(i, f"Order no. {i:06d} has been confirmed and sent") for i in range(3000)], "doc_id long, text string")
    got = lines.line_dedup(docs)
    assert got.agg(F.sum("n_near")).first()[0] == 2999
