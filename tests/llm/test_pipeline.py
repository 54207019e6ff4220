"""The pipeline's stages, each on what its predecessor kept."""

import corpus_pipeline
from strataframe.llm import contamination, jaccard, langid, rulestats

from . import brute
from .conftest import hard_rows, words

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == columns, name
        counts.append(docs.count())
        if name.startswith("n-gram"):
            classes = jaccard.jaccard_classes(docs)
            assert classes.select("component_id").distinct().count() == counts[-1] == classes.count()
        if name.startswith("benchmark"):
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert contamination.find_contamination(docs, bench).where("__n_hit > 0").count() == 0
    assert counts[0] <= n and counts[1] < counts[0] and counts[2] <= counts[1]
    shards = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert shards.count() == counts[-1]


def test_stages_of_hard_rows_and_of_none(spark, hard, none):
    for docs in (hard, none):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= 2 * len(hard_rows())


def test_the_result_is_brute_force(spark):
    """Languages as the fitted model gives them (its scoring has a plain version of its own); all else in plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r["doc_id"] for r in langid.identify(docs).where("lang_pred != 'und' AND score >= 0.5").select("doc_id").collect()}
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect() if r["doc_id"] in known]
    first = {d for d, _, c in brute.jaccard_components([(d, t) for d, t, _ in rows]) if d == c}
    rows = [r for r in rows if r[0] in first]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r in rows if not brute.contaminated(r[1], items)]
    rows = [r for r, n in zip(rows, brute.mix(rows)) for _ in range(n if brute.WORD.search(r[1] or "") else 1)]
    want = brute.interleave(rows, 24)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "size", "shard", "slot").collect())
    # the copies of one document stand next to each other, so which of them is first doesn't matter
    assert len(got) == len(want) and got == want


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and "shard" in out.columns


def test_a_text_stays_if_only_another_one_of_its_id_is_a_copy(spark, hard):
    kept = jaccard.keep_first(hard)
    assert [r["text"] for r in kept.where("doc_id = 6").collect()] == ["another text under an id that is taken"]
    base, other = words(90, 1), words(90, 2)
    rows = [(1, base), (2, base), (2, other), (2, other), (3, other), (4, words(90, 3)), (4, words(90, 4))]
    kept = jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in kept.collect()) == sorted([(1, base), (2, other), (4, words(90, 3)), (4, words(90, 4))])


def test_trees_draw_from_all_rows(spark):
    passed = spark.range(20_000).selectExpr("id AS doc_id", *[f"id * {i + 1} AS {c}" for i, c in enumerate(rulestats.STATS)])
    samples = rulestats.tree_samples(passed)
    assert [len(x) for x in samples] == [256] * 100
    seen = {int(r[0]) for x in samples for r in x}
    assert len(seen) > 8192 and max(seen) > 19_900  # one pool of 8,192 rows can't hold so many
    few = rulestats.tree_samples(passed.limit(9))
    assert [len(x) for x in few] == [9] * 100 and rulestats.tree_samples(passed.limit(0)) == []
