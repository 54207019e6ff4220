"""Quality rules: statistics of whole texts, fixed rules, and an isolation forest over the statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mix64, small_batches, staged, with_fields
from .tokens import windows, words

SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rows of each tree, and trees: bounds whatever the corpus holds.
TREE_ROWS, TREES = 256, 100


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the STATS of each row; null is as empty (all 0).

    word_chars: code points in words; n_symbols: characters of SYMBOLS; n_dup_lines: lines (split at \\n)
    with a word, equal to an earlier line; n_repeat_words: words in 5-word windows that the text has twice
    or more, the first included.
    """
    small_batches(docs.sparkSession)
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            w = words(b.column(1))
            n = b.num_rows
            heads = np.r_[0, np.cumsum((w.data & 0xC0) != 0x80)]
            per_word = heads[w.end] - heads[w.start]
            chars = np.r_[0, np.cumsum(per_word)]
            symbols = np.r_[0, np.cumsum(is_symbol[w.data])]
            dup, rep = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i in range(n):
                lines = w.text_bytes(i).split(b"\n")
                if len(lines) > 1:
                    # a line is with a word if it has more than separators; equal lines agree on that
                    distinct = set(lines)
                    if len(distinct) < len(lines):
                        dup[i] = sum(1 for x in lines if x.split()) - sum(1 for x in distinct if x.split())
                h = windows(w.hash[w.at[i] : w.at[i + 1]], 5)
                if len(h) > 1:
                    _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
                    again = np.flatnonzero(count[inverse] > 1)
                    if len(again):
                        steps = np.zeros(len(h) + 6, np.int32)
                        np.add.at(steps, again, 1)
                        np.add.at(steps, again + 5, -1)
                        rep[i] = int((np.cumsum(steps) > 0).sum())
            columns = [np.diff(w.at), chars[w.at[1:]] - chars[w.at[:-1]], symbols[w.texts[1:]] - symbols[w.texts[:-1]], dup, rep]
            yield pa.record_batch([b.column(0), *[pa.array(np.asarray(x, np.int64)) for x in columns]], ["doc_id", *STATS])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"{s} long" for s in STATS))


#: A text's mean word length is shrunk to PRIOR_LENGTH as by so many words; repeats up to these shares are normal.
PRIOR_WORDS, PRIOR_LENGTH = 50, 5.0
NORMAL_DUP, NORMAL_REPEAT = 0.02, 0.10


def features(stats: np.ndarray) -> np.ndarray:
    """Features that don't depend on length: word length, symbols per word, repeats beyond what is normal."""
    s = stats.astype(np.float64)
    n = np.maximum(s[:, 0], 1)
    length = (s[:, 1] + PRIOR_WORDS * PRIOR_LENGTH) / (s[:, 0] + PRIOR_WORDS)
    return np.stack([length, np.log1p(s[:, 2] / n * 100), np.maximum(0, s[:, 3] / n - NORMAL_DUP), np.maximum(0, s[:, 4] / n - NORMAL_REPEAT)], 1)


class IsolationForest:
    """Random axis-parallel splits until rows stand alone; rows that are split off early are anomalies."""

    def __init__(self, x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 7, samples: list[np.ndarray] | None = None):
        """Each tree draws its rows from x, or takes those of its entry in samples."""
        rng = np.random.default_rng(seed)
        self.rows = min(rows, len(x)) if samples is None else max(map(len, samples), default=0)
        self.depth = max(1, int(np.ceil(np.log2(max(2, self.rows)))))
        drawn = samples if samples is not None else (x[rng.choice(len(x), self.rows, replace=False)] for _ in range(trees if len(x) else 0))
        self.trees = [self._grow(mine, rng) for mine in drawn]

    @staticmethod
    def _rest(n):
        """Mean path length of an unsuccessful search among n rows."""
        n = np.asarray(n, float)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    def _grow(self, x, rng):
        nodes: list[list] = []  # feature or -1, cut or path length, left, right

        def node(rows, depth):
            k = len(nodes)
            nodes.append([-1, depth + float(self._rest(len(rows))), 0, 0])
            lo, hi = rows.min(0), rows.max(0)
            free = np.flatnonzero(hi > lo)
            if depth < self.depth and len(rows) > 1 and len(free):
                f = int(rng.choice(free))
                cut = float(rng.uniform(lo[f], hi[f]))
                left = rows[:, f] < cut
                if left.any() and not left.all():
                    nodes[k][:2] = [f, cut]
                    nodes[k][2] = node(rows[left], depth + 1)
                    nodes[k][3] = node(rows[~left], depth + 1)
            return k

        node(x, 0)
        a = np.array(nodes, float)
        return a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; higher is easier to isolate."""
        total = np.zeros(len(x))
        each = np.arange(len(x))
        for feature, cut, left, right in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                goes_left = x[each, np.maximum(f, 0)] < cut[at]
                at = np.where(f < 0, at, np.where(goes_left, left[at], right[at]))
            total += cut[at]
        norm = float(self._rest(self.rows)) or 1.0
        return 2.0 ** (-total / max(1, len(self.trees)) / norm)


def base_failed():
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def threshold(counts: list[tuple[int, int, int]], bins: int, lose: float) -> float:
    """The least score that loses at most `lose` of the good rows, if bad rows are above it more often than good ones.

    counts: (bin of the score, label, rows). Without good labels nothing is lost (above 1).
    """
    good, bad = np.zeros(bins + 1), np.zeros(bins + 1)
    for b, label, n in counts:
        (good if label else bad)[b] += n
    if not good.sum():
        return 2.0
    above = np.cumsum(good[::-1])[::-1] / good.sum()
    cut = int(np.argmax(np.r_[above, 0.0] <= lose))
    bad_above = bad[cut:].sum() / max(1.0, bad.sum())
    return cut / bins if bad_above > above[min(cut, bins)] else 2.0


def tree_samples(passed: DataFrame, trees: int = TREES, rows: int = TREE_ROWS) -> list[np.ndarray]:
    """For each tree, the STATS of the `rows` rows of passed(doc_id, STATS) with the least hash of tree, doc_id and STATS.

    Rows that are equal in all of these count once, so that no number of copies of one row takes a tree's place.
    A first pass lets through what is below a bound that some more different rows than needed fall under, 6 standard
    deviations and the estimate's error more, so that the driver gets a few hundred rows a tree.
    """
    hashed = passed.select(F.xxhash64("doc_id", *STATS).alias("h"), *STATS)
    n = hashed.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    if not n:
        return []
    bound = min(1.0, (rows + 6 * rows**0.5) / (0.9 * n))
    salts = mix64(np.arange(1, trees + 1, dtype=np.uint64))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            u = [mix64(h ^ s) for s in salts]
            hit = [np.flatnonzero((x >> np.uint64(11)).astype(float) / 2.0**53 < bound) for x in u]
            at = np.concatenate(hit)
            tree = np.repeat(np.arange(trees), [len(x) for x in hit])
            key = np.concatenate([x[k] for x, k in zip(u, hit)]) >> np.uint64(1)
            yield pa.record_batch([pa.array(tree), pa.array(key.astype(np.int64)), *[c.take(pa.array(at)) for c in b.columns[1:]]], ["tree", "u", *STATS])

    found = hashed.mapInArrow(run, "tree long, u long, " + ", ".join(f"{s} long" for s in STATS))
    found = found.groupBy("tree", "u", *STATS).agg(F.lit(1).alias("one"))
    nth = F.row_number().over(Window.partitionBy("tree").orderBy("u", *STATS))
    drawn = np.array(found.withColumn("nth", nth).where(F.col("nth") <= rows).select("tree", "nth", *STATS).collect(), float).reshape(-1, 2 + len(STATS))
    drawn = drawn[np.lexsort((drawn[:, 1], drawn[:, 0]))]
    return [drawn[drawn[:, 0] == t, 2:] for t in range(trees)]


def quality_rules(docs: DataFrame, labels: DataFrame, lose: float = 0.01) -> DataFrame:
    """The statistics of every document, the fixed rules' verdict, and the forest's on the rest.

    docs needs doc_id and text, labels doc_id and quality (1 good, 0 bad; null is no label); other columns
    are ignored. Returns one row per input row: doc_id, the STATS, base_failed (fewer than 10 words, or over
    20 % of words in repeated windows), anomaly (0 to 1), kept.

    Each tree of the forest is grown on TREE_ROWS rows drawn by hash from all that pass the fixed rules. Its threshold is set from all labelled rows: the least that rejects at most `lose` of
    the good ones. Without labels, or where bad rows are no more anomalous than good ones, it rejects
    nothing. Null and empty texts fail the fixed rules; repeated rows fare alike; an empty table gives none.
    """
    bins = 2000
    stats = staged(rule_statistics(docs).withColumn("base_failed", base_failed()), "rule-stats")
    spark = docs.sparkSession
    passed = stats.where("NOT base_failed")
    samples = [features(x) for x in tree_samples(passed) if len(x)]
    forest = spark.sparkContext.broadcast(IsolationForest(np.zeros((0, 4)), samples=samples))
    schema = with_fields(stats.schema, "anomaly double")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = np.stack([b.column(s).to_numpy(zero_copy_only=False) for s in STATS], 1) if b.num_rows else np.zeros((0, len(STATS)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forest.value.score(features(x)))], [*b.schema.names, "anomaly"])

    scored = stats.mapInArrow(run, schema)
    scored = staged(scored, "rule-scores")
    known = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("q")).where("q != 0.5")
    counts = scored.where("NOT base_failed").join(known, "doc_id").groupBy(F.floor(F.col("anomaly") * bins).cast("int").alias("bin"), (F.col("q") > 0.5).cast("int").alias("label")).count().collect()
    at = threshold([tuple(r) for r in counts], bins, lose)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.floor(F.col("anomaly") * bins) < F.lit(at * bins)))
