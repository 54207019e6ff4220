"""Quality classification by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged, unit_hash
from .langid import fold
from .tokens import LOWER, words

#: Term spaces: trigrams of 16 byte classes, and hashed lower-cased words.
SHAPES, WORDS = 16**3, 1 << 12
TERMS = SHAPES + WORDS
#: Labelled rows for each label, latent dimensions, neighbours that vote.
FIT_ROWS, DIMS, NEIGHBOURS = 800, 48, 15
#: Documents whose cosines are computed together.
BLOCK = 256

#: Byte classes in order: other ASCII, space, newline, lower, upper, digit, non-ASCII, then these groups of characters.
_GROUPS = (".", ",;:", "!?", "|", "#*$%&", "<>", "()[]{}", "\"'`", "-_/\\")
CLASSES = np.zeros(256, np.uint8)
CLASSES[[0x20, 0x09]] = 1
CLASSES[[0x0A, 0x0D]] = 2
CLASSES[97:123] = 3
CLASSES[65:91] = 4
CLASSES[48:58] = 5
CLASSES[128:] = 6
for _i, _g in enumerate(_GROUPS):
    CLASSES[[ord(c) for c in _g]] = 7 + _i


def term_counts(column) -> np.ndarray:
    """Counts of TERMS in each whole text, one row a text."""
    w = words(column, lower=False)
    n = len(w.at) - 1
    out = np.zeros((n, TERMS), np.float32)
    if len(w.data) > 2:
        c = CLASSES[w.data].astype(np.int32)
        tri = c[:-2] * 256 + c[1:-1] * 16 + c[2:]
        for i in range(n):
            a, b = w.texts[i], w.texts[i + 1] - 2
            if b > a:
                out[i, :SHAPES] = np.bincount(tri[a:b], minlength=SHAPES)
    low = words(column, lower=True).hash if (LOWER[w.data] != w.data).any() else w.hash
    at = (low >> np.uint64(52)).astype(np.int64)
    for i in range(n):
        if w.at[i + 1] > w.at[i]:
            out[i, SHAPES:] = np.bincount(at[w.at[i] : w.at[i + 1]], minlength=WORDS)
    return out


class Space:
    """TF-IDF weights and a truncated singular basis, fitted on counts of labelled rows; their vectors and votes."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, weight: np.ndarray, idf: np.ndarray, dims: int = DIMS, neighbours: int = NEIGHBOURS):
        self.idf, self.k = idf.astype(np.float32), neighbours
        x = self.weighted(counts)
        self.basis = np.zeros((TERMS, 1), np.float32)
        if len(x):
            # randomised range finder with two power steps, then the small exact SVD
            rng = np.random.default_rng(5)
            q = np.linalg.qr(x @ rng.standard_normal((TERMS, min(dims + 16, len(x))), np.float32))[0]
            for _ in range(2):
                q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
            self.basis = np.linalg.svd(q.T @ x, full_matrices=False)[2][:dims].T.astype(np.float32).copy()
        self.vectors = self.unit(x @ self.basis)
        self.labels, self.weight = labels.astype(np.float64), weight.astype(np.float64)
        total = self.weight.sum()
        self.prior = float((self.weight * self.labels).sum() / total) if total else 0.5

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        return self.unit(np.log1p(counts) * self.idf)

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """The similarity-weighted share of label 1 among the nearest labelled vectors, by exact cosines."""
        v = self.unit(self.weighted(counts) @ self.basis)
        out = np.full(len(v), self.prior)
        if not len(self.vectors):
            return out
        cos = v @ self.vectors.T
        k = min(self.k, cos.shape[1])
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        sim = np.maximum(np.take_along_axis(cos, near, 1), 0.0).astype(np.float64)
        votes = vote(sim) * self.weight[near]
        total = votes.sum(1)
        some = total > 0
        out[some] = (votes * self.labels[near]).sum(1)[some] / total[some]
        return np.clip(out, 0.0, 1.0)


def vote(similarity):
    """A neighbour's weight: the fourth power of its cosine, so that among near-equal cosines the nearer ones tell."""
    return similarity**4


def _sample(labels: DataFrame, fit_rows: int) -> DataFrame:
    """(doc_id, y, __w): at most fit_rows rows of each label, by least hash, with the rows each stands for."""
    known = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    known = known.withColumn("u", unit_hash("quality", F.col("doc_id")))
    parts = []
    for good in (F.col("y") >= 0.5, F.col("y") < 0.5):
        mine = known.where(good)
        n = mine.count()
        parts.append(mine.orderBy("u", "doc_id").limit(fit_rows).withColumn("__w", F.lit(max(1.0, n / fit_rows))))
    return parts[0].unionByName(parts[1]).drop("u")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Space:
    """Document frequencies over all docs; the space and the votes from at most 2 * fit_rows labelled rows."""
    sample = staged(_sample(labels, fit_rows).withColumnRenamed("doc_id", "__id"), "quality-sample")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(sample), F.col("doc_id") == F.col("__id"), "left").select("text", "__id", "y", "__w")

    def run(batches):
        import pyarrow as pa

        names = ["y", "w", "u", "term", "n"]
        df, total = np.zeros(TERMS, np.int64), 0
        for b in batches:
            chosen = b.column(1).is_valid().to_numpy(zero_copy_only=False)
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                counts = term_counts(part.column(0))
                df += (counts > 0).sum(0)
                some = np.flatnonzero(chosen[i : i + BLOCK])
                if len(some):
                    terms = [np.flatnonzero(counts[j]).astype(np.int32) for j in some]
                    take = pa.array(some)
                    yield pa.record_batch([part.column(2).take(take), part.column(3).take(take), part.column(1).take(take).cast(pa.string()), pa.array(terms, pa.list_(pa.int32())), pa.array([counts[j][t].astype(np.int32) for j, t in zip(some, terms, strict=True)], pa.list_(pa.int32()))], names)
            total += b.num_rows
        if total:
            at = np.flatnonzero(df).astype(np.int32)
            yield pa.record_batch([pa.array([None], pa.float64()), pa.array([float(total)]), pa.array([None], pa.string()), pa.array([at], pa.list_(pa.int32())), pa.array([df[at].astype(np.int32)], pa.list_(pa.int32()))], names)

    facts = staged(rows.mapInArrow(run, "y double, w double, u string, term array<int>, n array<int>"), "quality-facts")
    df = np.zeros(TERMS)
    parts = facts.where("y IS NULL")
    for r in parts.select(F.explode(F.arrays_zip("term", "n")).alias("x")).groupBy("x.term").agg(F.sum("x.n").alias("n")).collect():
        df[r[0]] = r[1]
    n_docs = parts.agg(F.sum("w")).first()[0] or 0.0
    # one row of each labelled id (repeated documents vote once), in a fixed order
    mine = facts.where("y IS NOT NULL").groupBy("u").agg(F.min(F.struct("term", "n", "y", "w")).alias("r")).orderBy(F.md5("u"), "u").select("r.*").collect()
    counts = np.zeros((len(mine), TERMS), np.float32)
    for i, r in enumerate(mine):
        counts[i, r["term"]] = r["n"]
    idf = np.log((1.0 + n_docs) / (1.0 + df))
    return Space(counts, np.array([r["y"] for r in mine]), np.array([r["w"] for r in mine]), idf)


def score_quality(docs: DataFrame, labels: DataFrame, held_out: int = 0, parts: int = 5, least: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Score every whole text for quality, learning from the labels outside one fold.

    docs needs doc_id and text, labels doc_id and quality (1 or 0; null is none; rows that disagree are
    averaged); other columns are ignored. Returns one row per input row: doc_id, held_out, score (0 to 1,
    higher: label 1 likelier), predicted (1 if score >= least). Scores take the text alone.

    Texts are counts of byte-class trigrams and of hashed words, weighted by log TF and IDF over the whole
    corpus, in the latent space of a truncated SVD. The labelled vectors are broadcast (2 * fit_rows rows at
    most), and every document's exact cosines with all of them are computed in blocks; the nearest vote by the
    fourth power of similarity (see vote), each for the labelled rows that it stands for. A text without terms
    or without a similar neighbour gets the share of label 1; without labels, 0.5. An empty table gives none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    space = spark.sparkContext.broadcast(fit(docs, labels.where(fold(F.col("doc_id"), parts) != held_out), fit_rows))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            scores = [space.value.score(term_counts(b.column(1).slice(i, BLOCK))) for i in range(0, b.num_rows, BLOCK)]
            yield pa.record_batch([b.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["doc_id", "score"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, score double")
    return rows.select("doc_id", (fold(F.col("doc_id"), parts) == held_out).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
