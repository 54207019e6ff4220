"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, staged, unit_hash, unused, with_fields
from .tokens import slices, text_buffer

#: n-grams of 1 to ORDERS code points are hashed to FEATURES buckets each way.
ORDERS, FEATURES = 3, 1 << 15
#: Labelled rows that the classifier is fitted on for each language, and of those, one in so many for calibration.
FIT_ROWS, CALIBRATE = 800, 5
MAX_LANGS = 512
UNDETERMINED = "und"

_CHUNK = 1 << 18


def code_points(column) -> tuple[np.ndarray, np.ndarray]:
    """The code points of an Arrow string array, A-Z lower-cased, and len + 1 offsets."""
    data, texts = text_buffer(column)
    heads = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return np.where((points >= 65) & (points <= 90), points + np.uint32(32), points), heads[texts]


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def has_letter(column) -> np.ndarray:
    """Whether each text of an Arrow column has a letter (a code point of a letter category; number signs are none)."""
    data, texts = text_buffer(column)
    sums = np.r_[0, np.cumsum(_ASCII_LETTER[data])]
    out = sums[texts[1:]] > sums[texts[:-1]]
    for i in np.flatnonzero(~out).tolist():
        out[i] = any(map(str.isalpha, data[texts[i] : texts[i + 1]].tobytes().decode()))
    return out


def grams(points: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each code point."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    h = np.full(n, order * 0x9E3779B1 % (1 << 32), np.uint32)
    for j in range(order):
        h = (h ^ points[j : j + n]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
    return (h >> np.uint32(17)).astype(np.int32)


def bag(points: np.ndarray) -> np.ndarray:
    return np.concatenate([grams(points, k) for k in range(1, ORDERS + 1)])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Ftrl:
    """Multinomial logistic regression by follow-the-regularised-leader (proximal), L1 and L2 penalties."""

    def __init__(self, features: int, classes: int, alpha=0.5, beta=1.0, l1=0.02, l2=0.05):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1.0
        g = x[:, None] * p[None, :]
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature that gives held-back rows the least negative log-likelihood."""
    if not len(y):
        return 1.0
    grid = np.geomspace(0.05, 20, 121)
    nll = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(nll))])


class Model:
    """langs, the weight of each bucket's occurrence per class (IDF times regression weight), temperature."""

    def __init__(self, langs: list[str], table: np.ndarray, temp: float):
        self.langs, self.table, self.temp = langs, table.astype(np.float32), temp

    def logits(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One row per text: the mean weight of its n-grams, over the whole text."""
        out, total = np.zeros((len(at) - 1, len(self.langs))), np.zeros(len(at) - 1)
        for k in range(1, ORDERS + 1):
            g = grams(points, k)
            lo, hi = at[:-1], np.maximum(at[1:] - k + 1, at[:-1])
            total += hi - lo
            for i in range(0, len(g), _CHUNK):
                j = min(len(g), i + _CHUNK)
                a, b = np.clip(lo, i, j) - i, np.clip(hi, i, j) - i
                some = np.flatnonzero(b > a)
                if len(some):
                    edges = np.stack([a[some], b[some]], 1).ravel()
                    # a row past the chunk, so that the last text may end at its edge
                    values = np.concatenate([self.table[g[i:j]], np.zeros((1, len(self.langs)), np.float32)])
                    out[some] += np.add.reduceat(values, edges, axis=0, dtype=np.float64)[::2]
        return out * (SCALE / np.maximum(total, 1))[:, None]


#: Relative frequencies are small; this brings them to the order of one.
SCALE = 20.0


def fit(rows: list[tuple], df: np.ndarray, n_docs: int, epochs: int = 3) -> Model:
    """rows: (lang, buckets, counts), in a fixed order. df: documents with each bucket, of n_docs."""
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([UNDETERMINED], np.zeros((FEATURES, 1)), 1.0)
    idf = np.log((1.0 + n_docs) / (1.0 + df)) + 1.0
    data = []
    for lang, at, count in rows:
        at, count = np.asarray(at, np.int32), np.asarray(count, float)
        data.append((at, SCALE * count / max(1.0, count.sum()) * idf[at], langs.index(lang)))
    held = data[::CALIBRATE] if len(data) >= 10 * CALIBRATE else []
    model = Ftrl(FEATURES, len(langs))
    rng = np.random.default_rng(11)
    train = [d for i, d in enumerate(data) if not held or i % CALIBRATE]
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            model.learn(*train[i])
    w = model.weights()
    z = np.array([x @ w[at] for at, x, _ in held]).reshape(-1, len(langs))
    return Model(langs, w * idf[:, None], temperature(z, np.array([y for *_, y in held], int)))


def train(labelled: DataFrame, fit_rows: int = FIT_ROWS, most_langs: int = MAX_LANGS) -> Model:
    """Fit on (doc_id, text, lang): IDF over all rows, weights on at most fit_rows rows of each language.

    The rows fitted on are those with the least hash of their doc_id and text, exactly fit_rows of them or all that
    there are; rows equal in both count once there. Only their n-gram counts (at most FEATURES a row) reach the
    driver. Of more than most_langs languages the most frequent are learned (ties by name). Rows whose text or
    language is null take no part; an empty text is learned from like any; without rows all is undetermined.
    """
    spark = labelled.sparkSession
    labelled = labelled.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    labelled = labelled.withColumn("u", unit_hash("lang", F.col("doc_id"), F.xxhash64("text")))
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("u", 0.02).alias("different")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()
    # more than are wanted, by chance and by the estimate's error; then exactly the least
    bound = {r["lang"]: min(1.0, (fit_rows + 6 * fit_rows**0.5) / max(1.0, 0.9 * r["different"])) for r in sizes}
    chance = F.create_map(*[F.lit(x) for r in bound.items() for x in r]) if sizes else None
    pick = F.coalesce(F.col("u") < chance[F.col("lang")], F.lit(False)) if sizes else F.lit(False)

    def run(batches):
        import pyarrow as pa

        names = ["lang", "u", "bucket", "n", "counts"]
        seen = np.zeros(FEATURES, bool)
        df, n, taken = np.zeros(FEATURES, np.int64), 0, set()
        for b in (part for whole in batches for part in slices(whole, 0)):
            points, at = code_points(b.column(0))
            chosen = b.column(1).to_numpy(zero_copy_only=False).copy()
            for i in np.flatnonzero(chosen).tolist():
                name = (b.column(2)[i].as_py(), b.column(3)[i].as_py())
                chosen[i] = name not in taken
                taken.add(name)
            rows = []
            for i in range(b.num_rows):
                seen[:] = False
                own = points[at[i] : at[i + 1]]
                for k in range(1, ORDERS + 1):
                    seen[grams(own, k)] = True
                df += seen
                if chosen[i]:
                    counts = np.bincount(bag(own), minlength=FEATURES)
                    where = np.flatnonzero(counts)
                    rows.append((i, np.concatenate([where, counts[where]]).astype(np.int32).tobytes()))
            n += b.num_rows
            if rows:
                take = pa.array([r[0] for r in rows])
                none = pa.nulls(len(rows), pa.list_(pa.int32()))
                yield pa.record_batch([b.column(2).take(take), b.column(3).take(take), none, none, pa.array([r[1] for r in rows], pa.binary())], names)
        some = np.flatnonzero(df)
        if n:
            df_rows = [pa.array([None], pa.string()), pa.array([float(n)]), pa.array([some.astype(np.int32)], pa.list_(pa.int32())), pa.array([df[some].astype(np.int32)], pa.list_(pa.int32())), pa.nulls(1, pa.binary())]
            yield pa.record_batch(df_rows, names)

    facts = labelled.select("text", pick.alias("chosen"), "lang", "u").mapInArrow(run, "lang string, u double, bucket array<int>, n array<int>, counts binary")
    facts = staged(facts, "lang-facts")
    totals = facts.where("lang IS NULL")
    df = np.zeros(FEATURES)
    for r in totals.select(F.explode(F.arrays_zip("bucket", "n")).alias("x")).groupBy("x.bucket").agg(F.sum("x.n").alias("n")).collect():
        df[r[0]] = r[1]
    n_docs = totals.agg(F.sum("u")).first()[0] or 0
    mine = facts.where("lang IS NOT NULL").groupBy("lang", "u").agg(F.min("counts").alias("counts"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("u"))
    rows = mine.withColumn("nth", nth).where(F.col("nth") <= fit_rows).select("u", "lang", "counts").collect()
    halves = lambda data: np.frombuffer(bytes(data), np.int32).reshape(2, -1)
    return fit([(r["lang"], *halves(r["counts"])) for r in sorted(rows, key=lambda r: (r["u"], r["lang"]))], df, int(n_docs))


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs with lang_pred and score (the calibrated probability; 0 for `und`), under the given names."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop(*names)
    shared = spark.sparkContext.broadcast(model)
    text_at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for b in (part for whole in batches for part in slices(whole, text_at)):
            column = b.column(text_at)
            points, at = code_points(column)
            p = softmax(m.logits(points, at) / m.temp)
            best = p.argmax(1)
            letter = has_letter(column)
            lang = [m.langs[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), letter, strict=True)]
            score = np.where(letter, p[np.arange(len(best)), best], 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, *names])

    return docs.mapInArrow(run, with_fields(docs.schema, "`{}` string, `{}` double".format(*names)))


def fold(doc_id, parts: int):
    """crc32 of the id as text, modulo parts; of a null id, as of the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(parts))


def identify(docs: DataFrame, held_out: int = 2, parts: int = 4, fit_rows: int = FIT_ROWS, names: tuple[str, str, str] = ("held_out", "lang_pred", "score")) -> DataFrame:
    """Predict the language of every whole text, learning from the labelled rows outside one fold.

    docs needs doc_id, text and lang; all its columns return (but own lang_pred, score, held_out, which are
    replaced), with held_out, lang_pred and score (or other `names`). Predictions take the text alone. A text that is null or
    has no letter is `und` with score 0; so is every text if no row is labelled. Of equally likely languages the first by
    name is given. Repeated rows fare alike; an empty table gives none.

    x: TF-IDF of n-grams of 1 to 3 code points, by relative frequency, so that a text's logits are the mean
    of a weight per n-gram and texts of any length are scored in one pass over their characters.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*names)
    model = train(docs.where(fold(F.col("doc_id"), parts) != held_out).select("doc_id", "text", "lang"), fit_rows)
    return predict(docs, model, names[1:]).withColumn(names[0], fold(F.col("doc_id"), parts) == held_out)


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is determined with a score of `least` or more, with the columns of docs.

    Null, empty and letterless texts go, and, if no row is labelled, all; repeated rows fare alike; columns of
    any names, also the operator's own, return unchanged; an empty table gives none.
    """
    names = tuple(unused(c, docs) for c in ("__held_out", "__lang_pred", "__score"))
    out = identify(docs, names=names)
    return out.where((F.col(names[1]) != UNDETERMINED) & (F.col(names[2]) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
