"""Toxicity: a convolutional text classifier over hashed word embeddings, with thresholds calibrated by language."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import mix64, parted, small_batches, staged, unit_hash, with_fields
from .langid import fold
from .tokens import _LOW, NOT_ALNUM, Words, words

#: Words and their heads of HEADS bytes are hashed to 2**BITS buckets.
BITS, HEADS = 20, (4, 5, 6)
#: Embedding dimensions; widths of the filters and how many of each; widths of the window sums and their channels.
DIMS, WIDTHS, FILTERS, WIDE, CHANNELS = 8, (1, 2, 3), 8, (16, 64), 4
#: Labelled rows fitted on for each label; their words in all; words of one of them.
FIT_ROWS, FIT_WORDS, FIT_LENGTH = 3000, 3_000_000, 1 << 18
#: Of the rows fitted on, one in so many calibrates; a bucket is embedded if so many of the others have it.
CALIBRATE, LEAST_ROWS = 4, 3
#: A language has a threshold of its own with so many calibrating rows of label 1.
OWN_THRESHOLD = 8
#: Words worked on together; of a longer text, pieces that overlap by the widest window.
BLOCK_WORDS = 1 << 15


def buckets(w: Words) -> np.ndarray:
    """A row a word: the bucket of the word and of its heads; -1 where a word is no longer than a head."""
    size, n = w.end - w.start, len(w.start)
    out = np.full((n, 1 + len(HEADS)), -1, np.int32)
    shift = np.uint64(64 - BITS)
    out[:, 0] = (mix64(w.hash) >> shift).astype(np.int32)
    eights = np.ndarray((len(w.data) + 1,), "<u8", np.concatenate([w.data, np.zeros(8, np.uint8)]), 0, (1,))
    first = eights[w.start] if n else np.zeros(0, np.uint64)
    for i, k in enumerate(HEADS, 1):
        some = size > k
        out[some, i] = (mix64((first[some] & _LOW[k]) * np.uint64(2 * k + 1) + np.uint64(k)) >> shift).astype(np.int32)
    return out


def tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words of an Arrow text column, A-Z lower-cased, split at ASCII other than letters and digits; len + 1 offsets."""
    w = words(column, lower=True, separators=NOT_ALNUM)
    return buckets(w), w.at


def pieces(at: np.ndarray, most: int = BLOCK_WORDS, lap: int = max(WIDE)) -> list[tuple[np.ndarray, ...]]:
    """Groups of (text, first word, end of window starts, end of words), each of about `most` words.

    A text of more than `most` words is cut; a window that starts before the cut finds its words after it.
    """
    out, group, held = [], [], 0
    for i in range(len(at) - 1):
        a, b = int(at[i]), int(at[i + 1])
        while b > a:
            cut = b if b - a <= most else a + most
            group.append((i, a, cut, min(b, cut + lap)))
            held += group[-1][3] - a
            a = cut
            if held >= most:
                out.append(group)
                group, held = [], 0
    return [tuple(np.array(x, np.int64) for x in zip(*g, strict=True)) for g in (*out, group) if g]


@dataclass
class Net:
    """index: bucket to row of `embed` (row 0: nothing); filters w[k] (k, DIMS, FILTERS); window channels v; output u, u0.

    langs: (rows, languages) log-likelihoods of a word's bucket; shift: the logit that each of them (last: any other) takes for its threshold.
    """

    index: np.ndarray
    embed: np.ndarray
    w: dict[int, np.ndarray] = field(default_factory=dict)
    b: dict[int, np.ndarray] = field(default_factory=dict)
    v: np.ndarray | None = None
    c: np.ndarray | None = None
    u: np.ndarray | None = None
    u0: float = 0.0
    langs: np.ndarray | None = None
    shift: np.ndarray | None = None
    temp: float = 1.0

    def start(self, seed: int = 7) -> Net:
        rng = np.random.default_rng(seed)
        for k in WIDTHS:
            self.w[k] = rng.normal(0, 0.4, (k, DIMS, FILTERS)).astype(np.float32)
            self.w[k][:, 0, ::2] = np.abs(self.w[k][:, 0, ::2])
            self.b[k] = np.zeros(FILTERS, np.float32)
        self.v = rng.normal(0, 0.3, (DIMS, CHANNELS)).astype(np.float32)
        self.v[0] = np.abs(self.v[0]) + 0.2
        self.c = np.full(CHANNELS, -0.3, np.float32)
        n = FILTERS * len(WIDTHS) + CHANNELS * len(WIDE)
        self.u = rng.normal(0, 0.1, n).astype(np.float32)
        self.u[FILTERS * len(WIDTHS) :] = 0.3
        self.u0 = -1.0
        return self

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        """The sum of the embeddings of a word's buckets."""
        out = self.embed[ids[:, 0]].copy()
        for i in range(1, ids.shape[1]):
            out += self.embed[ids[:, i]]
        return out

    def filtered(self, x: np.ndarray, last: np.ndarray, k: int) -> np.ndarray:
        """The activation of the windows of k words that start at each word; what lies beyond `last` counts as nothing."""
        out = x @ self.w[k][0]
        for p in range(1, k):
            more = x[p:] @ self.w[k][p]
            out[:-p] += np.where((np.arange(len(x) - p) + p < last[:-p])[:, None], more, 0)
        return out

    def features(self, ids: np.ndarray, at: np.ndarray, most: int = BLOCK_WORDS) -> tuple[np.ndarray, np.ndarray]:
        """Pooled features of whole texts, and their mean language log-likelihoods."""
        n, langs = len(at) - 1, self.langs.shape[1]
        out, lang = np.zeros((n, len(self.u)), np.float32), np.zeros((n, langs))
        for text, a, v, e in pieces(at, most):
            rows, base = ids[a[0] : e[-1]], a[0]
            x = self.vectors(rows)
            last = np.repeat(e - base, np.diff(np.r_[a, e[-1]]))
            edges = np.stack([a - base, v - base], 1).ravel()
            closed = edges if edges[-1] < len(x) else edges[:-1]
            pooled = []
            for k in WIDTHS:
                m = np.maximum.reduceat(self.filtered(x, last, k), closed, axis=0)[::2]
                pooled.append(np.maximum(m + self.b[k], 0))
            sums = np.concatenate([np.zeros((1, CHANNELS)), np.cumsum(np.maximum(x @ self.v + self.c, 0), axis=0, dtype=np.float64)])
            here = np.arange(len(x))
            for k in WIDE:
                pooled.append(np.maximum.reduceat(sums[np.minimum(here + k, last)] - sums[here], closed, axis=0)[::2].astype(np.float32))
            np.maximum.at(out, text, np.concatenate(pooled, 1))
            if langs:
                np.add.at(lang, text, np.add.reduceat(self.langs[rows[:, 0]], closed, axis=0, dtype=np.float64)[::2])
        return out, lang

    def logits(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw logit and language (position in shift) of whole texts."""
        h, lang = self.features(ids, at)
        best = np.where(lang.any(1), lang.argmax(1), lang.shape[1]) if lang.shape[1] else np.zeros(len(h), int)
        return h.astype(np.float64) @ self.u + self.u0, best

    def score(self, buckets: np.ndarray, at: np.ndarray, least: float) -> np.ndarray:
        """Calibrated scores: a language's threshold has the score `least`."""
        z, lang = self.logits(self.index[buckets], at)
        return sigmoid((z - self.shift[lang]) / self.temp + np.log(least / (1 - least)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Adam:
    def __init__(self, rate: float):
        self.rate, self.m, self.s, self.t = rate, {}, {}, 0

    def step(self, name, value, grad):
        m, s = self.m.setdefault(name, np.zeros_like(grad)), self.s.setdefault(name, np.zeros_like(grad))
        m += 0.1 * (grad - m)
        s += 0.01 * (grad * grad - s)
        value -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(s / (1 - 0.99**self.t)) + 1e-6)


def learn(net: Net, texts: list[np.ndarray], y: np.ndarray, epochs: int = 5, batch: int = 32, rate: float = 0.01, decay: float = 1e-4) -> None:
    """Fit the net to texts (arrays of row ids) with logistic loss, both labels weighing alike, by hand-written gradients."""
    rng, opt = np.random.default_rng(3), Adam(rate)
    weight = np.where(y > 0, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum()))) if len(y) else y
    seen = np.full(net.embed.shape, 1e-2, np.float32)
    for _ in range(epochs):
        turn = rng.permutation(len(texts))
        for g in range(0, len(turn), batch):
            mine = turn[g : g + batch]
            ids = np.concatenate([texts[i] for i in mine])
            size = np.array([len(texts[i]) for i in mine])
            at = np.r_[0, np.cumsum(size)]
            x, last = net.vectors(ids), np.repeat(at[1:], size)
            dx = np.zeros_like(x)
            feats, backs = [], []
            for k in WIDTHS:
                act = net.filtered(x, last, k)
                top = np.maximum.reduceat(act, at[:-1], axis=0)
                where = np.stack([_first_of(act[:, f], top[:, f], at) for f in range(FILTERS)], 1)
                feats.append(np.maximum(top + net.b[k], 0))
                backs.append(where)
            raw = x @ net.v + net.c
            sums = np.concatenate([np.zeros((1, CHANNELS)), np.cumsum(np.maximum(raw, 0), axis=0, dtype=np.float64)])
            here = np.arange(len(x))
            for k in WIDE:
                inside = sums[np.minimum(here + k, last)] - sums[here]
                top = np.maximum.reduceat(inside, at[:-1], axis=0)
                backs.append(np.stack([_first_of(inside[:, c], top[:, c], at) for c in range(CHANNELS)], 1))
                feats.append(top.astype(np.float32))
            h = np.concatenate(feats, 1)
            dz = (weight[mine] * (sigmoid(h @ net.u + net.u0) - y[mine]) / len(mine)).astype(np.float32)
            dh = dz[:, None] * net.u[None, :]
            opt.t += 1
            du, du0, col = h.T @ dz + decay * net.u, dz.sum(keepdims=True), 0
            grads = {}
            for k, where in zip(WIDTHS, backs, strict=False):
                d = dh[:, col : col + FILTERS] * (feats[col // FILTERS] > 0)
                grads["b", k], grads["w", k] = d.sum(0), np.zeros_like(net.w[k])
                for p in range(k):
                    to = where + p
                    ok = to < at[1:, None]
                    to = np.where(ok, to, 0)
                    dd = d * ok
                    grads["w", k][p] = np.einsum("tfd,tf->df", x[to], dd)
                    np.add.at(dx, to.ravel(), (dd[:, :, None] * net.w[k][p].T[None]).reshape(-1, DIMS))
                col += FILTERS
            dr = np.zeros((len(x) + 1, CHANNELS))
            for j, k in enumerate(WIDE):
                where, d = backs[len(WIDTHS) + j], dh[:, col : col + CHANNELS]
                for c in range(CHANNELS):
                    np.add.at(dr[:, c], where[:, c], d[:, c])
                    np.add.at(dr[:, c], np.minimum(where[:, c] + k, at[1:]), -d[:, c])
                col += CHANNELS
            dr = (np.cumsum(dr, axis=0)[:-1] * (raw > 0)).astype(np.float32)
            grads["v"], grads["c"] = x.T @ dr, dr.sum(0)
            dx += dr @ net.v.T
            touched = np.flatnonzero(np.abs(dx).sum(1))
            for column in range(ids.shape[1]):
                rows = ids[touched, column]
                real = rows > 0
                np.add.at(seen, rows[real], dx[touched[real]] ** 2)
                np.add.at(net.embed, rows[real], -5 * rate * dx[touched[real]] / np.sqrt(seen[rows[real]]))
            for (kind, *k), grad in ((key if isinstance(key, tuple) else (key,), g) for key, g in grads.items()):
                value = getattr(net, kind)[k[0]] if k else getattr(net, kind)
                opt.step((kind, *k), value, grad + decay * value)
            opt.step("u", net.u, du)
            bias = np.array([net.u0], np.float32)
            opt.step("u0", bias, du0)
            net.u0 = float(bias[0])


def _first_of(values: np.ndarray, top: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first place in each text that has the text's maximum."""
    hit = np.flatnonzero(values == np.repeat(top, np.diff(at)))
    return hit[np.searchsorted(hit, at[:-1])]


def threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The logit at and above which rows are called 1 with the greatest F1, midway to the next row below."""
    if not len(z):
        return 0.0
    turn = np.argsort(-z, kind="stable")
    z, hit, miss = z[turn], np.cumsum(weight[turn] * y[turn]), np.cumsum(weight[turn] * (1 - y[turn]))
    f1 = 2 * hit / np.maximum(hit + miss + (weight * y).sum(), 1e-12)
    ends = np.r_[z[1:] != z[:-1], True]
    at = int(np.argmax(np.where(ends, f1, -1)))
    return float((z[at] + z[at + 1]) / 2 if at + 1 < len(z) else z[at] - 0.5)


def temperature(z: np.ndarray, y: np.ndarray, weight: np.ndarray, least: float) -> float:
    """Of a grid, the temperature that gives rows with logits from their threshold on the least loss."""
    grid = np.geomspace(0.2, 5, 41)
    if not len(z):
        return 1.0
    base = np.log(least / (1 - least))
    p = [np.clip(sigmoid(z / t + base), 1e-9, 1 - 1e-9) for t in grid]
    return float(grid[int(np.argmin([-(weight * (y * np.log(q) + (1 - y) * np.log(1 - q))).sum() for q in p]))])


def parted_rows(n: int) -> tuple[list[int], list[int]]:
    """Which of n rows are fitted on, and which are held back."""
    held = [i for i in range(n) if n >= 10 * CALIBRATE and i % CALIBRATE == 0]
    return [i for i in range(n) if not held or i % CALIBRATE], held


def fit(rows: list[tuple[np.ndarray, int, float, str | None]], least: float = 0.3) -> Net:
    """rows: (buckets of its words, label, labelled rows that it stands for, language or null), in a fixed order."""
    index = np.zeros(1 << BITS, np.int32)
    rows = [r for r in rows if len(r[0])]
    kept, held = parted_rows(len(rows))
    y = np.array([r[1] for r in rows], np.float32)
    # which rows have a bucket, by label; the first dimension of an embedding starts at its log odds
    counts = np.zeros((2, 1 << BITS), np.int32)
    for i in kept:
        own = np.unique(rows[i][0])
        counts[rows[i][1], own[own >= 0]] += 1
    used = np.flatnonzero(counts.sum(0) >= LEAST_ROWS)
    index[used] = np.arange(1, len(used) + 1)
    # a bucket of -1 reads the last place, which therefore stands for nothing
    index = np.r_[index, np.int32(0)]
    embed = np.zeros((len(used) + 1, DIMS), np.float32)
    if len(used):
        n = np.maximum(1, np.array([(y[kept] == 0).sum(), (y[kept] == 1).sum()]))
        odds = np.log((counts[1, used] + 0.5) / (n[1] + 1)) - np.log((counts[0, used] + 0.5) / (n[0] + 1))
        embed[1:] = np.random.default_rng(5).normal(0, 0.05, (len(used), DIMS))
        embed[1:, 0] = np.clip(odds, -3, 3) * np.minimum(1, counts[:, used].sum(0) / 6) / 3
    net = Net(index, embed).start()
    names = sorted({r[3] for r in rows if r[3] is not None})
    net.langs = np.zeros((len(embed), len(names)), np.float32)
    for r in (rows[i] for i in kept):
        if r[3] is not None:
            np.add.at(net.langs[:, names.index(r[3])], index[r[0][:, 0]], 1)
    if len(names):
        net.langs = np.log((net.langs + 0.1) / (net.langs.sum(0) + 0.1 * len(embed))).astype(np.float32)
        net.langs -= net.langs.mean(1, keepdims=True)
        net.langs[0] = 0
    if len(set(y[kept].tolist())) == 2:
        learn(net, [index[rows[i][0]] for i in kept], y[kept])
    else:
        net.u[:], net.u0 = 0, 0.0
    _calibrate(net, [rows[i] for i in (held or kept)], least)
    return net


def _calibrate(net: Net, rows: list[tuple], least: float) -> None:
    """Thresholds by predicted language, and one temperature."""
    at = np.r_[0, np.cumsum([len(r[0]) for r in rows])].astype(np.int64)
    n = net.langs.shape[1]
    net.shift = np.zeros(n + 1)
    if not rows:
        return
    z, lang = net.logits(net.index[np.concatenate([r[0] for r in rows])], at)
    y, weight = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    _set_thresholds(net, z, lang, y, np.ones(len(z)), weight, least)


def _set_thresholds(net: Net, z: np.ndarray, lang: np.ndarray, y: np.ndarray, count: np.ndarray, weight: np.ndarray, least: float) -> None:
    """From logits, languages and labels, each of `count` rows that weigh `weight` together."""
    n = net.langs.shape[1]
    net.shift = np.zeros(n + 1)
    if len(set(y.tolist())) < 2:
        net.shift[:] = np.average(z, weights=count) + (2.0 if not y.any() else -2.0)
        return
    net.shift[:] = threshold(z, y, weight)
    for k in range(n):
        mine = lang == k
        if (count * y)[mine].sum() >= OWN_THRESHOLD and (count * (1 - y))[mine].sum() >= OWN_THRESHOLD:
            net.shift[k] = threshold(z[mine], y[mine], weight[mine])
    net.temp = temperature(z - net.shift[lang], y, weight, least)


def with_logits(net: Net, texts: DataFrame) -> DataFrame:
    """texts without their `text`, with its hash h, its logit z in 256ths and its language; wordless texts are left out, as they have nothing to calibrate by."""
    known = texts.sparkSession.sparkContext.broadcast(net)
    own = [f for f in texts.schema.fields if f.name != "text"]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, at = tokens(b.column(0))
            z, lang = known.value.logits(known.value.index[ids], at)
            some = np.diff(at) > 0
            whole = np.floor(np.clip(z, -64, 64) * 256).astype(np.int64)
            columns = [*b.columns[1:], pa.array(whole), pa.array(lang.astype(np.int64))]
            yield pa.record_batch([c.filter(pa.array(some)) for c in columns], [*b.schema.names[1:], "z", "lang"])

    names = [F.col(f.name) for f in own]
    return texts.select("text", *names, F.xxhash64("text").alias("h")).mapInArrow(run, with_fields(StructType(own), "h long, z long, lang long"))


def labelled_logits(net: Net, texts: DataFrame, known: DataFrame, n_known: int) -> DataFrame:
    """with_logits of the rows of texts(doc_id, text) that known(__id, y, u) labels, with y and u.

    Texts are scored where they lie, and what meets the labels is a few numbers a row. Rows that surely have no label
    aren't scored, by a bit filter of bounded size.
    """
    texts = texts.where("text IS NOT NULL")
    if texts.schema["doc_id"].dataType == known.schema["__id"].dataType:
        texts = parted(texts, [F.col("doc_id")], known.select("__id"), n_keys=n_known)[1]
    return with_logits(net, texts).join(known, F.col("doc_id") == F.col("__id")).drop("doc_id", "__id")


def calibrate_on_all(net: Net, texts: DataFrame, fitted: list[float], sizes: dict[int, int], least: float, known: DataFrame | None = None) -> int:
    """Thresholds and temperature from all labelled rows of texts(text, y, u) but those fitted on, by their u; how many they are.

    With known(__id, y, u), texts has doc_id instead of y and u. Rows of one u count once. Logits are scored in tasks and
    counted by language, label and 256ths, so that a bounded number of counts reaches the driver, whatever the rows. Each
    label weighs as in all labelled rows. Without rows of both labels the net keeps the thresholds that it has.
    """
    own = texts.sparkSession.createDataFrame([(u,) for u in fitted], "__u double")
    rows = with_logits(net, texts) if known is None else labelled_logits(net, texts, known, sum(sizes.values()))
    rows = rows.join(F.broadcast(own), F.col("u") == F.col("__u"), "left_anti")
    one = rows.groupBy("u").agg(F.min("h").alias("h"), F.min_by(F.struct("y", "z", "lang"), "h").alias("r"))
    got = one.groupBy("r.y", "r.z", "r.lang").agg(F.count(F.lit(1)).alias("n")).orderBy("y", "z", "lang").collect()
    y, z, lang, n = (np.array([r[c] for r in got], float) for c in ("y", "z", "lang", "n"))
    if len(set(y.tolist())) == 2:
        share = {k: max(1.0, sizes.get(k, 0) / n[y == k].sum()) for k in (0, 1)}
        _set_thresholds(net, (z + 0.5) / 256, lang.astype(int), y, n, n * np.where(y > 0, share[1], share[0]), least)
    return int(n.sum())


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_words: int = FIT_WORDS, least: float = 0.3) -> Net:
    """Fit on docs(doc_id, text, and lang if there is one) and labels(doc_id, toxic).

    At most fit_rows rows a label are fitted on, those with the least hash of their doc_id, while their words
    come to fit_words at most; a text of more than FIT_LENGTH words is passed over. Rows of one id that disagree
    are averaged. Only the chosen rows' word buckets reach the driver. Thresholds and temperature come from all
    labelled rows that weren't fitted on; see calibrate_on_all.
    """
    spark = docs.sparkSession
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.avg(F.col("toxic").cast("double")).alias("y"))
    known = known.select("__id", (F.col("y") >= 0.5).cast("int").alias("y"), unit_hash("toxic", F.col("__id")).alias("u"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [known.where(F.col("y") == y).orderBy("u", "__id").limit(fit_rows) for y in (1, 0)]
    sample = staged(parts[0].unionByName(parts[1]), "toxic-sample")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), lang.alias("lang"))
    every = texts.select("doc_id", "text")
    # twice fit_rows rows at most, whatever the labels
    texts = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).where("text IS NOT NULL").select("text", "lang", "y", "u")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, at = tokens(b.column(0))
            raw = [ids[at[i] : at[i + 1]].tobytes() for i in range(b.num_rows)]
            yield pa.record_batch([pa.array(np.diff(at), pa.int64()), pa.array(raw, pa.binary()), b.column(1), b.column(2), b.column(3)], ["n", "ids", "lang", "y", "u"])

    facts = staged(texts.mapInArrow(run, "n long, ids binary, lang string, y int, u double"), "toxic-facts")
    # one row of each labelled id (repeated documents count once); lengths decide which of them fit
    one = facts.where(F.col("n") <= FIT_LENGTH).groupBy("u", "y").agg(F.min(F.struct("n", F.md5("ids").alias("name"))).alias("m"))
    chosen, left = [], {0: fit_words, 1: fit_words}
    for r in sorted(one.select("u", "y", "m.n", "m.name").collect(), key=lambda r: (r["u"], r["y"])):
        if r["n"] <= left[r["y"]]:
            left[r["y"]] -= r["n"]
            chosen.append((r["u"], r["name"]))
    pick = spark.createDataFrame(chosen, "u double, name string")
    got = facts.withColumn("name", F.md5("ids")).join(F.broadcast(pick), ["u", "name"]).groupBy("u", "name").agg(F.min(F.struct("y", "lang", "ids")).alias("r")).orderBy("u", "name").select("u", "r.*").collect()
    share = {y: max(1.0, sizes.get(y, 0) / max(1, sum(r["y"] == y for r in got))) for y in (0, 1)}
    width = 1 + len(HEADS)
    net = fit([(np.frombuffer(bytes(r["ids"]), np.int32).reshape(-1, width), r["y"], share[r["y"]], r["lang"]) for r in got], least)
    worded = [r["u"] for r in got if r["ids"]]
    calibrate_on_all(net, every, [worded[i] for i in parted_rows(len(worded))[0]], sizes, least, known)
    return net


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: int = 2, parts: int = 4, least: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Score every whole text for toxicity, learning from the labels outside one fold.

    docs needs doc_id and text and may have lang (used for the calibration of rows fitted on, never for a score);
    labels needs doc_id and toxic (1 or 0; null is none). Other columns are ignored. Returns one row per input row:
    doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= least).

    A word is the sum of the embeddings of its hash and of the hashes of its heads of 4 to 6 bytes. Filters over 1,
    2 and 3 words and sums of rectified channels over windows of 16 and 64 words are pooled by their maximum over
    the whole text; a long text in pieces that overlap. All is trained in numpy on a bounded sample (see train). Each
    language, as the text's own words tell it, has a threshold of greatest F1 on rows held back; a score is the
    distance from it, so that the threshold itself has the score `least`.

    Null, empty and wordless texts get one and the same low or prior score; repeated rows and ties fare alike, as a
    score follows from the text alone. Without labels of both kinds all texts get about the same score. An empty
    table gives none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.where(fold(F.col("doc_id"), parts) != held_out)
    net = spark.sparkContext.broadcast(train(known, labels.where(fold(F.col("doc_id"), parts) != held_out), fit_rows, least=least))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(net.value.score(*tokens(b.column(1)), least), pa.float64())], ["doc_id", "score"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, score double")
    return rows.select("doc_id", (fold(F.col("doc_id"), parts) == held_out).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
