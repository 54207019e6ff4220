"""Substring dedup by recompression: locally consistent names for word runs and pairs reveal long repeats."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, parted, small_batches, staged
from .shared import SharedKeys, find_shared
from .tokens import Words, _hash, windows, words

#: Rounds of naming. Each shortens a text to about 3/4; after these a symbol is some three words long.
ROUNDS = 4
_RUN = np.uint64(0x8CB92BA72F3D8DD7)
_PAIR = np.uint64(0xAEF17502108EF2D9)
#: As the context of a symbol that depends on where its text begins or ends.
_NEVER = 1 << 40


class Symbols:
    """The symbols of a batch of texts after some rounds, in order.

    name: 64 bits, equal for equal words; text: which text; start, end: the words it spans; left, right:
    the words that decide it. Wherever words left..right recur, this symbol recurs at the same place.
    """

    def __init__(self, name, text, start, end, left, right):
        self.name, self.text, self.start, self.end, self.left, self.right = name, text, start, end, left, right

    def take(self, keep: np.ndarray) -> Symbols:
        return Symbols(self.name[keep], self.text[keep], self.start[keep], self.end[keep], self.left[keep], self.right[keep])


def _neighbours(s: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """The left context of each symbol's left neighbour and the right context of its right one."""
    n = len(s.name)
    left, right = np.full(n, -_NEVER), np.full(n, _NEVER)
    same = s.text[1:] == s.text[:-1]
    left[1:][same] = s.left[:-1][same]
    right[:-1][same] = s.right[1:][same]
    return left, right


def name_runs(s: Symbols, round_: int) -> Symbols:
    """Replace each maximal run of one name by a symbol named after the name and the run's length."""
    n = len(s.name)
    if n < 2:
        return s
    joined = (s.name[1:] == s.name[:-1]) & (s.text[1:] == s.text[:-1])
    before, after = _neighbours(s)
    head = np.flatnonzero(np.r_[True, ~joined])
    tail = np.r_[head[1:], n] - 1
    length = tail - head + 1
    out = s.take(head)
    many = length > 1
    out.name[many] = mix64(out.name[many] * _RUN + length[many].astype(np.uint64) + np.uint64(round_))
    out.end = s.end[tail]
    # that a run goes no further, and that a single symbol is no run, both neighbours show
    out.left = np.minimum(s.left[head], before[head])
    out.right = np.maximum(s.right[tail], after[tail])
    return out


def name_pairs(s: Symbols, round_: int) -> Symbols:
    """Replace each (heads, tails) pair by a symbol named after both; a name's coin is a bit of its hash."""
    n = len(s.name)
    if n < 2:
        return s
    heads = (mix64(s.name ^ np.uint64((round_ + 1) * int(_PAIR) % (1 << 64))) >> np.uint64(63)) == 1
    pair = heads[:-1] & ~heads[1:] & (s.text[1:] == s.text[:-1])
    before, after = _neighbours(s)
    first = np.r_[pair, False]
    second = np.r_[False, pair]
    alone = ~first & ~second
    # a lone heads waited for tails on its right, a lone tails for heads on its left
    right = np.where(alone & heads, np.maximum(s.right, after), s.right)
    left = np.where(alone & ~heads, np.minimum(s.left, before), s.left)
    name, end = s.name.copy(), s.end.copy()
    i = np.flatnonzero(first)
    name[i] = mix64(s.name[i] * _PAIR + mix64(s.name[i + 1] ^ _RUN) + np.uint64(round_))
    end[i], right[i], left[i] = s.end[i + 1], np.maximum(s.right[i], s.right[i + 1]), np.minimum(s.left[i], s.left[i + 1])
    return Symbols(name, s.text, s.start, end, left, right).take(~second)


def recompress(w: Words, rounds: int = ROUNDS) -> Symbols:
    n = len(w.hash)
    text = np.repeat(np.arange(len(w.at) - 1), np.diff(w.at))
    at = np.arange(n)
    s = Symbols(w.hash.copy(), text, at, at + 1, at, at + 1)
    for r in range(rounds):
        s = name_pairs(name_runs(s, r), r)
    return s


def _inner(w: Words, k: int, rounds: int) -> Symbols:
    """Symbols that some k-word window decides; the context of others goes beyond any."""
    s = recompress(w, rounds)
    return s.take(s.right - s.left <= k)


def _decided(s: Symbols, n: int, k: int, some=slice(None)) -> np.ndarray:
    """How many of the symbols each of the k-word windows of a batch of n words decides."""
    # window i decides a symbol if i <= left and right <= i + k
    lo, hi = np.maximum(s.right[some] - k, 0), s.left[some] + 1
    steps = np.bincount(lo, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(hi, n), minlength=n + 1)[: n + 1]
    return np.cumsum(steps)[:n]


def _whole(w: Words, k: int) -> np.ndarray:
    """Whether the window that starts at each word is within one text."""
    return np.arange(len(w.hash)) + k <= np.repeat(w.at[1:], np.diff(w.at))


def _keys(column, k: int, rounds: int):
    """Each text's distinct keys: the symbols that windows decide, and the hash of each window that decides none."""
    w = words(column)
    n = len(w.hash)
    if n < k:
        return
    s = _inner(w, k, rounds)
    cut = np.searchsorted(s.text, np.arange(len(w.at)))
    plain = np.flatnonzero((_decided(s, n, k) == 0) & _whole(w, k))
    hashes = windows(w.hash, k)[plain]
    edge = np.searchsorted(plain, w.at)
    for i in range(len(w.at) - 1):
        if w.at[i + 1] - w.at[i] >= k:
            yield np.unique(np.concatenate([s.name[cut[i] : cut[i + 1]], hashes[edge[i] : edge[i + 1]]]))


def candidates(w: Words, shared: SharedKeys, k: int, rounds: int) -> np.ndarray:
    """First words of the windows that may occur in two texts: every symbol that the window decides is shared.

    A window that decides no symbol is a candidate if the window itself is shared.
    """
    n = len(w.hash)
    if n < k:
        return np.zeros(0, np.int64)
    s = _inner(w, k, rounds)
    ok = (_decided(s, n, k, shared(s.name) == 0) == 0) & _whole(w, k)
    plain = np.flatnonzero(ok & (_decided(s, n, k) == 0))
    ok[plain] = shared(windows(w.hash, k)[plain]) > 0
    return np.flatnonzero(ok)


def _covered(n: int, starts: np.ndarray, k: int) -> np.ndarray:
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + k, n), -1)
    return np.cumsum(steps)[:n] > 0


def repeated_windows(docs: DataFrame, k: int = 50, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, text_key, starts): the windows of each text whose words also start in a smaller doc_id."""

    def keys(column):
        return _keys(column, k, rounds)

    shared = find_shared(docs, keys)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            w = words(b.column(2))
            at = candidates(w, shared, k, rounds)
            if not len(at):
                continue
            text = np.searchsorted(w.at, at, "right") - 1
            # windows that cross a text's end are among the hashes but not among the candidates
            h, g = windows(w.hash, k)[at], windows(_hash(w.data, w.start, w.end, seed=1), k)[at]
            yield pa.record_batch(
                [b.column(0).take(pa.array(text)), b.column(1).take(pa.array(text)), pa.array((at - w.at[text]).astype(np.int32)), pa.array(h.view(np.int64)), pa.array((g >> np.uint64(32)).astype(np.uint32).view(np.int32))],
                ["doc_id", "text_key", "start", "h", "g"],
            )

    found = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, f"doc_id {id_type}, text_key long, start int, h long, g int")
    found = staged(found, "windows")
    first = found.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select(F.col("h").alias("__h"), F.col("g").alias("__g"), "first")
    # staged on both sides, so that adaptive execution can split a window that very many texts have
    late = found.join(staged(first, "window-firsts"), (F.col("h") == F.col("__h")) & (F.col("g") == F.col("__g"))).where(F.col("first") < F.col("doc_id"))
    return late.groupBy("doc_id", "text_key").agg(F.collect_set("start").alias("starts"))


def substring_dedup(docs: DataFrame, k: int = 50, rounds: int = ROUNDS) -> DataFrame:
    """Remove each word that is covered by a k-word window which also starts in a document with a smaller doc_id.

    docs needs doc_id and text; other columns are ignored. Words are runs of anything but space and \\t to
    \\r, unchanged. Returns one row per input row: doc_id, n_words, n_removed, kept (the other words joined
    by one space). Windows are judged on the input. A null or empty text has no words; a text of fewer than
    k words keeps all; rows with a null doc_id lose nothing and are no evidence; repeated rows fare alike,
    as only a smaller doc_id counts; an empty table gives none.

    Recompression: round by round, maximal runs of a symbol, then (heads, tails) pairs, get a new name. A
    name is a hash of what it stands for and a coin is a bit of the name, so naming is global with no
    dictionary to exchange, and equal words get equal symbols but near their ends. Each symbol carries the
    words that decide it. One round of Spark counts symbols over the corpus; a window can recur in another
    text only if every symbol that it decides is shared, so the others go, and those left are verified by
    96 bits of two hashes of their words' bytes that have nothing in common (of 10**13 windows, any two that
    differ agree with a probability under 0.001). A window that decides no symbol (in a long run) is its own symbol.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    late = staged(repeated_windows(docs, k, rounds), "window-starts")
    late = late.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "starts")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {id_type}, n_words long, n_removed long, kept string"

    def cut(b, lists=None):
        import pyarrow as pa

        w = words(b.column(1), hashes=False)
        per = np.diff(w.at)
        at = np.zeros(0, np.int64)
        if lists is not None:
            at = np.repeat(w.at[:-1], [len(x) if x.is_valid else 0 for x in lists]) + lists.flatten().to_numpy(zero_copy_only=False)
        gone = _covered(len(w.start), at.astype(np.int64), k)
        sums = np.r_[0, np.cumsum(gone)]
        removed = sums[w.at[1:]] - sums[w.at[:-1]]
        kept = []
        for i in range(len(per)):
            split = w.text_bytes(i).split()
            if removed[i]:
                split = [x for x, out in zip(split, gone[w.at[i] : w.at[i + 1]].tolist(), strict=True) if not out]
            kept.append(b" ".join(split).decode())
        return pa.record_batch([b.column(0), pa.array(per.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    # texts that surely lose nothing stay where they are; only the others move
    whole, touched = parted(docs, [F.col("doc_id"), F.xxhash64("text")], late.select("__id", "__key"), cut, columns)

    rows = touched.join(late, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__key")), "left").select("doc_id", "text", "starts")
    return whole.unionByName(rows.mapInArrow(lambda batches: (cut(b, b.column(2)) for b in batches), columns))
