"""Line dedup by a segment-partition edit join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import filter_bits, mix64, parted, small_batches, staged
from .shared import find_shared
from .tokens import SPACES, _hash, digests, slices, text_buffer

#: Lines within so many edits (code points) are near, if both have at least so many code points.
EDITS, LEAST_CHARS = 2, 20
#: Lists of a probe key up to so many lines are joined; longer ones are searched by their first line, then in blocks.
SHORT, BLOCK = 32, 512
_PIECE = 1 << 19
_LANES = 16
_BITS = (1 << 64) - 1
#: Code points up to which a line's match masks are made whole.
_SHORT = 2048


class _Powers:
    """1, m, m**2, ... modulo 2**64, grown as needed."""

    def __init__(self, m: int):
        self.m, self.table = np.uint64(m), np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if n > len(self.table):
            steps = np.full(max(n, 2 * len(self.table), 1 << 12), self.m, np.uint64)
            steps[0] = 1
            self.table = np.cumprod(steps, dtype=np.uint64)
        return self.table[:n]


#: Substrings of a line are hashed by differences of running sums; what meets there is verified on the texts.
_BYTE_UP, _BYTE_DOWN = _Powers(0x9E3779B97F4A7C15), _Powers(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def near(a: str, b: str, edits: int = EDITS) -> bool:
    """Whether a and b are within `edits` insertions, deletions and substitutions.

    What both begin and end with is left out; on the rest runs a bit-parallel edit distance (Myers) on a
    band of 64 diagonals that moves along (Hyyro), first down to the last row, then along it. Time grows with
    the lines' length, and memory doesn't.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > edits:
        return False
    lo, most = 0, len(b)
    while lo < most and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < most - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if len(a) <= edits:
        return True
    if edits == 0:
        return False
    start = edits - 63
    short = len(a) <= _SHORT
    if short:  # masks of the whole line are small, and quicker
        whole: dict[str, int] = {}
        for i, c in enumerate(a):
            whole[c] = whole.get(c, 0) | 1 << i
    else:  # a character's places within the band, as bits from where the band stood when it was last looked at
        where: dict[str, tuple[int, int]] = {}
        for i, c in enumerate(a[: edits + 1]):
            where[c] = (where.get(c, (0, start))[0] | 1 << (i - start), start)
    up, down = (_BITS << (63 - edits)) & _BITS, 0
    distance, row = edits, 1 << 62
    for i, c in enumerate(b):
        if short:
            bits = whole.get(c, 0)
            match = (bits >> start if start >= 0 else bits << -start) & _BITS
        else:
            bits, at = where.get(c, (0, start))
            match = bits >> (start - at) if start - at < 64 else 0
        zero = ((((match & up) + up) ^ up) | match | down) & _BITS
        h_up = (down | ~(zero | up)) & _BITS
        h_down = zero & up
        if i < len(a) - edits:
            distance += not zero >> 63
        else:
            distance += bool(h_up & row) - bool(h_down & row)
            row >>= 1
        up = (h_down | ~((zero >> 1) | h_up)) & _BITS
        down = (zero >> 1) & h_up
        start += 1
        if not short and start + 63 < len(a):  # the character that the band moves onto
            d = a[start + 63]
            bits, at = where.get(d, (0, start))
            where[d] = ((bits >> (start - at) if start - at < 64 else 0) | 1 << 63, start)
        if distance > 2 * edits + len(b) - i:
            return False
    return distance <= edits


class Lines:
    """The lines with a word of a batch of texts: text number, line number, 64-bit hash, and bytes from start to end.

    Equality is decided by a line's name, 128 bits of BLAKE2b; the hash finds candidates, which are verified.
    """

    def __init__(self, column):
        self.data, self.texts = text_buffer(column)
        breaks = np.flatnonzero(self.data == 10)
        n_breaks = np.searchsorted(breaks, self.texts)
        self.per_text = np.diff(n_breaks) + 1
        n_texts = len(self.texts) - 1
        cuts = np.sort(np.concatenate([self.texts[:-1], breaks + 1]), kind="stable")
        text = np.repeat(np.arange(n_texts), self.per_text)
        first = np.cumsum(self.per_text) - self.per_text
        number = np.arange(len(cuts)) - np.repeat(first, self.per_text)
        last = np.ones(len(cuts), bool)
        last[:-1] = text[1:] != text[:-1]
        end = np.empty(len(cuts), np.int64)
        end[:-1] = cuts[1:] - 1
        end[last] = self.texts[1:]
        # a stretch from the start of a line to that of the next line that isn't empty holds the line's bytes and line breaks only
        worded, some = end > cuts, np.flatnonzero(end > cuts)
        if len(some):
            worded[some] = np.logical_or.reduceat(~SPACES[self.data], cuts[some])
        self.text, self.number, self.start, self.end = text[worded], number[worded], cuts[worded], end[worded]
        self.hash = _hash(self.data, self.start, self.end)

    def names(self, some=slice(None)) -> list[bytes]:
        return digests(self.data, self.start[some], self.end[some])


def _segments(length: np.ndarray, parts: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the i-th of `parts` nearly equal segments, the later ones longer by one."""
    base, extra = length // parts, length % parts
    return i * base + np.maximum(0, i - (parts - extra)), base + (i >= parts - extra)


class Signatures:
    """Probe keys of lines that are long enough, and which of those are index keys.

    A line of length l is indexed by its EDITS + 1 segments. A line of length L probes each length l from L
    down to L - EDITS with the substrings at which a segment of a near line can lie: if i segments before
    it hold at least one edit each, it is shifted by i at most, seen from the left, and by EDITS - i from
    the right.
    """

    def __init__(self, lines: Lines, chosen: np.ndarray, edits: int, least: int):
        heads = np.zeros(len(lines.data) + 1, np.int64 if len(lines.data) >> 31 else np.int32)
        np.cumsum(lines.data.view(np.int8) >= -64, out=heads[1:])  # the bytes that begin a code point
        points = np.frombuffer(lines.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        start, end = heads[lines.start[chosen]].astype(np.int64), heads[lines.end[chosen]].astype(np.int64)
        ok = end - start >= least
        self.line, start, end = chosen[ok], start[ok], end[ok]
        self.length, self.start, self.points = end - start, start, points
        keys, index, of = [], [], []
        i = 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(start, start[i] + _PIECE)))
            lo, hi = int(start[i]), int(end[j - 1])
            piece = points[lo:hi]
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * _BYTE_UP(hi - lo), out=sums[1:])
            at, size = start[i:j] - lo, self.length[i:j]
            for short in range(edits + 1):
                length = size - short
                for s in range(edits + 1):
                    begin, width = _segments(length, edits + 1, s)
                    for shift in range(max(-s, short - (edits - s)), min(s, short + edits - s) + 1):
                        a = begin + shift
                        fits = np.flatnonzero((a >= 0) & (a + width <= size) & (length >= least))
                        b = at[fits] + a[fits]
                        h = (sums[b + width[fits]] - sums[b]) * _BYTE_DOWN(hi - lo + 1)[b]
                        keys.append(mix64(h + mix64(length[fits].astype(np.uint64) * np.uint64(64) + np.uint64(s))))
                        index.append(np.full(len(fits), short == 0 and shift == 0))
                        of.append(fits + i)
            i = j
        none = np.zeros(0, np.int64)
        self.key = np.concatenate(keys) if keys else none.astype(np.uint64)
        self.index = np.concatenate(index) if index else none.astype(bool)
        self.of = np.concatenate(of) if of else none

    def lanes(self, of: np.ndarray) -> np.ndarray:
        """Counts of code points by 16 classes, modulo 256, as two longs for each of the lines `of` (positions in self.line)."""
        own, back = np.unique(of, return_inverse=True)
        counts = np.zeros((len(own), _LANES), np.uint8)
        size = self.length[own]
        ends = np.cumsum(size)
        i = 0
        while i < len(own):  # lines of about _PIECE code points together
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _PIECE, "right")))
            n, mine = size[i:j], int(size[i:j].sum())
            at = np.arange(mine) + np.repeat(self.start[own[i:j]] - (np.cumsum(n) - n), n)
            lane = np.repeat(np.arange(j - i) * _LANES, n) + (self.points[at] & np.uint32(_LANES - 1))
            counts[i:j] = np.bincount(lane, minlength=_LANES * (j - i)).reshape(-1, _LANES) & 255
            i = j
        return counts.view(np.int64)[back].reshape(-1, 2)


def lanes_apart(a: list[Column], b: list[Column], edits: int) -> Column:
    """Whether the counts differ by too much: an edit changes them by 2 at most."""
    total = F.lit(0)
    for x, y in zip(a, b, strict=True):
        for lane in range(8):
            d = F.abs(F.shiftrightunsigned(x, 8 * lane).bitwiseAND(F.lit(255)) - F.shiftrightunsigned(y, 8 * lane).bitwiseAND(F.lit(255)))
            total = total + F.least(d, F.lit(256) - d)
    return total > 2 * edits


def lanes_differ(a: np.ndarray, b: np.ndarray, edits: int) -> np.ndarray:
    """lanes_apart for one line's counts (16 bytes) against many."""
    d = (a[None, :] - b).astype(np.uint8)
    return np.minimum(d, 0 - d).astype(np.int64).sum(1) > 2 * edits


def _signed(docs: DataFrame, edits: int, least: int) -> DataFrame:
    """(key, h, indexed, c0, c1): the probe keys of each distinct line, h by its hash, that another line has too.

    Which keys two lines have, a count over the corpus finds.
    """

    def fresh(lines: Lines, seen: set) -> np.ndarray:
        _, first = np.unique(lines.hash, return_index=True)
        if len(seen) > 100_000:  # a bounded memory of lines that this task had: a speed-up only
            seen.clear()
        new = [i for i in np.sort(first).tolist() if lines.hash[i] not in seen]
        seen.update(lines.hash[new].tolist())
        return np.array(new, np.int64)

    def keys(column):
        for part in slices(column):
            lines = Lines(part)
            yield Signatures(lines, fresh(lines, mine), edits, least).key

    mine: set = set()
    shared = find_shared(docs, keys)

    def post(batches):
        import pyarrow as pa

        seen: set = set()
        for b in (part for whole in batches for part in slices(whole, 0)):
            lines = Lines(b.column(0))
            s = Signatures(lines, fresh(lines, seen), edits, least)
            some = np.flatnonzero(shared(s.key))
            of = s.of[some]
            lanes = s.lanes(of)
            columns = [s.key[some].view(np.int64), lines.hash[s.line[of]].view(np.int64), s.index[some], lanes[:, 0], lanes[:, 1]]
            yield pa.record_batch([pa.array(x) for x in columns], ["key", "h", "indexed", "c0", "c1"])

    posts = docs.select("text").mapInArrow(post, "key long, h long, indexed boolean, c0 long, c1 long")
    return posts.groupBy("key", "h").agg(F.max("indexed").alias("indexed"), F.first("c0").alias("c0"), F.first("c1").alias("c1"))


def _texts_of(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """(h, name, line) of the lines ends(h); two lines of one hash are two rows."""
    keep = filter_bits(ends, "h", ends.count())

    def texts(batches):
        import pyarrow as pa

        for b in (part for whole in batches for part in slices(whole, 0)):
            lines = Lines(b.column(0))
            some = np.flatnonzero(keep(lines.hash))
            _, first = np.unique(lines.hash[some], return_index=True)
            some = some[first]
            out = [lines.data[x:y].tobytes().decode() for x, y in zip(lines.start[some], lines.end[some], strict=True)]
            yield pa.record_batch([pa.array(lines.hash[some].view(np.int64)), pa.array(lines.names(some), pa.binary()), pa.array(out, pa.string())], ["h", "name", "line"])

    found = docs.select("text").mapInArrow(texts, "h long, name binary, line string")
    return found.join(ends, "h", "left_semi").groupBy("h", "name").agg(F.first("line").alias("line"))


def _verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """(name): the later line of each of pairs(a, b) whose lines are within `edits` edits."""
    sides = [texts.select(F.col("h").alias(x), F.struct("name", "first").alias(f"at_{x}"), F.col("line").alias(f"line_{x}")) for x in "ab"]
    later = F.when(F.col("at_a.first") < F.col("at_b.first"), F.col("at_b.name")).otherwise(F.col("at_a.name"))
    full = pairs.join(sides[0], "a").join(sides[1], "b").select(later.alias("name"), "line_a", "line_b")

    def verify(batches):
        import pyarrow as pa

        for b in batches:
            ok = pa.array([near(x, y, edits) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)], pa.bool_())
            yield pa.record_batch([b.column(0).filter(ok)], ["name"])

    return full.mapInArrow(verify, "name binary")


def _searched(lists: DataFrame, late: DataFrame, texts: DataFrame, edits: int, block: int) -> DataFrame:
    """(name): those lines of long lists(key, h, name, first, ...) that are near an earlier line of their list, but aren't in `late` yet.

    A list's open lines and all its lines are dealt into blocks, and each open block meets each block in a
    task of its own, which yields a line at most once: rows grow with the list's length times its blocks,
    never with its pairs.
    """
    late = late.withColumn("late", F.lit(True))
    lists = staged(lists.join(late, "name", "left").withColumn("open", F.col("late").isNull()).drop("late"), "line-open")
    flag = F.xxhash64("name", "indexed")
    sizes = lists.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("open").cast("int")).alias("o"), F.sum(flag.cast("decimal(38,0)")).alias("f")).where("o > 0")
    # lists of the same lines are searched once
    sizes = sizes.groupBy("c", "o", "f").agg(F.min("key").alias("key"))
    part = lambda n: F.pmod(F.xxhash64("name"), F.ceil(F.col(n) / F.lit(block)).cast("long"))
    rows = lists.join(staged(sizes.select("key", "c", "o"), "line-sizes"), "key")
    query = rows.where("open").select("key", part("o").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("c") / F.lit(block)).cast("long") - 1)).alias("j"), F.lit(True).alias("asks"), "name", "indexed", "c0", "c1", "first")
    others = rows.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("o") / F.lit(block)).cast("long") - 1)).alias("i"), part("c").alias("j"), F.lit(False).alias("asks"), "name", "indexed", "c0", "c1", "first")
    # places compare as rank, so that Python needs no knowledge of their type
    full = query.unionByName(others).join(texts.select("name", "line"), "name").select("key", "i", "j", "asks", "name", "indexed", "c0", "c1", "first", "line")
    over = Window.partitionBy("key", "i", "j").orderBy("first")
    full = full.withColumn("rank", F.dense_rank().over(over)).drop("first")

    def search(key, table):
        import pyarrow as pa

        asks = table.column("asks").to_numpy()
        rank, indexed = table.column("rank").to_numpy(), table.column("indexed").to_numpy()
        lanes = np.stack([table.column(c).to_numpy() for c in ("c0", "c1")], 1).copy().view(np.uint8)
        names, lines = table.column("name").to_pylist(), table.column("line").to_pylist()
        mine = np.flatnonzero(~asks)
        found = []
        for q in np.flatnonzero(asks).tolist():
            able = mine[(rank[mine] < rank[q]) & (indexed[mine] | indexed[q])]
            able = able[~lanes_differ(lanes[q], lanes[able], edits)]
            if any(near(lines[q], lines[m], edits) for m in able.tolist()):
                found.append(names[q])
        return pa.table({"name": pa.array(found, pa.binary())})

    return full.groupBy("key", "i", "j").applyInArrow(search, "name binary").distinct()


def late_lines(docs: DataFrame, firsts: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS, short: int = SHORT, block: int = BLOCK) -> DataFrame:
    """(name) of the lines near a line whose first occurrence is earlier; firsts(name, h, first) has every line's.

    A distinct line posts those of its keys that another line has; an index and a probe key that meet make
    a candidate unless the lines' code point counts rule it out. Short lists are joined. A long one (a line
    of a template, say, with a number in it) is first searched against its first line only; what that
    leaves open is searched in blocks. Candidates are verified on their texts; nothing is capped.
    """
    posts = staged(_signed(docs, edits, least), "line-posts")
    met = posts.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    lists = staged(posts.join(met, "key"), "line-lists")
    close = ~lanes_apart([F.col("x.c0"), F.col("x.c1")], [F.col("y.c0"), F.col("y.c1")], edits)
    few = lists.where(F.col("c") <= short)
    pairs = few.where("indexed").alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.h") != F.col("y.h")) & close)
    pairs = pairs.select(F.least("x.h", "y.h").alias("a"), F.greatest("x.h", "y.h").alias("b"))
    many = lists.where(F.col("c") > short).drop("c")
    hot = bool(many.take(1))
    if hot:
        many = staged(many.join(firsts.select("h", "name", "first"), "h"), "line-long")
        least_of = lambda some, name: F.min(F.when(some, F.struct("first", "h", "c0", "c1"))).alias(name)
        star = staged(many.groupBy("key").agg(least_of(F.lit(True), "any"), least_of(F.col("indexed"), "ind")), "line-stars")
        met = many.join(star, "key")
        for name, some in (("ind", F.lit(True)), ("any", F.col("indexed"))):
            apart = lanes_apart([F.col("c0"), F.col("c1")], [F.col(f"{name}.c0"), F.col(f"{name}.c1")], edits)
            mine = met.where(some & F.col(name).isNotNull() & (F.col(f"{name}.h") != F.col("h")) & ~apart)
            pairs = pairs.unionByName(mine.select(F.least("h", f"{name}.h").alias("a"), F.greatest("h", f"{name}.h").alias("b")))
    pairs = staged(pairs.distinct(), "line-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("h"))
    ends = staged((ends.unionByName(many.select("h")) if hot else ends).distinct(), "line-ends")
    texts = staged(_texts_of(docs, ends).join(firsts.select("name", "first"), "name"), "line-texts")
    late = staged(_verified(pairs, texts, edits).distinct(), "line-late")
    return late.unionByName(_searched(many, late, texts, edits, block)).distinct() if hot else late


def _place(docs: DataFrame) -> Column:
    """What orders the lines of docs by (doc_id, number), a null doc_id last.

    Whole numbers are packed into one number, which a hash aggregate can take the minimum of: a long if the ids span
    less than 2**32, as numbers of lines have 31 bits, else a decimal; a struct, as for any other type of doc_id, would
    have all lines sorted by name first. The order is the same in each.
    """
    if docs.schema["doc_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("number"))
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    span = (high or 0) - (low or 0) + 1
    if span < (1 << 32) - 1:
        at = F.coalesce(F.col("doc_id").cast("long") - F.lit(low or 0).cast("long"), F.lit(span).cast("long"))
        return F.shiftleft(at, 31) + F.col("number").cast("long")
    number = F.col("number").cast("decimal(10,0)")
    last = F.lit("1" + 20 * "0").cast("decimal(21,0)")  # over any 64-bit number
    return (F.coalesce(F.col("doc_id").cast("decimal(21,0)"), last) * F.lit(1 << 31).cast("decimal(10,0)") + number).cast("decimal(32,0)")


def line_dedup(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS, short: int = SHORT, block: int = BLOCK) -> DataFrame:
    """Remove lines that equal, or are within `edits` edits of, an earlier line.

    docs needs doc_id and text; other columns are ignored. Lines are split at \\n; those without a word are
    left alone. Earlier is by (doc_id, line number), a null doc_id last. Two different lines are near if an
    edit distance in code points of `edits` or less parts them and both have `least` code points or more
    (short lines, in which two edits change most of a word or number, are only matched exactly; `least` can
    go down to edits + 1). All lines are judged on the input, so that a near chain may leave its first line only.

    Returns one row per input row: doc_id, n_lines (with a word), n_removed, n_near (of those, first
    occurrences near an earlier line), kept (the other lines joined by \\n). A null text has no lines and an
    empty kept; repeated rows (equal doc_id and text) fare alike; an empty table gives none.

    Equal lines meet by a 128-bit digest, pre-aggregated, so a line in every document costs one row a task.
    Only first occurrences are joined; see late_lines. Texts that lose nothing stay where they are.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def list_lines(batches):
        import pyarrow as pa

        for b in (part for whole in batches for part in slices(whole, 2)):
            lines = Lines(b.column(2))
            take = pa.array(lines.text)
            yield pa.record_batch([b.column(0).take(take), b.column(1).take(take), pa.array(lines.number.astype(np.int32)), pa.array(lines.names(), pa.binary()), pa.array(lines.hash.view(np.int64))], ["doc_id", "text_key", "number", "name", "h"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(list_lines, f"doc_id {id_type}, text_key long, number int, name binary, h long")
    rows = staged(rows, "lines")
    place = _place(docs)
    firsts = staged(rows.groupBy("name").agg(F.min("h").alias("h"), F.count(F.lit(1)).alias("rows"), F.min(place).alias("first")), "line-firsts")
    late = late_lines(docs, firsts, edits, least, short, block).withColumn("late", F.lit(True))
    # a line that occurs once and isn't late is no reason to remove anything
    heads = firsts.join(late, "name", "left").where("rows > 1 OR late")
    # staged, so that both sides of the next join are read from a shuffle and a line in every document can be split
    heads = staged(heads.select(F.col("name").alias("__name"), "first", F.coalesce("late", F.lit(False)).alias("late")), "line-heads")
    gone = rows.drop("h").join(heads, F.col("name") == F.col("__name")).withColumn("again", place != F.col("first")).where("again OR late")
    gone = gone.groupBy("doc_id", "text_key").agg(F.collect_set("number").alias("gone"), F.countDistinct(F.when(~F.col("again"), F.col("number"))).alias("n_near"))
    gone = staged(gone.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "gone", "n_near"), "line-gone")

    def cut(b, lists=None):
        import pyarrow as pa
        import pyarrow.compute as pc

        kept, n_lines, n_removed = [], [], []
        for text, gone in zip(b.column(1).cast(pa.binary()).to_pylist(), lists or [None] * b.num_rows, strict=True):
            split = (text or b"").split(b"\n")
            n_lines.append(sum(not x.isspace() for x in split if x))
            n_removed.append(len(gone or ()))
            if lists:
                out = set(gone or ())
                kept.append(b"\n".join([x for i, x in enumerate(split) if i not in out]) if gone else text or b"")
        near_ = b.column(3) if lists else pa.array(np.zeros(b.num_rows, np.int64))
        kept = pa.array(kept, pa.binary()).cast(pa.string()) if lists else pc.fill_null(b.column(1), "")
        return pa.record_batch([b.column(0), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), near_, kept], ["doc_id", "n_lines", "n_removed", "n_near", "kept"])

    columns = f"doc_id {id_type}, n_lines long, n_removed long, n_near long, kept string"
    whole, touched = parted(docs, [F.col("doc_id"), F.xxhash64("text")], gone.select("__id", "__key"), cut, columns)
    # merged, not broadcast, at any size: what is gone grows with the corpus, and texts then meet Python once a task
    touched = touched.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key")), "left").select("doc_id", "text", "gone", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
    return whole.unionByName(touched.mapInArrow(lambda batches: (cut(b, b.column(2).to_pylist()) for b in batches), columns))
