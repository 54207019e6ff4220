"""Benchmark decontamination: a broadcast hash set of test n-grams against every training token window."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_bits, small_batches, staged, unused, with_fields
from .tokens import NOT_ALNUM, slices, windows, words

#: The words of a text, as a pattern.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A benchmark of up to so many words is broadcast as a hash set; windows of a larger one meet the documents' by a join.
BLOCK_WORDS = 200_000


class Block:
    """The normalised n-grams of some items: sorted hashes by length, the words of each, and its items."""

    def __init__(self, n: int):
        self.n, self.ids, self.grams = n, [], {}

    def add(self, item_id: str, item: list[bytes]) -> None:
        size = min(self.n, len(item))
        if size:
            k = len(self.ids)
            self.ids.append(item_id)
            for i in range(len(item) - size + 1):
                self.grams.setdefault((size, b" ".join(item[i : i + size])), set()).add(k)

    def close(self) -> Block:
        self.by_size = {}
        for size in sorted({s for s, _ in self.grams}):
            texts = [t for s, t in self.grams if s == size]
            h = gram_hashes(texts, size)
            order = np.argsort(h, kind="stable")
            self.by_size[size] = (h[order], [texts[i] for i in order])
        return self


def gram_hashes(texts: list[bytes], size: int) -> np.ndarray:
    import pyarrow as pa

    w = words(pa.array([t.decode() for t in texts], pa.string()), True, NOT_ALNUM)
    return windows(w.hash, size)[w.at[:-1]]


def item_words(text: str | None) -> list[bytes]:
    import pyarrow as pa

    w = words(pa.array([text or ""], pa.string()), True, NOT_ALNUM, hashes=False)
    return [w.data[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]


def item_grams(benchmark: DataFrame, n: int) -> DataFrame:
    """(item_id, size, h, name) of each n-gram of each item, once an item: its hash and 128 bits of its words; made in tasks, item by item."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for item_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                item = item_words(text)
                size = min(n, len(item))
                grams = sorted({b" ".join(item[i : i + size]) for i in range(len(item) - size + 1)}) if size else []
                for i in range(0, len(grams), 10_000):
                    part = grams[i : i + 10_000]
                    k = len(part)
                    names = [hashlib.blake2b(g, digest_size=16).digest() for g in part]
                    yield pa.record_batch([pa.array([item_id or ""] * k), pa.array([size] * k, pa.int32()), pa.array(gram_hashes(part, size).view(np.int64)), pa.array(names, pa.binary())], ["item_id", "size", "h", "name"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(run, "item_id string, size int, h long, name binary")


def joined_hits(docs: DataFrame, benchmark: DataFrame, n: int, row: str) -> DataFrame:
    """(row, at, items): where windows of docs(row, text) are benchmark n-grams, for a benchmark of any size.

    at: array of struct first word, length; items: sorted distinct item_ids. A bit filter of bounded size lets through
    the windows whose hash a gram may have; these meet the grams by hash and name, so neither side is held whole anywhere.
    Which windows are hit, and which items a document holds, are found apart, so that a gram of very many items
    is not multiplied by the windows that have it.
    """
    grams = staged(item_grams(benchmark, n), "bench-grams")
    known = staged(grams.select("size", "h", "name").distinct(), "bench-names")
    keep = filter_bits(known, "h", known.count())
    sizes = sorted(r[0] for r in known.select("size").distinct().collect())

    def run(batches):
        import pyarrow as pa

        for b in (part for whole in batches for part in slices(whole, 1)):
            w = words(b.column(1), True, NOT_ALNUM)
            rows = b.column(0)
            for size in sizes:
                h = windows(w.hash, size)
                some = np.flatnonzero(keep(h.view(np.int64)))
                text = np.searchsorted(w.at, some, "right") - 1
                inside = some + size <= w.at[text + 1]
                some, text = some[inside], text[inside]
                names = [hashlib.blake2b(b" ".join(w.data[x:y].tobytes() for x, y in zip(w.start[i : i + size], w.end[i : i + size], strict=True)), digest_size=16).digest() for i in some.tolist()]
                k = len(some)
                yield pa.record_batch([rows.take(pa.array(text)), pa.array((some - w.at[text]).astype(np.int64)), pa.array(np.full(k, size, np.int32)), pa.array(h[some].view(np.int64)), pa.array(names, pa.binary())], ["row", "at", "size", "h", "name"])

    found = docs.select(row, "text").mapInArrow(run, "row long, at long, size int, h long, name binary")
    hits = staged(found.join(known, ["size", "h", "name"]), "bench-hits")
    at = hits.groupBy("row").agg(F.collect_set(F.struct("at", "size")).alias("at"))
    items = hits.select("row", "size", "h", "name").distinct().join(grams, ["size", "h", "name"]).select("row", "item_id").distinct()
    items = items.groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    return staged(at.join(items, "row").select(F.col("row").alias("__hit_row"), "at", "items"), "bench-found")


def hits_of(w, block: Block):
    """(text, first word, length, item numbers) of each verified occurrence of the block's n-grams."""
    for size, (hashes, texts) in block.by_size.items():
        h = windows(w.hash, size)
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        for i in np.flatnonzero(hashes[at] == h).tolist():
            text = int(np.searchsorted(w.at, i, "right")) - 1
            if i + size > w.at[text + 1]:
                continue
            gram = b" ".join(w.data[a:b].tobytes() for a, b in zip(w.start[i : i + size], w.end[i : i + size], strict=True))
            j = int(at[i])
            while j < len(hashes) and hashes[j] == h[i]:  # the words decide, not the hash
                if texts[j] == gram:
                    yield text, i, size, block.grams[size, gram]
                j += 1


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_words: int = BLOCK_WORDS, prefix: str = "__") -> DataFrame:
    """Where documents hold n-word windows of benchmark items.

    docs needs doc_id and text, benchmark item_id and text. Words are runs of anything but ASCII that is no
    letter or digit, A-Z lower-cased; an item of fewer than n words, but not none, is one window. All of
    docs' columns return (names of their own that clash are replaced), with __n_words, __n_hit (words inside
    a window's occurrence), __items (sorted distinct item_ids) and __spans (array<struct<start,end>>: bytes
    of the UTF-8 text from the first to past the last word of each stretch of hit words); prefix goes before
    these names.

    Null and empty texts have no words and no hits; items with a null item_id count under an empty one;
    equal items under their own ids; an empty benchmark hits nothing; empty docs give none.

    A benchmark of up to block_words words is broadcast as a hash set, and documents are scanned once and never
    shuffled. Of a larger one the windows are made in tasks and meet the documents' windows by a join (see joined_hits); docs
    are staged with a number for each row then. Which way is taken changes no result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    added = [prefix + c for c in ("n_words", "n_hit", "items", "spans")]
    docs = docs.drop(*added)
    schema = with_fields(docs.schema, "`{}` long, `{}` long, `{}` array<string>, `{}` array<struct<start:long,end:long>>".format(*added))
    text_at = docs.columns.index("text")
    size = benchmark.select(F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORDS)), F.lit(0)).cast("long").alias("n")).agg(F.sum("n")).first()[0] or 0
    if size > block_words:
        row = unused("__row", docs)
        numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "bench-docs")
        hits = joined_hits(numbered, benchmark, n, row)
        both = numbered.join(hits, F.col(row) == F.col("__hit_row"), "left").select(*[F.col(f"`{c}`") for c in docs.columns], "at", "items")
        width = len(docs.columns)

        def read(batches):
            for b in (part for whole in batches for part in slices(whole, text_at)):
                w = words(b.column(text_at), True, NOT_ALNUM, hashes=False)
                steps = np.zeros(len(w.start) + 1, np.int64)
                for i, at in enumerate(b.column(width).to_pylist()):
                    for x in at or ():
                        steps[w.at[i] + x["at"]] += 1
                        steps[w.at[i] + x["at"] + x["size"]] -= 1
                yield _found(b.columns[:width], b.schema.names[:width], w, steps, [x or [] for x in b.column(width + 1).to_pylist()], added)

        return both.mapInArrow(read, schema)

    block = Block(n)
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("text IS NOT NULL").collect():
        block.add(row[0] or "", item_words(row[1]))
    shared = spark.sparkContext.broadcast(block.close())

    def scan(batches):
        block = shared.value
        for b in (part for whole in batches for part in slices(whole, text_at)):
            w = words(b.column(text_at), True, NOT_ALNUM)
            steps = np.zeros(len(w.start) + 1, np.int64)
            items: list[set] = [set() for _ in range(b.num_rows)]
            for text, i, size, found in hits_of(w, block):
                steps[i] += 1
                steps[i + size] -= 1
                items[text].update(block.ids[k] for k in found)
            yield _found(b.columns, b.schema.names, w, steps, [sorted(x) for x in items], added)

    return docs.mapInArrow(scan, schema)


def _found(columns, names, w, steps: np.ndarray, items: list[list[str]], added: list[str]):
    """A batch with its counts, items and spans; steps rise where a hit window begins and fall where it has ended."""
    import pyarrow as pa

    hit = np.cumsum(steps)[:-1] > 0
    sums = np.r_[0, np.cumsum(hit)]
    spans = []
    for i in range(len(w.at) - 1):
        lo, hi = w.at[i], w.at[i + 1]
        mine = []
        if sums[hi] > sums[lo]:
            edge = np.diff(np.r_[0, hit[lo:hi].astype(np.int8), 0])
            begin, end = np.flatnonzero(edge == 1) + lo, np.flatnonzero(edge == -1) + lo - 1
            mine = [{"start": int(w.start[x] - w.texts[i]), "end": int(w.end[y] - w.texts[i])} for x, y in zip(begin, end, strict=True)]
        spans.append(mine)
    out = [
        pa.array(np.diff(w.at).astype(np.int64)),
        pa.array((sums[w.at[1:]] - sums[w.at[:-1]]).astype(np.int64)),
        pa.array(items, pa.list_(pa.string())),
        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
    return pa.RecordBatch.from_arrays([*columns, *out], [*names, *added])


def own_prefix(docs: DataFrame) -> str:
    """A prefix that no column of docs begins with."""
    prefix = "__"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, most: int = 0) -> DataFrame:
    """The documents with at most `most` hit words, with the columns of docs.

    Null and empty texts stay, repeated rows fare alike, columns of any names (the operator's own too) return
    unchanged, an empty table gives none, and an empty benchmark removes nothing.
    """
    prefix = own_prefix(docs)
    found = find_contamination(docs, benchmark, n, prefix=prefix)
    return found.where(F.col(prefix + "n_hit") <= most).select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, mark: str = " ") -> DataFrame:
    """Every document, with each stretch of hit words in its text replaced by `mark`.

    Null and empty texts are left as they are; otherwise as remove_documents.
    """
    prefix = own_prefix(docs)
    found = find_contamination(docs, benchmark, n, prefix=prefix)
    text_at, spans_at = found.columns.index("text"), found.columns.index(prefix + "spans")

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            texts = []
            for text, spans in zip(b.column(text_at).to_pylist(), b.column(spans_at).to_pylist(), strict=True):
                if spans:
                    raw, parts, at = text.encode(), [], 0
                    for s in spans:
                        parts.append(raw[at : s["start"]])
                        at = s["end"]
                    text = mark.encode().join([*parts, raw[at:]]).decode()
                texts.append(text)
            columns = list(b.columns)
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return found.mapInArrow(cut, found.schema).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """Counts, and the hash of the items' ids, comma-joined."""
    ids = F.array_join("__items", ",")
    n = F.col("__n_hit")
    return found.select("doc_id", F.col("__n_words").alias("n_words"), n.alias("n_hit"), F.size("__items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n > 0).alias("contaminated"))


def items_hash(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
