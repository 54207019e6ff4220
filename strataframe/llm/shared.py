"""Which keys (shingles, symbols) occur in two documents or more, over the whole corpus, in four bytes a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BitFilter, filters_of, power_of_two, staged

#: Keys are gathered from about so many keys before they are packed.
_FLUSH = 500_000
#: How often one task counts a key at most; enough for the classes below, and a bound on what a hot key sends.
_PER_FLUSH = 4


class SharedKeys:
    """Classes of 64-bit keys: 0 surely occurs in one document only; higher classes occur more often.

    A class is a function of the key and the corpus alone, so it may serve as a global order. It is held
    in filters of bounded size (BitFilter); when those fill up, rare keys may be put too high, never too low.
    """

    def __init__(self, shift: int, filters: list[BitFilter]):
        self.shift, self.filters = shift, filters

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        tok = keys >> np.uint64(self.shift)
        out = np.zeros(len(keys), np.uint8)
        for i, f in enumerate(self.filters):
            some = np.flatnonzero(out == i) if i else slice(None)
            out[some] += f(tok[some])
        return out


def find_shared(docs: DataFrame, keys_of: Callable[[object], Iterator[np.ndarray]], levels: tuple[int, ...] = (2,)) -> SharedKeys:
    """SharedKeys with one class for each of `levels` (counts of documents).

    keys_of takes an Arrow column of texts and yields each document's distinct keys. Each task sorts its
    keys and sends, for each range of keys, one block of four-byte remainders; each range is counted by
    itself. A task sends a key up to _PER_FLUSH times per flush, so a key that is in every document is no
    hot spot; every document counts, and a count under the cap is exact.
    """
    spark = docs.sparkSession
    buckets = power_of_two(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 256, 1 << 20)
    kb = buckets.bit_length() - 1
    shift = 32 - kb

    def pack(held: list[np.ndarray]):
        import pyarrow as pa

        tok, n = np.unique(np.concatenate(held) >> np.uint64(shift), return_counts=True)
        tok = np.repeat(tok, np.minimum(n, _PER_FLUSH))
        bucket = (tok >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        low = tok.astype(np.uint32)
        ends = np.r_[cuts[1:], len(tok)]
        return pa.record_batch([pa.array(bucket[cuts]), pa.array([low[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())], ["bucket", "low"])

    def blocks(batches):
        held, n = [], 0
        for b in batches:
            for keys in keys_of(b.column(0)):
                if len(keys):
                    held.append(keys)
                    n += len(keys)
                if n >= _FLUSH:
                    yield pack(held)
                    held, n = [], 0
        if held:
            yield pack(held)

    def count(key, table):
        import pyarrow as pa

        low, n = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("low")]), return_counts=True)
        often = n >= levels[0]
        tok = (np.uint64(key[0].as_py()) << np.uint64(32)) | low[often].astype(np.uint64)
        return pa.table({"tok": pa.array(tok.view(np.int64)), "level": pa.array(np.searchsorted(levels, n[often], "right").astype(np.int32))})

    packed = docs.select("text").mapInArrow(blocks, "bucket long, low binary")
    shared = staged(packed.groupBy("bucket").applyInArrow(count, "tok long, level int"), "shared")
    sizes = {r["level"]: r["n"] for r in shared.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    return SharedKeys(shift, filters_of(shared, "tok", [sum(n for k, n in sizes.items() if k > i) for i in range(len(levels))]))
