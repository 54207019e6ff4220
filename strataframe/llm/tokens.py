"""Vectorised words of Arrow text columns: boundaries and 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

from .common import mix64

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: What keeps the low bytes of eight, by how many are left.
_LOW = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)
#: Stretches of more bytes are named by a cryptographic hash.
_LANES = 128

#: Byte classes. SPACES: word separators are space and \t to \r. NOT_ALNUM: every ASCII byte but 0-9, A-Z, a-z.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = [not chr(i).isalnum() for i in range(128)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """The words of a batch of texts: hash, first byte, end byte; text i has words[at[i]:at[i + 1]]."""

    data: np.ndarray
    texts: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray
    hash: np.ndarray

    def text_bytes(self, i: int) -> bytes:
        return self.data[self.texts[i] : self.texts[i + 1]].tobytes()


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array, and len + 1 offsets; null is as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batch, column: int | None = None, most: int = 1 << 21):
    """The rows of an Arrow batch in slices of about `most` bytes of text in a column, a row at least: what a worker holds then doesn't grow with the batch.

    Without a column, `batch` is the column of texts itself.
    """
    import pyarrow.compute as pc

    texts = batch if column is None else batch.column(column)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    before = np.r_[0, np.cumsum(sizes)]
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(before, before[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(column, lower: bool = False, separators: np.ndarray = SPACES, hashes: bool = True) -> Words:
    data, texts = text_buffer(column)
    if lower:
        data = LOWER[data]
    inside = ~separators[data]
    n = len(data)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = texts[:-1][texts[:-1] < n]
    first[begins] = inside[begins]
    start = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    closes = texts[1:][texts[1:] > 0] - 1
    last[closes] = inside[closes]
    end = np.flatnonzero(last) + 1
    at = np.searchsorted(start, texts)
    return Words(data, texts, start, end, at, _hash(data, start, end) if hashes else np.zeros(0, np.uint64))


def _hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes: eight bytes at a time, each mixed in by a bijection that isn't linear.

    Stretches of up to eight bytes and one length never collide; long ones take the first half of a BLAKE2b.
    """
    size = end - start
    out = mix64(size.astype(np.uint64) * _A + np.uint64(seed))
    eights = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    some, at = np.flatnonzero(size <= _LANES), 0
    while len(some):
        if at:
            some = some[size[some] > at]
        out[some] = mix64(out[some] ^ (eights[start[some] + at] & _LOW[np.minimum(size[some] - at, 8)]))
        at += 8
    for i in np.flatnonzero(size > _LANES).tolist():
        raw = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        out[i] = int.from_bytes(raw, "little")
    return out


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    """A 128-bit BLAKE2b of each stretch of bytes: equal digests stand for equal bytes."""
    raw = data.tobytes()
    return [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix64(left * _B + right)


def windows(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A hash of every k consecutive hashes (len - k + 1 of them), in about 2 log2 k passes.

    Hashes of 1, 2, 4, ... consecutive ones are joined in pairs, by a step that isn't linear: no arrangement
    of repeated words cancels out, as it can in a polynomial modulo 2**64.
    """
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, size = (mix64(hashes ^ np.uint64(salt)) if salt else hashes), 1
    out, done = None, 0
    while True:
        if k & size:
            out, done = (power if out is None else _join(out[:n], power[done : done + n])), done + size
        if done == k:
            return mix64(out[:n] + np.uint64(k))
        power, size = _join(power[:-size], power[size:]), 2 * size


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence if it is shorter; none of nothing."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return np.unique(windows(hashes, min(k, len(hashes))))
