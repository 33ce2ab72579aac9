"""Vectorised word handling on Arrow batches, shared by the text operators.

A word is a maximal run of bytes other than space and U+0009..U+000D. Those
are ASCII, so working on UTF-8 bytes gives the same words as on code points.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes handled at once by the numpy kernels; a longer single text goes alone.
SLICE_BYTES = 2 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
IS_CHAR = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_array(col: pa.Array) -> pa.Array:
    """The column as non-null 64-bit-offset binary."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        return pa.array([b""] * len(col), pa.large_binary())
    col = col.cast(pa.large_string()) if pa.types.is_string(col.type) else col
    col = pc.cast(col, pa.large_binary())
    return pc.fill_null(col, b"") if col.null_count else col


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0 with one more entry than texts), without a copy."""
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def byte_list(col: pa.Array) -> list[bytes]:
    """The values of a large binary or string array; much faster than through Arrow scalars."""
    buf, offs = raw(col)
    data, at = buf.tobytes(), offs.tolist()
    return [data[a:b] for a, b in zip(at, at[1:])]


def slices(batch: pa.RecordBatch | pa.Table, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut a batch, without copies, into (rows, their texts) of at most ``most`` text bytes, one row at least."""
    texts = text_array(batch[column] if isinstance(batch, pa.Table) else batch.column(column))
    _, offs = raw(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, to - at), texts.slice(at, to - at)
        at = to


@dataclass
class Words:
    """Words of several texts in a row."""

    buf: np.ndarray  #: bytes of all texts
    docs: np.ndarray  #: byte offsets of the texts, n + 1
    begin: np.ndarray  #: byte offset of each word
    end: np.ndarray
    first: np.ndarray  #: index of each text's first word, n + 1

    def __len__(self) -> int:
        return len(self.begin)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def packed(self) -> pa.Array:
        """The words as one Arrow binary array."""
        inside = ~IS_SPACE[self.buf]
        offs = np.zeros(len(self) + 1, np.int64)
        np.cumsum(self.end - self.begin, out=offs[1:])
        return pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(offs), pa.py_buffer(self.buf[inside])])

    def ids(self) -> tuple[np.ndarray, pa.Array]:
        """Exact ids within these texts, and the distinct words that they index."""
        if not len(self):
            return np.zeros(0, np.int64), pa.array([], pa.large_binary())
        d = self.packed().dictionary_encode()
        return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary

    def hashes(self) -> np.ndarray:
        """XXH64 of each word."""
        ids, distinct = self.ids()
        return hash_all(distinct)[ids] if len(ids) else np.zeros(0, np.uint64)


def hash_all(distinct: pa.Array) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w) for w in byte_list(distinct)), np.uint64, len(distinct))


def words(texts: pa.Array, lower: bool = False) -> Words:
    buf, docs = raw(texts)
    if lower:
        buf = LOWER[buf]
    n = len(buf)
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(IS_SPACE[buf], out=inside[1:-1])
    here, before = inside[1:-1], inside[:-2]
    begins = here & ~before
    ends = here & ~inside[2:]
    if n:
        edge = docs[:-1][(docs[:-1] < n)]
        begins[edge] = here[edge]
        last = docs[1:][docs[1:] > 0] - 1
        ends[last] = here[last]
    begin = np.flatnonzero(begins)
    return Words(buf, docs, begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, docs))


def per_doc(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over each [offs[i], offs[i + 1])."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def code_points(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return per_doc(IS_CHAR[buf], offs)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
