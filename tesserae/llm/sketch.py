"""Document fingerprints: bottom-k sketches of word shingle hashes.

A sketch holds the k smallest distinct 64-bit hashes of a text's 3-word
shingles (of the whole sequence, if it has fewer words). Sketches of parts merge
to the sketch of the whole; two of them estimate resemblance and containment,
one the number of distinct shingles. A text with fewer than k shingles is
sketched exactly.

Defined results: null and empty texts, and those without a word, have an empty
sketch (fingerprint ""); two empty sketches are alike (1), an empty and another
are not (0); equal texts have equal fingerprints; rows that share a doc_id are
ordered by text (null first), a null doc_id comes after all others; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import checkpoint, small_side
from ._words import mix64, slices, text_array, words

K = 128
#: Documents of one group of ``fingerprint_neighbours`` share doc_id >> BLOCK_BITS.
BLOCK_BITS = 10
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, containment_next double"
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, and where each text's begin (n + 1)."""
    w = words(texts)
    h, n = w.hashes(), w.counts
    count = np.where(n >= 3, n - 2, np.minimum(n, 1))
    offs = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(w.first[:-1] - offs[:-1], count) + np.arange(offs[-1])
    out = mix64(h[at] * _A + np.uint64(1)) if len(h) else np.zeros(0, np.uint64)
    size = np.repeat(np.minimum(n, 3), count)
    for k, factor in ((1, _B), (2, _C)):
        more = np.flatnonzero(size > k)
        out[more] = mix64(out[more] * factor + h[at[more] + k])
    return out, offs


def sketches(texts: pa.Array, k: int = K) -> list[np.ndarray]:
    h, offs = shingle_hashes(texts)
    return [np.unique(h[a:b])[:k] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]


def merge(parts: Iterable[np.ndarray], k: int = K) -> np.ndarray:
    parts = [*parts]
    return np.unique(np.concatenate(parts))[:k] if parts else np.zeros(0, np.uint64)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of the shingle sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    first = np.concatenate([[True], ~twice])
    low = both[first][:k]
    return float(np.count_nonzero(both[1:][twice] <= low[-1]) / len(low))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a) or not len(b):
        return float(not len(a))
    j, na, nb = resemblance(a, b, k), distinct(a, k), distinct(b, k)
    return min(1.0, j * (na + nb) / (1 + j) / na)


def encode(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def decode(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), "<u8").astype(np.uint64)


def edit(text: str, following: str) -> str:
    """``text`` with its last half replaced by the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _neighbours(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows in order, each block followed by a ``copy`` of the row after its last; what a block needs is at most the row before."""
    last: pa.Table | None = None
    for batch in batches:
        for rows, _ in slices(batch):
            now = pa.Table.from_batches([rows])
            now = now if last is None else pa.concat_tables([last, now])
            last = now.slice(now.num_rows - 1).combine_chunks()
            own = [i for i, copy in enumerate(now["copy"].to_pylist()[:-1]) if not copy]
            if not own:
                continue
            texts = [t or "" for t in now["text"].to_pylist()]
            edited = [edit(texts[i], texts[i + 1]) for i in own]
            coded = [e.encode() for e in edited]
            old = sketches(text_array(now["text"]), k)
            new = sketches(pa.array(coded, pa.large_binary()), k)
            here, after = [old[i] for i in own], [old[i + 1] for i in own]
            columns = [
                now["doc_id"].take(own).combine_chunks(),
                pa.array([len(texts[i]) for i in own], pa.int64()),
                pa.array([hashlib.sha256(c).hexdigest() for c in coded]),
                pa.array([encode(a) for a in here]),
                pa.array([encode(a) for a in new]),
                pa.array([resemblance(a, b, k) for a, b in zip(here, new)]),
                pa.array([resemblance(a, b, k) for a, b in zip(here, after)]),
                pa.array([distinct(a, k) for a in here]),
                pa.array([containment(a, b, k) for a, b in zip(here, after)]),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])


def _targets(tops: DataFrame) -> DataFrame:
    """For each block, the one whose last row its first row follows: the next larger, and after the largest the least.

    Blocks are put in order a thousand at a time, so that what one task orders is
    a row for a million ids.
    """
    tops = checkpoint(tops.withColumn("above", F.shiftright("block", BLOCK_BITS)))
    lows = tops.groupBy("above").agg(F.min("block").alias("low"))
    order = Window.orderBy("above")
    following = F.coalesce(F.lead("low").over(order), F.first("low").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    lows = small_side(checkpoint(lows.select(F.col("above").alias("a"), following.alias("following"))), 16)
    inner = F.lead("block").over(Window.partitionBy("above").orderBy("block"))
    return tops.withColumn("inner", inner).join(lows, F.col("above") == F.col("a")).select("block", "top", F.coalesce("inner", "following").alias("target"))


def fingerprint_neighbours(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every document and of its text edited with the next one's, by descending doc_id, cyclically.

    Blocks of neighbouring ids are exchanged, sorted by Spark and read as a
    stream, of which one row more than a slice is held. What a block lacks is the
    document after its last: the first of the block below, copied to it. One
    row per block finds those; only they are joined. Rows that share a doc_id are
    one ordered run, which one task reads, in a stream.
    """
    key = F.shiftright(F.coalesce(F.col("doc_id"), F.lit(-(2**63))), BLOCK_BITS)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("block", key)
    tops = small_side(checkpoint(_targets(docs.groupBy("block").agg(F.max("doc_id").alias("top")))), 32)
    ends = docs.join(tops.withColumnRenamed("block", "b"), F.col("doc_id").eqNullSafe(F.col("top")) & (F.col("block") == F.col("b")))
    # Of rows that share the id, the first.
    ends = ends.groupBy("doc_id", "target").agg(F.min(F.struct(F.col("text").isNotNull().alias("has"), "text")).alias("least"))
    ends = ends.select("doc_id", F.col("least.text").alias("text"), F.col("target").alias("block"), F.lit(1).alias("copy"))
    rows = docs.select("doc_id", "text", "block", F.lit(0).alias("copy")).unionAll(ends)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "block").sortWithinPartitions("block", "copy", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    return rows.mapInArrow(lambda batches: _neighbours(batches, k), SCHEMA)
