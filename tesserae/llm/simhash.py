"""SimHash near-duplicates by tiled exact comparison.

Fingerprints that differ in at most 3 of 64 bits agree wholly in one of four
16-bit blocks, and on the other 48 bits in one of four 12-bit sub-blocks. So
every linked pair of distinct fingerprints shares one of 16 keys, and nothing is
lost by comparing only within keys: in tiles, by numpy exclusive-or and bit
counts, tiles ordered by population count and tile pairs skipped that differ in
it beyond the radius. Equal fingerprints are one row from the start, so copies
cost nothing.

A key leaves 36 bits free. If more than ``HOT`` fingerprints have it, they get four
longer keys instead, of a quarter of the free bits each: a pair within the radius
agrees in one of them too. After four such steps 12 bits are free at most, so no key has
more than 4,096 fingerprints, however many rows there are, and a fingerprint has at
most 4,096 keys. A pair counts in one place: under the first of the keys that it
shares at each step.

Links are counted, not listed: a task returns each fingerprint's number of linked documents,
and a spanning forest of its links, from which components follow.

Defined results: texts without words (null, empty) have fingerprint 0 and are
linked to each other and to other fingerprints near 0; repeated rows count as
documents of their own; a null doc_id is no component's name unless all its
members' are null; extra columns are ignored by ``groups`` and kept by
``representatives``; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import checkpoint, free_name, small_side
from ._words import mix64, slices, words
from .components import components

RADIUS = 3
HOT = 4096
TILE = 1024
STEPS = 4
#: Rows that a task compares, about.
ROWS = 500_000


def _rest(i: int, j: int) -> int:
    """Mask of block i and of sub-block j of the other 48 bits."""
    others = [b for k in range(4) if k != i for b in range(16 * k, 16 * k + 16)]
    return (0xFFFF << (16 * i)) | sum(1 << b for b in others[12 * j : 12 * j + 12])


MASKS = np.array([_rest(i, j) for i in range(4) for j in range(4)], np.uint64)


@lru_cache(maxsize=None)
def longer(mask: int) -> np.ndarray:
    """The mask with a quarter of its free bits more, four times."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [k * len(free) // 4 for k in range(5)]
    return np.array([mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:])], np.uint64)


def steps(path: int) -> list[tuple[np.ndarray, int]]:
    """Of a key's path, the masks at each step and the one taken. path: number of the first mask, then two bits a step, their count on top."""
    depth, taken = path >> 12, path & 15
    out = [(MASKS, taken)]
    for k in range(depth):
        masks = longer(int(out[-1][0][out[-1][1]]))
        out.append((masks, path >> (4 + 2 * k) & 3))
    return out


def fingerprints(texts: pa.Array) -> np.ndarray:
    """SimHash of each text's 3-word shingles (XXH64, seed 42; A-Z lower-cased)."""
    w = words(texts, lower=True)
    out = np.zeros(len(texts), np.uint64)
    size = w.end - w.begin
    joined = np.full(int(size.sum()) + len(size), 32, np.uint8)
    at = np.cumsum(size + 1) - size - 1
    if len(size):
        ends = np.cumsum(size)
        joined[np.repeat(at - ends + size, size) + np.arange(ends[-1])] = w.buf[np.repeat(w.begin - ends + size, size) + np.arange(ends[-1])]
    data = joined.tobytes()
    digest = xxhash.xxh64_intdigest
    first, stop = w.first.tolist(), at + size
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        n = b - a
        if not n:
            continue
        k = min(n, 3)
        h = np.array([digest(data[p:q], 42) for p, q in zip(at[a : b - k + 1].tolist(), stop[a + k - 1 : b].tolist())], np.uint64)
        ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]
    return out


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every document, fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(fingerprints(texts).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _keyed(fp: np.ndarray, masks: np.ndarray, path: np.ndarray) -> np.ndarray:
    """A key of each fingerprint for each mask, as (n, masks) signed longs: the masked bits, mixed with the mask's path."""
    return np.stack([mix64((fp & m) + np.uint64((int(k) + 1) * 0x9E3779B97F4A7C15 % 2**64)) for m, k in zip(masks, path)], 1).view(np.int64)


def _rows(key: np.ndarray, path: np.ndarray, fp: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    width = key.shape[1]
    return pa.RecordBatch.from_arrays([pa.array(key.reshape(-1)), pa.array(np.tile(path.astype(np.int32), len(fp))), pa.array(np.repeat(fp, width).view(np.int64)), pa.array(np.repeat(n, width))], ["key", "path", "fp", "n"])


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        path = np.arange(16)
        yield _rows(_keyed(fp, MASKS, path), path, fp, batch.column("n").to_numpy())


def _deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Four longer keys for each."""
    for batch in batches:
        path, fp, n = batch.column("path").to_numpy(), batch.column("fp").to_numpy().view(np.uint64), batch.column("n").to_numpy()
        for k in np.unique(path).tolist():
            own = path == k
            masks, taken = steps(k)[-1]
            more, depth = longer(int(masks[taken])), k >> 12
            paths = (k & 0xFFF | (depth + 1) << 12) + (np.arange(4) << (4 + 2 * depth))
            yield _rows(_keyed(fp[own], more, paths), paths, fp[own], n[own])


def join_all(up: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Union of the trees of p[i] and q[i]; up: each place's parent, never a larger one."""

    def roots(x: np.ndarray) -> np.ndarray:
        r = up[x]
        while (up[r] != r).any():
            r = up[r]
        up[x] = r
        return r

    while len(p):
        a, b = roots(p), roots(q)
        live = a != b
        p, q, a, b = p[live], q[live], a[live], b[live]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))


def _new(x: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Which differences are within the radius and met first on this path."""
    near = np.bitwise_count(x) <= RADIUS
    at = np.flatnonzero(near)
    first = np.argmax((x[at, None] & MASKS[None, :]) == 0, axis=1)
    near[at] = first == path[at] & 15
    deep = np.flatnonzero(near & (path >> 12 > 0))
    for k in np.unique(path[deep]).tolist():
        own = deep[path[deep] == k]
        for masks, taken in steps(k)[1:]:
            near[own] &= np.argmax((x[own, None] & masks[None, :]) == 0, axis=1) == taken
    return near


def _compare_tiles(fp: np.ndarray, pop: np.ndarray, path: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked places of one large key, ordered by population count."""
    for a in range(0, len(fp), TILE):
        for b in range(a, len(fp), TILE):
            if pop[b] - pop[min(a + TILE, len(fp)) - 1] > RADIUS:
                break
            x = fp[a : a + TILE, None] ^ fp[None, b : b + TILE]
            i, j = np.nonzero(np.bitwise_count(x) <= RADIUS)
            p, q = i + a, j + b
            p, q = p[p < q], q[p < q]
            ok = _new(fp[p] ^ fp[q], np.full(len(p), path))
            yield p[ok], q[ok]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a partition, whole keys together: (fp, linked, root) of linked fingerprints."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    key, path, fp, n = (t[c].to_numpy() for c in ("key", "path", "fp", "n"))
    fp = fp.view(np.uint64)
    pop = np.bitwise_count(fp).astype(np.int64)
    order = np.lexsort((fp, pop, key))
    key, path, fp, n, pop = (x[order] for x in (key, path, fp, n, pop))
    total = len(key)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(begin, total))
    stop = np.repeat(begin + size, size)
    linked = np.zeros(total, np.int64)
    up = np.arange(total)

    def note(p: np.ndarray, q: np.ndarray) -> None:
        np.add.at(linked, p, n[q])
        np.add.at(linked, q, n[p])
        join_all(up, p, q)

    small = np.flatnonzero(np.repeat(size <= 64, size))
    for d in range(1, 64):
        small = small[small + d < stop[small]]
        if not len(small):
            break
        p = small[pop[small + d] - pop[small] <= RADIUS]
        ok = _new(fp[p] ^ fp[p + d], path[p])
        note(p[ok], p[ok] + d)
    for b, s in zip(begin[size > 64].tolist(), size[size > 64].tolist()):
        for p, q in _compare_tiles(fp[b : b + s], pop[b : b + s], int(path[b])):
            note(p + b, q + b)
    at = np.flatnonzero(linked)
    root = at
    while (up[root] != root).any():
        root = up[root]
    yield pa.RecordBatch.from_arrays([pa.array(fp[at].view(np.int64)), pa.array(linked[at]), pa.array(fp[root].view(np.int64))], ["fp", "linked", "root"])


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """(fp, linked, root) rows of distinct fingerprints (fp, n): documents linked to fp in one task, and a forest edge."""
    kind = "key long, path int, fp long, n long"
    rows, ready, total = distinct.select("fp", "n").mapInArrow(_explode, kind), [], 16 * distinct.count()
    for _ in range(STEPS):
        large = checkpoint(rows.groupBy("key").count().where(F.col("count") > hot))
        if large.isEmpty():
            break
        total += 4 * (large.agg(F.sum("count")).first()[0])
        side = small_side(large.select("key"), 8)
        ready.append(rows.join(side, "key", "left_anti"))
        rows = checkpoint(rows.join(side, "key", "left_semi").mapInArrow(_deeper, kind))
    n = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // ROWS)
    return reduce(DataFrame.unionAll, [*ready, rows]).repartition(n, "key").mapInArrow(_compare, "fp long, linked long, root long")


def classes(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(fp, n_near, component_id, root) per distinct fingerprint of (doc_id, fp)."""
    distinct = checkpoint(fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low")))
    found = checkpoint(links(distinct, hot))
    near = found.groupBy("fp").agg(F.sum("linked").alias("linked"))
    roots = components(found.select(F.col("fp").alias("u"), F.col("root").alias("v")))
    all_ = distinct.join(near, "fp", "left").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    all_ = checkpoint(all_.select("fp", "low", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_near"), F.coalesce("root", "fp").alias("root")))
    names = all_.groupBy("root").agg(F.min("low").alias("component_id"))
    return all_.join(names, "root").select("fp", "n_near", "component_id", "root")


def hex16(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def groups(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint, n_near and component_id of every document."""
    fps = checkpoint(with_fingerprint(docs))
    got = fps.join(classes(fps, hot), "fp")
    return got.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "n_near", "component_id")


def representatives(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """The documents with one of each group left, all columns kept: that of the smallest doc_id (null last), by fingerprint if several share it."""
    names = docs.columns
    fps = checkpoint(with_fingerprint(docs))
    of = checkpoint(classes(fps, hot))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp"))
    own, row_fp = free_name("keep", names), free_name("row_fp", names)
    keep = checkpoint(fps.join(of, "fp").groupBy("root").agg(best.alias("k")).select(F.col("k.doc_id").alias(own), F.col("k.fp").alias("fp")))
    all_ = [F.col(f"`{c}`") for c in names]
    ids = keep.select(own).distinct()
    rows = docs.join(ids, docs["doc_id"].eqNullSafe(ids[own])).select(*(docs[f"`{c}`"] for c in names))
    if fps.groupBy("doc_id").count().where(F.col("count") > 1).isEmpty():
        return rows
    # Rows that share a doc_id are told apart by their fingerprints, and equal ones made one.
    kind = T.StructType([*docs.schema.fields, T.StructField(row_fp, T.LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fingerprints(texts).view(np.int64))], [*part.schema.names, row_fp])

    rows, keep = rows.mapInArrow(add, kind), keep.withColumnRenamed("fp", row_fp + "_")
    rows = rows.join(keep, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(row_fp) == F.col(row_fp + "_")))
    return rows.dropDuplicates(["doc_id", row_fp]).select(*all_)
