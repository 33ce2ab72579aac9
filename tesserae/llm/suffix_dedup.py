"""Substring removal by a distributed merge sort of suffixes that uses common prefixes.

A byte goes if a string of ``length`` bytes over it also starts in a document of
a smaller doc_id. ``_anchors`` selects the suffixes worth sorting: those at
anchors whose gram occurs in several documents in several contexts. Each group
of documents sorts its own, front-codes the sorted run (length of the prefix
shared with the suffix before, then the rest) and sends the parts of it to the
partitions. A partition merges the runs with a loser tree. The tree keeps, for
each run's head, the prefix it shares with the last suffix put out; heads that
differ in it are ordered without looking at them, others are compared from
there on, so no known prefix is compared again. The shared prefixes of
neighbours come out with the order; from them follow the strings, of the bytes
right of an anchor, that are equal, and with the bytes left of it the windows.

Texts are UTF-8; matches never cross documents. Kept bytes need not be valid
UTF-8, since a removed span may begin inside a character.

Defined results: null and empty texts, and those under ``length`` bytes, lose
nothing; rows that share a doc_id don't remove from each other; a null doc_id
loses and removes nothing; extra columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._anchors import HOT, Contexts, Found, Method, Symbols, dedup, ramps
from ._words import mix64, raw

LENGTH, GRAM = 50, 20
VALUES = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x51_7C_C1_B7_27_22_0A_95))
RECORD = np.dtype([("shared", "u1"), ("rest", "u1"), ("left", "u1"), ("n", "u1"), ("ch", "<u8"), ("first", "<u2"), ("last", "<u2")])
PREFIX = 6  #: bytes of the gram's digest before the suffix itself
DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
SPANS = "doc_id long, kept binary, spans array<struct<begin:long,end:long>>"


class Bytes(Symbols):
    def __init__(self, texts: pa.Array) -> None:
        self.buf, self.first = raw(texts)
        self.values = VALUES[self.buf]
        self.bytes = self.buf.tobytes()

    def context(self, begin: int, end: int) -> bytes:
        return self.bytes[begin:end]


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    n = min(len(a), len(b))
    while known < n and a[known] == b[known]:
        known += 1
    return known


def pack(c: Contexts) -> Iterator[tuple[int, bytes]]:
    """For each place a sorted, front-coded run of suffixes with what belongs to each."""
    size = np.array([len(x) for x in c.text])
    right = size - c.left
    flat = np.frombuffer(b"".join(c.text), np.uint8)
    start = np.cumsum(size) - size
    total, width = len(size), -(-(PREFIX + int(right.max())) // 8) * 8
    keys = np.zeros((total, width), np.uint8)
    keys[:, :PREFIX] = c.fp.astype(">u8").view(np.uint8).reshape(-1, 8)[:, -PREFIX:]
    row = np.arange(total)
    keys.reshape(-1)[ramps(row * width + PREFIX, right)] = flat[ramps(start + c.left, right)]
    # Zeros behind a key don't tell it from a longer one with zeros there; its length does.
    order = np.lexsort((right, *keys.view(">u8").T[::-1].astype(np.uint64), c.place))
    keys, left, start, long = keys[order], c.left[order], start[order], PREFIX + right[order]
    place = c.place[order]
    differ = keys[1:] != keys[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    shared = np.concatenate([[0], np.where(place[1:] == place[:-1], np.minimum(shared, np.minimum(long[1:], long[:-1])), 0)])
    rest = long - shared
    rec = np.zeros(total, RECORD)
    for name, x in (("shared", shared), ("rest", rest), ("left", left), ("n", c.n[order]), ("ch", c.ch[order]), ("first", c.first[order]), ("last", c.last[order])):
        rec[name] = x
    end = np.cumsum(rest + left)
    data = np.zeros(int(end[-1]), np.uint8)
    data[ramps(end - rest - left, rest)] = keys.reshape(-1)[ramps(row * width + shared, rest)]
    data[ramps(end - left, left)] = flat[ramps(start, left)]
    end = [0, *end.tolist()]
    for p, x, y in c.cuts():
        yield p, (y - x).to_bytes(4, "little") + rec[x:y].tobytes() + data[end[x] : end[y]].tobytes()


def unpack(block: bytes) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    n = int.from_bytes(block[:4], "little")
    at = 4 + n * RECORD.itemsize
    rec = np.frombuffer(block[4:at], RECORD)
    keys, lefts, before = [], [], b""
    for k, rest, left in zip(rec["shared"].tolist(), rec["rest"].tolist(), rec["left"].tolist()):
        before = before[:k] + block[at : at + rest]
        at += rest
        keys.append(before)
        lefts.append(block[at : at + left])
        at += left
    return rec, keys, lefts


def merge(runs: list[list[bytes]], shared: list[list[int]]) -> Iterator[tuple[int, int, int]]:
    """Merge sorted runs: (run, place in it, prefix shared with the one before), in order.

    shared[r][i]: prefix that runs[r][i] shares with runs[r][i - 1].
    """
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    place = [0] * k
    head: list[bytes | None] = [r[0] if r else None for r in runs] + [None] * (k - len(runs))
    known = [0] * k
    lost = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes the one shared with the winner."""
        x, y = head[a], head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = known[a], known[b]
        if p > q:
            return a, b
        if p < q:
            return b, a
        n = min(len(x), len(y))
        while p + 8 <= n and x[p : p + 8] == y[p : p + 8]:
            p += 8
        while p < n and x[p] == y[p]:
            p += 1
        if p == len(x) or p < n and x[p] < y[p]:
            known[b] = p
            return a, b
        known[a] = p
        return b, a

    winners = list(range(k))
    level = k
    while level > 1:
        level //= 2
        up = []
        for i in range(level):
            w, lost[level + i] = play(winners[2 * i], winners[2 * i + 1])
            up.append(w)
        winners = up
    w = winners[0]
    while head[w] is not None:
        i = place[w]
        yield w, i, known[w]
        i += 1
        place[w] = i
        if i < len(runs[w]):
            head[w], known[w] = runs[w][i], shared[w][i]
        else:
            head[w] = None
        node = (w + k) // 2
        while node:
            other = lost[node]
            x, y = head[w], head[other]
            if y is not None:
                if x is None or known[w] < known[other]:
                    lost[node], w = w, other
                elif known[w] == known[other]:
                    w, lost[node] = play(w, other)
            node //= 2


def resolve(blocks: list[bytes], bases: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, Found]]:
    if not blocks:
        return
    parts = [unpack(b) for b in blocks]
    order = list(merge([p[1] for p in parts], [p[0]["shared"].tolist() for p in parts]))
    part = np.array([x[0] for x in order])
    place = np.array([x[1] for x in order])
    common = np.array([x[2] for x in order])
    base = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
    rec = np.concatenate([p[0] for p in parts])[base[part] + place]
    lefts = [parts[p][2][i] for p, i, _ in order]
    keys = [parts[p][1][i] for p, i, _ in order]
    n, left = rec["n"].astype(np.int64), rec["left"].astype(np.int64)
    mine, last = bases[part] + rec["first"], bases[part] + rec["last"]
    total, deep = len(order), int(left.max(initial=0))
    back = np.zeros((total, deep), np.uint8)
    flat = np.frombuffer(b"".join(x[::-1] for x in lefts), np.uint8)
    back[np.repeat(np.arange(total), left), np.arange(len(flat)) - np.repeat(np.cumsum(left) - left, left)] = flat
    first = np.full((total, int(n.max(initial=0))), np.iinfo(np.int64).max)
    h = np.zeros(total, np.uint64)
    for o in range(deep + 1):
        # Windows that begin o bytes before the anchor: equal right of it as far as they reach, and left of it.
        if o:
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + back[:, o - 1].astype(np.uint64) + np.uint64(1))
        has = np.flatnonzero((o <= left) & (o > left - n))
        if not len(has):
            continue
        right = np.cumsum(common < PREFIX + length - o).astype(np.uint64)
        name = mix64(right * np.uint64(0xC2B2AE3D27D4EB4F) ^ h)[has]
        _, which = np.unique(name, return_inverse=True)
        low = np.full(int(which.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, which, mine[has])
        first[has, left[has] - o] = low[which]
    send = np.flatnonzero(first.min(axis=1, initial=np.iinfo(np.int64).max) < last)
    send = send[np.argsort(part[send], kind="stable")]
    fp = np.frombuffer(b"".join([b"\0\0" + keys[i][:PREFIX] for i in send.tolist()]), ">u8").astype(np.uint64)
    cut = np.flatnonzero(np.diff(part[send], prepend=-1)).tolist()
    for x, y in zip(cut, [*cut[1:], len(send)]):
        own = send[x:y]
        yield int(part[own[0]]), Found(fp[x:y], rec["ch"][own], n[own], first[own][np.arange(first.shape[1]) < n[own][:, None]])


def spans_of(gone: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal marked runs; runs end with their text."""
    edge = np.zeros(len(gone) + 1, bool)
    edge[first] = True
    before = np.concatenate([[False], gone[:-1]]) if len(gone) else gone
    after = np.concatenate([gone[1:], [False]]) if len(gone) else gone
    return np.flatnonzero(gone & (~before | edge[:-1])), np.flatnonzero(gone & (~after | edge[1:])) + 1


def _pieces(s: Bytes, gone: np.ndarray) -> list[bytes]:
    kept = s.buf[~gone].tobytes()
    at = np.concatenate([[0], np.cumsum(~gone)])[s.first].tolist()
    return [kept[a:b] for a, b in zip(at, at[1:])]


def _digests(rows: pa.RecordBatch, s: Bytes, gone: np.ndarray) -> dict:
    begin, _ = spans_of(gone, s.first)
    total = np.concatenate([[0], np.cumsum(gone)])[s.first]
    return {
        "doc_id": rows.column("doc_id"),
        "n_bytes": pa.array(np.diff(s.first)),
        "n_removed": pa.array(np.diff(total).astype(np.int64)),
        "n_spans": pa.array(np.diff(np.searchsorted(begin, s.first)).astype(np.int64)),
        "kept_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in _pieces(s, gone)], pa.string()),
    }


def _kept(rows: pa.RecordBatch, s: Bytes, gone: np.ndarray) -> dict:
    begin, end = spans_of(gone, s.first)
    at = np.searchsorted(begin, s.first).tolist()
    start = s.first.tolist()
    spans = [[{"begin": b - start[i], "end": e - start[i]} for b, e in zip(begin[x:y].tolist(), end[x:y].tolist())] for i, (x, y) in enumerate(zip(at, at[1:]))]
    return {"doc_id": rows.column("doc_id"), "kept": pa.array(_pieces(s, gone), pa.binary()), "spans": pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))}


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def digests(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Counts and the digest of what is kept of every document."""
    return dedup(_slim(docs), Method(LENGTH, GRAM, Bytes, pack, resolve, _digests, DIGESTS), hot)


def remove(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """What is kept of every document, and the removed spans, in bytes."""
    return dedup(_slim(docs), Method(LENGTH, GRAM, Bytes, pack, resolve, _kept, SPANS), hot)
