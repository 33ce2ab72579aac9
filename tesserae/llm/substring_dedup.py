"""Substring removal by suffix automata of reference shards, which meet the texts by exchange rather than by broadcast.

A word goes if a window of ``length`` words over it also starts in a document of
a smaller doc_id. ``_anchors`` brings the contexts that share an anchor gram to
one partition; those of a few thousand contexts are a reference shard. A shard's
suffix automaton grows in document order: the words of a context first run
through the automaton of all that is before it, which gives at each word the
length of its longest match there (its matching statistics) and, where that
reaches the threshold, the first document that has the window; then the context
is added. The maximal spans of such windows are removed.

The automata aren't broadcast: every shard would have to meet every document,
which grows with the square of the corpus. Shards and the texts that may match
them meet by exchange instead, and words are compared as such, so the outcome is
exactly that of all shards against all documents.

Words are compared unchanged; windows never cross documents.

Defined results: null and empty texts, and those under ``length`` words, lose
nothing; rows that share a doc_id don't remove from each other; a null doc_id
loses and removes nothing; extra columns are ignored by ``digests`` and kept by
``remove``; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._anchors import HOT, Contexts, Found, Method, Symbols, dedup
from ._words import mix64, words

LENGTH, GRAM = 13, 6
#: Contexts of one automaton; a gram's are never parted.
SHARD = 2000
RECORD = np.dtype([("fp", "<u8"), ("ch", "<u8"), ("n", "<u2"), ("size", "<u4"), ("first", "<u2"), ("last", "<u2")])
DIGESTS = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class WordSymbols(Symbols):
    def __init__(self, texts: pa.Array) -> None:
        self.words = words(texts)
        self.first = self.words.first
        self.values = mix64(self.words.hashes())
        self.bytes = self.words.buf.tobytes()
        self.begin, self.end = self.words.begin.tolist(), self.words.end.tolist()

    def context(self, begin: int, end: int) -> bytes:
        return b" ".join([self.bytes[a:b] for a, b in zip(self.begin[begin:end], self.end[begin:end])])


class Automaton:
    """Suffix automaton of several word strings, added one after another; each state knows the first document of its strings."""

    def __init__(self) -> None:
        self.to: list[dict] = [{}]
        self.link, self.size, self.first = [-1], [0], [0]

    def _state(self, to: dict, link: int, size: int, first: int) -> int:
        self.to.append(to)
        self.link.append(link)
        self.size.append(size)
        self.first.append(first)
        return len(self.to) - 1

    def _split(self, p: int, c: object, q: int) -> int:
        """The state of the strings that end in p and c, apart from the longer ones of q."""
        clone = self._state(self.to[q].copy(), self.link[q], self.size[p] + 1, self.first[q])
        self.link[q] = clone
        while p >= 0 and self.to[p].get(c) == q:
            self.to[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, string: list, document: int) -> None:
        """Documents come in ascending order."""
        to, link, size = self.to, self.link, self.size
        last = 0
        for c in string:
            q = to[last].get(c)
            if q is not None:
                last = q if size[q] == size[last] + 1 else self._split(last, c, q)
                continue
            new = self._state({}, 0, size[last] + 1, document)
            p = last
            while p >= 0 and c not in to[p]:
                to[p][c] = new
                p = link[p]
            if p >= 0:
                q = to[p][c]
                link[new] = q if size[q] == size[p] + 1 else self._split(p, c, q)
            last = new

    def matches(self, string: list, threshold: int) -> list[tuple[int, int | None]]:
        """For each word, the length of the longest match that ends there (at most the threshold), and at the threshold its first document."""
        to, link, size, first = self.to, self.link, self.size, self.first
        state = length = 0
        out = []
        for c in string:
            while state and c not in to[state]:
                state = link[state]
                length = size[state]
            if c in to[state]:
                state = to[state][c]
                length = min(length + 1, threshold)
                while size[link[state]] >= length > 0:
                    state = link[state]
            out.append((length, first[state] if length == threshold else None))
        return out


def pack(c: Contexts) -> Iterator[tuple[int, bytes]]:
    rec = np.zeros(len(c.text), RECORD)
    for name, x in (("fp", c.fp), ("ch", c.ch), ("n", c.n), ("size", [len(t) for t in c.text]), ("first", c.first), ("last", c.last)):
        rec[name] = x
    for p, x, y in c.cuts():
        yield p, (y - x).to_bytes(4, "little") + rec[x:y].tobytes() + b"".join(c.text[x:y])


def resolve(blocks: list[bytes], bases: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, Found]]:
    rows = []
    for i, (block, base) in enumerate(zip(blocks, bases.tolist())):
        n = int.from_bytes(block[:4], "little")
        at = 4 + n * RECORD.itemsize
        for fp, ch, windows, size, first, last in np.frombuffer(block[4:at], RECORD).tolist():
            rows.append((fp, base + first, i, ch, windows, block[at : at + size], base + last))
            at += size
    rows.sort(key=lambda r: r[0])
    found: dict[int, list] = {}
    begin = 0
    for end in range(1, len(rows) + 1):
        if end < len(rows) and (end - begin < SHARD or rows[end][0] == rows[end - 1][0]):
            continue
        shard = Automaton()
        for fp, first, i, ch, windows, context, last in sorted(rows[begin:end], key=lambda r: r[1]):
            string = context.split(b" ")
            firsts = np.array([first if d is None else d for _, d in shard.matches(string, length)[length - 1 :]], np.int64)
            shard.add(string, first)
            if firsts.min() < last:
                found.setdefault(i, []).append((fp, ch, firsts))
        begin = end
    for i, own in found.items():
        fps, chs, firsts = zip(*own)
        yield i, Found(np.array(fps, np.uint64), np.array(chs, np.uint64), np.array([len(x) for x in firsts]), np.concatenate(firsts))


def _digests(rows: pa.RecordBatch, s: WordSymbols, gone: np.ndarray) -> dict:
    total = np.concatenate([[0], np.cumsum(gone)])[s.first]
    keep = np.flatnonzero(~gone)
    at = np.searchsorted(keep, s.first).tolist()
    keep = keep.tolist()
    kept = [b" ".join([s.bytes[s.begin[i] : s.end[i]] for i in keep[a:b]]) for a, b in zip(at, at[1:])]
    return {"doc_id": rows.column("doc_id"), "n_words": pa.array(np.diff(s.first).astype(np.int64)), "n_removed": pa.array(np.diff(total).astype(np.int64)), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}


def _cut(rows: pa.RecordBatch, s: WordSymbols, gone: np.ndarray) -> dict:
    """All columns, the text without the removed words and the white space before each; other texts as they are."""
    out = {n: rows.column(n) for n in rows.schema.names}
    total = np.concatenate([[0], np.cumsum(gone)])[s.first]
    hit = np.flatnonzero(np.diff(total))
    texts = rows.column("text").to_pylist()
    stop = s.words.docs.tolist()
    first = s.first.tolist()
    for i in hit.tolist():
        parts, at = [], stop[i]
        for w in range(first[i], first[i + 1]):
            if not gone[w]:
                parts.append(s.bytes[at : s.end[w]])
            at = s.end[w]
        parts.append(s.bytes[at : stop[i + 1]])
        texts[i] = b"".join(parts).decode().lstrip(" \t\n\r\x0b\x0c")
    out["text"] = pa.array(texts, pa.string())
    if "n_chars" in out:
        was = out["n_chars"].to_pylist()
        for i in hit.tolist():
            was[i] = len(texts[i])
        out["n_chars"] = pa.array(was, out["n_chars"].type)
    return out


def digests(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Counts and the digest of the words kept of every document."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return dedup(docs, Method(LENGTH, GRAM, WordSymbols, pack, resolve, _digests, DIGESTS), hot)


def remove(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """The documents, all columns kept, with repeated words taken out of text (and n_chars put right)."""
    return dedup(docs, Method(LENGTH, GRAM, WordSymbols, pack, resolve, _cut, docs.schema), hot)
