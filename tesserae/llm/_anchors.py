"""Exact removal of strings that also start in an earlier document: the exchange that two operators share.

Texts are rows of symbols (bytes or words); a window is ``length`` of them. Of
the ``length - gram + 1`` grams in a window the one of least hash is its anchor
(the last of equals). Equal windows have equal anchors at equal places, so only
windows of the same anchor gram need to be compared: 6 % of all byte positions
are anchors. Windows next to each other with the same anchor form a run; its
context is the string that they cover.

Documents are handled in groups of 2^GROUP_BITS neighbouring ids:

1. A group tells each anchor gram's partition, once per gram: a digest of the
   gram, of its context (or that it has several), and its first document here.
2. A partition sees in which grams documents meet. If all contexts of one are
   equal, the first document of all its windows is known. Otherwise the groups
   are asked for the contexts.
3. Asked groups send each distinct context once, with its first document.
4. A resolver, by the operator's own method, finds the first document of every
   window of the contexts that share a gram.
5. A group marks the windows whose first document is before its own.

Partitions hold about 256 MB of text's grams each, whatever the setting of shuffle
partitions is if there is more text, and every row goes just where it belongs. A
partition is read in slices of its grams, about 8 MB of text's each and sorted by
Spark, so that a task of steps 2 and 4 holds one slice at a time. What a group
sends to a slice is one row, so rows are groups times slices: no more slices than
memory needs, and no work in Python per row beyond cutting its bytes.

A gram of a third of all documents is one entry per group in step 1. A gram of
more than ``HOT`` contexts isn't resolved in one place: groups send its windows
as digests, which spread over all partitions and are again one per group.
Nothing is dropped at any size. Texts are exchanged once, by group; steps 3 and
5 read the same exchange again.

Digests: 48 bits of the gram and 40 of the context in steps 1 and 2; contexts
themselves, or 128-bit digests of hot windows, in step 4. What steps 1 and 2 settle
is therefore right but for a collision of 88 bits, what step 4 settles by contexts
is compared symbol by symbol.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import mix64, slices

GROUP_BITS = 10
HOT = 4096
#: Bytes of text whose grams share a partition, and a slice of one.
PART_BYTES, SLICE_BYTES = 256 << 20, 8 << 20
#: Bytes of text whose anchors are found at once, so that the arrays of it stay in a core's cache.
TEXT_BYTES = 128 << 10
_Q1, _Q2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_LOW48 = np.uint64((1 << 48) - 1)
_LOW40 = np.uint64((1 << 40) - 1)
SEVERAL = np.uint64(0)
ENTRY = np.dtype([("fp", "V6"), ("ch", "V5"), ("meta", "<u2")])
#: What a partition says of a gram: its first document, or one of these.
ASK, ASK_HOT = 2**63 - 1, 2**63 - 2
ANSWER = np.dtype([("fp", "<u8"), ("first", "<i8")])
HOT_WINDOW = np.dtype([("digest", "V16"), ("first", "<i8"), ("last", "<i8")])
SINGLE_ROW, CONTEXT_ROW, HOT_ROW, ASK_ROW = 0, 1, 2, 3


def _pack(x: np.ndarray, size: int) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).view(f"V{size}").reshape(-1)


def _unpack(x: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :size] = np.ascontiguousarray(x).view(np.uint8).reshape(-1, size)
    return out.view("<u8").reshape(-1).astype(np.uint64)


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    return np.multiply.accumulate(out, out=out)


_kept_powers = lru_cache(maxsize=4)(_powers)


class Rolling:
    """Hashes of any strings of a row of symbols."""

    def __init__(self, values: np.ndarray, factor: int) -> None:
        n = len(values)
        # The tables are kept for slices of the usual size; those for a long single text are not.
        power, self.back = (_kept_powers(f, 2 * TEXT_BYTES)[: n + 1] if n < 2 * TEXT_BYTES else _powers(f, n + 1) for f in (factor, pow(factor, -1, 2**64)))
        power = power[:n]
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * power, out=self.total[1:])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.total[end] - self.total[begin]) * self.back[begin])


@dataclass
class Runs:
    """Runs of windows with one anchor each: anchor, first and last window start, hashes of gram and context, text that holds them."""

    at: np.ndarray
    a: np.ndarray
    b: np.ndarray
    fp: np.ndarray
    ch: np.ndarray
    owner: np.ndarray


def runs(values: np.ndarray, first: np.ndarray, length: int, gram: int) -> Runs:
    """Of the symbols of several texts; first: where each text begins, n + 1."""
    n = len(values)
    none = np.zeros(0, np.int64)
    size = np.diff(first)
    count = np.maximum(size - length + 1, 0)
    if not count.sum():
        return Runs(none, none, none, none.astype(np.uint64), none.astype(np.uint64), none)
    one, two = Rolling(values, _Q1), Rolling(values, _Q2)
    places = np.arange(n - gram + 1)
    h = one(places, places + gram)
    bits = np.uint64(max(1, int(n).bit_length()))
    least = (h >> bits << bits) | places[::-1].astype(np.uint64)
    width, step = length - gram + 1, 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    anchor = (n - gram) - (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ends = np.cumsum(count)
    window = np.repeat(first[:-1] - ends + count, count) + np.arange(ends[-1])
    anchor = anchor[window]
    new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    begin = np.flatnonzero(new)
    a, b, at = window[begin], window[np.append(begin[1:] - 1, len(window) - 1)], anchor[begin]
    owner = np.searchsorted(ends, begin, "right")
    ch = mix64(two(a, b + length) + np.uint64(_Q1) * (at - a).astype(np.uint64) + np.uint64(_Q2) * (b - a).astype(np.uint64))
    return Runs(at, a, b, h[at], ch, owner)


class Symbols:
    """A slice of texts as symbols."""

    values: np.ndarray
    first: np.ndarray

    def context(self, begin: int, end: int) -> bytes:
        """The string of the symbols from begin to end."""
        raise NotImplementedError


@dataclass
class Contexts:
    """A group's distinct contexts by place (a slice of a partition), then gram; documents count from the group's first id."""

    place: np.ndarray
    fp: np.ndarray
    ch: np.ndarray
    left: np.ndarray  #: symbols before the anchor
    n: np.ndarray  #: windows
    first: np.ndarray
    last: np.ndarray
    text: list[bytes]

    def cuts(self) -> Iterator[tuple[int, int, int]]:
        """(place, begin, end)."""
        cut = np.flatnonzero(np.concatenate([[True], self.place[1:] != self.place[:-1]])) if len(self.place) else np.zeros(0, np.int64)
        return zip(self.place[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(self.place)])


@dataclass
class Found:
    """Contexts of which an earlier document has windows: number of windows, and the first document of each, one context after another."""

    fp: np.ndarray
    ch: np.ndarray
    n: np.ndarray
    first: np.ndarray

    def packed(self, base: int) -> bytes:
        """Documents as from base; 0 for all before."""
        first = np.clip(self.first - base + 1, 0, (1 << GROUP_BITS) + 1)
        return b"".join([len(self.fp).to_bytes(4, "little"), _pack(self.fp, 6).tobytes(), self.ch.astype("<u8").tobytes(), self.n.astype("<u2").tobytes(), first.astype("<u2").tobytes()])

    @staticmethod
    def unpacked(blocks: list[bytes]) -> Found:
        """Of several blocks; documents as in them."""
        parts: list[list[bytes]] = [[], [], [], []]
        for x in blocks:
            n = int.from_bytes(x[:4], "little")
            for part, a, b in zip(parts, (4, 4 + 6 * n, 4 + 14 * n, 4 + 16 * n), (4 + 6 * n, 4 + 14 * n, 4 + 16 * n, len(x))):
                part.append(x[a:b])
        fp, ch, n, first = (b"".join(p) for p in parts)
        return Found(_unpack(np.frombuffer(fp, "V6"), 6), np.frombuffer(ch, "<u8"), np.frombuffer(n, "<u2").astype(np.int64), np.frombuffer(first, "<u2").astype(np.int64))


def ramps(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each size, one after another."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


@dataclass(frozen=True)
class Method:
    """What an operator brings along."""

    length: int
    gram: int
    symbols: Callable[[pa.Array], Symbols]
    pack: Callable[[Contexts], Iterator[tuple[int, bytes]]]  #: a group's contexts to (place, packed part)
    resolve: Callable[[list[bytes], np.ndarray], Iterator[tuple[int, Found]]]  #: packed parts, and the id that each one's documents count from, to (part, what is found)
    finish: Callable[[pa.RecordBatch, Symbols, np.ndarray], dict]  #: output columns, from the marked windows
    schema: str


#: What the group column's name begins with; as many underscores follow as keep it apart from other columns.
GROUP = "grp"


def _group(table: pa.Table) -> tuple[str, int]:
    name = max((n for n in table.column_names if n.rstrip("_") == GROUP), key=len)
    return name, int(table[name][0].as_py())


def _all_runs(table: pa.Table, m: Method) -> Iterator[tuple[pa.RecordBatch, Symbols, Runs, np.ndarray]]:
    table = table.drop_columns([_group(table)[0]])
    for rows, texts in (x for batch in table.sort_by("doc_id").combine_chunks().to_batches() for x in slices(batch, most=TEXT_BYTES)):
        s = m.symbols(texts)
        r = runs(s.values, s.first, m.length, m.gram)
        yield rows, s, r, rows.column("doc_id").to_numpy(zero_copy_only=False)[r.owner]


def _tell(table: pa.Table, m: Method, parts: int, per: int) -> pa.Table:
    """Step 1."""
    _, group = _group(table)
    got = [(r.fp & _LOW48, r.ch & _LOW40, doc) for _, _, r, doc in _all_runs(table, m)]
    fp, ch, doc = (np.concatenate([g[i] for g in got]) for i in range(3))
    ch[ch == SEVERAL] = 1
    place = fp % np.uint64(parts * per)
    order = np.argsort(place << np.uint64(48) | fp) if parts * per <= 1 << 16 else np.lexsort((fp, place))
    fp, ch, doc = fp[order], ch[order], doc[order]
    if not len(fp):
        return pa.table({"part": pa.array([], pa.int32()), "slice": pa.array([], pa.int32()), "grp": pa.array([], pa.int64()), "payload": pa.array([], pa.binary())})
    new = np.concatenate([[True], fp[1:] != fp[:-1]])
    begin = np.flatnonzero(new)
    low, high = np.minimum.reduceat(doc, begin), np.maximum.reduceat(doc, begin)
    size = np.diff(np.append(begin, len(fp)))
    kinds = np.ones(len(begin), np.int64)
    again = np.flatnonzero(size > 1)
    if len(again):
        own, each = np.repeat(again, size[again]), ch[ramps(begin[again], size[again])]
        order = np.lexsort((each, own))
        own, each = own[order], each[order]
        kinds += np.bincount(own[1:][(own[1:] == own[:-1]) & (each[1:] != each[:-1])], minlength=len(begin))
    entry = np.zeros(len(begin), ENTRY)
    entry["fp"] = _pack(fp[begin], 6)
    entry["ch"] = _pack(np.where(kinds > 1, SEVERAL, ch[begin]), 5)
    power = np.minimum(np.ceil(np.log2(kinds)).astype(np.int64), 31)
    entry["meta"] = (low & ((1 << GROUP_BITS) - 1)) | (high > low).astype(np.int64) << 10 | power << 11
    place = (fp[begin] % np.uint64(parts * per)).astype(np.int32)
    cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    blocks = [entry[x:y].tobytes() for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(entry)])]
    return pa.table({"part": place[cut] // per, "slice": place[cut] % per, "grp": np.full(len(cut), group), "payload": pa.array(blocks, pa.binary())})


def _by_group(group: np.ndarray, records: np.ndarray, kind: int) -> pa.RecordBatch:
    order = np.argsort(group, kind="stable")
    group, records = group[order], records[order]
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    blocks = [records[x:y].tobytes() for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(group)])]
    return pa.RecordBatch.from_arrays([pa.array(group[cut], pa.int64()), pa.array(np.full(len(cut), kind, np.int32)), pa.array(blocks, pa.binary())], ["grp", "kind", "payload"])


ANSWERS = "grp long, kind int, payload binary"


def _by_slice(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[tuple]]:
    """The rows of one slice of a partition after another."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("slice", *names))))
    for _, own in groupby(rows, key=lambda r: r[0]):
        yield [r[1:] for r in own]


def _meet(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """Step 2, for all grams of a partition."""
    for rows in _by_slice(batches, "grp", "payload"):
        yield from _meet_slice([r[0] for r in rows], [r[1] for r in rows], hot)


def _meet_slice(groups: list[int], blocks: list[bytes], hot: int) -> Iterator[pa.RecordBatch]:
    each = np.array([len(x) // ENTRY.itemsize for x in blocks])
    entry = np.frombuffer(b"".join(blocks), ENTRY)
    del blocks
    group = np.repeat(np.array(groups, np.int64), each)
    fp, ch, meta = _unpack(entry["fp"], 6), _unpack(entry["ch"], 5), entry["meta"].astype(np.int64)
    order = np.argsort(fp)
    fp, ch, meta, group = fp[order], ch[order], meta[order], group[order]
    begin = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
    size = np.diff(np.append(begin, len(fp)))
    low = (group << GROUP_BITS) | meta & ((1 << GROUP_BITS) - 1)
    more = meta >> 10 & 1
    first = np.minimum.reduceat(low, begin)
    shared = (size > 1) | (np.maximum.reduceat(more, begin) > 0)
    several = (np.minimum.reduceat(ch, begin) != np.maximum.reduceat(ch, begin)) | (np.minimum.reduceat(ch, begin) == SEVERAL)
    kinds = np.add.reduceat(1 << (meta >> 11), begin)
    say = np.where(several, np.where(kinds > hot, ASK_HOT, ASK), first)
    say, shared = np.repeat(say, size), np.repeat(shared, size)
    send = shared & ~((say == low) & (more == 0))
    out = np.zeros(int(send.sum()), ANSWER)
    out["fp"], out["first"] = fp[send], say[send]
    # Step 3 needs to know what is asked, step 5 what is settled, and both what is hot.
    for kind, own in ((ASK_ROW, out["first"] >= ASK_HOT), (SINGLE_ROW, out["first"] != ASK)):
        yield _by_group(group[send][own], out[own], kind)


def _answers(right: pa.Table, kind: int) -> list[bytes]:
    return [p for p, k in zip(right["payload"].to_pylist(), right["kind"].to_pylist()) if k == kind]


def _lookup(table: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which are in the table sorted by fp, their places)."""
    at = np.searchsorted(table["fp"], fp)
    at[at == len(table)] = 0
    return (table["fp"][at] == fp) if len(table) else np.zeros(len(fp), bool), at


def _said(right: pa.Table, kind: int) -> np.ndarray:
    said = np.frombuffer(b"".join(_answers(right, kind)), ANSWER)
    return said[np.argsort(said["fp"], kind="stable")]


def _hot_digests(s: Symbols, r: Runs, i: int, length: int) -> list[bytes]:
    return [hashlib.blake2b(s.context(w, w + length), digest_size=16).digest() for w in range(int(r.a[i]), int(r.b[i]) + 1)]


def _send(left: pa.Table, right: pa.Table, m: Method, parts: int, per: int) -> pa.Table:
    """Step 3."""
    _, group = _group(left)
    said = _said(right, ASK_ROW)
    got: list[tuple[np.ndarray, ...]] = []
    texts: list[bytes] = []
    hot: dict[bytes, list[int]] = {}
    if len(said):
        for _, s, r, doc in _all_runs(left, m):
            known, at = _lookup(said, r.fp & _LOW48)
            say = said["first"][at]
            for i in np.flatnonzero(known & (say == ASK_HOT)).tolist():
                d = int(doc[i])
                for g in _hot_digests(s, r, i, m.length):
                    hot.setdefault(g, [d, d])[1] = d
            i = np.flatnonzero(known & (say == ASK))
            got.append((r.fp[i] & _LOW48, r.ch[i], r.at[i] - r.a[i], r.b[i] - r.a[i] + 1, doc[i] - (group << GROUP_BITS)))
            texts += map(s.context, r.a[i].tolist(), (r.b[i] + m.length).tolist())
    rows: list[tuple[int, int, bytes]] = []
    if texts:
        fp, ch, before, n, doc = (np.concatenate([g[k] for g in got]) for k in range(5))
        place = (fp % np.uint64(parts * per)).astype(np.int64)
        order = np.lexsort((ch, fp, place))  # stable, so that a context's documents stay in order
        new = np.concatenate([[True], (fp[order[1:]] != fp[order[:-1]]) | (ch[order[1:]] != ch[order[:-1]])])
        begin = np.flatnonzero(new)
        one, last = order[begin], order[np.append(begin[1:], len(order)) - 1]
        rows += [(p, CONTEXT_ROW, x) for p, x in m.pack(Contexts(place[one], fp[one], ch[one], before[one], n[one], doc[one], doc[last], [texts[i] for i in one.tolist()]))]
    if hot:
        rec = np.array([(np.void(g), *x) for g, x in hot.items()], HOT_WINDOW)
        where = (np.ascontiguousarray(rec["digest"]).view("<u8")[::2] % np.uint64(parts * per)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        rec, where = rec[order], where[order]
        cut = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        rows += [(int(where[x]), HOT_ROW, rec[x:y].tobytes()) for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(rec)])]
    part, kind, payload = zip(*rows) if rows else ((), (), ())
    at = np.array(part, np.int32)
    return pa.table({"part": at // per, "slice": at % per, "grp": pa.array([group] * len(rows), pa.int64()), "kind": pa.array(kind, pa.int32()), "payload": pa.array(payload, pa.binary())})


def _resolve(batches: Iterator[pa.RecordBatch], m: Method) -> Iterator[pa.RecordBatch]:
    """Step 4."""
    for rows in _by_slice(batches, "grp", "kind", "payload"):
        yield from _resolve_slice(*map(list, zip(*rows)), m)


def _resolve_slice(groups: list[int], kinds: list[int], blocks: list[bytes], m: Method) -> Iterator[pa.RecordBatch]:
    context = [i for i, k in enumerate(kinds) if k == CONTEXT_ROW]
    base = np.array([groups[i] for i in context], np.int64) << GROUP_BITS
    found = [(groups[context[i]], x.packed(int(base[i]))) for i, x in m.resolve([blocks[i] for i in context], base)]
    if found:
        own, payload = zip(*found)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(np.full(len(own), CONTEXT_ROW, np.int32)), pa.array(payload, pa.binary())], ["grp", "kind", "payload"])
    hot = [i for i, k in enumerate(kinds) if k == HOT_ROW]
    if hot:
        rec = np.frombuffer(b"".join(blocks[i] for i in hot), HOT_WINDOW)
        group = np.repeat(np.array([groups[i] for i in hot]), [len(blocks[i]) // HOT_WINDOW.itemsize for i in hot])
        _, which = np.unique(np.ascontiguousarray(rec["digest"]).view("<u8").reshape(-1, 2), axis=0, return_inverse=True)
        first = np.full(int(which.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, which, rec["first"])
        out = rec.copy()
        out["first"] = first[which]
        send = out["first"] < rec["last"]
        yield _by_group(group[send], out[send], HOT_ROW)


def _mark(left: pa.Table, right: pa.Table, m: Method) -> pa.Table:
    """Step 5."""
    base = _group(left)[1] << GROUP_BITS
    said = _said(right, SINGLE_ROW)
    found = Found.unpacked(_answers(right, CONTEXT_ROW))
    begin = np.cumsum(found.n) - found.n
    place_of = dict(zip(zip(found.fp.tolist(), found.ch.tolist()), range(len(found.fp))))
    grams = np.zeros(len(found.fp), ANSWER)
    grams["fp"] = np.sort(found.fp)
    hot: dict[bytes, int] = {}
    for block in _answers(right, HOT_ROW):
        rec = np.frombuffer(block, HOT_WINDOW)
        hot.update(zip(rec["digest"].tolist(), rec["first"].tolist()))
    out = []
    for rows, s, r, doc in _all_runs(left, m):
        step = np.zeros(len(s.values) + 1, np.int64)
        known, at = _lookup(said, r.fp & _LOW48)
        first = np.where(known, said["first"][at], doc) if len(said) else doc
        whole = np.flatnonzero(first < doc)
        np.add.at(step, r.a[whole], 1)
        np.add.at(step, r.b[whole] + m.length, -1)
        asked = np.flatnonzero(_lookup(grams, r.fp & _LOW48)[0])
        at = np.array(list(map(place_of.get, zip((r.fp[asked] & _LOW48).tolist(), r.ch[asked].tolist()), repeat(-1))), np.int64)
        asked, at = asked[at >= 0], at[at >= 0]
        n = found.n[at]
        w = ramps(r.a[asked], n)[found.first[ramps(begin[at], n)] < np.repeat(doc[asked] - base + 1, n)]
        np.add.at(step, w, 1)
        np.add.at(step, w + m.length, -1)
        for i in np.flatnonzero(first == ASK_HOT).tolist():
            for j, g in enumerate(_hot_digests(s, r, i, m.length)):
                if hot.get(g, doc[i]) < doc[i]:
                    step[r.a[i] + j] += 1
                    step[r.a[i] + j + m.length] -= 1
        out.append(m.finish(rows, s, np.cumsum(step[:-1]) > 0))
    return pa.Table.from_batches([pa.RecordBatch.from_pydict(o) for o in out])


def group_of(doc_id) -> object:
    return F.shiftright(doc_id, GROUP_BITS)


def places(size: int, setting: int) -> tuple[int, int]:
    """(partitions, slices of each) for so many bytes of text."""
    parts = max(setting, -(-size // PART_BYTES))
    return parts, max(1, -(-size // (parts * SLICE_BYTES)))


def dedup(docs: DataFrame, m: Method, hot: int = HOT) -> DataFrame:
    """The method's output for all documents, of which every column named in ``docs`` is handed to ``finish``.

    A row with a null doc_id comes neither before nor after another: it loses
    nothing, and nothing is removed on its account.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, per = places(size, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    name = GROUP
    while any(c.rstrip("_") == GROUP and len(c) >= len(name) for c in docs.columns):
        name += "_"
    groups = docs.where(F.col("doc_id").isNotNull()).withColumn(name, group_of(F.col("doc_id"))).groupBy(name)
    told = groups.applyInArrow(lambda t: _tell(t, m, parts, per), "part int, slice int, grp long, payload binary")
    said = told.repartitionById(parts, "part").sortWithinPartitions("slice").mapInArrow(lambda b: _meet(b, hot), ANSWERS)
    asked = groups.cogroup(said.where(F.col("kind") == ASK_ROW).groupBy("grp")).applyInArrow(lambda x, y: _send(x, y, m, parts, per), "part int, slice int, grp long, kind int, payload binary")
    found = asked.repartitionById(parts, "part").sortWithinPartitions("slice").mapInArrow(lambda b: _resolve(b, m), ANSWERS)
    done = groups.cogroup(said.where(F.col("kind") == SINGLE_ROW).unionAll(found).groupBy("grp")).applyInArrow(lambda x, y: _mark(x, y, m), m.schema)

    def nameless(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch):
                s = m.symbols(texts)
                yield pa.RecordBatch.from_pydict(m.finish(rows, s, np.zeros(len(s.values), bool)))

    return done.unionAll(docs.where(F.col("doc_id").isNull()).mapInArrow(nameless, m.schema))
