"""Byte-level BPE, encoding and decoding, by batched numpy merge rounds.

A text is cut into units: a run of white space with the word after it. Distinct
units are encoded once per worker; a unit's pre-tokens that are new become
symbols in one flat array. Every round finds each word's lowest-rank pair by
binary search over the sorted pair keys and merges all its places, until no
word has a pair left. Ids of texts are then gathered from those of their units.

Defined results: null and empty texts have no ids and decode to an empty text;
repeated rows are encoded alike; extra columns are ignored; an empty table
gives an empty table. A text that holds a special token's string or white space
outside U+0009..U+000D and U+0020 is cut as a whole instead of by units, which
gives the ids that the tokenizers library gives.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import free_name
from ._words import IS_SPACE, byte_list, raw, slices

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Symbols above which a pre-token is merged alone, with a heap.
LONG = 512
#: Bytes of distinct units and their ids that a worker remembers before it starts anew.
REMEMBER = 24 << 20
NONE = 1 << 40
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+", regex.V1)
SPACES = b"\t\n\x0b\x0c\r "
#: Bytes without which no text holds white space outside ASCII.
ODD_BYTES = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
SLICE = 4 << 20
ODD_SPACE = regex.compile(r"[\p{White_Space}--[\t-\r ]]", regex.V1)


def byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, each with its byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """Merge table of a byte-level ``tokenizer.json``."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        cut = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) != ("ByteLevel", False, True):
            raise ValueError(f"{path}: only byte-level pre-tokens without a normalizer and a prefix space are known")
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        to_byte = byte_chars()
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.base = 1 << 20
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = made
        self.start = np.zeros(256, np.int64)
        for c, b in to_byte.items():
            self.start[b] = vocab[c]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        pieces: list[bytes] = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.piece_len = np.array([len(x) for x in pieces], np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)[:-1]])
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def rank(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.ranks[at], NONE) if len(self.keys) else np.full(len(keys), NONE)

    def merge(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts in a row, and the count of each."""
        lens = np.array([len(p) for p in parts], np.int64)
        counts = np.zeros(len(parts), np.int64)
        short = np.flatnonzero((lens > 0) & (lens <= LONG))
        sym = self.start[np.frombuffer(b"".join([parts[i] for i in short]), np.uint8)]
        word = np.repeat(short, lens[short])
        done_ids, done_words = [], []
        rank = np.full(len(sym), NONE)
        if len(sym) > 1:
            inner = np.flatnonzero(word[1:] == word[:-1])
            rank[inner] = self.rank(sym[inner] * self.base + sym[inner + 1])
        while len(sym):
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(begin, len(sym)))
            low = np.minimum.reduceat(rank, begin)
            if (low == NONE).any():
                over = np.repeat(low == NONE, size)
                done_ids.append(sym[over])
                done_words.append(word[over])
                live = ~over
                sym, word, rank = sym[live], word[live], rank[live]
                size, low = size[low != NONE], low[low != NONE]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, size))
            # In a run such as "aaa" a place that the one before it consumes is no place.
            fresh = np.concatenate([[True], np.diff(hit) != 1])
            nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[nth % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            now = np.cumsum(stay)[hit] - 1
            sym, word, rank = sym[stay], word[stay], rank[stay]
            for at in (now, now[now > 0] - 1):
                nxt = np.minimum(at + 1, len(sym) - 1)
                pair = (at < len(sym) - 1) & (word[at] == word[nxt])
                rank[at] = NONE
                at, nxt = at[pair], nxt[pair]
                rank[at] = self.rank(sym[at] * self.base + sym[nxt])
        for i in np.flatnonzero(lens > LONG):
            ids = self.merge_long(parts[i])
            done_ids.append(ids)
            done_words.append(np.full(len(ids), i))
        if not done_ids:
            return np.zeros(0, np.int64), counts
        ids, owner = np.concatenate(done_ids), np.concatenate(done_words)
        by = np.argsort(owner, kind="stable")
        np.add.at(counts, owner, 1)
        return ids[by], counts

    def merge_long(self, part: bytes) -> np.ndarray:
        """One part alone: a heap of (rank, place) over a linked list."""
        sym = self.start[np.frombuffer(part, np.uint8)].tolist()
        n = len(sym)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.rank(np.array(sym[:-1]) * self.base + np.array(sym[1:])).tolist()
        table = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        heap = [(r, i, sym[i], sym[i + 1]) for i, r in enumerate(ranks) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = int(self.made[r]), -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
            for p in (prev[i], i):
                q = nxt[p] if p >= 0 else n
                if p >= 0 and q < n and (s := table.get(sym[p] * self.base + sym[q])) is not None:
                    heapq.heappush(heap, (s, p, sym[p], sym[q]))
        return np.array([s for s in sym if s >= 0], np.int64)

    def cut(self, text: str) -> list[bytes | int]:
        """Pre-tokens of a whole text, special tokens as ids."""
        out: list[bytes | int] = []
        for piece in self.special_cut.split(text) if self.special_cut else [text]:
            if piece in self.special:
                out.append(self.special[piece])
            else:
                out += [m.encode() for m in PATTERN.findall(piece)]
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids' tokens in a row."""
        return gather(self.piece_bytes, self.piece_at[ids], self.piece_len[ids])


def gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[at[i] : at[i] + size[i]] one after another."""
    ends = np.cumsum(size)
    if not len(size) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(at - ends + size, size) + np.arange(ends[-1])]


class Memory:
    """Ids of the strings that a worker has met, in flat arrays; ``encode`` gives those of new ones."""

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], most: int = REMEMBER) -> None:
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.flat, self.at, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def __call__(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, where each unit's begin, how many they are); the units (large binary) differ from each other."""
        if self.known.nbytes + self.flat.nbytes + self.at.nbytes + self.size.nbytes > self.most:
            self.clear()
        place = pc.index_in(units, value_set=self.known)
        index = pc.fill_null(place, 0).to_numpy(zero_copy_only=False)
        if place.null_count:
            missing = place.is_null()
            new = units.filter(missing)
            ids, counts = self.encode(new)
            index = index.copy()
            index[missing.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, new])
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(counts) - counts])
            self.size = np.concatenate([self.size, counts.astype(np.int32)])
            self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
        return self.flat, self.at[index], self.size[index].astype(np.int64)


class Encoder:
    """Encodes Arrow texts; keeps what it has learnt for the next batch."""

    def __init__(self, path: str) -> None:
        self.bpe = Bpe(path)
        self.parts = Memory(lambda parts: self.bpe.merge(byte_list(parts)))
        self.units = Memory(self._units)

    def _pieces(self, cuts: list[list[bytes | int]]) -> tuple[np.ndarray, np.ndarray]:
        each = [p for c in cuts for p in c]
        plain = list({p for p in each if isinstance(p, bytes)})
        flat, at, size = self.parts(pa.array(plain, pa.large_binary()))
        where = dict(zip(plain, range(len(plain))))
        index = np.array([where[p] if isinstance(p, bytes) else -1 - p for p in each], np.int64)
        special = index < 0
        plain_index = np.where(special, 0, index)
        count = np.where(special, 1, np.append(size, 0)[plain_index])
        start = np.where(special, len(flat) - 1 - index, np.append(at, 0)[plain_index])
        top = max([0, *self.bpe.special.values()]) + 1
        ids = gather(np.concatenate([flat, np.arange(top, dtype=np.int32)]), start, count)
        per = np.array([len(c) for c in cuts], np.int64)
        total = np.concatenate([[0], np.cumsum(count)])
        ends = np.cumsum(per)
        return ids, total[ends] - total[ends - per]

    def _units(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Units that are white space and a word can be cut in one go: no pre-token crosses from one to the next."""
        units = byte_list(distinct)
        counts = np.zeros(len(units), np.int64)
        alone = np.array([not (u[0] in SPACES and u[-1] not in SPACES) for u in units], bool)
        rest = [units[i] for i in np.flatnonzero(~alone)]
        parts = pa.array(PATTERN.findall(b"".join(rest).decode()), pa.large_string())
        coded = parts.dictionary_encode()
        flat, at, size = self.parts(coded.dictionary.cast(pa.large_binary()))
        index = coded.indices.to_numpy(zero_copy_only=False)
        ids = gather(flat, at[index], size[index])
        ends = np.searchsorted(raw(parts)[1], np.cumsum([len(u) for u in rest]))
        total = np.concatenate([[0], np.cumsum(size[index])])
        counts[~alone] = np.diff(total[np.concatenate([[0], ends])])
        more, each = self._pieces([[m.encode() for m in PATTERN.findall(units[i].decode())] for i in np.flatnonzero(alone)])
        start = np.zeros(len(units), np.int64)
        start[~alone] = np.cumsum(counts[~alone]) - counts[~alone]
        counts[alone] = each
        start[alone] = len(ids) + np.cumsum(each) - each
        return gather(np.concatenate([ids, more]), start, counts), counts

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        n = len(texts)
        buf, docs = raw(texts)
        whole = np.zeros(n, bool)
        joined = buf.tobytes()
        if self.bpe.special or (buf >= 0xC2).any():
            strange = [t.encode() for t in self.bpe.special]
            if any(s in joined for s in strange) or any(s in joined for s in ODD_BYTES) and ODD_SPACE.search(joined.decode()):
                for i, t in enumerate(texts.to_pylist()):
                    whole[i] = any(s in t for s in strange) or bool(ODD_SPACE.search(t.decode()))
        space = IS_SPACE[buf]
        begins = space & ~np.concatenate([[False], space[:-1]]) if len(buf) else space
        if len(buf):
            begins[docs[:-1][docs[:-1] < len(buf)]] = True
        begin = np.flatnonzero(begins)
        first = np.searchsorted(begin, docs)
        packed = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(buf)).astype(np.int64)), pa.py_buffer(buf)])
        coded = packed.dictionary_encode()
        if whole.any():
            used = np.repeat(~whole, np.diff(first))
            coded = packed.filter(pa.array(used)).dictionary_encode()
            first = np.concatenate([[0], np.cumsum(np.where(whole, 0, np.diff(first)))])
        flat, at, size = self.units(coded.dictionary)
        index = coded.indices.to_numpy(zero_copy_only=False)
        ids = gather(flat, at[index], size[index])
        total = np.concatenate([[0], np.cumsum(size[index])])
        counts = total[first[1:]] - total[first[:-1]]
        if not whole.any():
            return ids, counts
        odd = np.flatnonzero(whole)
        more, each = self._pieces([self.bpe.cut(t.as_py().decode()) for t in texts.take(pa.array(odd))])
        plain_at = np.cumsum(counts) - counts
        counts[odd] = each
        at = plain_at
        at[odd] = len(ids) + np.cumsum(each) - each
        return gather(np.concatenate([ids, more]), at, counts), counts


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode every text, decode its ids, and return digests of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for batch in batches:
            for rows, texts in slices(batch, most=SLICE):
                ids, counts = encoder(texts)
                data = memoryview(ids.astype("<u4").tobytes())
                text = memoryview(encoder.bpe.decode(ids).tobytes())
                ends = np.cumsum(counts)
                sizes = np.concatenate([[0], np.cumsum(encoder.bpe.piece_len[ids])])
                cuts, at = sizes[np.concatenate([[0], ends])].tolist(), np.concatenate([[0], 4 * ends]).tolist()
                spans = range(len(counts))
                decoded = [bytes(text[cuts[i] : cuts[i + 1]]).decode("utf-8", "replace").encode() for i in spans]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(counts), pa.array([hashlib.sha256(data[at[i] : at[i + 1]]).hexdigest() for i in spans]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """The documents with n_tokens, ids and same (whether the decoded ids are the text) instead of their text; all other columns stay.

    Null and empty texts have no ids; repeated rows are encoded each; a new
    column whose name is taken gets underscores behind it; an empty table gives an
    empty one.
    """
    new = [free_name(c, docs.columns) for c in ("n_tokens", "ids", "same")]
    docs = docs.withColumn("text", F.col("text").cast("string"))
    kinds = (T.LongType(), T.ArrayType(T.IntegerType()), T.BooleanType())
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != "text"), *map(T.StructField, new, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for batch in batches:
            for rows, texts in slices(batch, most=SLICE):
                ids, counts = encoder(texts)
                ends = np.concatenate([[0], np.cumsum(counts)])
                sizes = np.concatenate([[0], np.cumsum(encoder.bpe.piece_len[ids])])[ends].tolist()
                text = encoder.bpe.decode(ids).tobytes()
                same = [text[a:b] == t for a, b, t in zip(sizes, sizes[1:], byte_list(texts))]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                kept = [rows.column(c) for c in rows.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(counts), lists, pa.array(same, pa.bool_())], schema.names)

    return docs.mapInArrow(run, schema)


_ENCODERS: dict[str, Encoder] = {}


def worker_encoder(path: str) -> Encoder:
    """The worker's encoder, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
