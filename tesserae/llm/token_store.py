"""Content-addressed store of token ids.

Texts become id streams, each closed by an end id. A rolling hash over the last
16 ids cuts a stream into chunks, so equal passages give equal chunks wherever
they stand. A chunk is stored once, under the digest of its bytes. A store is a
folder of three tables:

``chunks``    digest, n, payload (ids as little-endian integers of ``width`` bytes)
``recipes``   position, doc_id, start, n_tokens, digests, leaf - by ascending doc_id
``manifest``  level, node, n_docs, start, n_tokens, root - Merkle nodes of 1,024 leaves, then of 1,024 nodes, up to one

``leaf`` is the digest of all that a recipe says: the document's place in order
and its id, where its ids start, how many they are, and its chunks. Reading
checks every chunk against its digest, every recipe against its leaf, the leaves
against the manifest, and that each document starts where the one before ends.

Texts are tokenized once, into a staging table in the store's folder, from which
recipes and chunks are made and which is then deleted. A task stages a chunk
about once, however many documents hold it, so a passage that a third of all
documents share moves no more often than there are tasks; and it is looked up
once for every few thousand documents. Places in order are sums over ranges, so
no id, and no null, brings its rows together.

Defined results: null and empty texts have the end id only; rows that share a
doc_id follow each other by their chunks' digests; a null doc_id comes first;
extra columns are ignored; an empty table gives an empty store.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import prefix_sums
from ._spark import checkpoint, delete
from ._words import byte_list, mix64, raw, slices, words
from .bpe import Memory, byte_chars, gather

WINDOW, LEAST, MOST, MASK = 16, 128, 4096, np.uint64(511)
DIGEST = 16
FAN_BITS = 10
SLICE = 2 << 20
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^ \p{L}\p{N}]+")
#: Normalizer and pre-tokenizer of the files for which words and PARTS cut as the library does.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
CUT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
#: Digests that a task remembers as staged before it starts anew.
SEEN = 1 << 17
_Q = 0x9E3779B97F4A7C15
_Q_INVERSE = pow(_Q, -1, 2**64)


class WordTokenizer:
    """A tokenizers file of lower-cased words, of which white space is no part, so that each distinct word is encoded once.

    New words of Latin letters, digits and signs are cut into pre-tokens
    together, and pre-tokens that are new go through the library's model. All
    other words are left to the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if (spec["normalizer"] or {}).get("normalizers") != NORMALIZER or steps[:1] != [CUT] or [x["type"] for x in steps[1:]] != ["ByteLevel"]:
            raise ValueError(f"{path}: another normalizer or pre-tokenizer than that of lower-cased words")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: What the short way doesn't take: beyond Latin Extended-B normalization and case have more to them.
        self.odd = regex.compile("|".join([*map(regex.escape, special), r"[^ !-~\u00a1-\u024f]"]))
        self.letter = {b: c for c, b in byte_chars().items()}
        self.memory = Memory(self._encode)
        self.parts = Memory(self._parts)

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        tokenize, letter = self.tokenizer.model.tokenize, self.letter
        ids = [[t.id for t in tokenize("".join([letter[b] for b in p]))] for p in byte_list(parts)]
        return np.array([i for x in ids for i in x], np.int64), np.array([len(x) for x in ids], np.int64)

    def _encode(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        units = byte_list(distinct)
        text = b" ".join(units).decode()
        counts = np.zeros(len(units), np.int64)
        odd = np.zeros(len(units), bool)
        if self.odd.search(text):
            odd[:] = [bool(self.odd.search(u.decode())) for u in units]
            text = b" ".join([u for u, o in zip(units, odd) if not o]).decode()
        text = text.lower()
        parts = pa.array(PARTS.findall(text), pa.large_string())
        coded = parts.dictionary_encode()
        flat, at, size = self.parts(coded.dictionary.cast(pa.large_binary()))
        index = coded.indices.to_numpy(zero_copy_only=False)
        ids = gather(flat, at[index], size[index])
        ends = np.cumsum([len(w) for w in text.split(" ")]) if text else np.zeros(0, np.int64)
        lengths = np.concatenate([[0], np.cumsum(pc.utf8_length(parts).to_numpy(zero_copy_only=False))])
        total = np.concatenate([[0], np.cumsum(size[index])])
        counts[~odd] = np.diff(total[np.concatenate([[0], np.searchsorted(lengths, ends)])])
        alone = [np.array(self.tokenizer.encode(u.decode(), add_special_tokens=False).ids, np.int64) for u, o in zip(units, odd) if o]
        counts[odd] = [len(x) for x in alone]
        start = np.zeros(len(units), np.int64)
        start[~odd] = np.cumsum(counts[~odd]) - counts[~odd]
        start[odd] = len(ids) + np.cumsum(counts[odd]) - counts[odd]
        return gather(np.concatenate([ids, *alone]), start, counts), counts

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each closed by ``end``, and how many each has."""
        w = words(texts)
        index, distinct = w.ids()
        flat, at, size = self.memory(distinct)
        n = size[index]
        total = np.concatenate([[0], np.cumsum(n)])
        counts = total[w.first[1:]] - total[w.first[:-1]]
        ids = gather(flat, at[index], n)
        return np.insert(ids, np.cumsum(counts), end) if len(counts) else ids, counts + 1


_TOKENIZERS: dict[str, WordTokenizer] = {}


def worker_tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def cut(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of all chunks in a row, and how many each document has."""
    n = len(ids)
    power = np.full(n, _Q, np.uint64)
    back = np.full(n, _Q_INVERSE, np.uint64)
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(back, out=back)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(ids.astype(np.uint64) + np.uint64(_Q)) * power, dtype=np.uint64)])
    places = np.arange(WINDOW, n + 1)
    marked = places[(mix64((total[places] - total[places - WINDOW]) * back[places - 1]) & MASK) == 0]
    ends = np.cumsum(counts)
    sizes, each = [], np.zeros(len(counts), np.int64)
    bounds = np.searchsorted(marked, np.concatenate([[0], ends]), "right").tolist()
    marked = marked.tolist()
    for i, (stop, size) in enumerate(zip(ends.tolist(), counts.tolist())):
        at, before = stop - size, len(sizes)
        for m in marked[bounds[i] : bounds[i + 1]]:
            while m - at > MOST:
                sizes.append(MOST)
                at += MOST
            if m - at >= LEAST and m - (stop - size) >= WINDOW and m < stop:
                sizes.append(m - at)
                at = m
        while stop - at > MOST:
            sizes.append(MOST)
            at += MOST
        sizes.append(stop - at)
        each[i] = len(sizes) - before
    return np.array(sizes, np.int64), each


def digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=DIGEST).digest()


def _streams(batches: Iterator[pa.RecordBatch], path: str, end: int, width: int) -> Iterator[tuple]:
    """(rows, counts, chunk sizes, chunks of each, bytes of all ids)."""
    tokenizer = worker_tokenizer(path)
    for batch in batches:
        for rows, texts in slices(batch, most=SLICE):
            ids, counts = tokenizer(texts, end)
            sizes, each = cut(ids, counts)
            yield rows, counts, sizes, each, ids.astype(f"<u{width}").tobytes()


def _pieces(data: bytes, sizes: np.ndarray, width: int) -> list[bytes]:
    ends = (np.cumsum(sizes) * width).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def staged(docs: DataFrame, path: str, end: int, width: int) -> DataFrame:
    """Every document's recipe, and the bytes of those of its chunks that its task doesn't remember.

    sizes: ids of each chunk; fresh: 1 for each whose bytes are in payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for rows, counts, sizes, each, data in _streams(batches, path, end, width):
            if len(seen) > SEEN:
                seen.clear()
            pieces = _pieces(data, sizes, width)
            keys = [digest(p) for p in pieces]
            fresh = bytearray(len(keys))
            for i, k in enumerate(keys):
                if k not in seen:
                    seen.add(k)
                    fresh[i] = 1
            ends = np.cumsum(each).tolist()
            spans = [*zip([0, *ends], ends)]
            lengths = sizes.astype("<i4")
            columns = [
                rows.column("doc_id"),
                pa.array(counts),
                pa.array([b"".join(keys[a:b]) for a, b in spans], pa.binary()),
                pa.array([lengths[a:b].tobytes() for a, b in spans], pa.binary()),
                pa.array([bytes(fresh[a:b]) for a, b in spans], pa.binary()),
                pa.array([b"".join([p for p, f in zip(pieces[a:b], fresh[a:b]) if f]) for a, b in spans], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "digests", "sizes", "fresh", "payload"])

    return docs.mapInArrow(run, "doc_id long, n_tokens long, digests binary, sizes binary, fresh binary, payload binary")


def chunks(stage: DataFrame, width: int) -> DataFrame:
    """Every distinct chunk once: one exchange by digest, in which equal ones become neighbours."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for keys, sizes, fresh, data in zip(*(batch.column(c).to_pylist() for c in ("digests", "sizes", "fresh", "payload"))):
                at = 0
                for i, (n, f) in enumerate(zip(np.frombuffer(sizes, "<i4").tolist(), fresh)):
                    if f:
                        out.append((keys[i * DIGEST : (i + 1) * DIGEST], n, data[at : at + n * width]))
                        at += n * width
            k, n, p = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(n, pa.int32()), pa.array(p, pa.binary())], ["digest", "n", "payload"])

    rows = stage.select("digests", "sizes", "fresh", "payload").mapInArrow(emit, "digest binary, n int, payload binary")
    n = int(stage.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "digest").groupBy("digest").agg(F.first("n").alias("n"), F.first("payload").alias("payload"))


def _leaf() -> Column:
    """Digest of all that a recipe says."""
    number = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    known = F.when(F.col("doc_id").isNull(), F.lit(b"\x00")).otherwise(F.lit(b"\x01"))
    said = F.concat(number(F.col("position")), known, number(F.coalesce("doc_id", F.lit(0))), number(F.col("start")), number(F.col("n_tokens")), "digests")
    return F.unhex(F.sha2(said, 256))


def merkle(recipes: DataFrame) -> DataFrame:
    """All nodes over the recipes, by their places, with whether their documents follow each other without a gap."""
    level = recipes.select(F.col("position").alias("node"), F.lit(1).cast("long").alias("n_docs"), "start", "n_tokens", F.col("leaf").alias("root"))
    out, depth = None, 0
    while True:
        kids = F.sort_array(F.collect_list(F.struct("node", "start", "n_tokens", "root"))).alias("kids")
        got = level.groupBy(F.shiftright("node", FAN_BITS).alias("node")).agg(F.sum("n_docs").alias("n_docs"), F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"), kids)
        root = F.unhex(F.sha2(F.unhex(F.array_join(F.transform("kids", lambda k: F.hex(k["root"])), "")), 256))
        others = F.size("kids") - 1
        joined = F.forall(F.zip_with(F.slice("kids", 1, others), F.slice("kids", 2, others), lambda a, b: a["start"] + a["n_tokens"] == b["start"]), lambda x: x)
        got = checkpoint(got.select("node", "n_docs", "start", "n_tokens", root.alias("root"), joined.alias("joined")))
        here = got.select(F.lit(depth).alias("level"), "*")
        out = here if out is None else out.unionAll(here)
        if got.count() <= 1:
            return out
        level, depth = got.drop("joined"), depth + 1


def write(docs: DataFrame, folder: str, path: str, end: int, width: int = 2) -> str:
    """Write a store of the documents (doc_id, text) and return its folder."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    staged(docs, path, end, width).write.option("compression", "zstd").parquet(f"{folder}/stage")
    stage = spark.read.parquet(f"{folder}/stage")
    placed = prefix_sums(stage.select("doc_id", "n_tokens", "digests", F.lit(1).cast("long").alias("one")), ["doc_id", "digests"], {"start": "n_tokens", "position": "one"})
    placed = placed.select("position", "doc_id", "start", "n_tokens", "digests").withColumn("leaf", _leaf())
    placed.sortWithinPartitions("position").write.option("compression", "zstd").parquet(f"{folder}/recipes")
    chunks(stage, width).write.option("compression", "zstd").parquet(f"{folder}/chunks")
    delete(spark, f"{folder}/stage")
    merkle(spark.read.parquet(f"{folder}/recipes")).drop("joined").withColumn("width", F.lit(width)).write.parquet(f"{folder}/manifest")
    return folder


class Damaged(ValueError):
    """A store whose bytes differ from their digests."""


def _checked_crcs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, payloads = batch.column("digest").to_pylist(), batch.column("payload").to_pylist()
        crcs = []
        for k, p in zip(keys, payloads):
            if digest(p) != k:
                raise Damaged(f"chunk {k.hex()}")
            crcs.append(zlib.crc32(np.frombuffer(p, f"<u{width}").astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([len(p) // width for p in payloads], pa.int32()), pa.array(crcs, pa.int64())], ["digest", "n", "crc"])


def _times(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Images of crc values under an operator on their 32 bits."""
    bits = (v[..., None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
    return np.bitwise_xor.reduce(np.where(bits.astype(bool), m, np.uint32(0)), axis=-1)


def _crc_powers() -> list[np.ndarray]:
    """Operators that append 2^k zero bytes to a crc32, as images of its 32 bits."""
    m = np.array([0xEDB88320, *(1 << i for i in range(31))], np.uint32)
    for _ in range(3):
        m = _times(m, m)
    out = [m]
    while len(out) < 40:
        out.append(_times(out[-1], out[-1]))
    return out


POWERS = _crc_powers()


@lru_cache(maxsize=MOST + 1)
def _append(size: int) -> list[list[int]]:
    """The operator that appends size zero bytes, as a table for each of the four bytes of a crc."""
    m = np.uint32(1) << np.arange(32, dtype=np.uint32)
    k = 0
    while size:
        if size & 1:
            m = _times(POWERS[k], m)
        size >>= 1
        k += 1
    return [_times(m, np.arange(256, dtype=np.uint32) << np.uint32(8 * i)).tolist() for i in range(4)]


def crc_join(a: int, b: int, size: int) -> int:
    """crc32 of two byte strings in a row, from theirs and the second's size."""
    t = _append(size)
    return t[0][a & 255] ^ t[1][a >> 8 & 255] ^ t[2][a >> 16 & 255] ^ t[3][a >> 24] ^ b


def _crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for want, parts in zip(batch.column("n_tokens").to_pylist(), batch.column("parts").to_pylist()):
            crc = n = 0
            for p in parts:
                if p["crc"] is None:
                    raise Damaged("a recipe names a chunk that isn't stored")
                crc = crc_join(crc, p["crc"], 4 * p["n"]) if n else p["crc"]
                n += p["n"]
            if n != want:
                raise Damaged("a recipe's chunks have another length")
            out.append(crc)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(out, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk of a batch of recipes once, with all the places where it is used."""
    names = ("position", "doc_id", "start", "n_tokens")
    for batch in batches:
        buf, offs = raw(batch.column("digests").cast(pa.large_binary()))
        each = np.diff(offs) // DIGEST
        n = int(each.sum())
        keys = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int64) * DIGEST), pa.py_buffer(buf)]).dictionary_encode()
        which = keys.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(which, kind="stable")
        owner = np.repeat(np.arange(batch.num_rows), each)
        at = np.arange(n) - np.repeat(np.cumsum(each) - each, each)
        used = batch.select(names).take(pa.array(owner[order]))
        places = pa.StructArray.from_arrays([*used.columns, pa.array(at[order].astype(np.int32))], [*names, "at"])
        ends = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(keys.dictionary)))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([keys.dictionary.cast(pa.binary()), pa.ListArray.from_arrays(pa.array(ends), places)], ["digest", "on"])


def _looked_up(spark: SparkSession, folder: str, stored: DataFrame) -> DataFrame:
    """A row for every chunk of every recipe with what ``stored`` has of it, null if nothing."""
    kind = "digest binary, on array<struct<position:long,doc_id:long,start:long,n_tokens:long,at:int>>"
    uses = spark.read.parquet(f"{folder}/recipes").select("position", "doc_id", "start", "n_tokens", "digests").mapInArrow(_uses, kind)
    rows = uses.join(stored, "digest", "left").select(F.explode("on").alias("p"), *(c for c in stored.columns if c != "digest"))
    return rows.select("p.*", *(c for c in rows.columns if c != "p"))


def verify(spark: SparkSession, folder: str) -> None:
    """Raise ``Damaged`` unless recipes, leaves and Merkle nodes agree, and documents follow each other from 0 without a gap."""
    wrong = F.raise_error(F.concat(F.lit("Damaged: recipe of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).cast("binary")
    again = merkle(spark.read.parquet(f"{folder}/recipes").withColumn("leaf", F.when(F.col("leaf") == _leaf(), F.col("leaf")).otherwise(wrong)))
    bad = again.where(~F.col("joined") | (F.col("node") == 0) & (F.col("start") != 0))
    if bad.head(1):
        raise Damaged("documents don't follow each other")
    again = again.drop("joined")
    written = spark.read.parquet(f"{folder}/manifest").select(*again.columns)
    if written.exceptAll(again).unionAll(again.exceptAll(written)).head(1):
        raise Damaged("the manifest differs")


def _width(spark: SparkSession, folder: str) -> int:
    return spark.read.parquet(f"{folder}/manifest").select(F.coalesce(F.max("width"), F.lit(2))).first()[0]


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of every document's ids, from the files.

    Payloads are read once and stay where they are: a document's crc32 follows
    from those of its chunks.
    """
    verify(spark, folder)
    width = _width(spark, folder)
    crcs = spark.read.parquet(f"{folder}/chunks").mapInArrow(lambda b: _checked_crcs(b, width), "digest binary, n int, crc long")
    docs = _looked_up(spark, folder, crcs).groupBy("position", "doc_id", "start", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("parts"))
    return docs.mapInArrow(_crcs, "doc_id long, start long, n_tokens long, ids_crc32 long")


def reconstruct(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start and ids of every document; each chunk is checked against its digest."""
    width = _width(spark, folder)

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, p in zip(b.column("digest").to_pylist(), b.column("payload").to_pylist()):
                if digest(p) != k:
                    raise Damaged(f"chunk {k.hex()}")
            yield b

    stored = spark.read.parquet(f"{folder}/chunks").select("digest", "payload").mapInArrow(checked, "digest binary, payload binary")
    docs = _looked_up(spark, folder, stored).groupBy("position", "doc_id", "start", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("at", "payload"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = []
            for want, parts in zip(b.column("n_tokens").to_pylist(), b.column("parts").to_pylist()):
                if any(p["payload"] is None for p in parts):
                    raise Damaged("a recipe names a chunk that isn't stored")
                ids.append(np.frombuffer(b"".join(p["payload"] for p in parts), f"<u{width}").astype(np.int64))
                if len(ids[-1]) != want:
                    raise Damaged("a recipe's chunks have another length")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    return docs.mapInArrow(run, "doc_id long, start long, ids array<long>")


def digests(docs: DataFrame, folder: str, path: str, end: int) -> DataFrame:
    """Write a store, read its documents' digests back from the files, and delete it."""
    spark = docs.sparkSession
    out = checkpoint(read_digests(spark, write(docs, folder, path, end)))
    delete(spark, folder)
    return out
