import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tesserae.llm import token_store as s
from tesserae.llm._words import text_array

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_words_encode_as_whole_texts():
    rnd = random.Random(4)
    alpha = "aaabB'sé́ ñßΣσ  \n\t1٣中😀.!?-\u0085\x1c\x07İ  <|endoftext|>"
    texts = ["", None, "it's <|endoftext|>x", "<|startoftext|>", "a<|startoftext|> b", "ΟΔΟΣ. ΑΣ ΣΑΣ'Σ", *("".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 30))) for _ in range(3000))]
    ids, counts = s.WordTokenizer(PATH)(text_array(pa.array(texts)), 2)
    t, at = Tokenizer.from_file(PATH), 0
    for text, n in zip(texts, counts.tolist()):
        assert ids[at : at + n].tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 2], repr(text)
        at += n


def test_chunks_tile_streams_and_follow_content():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 49000, 60_000)
    counts = np.array([30_000, 1, 29_999])
    sizes, each = s.cut(ids, counts)
    ends = np.cumsum(each)
    assert [sizes[a:b].sum() for a, b in zip([0, *ends], ends)] == counts.tolist() and sizes.max() <= s.MOST
    moved, _ = s.cut(np.concatenate([ids[:30_000][777:]]), np.array([30_000 - 777]))
    cuts = lambda x, to: {to - int(c) for c in np.cumsum(x)}
    assert len(cuts(sizes[: ends[0]], 30_000) & cuts(moved, 30_000 - 777)) > each[0] // 2
    assert s.cut(np.zeros(20_000, np.int64), np.array([20_000]))[0].sum() == 20_000


@pytest.mark.parametrize("a, b", [(b"", b""), (b"a", b""), (b"abc", b"d" * 5000), (b"\x00" * 9, b"\x00")])
def test_crc_join(a, b):
    assert s.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_store_round_trip(spark, clashing, tmp_path):
    folder = s.write(clashing, str(tmp_path / "store"), PATH, 2)
    t = Tokenizer.from_file(PATH)
    src = [(r.doc_id, [*t.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in clashing.collect()]
    src.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(s.read_digests(spark, folder).collect(), key=lambda r: r.start)
    ids = {r.start: r.ids for r in s.reconstruct(spark, folder).collect()}
    assert [r.doc_id for r in got] == [d for d, _ in src]
    assert sorted((str(r.doc_id), ids[r.start]) for r in got) == sorted((str(d), x) for d, x in src)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[at]), zlib.crc32(np.array(ids[at], "<u4").tobytes()))
        at += r.n_tokens
    c = spark.read.parquet(f"{folder}/chunks")
    assert c.count() == c.select("digest").distinct().count()


@pytest.fixture(scope="module")
def sound(spark, documents, tmp_path_factory):
    return s.write(documents.where("doc_id < 20"), str(tmp_path_factory.mktemp("store") / "store"), PATH, 2)


@pytest.mark.parametrize(
    "table, change, says",
    [
        ("recipes", "* except (digests), if(doc_id = 3, reverse(digests), digests) digests", "recipe of document 3"),
        ("recipes", "* except (start), start + 7 start", "recipe of document"),
        ("recipes", "* except (doc_id), if(doc_id = 4, 400, doc_id) doc_id", "recipe of document 400"),
        ("chunks", "digest, n, concat(payload, x'0000') payload", "chunk "),
        ("chunks", "unhex(md5(digest)) digest, n, payload", "chunk "),
        ("manifest", "* except (n_tokens), n_tokens + 1 n_tokens", "manifest differs"),
    ],
)
def test_damage_is_found(spark, sound, tmp_path, table, change, says):
    for t in ("recipes", "chunks", "manifest"):
        spark.sql(f"SELECT {change if t == table else '*'} FROM parquet.`{sound}/{t}`").write.parquet(str(tmp_path / t))
    with pytest.raises(Exception, match=says):
        s.read_digests(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("shift", ["start + 7", "if(position >= 5, start + 7, start)"])
def test_moved_starts_are_found_even_with_fitting_leaves(spark, sound, tmp_path, shift):
    moved = spark.read.parquet(f"{sound}/recipes").selectExpr("position", "doc_id", f"{shift} start", "n_tokens", "digests").withColumn("leaf", s._leaf())
    moved.write.parquet(str(tmp_path / "recipes"))
    s.merkle(spark.read.parquet(str(tmp_path / "recipes"))).drop("joined").selectExpr("*", "2 width").write.parquet(str(tmp_path / "manifest"))
    with pytest.raises(s.Damaged, match="follow"):
        s.verify(spark, str(tmp_path))


def test_missing_chunk_is_found(spark, sound, tmp_path):
    for t in ("recipes", "manifest"):
        spark.read.parquet(f"{sound}/{t}").write.parquet(str(tmp_path / t))
    spark.read.parquet(f"{sound}/chunks").orderBy("digest").offset(1).write.parquet(str(tmp_path / "chunks"))
    for read in (s.read_digests, s.reconstruct):
        with pytest.raises(Exception, match="isn't stored"):
            read(spark, str(tmp_path)).collect()


def test_many_rows_of_one_id(spark, tmp_path):
    rows = [(None, "same text here")] * 1500 + [(5, f"text {i % 3}") for i in range(1500)] + [(-1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = s.write(df, str(tmp_path / "store"), PATH, 2)
    got = sorted(s.read_digests(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 1500 + [-1] + [5] * 1500
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    assert spark.read.parquet(f"{folder}/chunks").count() == 5


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="another normalizer"):
        s.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def test_empty_table(spark, documents, tmp_path):
    folder = s.write(documents.limit(0), str(tmp_path / "store"), PATH, 2)
    assert s.read_digests(spark, folder).count() == 0
