import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tesserae.llm import bpe
from tesserae.llm._words import text_array

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(seed):
    rnd = random.Random(seed)
    alpha = "aaabbcé ñß  \n\t'sdt\r\x0b\x0c\u0085\x1c\x1f1٣中文😀!?-_.,<|endoftext|> 　́"
    out = ["", None, " ", "  ", "a", "a  ", "\n\n a", "<|endoftext|>", "x<|endoftext|> <|endoftext|>  y", "a \n b", "it's we'll 'tis", "a" * 2000, "ab" * 900 + " the", "é" * 700, "a \n b", "     "]
    out += ["".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 40))) for _ in range(1500)]
    return out + ["".join(rnd.choice(["<|endoftext|>", "the ", "then", "  ", "\n", " ", " x", ".", "'ll", "12"]) for _ in range(rnd.randint(1, 12))) for _ in range(500)]


def test_ids_are_the_librarys(library):
    rows = texts(5)
    e = bpe.Encoder(PATH)
    for _ in range(2):  # new, then remembered
        ids, counts = e(text_array(pa.array(rows)))
        at = np.cumsum(counts) - counts
        for i, t in enumerate(rows):
            assert ids[at[i] : at[i] + counts[i]].tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)
        assert e.bpe.decode(ids).tobytes().decode() == "".join(t or "" for t in rows)


def test_memory_that_starts_anew(library):
    e = bpe.Encoder(PATH)
    e.units.most = e.parts.most = 10
    for t in texts(7)[::7]:
        assert e(text_array(pa.array([t])))[0].tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_heap_equals_rounds(monkeypatch):
    e, rnd = bpe.Bpe(PATH), random.Random(1)
    parts = ["".join(rnd.choice("thering éa") for _ in range(rnd.randint(1, 60))).encode() for _ in range(300)] + [b"a" * n for n in range(1, 30)]
    want = e.merge(parts)
    monkeypatch.setattr(bpe, "LONG", 0)
    got = e.merge(parts)
    assert want[0].tolist() == got[0].tolist() and want[1].tolist() == got[1].tolist()


def test_query_rows(library, clashing):
    def row(d, t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        return str(d), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(clashing, PATH).collect())
    assert got == sorted(row(r.doc_id, r.text) for r in clashing.collect())
    assert bpe.round_trip(clashing.limit(0), PATH).count() == 0


def test_encode_keeps_other_columns(library, documents, clashing):
    df = clashing.selectExpr("*", "1 AS ids", "2 AS n_tokens_")
    out = bpe.encode(df, PATH)
    assert out.columns == [c for c in df.columns if c != "text"] + ["n_tokens", "ids_", "same"]
    want = [str((r.doc_id, r.n_chars, library.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect()]
    assert sorted(str((r.doc_id, r.n_chars, r.ids_)) for r in out.collect()) == sorted(want)
    assert bpe.encode(documents.select("doc_id", "text"), PATH).columns == ["doc_id", "n_tokens", "ids", "same"]
    assert all(r.same for r in bpe.encode(documents, PATH).collect()) and bpe.encode(documents.limit(0), PATH).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Bpe(public_tokenizers.path("word_bpe_49k.json"))
