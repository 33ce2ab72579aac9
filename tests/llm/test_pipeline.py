import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as c
from tests.llm.test_simhash import brute, one
from tests.llm.test_quality import judge_one
from tesserae.llm import mixing

WORD = r"[^\x20\x09-\x0D]+"


def corpus():
    rng = np.random.default_rng(8)
    vocabulary = [f"{a}{b}" for a in "bcdfgh" for b in ("an", "el", "or", "ins", "é")]
    text = lambda n: " ".join(rng.choice(vocabulary, n)) + " end."
    rows, shared = [], text(70)
    for i in range(60):
        body = text(int(rng.integers(20, 300)))
        if i % 5 == 0:
            body += "\n" + shared
        if i % 7 == 0:
            body += " #%#% |||" * 40
        if i % 11 == 0:
            body = text(30) + (" " + text(12)) * 1 + (" again and again") * 90
        rows.append((i, body, "en", f"src{i % 4}" if i % 13 else None, len(body)))
    rows += [(100 + i, rows[i][1] + " x", "en", "src0", 0) for i in (2, 3, 4, 2)] + [(200, None, "en", "src1", 0), (201, "", "en", "src1", 0)]
    return [r for k, r in enumerate(rows) if r[0] not in {x[0] for x in rows[:k]}]


def by_hand(rows):
    rows = [r for r in rows if judge_one(r[1])["kept"]]
    groups = {d: comp for d, _, _, comp in brute([(r[0], one(r[1])) for r in rows])}
    rows = [r for r in rows if groups[str(r[0])] == r[0]]
    seen, out = set(), []
    for r in sorted(rows):
        words = [(m.start(), m.end(), m[0]) for m in re.finditer(WORD, r[1])]
        windows = [tuple(w[2] for w in words[i : i + 13]) for i in range(len(words) - 12)]
        gone = {j for i, w in enumerate(windows) if w in seen for j in range(i, i + 13)}
        seen |= set(windows)
        kept, at = "", 0
        for j, (_, e, _) in enumerate(words):
            kept += "" if j in gone else r[1][at:e]
            at = e
        out.append((r[0], (kept + r[1][at:]).lstrip(" \t\n\r\x0b\x0c") if gone else r[1], r[2], r[3]))
    return out


def test_run_matches_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = c.run(spark, str(tmp_path)).collect()
    left = by_hand(rows)
    assert 20 < len(left) < 60
    taken = {r.doc_id: r.taken // r["size"] for r in mixing.plan(spark.createDataFrame(left, "doc_id long, text string, lang string, source string")).collect() if r["size"]}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((d, lang, str(source), t.encode(x, add_special_tokens=False).ids) for d, x, lang, source in left for _ in range(taken.get(d, 0)))
    assert sorted((r.doc_id, r.lang, str(r.source), r.ids) for r in got) == want
    assert all(r.same and r.n_tokens == len(r.ids) for r in got)


@pytest.mark.parametrize("table", ["documents", "clashing"])
def test_stages_keep_columns_and_take_all_rows(spark, request, table):
    docs = documents = request.getfixturevalue(table)
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == documents.columns and out.dtypes == documents.dtypes, name
        assert out.count() >= 0
        stage(spark, docs.limit(0), "").collect()
        docs = out
    assert c.encode(spark, documents, "").count() == documents.count()


@pytest.mark.parametrize("text, stays", [(" ".join(f"word{i} of" for i in range(60)), True), ("one two three " * 60, False), (" ".join(f"w{i}#%|" for i in range(60)), True)])
def test_clean_documents_stay(spark, text, stays):
    df = spark.createDataFrame([(1, text, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert c.quality_rules(spark, df, "").count() == int(stays)
