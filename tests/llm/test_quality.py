import random
import re

import numpy as np
import pyarrow as pa

from tesserae.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pairwise(w):
    """For each word, the longest string from it that starts elsewhere too."""
    n = len(w)
    out = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and w[i + k] == w[j + k]:
                k += 1
            out[i], out[j] = max(out[i], k), max(out[j], k)
    return out


def repeats(w):
    """The same for long texts: suffixes sorted as strings with a character for each distinct word."""
    names = {x: chr(0x4E00 + i) for i, x in enumerate(dict.fromkeys(w))}
    s, out = "".join(names[x] for x in w), [0] * len(w)
    order = sorted(range(len(s)), key=lambda i: s[i:])
    for i, j in zip(order, order[1:]):
        k, top = 0, len(s) - max(i, j)
        while k < top:  # the prefix that both share, by halves
            mid = (k + top + 1) // 2
            k, top = (mid, top) if s[i + k : i + mid] == s[j + k : j + mid] else (k, mid - 1)
        out[i], out[j] = max(out[i], k), max(out[j], k)
    return out


def judge_one(text, rules=q.Rules()):
    text = text or ""
    w = WORD.findall(text)
    n, ls = len(w), repeats(w)
    cover = lambda least, size: len({j for i, k in enumerate(ls) if k >= least for j in range(i, i + (size or k))})
    lines = [x for x in text.split("\n") if WORD.search(x)]
    m = {"n_words": n, "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": cover(3, 3)}
    m["base_failed"] = n < 50 or 100 * m["n_repeat_words"] > 50 * n
    m["covered_fraction"] = cover(rules.span, 0) / max(n, 1)
    m["longest_repeat"] = max([k for k in ls if k >= 2], default=0)
    bad = m["covered_fraction"] > rules.max_covered or m["longest_repeat"] > rules.max_longest
    m["kept"] = not m["base_failed"] and not bad
    return m


def some_texts():
    rnd = random.Random(6)
    texts = [None, "", "one", "a a", "a a a a a a", " \n ", "é é\u0085é\n\né", "#* $ |"]
    for _ in range(60):
        words = [rnd.choice("abcdefghijk") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 150))]
        if rnd.random() < 0.5 and words:
            i = rnd.randrange(len(words))
            words += words[i : i + rnd.randint(5, 40)] * rnd.randint(1, 3)
        texts.append("".join(x + rnd.choice([" ", " ", "\n", "  "]) for x in words))
    return texts


def test_measures_match_brute_force():
    texts = some_texts()
    from tesserae.llm._words import text_array

    m = q.measure(text_array(pa.array(texts)), q.Rules())
    for i, t in enumerate(texts):
        assert {k: v[i].item() for k, v in m.items()} == judge_one(t), repr(t)
        assert repeats(WORD.findall(t or "")) == pairwise(WORD.findall(t or ""))


def test_query_rows(clashing):
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in q.judge(clashing).collect())
    rows = [(r.doc_id, judge_one(r.text)) for r in clashing.collect()]
    assert max(m["n_words"] for _, m in rows) > 9000
    assert got == sorted((str(d), *(m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))) for d, m in rows)
    assert q.keep(clashing).columns == clashing.columns and q.keep(clashing).count() == sum(m["kept"] for _, m in rows)
    assert q.judge(clashing.limit(0)).count() == 0


def test_long_repetitive_text():
    ids = np.zeros(20_000, np.int64)
    ls = q.longest_repeats(ids, np.array([0, 20_000]))
    assert ls[0] == 19_999 and ls[-1] in (0, 1)


def test_repetition_alone_decides(spark):
    clean = " ".join(f"word{i} of" for i in range(60))
    once = " ".join(f"w{i}" for i in range(51))
    texts = {"clean": (clean, True), "symbols": (clean + " #%$" * 10 + "|" * 300, True), "lines": ("\n".join([clean, *["a b", "c"] * 8]), True), "half": (clean + " " + " ".join(f"r{i}" for i in range(45)) + (" " + " ".join(f"r{i}" for i in range(45))), False), "longest": (" ".join(f"z{i}" for i in range(600)) + " " + once + " then " + once, False)}
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts.values())], "doc_id long, text string")
    got = [(r.base_failed, r.kept) for r in q.judge(df).orderBy("doc_id").collect()]
    assert got == [(False, kept) for _, kept in texts.values()]
