import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tesserae.llm import _anchors, substring_dedup, suffix_dedup


def brute(rows, length, split):
    """{doc_id: (n, removed, spans, kept)} straight from the definition."""
    first = {}
    texts = [(d, split(t or "")) for d, t in rows]
    for d, x in texts:
        for i in range(len(x) - length + 1):
            k = x[i : i + length] if isinstance(x, bytes) else tuple(x[i : i + length])
            if d is not None:
                first[k] = min(d, first.get(k, d))
    out = []
    for d, x in texts:
        gone = [False] * len(x)
        for i in range(len(x) - length + 1):
            k = x[i : i + length] if isinstance(x, bytes) else tuple(x[i : i + length])
            if d is not None and first[k] < d:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = [c for c, g in zip(x, gone) if not g]
        out.append((str(d), len(x), sum(gone), spans, kept))
    return out


def bytes_of(rows):
    return sorted((d, n, r, s, hashlib.sha256(bytes(k)).hexdigest()) for d, n, r, s, k in brute(rows, 50, str.encode))


def words_of(rows):
    return sorted((d, n, r, hashlib.sha256(" ".join(k).encode()).hexdigest()) for d, n, r, s, k in brute(rows, 13, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)))


def corpus(seed, docs=260):
    """Few words, shared passages in ever other surroundings, copies, edits, ids far apart."""
    rnd = random.Random(seed)
    vocabulary = ["a", "of", "the", "é", "then", "wooden", "x" * 30, "😀"]
    passages = [" ".join(rnd.choice(vocabulary) + rnd.choice(["", "s", "ed"]) for _ in range(rnd.randint(10, 60))) for _ in range(6)]
    rows, ids = [], rnd.sample(range(-3000, 9000), docs)
    for i in ids:
        parts = []
        for _ in range(rnd.randint(0, 4)):
            p = rnd.choice(passages)
            kind = rnd.random()
            if kind < 0.3:
                p = p[rnd.randint(0, len(p) // 2) :]
            elif kind < 0.5:
                p = p[: rnd.randint(1, len(p))]
            elif kind < 0.7:
                parts.append(" ".join(rnd.choice(vocabulary) + str(rnd.randint(0, 99)) for _ in range(rnd.randint(1, 30))))
            parts.append(p)
        rows.append((i, rnd.choice([" ", "\n", "  ", ""]).join(parts)))
    rows += [(ids[0], rows[0][1]), (ids[1], rows[5][1]), (None, rows[3][1]), (None, rows[3][1]), (99_999, "ab" * 400), (100_000, "b" + "ab" * 300), (100_001, None), (100_002, "")]
    return rows


@pytest.mark.parametrize("seed, hot", [(1, 4096), (2, 1), (3, 6)])
def test_bytes_match_brute_force(spark, seed, hot):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as grp", "1 as part", "2 as kind").repartition(4)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(df, hot).collect())
    assert got == bytes_of(rows)


@pytest.mark.parametrize("seed, hot", [(4, 4096), (5, 1), (6, 6)])
def test_words_match_brute_force(spark, seed, hot):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as grp", "1 as part", "2 as kind").repartition(4)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digests(df, hot).collect())
    assert got == words_of(rows)


def test_fixture_rows(clashing):
    rows = [(r.doc_id, r.text) for r in clashing.collect()]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(clashing).collect()) == bytes_of(rows)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digests(clashing).collect()) == words_of(rows)
    assert suffix_dedup.digests(clashing.limit(0)).count() == 0 and substring_dedup.digests(clashing.limit(0)).count() == 0


def test_spans_and_texts(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text, 5), (2, f"own\nstart {text} own  end\n", 6), (3, " clean \n text", 7)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in substring_dedup.remove(df).collect()}
    assert [got[i].text for i in (1, 2, 3)] == [text, "own\nstart own  end\n", " clean \n text"] and [got[i].n_chars for i in (1, 2, 3)] == [5, 19, 7]
    cut = {r.doc_id: r for r in suffix_dedup.remove(df).collect()}
    b = df.collect()[1].text.encode()
    for r in cut[2].spans:
        b = b[: r.begin] + b"\xff" * (r.end - r.begin) + b[r.end :]
    assert b.replace(b"\xff", b"") == cut[2].kept and len(cut[2].spans) == 1 and not cut[1].spans


def test_loser_tree_merges_and_gives_shared_prefixes():
    rnd = random.Random(2)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 9))) for _ in range(rnd.randint(0, 30))) for _ in range(k)]
        shared = [[suffix_dedup.shared_prefix(r[i - 1], r[i]) if i else 0 for i in range(len(r))] for r in runs]
        got = list(suffix_dedup.merge(runs, shared))
        keys = [runs[r][i] for r, i, _ in got]
        assert keys == sorted(x for r in runs for x in r)
        assert all(n == suffix_dedup.shared_prefix(a, b) for a, b, (_, _, n) in zip(keys, keys[1:], got[1:]))


def test_matching_statistics():
    rnd = random.Random(3)
    for _ in range(40):
        a = substring_dedup.Automaton()
        known = []
        for d in range(6):
            x = [rnd.choice("ab") for _ in range(rnd.randint(0, 12))]
            want = []
            for i in range(len(x)):
                n = max(k for k in range(0, min(4, i + 1) + 1) if k == 0 or any(y[j : j + k] == x[i + 1 - k : i + 1] for _, y in known for j in range(len(y))))
                docs = [e for e, y in known for j in range(len(y)) if y[j : j + 4] == x[i - 3 : i + 1]] if n == 4 else []
                want.append((n, min(docs) if docs else None))
            assert a.matches(x, 4) == want
            a.add(x, d)
            known.append((d, x))


def test_slices_are_as_many_as_memory_needs():
    for size in (0, 1, 10**9, 10**10, 10**12):
        for setting in (1, 12, 200, 600):
            parts, per = _anchors.places(size, setting)
            assert parts >= setting and size <= parts * per * _anchors.SLICE_BYTES and (per == 1 or size > parts * (per - 1) * _anchors.SLICE_BYTES)
    assert _anchors.places(10 << 30, 600) == (600, 3)


@pytest.mark.parametrize("module", [suffix_dedup, substring_dedup])
def test_rows_of_the_exchanges(module):
    """A slice answers all groups in one batch, and a group hears of a gram once in each step."""
    own = module.Bytes if module is suffix_dedup else module.WordSymbols
    m = _anchors.Method(module.LENGTH, module.GRAM, own, module.pack, module.resolve, module._digests, module.DIGESTS)
    rnd = random.Random(5)
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(g << _anchors.GROUP_BITS | i, f"{rnd.random()} {passage} {rnd.random()}") for g in range(12) for i in range(3)]
    groups = [pa.table({"grp": [g] * 3, "doc_id": pa.array([d for d, _ in rows[3 * g : 3 * g + 3]], pa.int64()), "text": [t for _, t in rows[3 * g : 3 * g + 3]]}) for g in range(12)]

    def to(group, batches, kinds):
        found = [(r["kind"], r["payload"]) for b in batches for r in b.to_pylist() if r["grp"] == group and r["kind"] in kinds]
        return pa.table({"kind": pa.array([k for k, _ in found], pa.int32()), "payload": pa.array([p for _, p in found], pa.binary())})

    told = pa.concat_tables([_anchors._tell(g, m, 1, 1) for g in groups])
    said = list(_anchors._meet_slice(told["grp"].to_pylist(), told["payload"].to_pylist(), _anchors.HOT))
    asked = pa.concat_tables([_anchors._send(g, to(i, said, {_anchors.ASK_ROW}), m, 1, 1) for i, g in enumerate(groups)])
    found = list(_anchors._resolve_slice(asked["grp"].to_pylist(), asked["kind"].to_pylist(), asked["payload"].to_pylist(), m))
    assert len(found) == 1 and sorted(found[0]["grp"].to_pylist()) == list(range(12))
    for i in range(12):
        asks, settled = (_anchors._said(to(i, said, {k}), k)["fp"].tolist() for k in (_anchors.ASK_ROW, _anchors.SINGLE_ROW))
        assert asks and len(set(asks + settled)) == len(asks + settled)
    done = [r for i, g in enumerate(groups) for r in _anchors._mark(g, to(i, said + found, {_anchors.SINGLE_ROW, _anchors.CONTEXT_ROW, _anchors.HOT_ROW}), m).to_pylist()]
    want = bytes_of(rows) if module is suffix_dedup else words_of(rows)
    assert sorted((str(r["doc_id"]), *[v for k, v in r.items() if k != "doc_id"]) for r in done) == want


def test_packed_runs_are_sorted_and_whole():
    rnd = random.Random(4)
    n = 400
    text = [bytes(rnd.choice(b"\0\0ab") for _ in range(rnd.randint(50, 56))) for _ in range(n)]
    left = np.array([rnd.randint(max(0, len(t) - 50), 30) for t in text])
    place = np.sort(np.array([rnd.randint(0, 5) for _ in range(n)]))
    fp, ch, windows, first = (np.array([rnd.randint(0, top) for _ in range(n)], np.uint64) for top in (3, 2**64 - 1, 31, 1023))
    got = {p: suffix_dedup.unpack(x) for p, x in suffix_dedup.pack(_anchors.Contexts(place, fp, ch, left, windows, first, first, text))}
    assert sorted(got) == sorted(set(place.tolist()))
    for p, (rec, keys, lefts) in got.items():
        want = sorted((int(fp[i]).to_bytes(6, "big") + text[i][left[i] :], text[i][: left[i]], int(ch[i]), int(windows[i]), int(first[i])) for i in np.flatnonzero(place == p))
        assert keys == [w[0] for w in want]
        assert sorted(zip(keys, lefts, rec["ch"].tolist(), rec["n"].tolist(), rec["first"].tolist())) == want
        assert rec["shared"].tolist() == [0] + [suffix_dedup.shared_prefix(a, b) for a, b in zip(keys, keys[1:])]
