import re
from collections import defaultdict

import pytest

from tesserae.llm import mixing

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes):
    """Shares by weight, the excess over 3 times the source handed on until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full, left = set(), dict(sizes)
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        share = {s: rest * weight[s] / total for s in open_}
        over = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else share[s] for s in left}
        full |= over
        if len(full) == len(names):
            return {s: 3.0 * sizes[s] for s in left}


def rows_of(df):
    return [(r.doc_id, len(re.findall(WORD, r.text or "")), r.source) for r in df.collect()]


@pytest.mark.parametrize("table", ["documents", "clashing"])
def test_plan(request, table):
    df = request.getfixturevalue(table)
    src = rows_of(df)
    sizes = defaultdict(int)
    for _, n, s in src:
        sizes[s] += n
    want = targets(sizes)
    by_size = {(str(d), n): s for d, n, s in src}
    got = mixing.plan(df).collect()
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(d), n) for d, n, _ in src)
    taken = defaultdict(int)
    for r in got:
        s = by_size[str(r.doc_id), r["size"]]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert 0 <= r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[s] += r.taken
    largest = {s: max(n for _, n, t in src if t == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(df.repartition(5)).collect()))


def test_hot_source_and_ranges(spark):
    rows = [(i, "w " * (i % 9 + 1), "hot" if i % 3 else f"s{i % 5}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan(df).collect()
    by = defaultdict(lambda: [0, 0.0])
    for r in got:
        by[rows[r.doc_id][2]][0] += r.taken
        by[rows[r.doc_id][2]][1] = r.target
    assert all(abs(t - w) <= 9 for t, w in by.values()) and sum(w for _, w in by.values()) == pytest.approx(sum(r["size"] for r in got))


def test_sample_repeats_what_is_taken(spark, clashing):
    taken = defaultdict(int)
    for r in mixing.plan(clashing).collect():
        taken[str(r.doc_id)] += r.taken
    out = mixing.sample(clashing)
    assert out.columns == clashing.columns and out.dtypes == clashing.dtypes
    words = defaultdict(int)
    for d, n, _ in rows_of(out):
        words[str(d)] += n
    assert words == {d: n for d, n in taken.items() if n}
    assert mixing.plan(clashing.limit(0)).count() == mixing.sample(clashing.limit(0)).count() == 0


def test_one_source_and_sizes_of_zero(spark):
    one = spark.createDataFrame([(1, "a b", None), (2, None, None), (3, "", None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r["size"], r.target, r.taken) for r in mixing.plan(one).collect()) == [(1, 2, 2.0, 2), (2, 0, 2.0, 0), (3, 0, 2.0, 0)]
    none = one.where("doc_id > 1")
    assert [(r.target, r.taken) for r in mixing.plan(none).collect()] == [(0.0, 0)] * 2
