import re

import numpy as np
import pytest
import xxhash

from tesserae.llm import simhash


def one(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute(rows):
    """{(doc_id, fingerprint): ...} by comparing all pairs."""
    fps = [f for _, f in rows]
    near = [[j for j, g in enumerate(fps) if j != i and (f ^ g).bit_count() <= 3] for i, f in enumerate(fps)]
    comp = [None] * len(rows)
    for i in range(len(rows)):
        if comp[i] is None:
            todo, seen = [i], {i}
            while todo:
                for j in near[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            ids = [rows[j][0] for j in seen if rows[j][0] is not None]
            for j in seen:
                comp[j] = min(ids, default=None)
    return sorted((str(d), f"{f:016x}", len(n), c) for (d, f), n, c in zip(rows, near, comp))


@pytest.mark.parametrize("hot", [simhash.HOT, 2])
def test_groups_match_brute_force(spark, clashing, hot):
    want = brute([(r.doc_id, one(r.text)) for r in clashing.collect()])
    got = sorted((str(r.doc_id), r.fingerprint, r.n_near, r.component_id) for r in simhash.groups(clashing, hot).collect())
    assert got == want


def test_every_near_pair_meets_once_at_each_step():
    rng = np.random.default_rng(5)
    path = int(rng.integers(0, 16))
    for depth in range(simhash.STEPS):
        masks, taken = simhash.steps(path)[-1]
        free = [b for b in range(64) if not int(masks[taken]) >> b & 1]
        for mask in (more := simhash.longer(int(masks[taken]))):
            assert int(mask) & int(masks[taken]) == int(masks[taken])
        for _ in range(200):
            x = sum(1 << b for b in rng.choice(free, 3, replace=False).tolist())
            assert any(x & int(m) == 0 for m in more)
        path = (path & 0xFFF | (depth + 1) << 12) + (int(rng.integers(0, 4)) << (4 + 2 * depth))
    masks, taken = simhash.steps(path)[-1]
    assert 64 - int(masks[taken]).bit_count() <= 12


@pytest.mark.parametrize("hot", [simhash.HOT, 1, 5, 70])
def test_links_of_clustered_fingerprints(spark, hot):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 8, dtype=np.uint64)
    fps = {int(b) for b in base} | {0}
    for b in base.tolist():
        for _ in range(120):
            x = b
            for bit in rng.integers(0, 64, rng.integers(1, 6)).tolist():
                x ^= 1 << bit
            fps.add(x)
    rows = list(enumerate(fps))
    signed = [(i, f - 2**64 if f >= 2**63 else f) for i, f in rows] + [(10_000, 0)]
    df = spark.createDataFrame(signed, "doc_id long, fp long")
    got = {r.fp % 2**64: (r.n_near, r.component_id) for r in simhash.classes(df, hot).collect()}
    want = {int(f, 16): (n, c) for _, f, n, c in brute(rows + [(10_000, 0)])}
    assert got == want


@pytest.mark.parametrize("hot", [20, 50])
def test_hot_tiles_with_empty_neighbours(spark, hot):
    # 320 of one population count, so that tiles of over 64 have neighbours without rows; and one of three bits more.
    low = [1 << i for i in range(20)]
    fps = [(2**20 - 1) ^ a ^ (1 << b) for a in low for b in range(20, 36)] + [2**23 - 1]
    signed = list(enumerate(fps))
    df = spark.createDataFrame(signed, "doc_id long, fp long")
    got = {r.fp: (r.n_near, r.component_id) for r in simhash.classes(df, hot).collect()}
    assert got == {int(f, 16): (n, c) for _, f, n, c in brute(signed)}


def test_representatives_keep_one_of_each_group(spark, documents, clashing):
    kept = simhash.representatives(documents).collect()
    rows = [(r.doc_id, one(r.text)) for r in documents.collect()]
    fps = {r.fp % 2**64: r.root for r in simhash.classes(simhash.with_fingerprint(documents)).collect()}
    groups = {}
    for d, f in rows:
        k = (d is None, d or 0, f if f < 2**63 else f - 2**64)
        groups[fps[f]] = min(groups.get(fps[f], k), k)
    assert sorted(groups.values()) == sorted((r.doc_id is None, r.doc_id or 0, (lambda f: f if f < 2**63 else f - 2**64)(one(r.text))) for r in kept)
    assert simhash.representatives(clashing).columns == clashing.columns


def test_representatives_of_distinct_ids(spark, documents):
    df = documents.where("doc_id < 107")
    kept = simhash.representatives(df).collect()
    assert {r.doc_id for r in kept} == {r.component_id for r in simhash.groups(df).collect()} and len(kept) == len({r.doc_id for r in kept})


def test_empty_table(documents):
    assert simhash.groups(documents.limit(0)).count() == 0
    assert simhash.representatives(documents.limit(0)).count() == 0
