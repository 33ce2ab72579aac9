import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from tesserae.llm import sketch


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def by_hand(rows):
    """Texts, edited texts and true likenesses, by sets of shingles."""
    src = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    for i, (d, t) in enumerate(src):
        t, nxt = t or "", src[(i + 1) % len(src)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        a, b, c = shingles(t), shingles(e), shingles(nxt)
        yield (str(d), len(t), hashlib.sha256(e.encode()).hexdigest()), t, e, (len(a | b), jaccard(a, b)), (len(a | c), jaccard(a, c)), len(a)


@pytest.mark.parametrize("parts", [1, 5])
def test_rows_match_brute_force(spark, clashing, parts):
    src = [(r.doc_id, r.text) for r in clashing.collect()]
    want = sorted(by_hand(src), key=lambda w: (w[0], w[4][1]))
    got = sorted(sketch.fingerprint_neighbours(clashing.repartition(parts)).collect(), key=lambda r: (str(r.doc_id), r.n_chars, r.edited_sha256, r.near_next))
    assert [(str(r.doc_id), r.n_chars, r.edited_sha256) for r in got] == [w[0] for w in want]
    fingerprint = {}
    for r, (_, t, e, (n, edited), (m, after), size) in zip(got, want):
        # Exact where k hashes hold all shingles of both, else within the sketch's error.
        assert r.near_edited == pytest.approx(edited, abs=1e-12 if n <= sketch.K else 0.2)
        assert r.near_next == pytest.approx(after, abs=1e-12 if m <= sketch.K else 0.2)
        assert r.n_shingles == pytest.approx(size, abs=0 if size < sketch.K else size * 0.35)
        for text, f in ((t, r.fingerprint), (e, r.edited_fingerprint)):
            assert fingerprint.setdefault(frozenset(shingles(text)), f) == f
    assert len(set(fingerprint.values())) == len(fingerprint)


def test_ids_far_apart_and_shared(spark):
    ids = [*range(-3000, 3000, 7), 2**62, -(2**62), 2**40, 2**40 + 5, None, None, *[77] * 1500, *[2**40] * 3]
    src = [(d, None if i % 97 == 5 else f"text {i % 400} of some words {i % 13}") for i, d in enumerate(ids)]
    got = sketch.fingerprint_neighbours(spark.createDataFrame(src, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(w[0] for w in by_hand(src))


def texts(*words):
    return pa.array([" ".join(w).encode() for w in words], pa.large_binary())


def test_estimates_are_near_the_truth():
    n = 6000
    a, b = [f"a{i}" for i in range(n)], [f"a{i}" for i in range(n // 3, n)] + [f"b{i}" for i in range(n // 3)]
    x, y = sketch.sketches(texts(a, b))
    assert abs(sketch.resemblance(x, y) - 0.5) < 0.15
    assert abs(sketch.containment(x, y) - 2 / 3) < 0.2
    assert abs(sketch.distinct(x) / n - 1) < 0.35


def test_merge_equals_sketch_of_all():
    h = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    parts = [h[::2][: sketch.K], h[1::2][: sketch.K]]
    assert (sketch.merge(parts) == h[: sketch.K]).all() and len(sketch.merge([])) == 0
    assert (sketch.decode(sketch.encode(h[:9])) == h[:9]).all()


def test_edges(documents):
    e = np.zeros(0, np.uint64)
    one = np.array([5], np.uint64)
    assert sketch.resemblance(e, e) == 1 and sketch.resemblance(e, one) == 0 and sketch.containment(e, one) == 1 and sketch.containment(one, e) == 0
    assert sketch.fingerprint_neighbours(documents.limit(0)).count() == 0
    assert sketch.fingerprint_neighbours(documents.where("doc_id = 102")).first().edited_sha256 == hashlib.sha256(b"wowo").hexdigest()
