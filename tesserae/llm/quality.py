"""Quality rules by suffix arrays: how much of a text repeats other parts of it.

The alphabet is the text's words. A batch of texts is sorted at once by prefix
doubling in numpy; after each round only suffixes that still share a rank are
sorted again. From the ranks of all rounds come the common prefixes of
neighbouring suffixes; the intervals of that array are the maximal repeated
word strings. The union of their spans gives the covered fraction.

A text that meets the base rules is rejected for its repetition alone: if the
repeated strings of ``span`` or more words cover more than ``max_covered`` of it,
or the longest one has more than ``max_longest`` words. Symbols and repeated
lines are measured, but don't decide. The limits lie between what clean prose and
repetitive texts show in the supplied tables (README).

Each text is judged on its own, in one pass without a shuffle.

Defined results: a null or empty text has no words and fails the base rules;
repeated rows are judged alike; other columns, whatever their names, are
ignored by ``judge`` and kept by ``keep``; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import IS_CHAR, IS_SPACE, Words, byte_list, per_doc, slices, words

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_fraction double, longest_repeat long"
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = b" \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict, in words; a text at a limit passes."""

    min_words: int = 50
    max_repeat_percent: int = 50  #: words in 3-word windows that recur
    span: int = 8  #: shortest repeat that counts as covered
    max_covered: float = 0.3
    max_longest: int = 50


def suffix_ranks(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of the texts' words, and the suffixes' ranks by their first 1, 2, 4, ... words.

    Suffixes end with their text, so none equals one of another text.
    """
    n = len(ids)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    stop = first[1:][owner]
    key = owner * (int(ids.max(initial=0)) + 1) + ids
    sa = np.argsort(key, kind="stable")
    new = np.empty(n, bool)
    new[:1] = True
    new[1:] = key[sa[1:]] != key[sa[:-1]]
    lead = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = lead
    levels, h = [rank.copy()], 1
    while True:
        alone = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            return sa, levels
        at = sa[open_]
        then = at + h
        key = rank[at] * (n + 1) + np.where(then < stop[at], rank[np.minimum(then, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        sa[open_], key = at[by], key[by]
        fresh = np.empty(len(open_), bool)
        fresh[0] = True
        fresh[1:] = key[1:] != key[:-1]
        new[open_] = fresh
        lead = np.maximum.accumulate(np.where(fresh, open_, 0))
        rank[sa[open_]] = lead
        levels.append(rank.copy())
        h *= 2


def longest_repeats(ids: np.ndarray, first: np.ndarray, least: int = 2) -> np.ndarray:
    """For each word, the words in the longest string from it that also starts elsewhere in its text; lengths below ``least`` may be given as 0."""
    n = len(ids)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    sa, levels = suffix_ranks(ids, first)
    low = min(max(least, 1).bit_length() - 1, len(levels) - 1)
    near = np.flatnonzero(levels[low][sa[1:]] == levels[low][sa[:-1]])
    i, j = sa[near].copy(), sa[near + 1].copy()
    common = np.zeros(len(near), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        ranks = levels[level]
        p, q = i + common, j + common
        same = (p < n) & (q < n)
        same &= ranks[np.minimum(p, n - 1)] == ranks[np.minimum(q, n - 1)]
        common += same << level
    np.maximum.at(out, sa[near], common)
    np.maximum.at(out, sa[near + 1], common)
    return out


def covered(lengths: np.ndarray, at_least: int) -> np.ndarray:
    """Which words lie in the union of the spans [i, i + lengths[i]) of ``at_least`` or more words."""
    n = len(lengths)
    reach = np.where(lengths >= at_least, np.arange(n) + lengths, 0)
    return np.maximum.accumulate(reach) > np.arange(n) if n else np.zeros(0, bool)


def _dup_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    return len(lines) - len(set(lines))


def measure(texts: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    w: Words = words(texts)
    ids, _ = w.ids()
    n = w.counts
    lengths = longest_repeats(ids, w.first)
    within = np.minimum(lengths, 3)
    repeat = per_doc(covered(np.where(within == 3, 3, 0), 3), w.first)
    cover = per_doc(covered(lengths, rules.span), w.first)
    longest = np.zeros(len(n), np.int64)
    np.maximum.at(longest, w.owner(), lengths)
    longest[longest < 2] = 0
    chars = per_doc(IS_CHAR[w.buf] & ~IS_SPACE[w.buf], w.docs)
    symbols = per_doc(IS_SYMBOL[w.buf], w.docs)
    rows = byte_list(texts)
    dup = np.fromiter((_dup_lines(t) for t in rows), np.int64, len(rows))
    base = (n < rules.min_words) | (100 * repeat > rules.max_repeat_percent * n)
    fraction = cover / np.maximum(n, 1)
    bad = (fraction > rules.max_covered) | (longest > rules.max_longest)
    return {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "base_failed": base, "kept": ~base & ~bad, "covered_fraction": fraction, "longest_repeat": longest}


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row of measures and verdict per document (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch):
                m = measure(texts, rules)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(x) for x in m.values())], ["doc_id", *m])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with all their columns; decided in the scan, so without a join."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch):
                yield rows.filter(pa.array(measure(texts, rules)["kept"]))

    return docs.mapInArrow(run, schema)
