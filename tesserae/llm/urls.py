"""URL filters: host and path rules, then a weighted vocabulary found by Aho-Corasick.

Every url is judged in the scan, without a shuffle. A hit counts where neither
neighbour of the term, in the lower-cased url, is an ASCII letter or digit. One strict
term, or enough weight of distinct soft terms, blocks a url that no rule fits.

The vocabulary is a file of lines term, kind (strict or soft), weight and topic.
``url_terms.tsv`` beside this module is one of 469 terms (86 strict), written for
this package: words of addresses of nine kinds of unwanted sites in English, German,
French and Spanish, with the supplied tables' hosts in view; another file is a
parameter. It travels in the
plan of each task, so it is meant for up to some 100,000 terms; ``Vocabulary.load``
refuses files of over 8 MB.

Defined results: a null url, or one without "://", has an empty host and path,
fits no rule, and is judged by its terms (a null one is allowed); repeated rows
are judged alike; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import csv
import os
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._words import LOWER

_LOWER = LOWER.tobytes()
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


TERMS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "url_terms.tsv")
MOST_BYTES = 8 << 20


@dataclass(frozen=True)
class Vocabulary:
    """Terms in lower case. Soft ones block together, by the summed weight of those that differ."""

    strict: frozenset[str]
    soft: dict[str, int]
    limit: int = 3  #: summed weight of distinct soft terms
    distinct: int = 2  #: and at least so many of them

    @classmethod
    def load(cls, path: str = TERMS, limit: int = 3, distinct: int = 2) -> Vocabulary:
        if os.path.getsize(path) > MOST_BYTES:
            raise ValueError(f"{path} has over {MOST_BYTES} bytes")
        strict, soft = set(), {}
        with open(path, encoding="utf-8") as f:
            for row in csv.DictReader(f, delimiter="\t", quoting=csv.QUOTE_NONE):
                if row["kind"] not in ("strict", "soft") or not row["term"] or row["term"] != row["term"].lower() or row["term"] in strict or row["term"] in soft:
                    raise ValueError(f"{path}: {row}")
                if row["kind"] == "strict":
                    strict.add(row["term"])
                else:
                    soft[row["term"]] = int(row["weight"])
        return cls(frozenset(strict), soft, limit, distinct)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1]), reverse=True):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = (F if name is None else name).when(fits, F.lit(h + p))
        verdict = (F if verdict is None else verdict).when(fits, F.lit(v))
    if name is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return name, verdict


class Matcher:
    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.machine = ahocorasick.Automaton()
        for t in {*v.strict, *v.soft}:
            self.machine.add_word(t, t)
        self.machine.make_automaton()

    def __call__(self, url: str | None) -> tuple[int, int, int, bool]:
        """(strict hits, soft hits, weight of the distinct soft terms, blocked)."""
        if not url:
            return 0, 0, 0, False
        low = url.encode().translate(_LOWER).decode()
        strict, soft, met = 0, 0, set()
        for end, term in self.machine.iter(low):
            a, b = end - len(term), end + 1
            if a >= 0 and low[a].isascii() and low[a].isalnum() or b < len(low) and low[b].isascii() and low[b].isalnum():
                continue
            if term in self.v.strict:
                strict += 1
            else:
                soft += 1
                met.add(term)
        weight = sum(self.v.soft[t] for t in met)
        return strict, soft, weight, strict > 0 or len(met) >= self.v.distinct and weight >= self.v.limit


def judge(pages: DataFrame, rules=RULES, vocabulary: Vocabulary | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and term counts for every url; by ``url_terms.tsv`` if no vocabulary is given."""
    vocabulary = vocabulary or Vocabulary.load()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(vocabulary)
        for batch in batches:
            found = [match(u) for u in batch.column("url").to_pylist()]
            cols = list(zip(*found)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.bool_())],
                ["page_id", "url", "n_strict", "n_soft", "soft_weight", "blocked"],
            )

    got = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(run, "page_id long, url string, n_strict long, n_soft long, soft_weight long, blocked boolean")
    got = got.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "n_strict", "n_soft", "soft_weight", "blocked")
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    return got.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"), "n_strict", "n_soft", "soft_weight")


def oracle_sql(rules=RULES, v: Vocabulary | None = None) -> str:
    """The same in DuckDB, for terms of letters and digits only: a term with boundaries is then a maximal run of them."""
    v = v or Vocabulary.load()
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fit = [(f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')", h + p, k) for h, p, k in sorted(rules, key=lambda r: len(r[0] + r[1]), reverse=True)]
    name = " ".join(f"WHEN {f} THEN '{n}'" for f, n, _ in fit)
    verdict = " ".join(f"WHEN {f} THEN '{k}'" for f, _, k in fit)
    terms = ", ".join([f"('{t}', true, 0)" for t in sorted(v.strict)] + [f"('{t}', false, {w})" for t, w in sorted(v.soft.items())])
    return f"""WITH v(term, strict, weight) AS (VALUES {terms}),
u AS (SELECT row_number() OVER () AS r, page_id, coalesce(translate(url, '{upper}', '{lower}'), '') AS low,
  coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
t AS (SELECT r, term, count(*) AS n FROM (SELECT r, unnest(regexp_extract_all(low, '[a-z0-9]+')) AS term FROM u) GROUP BY r, term),
m AS (SELECT r, sum(n) FILTER (strict) AS n_strict, sum(n) FILTER (NOT strict) AS n_soft, sum(weight) FILTER (NOT strict) AS soft_weight, count(*) FILTER (NOT strict) AS met FROM t JOIN v USING (term) GROUP BY r)
SELECT page_id, host, path, CASE {name} END AS rule,
  CASE {verdict} WHEN coalesce(n_strict, 0) > 0 OR (met >= {v.distinct} AND soft_weight >= {v.limit}) THEN 'block' ELSE 'allow' END AS verdict,
  CAST(coalesce(n_strict, 0) AS BIGINT) AS n_strict, CAST(coalesce(n_soft, 0) AS BIGINT) AS n_soft, CAST(coalesce(soft_weight, 0) AS BIGINT) AS soft_weight FROM u LEFT JOIN m USING (r)"""
