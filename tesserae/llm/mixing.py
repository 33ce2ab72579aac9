"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources in code point order, null last, weigh 1, 2, 3, 1, ... and share the
words of all documents; no target exceeds 3 times its source (the excess goes
to the others by weight). A source first gives complete epochs, then a fraction:
its documents by ascending key -ln(u) / quality weight, up to its word budget.
The last one is taken where that brings the total nearer. u comes from a digest
of doc_id, so reruns agree.

A source may hold any share of the rows. Its order isn't sorted as a whole: keys
fall into 65,536 ranges of equal probability, sums by (source, range) find the
range where the budget ends, and only that range is ordered.

Defined results: null and empty texts have size 0 and give no words; a source of
size 0 has target 0; rows that share doc_id and key are taken or left together;
extra columns are ignored by ``plan`` and kept by ``sample``; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import checkpoint, small_side

RANGES = 65536
CAP = 3
WEIGHTS = (1, 2, 3)
_NOISE = "#*$%&|<>0123456789"


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for prose; less the more symbols and digits a text holds, 0.05 at least."""
    n = F.length(text)
    noise = n - F.length(F.translate(text, _NOISE, ""))
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(4.0) * F.coalesce(noise, F.lit(0)) / F.greatest(F.coalesce(n, F.lit(0)), F.lit(1)))


def uniform(doc_id: Column) -> Column:
    """In (0, 1), from the first 48 bits of the id's digest."""
    digest = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12)
    return (F.conv(digest, 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(2**48))


def keyed(docs: DataFrame) -> DataFrame:
    """The documents with the columns that decide: _size, _key, _range, _source."""
    docs = docs.withColumns({"_size": size(F.col("text")), "_key": -F.log(uniform(F.col("doc_id"))) / quality_weight(F.col("text"))})
    return docs.withColumns({"_range": F.least(F.floor((F.lit(1.0) - F.exp(-F.col("_key"))) * RANGES).cast("long"), F.lit(RANGES - 1)), "_source": F.col("source").cast("string")})


def targets(sizes: DataFrame) -> DataFrame:
    """(_source, source_size) with a target each: the level at which capped shares use up all words."""
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    cycle = (F.row_number().over(order) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (cycle + 1).cast("int"))
    t = sizes.withColumn("_w", weight.cast("long")).withColumn("_cap", CAP * F.col("source_size"))
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last())
    done = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumns({
        "_left": F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(done), F.lit(0)),
        "_weights": F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(done), F.lit(0)),
    })
    open_ = F.col("_left") * F.col("_w") < F.col("_cap") * F.col("_weights")
    level = F.min(F.when(open_, F.struct(F.col("_cap") / F.col("_w"), F.col("_left"), F.col("_weights")))).over(everything)
    t = t.withColumn("_level", level)
    share = F.col("_level._left").cast("double") * F.col("_w") / F.col("_level._weights")
    return t.select("_source", "source_size", F.when(F.col("_level").isNull(), F.col("_cap").cast("double")).otherwise(F.least(F.col("_cap").cast("double"), share)).alias("target"))


def source_plan(slim: DataFrame) -> DataFrame:
    """One row per source: size, target, epochs, and the last document of the fraction as (cut range, key, id)."""
    sums = slim.groupBy("_source", "_range").agg(F.sum("_size").alias("_sum"))
    t = targets(sums.groupBy("_source").agg(F.sum("_sum").alias("source_size")))
    t = t.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    t = checkpoint(t.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    by = Window.partitionBy("_source").orderBy("_range")
    runs = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    edge = runs.join(small_side(t, 64).select(F.col("_source").alias("_s"), "rest"), F.col("_source").eqNullSafe(F.col("_s")))
    edge = edge.where((F.col("_before") <= F.col("rest")) & (F.col("_before") + F.col("_sum") > F.col("rest"))).select(F.col("_source").alias("_s"), F.col("_range").alias("_edge"), "_before", "rest")
    edge = checkpoint(edge)
    inside = slim.join(small_side(edge, 64), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_edge")))
    local = Window.partitionBy("_s", "_edge").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_size").over(local), F.lit(0)))
    cut = inside.where(2 * F.col("_before") + F.col("_size") <= 2 * F.col("rest")).groupBy("_s").agg(F.max(F.struct("_key", "doc_id")).alias("_cut"))
    marks = edge.select("_s", "_edge").join(cut.withColumnRenamed("_s", "_c"), F.col("_s").eqNullSafe(F.col("_c")), "left").select("_s", "_edge", "_cut")
    out = t.join(marks, F.col("_source").eqNullSafe(F.col("_s")), "left")
    return checkpoint(out.select(F.col("_source").alias("_s"), "source_size", "target", "epochs", "_edge", F.col("_cut._key").alias("_cut_key"), F.col("_cut.doc_id").alias("_cut_id")))


def _decided(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows with ``taken``; the sources' side is broadcast only if measured to be small, and a hot source then isn't shuffled."""
    rows = rows.join(small_side(plan, 96), F.col("_source").eqNullSafe(F.col("_s")))
    same = (F.col("_key") == F.col("_cut_key")) & (F.col("doc_id").eqNullSafe(F.col("_cut_id")) | (F.col("doc_id").isNull() | (F.col("doc_id") < F.col("_cut_id"))))
    chosen = F.when(F.col("_edge").isNull(), F.lit(0)).when(F.col("_range") < F.col("_edge"), F.lit(1)).when((F.col("_range") == F.col("_edge")) & ((F.col("_key") < F.col("_cut_key")) | same), F.lit(1)).otherwise(F.lit(0))
    return rows.withColumn("taken", (F.col("_size") * (F.col("epochs") + chosen)).cast("long")).withColumn("_copies", F.col("epochs") + chosen)


def plan(docs: DataFrame) -> DataFrame:
    """Words that the mix takes of each document."""
    slim = checkpoint(keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "source")).select("doc_id", "_source", "_size", "_key", "_range"))
    return _decided(slim, source_plan(slim)).select("doc_id", F.col("_size").alias("size"), "source_size", "target", "taken")


def sample(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with all its columns. Texts aren't shuffled."""
    # All columns in one, so that none can clash with those that decide.
    rows = keyed(docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "source"))
    slim = checkpoint(rows.select("doc_id", "_source", "_size", "_key", "_range"))
    # From here on only whether a text has words counts; they are counted once.
    rows = rows.withColumn("_size", F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).cast("int")).drop("text")
    mixed = _decided(rows, source_plan(slim)).where((F.col("_size") > 0) & (F.col("_copies") > 0))
    return mixed.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")


ORACLE_SQL = f"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
  greatest(0.05::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * coalesce(length(text) - length(translate(text, '{_NOISE}', '')), 0) / greatest(coalesce(length(text), 0), 1)) AS q,
  (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / {2**48}.0::DOUBLE AS u FROM documents),
k AS (SELECT *, -ln(u) / q AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
f AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lft,
  CAST(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ws FROM w),
l AS (SELECT lft AS l_left, ws AS l_ws FROM f WHERE lft * w < cap * ws ORDER BY cap / w, source NULLS LAST LIMIT 1),
t AS (SELECT f.source, f.source_size, CASE WHEN l_ws IS NULL THEN f.cap::DOUBLE ELSE least(f.cap::DOUBLE, l_left::DOUBLE * f.w / l_ws) END AS target FROM f LEFT JOIN l ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
b AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
  coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM b"""
