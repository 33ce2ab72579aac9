"""The registered queries of the engine's own operators on the supplied tables, with their DuckDB SQL.

Documents and pages stand for stored objects with bytes, orders for a large
listing without; documents with their labels make a graph of items and
descriptors whose gaps are natural violations.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as fn
from . import plans, sources
from .model import CORE_METHODS, GIB, METHODS, PREFIXES, RDF_TYPE, ROBUSTNESS, Method, classes, iri
from .operators import annotate, checks, checksum, rdf
from .session import checkpoint, inline
from .sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KB = Method("md5-1kb", "md5", 1024)


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# Views


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def objects(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as objects with bytes."""
    d = table(spark, sf, "documents")
    return d.select(F.col("source").alias("bucket"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("key"), F.octet_length("text").cast("bigint").alias("size"), F.encode("text", "UTF-8").alias("content"))


def listing(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a listing of large objects."""
    o = table(spark, sf, "orders")
    return o.select(F.lit("store").alias("bucket"), F.concat(F.lit("obj/"), F.col("o_orderkey").cast("string")).alias("key"), F.col("o_orderdate").alias("last_modified"), F.col("o_orderstatus").alias("etag"), F.floor(F.col("o_totalprice") * 100000).cast("bigint").alias("size"))


OBJECTS = "objects AS (SELECT source AS bucket, source || '/' || doc_id AS key, strlen(text) AS size, encode(text) AS content FROM documents)"
LISTING = "listing AS (SELECT 'store' AS bucket, 'obj/' || o_orderkey AS key, o_orderdate AS last_modified, o_orderstatus AS etag, CAST(floor(o_totalprice * 100000) AS BIGINT) AS size FROM orders)"
_HUMAN = "CASE " + " ".join(f"WHEN {{0}} >= {2**p} THEN printf('%.1f', {{0}} / {2**p}.0) || ' {u}'" for p, u in fn.UNITS) + " ELSE CAST({0} AS VARCHAR) END"


def human_sql(x: str) -> str:
    return _HUMAN.replace("{0}", x)


# Sources, listing


@query("src01_list_prefix", f"WITH {OBJECTS} SELECT bucket, key, CAST(size AS BIGINT) AS size FROM objects WHERE starts_with(key, 'src1')")
def _(spark, sf):
    return sources.list_table(objects(spark, sf).select("bucket", "key", "size"), "src1")


@query("src03_api_rows", "SELECT 'pages' AS bucket, url AS key, CAST(strlen(html) AS BIGINT) AS size FROM pages")
def _(spark, sf):
    api = table(spark, sf, "pages").select(F.col("url").alias("Key"), F.lit(None).cast("timestamp").alias("LastModified"), F.lit(None).cast("string").alias("ETag"), F.octet_length("html").alias("Size"))
    return sources.from_api(api, "pages").select("bucket", "key", "size")


@query("agg01_02_listing_totals", f"WITH {LISTING} SELECT count(*) AS num_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_size FROM listing")
def _(spark, sf):
    return plans.totals(listing(spark, sf))


_TASK = "url || ' ' || size || ' ' || method || ' ' || block_size || ' ' || \"offset\""


def task_sql(m: Method, view: str = "listing") -> str:
    """CTE t: tasks of a view."""
    small = f"(size < {plans.SMALL_BYTES} OR size < {m.block_size} / 2.0)"
    own = "1" if not m.block_size else f"CAST(ceil(size / {m.block_size}.0) AS BIGINT)"
    return f"""b AS (SELECT *, CASE WHEN {small} THEN 0 ELSE {own} END AS n FROM {view}),
r AS (SELECT *, CAST(coalesce(sum(n) OVER (ORDER BY key, bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, CAST(sum(n) OVER () AS BIGINT) AS total FROM b),
t AS (SELECT CASE WHEN n = 0 THEN total + 1 ELSE before + i + 1 END AS task_num, 's3://' || bucket || '/' || key AS url, size, '{m.id}' AS method, CAST({m.block_size} AS BIGINT) AS block_size, CAST(i * {m.block_size} AS BIGINT) AS "offset"
  FROM (SELECT *, unnest(range(0, greatest(n, 1))) AS i FROM r))"""


@query("src06_07_parse_task_lines", f"WITH {LISTING}, {task_sql(METHODS['md5-8gb'])} SELECT url, size, method, block_size, \"offset\" FROM t")
def _(spark, sf):
    t = plans.plan_tasks(listing(spark, sf), METHODS["md5-8gb"])
    lines = t.select(F.concat(F.lit("  "), fn.task_line(F.col("url"), F.col("size"), F.col("method"), F.col("block_size"), F.col("offset")), F.lit(" \n")).alias("value"))
    return sources.task_rows(lines.unionAll(inline(spark, [("",), ("   ",)], "value string")))


@query("src04_range_md5_1000", f"WITH {OBJECTS} SELECT key, md5(content[101:1100]) AS checksum FROM objects")
def _(spark, sf):
    return objects(spark, sf).select("key", checksum.range_checksum(F.col("content"), F.lit(100), F.lit(1000)).alias("checksum"))


# Scalars


@query("scl01_human_size", f"WITH {LISTING} SELECT key, {human_sql('size')} AS text, {human_sql('(size * 1000)')} AS larger, {human_sql('(size // 100000)')} AS smaller FROM listing")
def _(spark, sf):
    return listing(spark, sf).select("key", fn.human_size(F.col("size")).alias("text"), fn.human_size(F.col("size") * 1000).alias("larger"), fn.human_size(F.expr("size div 100000")).alias("smaller"))


@query("scl04_parse_url", "SELECT page_id, split_part(u, '/', 1) AS bucket, CASE WHEN strpos(u, '/') > 0 THEN substr(u, strpos(u, '/') + 1) END AS key FROM (SELECT page_id, replace('s3://pages/' || url, 's3://', '') AS u FROM pages)")
def _(spark, sf):
    bucket, key = fn.parse_url(F.concat(F.lit("s3://pages/"), "url"))
    return table(spark, sf, "pages").select("page_id", bucket.alias("bucket"), key.alias("key"))


@query("scl05_range_header", "SELECT l_orderkey, l_linenumber, 'bytes=' || l_partkey || '-' || CASE WHEN l_quantity > 25 AND l_suppkey <> 0 THEN CAST(l_partkey + l_suppkey - 1 AS VARCHAR) ELSE '' END AS header FROM lineitem")
def _(spark, sf):
    length = F.when(F.col("l_quantity") > 25, F.col("l_suppkey")).otherwise(F.lit(0))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", fn.range_header(F.col("l_partkey"), length).alias("header"))


@query("scl06_08_listing_line", f"WITH {LISTING} SELECT 's3://' || bucket || '/' || rpad(key, CAST(greatest(110, length(key)) AS INTEGER), ' ') || ': ' || rpad(h, CAST(greatest(12, length(h)) AS INTEGER), ' ') || ' ' || strftime(last_modified, '%Y-%m-%d') || ' ' || etag AS line FROM (SELECT *, {human_sql('size')} AS h FROM listing)")
def _(spark, sf):
    return listing(spark, sf).select(fn.listing_line(F.col("bucket"), F.col("key"), F.col("size"), F.col("last_modified"), F.col("etag")).alias("line"))


@query("scl07_task_line", f"WITH {LISTING}, {task_sql(METHODS['md5'])} SELECT task_num, {_TASK} AS line FROM t")
def _(spark, sf):
    t = plans.plan_tasks(listing(spark, sf), METHODS["md5"])
    return t.select("task_num", fn.task_line(F.col("url"), F.col("size"), F.col("method"), F.col("block_size"), F.col("offset")).alias("line"))


@query("scl11_methods", "SELECT * FROM (VALUES " + ", ".join(f"('{m}', CAST({METHODS[m].block_size} AS BIGINT), {METHODS[m].needs_offsets})" for m in CORE_METHODS) + ") v(id, block_size, needs_offsets)")
def _(spark, sf):
    m = inline(spark, [(METHODS[i].id, METHODS[i].block_size) for i in CORE_METHODS], "id string, block_size long")
    return m.select("id", "block_size", fn.needs_offsets(F.col("block_size")).alias("needs_offsets"))


@query("scl12_curie_expand", f"SELECT doc_id, '{PREFIXES['dat']}doc-' || doc_id AS known, 'other:' || doc_id AS unknown FROM documents")
def _(spark, sf):
    i = F.col("doc_id").cast("string")
    return table(spark, sf, "documents").select("doc_id", fn.expand_curie(F.concat(F.lit("dat:doc-"), i)).alias("known"), fn.expand_curie(F.concat(F.lit("other:"), i)).alias("unknown"))


@query("scl13_curie_contract", "SELECT page_id, 'dat:' || page_id AS known, url AS unknown FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", fn.contract_iri(F.concat(F.lit(PREFIXES["dat"]), F.col("page_id").cast("string"))).alias("known"), fn.contract_iri(F.col("url")).alias("unknown"))


@query("scl14_15_words_integers", "SELECT l_orderkey, l_linenumber, CAST(l_partkey AS BIGINT) AS part, CAST(3 AS INTEGER) AS n FROM lineitem")
def _(spark, sf):
    w = fn.words(F.concat(F.lit("  "), F.col("l_partkey").cast("string"), F.lit("\t x \n y  ")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", fn.integer(w[0]).alias("part"), F.size(w).alias("n"))


@query("scl19_coverage", f"WITH {OBJECTS} SELECT key, CASE WHEN size > 0 THEN least(size, 1024) / size ELSE 1.0 END AS coverage FROM objects")
def _(spark, sf):
    return objects(spark, sf).select("key", fn.coverage(F.least(F.col("size"), F.lit(1024)), F.col("size")).alias("coverage"))


@query("scl02_whole_md5", f"WITH {OBJECTS} SELECT key, md5(content) AS checksum FROM objects")
def _(spark, sf):
    return objects(spark, sf).select("key", fn.digest(F.col("content"), "md5").alias("checksum"))


@query("scl03_sha1", f"WITH {OBJECTS} SELECT key, sha1(content) AS checksum FROM objects")
def _(spark, sf):
    return objects(spark, sf).select("key", fn.digest(F.col("content"), "sha1").alias("checksum"))


@query("scl03_sha256", f"WITH {OBJECTS} SELECT key, sha256(content) AS checksum FROM objects")
def _(spark, sf):
    return objects(spark, sf).select("key", fn.digest(F.col("content"), "sha256").alias("checksum"))


@query("scl03_sha512")
def _(spark, sf):
    return objects(spark, sf).select("key", fn.digest(F.col("content"), "sha512").alias("checksum"))


# Planning


@query("pln01_offsets", "SELECT c_custkey, unnest(range(0, CAST(c_custkey * 10 AS BIGINT), 1000)) AS \"offset\" FROM customer")
def _(spark, sf):
    return plans.explode_offsets(table(spark, sf, "customer").select("c_custkey"), F.lit(1000), F.col("c_custkey") * 10, "offset")


def _route_sql(m: Method) -> str:
    small = f"(size < {plans.SMALL_BYTES} OR size < {m.block_size} / 2.0)"
    own = "1" if not m.block_size else f"ceil(size / {m.block_size}.0)"
    return f"WITH {LISTING} SELECT key, CASE WHEN {small} THEN 'small' ELSE '{'blocks' if m.block_size else 'whole'}' END AS route, CAST(CASE WHEN {small} THEN 0 ELSE {own} END AS BIGINT) AS n_blocks FROM listing"


for _m in CORE_METHODS:
    query(f"pln02_route_{_m.replace('-', '_')}", _route_sql(METHODS[_m]))(lambda spark, sf, m=METHODS[_m]: listing(spark, sf).select("key", plans.route(F.col("size"), m).alias("route"), plans.n_blocks(F.col("size"), m).alias("n_blocks")))
    query(f"pln03_task_numbers_{_m.replace('-', '_')}", f"WITH {LISTING}, {task_sql(METHODS[_m])} SELECT * FROM t")(lambda spark, sf, m=METHODS[_m]: plans.plan_tasks(listing(spark, sf), m))


@query("pln04_small_task", f"WITH {LISTING}, {task_sql(METHODS['md5-8gb'])} SELECT task_num, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM t WHERE task_num = (SELECT max(task_num) FROM t) GROUP BY task_num")
def _(spark, sf):
    t = plans.plan_tasks(listing(spark, sf), METHODS["md5-8gb"])
    return t.where(plans.is_small(F.col("size"), METHODS["md5-8gb"])).groupBy("task_num").agg(F.count(F.lit(1)).alias("objects"), F.sum("size").alias("bytes"))


@query("pln07_block_length", f"WITH {LISTING}, {task_sql(METHODS['md5-2gb'])} SELECT url, \"offset\", CASE WHEN size < {GIB} THEN size ELSE least({2 * GIB}, size - \"offset\") END AS length FROM t")
def _(spark, sf):
    return plans.with_length(plans.plan_tasks(listing(spark, sf), METHODS["md5-2gb"])).select("url", "offset", "length")


@query("pln10_split_reverse", f"WITH {OBJECTS}, p AS (SELECT key, content, unnest(range(0, size, 9)) AS o FROM objects) SELECT key, o AS \"offset\", hex(content[o + 1 : o + 9]) AS piece FROM p")
def _(spark, sf):
    p = table(spark, sf, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("key"), F.posexplode(plans.split_bytes(F.col("text"), 9)).alias("i", "piece"))
    return p.select("key", (F.col("i") * 9).cast("bigint").alias("offset"), F.hex("piece").alias("piece"))


@query("scl20_reverse_trim", "SELECT p_partkey, trim(reverse(p_name || ' '), ' ') AS text FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", fn.reversed_trimmed(F.concat("p_name", F.lit(" "))).alias("text"))


# Checksums, annotations

_BLOCKS = f"""WITH {OBJECTS}, a AS (SELECT 's3://' || bucket || '/' || key AS url, o AS "offset", least(1024, size - o) AS length, 'md5-1kb' AS method, md5(content[o + 1 : o + 1024]) AS checksum
  FROM (SELECT *, unnest(range(0, greatest(size, 1), 1024)) AS o FROM objects))"""


def _annotations(spark, sf) -> DataFrame:
    """Every object is small for the planner, so blocks of 1 KiB are cut here whatever its size."""
    o = objects(spark, sf)
    b = checksum.blocks(F.col("content"), F.col("size"), F.lit(KB.block_size), KB.algorithm)
    rows = o.select(fn.url(F.col("bucket"), F.col("key")).alias("url"), F.explode(b).alias("b"))
    return rows.select("url", "b.offset", "b.length", F.lit(KB.id).alias("method"), "b.checksum")


@query("src04_block_md5", f"{_BLOCKS} SELECT * FROM a")
def _(spark, sf):
    return _annotations(spark, sf)


@query("agg03_object_checksums", f"WITH {OBJECTS} SELECT 's3://' || bucket || '/' || key AS url, CAST(0 AS BIGINT) AS \"offset\", CAST(size AS BIGINT) AS length, 'md5-8gb' AS method, md5(content) AS checksum FROM objects")
def _(spark, sf):
    return checksum.block_checksums(objects(spark, sf), METHODS["md5-8gb"])


@query("snk02_annotation_lines", f"{_BLOCKS} SELECT '<' || url || '>  ' || checksum AS value FROM a")
def snk02_annotation_lines(spark, sf):
    return sinks.annotation_lines(_annotations(spark, sf))


@query("api04_combine_sorted", "WITH o AS (SELECT 's3://d/' || doc_id AS url, text FROM documents UNION ALL SELECT 's3://p/' || page_id, html FROM pages) SELECT url, CAST(0 AS BIGINT) AS \"offset\", md5(text) AS checksum FROM o")
def _(spark, sf):
    def part(name, key, text, bucket):
        return table(spark, sf, name).select(fn.url(F.lit(bucket), F.col(key).cast("string")).alias("url"), F.lit(0).cast("bigint").alias("offset"), fn.digest(F.encode(text, "UTF-8"), "md5").alias("checksum"))

    return annotate.combine(part("documents", "doc_id", "text", "d"), part("pages", "page_id", "html", "p"))


@query("rdf05_descriptors", f"{_BLOCKS} SELECT url || '#' || method || '-' || \"offset\" AS id, '{PREFIXES['dat']}' || method AS \"hasType\", checksum AS value, a.\"offset\", length, CASE WHEN size > 0 THEN length / size ELSE 1.0 END AS coverage FROM a JOIN (SELECT 's3://' || bucket || '/' || key AS u, size FROM objects) ON u = url")
def _(spark, sf):
    sizes = objects(spark, sf).select(fn.url(F.col("bucket"), F.col("key")).alias("url"), "size")
    return annotate.descriptors(_annotations(spark, sf), sizes).drop("label", "hasDescriptor")


# Graph

GRAPH = "https://example.org/graph"


def entities(spark, sf) -> dict[str, DataFrame]:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    i, has = F.col("doc_id").cast("string"), F.col("quality").isNotNull()
    none = F.array().cast("array<string>")
    items = d.select(
        F.concat(F.lit("dat:doc-"), i).alias("id"),
        F.when(F.col("n_chars") > 500, F.concat(F.lit("document "), i)).alias("label"),
        F.when(F.col("lang") != "de", F.concat(F.lit("https://example.org/source/"), "source")).alias("isPartOf"),
        F.when(has, F.array(F.concat(F.lit("dat:desc-"), i))).otherwise(none).alias("hasDescriptor"),
    )
    descriptors = d.where(has).select(
        F.concat(F.lit("dat:desc-"), i).alias("id"),
        F.when(F.col("toxic") == 1, "dat:type-unknown").otherwise("dat:type-quality").alias("hasType"),
        F.when(F.col("quality") == 1, "good").alias("value"),
        F.lit(0).cast("bigint").alias("offset"),
        F.col("n_chars").alias("length"),
        F.lit(1.0).alias("coverage"),
        F.lit(None).cast("string").alias("label"),
        none.alias("hasDescriptor"),
    )
    types = inline(spark, [("dat:type-quality", "quality", "dat:md5", None)], "id string, label string, usesMethod string, max_block_size long")
    methods = inline(spark, [("dat:md5", "MD5", None, "VERY_HIGH"), ("dat:own", None, None, "STRONG")], "id string, label string, comment string, robustness string")
    return {"Item": items, "Descriptor": descriptors, "DescriptorType": types, "Method": methods}


def quads(spark, sf) -> DataFrame:
    """All entities in one graph, with a predicate that items don't have, and second labels, in some languages; no quad comes twice."""
    own = reduce(DataFrame.unionByName, [rdf.quads_of(e, n, GRAPH) for n, e in entities(spark, sf).items()])
    d = table(spark, sf, "documents")
    s = F.concat(F.lit(PREFIXES["dat"] + "doc-"), F.col("doc_id").cast("string"))
    none = F.lit(None).cast("string")
    more = lambda lang, p, o: d.where(F.col("lang") == lang).select(F.lit(GRAPH).alias("graph"), s.alias("subject"), F.lit(p).alias("predicate"), F.lit(o).alias("object"), F.lit("literal").alias("object_kind"), none.alias("datatype"), none.alias("lang"))
    return own.unionByName(more("fr", iri("rdfs:seeAlso"), "voir")).unionByName(more("es", iri("rdfs:label"), "otro"))


def _q(subject: str, predicate: str, obj: str, kind: str, source: str, datatype: str | None = None) -> str:
    dt = f"'{iri(datatype)}'" if datatype else "CAST(NULL AS VARCHAR)"
    return f"SELECT '{GRAPH}' AS graph, {subject} AS subject, '{iri(predicate)}' AS predicate, {obj} AS object, '{kind}' AS object_kind, {dt} AS datatype FROM {source}"


def _quads_sql() -> str:
    dat = PREFIXES["dat"]
    doc, desc = f"'{dat}doc-' || doc_id", f"'{dat}desc-' || doc_id"
    have = "x WHERE quality IS NOT NULL"
    one = lambda s: f"(SELECT '{dat}{s}' AS s)"
    rows = [
        _q(doc, "rdf:type", f"'{iri('voc:Item')}'", "iri", "x"),
        _q(doc, "rdfs:label", "'document ' || doc_id", "literal", "x WHERE n_chars > 500"),
        _q(doc, "dct:isPartOf", "'https://example.org/source/' || source", "literal", "x WHERE lang <> 'de'", "xsd:anyURI"),
        _q(doc, "voc:hasDescriptor", desc, "iri", have),
        _q(desc, "rdf:type", f"'{iri('voc:Descriptor')}'", "iri", have),
        _q(desc, "voc:hasType", f"CASE WHEN toxic = 1 THEN '{dat}type-unknown' ELSE '{dat}type-quality' END", "iri", have),
        _q(desc, "voc:value", "'good'", "literal", have + " AND quality = 1"),
        _q(desc, "voc:offset", "'0'", "literal", have, "xsd:integer"),
        _q(desc, "voc:length", "CAST(n_chars AS VARCHAR)", "literal", have, "xsd:integer"),
        _q(desc, "voc:coverage", "'1.0'", "literal", have, "xsd:float"),
        _q("s", "rdf:type", f"'{iri('voc:DescriptorType')}'", "iri", one("type-quality")),
        _q("s", "rdfs:label", "'quality'", "literal", one("type-quality")),
        _q("s", "voc:usesMethod", f"'{dat}md5'", "iri", one("type-quality")),
        _q("s", "rdf:type", f"'{iri('voc:Method')}'", "iri", one("md5")),
        _q("s", "rdfs:label", "'MD5'", "literal", one("md5")),
        _q("s", "voc:robustness", "'VERY_HIGH'", "literal", one("md5")),
        _q("s", "rdf:type", f"'{iri('voc:Method')}'", "iri", one("own")),
        _q("s", "voc:robustness", "'STRONG'", "literal", one("own")),
        _q(doc, "rdfs:seeAlso", "'voir'", "literal", "x WHERE lang = 'fr'"),
        _q(doc, "rdfs:label", "'otro'", "literal", "x WHERE lang = 'es'"),
    ]
    return "x AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)), q AS (" + "\nUNION ALL ".join(rows) + f"), typed AS (SELECT graph, subject, object AS class FROM q WHERE predicate = '{RDF_TYPE}')"


QUADS = _quads_sql()


@query("rdf01_entity_to_quads", f"WITH {QUADS} SELECT * FROM q WHERE predicate <> '{iri('rdfs:seeAlso')}' AND object <> 'otro'")
def _(spark, sf):
    return rdf.union(*(rdf.quads_of(e, n, GRAPH) for n, e in entities(spark, sf).items())).drop("lang")


@query("rdf02_quads_to_entity", "SELECT 'dat:desc-' || doc_id AS id, CASE WHEN toxic = 1 THEN 'dat:type-unknown' ELSE 'dat:type-quality' END AS \"hasType\", CASE WHEN quality = 1 THEN 'good' END AS value, CAST(0 AS BIGINT) AS \"offset\", n_chars AS length, CAST(1.0 AS DOUBLE) AS coverage, CAST(NULL AS VARCHAR) AS label FROM documents JOIN labels USING (doc_id)")
def _(spark, sf):
    return rdf.entities_of(quads(spark, sf), "Descriptor").drop("hasDescriptor")


@query("fil08_subject_lookup", f"WITH {QUADS} SELECT predicate, object, object_kind FROM q WHERE subject = '{PREFIXES['dat']}doc-0'")
def _(spark, sf):
    return rdf.about(quads(spark, sf), "dat:doc-0").select("predicate", "object", "object_kind")


@query("set01_graph_union", f"WITH {QUADS} SELECT DISTINCT graph, subject, predicate, object FROM q")
def _(spark, sf):
    q = quads(spark, sf)
    return rdf.union(q, q.where(F.col("predicate") == RDF_TYPE)).select("graph", "subject", "predicate", "object")


@query("snk03_ntriples", f"""WITH {QUADS} SELECT DISTINCT '<' || subject || '> <' || predicate || '> ' || CASE WHEN object_kind = 'iri' THEN '<' || object || '>' ELSE '"' || object || '"' || coalesce('^^<' || datatype || '>', '') END || ' .' AS value FROM q""")
def _(spark, sf):
    return sinks.ntriples(quads(spark, sf))


@query("src09_ntriples_round_trip", f"WITH {QUADS} SELECT DISTINCT subject, predicate, object, object_kind, datatype FROM q")
def _(spark, sf):
    return sources.ntriples(sinks.ntriples(quads(spark, sf)), GRAPH).select("subject", "predicate", "object", "object_kind", "datatype")


@query("src08_turtle_round_trip", f"WITH {QUADS} SELECT DISTINCT subject, predicate, object, object_kind, datatype FROM q")
def _(spark, sf):
    return sources.turtle(sinks.ntriples(quads(spark, sf)), GRAPH).select("subject", "predicate", "object", "object_kind", "datatype")


_DESCRIPTORS = "SELECT 'dat:desc-' || doc_id AS id, CASE WHEN toxic = 1 THEN 'dat:type-unknown' ELSE 'dat:type-quality' END AS \"hasType\", CASE WHEN quality = 1 THEN 'good' END AS value, CAST(0 AS BIGINT) AS \"offset\", n_chars AS length, CAST(1.0 AS DOUBLE) AS coverage, CAST(NULL AS VARCHAR) AS label, CAST({0} AS INTEGER) AS n_lists FROM documents JOIN labels USING (doc_id)"


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("n_lists", F.size("hasDescriptor")).drop("hasDescriptor")


@query("src10_yaml_round_trip", _DESCRIPTORS.replace("{0}", "0"))
def _(spark, sf):
    return _flat(sources.documents(sinks.to_yaml(entities(spark, sf)["Descriptor"], "Descriptor"), "Descriptor", "yaml"))


@query("src11_json_round_trip", _DESCRIPTORS.replace("{0}", "0"))
def _(spark, sf):
    return _flat(sources.documents(sinks.to_json(entities(spark, sf)["Descriptor"], "Descriptor"), "Descriptor", "json"))


@query("scl16_coercion", _DESCRIPTORS.replace("{0}", "1"))
def _(spark, sf):
    d = entities(spark, sf)["Descriptor"]
    text = d.select("id", "hasType", "value", F.col("offset").cast("string"), F.col("length").cast("string"), F.col("coverage").cast("string"), F.lit("dat:x").alias("hasDescriptor"))
    return _flat(checks.coerced(text, "Descriptor"))


@query("agg04_multivalued", "SELECT 'dat:n' || n_nationkey AS id, n_name AS label, coalesce(string_agg('dat:c' || c_custkey, ' ' ORDER BY 'dat:c' || c_custkey), '') AS descriptors FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
def _(spark, sf):
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.collect_list(F.concat(F.lit("dat:c"), F.col("c_custkey").cast("string"))).alias("hasDescriptor"))
    n = table(spark, sf, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    items = n.select(F.concat(F.lit("dat:n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("label"), "hasDescriptor")
    got = rdf.entities_of(rdf.quads_of(items, "Item", GRAPH), "Item")
    return got.select("id", "label", F.array_join("hasDescriptor", " ").alias("descriptors"))


@query("joi05_descriptor_chain", "SELECT 'dat:doc-' || doc_id AS item, CASE WHEN n_chars > 500 THEN 'document ' || doc_id END AS item_label, 'dat:desc-' || doc_id AS descriptor, CASE WHEN quality = 1 THEN 'good' END AS value, CAST(0 AS BIGINT) AS \"offset\", n_chars AS length, CAST(1.0 AS DOUBLE) AS coverage, 'dat:type-quality' AS type, 'quality' AS type_label, 'dat:md5' AS method, 'MD5' AS method_label, 'VERY_HIGH' AS robustness FROM documents JOIN labels USING (doc_id) WHERE toxic <> 1")
def _(spark, sf):
    e = entities(spark, sf)
    return rdf.chain(e["Item"], e["Descriptor"], e["DescriptorType"], e["Method"])


@query("joi06_closure", """WITH RECURSIVE e AS (SELECT DISTINCT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r0', 'r0'),
w AS (SELECT src AS source, dst AS node, 1 AS depth FROM e UNION SELECT w.source, e.dst, w.depth + 1 FROM w JOIN e ON w.node = e.src WHERE w.depth < 6) SELECT source, node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY source, node""")
def _(spark, sf):
    def edge(name, a, x, b, y):
        return table(spark, sf, name).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"))

    e = edge("customer", "c", "c_custkey", "n", "c_nationkey").unionAll(edge("supplier", "s", "s_suppkey", "n", "s_nationkey")).unionAll(edge("nation", "n", "n_nationkey", "r", "n_regionkey"))
    return rdf.closure(e.unionAll(inline(spark, [("r0", "r0")], "src string, dst string")))


# Checks


#: The rules once more, for the SQL only, written out from the classes' definitions: class to its required slots, to all its slots, and slots that refer to a class.
_NAMES = {"id": "voc:id", "label": "rdfs:label", "isPartOf": "dct:isPartOf", "comment": "rdfs:comment", "type": "rdf:type"}
_REQUIRED = {"Thing": "id", "DescribableThing": "id", "Item": "id label isPartOf", "Descriptor": "id hasType value offset coverage", "DescriptorType": "id label usesMethod", "Method": "id label robustness"}
_PERMITTED = {
    "Thing": "id type",
    "DescribableThing": "id hasDescriptor type",
    "Item": "id label isPartOf hasDescriptor type",
    "Descriptor": "id hasType value offset length coverage label hasDescriptor type",
    "DescriptorType": "id label usesMethod max_block_size type",
    "Method": "id label comment robustness type",
}
_RANGES = [("DescribableThing", "hasDescriptor", "Descriptor"), ("Item", "hasDescriptor", "Descriptor"), ("Descriptor", "hasDescriptor", "Descriptor"), ("Descriptor", "hasType", "DescriptorType"), ("DescriptorType", "usesMethod", "Method")]
_TYPES = {"id": "xsd:anyURI", "isPartOf": "xsd:anyURI", "offset": "xsd:integer", "length": "xsd:integer", "max_block_size": "xsd:integer", "coverage": "xsd:float", "label": "xsd:string", "value": "xsd:string", "comment": "xsd:string"}
_slot = lambda s: iri(_NAMES.get(s, f"voc:{s}"))
REQUIRED_BY_HAND = [(iri(f"voc:{c}"), _slot(s)) for c, slots in _REQUIRED.items() for s in slots.split()]
PERMITTED_BY_HAND = [(iri(f"voc:{c}"), _slot(s)) for c, slots in _PERMITTED.items() for s in slots.split()]
RANGES_BY_HAND = [(iri(f"voc:{c}"), _slot(s), iri(f"voc:{o}")) for c, s, o in _RANGES]
_REFERENCES = {"hasDescriptor", "hasType", "usesMethod"}


def _values(rows: list[tuple], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows) + f") r({names})"


def _required_sql(rules) -> str:
    return f"WITH {QUADS} SELECT 'https://w3id.org/linkml/required' AS \"check\", t.class, t.graph, t.subject, r.predicate FROM typed t JOIN {_values(rules, 'class, predicate')} ON t.class = r.class WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.graph = t.graph AND q.subject = t.subject AND q.predicate = r.predicate)"


def _permitted_sql(names) -> str:
    rules = [r for r in PERMITTED_BY_HAND if r[0] in names]
    return f"WITH {QUADS} SELECT t.class, t.graph AS g, t.subject AS s, q.predicate AS p FROM typed t JOIN q ON q.graph = t.graph AND q.subject = t.subject WHERE t.class IN ({', '.join(repr(n) for n in names)}) AND NOT EXISTS (SELECT 1 FROM {_values(rules, 'class, predicate')} WHERE r.class = t.class AND r.predicate = q.predicate)"


def _range_sql(rules) -> str:
    return f"WITH {QUADS} SELECT 'https://w3id.org/linkml/range' AS \"check\", t.class, t.graph, t.subject, q.predicate, q.object FROM typed t JOIN {_values(rules, 'class, predicate, want')} ON t.class = r.class JOIN q ON q.graph = t.graph AND q.subject = t.subject AND q.predicate = r.predicate WHERE NOT EXISTS (SELECT 1 FROM typed o WHERE o.graph = q.graph AND o.subject = q.object AND o.class = r.want AND q.object_kind = 'iri')"


def _all_checks() -> None:
    classes_ = [iri(c.curie) for c in classes().values()]
    ranges = RANGES_BY_HAND
    local = lambda x: x.replace("#", "/").rsplit("/", 1)[1].lower()
    query("chk_required_all", _required_sql(REQUIRED_BY_HAND))(lambda spark, sf: checks.required(quads(spark, sf)))
    query("chk_permitted_all", _permitted_sql(classes_))(lambda spark, sf: checks.permitted(checkpoint(quads(spark, sf))))
    query("chk_range_all", _range_sql(ranges))(lambda spark, sf: checks.object_range(checkpoint(quads(spark, sf))))
    n = 0
    for r in REQUIRED_BY_HAND:
        n += 1
        query(f"chk{n:02d}_required_{local(r[0])}_{local(r[1])}", _required_sql([r]))(lambda spark, sf, r=r: checks.required(quads(spark, sf), [r]))
    for c in classes_:
        n += 1
        query(f"chk{n:02d}_permitted_{local(c)}", _permitted_sql([c]))(lambda spark, sf, c=c: checks.permitted(quads(spark, sf), [c]))
    for r in ranges:
        n += 1
        query(f"chk{n:02d}_range_{local(r[0])}_{local(r[1])}", _range_sql([r]))(lambda spark, sf, r=r: checks.object_range(quads(spark, sf), [r]))


_all_checks()
_SLOTS = [(iri(f"voc:{c}"), _slot(s), s) for c, slots in _PERMITTED.items() for s in slots.split() if s != "type"]
_T = "typed t JOIN q ON q.graph = t.graph AND q.subject = t.subject"


def _shape_rules() -> list[tuple[str, str]]:
    every = {p for _, p in PERMITTED_BY_HAND}
    return sorted({*PERMITTED_BY_HAND, *((iri(f"voc:{c}"), p) for c in ("Thing", "DescribableThing") for p in every)})


@query("shp01_closed", f"WITH {QUADS} SELECT t.graph, t.subject, t.class, q.predicate FROM {_T} WHERE t.class IN ({', '.join(repr(iri(c.curie)) for c in classes().values())}) AND NOT EXISTS (SELECT 1 FROM {_values(_shape_rules(), 'class, predicate')} WHERE r.class = t.class AND r.predicate = q.predicate)")
def _(spark, sf):
    return checks.closed(quads(spark, sf))


@query("shp02_datatype", f"WITH {QUADS} SELECT t.graph, t.subject, t.class, q.predicate, q.object, coalesce(q.datatype, '{iri('xsd:string')}') AS datatype FROM {_T} JOIN {_values([(c, p, iri(_TYPES[s])) for c, p, s in _SLOTS if s in _TYPES], 'class, predicate, want')} ON r.class = t.class AND r.predicate = q.predicate WHERE q.object_kind = 'literal' AND coalesce(q.datatype, '{iri('xsd:string')}') <> r.want")
def _(spark, sf):
    return checks.datatypes(quads(spark, sf))


@query("shp03_class", f"SELECT class, graph, subject, predicate, object FROM ({_range_sql(RANGES_BY_HAND)})")
def _(spark, sf):
    return checks.object_classes(quads(spark, sf))


@query("shp04_node_kind", f"WITH {QUADS} SELECT t.graph, t.subject, t.class, q.predicate, q.object, q.object_kind FROM {_T} JOIN {_values([(c, p, 'iri' if s in _REFERENCES else 'literal') for c, p, s in _SLOTS], 'class, predicate, want')} ON r.class = t.class AND r.predicate = q.predicate WHERE q.object_kind <> r.want")
def _(spark, sf):
    return checks.node_kinds(quads(spark, sf))


@query("shp05_min_count", f"SELECT graph, subject, class, predicate, CAST(0 AS BIGINT) AS n FROM ({_required_sql(REQUIRED_BY_HAND)})")
def _(spark, sf):
    return checks.min_count(quads(spark, sf))


@query("shp06_max_count", f"WITH {QUADS} SELECT t.graph, t.subject, t.class, q.predicate, count(*) AS n FROM {_T} JOIN {_values([(c, p) for c, p, s in _SLOTS if s != 'hasDescriptor'], 'class, predicate')} ON r.class = t.class AND r.predicate = q.predicate GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    return checks.max_count(quads(spark, sf))


@query("shp07_enum_in", f"WITH {QUADS} SELECT t.graph, t.subject, t.class, q.predicate, q.object FROM {_T} WHERE t.class = '{iri('voc:Method')}' AND q.predicate = '{iri('voc:robustness')}' AND q.object NOT IN ({', '.join(repr(r) for r in ROBUSTNESS)})")
def _(spark, sf):
    return checks.enum_values(quads(spark, sf))


@query("shp08_target_class", f"WITH {QUADS} SELECT graph, subject, class FROM typed")
def _(spark, sf):
    return checks.typed(quads(spark, sf))


@query("scl17_18_invalid_entities", "SELECT 'dat:desc-' || doc_id AS id, 'value' AS slot, 'missing' AS problem FROM documents JOIN labels USING (doc_id) WHERE quality <> 1 UNION ALL SELECT * FROM (VALUES ('dat:own', 'label', 'missing'), ('dat:own', 'robustness', 'not in the enumeration')) v(id, slot, problem)")
def _(spark, sf):
    e = entities(spark, sf)
    return checks.invalid_entities(e["Descriptor"], "Descriptor").unionAll(checks.invalid_entities(e["Method"], "Method"))
