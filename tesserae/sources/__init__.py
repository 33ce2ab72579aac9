"""Readers: object listings, byte ranges, task files, RDF and entity files."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fn
from ..model import OBJECTS, PREFIXES, QUADS, entity_schema
from ..session import checkpoint, inline

CHUNK = 1 << 20


# Objects


def list_table(objects: DataFrame, prefix: str) -> DataFrame:
    """Rows of a listing table whose key begins with a string prefix, in key order; the filter reaches a Parquet scan."""
    return objects.where(F.col("key").startswith(prefix)).orderBy("key")


def _filesystem(path: str) -> tuple[object, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def walk(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """(key, last_modified, size, folder): the files and folders under root whose keys begin with a string prefix; folders' keys end with a slash.

    Only the deepest folder that the prefix names and what matches below it is
    listed: a level a round, each folder by a task of its own, and each level is
    written to the checkpoint folder.
    """
    from pyarrow import fs

    _, base = _filesystem(root)
    uri = root.rstrip("/") if "://" in root else base.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at = _filesystem(uri)
        at = at.rstrip("/")
        for b in batches:
            for folder in b.column("folder").to_pylist():
                found = here.get_file_info(fs.FileSelector(f"{at}/{folder}".rstrip("/"), allow_not_found=True))
                for lo in range(0, len(found), 10_000):
                    part = found[lo : lo + 10_000]
                    below = [i.type == fs.FileType.Directory for i in part]
                    keys = [i.path[len(at) + 1 :] + "/" * d for i, d in zip(part, below)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([i.mtime for i in part], pa.timestamp("us", "UTC")), pa.array([i.size for i in part], pa.int64()), pa.array(below, pa.bool_())], ["key", "last_modified", "size", "folder"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level, levels = inline(spark, [(prefix.rpartition("/")[0],)], "folder string"), []
    while True:
        levels.append(checkpoint(level.mapInArrow(run, "key string, last_modified timestamp, size long, folder boolean").where(F.col("key").startswith(prefix))))
        below = levels[-1].where("folder")
        if below.isEmpty():
            return reduce(DataFrame.unionAll, levels)
        level = below.select(F.col("key").alias("folder")).repartition(n)


def list_files(spark: SparkSession, bucket: str, root: str, prefix: str = "") -> DataFrame:
    """Listing of the files under root, empty ones too, keys relative to it; bytes aren't read and there is no ETag (null)."""
    files = walk(spark, root, prefix).where(~F.col("folder"))
    return list_table(files.select(F.lit(bucket).alias("bucket"), "key", "last_modified", F.lit(None).cast("string").alias("etag"), "size"), prefix)


def list_pages(spark: SparkSession, bucket: str, prefixes: list[str], fetch: Callable[[str, str | None], dict]) -> DataFrame:
    """Listing of a store by its own paged interface: ``fetch(prefix, token)`` gives a response with Contents, IsTruncated and NextContinuationToken.

    A task follows the tokens of a prefix; prefixes that don't overlap are listed side by side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for prefix in b.column("prefix").to_pylist():
                more, token = True, None
                while more:
                    page = fetch(prefix, token)
                    rows = page.get("Contents") or []
                    more, token = page.get("IsTruncated", False), page.get("NextContinuationToken")
                    if more and not token:
                        raise ValueError(f"a truncated page of {prefix!r} has no token")
                    yield pa.RecordBatch.from_arrays([pa.array([r["Key"] for r in rows], pa.string()), pa.array([r.get("LastModified") for r in rows], pa.timestamp("us", "UTC")), pa.array([r.get("ETag") for r in rows], pa.string()), pa.array([r["Size"] for r in rows], pa.int64())], ["Key", "LastModified", "ETag", "Size"])

    shards = inline(spark, [(p,) for p in prefixes], "prefix string").repartition(max(1, len(prefixes)))
    return from_api(shards.mapInArrow(run, "Key string, LastModified timestamp, ETag string, Size long"), bucket)


def from_api(pages: DataFrame, bucket: str) -> DataFrame:
    """Rows of an object store's listing response (Key, LastModified, ETag, Size) as a listing; any number of pages is one table."""
    return pages.select(F.lit(bucket).alias("bucket"), F.col("Key").alias("key"), F.col("LastModified").cast("timestamp").alias("last_modified"), F.col("ETag").alias("etag"), F.col("Size").cast("bigint").alias("size"))


def api_pages(spark: SparkSession, path: str, bucket: str) -> DataFrame:
    """Listing responses saved as JSON, a page each with Contents, IsTruncated and NextContinuationToken; a page without Contents has no rows."""
    kind = "Contents array<struct<Key:string,LastModified:string,ETag:string,Size:bigint>>, IsTruncated boolean, NextContinuationToken string"
    pages = spark.read.schema(kind).json(path)
    return from_api(pages.select(F.explode("Contents").alias("c")).select("c.*"), bucket)


def slice_bytes(data: Column, offset: Column, length: Column) -> Column:
    """Bytes [offset, offset + length) of a binary column; all from offset if length is null or 0."""
    rest = F.octet_length(data) - offset
    want = F.when(F.coalesce(length, F.lit(0)) == 0, rest).otherwise(F.least(length, rest))
    return F.substring(data, (offset + 1).cast("int"), F.greatest(want, F.lit(0)).cast("int"))


def read_range(path: str, offset: int, length: int | None) -> Iterator[bytes]:
    """Chunks of a file's byte range; a range beyond the end is shorter or empty."""
    left = length or None
    store, at = _filesystem(path)
    with store.open_input_file(at) as f:
        f.seek(min(offset, f.size()))
        while left is None or left > 0:
            data = f.read(CHUNK if left is None else min(CHUNK, left))
            if not data:
                return
            left = None if left is None else left - len(data)
            yield data


# Task files


def task_rows(lines: DataFrame) -> DataFrame:
    """Task lines (value) as rows; blank lines are skipped, any other number of parts than five is an error."""
    parts = lines.select(fn.words(F.col("value")).alias("c"), "value").where(F.size("c") > 0)
    ok = F.when(F.size("c") == 5, F.col("c")).otherwise(F.raise_error(F.concat(F.lit("Invalid number of components: "), F.size("c").cast("string"), F.lit(" in line "), F.col("value"))).cast("array<string>"))
    c = parts.select(ok.alias("c"))
    return c.select(F.col("c")[0].alias("url"), fn.integer(F.col("c")[1]).alias("size"), F.col("c")[2].alias("method"), fn.integer(F.col("c")[3]).alias("block_size"), fn.integer(F.col("c")[4]).alias("offset"))


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    return task_rows(spark.read.text(path))


# RDF

_NT = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*\.\s*(?:#.*)?$'


def _unescaped(c: Column) -> Column:
    for a, b in ((r"\\t", "\t"), (r"\\n", "\n"), (r"\\r", "\r"), (r'\\"', '"')):
        c = F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)" + a, "$1" + b)
    return F.regexp_replace(c, r"\\\\", r"\\")


def ntriples(lines: DataFrame, graph: str | None = None) -> DataFrame:
    """N-Triples lines (value) as quads in a named graph, or the default one; blank and comment lines are skipped, bad ones an error."""
    v = lines.where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    part = lambda i: F.regexp_extract("value", _NT, i)
    good = F.when(F.col("value").rlike(_NT), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not an N-Triples line: "), F.col("value"))).cast("string"))
    v = v.select(good.alias("value"))
    is_iri, is_blank = part(3) != "", part(4) != ""
    none = F.lit(None).cast("string")
    return v.select(
        F.lit(graph).cast("string").alias("graph"),
        F.regexp_replace(part(1), "^<|>$", "").alias("subject"),
        part(2).alias("predicate"),
        F.when(is_iri, part(3)).when(is_blank, part(4)).otherwise(_unescaped(part(5))).alias("object"),
        F.when(is_iri | is_blank, "iri").otherwise("literal").alias("object_kind"),
        F.when(part(6) != "", part(6)).otherwise(none).alias("datatype"),
        F.when(part(7) != "", part(7)).otherwise(none).alias("lang"),
    )


def read_ntriples(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    return ntriples(spark.read.text(path), graph).dropDuplicates()


_TOKEN = re.compile(r'\s+|#[^\n]*|(?P<iri><[^>]*>)|(?P<str>"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*")|(?P<dt>\^\^)|(?P<at>@[A-Za-z][\w-]*)|(?P<num>[+-]?(?:\d+\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<p>[;,.\[\]()])|(?P<name>(?:_|[A-Za-z][\w.-]*)?:[\w.%-]*(?<!\.)|a\b|true\b|false\b)')
_XSD = PREFIXES["xsd"]
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)


def parse_turtle(text: str) -> list[tuple]:
    """(subject, predicate, object, kind, datatype, lang) of a Turtle subset: prefixes, a, lists by ";" and ",", literals."""
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"Turtle not understood at {text[at : at + 30]!r}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m.group()))
        at = m.end()
    prefixes: dict[str, str] = {}
    base, out, i = "", [], 0

    def resolve(kind: str, x: str) -> str:
        if kind == "iri":
            x = x[1:-1]
            return x if re.match(r"[A-Za-z][\w+.-]*:", x) else base + x
        if x == "a":
            return PREFIXES["rdf"] + "type"
        p, _, local = x.partition(":")
        if p == "_":
            return x
        if p not in prefixes:
            raise ValueError(f"unknown prefix {p!r}")
        return prefixes[p] + local

    def literal(x: str) -> str:
        x = x[3:-3] if x.startswith('"""') else x[1:-1]
        named = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}
        return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else named.get(m[1], m[1]), x)

    while i < len(tokens):
        kind, x = tokens[i]
        if x in ("@prefix", "@base"):
            if x == "@prefix":
                prefixes[tokens[i + 1][1][:-1]] = resolve(*tokens[i + 2])
                i += 4
            else:
                base = tokens[i + 1][1][1:-1]
                i += 3
            continue
        subject = resolve(kind, x)
        i += 1
        while True:
            predicate = resolve(*tokens[i])
            i += 1
            while True:
                kind, x = tokens[i]
                i += 1
                dt = lang = None
                if kind == "str":
                    value, what = literal(x), "literal"
                    if i < len(tokens) and tokens[i][0] == "dt":
                        dt = resolve(*tokens[i + 1])
                        i += 2
                    elif i < len(tokens) and tokens[i][0] == "at":
                        lang = tokens[i][1][1:]
                        i += 1
                elif kind == "num":
                    value, what = x, "literal"
                    dt = _XSD + ("double" if "e" in x.lower() else "decimal" if "." in x else "integer")
                elif x in ("true", "false"):
                    value, what, dt = x, "literal", _XSD + "boolean"
                else:
                    value, what = resolve(kind, x), "iri"
                out.append((subject, predicate, value, what, dt, lang))
                if tokens[i][1] != ",":
                    break
                i += 1
            while tokens[i][1] == ";":
                i += 1
            if tokens[i][1] == ".":
                i += 1
                break
    return out


def turtle(texts: DataFrame, graph: str | None = None) -> DataFrame:
    """Turtle documents (value) as quads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = QUADS.replace(" string", "").split(", ")
        for b in batches:
            rows = [(graph, *t) for text in b.column("value").to_pylist() for t in parse_turtle(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(7)], names)

    return texts.select("value").mapInArrow(run, QUADS).dropDuplicates()


def read_turtle(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    """Turtle files as quads, a file per task at most (the format can't be split)."""
    return turtle(spark.read.text(path, wholetext=True), graph)


# Entities


def documents(texts: DataFrame, name: str, kind: str) -> DataFrame:
    """Entities of one class from JSON or YAML documents (value), each one entity or several; a closed class has no other keys than its slots and "@type"."""
    schema = _nullable(entity_schema(name))
    fields = {f.name: f.dataType for f in schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column("value").to_pylist():
                if kind == "yaml":
                    import yaml

                    found = [*yaml.load_all(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))]
                else:
                    found = [json.loads(text)]
                for d in (e for x in found for e in (x if isinstance(x, list) else [x])):
                    if not isinstance(d, dict) or set(d) - {*fields, "@type"}:
                        raise ValueError(f"not an entity of {name}: {d!r}")
                    rows.append(json.dumps({k: (v if isinstance(v, list) else [v]) if isinstance(fields.get(k), T.ArrayType) and v is not None else v for k, v in d.items()}))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["value"])

    rows = texts.select("value").mapInArrow(run, "value string")
    return _with_lists(rows.select(F.from_json("value", schema).alias("e")).select("e.*"), name)


def read_json(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Entities of one class from JSON files; "@type" is dropped, missing slots are null, lists default to empty."""
    return documents(spark.read.text(path, wholetext=True), name, "json")


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def _with_lists(df: DataFrame, name: str) -> DataFrame:
    many = [f.name for f in entity_schema(name).fields if isinstance(f.dataType, T.ArrayType)]
    return df.withColumns({c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in many}) if many else df


def read_yaml(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Entities of one class from YAML files."""
    return documents(spark.read.text(path, wholetext=True), name, "yaml")


def empty_listing(spark: SparkSession) -> DataFrame:
    """What an empty prefix lists."""
    return spark.createDataFrame([], OBJECTS)
