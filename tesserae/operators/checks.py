"""Integrity checks over quads, driven by tables of rules.

Types are matched exactly, without subclasses; triples of the default graph
(null) match nothing. All rules of a kind run in one pass: quads are joined with
the rules of their subject's class, a table of a few rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fn
from ..model import RDF_TYPE, ROBUSTNESS, classes, entity_schema, iri
from ..session import checkpoint, inline

REQUIRED, RANGE = iri("linkml:required"), iri("linkml:range")
_LITERAL = ("string", "integer", "float", "enum", "uri")
_XSD = {"integer": iri("xsd:integer"), "float": iri("xsd:float"), "uri": iri("xsd:anyURI"), "string": iri("xsd:string")}


def required_rules(strict_is_part_of: bool = True) -> list[tuple[str, str]]:
    """(class, predicate)"""
    return [(iri(c.curie), iri(s.curie)) for c in classes(strict_is_part_of).values() for s in c.slots if s.required]


def permitted_rules() -> list[tuple[str, str]]:
    return [(iri(c.curie), p) for c in classes().values() for p in (*(iri(s.curie) for s in c.slots), RDF_TYPE)]


def range_rules() -> list[tuple[str, str, str]]:
    """(class, predicate, class of the object)"""
    return [(iri(c.curie), iri(s.curie), iri(classes()[s.kind].curie)) for c in classes().values() for s in c.slots if s.kind not in _LITERAL]


def _rules(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    return F.broadcast(inline(spark, rows, names))  # a few rows by construction


def typed(quads: DataFrame) -> DataFrame:
    """(graph, subject, class) of named graphs."""
    return quads.where((F.col("predicate") == RDF_TYPE) & F.col("graph").isNotNull()).select("graph", "subject", F.col("object").alias("class"))


def required(quads: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """(check, class, graph, subject, predicate) of typed subjects that lack a required predicate.

    One combining aggregation by subject, of no more than the rules' classes and predicates.
    """
    rules = required_rules() if rules is None else rules
    has = F.array_compact(F.collect_set(F.when(F.col("predicate").isin([*{p for _, p in rules}]), F.col("predicate"))))
    is_a = F.array_compact(F.collect_set(F.when((F.col("predicate") == RDF_TYPE) & F.col("object").isin([*{c for c, _ in rules}]), F.col("object"))))
    subjects = quads.where(F.col("graph").isNotNull()).groupBy("graph", "subject").agg(has.alias("has"), is_a.alias("is_a"))
    every = F.expr("array(" + ", ".join(f"named_struct('class', '{c}', 'predicate', '{p}')" for c, p in rules) + ")")
    lacks = F.filter(every, lambda r: F.array_contains("is_a", r["class"]) & ~F.array_contains("has", r["predicate"]))
    return subjects.where(F.size("is_a") > 0).select("graph", "subject", F.explode(lacks).alias("r")).select(F.lit(REQUIRED).alias("check"), "r.class", "graph", "subject", "r.predicate")


def permitted(quads: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(class, g, s, p) of triples, one row each, whose predicate isn't one of their subject's class."""
    rules = [r for r in permitted_rules() if names is None or r[0] in names]
    spark = quads.sparkSession
    some = _rules(spark, [(c,) for c in dict.fromkeys(c for c, _ in rules)], "class string")
    rows = typed(quads).join(some, "class").join(quads.select("graph", "subject", "predicate"), ["graph", "subject"])
    bad = rows.join(_rules(spark, rules, "class string, predicate string"), ["class", "predicate"], "left_anti")
    return bad.select("class", F.col("graph").alias("g"), F.col("subject").alias("s"), F.col("predicate").alias("p"))


def object_range(quads: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(check, class, graph, subject, predicate, object) of references whose object isn't typed as wanted in the same graph; a literal never is."""
    r = _rules(quads.sparkSession, range_rules() if rules is None else rules, "class string, predicate string, want string")
    t = typed(quads)
    refs = t.join(r, "class").join(quads.select("graph", "subject", "predicate", "object", "object_kind"), ["graph", "subject", "predicate"])
    target = t.select("graph", F.col("subject").alias("object"), F.col("class").alias("want"), F.lit("iri").alias("object_kind"))
    bad = refs.join(target, ["graph", "object", "want", "object_kind"], "left_anti")
    return bad.select(F.lit(RANGE).alias("check"), "class", "graph", "subject", "predicate", "object")


def check_all(quads: DataFrame) -> DataFrame:
    """Rows of all three kinds with the same columns; quads are made once, into the checkpoint folder."""
    quads = checkpoint(quads)
    none = F.lit(None).cast("string")
    return (
        required(quads).withColumn("object", none)
        .unionByName(permitted(quads).select(F.lit(iri("linkml:permitted")).alias("check"), "class", F.col("g").alias("graph"), F.col("s").alias("subject"), F.col("p").alias("predicate"), none.alias("object")))
        .unionByName(object_range(quads))
    )


# Shapes


def _slots() -> list[tuple]:
    return [(iri(c.curie), iri(s.curie), s) for c in classes().values() for s in c.slots]


def _focus(quads: DataFrame) -> DataFrame:
    return typed(quads).join(quads.drop("lang"), ["graph", "subject"])


def closed(quads: DataFrame) -> DataFrame:
    """Triples of a closed shape that are of none of its properties; the two abstract classes ignore their subclasses' slots."""
    inherit = {iri(c.curie): {iri(s.curie) for k in classes().values() for s in k.slots} for c in classes().values() if c.name in ("Thing", "DescribableThing")}
    rules = sorted({*permitted_rules(), *((c, p) for c, ps in inherit.items() for p in ps)})
    rows = typed(quads).join(quads.select("graph", "subject", "predicate"), ["graph", "subject"])
    rows = rows.join(_rules(quads.sparkSession, sorted({(c,) for c, _ in rules}), "class string"), "class", "left_semi")
    return rows.join(_rules(quads.sparkSession, rules, "class string, predicate string"), ["class", "predicate"], "left_anti").select("graph", "subject", "class", "predicate")


def datatypes(quads: DataFrame) -> DataFrame:
    """Literals of another datatype than the slot's; a plain one is a string."""
    r = _rules(quads.sparkSession, [(c, p, _XSD[s.kind]) for c, p, s in _slots() if s.kind in _XSD], "class string, predicate string, want string")
    rows = _focus(quads).join(r, ["class", "predicate"])
    has = F.coalesce("datatype", F.lit(_XSD["string"]))
    return rows.where((F.col("object_kind") == "literal") & (has != F.col("want"))).select("graph", "subject", "class", "predicate", "object", has.alias("datatype"))


def node_kinds(quads: DataFrame) -> DataFrame:
    """Objects that are IRIs where literals belong, or the reverse."""
    r = _rules(quads.sparkSession, [(c, p, "literal" if s.kind in _LITERAL else "iri") for c, p, s in _slots()], "class string, predicate string, want string")
    return _focus(quads).join(r, ["class", "predicate"]).where(F.col("object_kind") != F.col("want")).select("graph", "subject", "class", "predicate", "object", "object_kind")


def object_classes(quads: DataFrame) -> DataFrame:
    """The shapes' class constraint: the same rows as the range checks."""
    return object_range(quads).drop("check")


def min_count(quads: DataFrame) -> DataFrame:
    """(graph, subject, class, predicate, n) with fewer values than one where one is needed."""
    r = _rules(quads.sparkSession, required_rules(), "class string, predicate string")
    need = typed(quads).join(r, "class")
    have = quads.groupBy("graph", "subject", "predicate").agg(F.count(F.lit(1)).alias("n"))
    return need.join(have, ["graph", "subject", "predicate"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint")).where("n < 1").select("graph", "subject", "class", "predicate", "n")


def max_count(quads: DataFrame) -> DataFrame:
    """The same with more than one value where at most one is allowed."""
    r = _rules(quads.sparkSession, [(c, p) for c, p, s in _slots() if not s.many], "class string, predicate string")
    n = quads.groupBy("graph", "subject", "predicate").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return typed(quads).join(n, ["graph", "subject"]).join(r, ["class", "predicate"]).select("graph", "subject", "class", "predicate", "n")


def enum_values(quads: DataFrame) -> DataFrame:
    """Values outside an enumeration."""
    r = _rules(quads.sparkSession, [(c, p) for c, p, s in _slots() if s.kind == "enum"], "class string, predicate string")
    return _focus(quads).join(r, ["class", "predicate"]).where(~F.col("object").isin(*ROBUSTNESS)).select("graph", "subject", "class", "predicate", "object")


def shapes(quads: DataFrame) -> DataFrame:
    """(constraint, graph, subject, class, predicate) of all shape violations; quads are made once, into the checkpoint folder."""
    quads = checkpoint(quads)
    parts = {"closed": closed, "datatype": datatypes, "class": object_classes, "nodeKind": node_kinds, "minCount": min_count, "maxCount": max_count, "in": enum_values}
    return reduce(DataFrame.unionByName, [f(quads).select(F.lit(k).alias("constraint"), "graph", "subject", "class", "predicate") for k, f in parts.items()])


# Entity rows


def invalid_entities(entities: DataFrame, name: str, strict_is_part_of: bool = True) -> DataFrame:
    """(id, slot, problem) of entity rows: a required slot null or empty, or an unknown enum value."""
    c = classes(strict_is_part_of)[name]
    found = []
    for s in c.slots:
        if s.required:
            found.append(F.when(F.col(s.name).isNull() | (F.col(s.name).cast("string") == ""), F.struct(F.lit(s.name).alias("slot"), F.lit("missing").alias("problem"))))
        if s.kind == "enum":
            found.append(F.when(~F.col(s.name).isin(*ROBUSTNESS), F.struct(F.lit(s.name).alias("slot"), F.lit("not in the enumeration").alias("problem"))))
    return entities.select("id", F.explode(F.array_compact(F.array(*found))).alias("p")).select("id", "p.slot", "p.problem")


def coerced(entities: DataFrame, name: str) -> DataFrame:
    """The class's columns in their types: missing ones null, a scalar for a list as a list of one; a bad value is an error under ANSI mode."""
    cols = []
    for f in entity_schema(name).fields:
        many = isinstance(f.dataType, T.ArrayType)
        if f.name not in entities.columns:
            c = F.array().cast(f.dataType) if many else F.lit(None).cast(f.dataType)
        elif many and not isinstance(entities.schema[f.name].dataType, T.ArrayType):
            c = fn.as_list(F.col(f.name))
        else:
            c = F.coalesce(F.col(f.name), F.array().cast(f.dataType)) if many else F.col(f.name).cast(f.dataType)
        cols.append(c.alias(f.name))
    return entities.select(*cols)


def unknown_columns(entities: DataFrame, name: str) -> list[str]:
    """Columns that a closed class doesn't have."""
    return sorted(set(entities.columns) - {s.name for s in classes()[name].slots})
