"""Entities and quads: mapping both ways, graph union, and walks along references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..model import RDF_TYPE, Class, Slot, classes, iri
from ..session import checkpoint

_DATATYPE = {"float": iri("xsd:float"), "integer": iri("xsd:integer"), "uri": iri("xsd:anyURI")}
_LITERAL = ("string", "integer", "float", "enum", "uri")


def _quad(s: Slot, c: object) -> object:
    reference = s.kind not in _LITERAL
    return F.struct(
        F.lit(iri(s.curie)).alias("predicate"),
        (fn.expand_curie(c) if reference else c.cast("string")).alias("object"),
        F.lit("iri" if reference else "literal").alias("object_kind"),
        F.lit(_DATATYPE.get(s.kind)).cast("string").alias("datatype"),
    )


def _each(s: Slot) -> object:
    return F.transform(F.coalesce(F.col(s.name), F.array().cast("array<string>")), lambda x: _quad(s, x))


def quads_of(entities: DataFrame, name: str, graph: str | None = None, strict_is_part_of: bool = True) -> DataFrame:
    """A quad for the type and for every slot that is set; the id is the subject."""
    c: Class = classes(strict_is_part_of)[name]
    one = [_quad(s, F.col(s.name)) for s in c.slots if s.name != "id" and not s.many and s.name in entities.columns]
    many = [_each(s) for s in c.slots if s.many and s.name in entities.columns]
    kind = F.struct(F.lit(RDF_TYPE).alias("predicate"), F.lit(iri(c.curie)).alias("object"), F.lit("iri").alias("object_kind"), F.lit(None).cast("string").alias("datatype"))
    rows = entities.select(fn.expand_curie(F.col("id")).alias("subject"), F.explode(F.concat(F.array(kind, *one), *many)).alias("q"))
    rows = rows.where(F.col("q.object").isNotNull())
    return rows.select(F.lit(graph).cast("string").alias("graph"), "subject", "q.predicate", "q.object", "q.object_kind", "q.datatype", F.lit(None).cast("string").alias("lang"))


def entities_of(quads: DataFrame, name: str, subject: str | None = None, strict_is_part_of: bool = True) -> DataFrame:
    """Entities of a class by one aggregation over its slots; predicates of no slot are left out, references become CURIEs, lists are sorted.

    A slot with several values where one is allowed takes the least.
    """
    c = classes(strict_is_part_of)[name]
    slots = [s for s in c.slots if s.name != "id"]
    q = about(quads, subject) if subject else quads
    q = q.where(F.col("predicate").isin([RDF_TYPE, *(iri(s.curie) for s in slots)]))
    cols = []
    for s in slots:
        value = F.when(F.col("predicate") == iri(s.curie), F.col("object") if s.kind in _LITERAL else fn.contract_iri(F.col("object")))
        value = F.array_sort(F.collect_set(value)) if s.many else F.min(value).cast({"integer": "bigint", "float": "double"}.get(s.kind, "string"))
        cols.append(value.alias(s.name))
    typed = F.bool_or((F.col("predicate") == RDF_TYPE) & (F.col("object") == iri(c.curie)))
    got = q.groupBy("subject").agg(typed.alias("_typed"), *cols).where("_typed")
    return got.select(fn.contract_iri(F.col("subject")).alias("id"), *(s.name for s in slots))


def about(quads: DataFrame, subject: str) -> DataFrame:
    """Quads of one subject, a CURIE or IRI; the filter reaches the scan."""
    return quads.where(F.col("subject") == iri(subject))


def union(*graphs: DataFrame) -> DataFrame:
    """Graphs as sets."""
    return reduce(DataFrame.unionByName, graphs).dropDuplicates()


def chain(items: DataFrame, descriptors: DataFrame, types: DataFrame, methods: DataFrame) -> DataFrame:
    """Item, its descriptors, their types and methods, by references."""
    i = items.select(F.col("id").alias("item"), F.col("label").alias("item_label"), F.explode("hasDescriptor").alias("descriptor"))
    d = descriptors.select(F.col("id").alias("descriptor"), "value", "coverage", "length", "offset", "hasType")
    t = types.select(F.col("id").alias("hasType"), F.col("label").alias("type_label"), "usesMethod")
    m = methods.select(F.col("id").alias("usesMethod"), F.col("label").alias("method_label"), "robustness")
    return i.join(d, "descriptor").join(t, "hasType").join(m, "usesMethod").select("item", "item_label", "descriptor", "coverage", "value", "length", "offset", F.col("hasType").alias("type"), "type_label", F.col("usesMethod").alias("method"), "method_label", "robustness")


def closure(edges: DataFrame, starts: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(source, node, depth): what each source (start, or node with an edge) reaches, at its least depth; cycles end where a pair is known.

    Breadth first: a round joins only the pairs that the last one found, and
    what it finds is written to the checkpoint folder, once.
    """
    e = checkpoint(edges.select(F.col("src").alias("src"), F.col("dst").alias("dst")).distinct())
    first = e if starts is None else e.join(starts.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    front = checkpoint(first.select(F.col("src").alias("source"), F.col("dst").alias("node"), F.lit(1).alias("depth")))
    fronts, depth = [front], 1
    while not front.isEmpty() and (max_depth is None or depth < max_depth):
        depth += 1
        step = front.join(e, front["node"] == e["src"]).select("source", F.col("dst").alias("node"), F.lit(depth).alias("depth")).distinct()
        known = reduce(DataFrame.unionAll, fronts).select("source", "node")
        front = checkpoint(step.join(known, ["source", "node"], "left_anti").select("source", "node", "depth"))
        fronts.append(front)
    return reduce(DataFrame.unionAll, fronts)


