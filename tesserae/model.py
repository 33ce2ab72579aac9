"""The data model: hash methods, entity classes, slots, prefixes and row types."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import types as T

GIB = 1 << 30

# Hash methods


@dataclass(frozen=True)
class Method:
    """How objects are hashed: in blocks of block_size bytes, or whole if that is 0."""

    id: str
    algorithm: str
    block_size: int = 0

    @property
    def needs_offsets(self) -> bool:
        return self.block_size != 0


#: The three methods of the planner, then extensions by the same rule.
METHODS = {f"{a}{s}": Method(f"{a}{s}", a, n) for a in ("md5", "sha1", "sha256", "sha512") for s, n in (("", 0), ("-2gb", 2 * GIB), ("-8gb", 8 * GIB))}
CORE_METHODS = ("md5", "md5-2gb", "md5-8gb")
DEFAULT_METHOD = "md5-8gb"


def method_by_id(method_id: str) -> Method:
    """The registered method, or ValueError."""
    if method_id not in METHODS:
        raise ValueError(f"unknown method {method_id!r}; known: {', '.join(METHODS)}")
    return METHODS[method_id]


# Names

TERM, DATA = "voc", "dat"
_W3, _W3ID = "http://www.w3.org/", "https://w3id.org/"
_PURL, _QUDT = "http://purl.org/dc/", "http://qudt.org/"
PREFIXES = {
    TERM: "https://example.org/descriptor/",
    DATA: "https://example.org/data/",
    "unit": _QUDT + "vocab/unit/",
    "rdfs": _W3 + "2000/01/rdf-schema#",
    "dcmi": _PURL + "dcmitype/",
    "xsd": _W3 + "2001/XMLSchema#",
    "qudt": _QUDT + "schema/qudt/",
    "dct": _PURL + "terms/",
    "xml": _W3 + "XML/1998/namespace",
    "linkml": _W3ID + "linkml/",
    "rdf": _W3 + "1999/02/22-rdf-syntax-ns#",
}


def iri(curie: str, prefixes: dict[str, str] = PREFIXES) -> str:
    p, _, local = curie.partition(":")
    return prefixes[p] + local if p in prefixes else curie


RDF_TYPE = iri("rdf:type")

# Classes

#: Strongest first.
ROBUSTNESS = tuple("EXTREMELY_HIGH VERY_HIGH HIGH MODERATE LOW VERY_LOW".split())


@dataclass(frozen=True)
class Slot:
    name: str
    curie: str
    kind: str = "string"  #: string, integer, float, uri, enum or a class's name
    required: bool = False
    many: bool = False


@dataclass(frozen=True)
class Class:
    name: str
    parent: str | None
    slots: tuple[Slot, ...] = field(default=())

    @property
    def curie(self) -> str:
        return f"{TERM}:{self.name}"

    def slot(self, name: str) -> Slot:
        return next(s for s in self.slots if s.name == name)


_ID = Slot("id", f"{TERM}:id", "uri", True)
_LABEL = Slot("label", "rdfs:label", "string", True)
_HAS = Slot("hasDescriptor", f"{TERM}:hasDescriptor", "Descriptor", False, True)
_own = lambda name, kind, required: Slot(name, f"{TERM}:{name}", kind, required)


@lru_cache
def classes(strict_is_part_of: bool = True) -> dict[str, Class]:
    """All classes, parents before children, with inherited slots."""
    return {
        c.name: c
        for c in (
            Class("Thing", None, (_ID,)),
            Class("DescribableThing", "Thing", (_ID, _HAS)),
            Class("Item", "DescribableThing", (_ID, _LABEL, Slot("isPartOf", "dct:isPartOf", "uri", strict_is_part_of), _HAS)),
            Class("Descriptor", "DescribableThing", (_ID, _own("hasType", "DescriptorType", True), _own("value", "string", True), _own("offset", "integer", True), _own("length", "integer", False), _own("coverage", "float", True), Slot("label", "rdfs:label"), _HAS)),
            Class("DescriptorType", "Thing", (_ID, _LABEL, _own("usesMethod", "Method", True), _own("max_block_size", "integer", False))),
            Class("Method", "Thing", (_ID, _LABEL, Slot("comment", "rdfs:comment"), _own("robustness", "enum", True))),
        )
    }


CONCRETE = ("Item", "Descriptor", "DescriptorType", "Method")
_SPARK = {"integer": T.LongType(), "float": T.DoubleType()}


def entity_schema(name: str, strict_is_part_of: bool = True) -> T.StructType:
    """Row type of a class's entities."""
    out = []
    for s in classes(strict_is_part_of)[name].slots:
        kind = _SPARK.get(s.kind, T.StringType())
        out.append(T.StructField(s.name, T.ArrayType(T.StringType()) if s.many else kind, not s.required))
    return T.StructType(out)


# Rows

OBJECTS = "bucket string, key string, last_modified timestamp, etag string, size long"
TASKS = "task_num long, url string, size long, method string, block_size long, offset long"
ANNOTATIONS = "url string, offset long, length long, method string, checksum string"
QUADS = "graph string, subject string, predicate string, object string, object_kind string, datatype string, lang string"
