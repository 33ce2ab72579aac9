"""Scalar functions as column expressions; none leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import PREFIXES

UNITS = ((50, "PB"), (40, "TB"), (30, "GB"), (20, "MB"), (10, "KB"))


def human_size(n: Column) -> Column:
    """Bytes with one decimal in the largest unit reached; plain below 1024. format_number rounds half to even, as %.1f does elsewhere."""
    out = None
    for power, unit in UNITS:
        text = F.concat(F.replace(F.format_number(n / F.lit(float(2**power)), 1), F.lit(","), F.lit("")), F.lit(f" {unit}"))
        out = (F if out is None else out).when(n >= 2**power, text)
    return out.otherwise(n.cast("string"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value bound as a variable: what stands in a lambda is computed, and bytes are copied, again for each element."""
    return F.transform(F.array(value), use)[0]


def digest(data: Column, algorithm: str) -> Column:
    """Lower-case hex digest of binary data."""
    if algorithm == "md5":
        return F.md5(data)
    if algorithm == "sha1":
        return F.sha1(data)
    if algorithm in ("sha256", "sha512"):
        return F.sha2(data, int(algorithm[3:]))
    raise ValueError(f"unknown algorithm {algorithm!r}")


def url(bucket: Column, key: Column) -> Column:
    return F.concat(F.lit("s3://"), bucket, F.lit("/"), key)


def parse_url(u: Column) -> tuple[Column, Column]:
    """(bucket, key); every "s3://" is taken out, then the first slash divides."""
    parts = F.split(F.replace(u, F.lit("s3://"), F.lit("")), "/", 2)
    return parts.getItem(0), F.get(parts, F.lit(1))


def range_header(offset: Column, length: Column) -> Column:
    """HTTP range of length bytes from offset; open-ended if length is null or 0."""
    end = F.when(F.coalesce(length, F.lit(0)) != 0, (offset + length - 1).cast("string")).otherwise(F.lit(""))
    return F.concat(F.lit("bytes="), offset.cast("string"), F.lit("-"), end)


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def task_line(u: Column, size: Column, method: Column, block_size: Column, offset: Column) -> Column:
    return F.concat_ws(" ", u, size.cast("string"), method, block_size.cast("string"), offset.cast("string"))


def listing_line(bucket: Column, key: Column, size: Column, modified: Column, etag: Column) -> Column:
    """Key padded to 110 and size to 12, never cut."""
    return F.format_string("s3://%s/%-110s: %-12s %s %s", bucket, key, human_size(size), day(modified), etag)


def annotation_line(u: Column, checksum: Column) -> Column:
    return F.format_string("<%s>  %s", u, checksum)


def needs_offsets(block_size: Column) -> Column:
    return block_size != 0


def words(line: Column) -> Column:
    """Trimmed line, split at white space; empty for a blank one."""
    t = F.regexp_replace(line, r"^\s+|\s+$", "")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"\s+"))


def integer(text: Column) -> Column:
    """Bad input is an error under ANSI mode."""
    return text.cast("bigint")


def expand_curie(curie: Column, prefixes: dict[str, str] = PREFIXES) -> Column:
    """prefix:local to its IRI; what has no known prefix stays."""
    table = F.expr("map(" + ", ".join(f"'{p}', '{base}'" for p, base in prefixes.items()) + ")")
    base = F.try_element_at(table, F.substring_index(curie, ":", 1))
    known = curie.contains(":") & base.isNotNull()
    return F.when(known, F.concat(base, F.substring(curie, F.instr(curie, ":") + 1, F.length(curie)))).otherwise(curie)


def contract_iri(i: Column, prefixes: dict[str, str] = PREFIXES) -> Column:
    """An IRI to prefix:local by the longest base that it begins with."""
    out = None
    for p, base in sorted(prefixes.items(), key=lambda kv: -len(kv[1])):
        hit = i.startswith(base)
        out = (F if out is None else out).when(hit, F.concat(F.lit(p + ":"), F.substring(i, len(base) + 1, 2**31 - 1)))
    return i if out is None else out.otherwise(i)


def coverage(length: Column, size: Column) -> Column:
    """Fraction of the item that a descriptor covers; 1 for an empty item."""
    return F.when(size > 0, length / size).otherwise(F.lit(1.0))


def as_list(x: Column) -> Column:
    """A scalar to a list of one, null to none."""
    return F.when(x.isNull(), F.array().cast("array<string>")).otherwise(F.array(x.cast("string")))


def reversed_trimmed(text: Column) -> Column:
    return F.trim(F.reverse(text))


def urlsafe_base64(data: Column) -> Column:
    return F.translate(F.base64(data), "+/", "-_")
