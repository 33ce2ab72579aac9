import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae import functions as fn
from tesserae.model import METHODS, method_by_id

SIZES = {500: "500", 1023: "1023", 1024: "1.0 KB", 2048: "2.0 KB", 15360: "15.0 KB", 2**20: "1.0 MB", 5 * 2**20: "5.0 MB", 50 * 2**20: "50.0 MB", 2**30: "1.0 GB", 3 * 2**30: "3.0 GB", 10 * 2**30: "10.0 GB", 3 * 2**40: "3.0 TB", 10 * 2**40: "10.0 TB", 3 * 2**50: "3.0 PB", 10 * 2**50: "10.0 PB", 0: "0", -1024: "-1024", 1280: "1.2 KB", 1048575: "1024.0 KB", 328226892212: "305.7 GB"}


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_human_size(spark):
    rows = spark.createDataFrame([(n,) for n in SIZES], "n long").select("n", fn.human_size(F.col("n")).alias("t")).collect()
    assert {r.n: r.t for r in rows} == SIZES


def test_human_size_as_python_formats(spark):
    import random

    rnd = random.Random(1)
    ns = [rnd.randrange(2 ** rnd.randrange(11, 59)) for _ in range(3000)] + [2**p * k // 20 for p in (10, 20, 30, 40, 50) for k in range(20, 200)]

    def want(n):
        for p, u in fn.UNITS:
            if n >= 2**p:
                return f"{n / 2**p:.1f} {u}"
        return str(n)

    rows = spark.createDataFrame([(n,) for n in ns], "n long").select("n", fn.human_size(F.col("n")).alias("t")).collect()
    assert [(r.n, r.t) for r in rows] == [(n, want(n)) for n in ns]


@pytest.mark.parametrize("url, bucket, key", [("s3://b/k/x", "b", "k/x"), ("b/k", "b", "k"), ("s3://b/s3://k", "b", "k"), ("s3://b", "b", None)])
def test_parse_url(spark, url, bucket, key):
    b, k = fn.parse_url(F.lit(url))
    assert (one(spark, b), one(spark, k)) == (bucket, key)


@pytest.mark.parametrize("offset, length, text", [(0, 1000, "bytes=0-999"), (5, None, "bytes=5-"), (5, 0, "bytes=5-")])
def test_range_header(spark, offset, length, text):
    assert one(spark, fn.range_header(F.lit(offset), F.lit(length))) == text


def test_curies(spark):
    assert one(spark, fn.expand_curie(F.lit("dct:isPartOf"))) == "http://purl.org/dc/terms/isPartOf"
    assert one(spark, fn.expand_curie(F.lit("http://x/y"))) == "http://x/y" and one(spark, fn.expand_curie(F.lit("plain"))) == "plain"
    assert one(spark, fn.contract_iri(F.lit("http://purl.org/dc/terms/isPartOf"))) == "dct:isPartOf"
    assert one(spark, fn.contract_iri(F.lit("ab"), {"x": "a", "y": "ab"})) == "y:"


def test_words_integers_lists(spark):
    assert one(spark, fn.words(F.lit(" a  b\tc\n"))) == ["a", "b", "c"] and one(spark, fn.words(F.lit(" \n"))) == []
    assert one(spark, fn.as_list(F.lit("x"))) == ["x"] and one(spark, fn.as_list(F.lit(None))) == []
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(spark, fn.integer(F.lit("1x")))


def test_lines(spark):
    line = one(spark, fn.listing_line(F.lit("b"), F.lit("k" * 120), F.lit(2048), F.timestamp_seconds(F.lit(86400)), F.lit("e")))
    assert line == f"s3://b/{'k' * 120}: {'2.0 KB':12} 1970-01-02 e"
    assert one(spark, fn.annotation_line(F.lit("s3://b/k"), F.lit("00"))) == "<s3://b/k>  00"
    assert one(spark, fn.reversed_trimmed(F.lit("abc "))) == "cba" and one(spark, fn.urlsafe_base64(F.lit(b"\xfb\xff"))) == "-_8="
    assert [one(spark, fn.coverage(F.lit(n), F.lit(s))) for n, s in ((1, 4), (0, 0))] == [0.25, 1.0]


def test_methods():
    assert {m: METHODS[m].block_size for m in ("md5", "md5-2gb", "md5-8gb")} == {"md5": 0, "md5-2gb": 2147483648, "md5-8gb": 8589934592}
    assert not method_by_id("md5").needs_offsets and method_by_id("md5-2gb").needs_offsets
    with pytest.raises(ValueError, match="md5-8gb"):
        method_by_id("md5_8gb")


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="ab:/ é", max_size=8), min_size=1, max_size=20))
def test_expand_then_contract_known_names(spark, names):
    df = spark.createDataFrame([(f"dat:{n}",) for n in names], "c string")
    assert all(r.c == r.d for r in df.select("c", fn.contract_iri(fn.expand_curie(F.col("c"))).alias("d")).collect())


def test_rules_are_those_written_by_hand():
    from tesserae import queries
    from tesserae.operators import checks

    assert sorted(checks.required_rules()) == sorted(queries.REQUIRED_BY_HAND)
    assert sorted(checks.permitted_rules()) == sorted(queries.PERMITTED_BY_HAND)
    assert sorted(checks.range_rules()) == sorted(queries.RANGES_BY_HAND)


def test_digests_of_known_inputs(spark):
    import hashlib

    from pyspark.sql import functions as F

    from tesserae import functions as fn

    data = [b"", b"abc", bytes(range(256)) * 99]
    rows = spark.createDataFrame([(x,) for x in data], "x binary")
    for a in ("md5", "sha1", "sha256", "sha512"):
        assert [r.h for r in rows.select(fn.digest(F.col("x"), a).alias("h")).collect()] == [hashlib.new(a, x).hexdigest() for x in data]
    assert rows.select(fn.digest(F.col("x"), "sha512").alias("h")).collect()[1].h.startswith("ddaf35a193617abacc417349ae204131")
