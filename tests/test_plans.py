import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae import plans
from tesserae.model import GIB, METHODS, Method
from tesserae.operators import checksum
from tesserae.queries import QUERIES


@pytest.mark.parametrize("block, length, want", [(1024, 4096, [0, 1024, 2048, 3072]), (1000, 3500, [0, 1000, 2000, 3000]), (1000, 0, []), (5000, 2000, [0]), (1000, -2000, []), (8 * GIB, 35 * GIB, [i * 8 * GIB for i in range(5)])])
def test_offsets(spark, block, length, want):
    assert spark.range(1).select(plans.offsets(F.lit(block), F.lit(length)).alias("o")).first().o == want


def test_offsets_of_one_row_are_spread_over_tasks(spark, tmp_path):
    keys = [None, -5, 0, 101, 4_096_000]  # the last has ten runs of 4,096 offsets
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    got = QUERIES["pln01_offsets"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).toArrow().to_pylist()
    assert sorted((r["c_custkey"], r["offset"]) for r in got) == [(k, o) for k in keys for o in range(0, (k or 0) * 10, 1000)]
    assert max(Counter(r["task"] for r in got).values()) < len(got) * 0.4


@pytest.mark.parametrize("block, length", [(1024, 4096), (7, 7 * 4096), (7, 7 * 4096 + 1), (1, 12288), (1000, 0), (1000, -2000), (7, None), (2**33, 2**50 + 1), (2**40, 2**40 + 1), (2**62, 2**63 - 1)])
def test_exploded_offsets(spark, block, length):
    rows = spark.createDataFrame([("a", block, length)] * 2, "id string, b long, l long")
    got = plans.explode_offsets(rows, F.col("b"), F.col("l"), "o")
    assert got.columns == ["id", "b", "l", "o"]
    assert sorted(r.o for r in got.collect()) == sorted(2 * list(range(0, length or 0, block)))


def test_no_block_size(spark):
    with pytest.raises(Exception, match="block size"):
        spark.range(1).select(plans.offsets(F.col("id"), F.lit(1000)).alias("o")).collect()


@pytest.mark.parametrize("method, size, route, n", [("md5", 2**24 - 1, "small", 0), ("md5", 2**24, "whole", 1), ("md5-2gb", 2**30 - 1, "small", 0), ("md5-2gb", 2**30, "blocks", 1), ("md5-2gb", 2**31, "blocks", 1), ("md5-2gb", 2**31 + 1, "blocks", 2), ("md5-8gb", 2**32 - 1, "small", 0), ("md5-8gb", 2**32, "blocks", 1), ("md5", 0, "small", 0), ("md5-8gb", 2**62, "blocks", 2**29)])
def test_routes(spark, method, size, route, n):
    m = METHODS[method]
    r = spark.range(1).select(plans.route(F.lit(size), m).alias("r"), plans.n_blocks(F.lit(size), m).alias("n")).first()
    assert (r.r, r.n) == (route, n)


def listing(spark, sizes):
    return spark.createDataFrame([("b", f"k{i:03d}", s) for i, s in enumerate(sizes)], "bucket string, key string, size long")


@pytest.mark.parametrize("method, n", [("md5", 5), ("md5-8gb", 41), ("md5-2gb", 155)])
def test_task_counts_of_the_published_runs(spark, method, n):
    sizes = [int(g * GIB) for g in (189.3, 52, 31.3, 33.6)] + [42396, 70460, 42984, 267847]
    t = plans.plan_tasks(listing(spark, sizes), METHODS[method]).collect()
    assert sorted({r.task_num for r in t}) == list(range(1, n + 1)) and sum(r.task_num == n for r in t) == 4


def test_one_large_object(spark):
    t = sorted(plans.plan_tasks(listing(spark, [5 * GIB]), METHODS["md5-2gb"]).collect())
    assert [(r.task_num, r.offset, r.size, r.block_size) for r in t] == [(i + 1, i * 2 * GIB, 5 * GIB, 2 * GIB) for i in range(3)]
    assert plans.plan_tasks(listing(spark, [1]).limit(0), METHODS["md5"]).count() == 0


def test_totals(spark):
    assert tuple(plans.totals(listing(spark, [1, 2, 3])).first()) == (3, 6) and tuple(plans.totals(listing(spark, [1]).limit(0)).first()) == (0, 0)


def test_prefix_and_pieces(spark):
    assert plans.split_prefix("b/x/y") == ("b", "x/y") and plans.split_prefix("b") == ("b", "")
    assert spark.range(1).select(plans.split_bytes(F.lit("hello wörld"), 5).alias("p")).first().p == [b"hello", b" w\xc3\xb6r", b"ld"]


def test_text_is_computed_once_for_all_its_pieces(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        calls.add(1)
        return text

    text = "wörld " * 2000
    long, none, empty = (r.p for r in spark.createDataFrame([(text,), (None,), ("",)], "t string").select(plans.split_bytes(counted("t"), 9).alias("p")).collect())
    assert b"".join(long) == text.encode() and {len(x) for x in long[:-1]} == {9} and none == empty == []
    assert calls.value == 3


def test_content_is_read_once_for_all_its_blocks(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("binary")
    def counted(content):
        calls.add(1)
        return content

    data = bytes(range(256)) * 40
    rows = spark.createDataFrame([(data, len(data)), (b"", 0)], "c binary, n long").select(checksum.blocks(counted("c"), F.col("n"), F.lit(1000), "md5").alias("b")).collect()
    assert [[tuple(b) for b in r.b] for r in rows] == [[(o, len(x[o : o + 1000]), hashlib.md5(x[o : o + 1000]).hexdigest()) for o in range(0, max(len(x), 1), 1000)] for x in (data, b"")]
    assert calls.value == 2


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 2**40), min_size=1, max_size=30), st.sampled_from(["md5", "md5-2gb", "md5-8gb"]))
def test_tasks_tile_every_object_and_number_densely(spark, sizes, method):
    t = plans.with_length(plans.plan_tasks(listing(spark, sizes), METHODS[method])).collect()
    nums = sorted({r.task_num for r in t})
    assert nums == list(range(nums[0], nums[-1] + 1))
    by = {}
    for r in sorted(t, key=lambda r: r.offset):
        assert by.setdefault(r.url, 0) == r.offset
        by[r.url] += r.length
    assert [by[f"s3://b/k{i:03d}"] for i in range(len(sizes))] == sizes
    large = [(r.url, r.offset) for r in sorted(t, key=lambda r: r.task_num) if r.task_num != nums[-1]]
    assert large == sorted(large)


def test_a_new_method(spark):
    t = plans.plan_tasks(listing(spark, [2**25]), Method("own", "sha1", 2**24)).collect()
    assert sorted(r.offset for r in t) == [0, 2**24]
