import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tesserae import cli, sources
from tesserae.model import METHODS, PREFIXES, Method, iri
from tesserae.operators import annotate, checks, checksum, rdf
from tesserae.plans import plan_tasks
from tesserae.sources import sinks
from tesserae.streaming import annotate_stream, arriving_objects

TTL = """@prefix voc: <https://example.org/descriptor/> . # names
@prefix dat: <https://example.org/data/> .
dat:i1 a voc:Item ; rdfs:label "A \\"short\\" file\\n"@en ; dct:isPartOf "https://example.org/set"^^xsd:anyURI ; voc:hasDescriptor dat:d1, dat:d2 .
dat:d1 a voc:Descriptor ; voc:hasType dat:t ; voc:value "00ff" ; voc:offset 0 ; voc:length 4096 ; voc:coverage "1.0"^^xsd:float ; .
dat:t a voc:DescriptorType ; rdfs:label "whole" ; voc:usesMethod dat:m .
<https://example.org/data/m> a voc:Method ; rdfs:label "SHA256" ; voc:robustness "EXTREMELY_HIGH" .
"""

TTL = "".join(f"@prefix {p}: <{PREFIXES[p]}> .\n" for p in ("xsd", "rdfs", "dct")) + TTL


@pytest.fixture
def store(tmp_path):
    for name, size in (("b/x/one.bin", 10), ("b/x/two words.bin", 5000), ("b/xyz", 0), ("b/other", 3)):
        p = tmp_path / "store" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(bytes(i % 251 for i in range(size)))
    return tmp_path / "store"


def test_listing_of_files(spark, store):
    rows = sources.list_files(spark, "b", str(store / "b"), "x").collect()
    assert [(r.key, r.size) for r in rows] == [("x/one.bin", 10), ("x/two words.bin", 5000), ("xyz", 0)]
    assert sources.list_files(spark, "b", str(store / "b"), "nothing").count() == 0 == sources.empty_listing(spark).count()


def test_saved_api_pages(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"Contents":[{"Key":"a","LastModified":"2021-01-01T00:00:00Z","ETag":"e","Size":5}],"IsTruncated":true,"NextContinuationToken":"n"}\n{"Contents":[{"Key":"b","LastModified":"2021-01-02T00:00:00Z","ETag":"f","Size":6}],"IsTruncated":false}\n{"IsTruncated":false}\n')
    assert [(r.bucket, r.key, r.size, str(r.last_modified)[:10]) for r in sources.api_pages(spark, str(tmp_path), "b").orderBy("key").collect()] == [("b", "a", 5, "2021-01-01"), ("b", "b", 6, "2021-01-02")]


@pytest.mark.parametrize("offset, length", [(0, None), (0, 0), (100, 1000), (4990, 100), (6000, 5)])
def test_ranges(spark, store, offset, length):
    p = store / "b/x/two words.bin"
    data = p.read_bytes()[offset:]
    want = hashlib.md5(data[:length] if length else data).hexdigest()
    assert checksum.file_checksum(str(p), offset, length) == want
    got = spark.createDataFrame([(p.read_bytes(),)], "c binary").select(checksum.range_checksum(F.col("c"), F.lit(offset), F.lit(length).cast("int")).alias("h")).first().h
    assert got == want


def test_tasks_from_files_to_annotations(spark, store, tmp_path):
    m = Method("md5-own", "md5", 2048)
    (store / "b/big.bin").write_bytes(os.urandom(2**24 + 5))
    objects = sources.list_files(spark, "b", str(store / "b")).where("key not like '% %'")
    tasks = plan_tasks(objects, m)
    sinks.write_task_files(tasks.where("offset < 20000"), str(tmp_path / "tasks"))
    back = sources.read_tasks(spark, str(tmp_path / "tasks"))
    got = {(r.url, r.offset): r for r in checksum.checksum_tasks(back, str(store), m).collect()}
    data = (store / "b/big.bin").read_bytes()
    for o in range(0, 20000, 2048):
        assert got["s3://b/big.bin", o].checksum == hashlib.md5(data[o : o + 2048]).hexdigest()
    assert got["s3://b/xyz", 0].checksum == hashlib.md5(b"").hexdigest() and got["s3://b/x/one.bin", 0].length == 10
    sinks.write_annotations(checksum.checksum_tasks(back, str(store), m), str(tmp_path / "out"), one_file=True)
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines == sorted(lines, key=lambda x: x.split(">")[0]) and f"<s3://b/x/one.bin>  {hashlib.md5((store / 'b/x/one.bin').read_bytes()).hexdigest()}" in lines


def test_task_lines(spark):
    lines = spark.createDataFrame([("",), ("  s3://b/k 5 md5 0 0 ",), (" \t",)], "value string")
    assert [tuple(r) for r in sources.task_rows(lines).collect()] == [("s3://b/k", 5, "md5", 0, 0)]
    with pytest.raises(Exception, match="Invalid number of components: 3"):
        sources.task_rows(spark.createDataFrame([("a b c",)], "value string")).collect()
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        sources.task_rows(spark.createDataFrame([("a x c 0 0",)], "value string")).collect()


def test_turtle_to_ntriples_and_back(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(TTL)
    q = sources.read_turtle(spark, str(tmp_path / "a.ttl"), "g")
    assert q.count() == 17
    sinks.write_ntriples(q, str(tmp_path / "nt"))
    again = sources.read_ntriples(spark, str(tmp_path / "nt"), "g")
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, q.collect()), key=str)
    with pytest.raises(ValueError, match="prefix"):
        sources.parse_turtle("x:a x:b x:c .")
    with pytest.raises(Exception, match="not an N-Triples line"):
        sources.ntriples(spark.createDataFrame([("<a> b",)], "value string")).collect()


def test_checks_of_the_fixture(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(TTL)
    q = sources.read_turtle(spark, str(tmp_path / "a.ttl"), "g").where(F.col("object") != iri("dat:d2"))
    rows = checks.check_all(q).collect()
    assert sorted((r.subject.rsplit("/")[-1], r.predicate.rsplit("/")[-1]) for r in rows) == [(s, "id") for s in ("d1", "i1", "m", "t")]
    assert checks.check_all(sources.read_turtle(spark, str(tmp_path / "a.ttl"))).count() == 0  # default graph
    dangling = checks.object_range(sources.read_turtle(spark, str(tmp_path / "a.ttl"), "g")).collect()
    assert [r.object for r in dangling] == [iri("dat:d2")]
    kinds = checks.shapes(q).groupBy("constraint").count().collect()
    assert {r.constraint: r["count"] for r in kinds} == {"minCount": 4}


def test_entities_round_trip_and_chain(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(TTL)
    q = sources.read_turtle(spark, str(tmp_path / "a.ttl"), "g")
    e = {n: rdf.entities_of(q, n) for n in ("Item", "Descriptor", "DescriptorType", "Method")}
    assert e["Item"].first().asDict() == {"id": "dat:i1", "label": 'A "short" file\n', "isPartOf": "https://example.org/set", "hasDescriptor": ["dat:d1", "dat:d2"]}
    d = e["Descriptor"].first()
    assert (d.offset, d.length, d.coverage, d.value, d.label, d.hasDescriptor) == (0, 4096, 1.0, "00ff", None, [])
    row = rdf.chain(e["Item"], e["Descriptor"], e["DescriptorType"], e["Method"]).collect()
    assert [(r.descriptor, r.method_label, r.robustness) for r in row] == [("dat:d1", "SHA256", "EXTREMELY_HIGH")]
    back = rdf.union(*(rdf.quads_of(x, n, "g") for n, x in e.items()))
    assert back.select("subject", "predicate", "object").exceptAll(q.select("subject", "predicate", "object")).count() == 0
    assert back.count() == q.count()
    assert rdf.entities_of(q, "Method", "dat:m").count() == 1 and rdf.about(q, "dat:nobody").count() == 0


def test_closure_ends_in_cycles(spark):
    e = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert sorted(tuple(r) for r in rdf.closure(e, spark.createDataFrame([("a",)], "node string")).collect()) == [("a", "a", 1), ("a", "b", 1), ("a", "c", 2)]
    assert rdf.closure(e, max_depth=1).count() == 4


def test_entity_documents(spark, tmp_path):
    (tmp_path / "m.yaml").write_text('# one\nrobustness: "VERY_HIGH"\nid: "dat:m"\nlabel: "MD5"\ncomment: >-\n  two\n  lines\n')
    (tmp_path / "i.json").write_text('{"id": "dat:i", "label": "f", "hasDescriptor": ["dat:d"], "@type": "Item"}')
    m = sources.read_yaml(spark, str(tmp_path / "m.yaml"), "Method")
    assert m.first().asDict() == {"id": "dat:m", "label": "MD5", "comment": "two lines", "robustness": "VERY_HIGH"}
    i = sources.read_json(spark, str(tmp_path / "i.json"), "Item")
    assert i.first().hasDescriptor == ["dat:d"] and [tuple(r) for r in checks.invalid_entities(i, "Item").collect()] == [("dat:i", "isPartOf", "missing")]
    assert checks.invalid_entities(i, "Item", strict_is_part_of=False).count() == 0
    assert sinks.to_json(i, "Item").first().value == '{"id":"dat:i","label":"f","hasDescriptor":["dat:d"],"@type":"Item"}'
    assert sinks.to_yaml(m, "Method").first().value.startswith("id: dat:m\nlabel: MD5\n")
    assert checks.unknown_columns(i.withColumn("x", F.lit(1)), "Item") == ["x"]
    (tmp_path / "bad.yaml").write_text("id: x\npokemon: y\n")
    with pytest.raises(Exception, match="not an entity"):
        sources.read_yaml(spark, str(tmp_path / "bad.yaml"), "Item").collect()


def test_descriptors_of_annotations(spark):
    a = spark.createDataFrame([("s3://b/k", 0, 50, "md5", "00")], "url string, offset long, length long, method string, checksum string")
    d = annotate.descriptors(a, spark.createDataFrame([("s3://b/k", 200)], "url string, size long")).first()
    assert (d.id, d.value, d.coverage) == ("s3://b/k#md5-0", "00", 0.25)


def test_command_line(spark, store, tmp_path, capsys):
    root = ["--root", str(store)]
    assert cli.main([*root, "list", "b/x/one", "--task-dir", str(tmp_path / "t")]) == 0
    assert "Total size: 10 in 1 files" in capsys.readouterr().out
    assert cli.main([*root, "annotate", str(tmp_path / "t"), str(tmp_path / "a")]) == 0
    assert cli.main([*root, "combine", str(tmp_path / "a"), str(tmp_path / "c")]) == 0
    h = hashlib.md5((store / "b/x/one.bin").read_bytes()).hexdigest()
    assert [r.value for r in spark.read.text(str(tmp_path / "c")).collect()] == [f"<s3://b/x/one.bin>  {h}"]
    capsys.readouterr()
    assert cli.main([*root, "checksum", "s3://b/x/one.bin", "--length", "4"]) == 0
    assert capsys.readouterr().out == f"Checksum: {hashlib.md5(bytes(range(4))).hexdigest()}\n"


def test_stream_of_arriving_files(spark, store, tmp_path):
    q = annotate_stream(arriving_objects(spark, "b", str(store / "b/x")), METHODS["sha256"], str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.checksum for r in rows} == {hashlib.sha256(p.read_bytes()).hexdigest() for p in (store / "b/x").iterdir()}


def test_stream_keys_are_whole_paths(spark, store, tmp_path):
    q = annotate_stream(arriving_objects(spark, "b", str(store / "b")), METHODS["md5"], str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["s3://b/other", "s3://b/x/one.bin", "s3://b/x/two words.bin"]


@pytest.mark.parametrize("prefix, folders", [("", ["x/", "x/deep/", "x/deep/er/"]), ("x/deep/e", ["x/deep/er/"]), ("x/one", []), ("x/deep/er/", []), ("none/y", [])])
def test_only_folders_under_the_prefix_are_listed(spark, store, prefix, folders):
    (store / "b/x/deep/er").mkdir(parents=True)
    (store / "b/x/deep/er/f").write_bytes(b"1")
    rows = sources.walk(spark, str(store / "b"), prefix).collect()
    assert sorted(r.key for r in rows if r.folder) == folders
    keys = ["other", "x/deep/er/f", "x/one.bin", "x/two words.bin", "xyz"]
    assert sorted(r.key for r in rows if not r.folder) == [k for k in keys if k.startswith(prefix)] == [r.key for r in sources.list_files(spark, "b", str(store / "b"), prefix).collect()]


def test_pages_are_followed_by_their_tokens(spark):
    def fetch(prefix, token):
        at = int(token or 0)
        more = at < 4
        return {"Contents": [{"Key": f"{prefix}{at + i}", "Size": at + i, "ETag": "e"} for i in range(2)], "IsTruncated": more} | ({"NextContinuationToken": str(at + 2)} if more else {})

    rows = sources.list_pages(spark, "b", ["x/", "y/"], fetch).orderBy("key").collect()
    assert [(r.bucket, r.key, r.size) for r in rows] == [("b", f"{p}{i}", i) for p in ("x/", "y/") for i in range(6)]
    assert sources.list_pages(spark, "b", ["x/"], lambda p, t: {"IsTruncated": False}).count() == 0


@pytest.mark.parametrize("method", ["sha256", "sha512", "sha1-2gb", "md5"])
def test_annotate_uses_the_method_of_each_line(spark, store, tmp_path, method):
    root = ["--root", str(store)]
    assert cli.main([*root, "list", "b/x/", "--task-dir", str(tmp_path / "t"), "--method-id", method]) == 0
    (tmp_path / "t/task_1").write_text(f"s3://b/x/one.bin 10 {method} {METHODS[method].block_size} 0\n")
    assert cli.main([*root, "annotate", str(tmp_path / "t"), str(tmp_path / "a")]) == 0
    h = hashlib.new(METHODS[method].algorithm, (store / "b/x/one.bin").read_bytes()).hexdigest()
    assert [r.value for r in spark.read.text(str(tmp_path / "a")).collect()] == [f"<s3://b/x/one.bin>  {h}"]
    (tmp_path / "t/task_1").write_text("s3://b/x/one.bin 10 other 0 0\n")
    with pytest.raises(Exception, match="unknown method 'other'"):
        cli.main([*root, "annotate", str(tmp_path / "t"), str(tmp_path / "b")])


def test_task_files(spark, tmp_path):
    objects = spark.createDataFrame([("b", "big", 5 << 21), ("b", "huge", 1 << 25), ("b", "s1", 5), ("b", "s2", 0)], "bucket string, key string, size long")
    m = Method("own", "md5", 1 << 23)
    sinks.write_task_files(plan_tasks(objects, m), str(tmp_path / "t"))
    line = lambda k, n, o: f"s3://b/{k} {n} own {1 << 23} {o}\n"
    want = {f"task_{i + 1}": line("huge", 1 << 25, i << 23) for i in range(4)} | {"task_5": line("big", 5 << 21, 0) + line("s1", 5, 0) + line("s2", 0, 0)}
    assert {p.name: p.read_text() for p in (tmp_path / "t").iterdir() if not p.name.startswith(".")} == want
    assert sources.read_tasks(spark, str(tmp_path / "t")).count() == 7
    sinks.write_task_files(plan_tasks(objects.where("key = 'huge'"), m), str(tmp_path / "u"))
    assert (tmp_path / "u/task_5").read_text() == "" and len(list((tmp_path / "u").iterdir())) == 5
    sinks.write_task_files(plan_tasks(objects.limit(0), m), str(tmp_path / "v"))
    assert [p.name for p in (tmp_path / "v").iterdir()] == ["task_1"]


def test_combine_keeps_the_order_of_blocks(spark, tmp_path):
    (tmp_path / "one").write_text("".join(f"<s3://b/z>  {i:032x}\n" for i in (9, 3, 7)) + f"<s3://b/a>  {5:032x}\n")
    (tmp_path / "two").write_text("".join(f"<s3://b/{k}>  {i:032x}\n" for k, i in (("z", 1), ("a", 0), ("z", 2))))
    assert cli.main(["combine", str(tmp_path / "one"), str(tmp_path / "two"), str(tmp_path / "out")]) == 0
    want = [("a", 5), ("a", 0), ("z", 9), ("z", 3), ("z", 7), ("z", 1), ("z", 2)]
    assert (tmp_path / "out").read_text() == "".join(f"<s3://b/{k}>  {i:032x}\n" for k, i in want)


def test_json_entities_are_closed(spark, tmp_path):
    (tmp_path / "i.json").write_text('{"id": "dat:i", "pokemon": 1}')
    with pytest.raises(Exception, match="not an entity"):
        sources.read_json(spark, str(tmp_path / "i.json"), "Item").collect()
    (tmp_path / "many.json").write_text('[{"id": "dat:i"}, {"id": "dat:j", "hasDescriptor": null}]')
    assert [(r.id, r.hasDescriptor) for r in sources.read_json(spark, str(tmp_path / "many.json"), "Item").collect()] == [("dat:i", []), ("dat:j", [])]


def test_turtle_written_and_read(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(TTL)
    q = sources.read_turtle(spark, str(tmp_path / "a.ttl"), "g")
    sinks.write_turtle(q, str(tmp_path / "out"))
    assert sorted(map(tuple, sources.read_turtle(spark, str(tmp_path / "out"), "g").collect()), key=str) == sorted(map(tuple, q.collect()), key=str)


def test_describe_a_prefix(spark, store):
    rows = annotate.describe(spark, "b", str(store), "x/", METHODS["sha1"]).collect()
    assert [(r.url, r.length, r.method) for r in rows] == [("s3://b/x/one.bin", 10, "sha1"), ("s3://b/x/two words.bin", 5000, "sha1")]
    assert rows[0].checksum == hashlib.sha1((store / "b/x/one.bin").read_bytes()).hexdigest()


def test_coercion(spark):
    df = spark.createDataFrame([("dat:d", "dat:t", "5", "0.5", "dat:x")], "id string, hasType string, offset string, coverage string, hasDescriptor string")
    r = checks.coerced(df, "Descriptor").first()
    assert (r.offset, r.coverage, r.hasDescriptor, r.value, r.length) == (5, 0.5, ["dat:x"], None, None)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        checks.coerced(df.withColumn("offset", F.lit("x")), "Descriptor").collect()
