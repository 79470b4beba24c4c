import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from bindery.operators.patterns import Graph, values
from bindery.operators.solutions import Solutions, Var
from bindery.sources.catalog import RDF_TYPE
from bindery.sources.detect import columns_profile, detect, discriminator, object_properties, sample_questions
from bindery.sources.formats import ask_text, malformed, ntriples, read_ntriples, result_lines, write_results
from bindery.streaming import watch, windowed_counts


def test_ntriples_round_trip(spark, tmp_path):
    rows = [("http://a/1", "http://p", 'say "hi"\tto\\n\nall'), ("_:b1", "http://q", "http://a/2"), ("http://a/1", "http://p", "é")]
    triples = spark.createDataFrame(rows, "subject string, predicate string, object string")
    path = str(tmp_path / "out")
    ntriples(triples).write.text(path)
    back = read_ntriples(spark, path).select("subject_uri", "predicate", F.coalesce("object_uri", "object_value")).collect()
    assert sorted(map(tuple, back)) == sorted(rows)


def test_ntriples_terms(spark, tmp_path):
    (tmp_path / "x.nt").write_text('<http://a> <http://p> "x"@en .\n# note\n<http://a> <http://p> "1"^^<http://t> .\nnonsense\n')
    got = sorted(map(tuple, read_ntriples(spark, str(tmp_path / "x.nt")).select("object_value", "object_language", "object_datatype").collect()))
    assert got == [("1", None, "http://t"), ("x", "en", None)]


def test_ntriples_escapes_and_bad_lines(spark, tmp_path):
    path = str(tmp_path / "x.nt")
    (tmp_path / "x.nt").write_text('<http://a/\\u00e9> <http://p> "\\U0001F600\\\\u0041\\t\\"" . # end\n\n  # note\nnonsense\n_:b <http://p> <http://o> .\n')
    got = sorted(map(tuple, read_ntriples(spark, path).select("subject_uri", "object_value", "object_uri").collect()))
    assert got == [("_:b", None, "http://o"), ("http://a/é", '😀\\u0041\t"', None)]
    assert [r[0] for r in malformed(spark, path).collect()] == ["nonsense"]
    with pytest.raises(Exception, match="no triple"):
        read_ntriples(spark, path, strict=True).collect()


def test_results_with_blank_nodes_and_languages(spark):
    df = spark.createDataFrame([("_:b1", "x", "en"), ("http://a", "y", None)], "n string, t string, tag string")
    found = Solutions(df, {"n": Var(""), "t": Var(), "tag": Var(unbound=True)})
    rows = json.loads("".join(result_lines(found, "json", languages={"t": "tag"})))
    assert rows["head"]["vars"] == ["n", "t"]
    assert {"n": {"type": "bnode", "value": "b1"}, "t": {"type": "literal", "value": "x", "xml:lang": "en"}} in rows["results"]["bindings"]
    assert '_:b1\t"x"@en' in "".join(result_lines(found, "tsv", languages={"t": "tag"}))
    text = "".join(result_lines(found, "xml", languages={"t": "tag"}))
    assert "<bnode>b1</bnode>" in text and 'xml:lang="en"' in text and ET.fromstring(text) is not None


def test_result_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b', 5), (2, None, None)], "p int, name string, n bigint")
    found = Solutions(df, {"p": Var("http://p/"), "name": Var(unbound=True), "n": Var(unbound=True)})
    assert "".join(result_lines(found, "csv")) == 'p,name,n\r\nhttp://p/1,"a,""b",5\r\nhttp://p/2,,\r\n'
    assert "".join(result_lines(found, "tsv")).split("\n")[1] == '<http://p/1>\t"a,\\"b"\t"5"^^<http://www.w3.org/2001/XMLSchema#integer>'
    parsed = json.loads("".join(result_lines(found, "json")))
    assert parsed["head"]["vars"] == ["p", "name", "n"] and len(parsed["results"]["bindings"]) == 2
    assert parsed["results"]["bindings"][1] == {"p": {"type": "uri", "value": "http://p/2"}}
    assert len(ET.fromstring("".join(result_lines(found, "xml")))[1]) == 2
    assert "".join(result_lines(found, "csv", max_rows=1)).count("\r\n") == 2
    write_results(found, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    assert json.loads(ask_text(True, "json"))["boolean"] is True and "true" in ask_text(True, "xml")


def test_detection(spark):
    tables = {
        "users": spark.createDataFrame([("u1", "ann"), ("u2", "bob")], "_id string, name string"),
        "vertices": spark.createDataFrame([(f"d{i}", "Doc" if i % 2 else "Note", "x y") for i in range(8)], "_id string, type string, title string"),
        "links": spark.createDataFrame([("u1", "d1", "WROTE"), ("u2", "d3", "WROTE"), ("d0", "u1", "CITES"), ("d1", "u1", "CITES")], "_from string, _to string, type string"),
        "facts": spark.createDataFrame([("a", RDF_TYPE, "http://x/City", None), ("b", RDF_TYPE, "http://x/Land", None), ("a", "in", "b", None)], "subject_uri string, predicate string, object_uri string, object_value string"),
    }
    style, c = detect(tables)
    assert style == "hybrid" and set(c.classes) == {"users", "Doc", "Note", "City", "Land"}
    assert (c.edges["WROTE"].source, c.edges["WROTE"].target) == ("users", "Doc")
    assert (c.edges["CITES"].source, c.edges["CITES"].target) == ("Any", "users")
    assert [tuple(r) for r in object_properties(tables["facts"], RDF_TYPE).collect()] == [("in", "http://x/City", "http://x/Land", 1)]
    assert Graph(c).star("?d", "Doc", {"title": "?t"}).df.count() == 4
    assert "What is the number of users?" in sample_questions(c)
    assert set(c.within({"users", "Doc"}).edges) == {"WROTE"}


def test_columns_profile(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    assert columns_profile(df) == [("a", "int", 1.0, True), ("b", "string", 0.5, False)]
    assert columns_profile(df.limit(0)) == [("a", "int", 0.0, False), ("b", "string", 0.0, False)]


def test_detection_keeps_all_classes(spark):
    many = spark.range(1_200).select(F.concat(F.lit("s"), "id").alias("subject_uri"), F.lit(RDF_TYPE).alias("predicate"), F.concat(F.lit("http://x/C"), "id").alias("object_uri"), F.lit(None).cast("string").alias("object_value"))
    things = spark.range(80).select(F.concat(F.lit("v"), "id").alias("_id"), F.concat(F.lit("a.b"), F.col("id") % 40).alias("type"))
    links = spark.range(80).select(F.lit("v1").alias("_from"), F.lit("v2").alias("_to"), F.concat(F.lit("r"), F.col("id") % 35).alias("type"))
    assert len(detect({"facts": many})[1].classes) == 1_200
    assert discriminator(things) == ("type", tuple(sorted(f"a.b{i}" for i in range(40))))
    assert discriminator(links, edges=True) == ("type", tuple(sorted(f"r{i}" for i in range(35))))
    assert discriminator(things.withColumnRenamed("type", "kind")) is None


def test_stream_agrees_with_batch(spark, tmp_path):
    events = spark.range(200).select(F.timestamp_seconds(F.col("id") * 30 + 1_600_000_000).alias("at"), (F.col("id") % 3).cast("string").alias("kind"))
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    names = values(spark, [{"kind": "0", "name": "zero"}, {"kind": "1", "name": "one"}], "kind string, name string")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in"))
    found = lambda df: Solutions(df, {"at": Var(), "kind": Var()}).join(names)
    query = watch(windowed_counts(found(stream), "at", ["name"]), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = {(r["start"], r["name"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["start"], r["name"], r["n"]) for r in windowed_counts(found(events), "at", ["name"]).collect()}
    assert got and got <= want  # windows still open are not out yet
