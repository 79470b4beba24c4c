"""Joins of bags of solutions against a brute-force version, unbound variables included."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bindery.functions import aggregates as A
from bindery.functions import numbers as N
from bindery.functions import strings as S
from bindery.operators import paths as P
from bindery.operators.patterns import Graph, values
from bindery.operators.solutions import Solutions, Var
from bindery.sources.catalog import RDF_TYPE, Catalog, ClassMap, EdgeMap, MappingError, Prop, drift, fingerprint, from_bundle


def bag(rows):
    return Counter(frozenset((k, v) for k, v in r.items() if v is not None) for r in rows)


def collected(s):
    return bag(r.asDict() for r in s.frame().collect())


def compatible(a, b):
    return all(a[k] == b[k] for k in a if k in b and a[k] is not None and b[k] is not None)


def merged(a, b):
    out = dict(a)
    out.update({k: v for k, v in b.items() if v is not None})
    return out


def brute(op, left, right):
    if op == "join":
        return [merged(a, b) for a in left for b in right if compatible(a, b)]
    if op == "optional":
        return [m for a in left for m in ([merged(a, b) for b in right if compatible(a, b)] or [a])]
    if op == "minus":
        shares = lambda a, b: any(a.get(k) is not None and b.get(k) is not None for k in a)
        return [a for a in left if not any(compatible(a, b) and shares(a, b) for b in right)]
    if op == "exists":
        return [a for a in left if any(compatible(a, b) for b in right)]
    if op == "not_exists":
        return [a for a in left if not any(compatible(a, b) for b in right)]
    return left + right


CASES = [(op, l, r, seed) for op in ("join", "optional", "minus", "exists", "not_exists", "union") for seed, (l, r) in enumerate([("x y", "y z"), ("x y", "x y"), ("x", "z"), ("x y z", "z y")])]


@pytest.mark.parametrize("op,l,r,seed", CASES)
def test_against_brute_force(spark, op, l, r, seed):
    rng = random.Random(seed)
    make = lambda names: [{n: rng.choice([1, 2, 3, None]) for n in names.split()} for _ in range(7)]
    left, right = make(l), make(r)
    schema = lambda names: ", ".join(f"{n} int" for n in names.split())
    a, b = values(spark, left, schema(l)), values(spark, right, schema(r))
    assert collected(getattr(a, op)(b)) == bag(brute(op, left, right))


def test_templates_of_other_classes_never_meet(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    a, b, whole = (Solutions(df if p != "" else spark.createDataFrame([("http://a/2",)], "k string"), {"k": Var(p)}) for p in ("http://a/", "http://b/", ""))
    assert a.join(b).df.count() == 0 and a.not_exists(b).df.count() == 2 and a.minus(b).df.count() == 2
    assert a.optional(b).df.count() == 2
    assert [r[0] for r in a.join(whole).frame().collect()] == ["http://a/2"]
    assert sorted(r[0] for r in a.union(b).frame().collect()) == ["http://a/1", "http://a/2", "http://b/1", "http://b/2"]


def test_groups_and_projection(spark):
    rows = values(spark, [{"k": "a", "v": 1}, {"k": "a", "v": None}, {"k": "b", "v": None}], "k string, v int")
    got = {r["k"]: (r["n"], r["s"]) for r in rows.group(["k"], {"n": A.count_bound(F.col("v")), "s": A.sum0(F.col("v"))}).df.collect()}
    assert got == {"a": (1, 1), "b": (0, 0)}
    none = rows.filter(F.lit(False))
    assert none.group(["k"], {"n": F.count("*")}).df.count() == 0
    assert none.group(["k"], {"n": F.count("*")}, empty_row=True).df.collect()[0].asDict() == {"k": None, "n": None}
    assert rows.project("k", "nowhere").df.where("nowhere IS NULL").count() == 3
    assert rows.group([], {"n": A.count_distinct_solutions(F.col("k"), F.col("v"))}).df.first()[0] == 3
    with pytest.raises(ValueError):
        rows.bind("k", F.lit(1))


def people(spark):
    people = spark.createDataFrame([(1, "alice", 30, "hr", "g1", "t1"), (2, "bob", 41, "it", None, "t1"), (3, "carol", None, "it", "g2", "t2")], "id int, name string, age int, dept string, _graph string, org string")
    knows = spark.createDataFrame([(1, 2, "knows"), (2, 3, "knows"), (3, 1, "likes")], "_from int, _to int, type string")
    props = {"name": Prop("name"), "age": Prop("age"), "dept": Prop("dept")}
    classes = {
        "Person": ClassMap("people", "id", "http://p/", props, graph_field="_graph"),
        "Member": ClassMap("people", "id", "http://p/", props, tenant_field="org"),
        "Techie": ClassMap("people", "id", "http://p/", props, "dept", "it"),
    }
    edges = {"knows": EdgeMap("knows", "Person", "Person", type_field="type", type_value="knows"), "tied": EdgeMap("knows", "Member", "Member", tenant_field="org")}
    return Catalog({"people": people, "knows": knows}, classes, edges)


def test_scopes(spark):
    c = people(spark)
    names = lambda g, cls="Person": sorted(r["n"] for r in g.star("?p", cls, {"name": "?n"}).frame("n").collect())
    assert names(Graph(c)) == ["alice", "bob", "carol"]
    assert names(Graph(c, graph="g1")) == ["alice"] and names(Graph(c, graph="")) == ["bob"] and names(Graph(c, graph=("g1", "g2"))) == ["alice", "carol"]
    assert names(Graph(c), "Techie") == ["bob", "carol"]
    assert names(Graph(c, tenant="t1"), "Member") == ["alice", "bob"]
    for read in (lambda: names(Graph(c), "Member"), lambda: Graph(c).edge("?a", "tied", "?b"), lambda: Graph(c).star("?x", "Nobody")):
        with pytest.raises(MappingError):
            read()


def test_tenants_do_not_meet(spark):
    c = people(spark)
    c.classes["Triples"] = ClassMap("knows", "subject_uri", triples_of="http://p/T", tenant_field="org")
    c.classes["Other"] = ClassMap("people", "id", "http://p/", c.classes["Person"].props, tenant_field="org", tenant_entity="Club")
    c.classes["Guest"] = ClassMap("people", "id", "http://p/", c.classes["Person"].props, tenant_field="org", tenant_entity="Firm")
    with pytest.raises(MappingError):  # a triple table has no column of tenants
        Graph(c, tenant="t1").star("?x", "Triples")
    a, b = (Graph(c, tenant=t).star("?p", "Member") for t in ("t1", "t2"))
    open_ = Graph(c).star("?p", "Person", {"age": "?a"})
    assert a.join(open_).join(a).df.count() == 2
    for meet in (a.join, a.optional, a.minus, a.exists, a.union, a.filter(F.lit(True)).project("p").join):
        with pytest.raises(MappingError):
            meet(b)
    with pytest.raises(MappingError):
        a.join(open_).distinct().union(b)
    g = Graph(c, tenant="t1")
    assert g.star("?p", "Other").join(g.star("?p", "Member")).df.count() == 2
    with pytest.raises(MappingError):
        g.star("?p", "Other").join(g.star("?p", "Guest"))


def test_bundle_scopes_edges(spark):
    edges = spark.createDataFrame([("a", "b", "g1", "A"), ("a", "c", "g2", "B")], "_from string, _to string, g string, t string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "_uri string")
    bundle = {"physicalMapping": {"entities": {"N": {"collectionName": "nodes"}}, "relationships": {"to": {"edgeCollectionName": "edges", "domain": "N", "range": "N", "tenantField": "t", "graphField": "g"}}}}
    c = from_bundle(bundle, {"edges": edges, "nodes": nodes})
    assert [tuple(r) for r in Graph(c, tenant="A").edge("?x", "to", "?y").df.collect()] == [("a", "b")]
    assert Graph(c, graph="g1", tenant="B").edge("?x", "to", "?y").df.count() == 0
    with pytest.raises(MappingError):
        Graph(c).edge("?x", "to", "?y")


def test_null_compatible_joins_against_brute_force(spark):
    rng = random.Random(4)
    rows = lambda n, extra: [{"k": rng.choice([1, 2]), "a": rng.choice([None, 1, 2]), "b": rng.choice([None, 1, 2]), extra: i} for i in range(n)]
    for names in (["k", "a", "b"], ["a", "b"], ["a"]):
        left, right = rows(12, "l"), rows(9, "r")
        left = [{n: x[n] for n in [*names, "l"]} for x in left]
        right = [{n: x[n] for n in [*names, "r"]} for x in right]
        schema = lambda extra: ", ".join(f"{n} int" for n in [*names, extra])
        a, b = values(spark, left, schema("l")), values(spark, right, schema("r"))
        fits = lambda x, y: all(x[n] is None or y[n] is None or x[n] == y[n] for n in names)
        share = lambda x, y: any(x[n] is not None and y[n] is not None for n in names)
        merged = lambda x, y: tuple(x[n] if x[n] is not None else y[n] for n in names) + (x["l"], y["r"])
        inner = [merged(x, y) for x in left for y in right if fits(x, y)]
        got = lambda s, *more: sorted(map(repr, (tuple(r[n] for n in [*names, "l", *more]) for r in s.df.collect())))
        alone = [(*(x[n] for n in names), x["l"], None) for x in left if not any(fits(x, y) for y in right)]
        plain = lambda keep: sorted(repr((*(x[n] for n in names), x["l"])) for x in left if keep(x))
        assert got(a.join(b), "r") == sorted(map(repr, inner))
        assert got(a.optional(b), "r") == sorted(map(repr, inner + alone))
        assert got(a.exists(b)) == plain(lambda x: any(fits(x, y) for y in right))
        assert got(a.not_exists(b)) == plain(lambda x: not any(fits(x, y) for y in right))
        assert got(a.minus(b)) == plain(lambda x: not any(fits(x, y) and share(x, y) for y in right))


def facts(spark):
    rows = [("a", RDF_TYPE, "http://x/T", None, "g1"), ("a", "age", None, "7", "g1"), ("b", RDF_TYPE, "http://x/T", None, "g2"), ("b", "knows", "a", None, "g2"), ("c", RDF_TYPE, "http://x/U", None, None)]
    df = spark.createDataFrame(rows, "subject_uri string, predicate string, object_uri string, object_value string, _graph string")
    return Catalog({"facts": df}, {"T": ClassMap("facts", "subject_uri", triples_of="http://x/T", graph_field="_graph")})


def test_triple_tables_in_optional_minus_and_exists(spark):
    g = Graph(facts(spark))
    t = g.star("?s", "T")
    one = lambda s: sorted(tuple(r) for r in s.df.collect())
    assert one(t.optional(g.triples("facts", "?s", "age", "?age"))) == [("a", "7"), ("b", None)]
    assert one(g.star("?s", "T", optional={"age": "?age"})) == [("a", "7"), ("b", None)]
    assert one(t.minus(g.star("?s", "T", {"age": "?x"}))) == [("b",)]
    assert one(t.exists(g.star("?s", "T", {"knows": "?o"}))) == [("b",)]
    assert {tuple(r) for r in g.describe("T", ["a"]).collect()} == {("a", RDF_TYPE, "http://x/T"), ("a", "age", "7")}


def test_scope_reaches_every_part(spark):
    g = Graph(facts(spark))
    inner = g.inside("g1")
    # GRAPH around a sub-select, MINUS and EXISTS: each part is read in the graph
    assert inner.star("?s", "T").exists(inner.star("?s", "T", {"age": "?x"})).df.count() == 1
    assert inner.star("?s", "T").minus(inner.star("?s", "T", {"knows": "?x"})).df.count() == 1
    assert inner.star("?s", "T").join(inner.star("?s", "T").group(["s"], {"n": F.count("*")})).df.count() == 1
    assert inner.inside("g2").star("?s", "T").df.first()["s"] == "b"
    data = g.dataset("g1", named=("g2",))
    assert [r["s"] for r in data.star("?s", "T").df.collect()] == ["a"]
    assert [tuple(r) for r in data.star("?s", "T", graph_var="g").df.select("s", "g").collect()] == [("b", "g2")]
    assert data.inside("g1").star("?s", "T").df.count() == 0 and data.inside("g2").star("?s", "T").df.count() == 1


def test_variable_predicate_of_undeclared_columns_warns(spark):
    c = people(spark)
    got = Graph(c).star("?p", "Person", {"org": "?o"})
    assert got.df.count() == 3 and any("org" in w for w in c.warnings)


def test_shards_repeat_rows_unless_told(spark):
    t = spark.createDataFrame([("a",)], "_uri string")
    for distinct, n in ((False, 2), (True, 1)):
        c = Catalog({"x": t, "y": t}, {"C": ClassMap("f*", "_uri")}, {}, {"f*": ("x", "y")}, distinct)
        assert Graph(c).star("?s", "C").df.count() == n


def test_minus_and_unions_do_not_see_outer_bindings(spark):
    outer = values(spark, [{"a": 1, "b": 1}, {"a": 2, "b": 5}], "a int, b int")
    inner = values(spark, [{"a": 1, "c": 9}], "a int, c int").bind("b2", F.lit(None).cast("int"))
    # a filter inside MINUS on a variable that is bound outside only is an error, so the part is empty
    assert outer.minus(inner.filter(F.col("b2") == 1).project("a")).df.count() == 2
    assert outer.exists(inner, lambda left, right: left["b"] == 1).df.count() == 1


def test_construct_and_describe_with_limits(spark):
    g = Graph(people(spark))
    s = g.star("?p", "Person", {"name": "?n"}).order_by(F.col("n")).slice(2)
    assert s.construct(("?p", "http://v/name", "?n")).count() == 2
    assert {r["subject"] for r in g.describe("Person", s, "p", ("name",)).collect()} == {"http://p/1", "http://p/2"}


def test_star_details(spark):
    g = Graph(people(spark))
    assert g.star("?p", "Person", {"age": "?a"}).df.count() == 2  # a missing value is no triple
    assert g.star("?p", "Person", optional={"age": "?a"}).df.count() == 3
    assert g.star("?p", "Person", {"name": "?x", "dept": "?x"}).df.count() == 0
    assert g.star("http://p/oops", "Person").df.count() == 0
    g.star("?p", "Person", {"org": "?o"})
    assert any("org" in w for w in g.catalog.warnings)


def test_paths(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 2), (9, 9), (5, None)], "x int, y int")
    path = Solutions(df, {"x": Var("http://n/"), "y": Var("http://n/")})
    closure = {(1, 2), (1, 3), (1, 4), *((a, b) for a in (2, 3, 4) for b in (2, 3, 4)), (9, 9)}
    pairs = lambda p: {tuple(r) for r in p.df.collect()}
    assert pairs(P.one_or_more(path)) == closure
    assert pairs(P.one_or_more(path, max_depth=1)) == {(1, 2), (2, 3), (3, 4), (4, 2), (9, 9)}
    nodes = values(spark, [{"n": 7}, {"n": 1}], "n int", {"n": "http://n/"})
    assert pairs(P.zero_or_more(path, nodes, "n")) == closure | {(7, 7), (1, 1)}
    assert P.inverse(path).df.where("x = 2 AND y = 1").count() == 1
    for x in (1, 2, 9):
        one = spark.createDataFrame([(x,)], "n int")
        assert pairs(P.one_or_more(path, starts=one)) == {p for p in closure if p[0] == x}
        assert pairs(P.one_or_more(path, ends=one)) == {p for p in closure if p[1] == x}
        assert all(P.connects(path, x, y).ask().first()[0] == ((x, y) in closure) for y in (1, 3, 9))
    assert not P.connects(path, 1, 4, max_depth=2).ask().first()[0] and P.connects(path, 1, 3, max_depth=2).ask().first()[0]
    assert P.hits(P.one_or_more(path), 1, 4).ask().first()[0] and not P.hits(path, 1, 4).ask().first()[0]


def test_functions(spark):
    row = spark.createDataFrame([("fred#x", "a b*~é", "en-GB", -2.5, "3.7", "x")], "s string, u string, l string, d double, n string, bad string")
    c = F.col
    got = row.select(
        S.strbefore(c("s"), "#"), S.strafter(c("s"), "?"), S.substr(c("s"), 0, 3), S.encode_for_uri(c("u")), S.langmatches(c("l"), "EN"), S.langmatches(c("l"), "*"),
        N.round_half_up(c("d")), N.xsd_integer(c("n")), N.xsd_integer(c("bad")), N.divide(c("d"), F.lit(0)), S.regex(c("s"), "FRED", "i"), S.replace(c("s"), "R", "_", "i"),
        S.is_iri(F.lit("urn:x")), S.is_blank(S.bnode(c("s"))), S.same_term(c("s"), c("s")), N.xsd_boolean(F.lit("1")), N.lexical_part(F.lit("2011-01-10T14:45:13.5Z"), "seconds"),
    ).first()
    assert list(got)[:16] == ["fred", "", "fr", "a%20b%2A~%C3%A9", True, True, -2, 3, None, None, True, "f_ed#x", True, True, True, True]
    assert float(got[16]) == 13.5


def test_casts(spark):
    texts = ["9007199254740993", "-3.99", "1e30", "1e3", "INF", "NaN", "9223372036854775807", "9223372036854775808", "18446744073709551615", " 7 ", "2011-01-10T00:00:00Z", "2011-01-10x", "true", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = df.select(N.xsd_integer(t), N.xsd_integer(t, "unsignedLong").cast("string"), N.xsd_date(t).cast("string"), N.xsd_boolean(t), N.xsd_datetime(t).isNotNull()).collect()
    assert [r[0] for r in got] == [9007199254740993, -3, None, 1000, None, None, 2**63 - 1, None, None, 7, None, None, None, None]
    assert got[8][1] == str(2**64 - 1) and got[1][1] is None
    assert [r[2] for r in got][10:12] == ["2011-01-10", None] and got[12][3] is True and got[10][4] and not got[11][4]
    wide = spark.createDataFrame([(9007199254740993, float("inf"), 2.0**60)], "n bigint, i double, d double").select(N.xsd_integer(F.col("n")), N.xsd_integer(F.col("i")), N.round_half_up(F.col("i")), N.round_half_up(F.col("d"))).first()
    assert list(wide) == [9007199254740993, None, float("inf"), 2.0**60]
    assert spark.range(1).select(S.regex(F.lit("a.b"), "a.b", "q"), S.regex(F.lit("axb"), "a.b", "q"), S.datatype(F.lit(b"x"), "binary"), S.datatype(F.array(F.lit(1)), "array<int>")).first()[:2] == (True, False)


def test_bundle_and_drift(spark):
    tables = {"users": spark.createDataFrame([("u1", "ann")], "_uri string, name string"), "vertices": spark.createDataFrame([("d1", "Doc")], "_uri string, type string")}
    tables |= {f"t_{x}": spark.createDataFrame([(f"{x}1", "p", None, "v")], "subject_uri string, predicate string, object_uri string, object_value string") for x in ("us", "eu")}
    bundle = {
        "physicalMapping": {
            "entities": {"User": {"style": "COLLECTION", "collectionName": "users"}, "Doc": {"style": "LABEL", "collection_name": "vertices", "typeField": "type", "typeValue": "Doc"}},
            "relationships": {},
            "shardFamilies": [["t_us", "t_eu"]],
        }
    }
    c = from_bundle(bundle, tables)
    assert Graph(c).star("?u", "User", {"name": "?n"}).frame().collect()[0].asDict() == {"u": "u1", "n": "ann"}
    assert Graph(c).star("?d", "Doc").df.count() == 1 and Graph(c).triples("t_us*").df.count() == 2
    with pytest.raises(MappingError):
        from_bundle({"physicalMapping": {}, "physical_mapping": {}}, tables)
    before = fingerprint(c)
    assert drift(before, fingerprint(from_bundle(bundle, tables))) == "UNCHANGED"
    tables["users"] = tables["users"].withColumn("more", F.lit(1))
    assert drift(before, fingerprint(from_bundle(bundle, tables))) == "SHAPE_CHANGED"
