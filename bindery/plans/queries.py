"""The queries, by group: patterns, storage styles, expressions, joins, paths, groups, forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import numbers as N
from ..functions import strings as S
from ..operators import paths as P
from ..operators.patterns import Graph, values
from ..operators.solutions import Solutions, Var
from .star_schema import EX, graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, **scope: str):
    """Register ``f(graph) -> Solutions or DataFrame`` under its name."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = f(graph(spark, sf_dir, **scope))
            return found.frame() if isinstance(found, Solutions) else found

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql.replace("EX:", EX)
        return f

    return register


# -- basic patterns


@query("SELECT c_name AS name, o_totalprice AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 100000")
def flagship(g: Graph):
    c = g.star("?c", "Customer", {"name": "?name", "segment": "BUILDING"})
    o = g.star("?o", "Order", {"customer": "?c", "total": "?total"}).filter(F.col("total") > 100000)
    return o.join(c).project("name", "total")


@query("SELECT 'EX:customer/' || c_custkey AS c FROM customer")
def bgp_type(g: Graph):
    return g.star("?c", "Customer")


@query("SELECT 'EX:customer/' || c_custkey AS c, c_name AS name, c_acctbal AS balance FROM customer WHERE c_name IS NOT NULL AND c_acctbal IS NOT NULL")
def bgp_star(g: Graph):
    return g.star("?c", "Customer", {"name": "?name", "balance": "?balance"})


@query("SELECT 'EX:customer/' || c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING'")
def bgp_literal(g: Graph):
    return g.star("?c", "Customer", {"segment": "BUILDING"})


@query("SELECT p_name AS name FROM part WHERE p_size = 7")
def bgp_int_literal(g: Graph):
    return g.star("?p", "Part", {"size": 7, "name": "?name"}).project("name")


@query("SELECT o_totalprice AS total FROM orders WHERE o_custkey = 42")
def bgp_const_iri(g: Graph):
    return g.star("?o", "Order", {"customer": EX + "customer/42", "total": "?total"}).project("total")


@query("SELECT c_name AS name FROM customer WHERE c_custkey = 7")
def bgp_const_subject(g: Graph):
    return g.star(EX + "customer/7", "Customer", {"name": "?name"})


@query("SELECT l_quantity AS quantity, 'EX:part/' || l_partkey AS part FROM lineitem WHERE l_returnflag = 'R'")
def bgp_bnode(g: Graph):
    return g.star("?_l", "LineItem", {"part": "?part", "quantity": "?quantity", "flag": "R"})


@query("SELECT 'EX:nation/' || n_nationkey AS n, n_name AS name, 'EX:region/' || n_regionkey AS r FROM nation")
def select_star(g: Graph):
    return g.star("?n", "Nation", {"name": "?name", "region": "?r"})


@query("SELECT n_name AS name FROM nation WHERE n_nationkey = n_regionkey AND false")
def unmapped_property(g: Graph):
    return g.star("?n", "Nation", {"name": "?name", "motto": "?motto"}).project("name")


@query("SELECT 'EX:customer/' || c_custkey AS c FROM customer WHERE false")
def template_clash(g: Graph):
    return g.star("?c", "Customer").join(g.star("?c", "Supplier"))


# -- storage styles


@query("SELECT 'EX:event/' || event_id AS e, user_id AS u, value AS v FROM events WHERE event_type = 'purchase'")
def label_scan(g: Graph):
    return g.star("?e", "Purchase", {"user": "?u", "value": "?v"})


@query("SELECT 'EX:nation/' || n_nationkey AS n, n_name AS name FROM nation")
def rpt_type_attr(g: Graph):
    return g.star("?n", "RptNation", {EX + "name": "?name"})


@query("SELECT 'EX:nation/' || n_nationkey AS n FROM nation WHERE n_name = 'NATION_3'")
def rpt_literal(g: Graph):
    return g.star("?n", "RptNation", {EX + "name": "NATION_3"})


@query("SELECT 'EX:nation/' || n_nationkey AS n FROM nation WHERE n_regionkey = 2")
def rpt_iri_either_column(g: Graph):
    return g.star("?n", "RptNation", {EX + "inRegion": EX + "region/2"})


@query("SELECT 'EX:customer/' || c_custkey AS c, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def rpt_edge(g: Graph):
    return g.triples("triples", "?c", EX + "livesIn", "?n").join(g.triples("triples", "?n", EX + "name", "?name")).project("c", "name")


@query("SELECT c_name AS c_name, n_name AS n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def hybrid_table_rpt(g: Graph):
    return g.star("?c", "Customer", {"name": "?c_name", "nation": "?n"}).join(g.star("?n", "RptNation", {EX + "name": "?n_name"})).project("c_name", "n_name")


@query("SELECT p_name AS name, 'EX:part/' || p_partkey // 10 AS whole FROM part WHERE p_partkey // 10 > 0")
def edge_dedicated(g: Graph):
    return g.star("?p", "Part", {"name": "?name"}).join(g.edge("?p", "partOf", "?whole")).project("name", "whole")


@query("SELECT 'EX:order/' || o_orderkey AS o, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey")
def edge_generic_type(g: Graph):
    return g.edge("?o", "orderedBy", "?c").join(g.star("?c", "Customer", {"name": "?name"})).project("o", "name")


@query("SELECT 'EX:order/' || o_orderkey AS o, o_totalprice AS total FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')")
def shard_union(g: Graph):
    return g.star("?o", "ShardedOrder", {"total": "?total"})


@query("SELECT 'EX:customer/' || c_custkey AS c, c_acctbal AS b FROM customer WHERE c_mktsegment = 'BUILDING'", tenant="BUILDING")
def tenant_scope(g: Graph):
    return g.star("?c", "TenantCustomer", {"balance": "?b"})


@query("SELECT 'EX:document/' || doc_id AS d, lang FROM documents WHERE source = 'src3'", graph=EX + "graph/src3")
def graph_const(g: Graph):
    return g.star("?d", "GraphDocument", {"lang": "?lang"})


@query("SELECT 'EX:graph/' || source AS g, count(*) AS n FROM documents GROUP BY 1")
def graph_var(g: Graph):
    return g.star("?d", "GraphDocument", graph_var="g").group(["g"], {"n": F.count("*")})


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word")
def multi_valued_explode(g: Graph):
    return g.star("?d", "WordDocument", {"word": "?word"}).group(["word"], {"n": F.count("*")})


@query("SELECT 'EX:document/' || doc_id AS d FROM documents WHERE list_contains(string_split(text, ' '), 'idiot')")
def multi_valued_const(g: Graph):
    return g.star("?d", "WordDocument", {"word": "idiot"})


# -- filters and expressions


@query("SELECT 'EX:order/' || o_orderkey AS o FROM orders WHERE o_totalprice BETWEEN 50000 AND 60000")
def filter_range(g: Graph):
    return g.star("?o", "Order", {"total": "?t"}).filter(F.col("t").between(50000, 60000)).project("o")


@query("SELECT p_name AS name FROM part WHERE regexp_matches(p_name, '(?i)RED .*T$')")
def filter_regex_i(g: Graph):
    return g.star("?p", "Part", {"name": "?name"}).filter(lambda s: S.regex(s["name"], "RED .*T$", "i")).project("name")


@query("SELECT n_name AS name FROM nation WHERE n_regionkey IN (1, 3)")
def filter_in(g: Graph):
    return g.star("?n", "Nation", {"name": "?name", "region": "?r"}).filter(lambda s: s["r"].isin(EX + "region/1", EX + "region/3")).project("name")


@query("SELECT n_name AS name FROM nation")
def filter_not_in_empty(g: Graph):
    return g.star("?n", "Nation", {"name": "?name"}).filter(~F.col("name").isin([])).project("name")


@query("SELECT d.doc_id AS k FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 0 OR d.n_chars > 3000")
def filter_or_unbound(g: Graph):
    d = g.star("?d", "Document", {"chars": "?n"}).optional(g.star("?_l", "Label", {"document": "?d", "quality": "?q"}))
    return d.filter((F.col("q") == 0) | (F.col("n") > 3000)).df.select(F.col("d").alias("k"))


@query("SELECT o_orderkey AS k, o_totalprice / nullif(o_custkey % 3, 0) AS x FROM orders")
def arith_div_zero(g: Graph):
    return g.star("?o", "Order", {"total": "?t", "customer": "?c"}).df.select(F.col("o").alias("k"), N.divide(F.col("t"), F.col("c") % 3).alias("x"))


@query("SELECT d.doc_id AS k, CASE WHEN l.quality = 1 THEN 'good' WHEN l.quality <> 1 THEN 'bad' END AS verdict, coalesce(l.quality, -1) AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def if_coalesce(g: Graph):
    d = g.star("?d", "Document").optional(g.star("?_l", "Label", {"document": "?d", "quality": "?q"}))
    return d.df.select(F.col("d").alias("k"), S.if_(F.col("q") == 1, F.lit("good"), F.lit("bad")).alias("verdict"), F.coalesce("q", F.lit(-1)).alias("q"))


@query(
    "SELECT c_custkey AS k, upper(c_name) AS u, lower(c_name) AS l, CAST(length(c_name) AS INT) AS n, contains(c_name, '00') AS has, starts_with(c_name, 'Cust') AS starts, ends_with(c_name, '7') AS ends, c_name || '-' || c_mktsegment AS both FROM customer"
)
def string_suite(g: Graph):
    x = F.col("name")
    return g.star("?c", "Customer", {"name": "?name", "segment": "?s"}).df.select(
        F.col("c").alias("k"), F.upper(x).alias("u"), F.lower(x).alias("l"), F.length(x).alias("n"), F.contains(x, F.lit("00")).alias("has"),
        x.startswith("Cust").alias("starts"), x.endswith("7").alias("ends"), F.concat(x, F.lit("-"), F.col("s")).alias("both"),
    )


@query("SELECT c_custkey AS k, substr(c_name, 3) AS a, substr(c_name, 2, 4) AS b, substr(c_name, 1, 2) AS c FROM customer")
def substr_suite(g: Graph):
    x = F.col("name")
    return g.star("?c", "Customer", {"name": "?name"}).df.select(F.col("c").alias("k"), S.substr(x, 3).alias("a"), S.substr(x, 2, 4).alias("b"), S.substr(x, 0, 3).alias("c"))


@query(
    "SELECT p_partkey AS k, CASE WHEN contains(p_name, ' ') THEN split_part(p_name, ' ', 1) ELSE '' END AS b, CASE WHEN strpos(p_name, '#') > 0 THEN substr(p_name, strpos(p_name, '#') + 1) ELSE '' END AS a FROM part"
)
def strbefore_after(g: Graph):
    x = F.col("name")
    return g.star("?p", "Part", {"name": "?name"}).df.select(F.col("p").alias("k"), S.strbefore(x, " ").alias("b"), S.strafter(x, "#").alias("a"))


@query("SELECT doc_id AS k, url_encode(text) AS u FROM documents")
def encode_uri(g: Graph):
    return g.star("?d", "Document", {"text": "?t"}).df.select(F.col("d").alias("k"), S.encode_for_uri(F.col("t")).alias("u"))


@query("SELECT doc_id AS k, url_encode(text) AS u, sha256(text) AS s FROM documents")
def encode_uri_whole(g: Graph):
    x = F.col("t")
    return g.star("?d", "Document", {"text": "?t"}).df.select(F.col("d").alias("k"), S.encode_for_uri(x).alias("u"), F.sha2(x, 256).alias("s"))


@query("SELECT c_custkey AS k, md5(c_name) AS m, sha1(c_name) AS s1, sha256(c_name) AS s256 FROM customer")
def hash_suite(g: Graph):
    x = F.col("name")
    return g.star("?c", "Customer", {"name": "?name"}).df.select(F.col("c").alias("k"), F.md5(x).alias("m"), F.sha1(x).alias("s1"), F.sha2(x, 256).alias("s256"))


@query("SELECT o_orderkey AS k, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS lex FROM orders")
def date_parts(g: Graph):
    x = F.col("x")
    return g.star("?o", "Order", {"date": "?x"}).df.select(F.col("o").alias("k"), F.year(x).alias("y"), F.month(x).alias("m"), F.day(x).alias("d"), S.to_str(x, "timestamp").alias("lex"))


@query("SELECT * FROM (VALUES ('2011-01-10T14:45:13Z', 'Z', 'PT0S', 45), ('2011-01-10T14:45:13-05:00', '-05:00', '-PT5H', 45), ('2011-01-10T14:46:13+05:30', '+05:30', 'PT5H30M', 46), ('2011-01-10T14:47:13', '', NULL, 47)) t(lex, tz, zone, minutes)")
def tz_timezone(g: Graph):
    spark = g.catalog.table("region").sparkSession
    texts = ["2011-01-10T14:45:13Z", "2011-01-10T14:45:13-05:00", "2011-01-10T14:46:13+05:30", "2011-01-10T14:47:13"]
    x = F.col("lex")
    return values(spark, [{"lex": t} for t in texts], "lex string").df.select(x, N.tz(x).alias("tz"), N.timezone(x).alias("zone"), N.lexical_part(x, "minutes").alias("minutes"))


@query("SELECT s_suppkey AS k, abs(s_acctbal) AS a, CAST(ceil(s_acctbal) AS BIGINT) AS c, CAST(floor(s_acctbal) AS BIGINT) AS f, CAST(floor(s_acctbal + 0.5) AS BIGINT) AS r FROM supplier")
def numeric_rounding(g: Graph):
    x = F.col("b")
    return g.star("?s", "Supplier", {"balance": "?b"}).df.select(F.col("s").alias("k"), F.abs(x).alias("a"), F.ceil(x).alias("c"), F.floor(x).alias("f"), N.round_half_up(x).cast("bigint").alias("r"))


@query("SELECT s_suppkey AS k, CAST(trunc(s_acctbal) AS BIGINT) AS i, TRY_CAST(s_name AS DOUBLE) AS d, CAST(NULL AS BIGINT) AS n FROM supplier")
def xsd_casts(g: Graph):
    return g.star("?s", "Supplier", {"balance": "?b", "name": "?name"}).df.select(F.col("s").alias("k"), N.xsd_integer(F.col("b")).alias("i"), N.xsd_double(F.col("name")).alias("d"), N.xsd_integer(F.col("name")).alias("n"))


@query("SELECT lang, count(*) AS n FROM documents WHERE lower(lang) = 'en' OR starts_with(lower(lang), 'en-') GROUP BY lang")
def langmatches(g: Graph):
    return g.star("?d", "Document", {"lang": "?lang"}).filter(lambda s: S.langmatches(s["lang"], "EN")).group(["lang"], {"n": F.count("*")})


@query("SELECT p_partkey AS k, 'http://www.w3.org/2001/XMLSchema#integer' AS size_type, 'http://www.w3.org/2001/XMLSchema#double' AS price_type FROM part")
def datatype(g: Graph):
    s = g.star("?p", "Part", {"size": "?size", "price": "?price"})
    types = dict(s.df.dtypes)
    return s.df.select(F.col("p").alias("k"), S.datatype(F.col("size"), types["size"]).alias("size_type"), S.datatype(F.col("price"), types["price"]).alias("price_type"))


@query("SELECT 'EX:nation/' || n_nationkey AS n, true AS iri, false AS lit FROM nation")
def is_iri_literal(g: Graph):
    s = g.star("?n", "Nation", {"name": "?name"})
    return s.df.select(s["n"].alias("n"), S.is_iri(s["n"]).alias("iri"), S.is_iri(s["name"]).alias("lit"))


# -- modifiers


@query("SELECT c_custkey AS k, c_acctbal * 2 + 1 AS twice, c_acctbal * 2 + 1 > 5000 AS rich FROM customer")
def bind_chain(g: Graph):
    s = g.star("?c", "Customer", {"balance": "?b"}).bind("twice", F.col("b") * 2 + 1).bind("rich", F.col("twice") > 5000)
    return s.df.select(F.col("c").alias("k"), "twice", "rich")


@query("SELECT DISTINCT c_mktsegment AS s FROM customer")
def distinct(g: Graph):
    return g.star("?c", "Customer", {"segment": "?s"}).project("s").distinct()


@query("SELECT DISTINCT o_orderpriority AS p FROM orders ORDER BY p LIMIT 3")
def distinct_limit(g: Graph):
    return g.star("?o", "Order", {"priority": "?p"}).project("p").distinct().order_by(F.asc_nulls_first("p")).slice(3)


@query("SELECT o_orderkey AS k, o_totalprice AS t FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def order_limit_offset(g: Graph):
    return g.star("?o", "Order", {"total": "?t"}).order_by(F.desc_nulls_last("t"), F.asc("o")).slice(10, 5).df.withColumnRenamed("o", "k")


@query("SELECT n_name AS name FROM nation ORDER BY n_name OFFSET 20")
def offset_only(g: Graph):
    return g.star("?n", "Nation", {"name": "?name"}).project("name").order_by(F.asc_nulls_first("name")).slice(offset=20)


@query("SELECT c_mktsegment AS s, c_acctbal AS b, c_custkey AS k FROM customer ORDER BY s, b DESC, k LIMIT 25")
def topk_multi_key(g: Graph):
    s = g.star("?c", "Customer", {"segment": "?s", "balance": "?b"}).order_by(F.asc_nulls_first("s"), F.desc_nulls_last("b"), F.asc("c")).slice(25)
    return s.df.withColumnRenamed("c", "k")


# -- joins


@query("SELECT n_name AS nation, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def join_3way(g: Graph):
    o, c = g.star("?o", "Order", {"customer": "?c"}), g.star("?c", "Customer", {"nation": "?n"})
    return o.join(c).join(g.star("?n", "Nation", {"name": "?nation"})).group(["nation"], {"n": F.count("*")})


@query(
    "SELECT n_name AS nation, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = (SELECT min(r_name) FROM region) GROUP BY n_name"
)
def join_5way_region(g: Graph):
    region = g.star("?r", "Region", {"name": "?rn"}).group([], {"rn": F.min("rn")}).join(g.star("?r", "Region", {"name": "?rn"}))
    n = g.star("?n", "Nation", {"name": "?nation", "region": "?r"}).join(region)
    c = g.star("?c", "Customer", {"nation": "?n"}).join(n)
    o = g.star("?o", "Order", {"customer": "?c"}).join(c)
    line = g.star("?_l", "LineItem", {"order": "?o", "supplier": "?s", "price": "?price", "discount": "?discount"})
    all_ = line.join(o).join(g.star("?s", "Supplier", {"nation": "?n"}))
    return all_.group(["nation"], {"revenue": F.round(F.sum(F.col("price") * (1 - F.col("discount"))), 2)})


@query("SELECT a.r_name AS a, b.r_name AS b FROM region a, region b")
def cross_join(g: Graph):
    return g.star("?x", "Region", {"name": "?a"}).project("a").join(g.star("?y", "Region", {"name": "?b"}).project("b"))


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")
def theta_join(g: Graph):
    a, b = g.star("?x", "Nation", {"name": "?a", "region": "?r"}), g.star("?y", "Nation", {"name": "?b", "region": "?r"})
    return a.theta_join(b, lambda left, right: F.col("a") < F.col("b")).project("a", "b")


@query("SELECT 'EX:document/' || d.doc_id AS d, l.quality AS q, l.toxic AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def optional_attr(g: Graph):
    return g.star("?d", "Document").optional(g.star("?_l", "Label", {"document": "?d"}, {"quality": "?q", "toxic": "?t"}))


@query("SELECT 'EX:customer/' || c_custkey AS c, 'EX:order/' || o_orderkey AS o FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def optional_edge_all(g: Graph):
    return g.star("?c", "Customer").optional(g.edge("?o", "orderedBy", "?c"))


@query("SELECT 'EX:document/' || d.doc_id AS d, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 1 AND d.n_chars > 1000")
def optional_filter(g: Graph):
    d = g.star("?d", "Document", {"chars": "?n"})
    label = g.star("?_l", "Label", {"document": "?d", "quality": "?q"})
    return d.optional(label, lambda left, right: (F.col("q") == 1) & (F.col("n") > 1000)).project("d", "q")


@query("SELECT 'EX:document/' || d.doc_id AS d, a.quality AS q, b.toxic AS t FROM documents d LEFT JOIN (labels a LEFT JOIN (SELECT * FROM labels WHERE toxic = 1) b ON a.doc_id = b.doc_id) ON d.doc_id = a.doc_id")
def optional_nested(g: Graph):
    toxic = g.star("?_m", "Label", {"document": "?d", "toxic": "?t"}).filter(F.col("t") == 1)
    return g.star("?d", "Document").optional(g.star("?_l", "Label", {"document": "?d", "quality": "?q"}).optional(toxic))


@query("SELECT 'EX:customer/' || c_custkey AS c, n_name AS name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 1")
def optional_cross_subject(g: Graph):
    n = g.triples("triples", "?n", EX + "inRegion", EX + "region/1").join(g.triples("triples", "?n", EX + "name", "?name"))
    return g.triples("triples", "?c", EX + "livesIn", "?n").optional(n).project("c", "name")


@query("SELECT c_name AS name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def exists(g: Graph):
    return g.star("?c", "Customer", {"name": "?name"}).exists(g.star("?o", "Order", {"customer": "?c", "total": "?t"}).filter(F.col("t") > 200000)).project("name")


@query("SELECT 'EX:document/' || doc_id AS d FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def not_exists(g: Graph):
    return g.star("?d", "Document").not_exists(g.star("?_l", "Label", {"document": "?d"}))


@query("SELECT 'EX:document/' || doc_id AS d FROM documents WHERE n_chars > 4000 OR EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND toxic = 1)")
def exists_in_or(g: Graph):
    d = g.star("?d", "Document", {"chars": "?n"}).exists_flag("hit", g.star("?_l", "Label", {"document": "?d", "toxic": 1}))
    return d.filter((F.col("n") > 4000) | F.col("hit")).project("d")


@query("SELECT 'EX:document/' || doc_id AS d FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def minus(g: Graph):
    return g.star("?d", "Document").minus(g.star("?_l", "Label", {"document": "?d", "toxic": 0}))


@query("SELECT 'EX:nation/' || n_nationkey AS n FROM nation")
def minus_disjoint(g: Graph):
    return g.star("?n", "Nation").minus(g.star("?r", "Region"))


@query("SELECT d.doc_id AS k FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND (CASE WHEN l.toxic = 1 THEN 'xx' END IS NULL OR CASE WHEN l.toxic = 1 THEN 'xx' END = d.lang))")
def minus_optional(g: Graph):
    right = g.star("?_l", "Label", {"document": "?d", "toxic": "?t"}).bind("lang", F.when(F.col("t") == 1, F.lit("xx"))).project("d", "lang")
    return g.star("?d", "Document", {"lang": "?lang"}).minus(right).df.select(F.col("d").alias("k"))


@query(
    "WITH l AS (SELECT c_custkey AS c, c_name AS name, CASE WHEN c_acctbal > 5000 THEN c_mktsegment END AS a, CASE WHEN c_acctbal < 8000 THEN c_nationkey END AS b FROM customer),"
    " r AS (SELECT o_custkey AS c, CASE WHEN o_orderstatus = 'O' THEN 'BUILDING' END AS a, CASE WHEN o_orderstatus = 'F' THEN 7 END AS b, o_totalprice AS total FROM orders)"
    " SELECT l.name, coalesce(l.a, r.a) AS a, coalesce(l.b, r.b) AS b, r.total FROM l LEFT JOIN r ON l.c = r.c AND (l.a = r.a OR l.a IS NULL OR r.a IS NULL) AND (l.b = r.b OR l.b IS NULL OR r.b IS NULL)"
)
def optional_two_unbound(g: Graph):
    """Two of three shared variables may be unbound on either side."""
    left = g.star("?c", "Customer", {"name": "?name", "balance": "?x", "segment": "?s", "nation": "?n"})
    left = left.bind("a", F.when(F.col("x") > 5000, F.col("s"))).bind("b", F.when(F.col("x") < 8000, F.col("n"))).project("c", "name", "a", "b")
    right = g.star("?_o", "Order", {"customer": "?c", "status": "?t", "total": "?total"})
    right = right.bind("a", F.when(F.col("t") == "O", F.lit("BUILDING"))).bind("b", F.when(F.col("t") == "F", F.lit(7))).project("c", "a", "b", "total")
    return left.optional(right).project("name", "a", "b", "total")


@query("SELECT c_name AS name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def values_single(g: Graph):
    spark = g.catalog.table("region").sparkSession
    rows = values(spark, [{"s": "BUILDING"}, {"s": "MACHINERY"}], "s string")
    return g.star("?c", "Customer", {"name": "?name", "segment": "?s"}).join(rows).project("name")


@query("SELECT n_name AS name, t.x AS x FROM nation JOIN (VALUES ('NATION_1', 1), (NULL, 2)) t(name, x) ON t.name IS NULL OR t.name = n_name")
def values_undef(g: Graph):
    spark = g.catalog.table("region").sparkSession
    rows = values(spark, [{"name": "NATION_1", "x": 1}, {"name": None, "x": 2}], "name string, x int")
    return g.star("?n", "Nation", {"name": "?name"}).project("name").join(rows)


@query("SELECT c_name AS name, t.n AS n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) t ON o_custkey = c_custkey")
def subselect_agg(g: Graph):
    inner = g.star("?o", "Order", {"customer": "?c"}).group(["c"], {"n": F.count("*")})
    return g.star("?c", "Customer", {"name": "?name"}).join(inner).project("name", "n")


@query("SELECT c_name AS name, t.o_totalprice AS total FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5) t JOIN customer ON o_custkey = c_custkey")
def subselect_limit(g: Graph):
    top = g.star("?o", "Order", {"customer": "?c", "total": "?total"}).order_by(F.desc("total"), F.asc("o")).slice(5)
    return top.join(g.star("?c", "Customer", {"name": "?name"})).project("name", "total")


@query("SELECT 'EX:customer/' || c_custkey AS c, c_name AS name FROM customer WHERE c_custkey IN (3, 5, 8)")
def federation_seeded(g: Graph):
    spark = g.catalog.table("region").sparkSession
    seeds = values(spark, [{"c": 3}, {"c": 5}, {"c": 8}], "c bigint", {"c": EX + "customer/"})
    return seeds.join(g.star("?c", "Customer", {"name": "?name"}))


@query("SELECT 'EX:nation/' || n_nationkey AS n, s_name AS supplier, n_name AS name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = 2")
def federation_leg(g: Graph):
    """A leg of another source is asked for the distinct keys and joined by whole IRIs."""
    here = g.star("?n", "Nation", {"region": EX + "region/2", "name": "?name"})
    elsewhere = g.star("?s", "Supplier", {"nation": "?n", "name": "?supplier"}).frame("n", "supplier")
    return here.leg(elsewhere.join(here.keys_of("n"), "n", "left_semi"), iris=("n",)).project("n", "supplier", "name")


# -- sets and paths


@query("SELECT s_name AS name FROM supplier UNION ALL SELECT c_name FROM customer")
def union_shared(g: Graph):
    return g.star("?s", "Supplier", {"name": "?name"}).project("name").union(g.star("?c", "Customer", {"name": "?name"}).project("name"))


@query("SELECT r_name AS r, NULL AS n FROM region UNION ALL SELECT NULL, n_name FROM nation")
def union_disjoint(g: Graph):
    return g.star("?x", "Region", {"name": "?r"}).project("r").union(g.star("?y", "Nation", {"name": "?n"}).project("n"))


@query("SELECT 'EX:order/' || o_orderkey AS x, 'EX:nation/' || c_nationkey AS y FROM orders JOIN customer ON o_custkey = c_custkey")
def path_seq(g: Graph):
    return P.sequence(P.relation(g.edge("?o", "orderedBy", "?c"), "o", "c"), P.relation(g.edge("?c", "livesIn", "?n"), "c", "n"))


@query("SELECT 'EX:customer/' || o_custkey AS x, 'EX:order/' || o_orderkey AS y FROM orders")
def path_inverse(g: Graph):
    return P.inverse(P.relation(g.edge("?o", "orderedBy", "?c"), "o", "c"))


@query("SELECT 'EX:customer/' || c_custkey AS x, 'EX:nation/' || c_nationkey AS y FROM customer UNION SELECT 'EX:nation/' || n_nationkey, 'EX:region/' || n_regionkey FROM nation")
def path_alt(g: Graph):
    return P.alternative(P.relation(g.edge("?c", "livesIn", "?n"), "c", "n"), P.relation(g.edge("?n", "inRegion", "?r"), "n", "r"))


_PART_OF = "SELECT p_partkey AS x, p_partkey // 10 AS y FROM part WHERE p_partkey // 10 > 0"
_PLUS = f"WITH RECURSIVE e AS ({_PART_OF}), t AS (SELECT x, y FROM e UNION SELECT t.x, e.y FROM t JOIN e ON t.y = e.x) "


def _part_of(g: Graph):
    return P.relation(g.edge("?a", "partOf", "?b"), "a", "b")


@query(f"WITH e AS ({_PART_OF}) SELECT 'EX:part/' || x AS x, 'EX:part/' || y AS y FROM (SELECT * FROM e UNION SELECT p_partkey, p_partkey FROM part)")
def path_opt(g: Graph):
    return P.zero_or_one(_part_of(g), g.star("?p", "Part"), "p")


@query(_PLUS + "SELECT 'EX:part/' || x AS x, 'EX:part/' || y AS y FROM t")
def path_plus(g: Graph):
    return P.one_or_more(_part_of(g))


@query(_PLUS + "SELECT 'EX:part/' || x AS x, 'EX:part/' || y AS y FROM (SELECT * FROM t UNION SELECT p_partkey, p_partkey FROM part)")
def path_star(g: Graph):
    return P.zero_or_more(_part_of(g), g.star("?p", "Part"), "p")


@query("SELECT 'EX:nation/' || n_nationkey AS x, 'EX:region/' || n_regionkey AS y FROM nation")
def path_negated(g: Graph):
    return P.negated(g.all_triples("Nation", ("name", "region")), "name")


@query("SELECT count(*) > 0 AS answer FROM part WHERE p_partkey = 123 AND p_partkey // 100 = 1")
def path_const_ends(g: Graph):
    return P.connects(_part_of(g), 123, 1).ask()


@query("WITH RECURSIVE t(y) AS (SELECT 123 // 10 UNION SELECT y // 10 FROM t WHERE y // 10 > 0) SELECT 'EX:part/' || 123 AS x, 'EX:part/' || y AS y FROM t WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = 123)")
def path_from_const(g: Graph):
    """``<part/123> partOf+ ?y``: only what the constant reaches is read."""
    path = _part_of(g)
    return P.one_or_more(path, starts=path.df.where("x = 123").select("x"))


@query(
    "SELECT 'EX:nation/' || n_nationkey AS x, 'EX:region/' || n_regionkey AS y FROM nation"
    " UNION ALL SELECT 'EX:region/' || n_regionkey, 'EX:nation/' || n_nationkey FROM nation UNION ALL SELECT n_name, 'EX:nation/' || n_nationkey FROM nation"
)
def path_negated_edges(g: Graph):
    """``!(name|next|^next|^region)`` over properties and edges of nations."""
    return P.negated(g.all_triples("Nation", ("name", "region", "inRegion", "next")), "name", "next", "region", inverse_of=("next", "region"))


@query("SELECT 'EX:nation/' || a.n_nationkey AS x, 'EX:nation/' || b.n_nationkey AS y FROM nation a, nation b")
def path_cycle(g: Graph):
    return P.one_or_more(P.relation(g.edge("?a", "next", "?b"), "a", "b"))


@query("SELECT 'EX:nation/' || a.n_nationkey AS x, 'EX:nation/' || (a.n_nationkey + d.range) % 25 AS y FROM nation a, range(1, 11) d")
def path_bounded(g: Graph):
    return P.one_or_more(P.relation(g.edge("?a", "next", "?b"), "a", "b"), max_depth=10)


# -- groups


@query("SELECT count(*) AS n FROM lineitem")
def count_star(g: Graph):
    return g.star("?_l", "LineItem").group([], {"n": F.count("*")})


@query("SELECT lang, count(l.quality) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang")
def count_bound(g: Graph):
    d = g.star("?d", "Document", {"lang": "?lang"}).optional(g.star("?_l", "Label", {"document": "?d", "quality": "?q"}))
    return d.group(["lang"], {"n": A.count_bound(F.col("q"))})


@query("SELECT l_returnflag AS flag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def count_distinct(g: Graph):
    return g.star("?_l", "LineItem", {"flag": "?flag", "part": "?p"}).group(["flag"], {"parts": F.count_distinct("p")})


@query("SELECT count(*) AS n FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer)")
def count_distinct_star(g: Graph):
    return g.star("?_c", "Customer", {"segment": "?s", "nation": "?n"}).group([], {"n": A.count_distinct_solutions(F.col("s"), F.col("n"))})


@query(
    "SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 2) AS price, min(l_discount) AS low, max(l_tax) AS high, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"
)
def sum_avg_min_max(g: Graph):
    line = g.star("?_l", "LineItem", {"flag": "?flag", "status": "?status", "quantity": "?q", "price": "?p", "discount": "?d", "tax": "?t", "shipped": "?at"})
    line = line.filter(F.col("at") <= F.lit("1998-09-02").cast("timestamp"))
    return line.group(
        ["flag", "status"],
        {"qty": F.round(A.sum0(F.col("q")), 2), "price": F.round(A.avg0(F.col("p")), 2), "low": F.min("d"), "high": F.max("t"), "n": F.count("*")},
    )


@query("SELECT CAST(sum(DISTINCT p_size) AS BIGINT) AS total, p_brand AS brand FROM part GROUP BY p_brand")
def sum_distinct(g: Graph):
    return g.star("?p", "Part", {"size": "?size", "brand": "?brand"}).group(["brand"], {"total": F.sum_distinct("size")})


@query("SELECT r_name AS region, string_agg(n_name, '|' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def group_concat(g: Graph):
    n = g.star("?n", "Nation", {"name": "?name", "region": "?r"}).join(g.star("?r", "Region", {"name": "?region"}))
    return n.group(["region"], {"nations": A.group_concat(F.col("name"), "|")})


@query("SELECT c_mktsegment AS s, min(c_name) AS name FROM customer GROUP BY 1")
def sample(g: Graph):
    return g.star("?c", "Customer", {"segment": "?s", "name": "?name"}).sample(["s"], "name")


@query("SELECT 'EX:customer/' || o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def having(g: Graph):
    return g.star("?o", "Order", {"customer": "?c"}).group(["c"], {"n": F.count("*")}, F.col("n") > 12)


@query("SELECT CAST(year(o_orderdate) AS INT) AS y, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def group_by_expr(g: Graph):
    return g.star("?o", "Order", {"date": "?d", "total": "?t"}).bind("y", F.year("d")).group(["y"], {"total": F.round(F.sum("t"), 2)})


@query("SELECT CAST(0 AS DOUBLE) AS total, CAST(0 AS BIGINT) AS n, '' AS names")
def agg_empty(g: Graph):
    none = g.star("?c", "Customer", {"balance": "?b", "name": "?name", "segment": "NO SUCH"})
    return none.group([], {"total": A.sum0(F.col("b")), "n": F.count("*"), "names": A.group_concat(F.col("name"))})


@query("SELECT count(*) AS n FROM orders GROUP BY o_orderpriority, o_orderstatus")
def group_key_unprojected(g: Graph):
    return g.star("?o", "Order", {"priority": "?p", "status": "?s"}).group(["p", "s"], {"n": F.count("*")}).project("n")


# -- variable predicates and forms


@query("SELECT 'name' AS p, c_name AS o FROM customer WHERE c_custkey = 5 UNION ALL SELECT 'segment', c_mktsegment FROM customer WHERE c_custkey = 5 UNION ALL SELECT 'nation', 'EX:nation/' || c_nationkey FROM customer WHERE c_custkey = 5")
def spo_fixed_subject(g: Graph):
    return g.all_triples("Customer", ("name", "segment", "nation")).filter(F.col("s") == 5).project("p", "o")


@query("SELECT p, count(*) AS n FROM (SELECT unnest(['name', 'segment', 'balance', 'nation']) AS p FROM customer) GROUP BY p")
def spo_count_by_predicate(g: Graph):
    return g.all_triples("Customer", ("name", "segment", "balance", "nation")).group(["p"], {"n": F.count("*")})


@query("SELECT p, count(*) AS n FROM (SELECT unnest(['name', 'segment', 'balance', 'nation', 'livesIn']) AS p FROM customer) GROUP BY p")
def spo_count_with_edges(g: Graph):
    return g.all_triples("Customer").group(["p"], {"n": F.count("*")})


@query("SELECT doc_id AS s, 'word' AS p, unnest(string_split(text, ' ')) AS o FROM documents")
def spo_many_values(g: Graph):
    return Solutions(g.all_triples("WordDocument").df, {"s": Var(), "p": Var(), "o": Var()})


@query("SELECT predicate AS p, count(*) AS n FROM (SELECT unnest(['http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'EX:name', 'EX:inRegion']) AS predicate FROM nation UNION ALL SELECT unnest(['http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'EX:name', 'EX:livesIn']) FROM customer) GROUP BY 1")
def spo_triple_table(g: Graph):
    return g.triples("triples").group(["p"], {"n": F.count("*")})


@query("SELECT count(*) > 0 AS answer FROM customer WHERE c_mktsegment = 'BUILDING'")
def ask_true(g: Graph):
    return g.star("?c", "Customer", {"segment": "BUILDING"}).ask()


@query("SELECT count(*) > 0 AS answer FROM customer WHERE c_mktsegment = 'NO SUCH'")
def ask_false(g: Graph):
    return g.star("?c", "Customer", {"segment": "NO SUCH"}).ask()


@query("SELECT 'EX:customer/' || c_custkey AS subject, 'EX:livesIn' AS predicate, 'EX:nation/' || c_nationkey AS object FROM customer UNION SELECT 'EX:nation/' || c_nationkey, 'EX:hasSegment', c_mktsegment FROM customer")
def construct_template(g: Graph):
    return g.star("?c", "Customer", {"nation": "?n", "segment": "?s"}).construct(("?c", EX + "livesIn", "?n"), ("?n", EX + "hasSegment", "?s"))


@query("SELECT 'EX:nation/' || n_nationkey AS subject, 'EX:inRegion' AS predicate, 'EX:region/' || n_regionkey AS object FROM nation")
def construct_where(g: Graph):
    return g.edge("?n", "inRegion", "?r").construct(("?n", EX + "inRegion", "?r"))


@query("SELECT 'EX:nation/' || n_nationkey AS subject, 'name' AS predicate, n_name AS object FROM nation WHERE n_nationkey IN (3, 4) UNION SELECT 'EX:nation/' || n_nationkey, 'region', 'EX:region/' || n_regionkey FROM nation WHERE n_nationkey IN (3, 4)")
def describe_iri(g: Graph):
    return g.describe("Nation", [EX + "nation/3", EX + "nation/4"], only=("name", "region"))


@query("SELECT 'EX:nation/' || n_nationkey AS subject, 'name' AS predicate, n_name AS object FROM nation WHERE n_regionkey = 1 UNION SELECT 'EX:nation/' || n_nationkey, 'region', 'EX:region/' || n_regionkey FROM nation WHERE n_regionkey = 1")
def describe_var(g: Graph):
    return g.describe("Nation", g.star("?n", "Nation", {"region": EX + "region/1"}), "n", ("name", "region"))


# -- scopes of edges and triple tables, untyped subjects


@query("SELECT 'EX:order/' || o_orderkey AS o, 'EX:customer/' || o_custkey AS c FROM orders WHERE o_orderpriority = '1-URGENT'", tenant="1-URGENT")
def tenant_edge(g: Graph):
    return g.edge("?o", "placedBy", "?c")


@query("SELECT 'EX:nation/' || n_nationkey AS n, n_name AS name FROM nation WHERE n_regionkey = 1", graph=EX + "graph/1")
def graph_rpt(g: Graph):
    return g.star("?n", "GraphRptNation", {EX + "name": "?name"})


@query("SELECT 'EX:graph/' || n_regionkey AS g, count(*) AS n FROM nation GROUP BY n_regionkey")
def graph_rpt_var(g: Graph):
    return g.star("?n", "GraphRptNation", {EX + "name": "?name"}, graph_var="g").group(["g"], {"n": F.count("*")})


@query("SELECT count(*) AS n FROM customer WHERE false", graph=EX + "graph/1")
def graph_of_plain_class(g: Graph):
    """A table without graphs has nothing in a named graph."""
    return g.star("?c", "Customer").group([], {"n": F.count("*")})


@query("SELECT 'EX:region/' || r_regionkey AS s, r_name AS name FROM region UNION ALL SELECT 'EX:nation/' || n_nationkey, n_name FROM nation UNION ALL SELECT 'EX:supplier/' || s_suppkey, s_name FROM supplier")
def untyped_subject(g: Graph):
    """``?s name ?name`` without a class, over the classes that have the property."""
    return Graph(g.catalog.within({"Region", "Nation", "Supplier", "Event", "Document"})).anything("?s", {"name": "?name"})


@query("SELECT n_name AS name FROM nation WHERE n_nationkey = 7")
def untyped_iri(g: Graph):
    return Graph(g.catalog.within({"Region", "Nation", "Supplier"})).anything(EX + "nation/7", {"name": "?name"}).project("name")


@query(
    "SELECT 'EX:nation/' || n_nationkey AS subject, 'EX:name' AS predicate, n_name AS object FROM nation WHERE n_regionkey = 1"
    " UNION ALL SELECT 'EX:nation/' || n_nationkey, 'EX:inRegion', 'EX:region/' || n_regionkey FROM nation WHERE n_regionkey = 1"
    " UNION ALL SELECT 'EX:nation/' || n_nationkey, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'EX:Nation' FROM nation WHERE n_regionkey = 1"
)
def describe_var_rpt(g: Graph):
    """DESCRIBE over a triple table."""
    return g.describe("RptNation", g.star("?n", "RptNation", {EX + "inRegion": EX + "region/1"}), "n")


@query(
    "SELECT 'EX:nation/' || n_nationkey AS subject, 'name' AS predicate, n_name AS object FROM nation WHERE n_regionkey = 1"
    " UNION SELECT 'EX:region/' || r_regionkey, 'name', r_name FROM region WHERE r_regionkey = 1"
)
def describe_star(g: Graph):
    """DESCRIBE * of ?n and ?r."""
    found = g.star("?n", "Nation", {"region": "?r"}).filter(F.col("r") == 1)
    return g.describe_all(found, {"n": "Nation", "r": "Region"}, ("name",))


# -- term functions and casts


@query("SELECT p_partkey AS k, true AS name_literal, false AS iri_literal, false AS name_numeric, true AS size_numeric, '' AS tag FROM part")
def term_tests(g: Graph):
    s = g.star("?p", "Part", {"name": "?name", "size": "?size"})
    types = dict(s.df.dtypes)
    return s.df.select(
        F.col("p").alias("k"), S.is_literal(F.col("name")).alias("name_literal"), S.is_literal(s["p"]).alias("iri_literal"), S.is_numeric(F.col("name"), types["name"]).alias("name_numeric"),
        S.is_numeric(F.col("size"), types["size"]).alias("size_numeric"), S.lang(F.col("name")).alias("tag"),
    )


@query("SELECT p_partkey AS k, p_name AS value, 'http://www.w3.org/2001/XMLSchema#token' AS type, 'en' AS tag, 'EX:x/' || p_brand AS iri, 'EX:y' AS constant FROM part")
def term_makers(g: Graph):
    x, brand = F.col("name"), F.col("brand")
    made = S.strdt(x, S.XSD + "token")
    return g.star("?p", "Part", {"name": "?name", "brand": "?brand"}).df.select(
        F.col("p").alias("k"), made["value"].alias("value"), made["datatype"].alias("type"), S.strlang(x, "en")["lang"].alias("tag"), S.iri(brand, EX + "x/z").alias("iri"),
        S.iri("../y", EX + "x/z").alias("constant"),
    )


@query(
    "SELECT s_suppkey AS k, CASE WHEN trunc(s_acctbal) BETWEEN -128 AND 127 THEN trunc(s_acctbal)::BIGINT END AS b, CASE WHEN trunc(s_acctbal) BETWEEN 0 AND 65535 THEN trunc(s_acctbal)::BIGINT END AS us,"
    " CASE WHEN trunc(s_acctbal) < 0 THEN trunc(s_acctbal)::BIGINT END AS neg, CASE WHEN trunc(s_acctbal) > 0 THEN trunc(s_acctbal)::BIGINT END AS pos, s_acctbal <> 0 AS t, s_acctbal::FLOAT AS f FROM supplier"
)
def xsd_family(g: Graph):
    x = F.col("b")
    kinds = {"b": "byte", "us": "unsignedShort", "neg": "negativeInteger", "pos": "positiveInteger"}
    return g.star("?s", "Supplier", {"balance": "?b"}).df.select(
        F.col("s").alias("k"), *(N.xsd_integer(x, kind).alias(n) for n, kind in kinds.items()), N.xsd_boolean(x).alias("t"), N.xsd_float(x).alias("f")
    )


@query("SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_orderdate::TIMESTAMP AS t FROM orders")
def xsd_times(g: Graph):
    lexical = S.to_str(F.col("x"), "timestamp")
    return g.star("?o", "Order", {"date": "?x"}).df.select(F.col("o").alias("k"), N.xsd_date(lexical).alias("d"), N.xsd_datetime(lexical).cast("timestamp_ntz").alias("t"))
