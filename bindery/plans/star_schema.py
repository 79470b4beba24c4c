"""The star schema's tables as classes, edges and triple tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.patterns import Graph
from ..sources.catalog import RDF_TYPE, Catalog, ClassMap, EdgeMap, Prop

EX = "http://ex.org/"


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def nation_triples() -> DataFrame:
        """nation and customer as triples."""
        subject = F.concat(F.lit(EX + "nation/"), F.col("n_nationkey").cast("string"))
        none = F.lit(None).cast("string")

        def triple(p: str, iri, value):
            return F.struct(subject.alias("subject_uri"), F.lit(p).alias("predicate"), iri.alias("object_uri"), value.alias("object_value"))

        region = F.concat(F.lit(EX + "region/"), F.col("n_regionkey").cast("string"))
        parts = F.array(triple(RDF_TYPE, F.lit(EX + "Nation"), none), triple(EX + "name", none, F.col("n_name")), triple(EX + "inRegion", region, none))
        nations = read("nation").select(F.explode(parts).alias("t")).select("t.*")
        subject = F.concat(F.lit(EX + "customer/"), F.col("c_custkey").cast("string"))
        nation = F.concat(F.lit(EX + "nation/"), F.col("c_nationkey").cast("string"))
        parts = F.array(triple(RDF_TYPE, F.lit(EX + "Customer"), none), triple(EX + "name", none, F.col("c_name")), triple(EX + "livesIn", nation, none))
        return nations.unionByName(read("customer").select(F.explode(parts).alias("t")).select("t.*"))

    def typed_edges() -> DataFrame:
        def edge(table: str, a: str, b: str, kind: str) -> DataFrame:
            return read(table).select(F.col(a).cast("bigint").alias("_from"), F.col(b).cast("bigint").alias("_to"), F.lit(kind).alias("type"))

        return edge("orders", "o_orderkey", "o_custkey", "orderedBy").unionByName(edge("customer", "c_custkey", "c_nationkey", "livesIn")).unionByName(
            edge("nation", "n_nationkey", "n_regionkey", "inRegion")
        )

    def part_of() -> DataFrame:
        up = F.floor(F.col("p_partkey") / 10).cast("bigint")
        return read("part").select(F.col("p_partkey").alias("_from"), up.alias("_to")).where("_from != _to AND _to > 0")

    def ring() -> DataFrame:
        return read("nation").select(F.col("n_nationkey").alias("_from"), ((F.col("n_nationkey") + 1) % 25).cast("int").alias("_to"))

    def words() -> DataFrame:
        return read("documents").select("doc_id", F.split(F.col("text"), " ").alias("words"))

    def graph_triples() -> DataFrame:
        """The nations' triples, each in the graph of the nation's region."""
        region = F.concat(F.lit(EX + "graph/"), F.col("n_regionkey").cast("string"))
        subject = F.concat(F.lit(EX + "nation/"), F.col("n_nationkey").cast("string"))
        of = read("nation").select(subject.alias("subject_uri"), region.alias("_graph"))
        return nation_triples().join(of, "subject_uri")

    names = "region nation customer supplier part orders lineitem events documents embeddings labels".split()
    tables = {n: (lambda n=n: read(n)) for n in names}
    tables |= {"triples": nation_triples, "edges": typed_edges, "part_of": part_of, "ring": ring, "words": words, "graph_triples": graph_triples}
    for status in "FOP":
        tables[f"orders_{status}"] = lambda status=status: read("orders").where(F.col("o_orderstatus") == status)
    tables["graph_documents"] = lambda: read("documents").withColumn("_graph", F.concat(F.lit(EX + "graph/"), F.col("source")))

    def cls(table: str, key: str | None, word: str, /, **props: str | Prop) -> ClassMap:
        return ClassMap(table, key, f"{EX}{word}/" if key else "", {k: Prop(v) if isinstance(v, str) else v for k, v in props.items()})

    customer = {"name": "c_name", "segment": "c_mktsegment", "balance": "c_acctbal", "nation": Prop("c_nationkey", "Nation")}
    order = {"customer": Prop("o_custkey", "Customer"), "total": "o_totalprice", "status": "o_orderstatus", "date": "o_orderdate", "priority": "o_orderpriority"}
    document = {"lang": "lang", "source": "source", "chars": "n_chars", "text": "text"}
    classes = {
        "Region": cls("region", "r_regionkey", "region", name="r_name"),
        "Nation": cls("nation", "n_nationkey", "nation", name="n_name", region=Prop("n_regionkey", "Region")),
        "Customer": cls("customer", "c_custkey", "customer", **customer),
        "Supplier": cls("supplier", "s_suppkey", "supplier", name="s_name", nation=Prop("s_nationkey", "Nation"), balance="s_acctbal"),
        "Part": cls("part", "p_partkey", "part", name="p_name", brand="p_brand", type="p_type", size="p_size", price="p_retailprice"),
        "Order": cls("orders", "o_orderkey", "order", **order),
        "ShardedOrder": cls("orders*", "o_orderkey", "order", **order),
        # no natural key: line items are blank nodes
        "LineItem": cls(
            "lineitem", None, "", order=Prop("l_orderkey", "Order"), part=Prop("l_partkey", "Part"), supplier=Prop("l_suppkey", "Supplier"), quantity="l_quantity",
            price="l_extendedprice", discount="l_discount", tax="l_tax", flag="l_returnflag", status="l_linestatus", shipped="l_shipdate",
        ),
        "Event": cls("events", "event_id", "event", user="user_id", value="value", kind="event_type", at="ts", props="props"),
        "Purchase": ClassMap("events", "event_id", EX + "event/", {"user": Prop("user_id"), "value": Prop("value")}, "event_type", "purchase"),
        "Document": cls("documents", "doc_id", "document", **document),
        "GraphDocument": ClassMap("graph_documents", "doc_id", EX + "document/", {k: Prop(v) for k, v in document.items()}, graph_field="_graph"),
        "Label": cls("labels", None, "", document=Prop("doc_id", "Document"), quality="quality", toxic="toxic"),
        "WordDocument": cls("words", "doc_id", "document", word=Prop("words", many=True)),
        "TenantCustomer": ClassMap("customer", "c_custkey", EX + "customer/", {k: Prop(v) if isinstance(v, str) else v for k, v in customer.items()}, tenant_field="c_mktsegment"),
        "RptNation": ClassMap("triples", "subject_uri", triples_of=EX + "Nation"),
        "GraphRptNation": ClassMap("graph_triples", "subject_uri", triples_of=EX + "Nation", graph_field="_graph"),
        "RptCustomer": ClassMap("triples", "subject_uri", triples_of=EX + "Customer"),
    }
    edges = {
        "orderedBy": EdgeMap("edges", "Order", "Customer", type_field="type", type_value="orderedBy"),
        "livesIn": EdgeMap("edges", "Customer", "Nation", type_field="type", type_value="livesIn"),
        "inRegion": EdgeMap("edges", "Nation", "Region", type_field="type", type_value="inRegion"),
        "partOf": EdgeMap("part_of", "Part", "Part"),
        "next": EdgeMap("ring", "Nation", "Nation"),
        "placedBy": EdgeMap("orders", "Order", "Customer", "o_orderkey", "o_custkey", tenant_field="o_orderpriority"),
    }
    return Catalog(tables, classes, edges, {"orders*": ("orders_F", "orders_O", "orders_P")})


def graph(spark: SparkSession, sf_dir: str, **scope: str) -> Graph:
    return Graph(catalog(spark, sf_dir), **scope)
