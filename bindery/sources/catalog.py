"""What class and property each table, column, edge table or triple table holds.

A catalog names tables (DataFrames or functions that read them) and maps
classes and relationships onto them, in one of the storage styles:

* a class with a table of its own;
* a label: the rows of a shared table with one value of a discriminator;
* a triple table ``subject_uri, predicate, object_uri, object_value``;
* an edge table ``_from, _to``, of its own or shared with a discriminator;
* a foreign key column, which needs no edge table;
* a family of tables of one shape (shards), read as one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


#: One graph, several, or all of them.
Scope = str | tuple[str, ...] | None


class MappingError(ValueError):
    """A class, property or scope that the mapping cannot resolve."""


@dataclass(frozen=True)
class Prop:
    """A property: its column; ``target`` is the class a foreign key points to; ``many`` marks an array."""

    column: str
    target: str | None = None
    many: bool = False


@dataclass(frozen=True)
class ClassMap:
    """A class laid over a table. Its IRIs are ``prefix`` followed by the key column."""

    table: str
    key: str | None
    prefix: str = ""
    props: Mapping[str, Prop] = field(default_factory=dict)
    type_field: str | None = None
    type_value: str | None = None
    graph_field: str | None = None
    tenant_field: str | None = None
    #: root of the tenants; classes of two roots do not meet
    tenant_entity: str | None = None
    #: IRI of the class in a triple table; ``table`` is then the triple table
    triples_of: str | None = None


@dataclass(frozen=True)
class EdgeMap:
    """A relationship stored as rows of two keys."""

    table: str
    source: str
    target: str
    from_field: str = "_from"
    to_field: str = "_to"
    type_field: str | None = None
    type_value: str | None = None
    graph_field: str | None = None
    tenant_field: str | None = None
    #: root of the tenants; classes of two roots do not meet
    tenant_entity: str | None = None


@dataclass
class Catalog:
    tables: Mapping[str, Callable[[], DataFrame] | DataFrame]
    classes: Mapping[str, ClassMap] = field(default_factory=dict)
    edges: Mapping[str, EdgeMap] = field(default_factory=dict)
    shards: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    #: rows of one shard family may repeat in others
    shard_distinct: bool = False
    warnings: list[str] = field(default_factory=list)

    def table(self, name: str) -> DataFrame:
        if name in self.shards:
            parts = [self.table(n) for n in self.shards[name]]
            out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
            return out.distinct() if self.shard_distinct else out
        if name not in self.tables:
            raise MappingError(f"no table {name!r}")
        found = self.tables[name]
        return found() if callable(found) else found

    def class_map(self, name: str) -> ClassMap:
        if name not in self.classes:
            raise MappingError(f"class {name!r} is not mapped")
        return self.classes[name]

    def within(self, names: set[str]) -> Catalog:
        """Only these classes, and the edges between them."""
        classes = {n: m for n, m in self.classes.items() if n in names}
        edges = {n: e for n, e in self.edges.items() if e.source in classes and e.target in classes}
        return Catalog(self.tables, classes, edges, self.shards, self.shard_distinct)

    def rows(self, name: str, graph: Scope = None, tenant: str | None = None) -> DataFrame:
        """The rows of a class within its scopes. A class with a tenant field demands a tenant."""
        m = self.class_map(name)
        return _scoped(self.table(m.table), m, graph, tenant)

    def edge_rows(self, name: str, graph: Scope = None, tenant: str | None = None) -> DataFrame:
        m = self.edges[name]
        return _scoped(self.table(m.table), m, graph, tenant)

    def prop(self, cls: str, name: str) -> Prop | None:
        """The property; an undeclared one is the column of its name, if there is one."""
        m = self.class_map(cls)
        if name in m.props:
            return m.props[name]
        if name in self.table(m.table).columns:
            self.warnings.append(f"{cls}.{name} is not declared; column {name!r} is read")
            return Prop(name)
        return None


def in_graph(column: Column, graph: Scope) -> Column:
    """Rows of a named graph, of any of several, or with "" of the default graph."""
    names = [graph] if isinstance(graph, str) else list(graph)
    named = column.isin([n for n in names if n])
    return named | column.isNull() if "" in names else named


def _scoped(df: DataFrame, m: ClassMap | EdgeMap, graph: Scope, tenant: str | None) -> DataFrame:
    where: list[Column] = []
    if m.type_field:
        where.append(F.col(m.type_field) == m.type_value)
    if graph is not None:
        # a table without graphs is the default graph
        where.append(in_graph(F.col(m.graph_field) if m.graph_field else F.lit(None).cast("string"), graph))
    if m.tenant_field:
        if tenant is None:
            raise MappingError(f"table {m.table!r} is read for one tenant at a time")
        where.append(F.col(m.tenant_field) == tenant)
    return df.where(reduce(lambda a, b: a & b, where)) if where else df


def from_bundle(bundle: dict, tables: Mapping[str, Callable[[], DataFrame] | DataFrame]) -> Catalog:
    """A catalog from a mapping in JSON form (camel or snake case keys).

    ``physicalMapping.entities`` and ``.relationships`` name the tables and the
    styles COLLECTION, LABEL, RPT, DEDICATED_COLLECTION and GENERIC_WITH_TYPE;
    ``shardFamilies`` lists tables that are read as one.
    """

    def get(d: Mapping, camel: str, default=None):
        snake = "".join("_" + c.lower() if c.isupper() else c for c in camel)
        if camel in d and snake in d and camel != snake:
            raise MappingError(f"both {camel!r} and {snake!r} are given")
        return d.get(camel, d.get(snake, default))

    physical = get(bundle, "physicalMapping", {})
    shards = {family[0] + "*": tuple(family) for family in get(physical, "shardFamilies", []) or []}
    of = {table: name for name, family in shards.items() for table in family}
    classes, edges = {}, {}
    for name, e in get(physical, "entities", {}).items():
        table = get(e, "collectionName") or get(e, "triplesCollection") or name
        props = {p: Prop(get(v, "field", p) if isinstance(v, Mapping) else v) for p, v in (get(e, "properties", {}) or {}).items()}
        rpt = get(e, "style", get(e, "mappingStyle")) == "RPT"
        classes[name] = ClassMap(
            of.get(table, table), "_uri", "", props, get(e, "typeField"), get(e, "typeValue"), get(e, "graphField"), get(e, "tenantField"), get(e, "tenantEntity"), get(e, "iri", name) if rpt else None
        )
    for name, r in get(physical, "relationships", {}).items():
        table = get(r, "edgeCollectionName") or get(r, "collectionName") or name
        edges[name] = EdgeMap(
            table, get(r, "domain", ""), get(r, "range", ""), get(r, "fromField", "_from"), get(r, "toField", "_to"),
            get(r, "typeField"), get(r, "typeValue"), get(r, "graphField"), get(r, "tenantField"), get(r, "tenantEntity"),
        )
    return Catalog(tables, classes, edges, shards)


def fingerprint(catalog: Catalog) -> tuple[str, str]:
    """Hashes of the tables' shapes and of the mapping, over canonical JSON."""
    shapes = {n: sorted(catalog.table(n).dtypes) for n in catalog.tables}
    mapping = {"classes": {n: asdict(m) for n, m in catalog.classes.items()}, "edges": {n: asdict(m) for n, m in catalog.edges.items()}}
    digest = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True, default=str).encode()).hexdigest()
    return digest(shapes), digest(mapping)


def drift(before: tuple[str, str], after: tuple[str, str], counts: tuple[Mapping[str, int], Mapping[str, int]] | None = None) -> str:
    """What has changed; with row counts before and after also ``STATS_ONLY``."""
    if before == after and counts is not None and counts[0] != counts[1]:
        return "STATS_ONLY"
    return "UNCHANGED" if before == after else "SHAPE_CHANGED" if before[0] != after[0] else "MAPPING_CHANGED"
