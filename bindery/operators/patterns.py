"""Graph patterns over a catalog: stars, edges, triple tables, variable predicates.

A star is all triples of one subject. It is one scan: several properties of a
row cost no join, optional ones are nullable columns, constants are filters
that Parquet sees.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import RDF_TYPE, Catalog, ClassMap, EdgeMap, MappingError, Scope, in_graph
from .solutions import Solutions, Var


class Graph:
    """A catalog seen through a scope: a named graph, a tenant, a dataset.

    ``named`` are the graphs that ``GRAPH`` may read; None for all.
    """

    def __init__(self, catalog: Catalog, graph: Scope = None, tenant: str | None = None, named: tuple[str, ...] | None = None):
        self.catalog, self.graph, self.tenant, self.named = catalog, graph, tenant, named

    def dataset(self, *default: str, named: tuple[str, ...] = ()) -> Graph:
        """``FROM`` and ``FROM NAMED``: patterns read the merge of the default graphs, those inside ``GRAPH`` the named ones."""
        return Graph(self.catalog, default, self.tenant, named)

    def inside(self, graph: str) -> Graph:
        """``GRAPH <graph> { ... }``; of nested ones the innermost holds."""
        readable = self.named is None or graph in self.named
        return Graph(self.catalog, graph if readable else (), self.tenant, self.named)

    def _solutions(self, m: ClassMap | EdgeMap, df: DataFrame, vars_: Mapping[str, Var]) -> Solutions:
        """Solutions that know whose rows they are."""
        return Solutions(df, vars_, frozenset({(m.tenant_entity, self.tenant)}) if m.tenant_field else frozenset())

    # -- tables as classes

    def star(self, subject: str, cls: str, props: Mapping[str, object] | None = None, optional: Mapping[str, str] | None = None, graph_var: str | None = None) -> Solutions:
        """Triples of one subject of a class.

        ``subject`` is ``?var`` or an IRI. Each property goes to ``?var`` (it
        must be there) or to a constant it must equal; those of ``optional`` may
        be missing. One variable twice demands equal values. A property without
        a column makes a required triple empty and an optional one unbound.
        """
        m = self.catalog.class_map(cls)
        if m.triples_of:
            if m.tenant_field:
                raise MappingError(f"{cls}: a triple table has no column of tenants")
            return self._triple_star(subject, m, props or {}, optional or {}, graph_var)
        df = self.catalog.rows(cls, self.named if graph_var and self.named is not None else self.graph, self.tenant)
        out: dict[str, tuple[Column, Var]] = {}
        if subject.startswith("?"):
            if m.key is not None:
                out[subject[1:]] = (F.col(m.key), Var(m.prefix))
        else:
            df = df.where(self.has_iri(cls, subject))
        for name, want in (props or {}).items():
            p = self.catalog.prop(cls, name)
            if p is None:
                df = df.where(F.lit(False))
                if isinstance(want, str) and want.startswith("?"):
                    out.setdefault(want[1:], (F.lit(None).cast("string"), Var()))
                continue
            column = F.col(p.column)
            prefix = self.catalog.class_map(p.target).prefix if p.target else None
            if not (isinstance(want, str) and want.startswith("?")):
                if p.many:
                    df = df.where(F.array_contains(column, F.lit(want)))
                else:
                    df = df.where(self.has_iri(p.target, want, p.column) if p.target else column == F.lit(want))
                continue
            if p.many:
                many = f"_{name}"
                df = df.withColumn(many, F.explode(column))
                column = F.col(many)
            else:
                df = df.where(column.isNotNull())
            var = want[1:]
            if var in out:
                df = df.where(out[var][0] == column)
            else:
                out[var] = (column, Var(prefix))
        for name, want in (optional or {}).items():
            p = self.catalog.prop(cls, name)
            prefix = self.catalog.class_map(p.target).prefix if p and p.target else None
            out[want[1:]] = (F.col(p.column) if p else F.lit(None).cast("string"), Var(prefix, True))
        if graph_var:
            named = F.col(m.graph_field) if m.graph_field else F.lit(None).cast("string")  # else all is in the default graph
            df = df.where(named.isNotNull())
            out[graph_var] = (named, Var(""))
        df = df.select(*(c.alias(n) for n, (c, _) in out.items())) if out else df.select(F.lit(1).alias("_row"))
        return self._solutions(m, df, {n: v for n, (_, v) in out.items()} or {"_row": Var()})

    def anything(self, subject: str, props: Mapping[str, object] | None = None, optional: Mapping[str, str] | None = None) -> Solutions:
        """Triples of one subject of whatever class: the union over all mapped classes that
        declare the required properties, without repeats where classes share a table."""
        stars, seen = [], set()
        for name, m in self.catalog.classes.items():
            place = (m.table, m.key, m.prefix, m.type_field, m.type_value, m.triples_of)
            declared = m.triples_of or all(p in m.props for p in props or {})
            if declared and place not in seen and (m.key is not None or not subject.startswith("?")):
                seen.add(place)
                stars.append(self.star(subject, name, props, optional))
        if not stars:
            raise MappingError(f"no mapped class has {sorted(props or {})}")
        return reduce(Solutions.union, stars).distinct() if len(stars) > 1 else stars[0]

    def has_iri(self, cls: str, iri: str, column: str | None = None) -> Column:
        """A constant IRI as a filter on the key column, in the key's own type."""
        m = self.catalog.class_map(cls)
        if not iri.startswith(m.prefix):
            return F.lit(False)
        kind = dict(self.catalog.table(m.table).dtypes)[m.key]
        return F.col(column or m.key) == F.lit(iri.removeprefix(m.prefix)).try_cast(kind)

    def edge(self, subject: str, name: str, target: str) -> Solutions:
        """One hop over an edge table; the ends keep the keys of their classes."""
        m = self.catalog.edges[name]
        ends = {subject: (m.from_field, m.source), target: (m.to_field, m.target)}
        df = self.catalog.edge_rows(name, self.graph, self.tenant)
        for iri, (column, cls) in ends.items():
            if not iri.startswith("?"):
                df = df.where(self.has_iri(cls, iri, column))
        out = {v[1:]: (c, Var(self.catalog.class_map(cls).prefix)) for v, (c, cls) in ends.items() if v.startswith("?")}
        if subject == target:
            df = df.where(F.col(m.from_field) == F.col(m.to_field))
        df = df.select(*(F.col(c).alias(n) for n, (c, _) in out.items())) if out else df.select(F.lit(1).alias("_row"))
        return self._solutions(m, df, {n: v for n, (_, v) in out.items()} or {"_row": Var()})

    # -- triple tables

    def triples(self, table: str, subject: str = "?s", predicate: str = "?p", object_: object = "?o", graph_field: str | None = None, graph_var: str | None = None) -> Solutions:
        """One triple pattern. An object variable takes the IRI or else the value; an IRI
        constant matches either column, a literal the value only.

        ``graph_field`` names the column of graphs (``_graph`` if there is such
        a one); without it all triples are in the default graph.
        """
        df = self.catalog.table(table)
        column = graph_field or ("_graph" if "_graph" in df.columns else None)
        named = F.col(column) if column else F.lit(None).cast("string")
        scope = self.named if graph_var and self.named is not None else self.graph
        if scope is not None:
            df = df.where(in_graph(named, scope))
        out: dict[str, Column] = {}
        places = {"s": (subject, F.col("subject_uri")), "p": (predicate, F.col("predicate")), "o": (object_, F.coalesce("object_uri", "object_value"))}
        for place, (want, column) in places.items():
            if isinstance(want, str) and want.startswith("?"):
                if want[1:] in out:
                    df = df.where(out[want[1:]] == column)
                out.setdefault(want[1:], column)
            elif place != "o":
                df = df.where(column == F.lit(want))
            elif isinstance(want, str) and "://" in want:
                df = df.where((F.col("object_uri") == want) | (F.col("object_value") == want))
            else:
                df = df.where(F.col("object_value") == F.lit(str(want)))
        if graph_var:
            df = df.where(named.isNotNull())
            out[graph_var] = named
        df = df.select(*(c.alias(n) for n, c in out.items())) if out else df.select(F.lit(1).alias("_row"))
        return Solutions(df, {n: Var("" if n in (subject[1:], predicate[1:], graph_var) else None) for n in out} or {"_row": Var()})

    def _triple_star(self, subject: str, m: ClassMap, props: Mapping[str, object], optional: Mapping[str, str], graph_var: str | None = None) -> Solutions:
        one = lambda p, o: self.triples(m.table, subject, p, o, m.graph_field, graph_var)
        out = reduce(Solutions.join, [one(RDF_TYPE, m.triples_of), *(one(p, o) for p, o in props.items())])
        for p, o in optional.items():
            out = out.optional(one(p, o))
        return out

    # -- variable predicates

    def all_triples(self, cls: str, only: tuple[str, ...] | None = None) -> Solutions:
        """``?s ?p ?o`` over a class: its declared properties unpivoted, one row a value of
        those of many, and the edges that leave the class; values as text.

        ``only`` narrows ``?p`` before anything is read.
        """
        m = self.catalog.class_map(cls)
        if m.triples_of:
            return self._all_of_triples(cls, m, only)
        df = self.catalog.rows(cls, self.graph, self.tenant)
        props = {n: p for n, p in m.props.items() if only is None or n in only}
        prefix = lambda target: self.catalog.class_map(target).prefix if target in self.catalog.classes else None
        text = lambda column, target: Var(prefix(target)).shown(column).cast("string")
        single = {n: text(F.col(p.column), p.target) for n, p in props.items() if not p.many}
        arms = []
        if single:
            arms.append(df.select(F.col(m.key).alias("s"), *(c.alias(n) for n, c in single.items())).unpivot("s", list(single), "p", "o"))
        for n, p in props.items():
            if p.many:
                each = df.select(F.col(m.key).alias("s"), F.explode(p.column).alias("o"))
                arms.append(each.select("s", F.lit(n).alias("p"), text(F.col("o"), p.target).alias("o")))
        for n, e in self.catalog.edges.items():
            if e.source == cls and (only is None or n in only):
                rows = self.catalog.edge_rows(n, self.graph, self.tenant)
                arms.append(rows.select(F.col(e.from_field).alias("s"), F.lit(n).alias("p"), text(F.col(e.to_field), e.target).alias("o")))
        if not arms:
            raise MappingError(f"{cls} has no such properties")
        long = reduce(DataFrame.unionByName, arms).where("s IS NOT NULL AND o IS NOT NULL")
        return self._solutions(m, long, {"s": Var(m.prefix), "p": Var(""), "o": Var()})

    def _all_of_triples(self, cls: str, m: ClassMap, only: tuple[str, ...] | None) -> Solutions:
        """All triples whose subjects a triple table calls members of the class."""
        members = self.star("?s", cls)
        found = self.triples(m.table, "?s", "?p", "?o", m.graph_field)
        if only is not None:
            found = found.filter(F.col("p").isin(*only))
        return found.exists(members)

    def describe_all(self, resources: Solutions, classes: Mapping[str, str], only: tuple[str, ...] | None = None) -> DataFrame:
        """``DESCRIBE *``: the set of triples about what the variables bind, each of the class given for it."""
        parts = [self.describe(cls, resources, var, only) for var, cls in classes.items()]
        return reduce(DataFrame.unionByName, parts).distinct()

    def describe(self, cls: str, resources: Solutions | list[str], var: str = "s", only: tuple[str, ...] | None = None) -> DataFrame:
        """The set of triples about the resources, of the predicates ``only`` if given."""
        triples = self.all_triples(cls, only)
        if isinstance(resources, list):
            m = self.catalog.class_map(cls)
            kind = dict(triples.df.dtypes)["s"]
            keys = [F.lit(r.removeprefix(m.prefix)).try_cast(kind) for r in resources if r.startswith(m.prefix)]
            found = triples.filter(reduce(lambda a, b: a | b, (F.col("s") == k for k in keys), F.lit(False)))
        else:
            bound = resources.df.where(F.col(var).isNotNull()).select(F.col(var).alias("s"))
            found = triples.exists(resources._new(bound, {"s": Var(resources.vars[var].prefix)}))
        return found.construct(("?s", "?p", "?o"))


def values(spark, rows: list[dict[str, object]], schema: str, prefixes: Mapping[str, str] | None = None) -> Solutions:
    """Inline data; None is UNDEF. The rows are the caller's own, so their number is known."""
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    unbound = {n for n in df.columns if any(r.get(n) is None for r in rows)}
    return Solutions(df, {n: Var((prefixes or {}).get(n), n in unbound) for n in df.columns})


def unit(spark) -> Solutions:
    """One solution that binds nothing."""
    return Solutions(spark.range(1).withColumnRenamed("id", "_row"), {"_row": Var()})
