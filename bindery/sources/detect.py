"""Schema detection: what storage style tables have, from whole-table aggregates."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import Catalog, ClassMap, EdgeMap, Prop

#: Columns that tell classes apart, in order of preference.
SURE_DISCRIMINATORS = ("type", "_type", "entityType")
LIKELY_DISCRIMINATORS = ("label", "labels", "kind")
EDGE_DISCRIMINATORS = ("type", "relation", "relType", "_type")
#: A likely discriminator has at most so many values, for at most so large a share of the rows.
MOST_VALUES, MOST_SHARE = 32, 0.5
CLASS_LIKE = r"^[A-Za-z0-9_-]+$"
#: Share of rows that must look like triples.
TRIPLE_SHARE = 0.8
#: Column sets of triple tables.
TRIPLE_SHAPES = (("subject_uri", "predicate", "object_uri", "object_value"), ("subject", "predicate", "object_uri", "object_value"))


@dataclass(frozen=True)
class Profile:
    """What was found of one table."""

    name: str
    rows: int
    style: str  # triples, edges, labelled, plain
    discriminator: str | None = None
    values: tuple[str, ...] = ()
    columns: tuple[str, ...] = field(default_factory=tuple)


def triple_shape(df: DataFrame) -> tuple[str, ...] | None:
    """The triple columns, if enough rows have subject, predicate and one object."""
    for shape in TRIPLE_SHAPES:
        if set(shape) <= set(df.columns):
            s, p, uri, value = (F.col(c) for c in shape)
            good = s.isNotNull() & p.isNotNull() & (uri.isNotNull() | value.isNotNull())
            n, hits = df.agg(F.count("*"), F.count(F.when(good, 1))).first()
            if n and hits >= TRIPLE_SHARE * n:
                return shape
    return None


def discriminator(df: DataFrame, edges: bool = False) -> tuple[str, tuple[str, ...]] | None:
    """The column whose values are classes, with all its values; those of a likely column are few and name-like."""
    sure = EDGE_DISCRIMINATORS if edges else SURE_DISCRIMINATORS
    wanted = [c for c in (*sure, *(() if edges else LIKELY_DISCRIMINATORS)) if c in df.columns and dict(df.dtypes)[c] == "string"]
    if not wanted:
        return None
    stats = df.agg(
        *(F.count(c).alias(f"n_{c}") for c in wanted),
        *(F.approx_count_distinct(c).alias(f"d_{c}") for c in wanted),
        *(F.coalesce(F.bool_and(F.col(c).rlike(CLASS_LIKE)), F.lit(False)).alias(f"ok_{c}") for c in wanted),
    ).first()
    for c in wanted:
        n, d, ok = (stats[f"{k}_{c}"] for k in ("n", "d", "ok"))
        likely = c not in sure
        # the estimate may be off
        if not n or (likely and not (ok and d <= 2 * MOST_VALUES and d <= MOST_SHARE * n)):
            continue
        found = df.select(c).where(F.col(c).isNotNull()).distinct()
        values = [r[0] for r in (found.limit(MOST_VALUES + 1) if likely else found).collect()]
        if not likely or len(values) <= MOST_VALUES:
            return c, tuple(sorted(values))
    return None


def profile(name: str, df: DataFrame) -> Profile:
    n = df.count()
    if triple_shape(df):
        return Profile(name, n, "triples", columns=tuple(df.columns))
    edges = {"_from", "_to"} <= set(df.columns)
    found = discriminator(df, edges)
    style = "edges" if edges else "labelled" if found else "plain"
    return Profile(name, n, style, *(found or (None, ())), columns=tuple(df.columns))


def columns_profile(df: DataFrame, rows: int = 1_000) -> list[tuple[str, str, float, bool]]:
    """Name, type, filled share and whether a value is required, by a sample of at most ``rows`` rows.

    A column is required if every sampled row fills it; a table without rows requires none.
    """
    some = df.limit(rows)
    counts = some.agg(F.count("*"), *(F.count(F.col(f"`{c}`")) for c in df.columns)).first()
    n = counts[0]
    return [(c, t, filled / n if n else 0.0, n > 0 and filled == n) for (c, t), filled in zip(df.dtypes, counts[1:])]


def overall(profiles: list[Profile]) -> str:
    """``pg``, ``lpg``, ``rpt``, ``hybrid`` or ``unknown``."""
    kinds = {{"plain": "pg", "labelled": "lpg", "triples": "rpt"}[p.style] for p in profiles if p.style != "edges" and p.rows}
    return "unknown" if not kinds else kinds.pop() if len(kinds) == 1 else "hybrid"


def edge_ends(edges: DataFrame, vertices: Mapping[str, DataFrame], key: str = "_id") -> tuple[str, str]:
    """The class of each end if all edges agree, else ``Any``."""
    keys = [df.select(F.col(key).cast("string").alias("k"), F.lit(name).alias("c")) for name, df in vertices.items()]
    known = reduce(DataFrame.unionByName, keys)
    out = []
    for end in ("_from", "_to"):
        met = edges.select(F.col(end).cast("string").alias("k")).join(known, "k", "left")
        classes, missing = met.agg(F.collect_set("c"), F.count(F.when(F.col("c").isNull(), 1))).first()
        out.append(classes[0] if len(classes) == 1 and not missing else "Any")
    return out[0], out[1]


def object_properties(triples: DataFrame, type_iri: str) -> DataFrame:
    """``predicate, domain, range, n``: predicates that lead from typed subjects to typed objects."""
    types = triples.where(F.col("predicate") == type_iri).select(F.col("subject_uri").alias("node"), F.col("object_uri").alias("class"))
    links = triples.where((F.col("predicate") != type_iri) & F.col("object_uri").isNotNull())
    domain = types.withColumnsRenamed({"node": "subject_uri", "class": "domain"})
    range_ = types.withColumnsRenamed({"node": "object_uri", "class": "range"})
    return links.join(domain, "subject_uri").join(range_, "object_uri").groupBy("predicate", "domain", "range").agg(F.count("*").alias("n"))


def detect(tables: Mapping[str, DataFrame], key: str = "_id", type_iri: str = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type") -> tuple[str, Catalog]:
    """The overall style and a catalog guessed from the tables."""
    profiles = [profile(n, df) for n, df in tables.items()]
    classes: dict[str, ClassMap] = {}
    for p in profiles:
        props = {c: Prop(c) for c in p.columns if not c.startswith("_") and c != p.discriminator}
        if p.style == "plain":
            classes[p.name] = ClassMap(p.name, key if key in p.columns else None, "", props)
        elif p.style == "labelled":
            for v in p.values:
                classes[v] = ClassMap(p.name, key if key in p.columns else None, "", props, p.discriminator, v)
        elif p.style == "triples":
            found = tables[p.name].where(F.col("predicate") == type_iri).where("object_uri IS NOT NULL").select("object_uri").distinct()
            for r in found.orderBy("object_uri").collect():
                local = r[0].rpartition("/")[2].rpartition("#")[2]
                # of two classes of one local name the second goes by its whole IRI
                name = local if local and local not in classes else r[0]
                classes[name] = ClassMap(p.name, p.columns[0], triples_of=r[0])
    vertices = {n: _rows(tables, m) for n, m in classes.items() if m.key == key}
    edges: dict[str, EdgeMap] = {}
    for p in profiles:
        if p.style == "edges" and vertices:
            for v in p.values or (None,):
                df = tables[p.name] if v is None else tables[p.name].where(F.col(p.discriminator) == v)
                edges[v or p.name] = EdgeMap(p.name, *edge_ends(df, vertices, key), type_field=p.discriminator, type_value=v)
    return overall(profiles), Catalog(dict(tables), classes, edges)


def _rows(tables: Mapping[str, DataFrame], m: ClassMap) -> DataFrame:
    df = tables[m.table]
    return df.where(F.col(m.type_field) == m.type_value) if m.type_field else df


def sample_questions(catalog: Catalog, count: int = 10) -> list[str]:
    """Plain questions that the mapping can answer."""
    out = [f"Which {name} are known, by {p}?" for name, m in catalog.classes.items() for p in list(m.props)[:1]]
    out += [f"What is the number of {name}?" for name in catalog.classes]
    out += [f"For each {e.source}, to how many {e.target} does {name} lead?" for name, e in catalog.edges.items()]
    return list(dict.fromkeys(out))[:count]
