"""A bag of solutions: a DataFrame with a column for each variable.

Null is "unbound". An IRI variable keeps the raw key of its template
(``http://ex.org/customer/`` + 42) as long as it can, so joins run on integers
and constant IRIs reach the Parquet scan as key filters; the text is made when
it is shown or meets an IRI of another make.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import sample
from ..sources.catalog import MappingError


@dataclass(frozen=True)
class Var:
    """What is known of a variable.

    ``prefix`` is the template of an IRI whose key the column holds, "" for
    whole IRIs, None for literals. ``unbound`` says that it may be null.
    """

    prefix: str | None = None
    unbound: bool = False

    def shown(self, column: Column) -> Column:
        return F.concat(F.lit(self.prefix), column.cast("string")) if self.prefix else column


class Solutions:
    """Immutable; every method returns new solutions and runs nothing.

    ``tenants`` are the pairs of tenant root (None if none is named) and tenant
    that the rows were read for; solutions of two roots or tenants do not meet.
    """

    def __init__(self, df: DataFrame, vars_: Mapping[str, Var], tenants: frozenset[tuple[str | None, str]] = frozenset()):
        self.df = df.select(*vars_)
        self.vars = dict(vars_)
        self.tenants = tenants

    def _new(self, df: DataFrame, vars_: Mapping[str, Var]) -> Solutions:
        return Solutions(df, vars_, self.tenants)

    def _beside(self, other: Solutions) -> Solutions:
        """These solutions with the tenants of both sides, which must agree."""
        both = self.tenants | other.tenants
        if len({t for _, t in both}) > 1 or len({r for r, _ in both if r is not None}) > 1:
            raise MappingError(f"rows of different tenants do not meet: {sorted(map(str, both))}")
        return Solutions(self.df, self.vars, both)

    # -- columns

    def __getitem__(self, name: str) -> Column:
        """The value of a variable, IRIs as text."""
        return self.vars[name].shown(F.col(name))

    def key(self, name: str) -> Column:
        """The column as it is stored: the key of a template IRI."""
        return F.col(name)

    def frame(self, *names: str) -> DataFrame:
        """The solutions with IRIs as text."""
        return self.df.select(*(self[n].alias(n) for n in (names or self.vars)))

    def _whole(self, *names: str) -> Solutions:
        """Turn template keys into whole IRIs."""
        df = self.df.withColumns({n: self[n] for n in names if self.vars[n].prefix})
        return self._new(df, {n: replace(v, prefix="") if n in names and v.prefix else v for n, v in self.vars.items()})

    def _aligned(self, other: Solutions) -> tuple[Solutions, Solutions, list[str], bool]:
        """Both sides with like columns for shared variables; whether they can never be equal."""
        shared = [v for v in self.vars if v in other.vars]
        pairs = {v: (self.vars[v].prefix, other.vars[v].prefix) for v in shared}
        loose = self._loose(other)
        clash = any(a != b and a and b and v not in loose for v, (a, b) in pairs.items())
        mixed = [v for v, (a, b) in pairs.items() if a != b and (v in loose or not (a and b))]
        left, right = self._beside(other)._whole(*mixed), other._whole(*mixed)
        return left, right, shared, clash

    def _loose(self, other: Solutions) -> list[str]:
        """Shared variables that a side may leave unbound."""
        return [v for v in self.vars if v in other.vars and (self.vars[v].unbound or other.vars[v].unbound)]

    # -- filters and projections

    def filter(self, condition: Column | Callable[[Solutions], Column]) -> Solutions:
        return self._new(self.df.where(condition(self) if callable(condition) else condition), self.vars)

    def bind(self, name: str, value: Column | Callable[[Solutions], Column], unbound: bool = True) -> Solutions:
        if name in self.vars:
            raise ValueError(f"?{name} is bound already")
        column = value(self) if callable(value) else value
        return self._new(self.df.withColumn(name, column), self.vars | {name: Var(unbound=unbound)})

    def project(self, *names: str) -> Solutions:
        """Variables in order; one that is nowhere bound is null."""
        missing = [n for n in names if n not in self.vars]
        df = self.df.withColumns({n: F.lit(None).cast("string") for n in missing})
        return self._new(df, {n: self.vars.get(n, Var(unbound=True)) for n in names})

    def distinct(self) -> Solutions:
        return self._new(self.df.distinct(), self.vars)

    def reduced(self) -> Solutions:
        """REDUCED permits duplicates; they stay."""
        return self

    def explain(self) -> None:
        self.frame().explain("formatted")

    def order_by(self, *keys: Column) -> Solutions:
        """Unbound sorts first: pass ``asc_nulls_first`` or ``desc_nulls_last``."""
        return self._new(self.df.orderBy(*keys), self.vars)

    def slice(self, limit: int | None = None, offset: int = 0) -> Solutions:
        df = self.df.offset(offset) if offset else self.df
        return self._new(df if limit is None else df.limit(limit), self.vars)

    # -- joins

    # Compatible solutions agree where both are bound. Where variables may be
    # unbound, each side is parted by which of them are bound; two parts meet
    # by equality of what both have, so every part with something in common is
    # an equi-join, and only the part with nothing in common meets all rows.

    def _parts(self, loose: Sequence[str]) -> list[tuple[set[str], Solutions]]:
        """The rows by which of the loose variables they bind."""
        open_ = [v for v in loose if self.vars[v].unbound]
        if not open_:
            return [(set(loose), self)]
        out = []
        for bound in (set(c) for n in range(len(open_), -1, -1) for c in combinations(open_, n)):
            where = reduce(lambda a, b: a & b, (F.col(v).isNotNull() if v in bound else F.col(v).isNull() for v in open_))
            vars_ = self.vars | {v: replace(self.vars[v], unbound=v not in bound) for v in open_}
            out.append((bound | (set(loose) - set(open_)), self._new(self.df.where(where), vars_)))
        return out

    def _met(self, right: Solutions, shared: Sequence[str], keys: Sequence[str], how: str, on: Callable[[Solutions, Solutions], Column] | None) -> DataFrame:
        """Both sides by equality of ``keys``; shared variables of the right are called ``_r_...``."""
        r_df = right.df.withColumnsRenamed({v: f"_r_{v}" for v in shared})
        parts = [F.col(f"l.{v}") == F.col(f"_r_{v}") for v in keys]
        if on is not None:
            parts.append(on(self, right))
        if not parts and how == "inner":
            return self.df.alias("l").crossJoin(r_df)
        if not parts:  # any row of the right will do
            r_df = r_df.limit(1)
        return self.df.alias("l").join(r_df, reduce(lambda x, y: x & y, parts) if parts else F.lit(True), how)

    def _inner(self, right: Solutions, shared: Sequence[str], keys: Sequence[str], on: Callable[[Solutions, Solutions], Column] | None, how: str = "inner") -> Solutions:
        more = [v for v in right.vars if v not in shared]
        joined = self._met(right, shared, keys, how, on)
        merged = [(F.coalesce(f"l.{v}", f"_r_{v}") if self.vars[v].unbound and v in shared else F.col(f"l.{v}")).alias(v) for v in self.vars]
        both = {v: replace(x, unbound=x.unbound and (v not in shared or right.vars[v].unbound)) for v, x in self.vars.items()}
        return self._new(joined.select(*merged, *more), both | {v: replace(right.vars[v], unbound=right.vars[v].unbound or how == "left") for v in more})

    def _joined(self, other: Solutions, on: Callable[[Solutions, Solutions], Column] | None = None) -> Solutions:
        left, right, shared, clash = self._aligned(other)
        if clash:
            right = right.filter(F.lit(False))
        loose = left._loose(right)
        sure = [v for v in shared if v not in loose]
        if not loose:
            return left._inner(right, shared, sure, on)
        met = [a._inner(b, shared, sure + [v for v in loose if v in x and v in y], on) for x, a in left._parts(loose) for y, b in right._parts(loose)]
        return reduce(Solutions.union, met)

    def join(self, other: Solutions) -> Solutions:
        """Compatible solutions together; without shared variables all pairs."""
        return self._joined(other)

    def theta_join(self, other: Solutions, on: Callable[[Solutions, Solutions], Column]) -> Solutions:
        return self._joined(other, on)

    def _probed(self, right: Solutions, shared: Sequence[str], want: bool, on: Callable[[Solutions, Solutions], Column] | None = None, overlap: bool = False) -> Solutions:
        """The rows that do (or do not) meet a compatible row of the right, with ``overlap`` one that shares a bound variable."""
        loose = self._loose(right)
        sure = [v for v in shared if v not in loose]
        out = []
        for x, rest in self._parts(loose):
            for y, b in right._parts(loose):
                keys = sure + [v for v in loose if v in x and v in y]
                if overlap and not keys:
                    continue
                if want:
                    out.append(rest._new(rest._met(b, shared, keys, "left_semi", on), rest.vars))
                rest = rest._new(rest._met(b, shared, keys, "left_anti", on), rest.vars)
            if not want:
                out.append(rest)
        return reduce(Solutions.union, out) if out else self.filter(F.lit(False))

    def optional(self, other: Solutions, on: Callable[[Solutions, Solutions], Column] | None = None) -> Solutions:
        """Left join; a filter of the optional part belongs into ``on``, which names columns of both sides."""
        left, right, shared, clash = self._aligned(other)
        more = [v for v in right.vars if v not in shared]
        if not clash and not left._loose(right):
            return left._inner(right, shared, shared, on, "left") if shared or on is not None else left._crossed(right)
        alone = left if clash else left._probed(right, shared, False, on)
        types = dict(right.df.dtypes)
        df = alone.df.withColumns({v: F.lit(None).cast(types[v]) for v in more})
        alone = left._new(df, alone.vars | {v: replace(right.vars[v], unbound=True) for v in more})
        return alone if clash else left._joined(right, on).union(alone)

    def _crossed(self, right: Solutions) -> Solutions:
        """An optional part that shares nothing: all pairs, or the left rows alone if it is empty."""
        joined = self.df.join(right.df, F.lit(True), "left")
        return self._new(joined, self.vars | {v: replace(x, unbound=True) for v, x in right.vars.items()})

    def minus(self, other: Solutions) -> Solutions:
        """Without the solutions that share a bound variable with, and are compatible to, one of ``other``."""
        left, right, shared, clash = self._aligned(other)
        if not shared or clash:
            return self
        right = right._new(right.df.select(*shared).distinct(), {v: right.vars[v] for v in shared})
        return left._probed(right, shared, False, overlap=True)

    def _probe(self, other: Solutions, want: bool, on: Callable[[Solutions, Solutions], Column] | None) -> Solutions:
        left, right, shared, clash = self._aligned(other)
        if clash:
            return left.filter(F.lit(not want))
        return left._probed(right, shared, want, on)

    def exists(self, other: Solutions, on: Callable[[Solutions, Solutions], Column] | None = None) -> Solutions:
        return self._probe(other, True, on)

    def not_exists(self, other: Solutions, on: Callable[[Solutions, Solutions], Column] | None = None) -> Solutions:
        return self._probe(other, False, on)

    def exists_flag(self, name: str, other: Solutions) -> Solutions:
        """EXISTS as a variable, for use inside other expressions; shared variables must be bound."""
        left, right, shared, clash = self._aligned(other)
        if any(left.vars[v].unbound or right.vars[v].unbound for v in shared):
            raise ValueError("shared variables must be bound")
        if clash:
            return left.bind(name, F.lit(False), unbound=False)
        keys = right.df.select(*shared).distinct().withColumn(name, F.lit(True))
        df = left.df.join(keys, shared, "left").withColumn(name, F.coalesce(name, F.lit(False)))
        return left._new(df, left.vars | {name: Var()})

    # -- sets

    def union(self, other: Solutions) -> Solutions:
        """Bag union; variables of one side only are unbound in the other's rows."""
        mixed = [v for v, x in self.vars.items() if v in other.vars and x.prefix != other.vars[v].prefix]
        left, right = self._beside(other)._whole(*mixed), other._whole(*mixed)
        names = [*left.vars, *(v for v in right.vars if v not in left.vars)]
        vars_ = {}
        for v in names:
            a, b = left.vars.get(v), right.vars.get(v)
            prefix = (a or b).prefix if not (a and b) or a.prefix == b.prefix else ""
            vars_[v] = Var(prefix, a is None or b is None or a.unbound or b.unbound)
        types = [dict(left.df.dtypes), dict(right.df.dtypes)]
        clash = [v for v in names if v in types[0] and v in types[1] and "string" in (types[0][v], types[1][v]) and types[0][v] != types[1][v]]
        dfs = [s.df.withColumns({v: F.col(v).cast("string") for v in clash}) for s in (left, right)]
        return left._new(dfs[0].unionByName(dfs[1], allowMissingColumns=True), vars_)

    # -- legs of other sources

    def keys_of(self, *names: str) -> DataFrame:
        """The distinct bound values of some variables, IRIs as text: what a leg elsewhere is asked for."""
        return self.frame(*names).dropna().distinct()

    def leg(self, found: DataFrame, iris: Sequence[str] = ()) -> Solutions:
        """Join with the rows that another source returned for ``keys_of``: columns are
        variables, those of ``iris`` hold IRIs, and nulls are unbound."""
        return self.join(self._new(found, {n: Var("" if n in iris else None, unbound=True) for n in found.columns}))

    # -- groups and forms

    def group(self, keys: Sequence[str], aggregates: Mapping[str, Column], having: Column | None = None, empty_row: bool = False) -> Solutions:
        """Group by all keys; without keys there is one row. ``having`` names results.

        With ``empty_row`` no groups at all give one row of nulls.
        """
        grouped = self.df.groupBy(*keys).agg(*(c.alias(n) for n, c in aggregates.items()))
        df = grouped if having is None else grouped.where(having)
        if empty_row and keys:
            one = self.df.sparkSession.range(1).withColumn("_there", F.lit(True))
            df = one.join(df, F.col("_there"), "left").select(*keys, *aggregates)
        return self._new(df, {k: self.vars[k] for k in keys} | {n: Var(unbound=True) for n in aggregates})

    def sample(self, keys: Sequence[str], name: str) -> Solutions:
        return self.group(keys, {name: sample(self[name])})

    def ask(self) -> DataFrame:
        """One row, one boolean."""
        return self.df.limit(1).agg((F.count("*") > 0).alias("answer"))

    def construct(self, *template: tuple[str | Column, str, str | Column]) -> DataFrame:
        """The set of triples ``subject, predicate, object`` of the template.

        Strings that start with ``?`` are variables; triples with an unbound
        part are left out.
        """
        term = lambda x: (self[x[1:]] if x.startswith("?") else F.lit(x)) if isinstance(x, str) else x
        triples = [F.struct(*(term(x).cast("string").alias(n) for x, n in zip(t, ("subject", "predicate", "object")))) for t in template]
        return self.df.select(F.explode(F.array(*triples)).alias("t")).select("t.*").dropna().distinct()
