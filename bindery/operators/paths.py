"""Property paths. A path is a relation: solutions over ``x`` and ``y``.

Transitive paths run to a fixpoint, semi-naively: each round extends only the
pairs found in the one before, and writes them, so lineage stays short. Without
a bound the reach doubles each round, so a chain of n steps takes log n rounds.
The driver sees one count a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .solutions import Solutions, Var
from .storage import written

Path = Solutions


def relation(edges: Solutions, subject: str, target: str) -> Path:
    """Two variables of some solutions as a path of one step."""
    df = edges.df.select(F.col(subject).alias("x"), F.col(target).alias("y"))
    return edges._new(df, {"x": edges.vars[subject], "y": edges.vars[target]})


def _renamed(path: Path, x: str, y: str) -> Solutions:
    df = path.df.select(F.col("x").alias(x), F.col("y").alias(y))
    return path._new(df, {x: path.vars["x"], y: path.vars["y"]})


def sequence(*paths: Path) -> Path:
    """``p/q``: a bag."""
    out = paths[0]
    for p in paths[1:]:
        met = _renamed(out, "x", "m").join(_renamed(p, "m", "y"))
        out = met._new(met.df, {"x": met.vars["x"], "y": met.vars["y"]})
    return out


def inverse(path: Path) -> Path:
    return _renamed(path, "y", "x").project("x", "y")


def alternative(*paths: Path, bag: bool = False) -> Path:
    """``p|q``: distinct pairs, or all with ``bag``."""
    out = paths[0]
    for p in paths[1:]:
        out = out.union(p)
    return out if bag else out.distinct()


def _zero(nodes: Solutions, var: str) -> Path:
    df = nodes.df.select(F.col(var).alias("x"), F.col(var).alias("y")).where("x IS NOT NULL").distinct()
    return nodes._new(df, {"x": nodes.vars[var], "y": nodes.vars[var]})


def zero_or_one(path: Path, nodes: Solutions, var: str) -> Path:
    """``p?`` over the given nodes."""
    return _zero(nodes, var).union(path).distinct()


def one_or_more(path: Path, max_depth: int | None = None, starts: DataFrame | None = None, ends: DataFrame | None = None) -> Path:
    """``p+``: distinct pairs; cycles end when no new pair is found.

    ``starts`` (or ``ends``) holds, in one column, the keys that ``x`` (or
    ``y``) may have; then only what they reach is read and written.
    """
    if ends is not None and starts is None:
        return inverse(one_or_more(inverse(path), max_depth, ends))
    if path.vars["x"].prefix != path.vars["y"].prefix:
        path = path._whole("x", "y")
    step = path.df.where("x IS NOT NULL AND y IS NOT NULL").distinct()
    step = written(step, "path-step")
    first = step if starts is None else written(step.join(starts.toDF("x").distinct(), "x", "left_semi"), "path-first")
    seen, frontier, depth = first, first, 1
    while max_depth is None or depth < max_depth:
        # all pairs, unbounded: pairs at distance up to n, met by all known ones, reach up to 2n
        more = (seen if max_depth is None and starts is None else step).withColumnRenamed("x", "m")
        longer = frontier.withColumnRenamed("y", "m").join(more, "m").select("x", "y").distinct()
        frontier = written(longer.join(seen, ["x", "y"], "left_anti"), "path-frontier")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)  # tables that stand; none is written again
        depth += 1
    if ends is not None:
        seen = seen.join(ends.toDF("y").distinct(), "y", "left_semi")
    return path._new(seen.select("x", "y"), path.vars)


def connects(path: Path, x: object, y: object, max_depth: int | None = None) -> Solutions:
    """Whether ``p+`` joins two constant keys: one empty solution, or none.

    Nodes are visited from ``x`` on, each once, until ``y`` is among them.
    """
    step = path.df.where("x IS NOT NULL AND y IS NOT NULL").select("x", "y")
    frontier = written(step.where(F.col("x") == F.lit(x)).select("y").distinct(), "path-reached")
    seen, depth = frontier, 1
    while frontier.limit(1).count() and not frontier.where(F.col("y") == F.lit(y)).limit(1).count() and (max_depth is None or depth < max_depth):
        further = step.join(frontier.withColumnRenamed("y", "x"), "x", "left_semi").select("y").distinct()
        frontier = written(further.join(seen, "y", "left_anti"), "path-reached")
        seen, depth = seen.unionByName(frontier), depth + 1
    return path._new(frontier.where(F.col("y") == F.lit(y)).select(F.lit(1).alias("_row")), {"_row": Var()})


def zero_or_more(path: Path, nodes: Solutions, var: str, max_depth: int | None = None) -> Path:
    """``p*`` over the given nodes."""
    return _zero(nodes, var).union(one_or_more(path, max_depth)).distinct()


def negated(triples: Solutions, *predicates: str, inverse_of: tuple[str, ...] | None = None) -> Path:
    """``!(p|q)`` over ``s, p, o``: any other predicate.

    With ``inverse_of`` also ``!(^r)``: the triples of other predicates than
    those, backwards; without ``predicates`` only these.
    """
    away = lambda names: triples.filter(~F.col("p").isin(*names))
    if inverse_of is None:
        return relation(away(predicates), "s", "o")
    back = relation(away(inverse_of), "o", "s")
    return relation(away(predicates), "s", "o").union(back) if predicates else back


def hits(path: Path, x: object, y: object) -> Solutions:
    """Whether a path joins two constant keys: one empty solution, or none."""
    df = path.df.where((F.col("x") == F.lit(x)) & (F.col("y") == F.lit(y))).limit(1).select(F.lit(1).alias("_row"))
    return path._new(df, {"_row": Var()})
