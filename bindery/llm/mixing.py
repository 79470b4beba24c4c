"""Mixing sources to target weights with hash thresholds.

Each document has a fixed 60-bit hash. A source whose target is a times its
size plus a rest takes every document a times, and those below a threshold of
the hash once more. The threshold is found by histograms of 4096 buckets: the
sizes are summed by source and bucket, the bucket where the running sum passes
the rest is the boundary, and only its documents are counted again by their
next 12 bits. Documents are never sorted, and a threshold for a smaller rest
takes a part of what a larger one takes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, free, written

#: Bits of the hash that one histogram resolves, and the number of histograms.
BITS, LEVELS = 12, 5


def source_targets(totals: DataFrame, weights: Sequence[float], budget: float, most: float) -> DataFrame:
    """Adds ``target`` to ``source, source_size``.

    Sources are ranked by code point, null last, and weighted in turn. The
    targets fill ``budget`` times the sum of all sizes in proportion to the
    weights, but stop at ``most`` times the source's size; what is above is
    shared again among the others until none is above.
    """
    # rank over range partitions, so that any number of sources will do
    ranged = written(
        totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources"
    )
    parts = ranged.groupBy("part").agg(F.count("*").alias("n"))  # as many rows as partitions
    offsets = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    ranked = ranged.withColumn("within", within).join(offsets, "part").withColumn("rank", F.col("offset") + F.col("within") - 1)
    weighted = written(ranked.select("source", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("cap")), "mix-weights")
    all_size = weighted.agg(F.sum("source_size")).first()[0] or 0
    level = float("inf") if not all_size else 0.0
    capped = None
    while all_size:
        full = F.col("cap") < level * F.col("weight")
        at_cap, rest, n = weighted.agg(
            F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.sum(full.cast("long"))
        ).first()
        if n == capped or not rest:
            break
        capped, level = n, (budget * all_size - at_cap) / rest
    return weighted.select("source", "source_size", F.least("cap", level * F.col("weight")).alias("target"))


def thresholds(sized: DataFrame, rests: DataFrame) -> DataFrame:
    """``source, below``: documents with ``hash < below`` sum up to ``rest`` as near as whole documents can."""
    found = written(rests.select("source", F.lit(0).cast("long").alias("start"), F.col("rest").cast("double")), "mix-level")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = sized.join(found.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        inside = inside.where((F.col("hash") >= F.col("start")) & (F.shiftright(F.col("hash") - F.col("start"), shift) < (1 << BITS)))
        bins = inside.groupBy("source", "start", "rest", F.shiftright(F.col("hash") - F.col("start"), shift).alias("bin")).agg(
            F.sum("size").alias("size"), F.min("hash").alias("low"), F.max("hash").alias("high")
        )
        running = F.sum("size").over(Window.partitionBy("source").orderBy("bin"))
        passed = bins.withColumn("sum", running).where(F.col("sum") > F.col("rest"))
        # the first bucket that passes the rest; its documents alone are looked at again
        first = passed.groupBy("source").agg(F.min_by(F.struct("start", "bin", "size", "sum", "rest", "low", "high"), "bin").alias("b"))
        found_now = first.select(
            "source",
            (F.col("b.start") + F.shiftleft(F.col("b.bin"), shift)).alias("start"),
            (F.col("b.rest") - (F.col("b.sum") - F.col("b.size"))).alias("rest"),
            (F.col("b.low") == F.col("b.high")).alias("single"),
            F.col("b.size").alias("size"),
        )
        found = written(found_now, "mix-level")
        if not found.where(~F.col("single")).limit(1).count():
            break
        found = found.drop("single", "size") if level < LEVELS - 1 else found
    # documents of one hash go together, to the nearer side
    nearer = 2 * F.col("rest") > F.col("size")
    return found.select("source", F.when(nearer, F.col("start") + F.lit(1 << shift)).otherwise(F.col("start")).alias("below"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    budget: float = 1.5,
    most: int = 2,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` for every row.

    The size is the number of words (null text: none). ``copies`` says how
    often the mix takes the document; no document is taken more than ``most``
    times (a whole number). The hash depends on the id and the text's size
    alone, so runs agree; rows alike in both are taken alike. Rows with null ids,
    sources or texts take part (the null source ranks last); empty texts add
    nothing. An empty table gives an empty result. With ``keep`` the result
    has these columns of the input and ``copies`` instead.
    """
    id_, src, size, hash_, s_, times_, below_ = (free(n, docs) for n in ("id", "source", "size", "hash", "s", "times", "below"))
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(id_).cast("string"), size).cast("binary")), 1, BITS * LEVELS // 4), 16, 10).cast("long")
    own = [F.col(f"`{id_col}`").alias(id_), F.col(f"`{source_col}`").cast("string").alias(src), count_words(F.col(f"`{text_col}`")).alias(size)]
    measured = docs.select(*own).withColumn(hash_, hashed)
    sized = written(measured.select(F.col(id_).alias("doc_id"), F.col(src).alias("source"), F.col(size).alias("size"), F.col(hash_).alias("hash")), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, budget, most)
    times = F.coalesce(F.least(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(most)), F.lit(0)).cast("int")
    plan = targets.withColumn("times", times).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size"))
    plan = written(plan, "mix-targets")
    cut = thresholds(sized, plan.where((F.col("times") < most) & (F.col("source_size") > 0)).select("source", "rest"))
    plan = plan.join(cut.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = plan.select(F.col("source").alias(s_), "source_size", "target", F.col("times").alias(times_), F.col("below").alias(below_))
    plan = written(plan, "mix-plan")
    copies = (F.col(times_) + F.coalesce((F.col(hash_) < F.col(below_)).cast("int"), F.lit(0))).alias("copies")
    if keep:
        kept = [F.col(f"`{c}`") for c in keep if c != "copies"]
        rows = docs.select(*kept, *own).withColumn(hash_, hashed).select(*kept, src, hash_)
        return rows.join(plan.select(s_, times_, below_), F.col(src).eqNullSafe(F.col(s_))).select(*kept, copies)
    rows = sized.withColumnRenamed("hash", hash_)
    return rows.join(plan, F.col("source").eqNullSafe(F.col(s_))).select("doc_id", "source", "size", "source_size", "target", copies)
