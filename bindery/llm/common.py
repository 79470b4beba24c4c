"""Helpers shared by the text operators."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these (space, \t \n \v \f \r).
#: ``bytes.split()`` without arguments splits UTF-8 text at exactly this set.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session may go without: then a temporary one is made.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: With this setting Spark deletes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Tables written on the way to the one that ``settled`` makes.
_on_the_way: ContextVar[list[str] | None] = ContextVar("on_the_way", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    This cuts lineage and survives lost executors. The size of a written table
    is known to the planner, which broadcasts it only when it is small. The
    tables of one application lie in one folder, named by its id, that can go
    when the application has ended; shuffle files go as soon as the table stands.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    if (passing := _on_the_way.get()) is not None:
        passing.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``written(make(), name)``; what ``make`` has written on its way is deleted when that table stands.

    Nothing else may read those tables; a read that comes too late fails.
    """
    token = _on_the_way.set(passing := [])
    try:
        df = make()
    finally:
        _on_the_way.reset(token)
    table, context = written(df, name), df.sparkSession.sparkContext
    for path in map(context._jvm.org.apache.hadoop.fs.Path, passing):
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    return table


#: Bits that ``parted`` broadcasts at most (8 MB).
MOST_BITS = 1 << 26


def parted(rows: DataFrame, keys: DataFrame, number: str, most: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``number`` is surely not among those of ``keys``, a written table, and the other rows.

    Each number of ``keys`` sets one of ``most`` bits or fewer, which every task
    knows, so no row moves. Of the other rows some may have no partner, and all
    may come there when the bits are full: an exact join is to follow.
    """
    bits, count, wide = 1 << 15, keys.count(), (1 << 15) - 1  # the bits come in rows of 2**15
    while bits < min(most, 16 * count):
        bits *= 2
    at, bucket, marks = F.pmod(number, F.lit(bits)), free("bucket", rows), free("marks", rows)
    filled = keys.select(F.shiftright(at, 15).alias(bucket), at.bitwiseAND(F.lit(wide)).alias("at")).groupBy(bucket).agg(F.bitmap_construct_agg("at").alias(marks))
    byte = F.substring(marks, F.shiftright(at.bitwiseAND(F.lit(wide)), 3).cast("int") + 1, F.lit(1))
    bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("long"), at.bitwiseAND(F.lit(7)).cast("int"))
    marked = rows.withColumn(bucket, F.shiftright(at, 15)).join(F.broadcast(filled), bucket, "left").withColumn(bucket, F.coalesce(bit, F.lit(0)))
    return marked.where(F.col(bucket) == 0).select(rows.columns), marked.where(F.col(bucket) == 1).select(rows.columns)


def without(rows: DataFrame, gone: DataFrame, key: list[str], number: str) -> DataFrame:
    """The rows whose ``key`` is not in ``gone``, a written table; ``number`` is a long of the key, such as a hash.

    Most of them do not move.
    """
    stay, others = parted(rows, gone, number)
    return stay.unionByName(others.join(gone, key, "left_anti").select(rows.columns))


def free(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores before it until no column of the frames is called so (in any case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def worker_state(name: str) -> dict:
    """A dictionary that lasts as long as this Python worker, for reuse between tasks.

    It may hold only what can be made anew at any time. A worker keeps that of
    one operator; when another asks, it goes.
    """
    # functions come pickled with each task, so what lasts lies in a module of its own
    state = sys.modules.setdefault("_bindery_worker", types.ModuleType("_bindery_worker")).__dict__.setdefault("state", {})
    if name not in state:
        state.clear()
    return state.setdefault(name, {})


def binary_column(batch: pa.RecordBatch, i: int) -> list[bytes | None]:
    """Column ``i`` of a batch as UTF-8 byte strings."""
    col = batch.column(i)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    return col.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], column: int, max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Split batches so that each holds about ``max_bytes`` of one column at most.

    A single longer value comes alone.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            if total + n > max_bytes and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def count_words(text: Column) -> Column:
    """Number of words as a long; null text has none."""
    parts = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.coalesce(F.size(parts), F.lit(0)).cast("long")


def hex64(value: Column) -> Column:
    """A long as 16 lower-case hex digits (two's complement)."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))
