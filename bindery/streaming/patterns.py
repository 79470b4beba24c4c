"""Monotone patterns over a stream: stars, filters, joins with tables that stand still.

A streaming DataFrame is a table of a catalog like any other; what needs all
rows at once (MINUS, NOT EXISTS, ORDER BY) Spark itself refuses on streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.solutions import Solutions


def windowed_counts(found: Solutions, at: str, keys: list[str], size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Solutions per window and keys; rows later than ``late`` are dropped, windows come out once."""
    df = found.frame().withWatermark(at, late)
    return df.groupBy(F.window(at, size).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def watch(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append results to Parquet files, each exactly once, until the input is read up."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
