"""Near-duplicate documents by SimHash, linked through a grid of bit counts.

A 64-bit fingerprint is cut into 16 segments of 4 bits, and the bit counts of
the segments are a point of a 16-dimensional grid. Flipping one bit moves one
coordinate by one, so the Manhattan distance of two points never exceeds the
Hamming distance of their fingerprints: a range join over the grid finds every
pair that can link. For distance 2 both sides go to their own cell and its
direct neighbours (33 cells): two points at distance 2 or less always share one
of them, and only in cells with company anything more is done.

There links are verified exactly without comparing all pairs of a cell: each
fingerprint goes to itself and to its one-bit changes that lie in the cell. Two
fingerprints differ in at most two bits exactly when they meet at one of these
points, and all that meet hang from the smallest. So a fingerprint costs at
most 33 and 65 rows, however crowded its cells are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_column, pieces, written
from .components import connected

def fingerprint(words: list[bytes], shingle: int) -> int:
    """SimHash of the XXH64 (seed 42) of all word shingles, as a signed 64-bit integer."""
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return majority(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64))


def majority(hashes: np.ndarray) -> int:
    """SimHash of hashes, as a signed 64-bit integer: the bits set in over half of them."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        part = hashes[i : i + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1):
        values = [fingerprint((t or b"").lower().split(), shingle) for t in binary_column(batch, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` of every row; null and empty texts have fingerprint 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _fingerprints(batches, shingle), "doc_id long, fp long")


def _cell(fp: Column) -> Column:
    """Bit counts of the 16 segments, one in each hex digit of a long."""
    ones = [F.shiftrightunsigned(fp, i).bitwiseAND(F.lit(0x1111111111111111)) for i in range(4)]
    return ones[0] + ones[1] + ones[2] + ones[3]


def links(fps: DataFrame) -> DataFrame:
    """Edges ``a > b`` between distinct fingerprints ``fp`` that connect exactly
    those within two bits of each other (directly or by others of them)."""
    steps = []
    for i in range(16):
        digit = F.shiftrightunsigned("cell", 4 * i).bitwiseAND(F.lit(15))
        one = F.lit(1 << (4 * i))
        steps += [F.when(digit < 4, F.col("cell") + one), F.when(digit > 0, F.col("cell") - one)]
    placed = fps.select("fp", _cell(F.col("fp")).alias("cell")).select(F.explode(F.array(F.col("cell"), *steps)).alias("cell")).where("cell IS NOT NULL")
    company = written(placed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell"), "simhash-cells")
    points = [F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long")) for i in range(64))]
    met = fps.select("fp", F.explode(F.array(*points)).alias("point")).withColumn("cell", _cell(F.col("point"))).join(company, "cell", "left_semi").select("fp", "point")
    met = written(met, "simhash-points")
    least = met.groupBy("point").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top").select("point", "b")
    near = met.join(least, "point").where(F.col("fp") > F.col("b"))
    return near.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= 2).select(F.col("fp").alias("a"), "b").distinct()


def meetings(rows: DataFrame) -> DataFrame:
    """Pairs ``a > b`` of ids whose fingerprints meet, of rows ``id, fp`` with distinct ids.

    Two fingerprints within 5 bits differ in at most 2 bits of one of their
    halves. Each goes to its two halves and their one-bit changes (66 points),
    so those two meet; of all that meet at a point each is paired with the
    smallest id, so a crowd makes no pairs among itself. The other half is free:
    a wider pair that meets is returned too, and it is up to an exact check
    which pairs count.
    """
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 32))
    points = [x for half in (low, high) for x in (half, *(half.bitwiseXOR(F.lit(1 << i).cast("long")) for i in range(32)))]
    met = written(rows.select("id", F.explode(F.array(*points)).alias("point")), "simhash-halves")
    least = met.groupBy("point").agg(F.min("id").alias("b"), F.max("id").alias("top")).where("b < top").select("point", "b")
    return met.join(least, "point").where("id > b").select(F.col("id").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` for every row.

    Rows whose fingerprints differ in at most 2 bits are linked; the component
    is the smallest id that links lead to, the row's own included. Null and
    empty texts share fingerprint 0 and are linked like others; rows with
    repeated ids keep one row each; a null id never names a component (one of
    null ids only has none). An empty table gives no rows. A text is one row's
    work, however long. Other columns are not read.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    groups = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-groups")
    edges = written(links(groups.select("fp")), "simhash-links")
    roots = connected(edges)
    named = groups.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    found = written(named.join(smallest, "root").select("fp", "component_id"), "simhash-components")
    return rows.join(found, "fp").select("doc_id", "fp", "component_id")

