"""Approximate nearest neighbours by multi-index hashing.

Vectors are centred, rotated by a learnt rotation and cut to 64 signs. The code
is split into 4 substrings, each with an index of its own. By the pigeonhole
principle a code within Hamming distance R of a query's lies within R // 4 in
one of the substrings at least, so probing the buckets that near retrieves
every such code; their float vectors are then compared exactly.

Probing goes by two radii. The small one deals queries and codes out by
(substring, bucket), which serves vectors with close neighbours. A query whose
last neighbour found is so close that a nearer one would almost surely lie
within the radius is done. The others probe with the large radius, which a
sample has shown to hold the neighbours; its buckets are most of the index, so
the index stays in blocks and the queries come to it in blocks.

Equal vectors are searched once: each keeps its smallest ids, and no more of
them can be among the neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BITS, PARTS = 64, 4
#: Rows the rotation and the large radius are learnt from, at most.
FIT_ROWS = 4_096
#: Share of true neighbours that a radius shall hold.
HELD = 0.985
#: The small radius: each substring within one bit.
NEAR = 2 * PARTS - 1
#: Rows of the index in a block, and queries in a block. The index is copied once for each block of queries.
INDEX_ROWS, QUERY_ROWS = 8_192, 16_384
#: Queries of one vector are spread over so many keys when they get its answer.
SALT = 16


def learn_codes(sample: np.ndarray, rounds: int = 30, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Centre, and projection to 64 values whose signs are the code (iterative quantization)."""
    rng = np.random.default_rng(seed)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    centre = unit.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov((unit - centre).T).reshape(unit.shape[1], -1))
    axes = axes[:, ::-1][:, :BITS]
    blocks = []
    while sum(b.shape[1] for b in blocks) < BITS:
        low = (unit - centre) @ axes
        turn = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
            turn = (u @ w).T
        blocks.append(axes @ turn)
    return centre, np.concatenate(blocks, axis=1)[:, :BITS]


def codes(vectors: np.ndarray, centre: np.ndarray, projection: np.ndarray) -> np.ndarray:
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.packbits((unit - centre) @ projection > 0, axis=1, bitorder="little").view(np.int64).ravel()


def wide_radius(sample: np.ndarray, code: np.ndarray, k: int) -> int:
    """Hamming radius that holds the sample rows' own neighbours; those of all rows are nearer still."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    asked = slice(0, 512)
    cosine = unit[asked] @ unit.T
    np.fill_diagonal(cosine[:, : len(cosine)], -2)
    best = np.argsort(-cosine, axis=1)[:, :k]
    apart = np.bitwise_count(code[asked, None] ^ code[best]).astype(float)
    return max(NEAR, int(np.ceil(np.quantile(apart, HELD)))) if apart.size else NEAR


def close_enough(radius: int) -> float:
    """The cosine from which on a radius holds ``HELD`` of the codes, if bits differ independently."""
    low, high = 0.0, 0.5
    for _ in range(50):
        p = (low + high) / 2
        held = sum(math.comb(BITS, i) * p**i * (1 - p) ** (BITS - i) for i in range(radius + 1))
        low, high = (p, high) if held >= HELD else (low, p)
    return math.cos(math.pi * low)


def _coded(batches: Iterator[pa.RecordBatch], centre: np.ndarray, projection: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(batch.num_rows, -1)
        code = codes(vectors, centre, projection) if batch.num_rows else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.int64())], names=["rep", "vec", "ids", "code"])


def _packed(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Usable vectors as float64 bytes, so that equal ones are one key."""
    for batch in batches:
        ids, packed = [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.array([np.nan if y is None else y for y in v], np.float64) + 0.0  # -0 is 0
            if len(x) == dim and np.isfinite(x).all() and x.any():
                # a power of two changes no cosine and keeps squares from over- and underflow
                ids.append(i)
                packed.append(np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], names=["id", "vec"])


def _best(scores: np.ndarray, owners: list[list[int]], k: int) -> list[tuple[int, float]]:
    """The k best (score, then smaller id) of the ids behind the columns of a row of scores."""
    top = np.flatnonzero(scores >= np.partition(scores, -k)[-k]) if len(scores) > k else np.arange(len(scores))
    found = sorted((-float(scores[j]), i) for j in top for i in owners[j])[:k]
    return [(i, -s) for s, i in found]


def _search(queries: pa.Table, index: pa.Table, radius: int, k: int) -> pa.Table:
    """Probe one block of the index with one block of queries."""
    out: dict[str, list] = {"rep": [], "id": [], "score": []}
    if queries.num_rows and index.num_rows:
        floats = lambda t: np.frombuffer(b"".join(t["vec"].to_pylist()), np.float64).reshape(t.num_rows, -1)
        x, owners, code = floats(index), index["ids"].to_pylist(), index["code"].to_numpy()
        norm = np.sqrt((x * x).sum(axis=1))
        pieces = code.view(np.uint16).reshape(-1, PARTS)
        tables = [np.unique(pieces[:, p], return_inverse=True) for p in range(PARTS)]
        reps, asked, q = queries["rep"].to_pylist(), queries["code"].to_numpy(), floats(queries)
        parts = asked.view(np.uint16).reshape(-1, PARTS)
        for i, rep in enumerate(reps):
            probed = np.zeros(len(code), bool)
            for p, (buckets, bucket_of) in enumerate(tables):
                probed |= (np.bitwise_count(buckets ^ parts[i, p]) <= radius // PARTS)[bucket_of]
            at = np.flatnonzero(probed)
            at = at[np.bitwise_count(code[at] ^ asked[i]) <= radius]
            if len(at):
                cosine = (x[at] * q[i]).sum(axis=1) / (norm[at] * np.sqrt((q[i] * q[i]).sum()))
                for id_, s in _best(cosine, [owners[j] for j in at], k):
                    out["rep"].append(rep)
                    out["id"].append(id_)
                    out["score"].append(s)
    return pa.table(out, pa.schema([("rep", pa.int64()), ("id", pa.int64()), ("score", pa.float64())]))


def _top(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` for each vector asked for, first within parts of what was found for it."""
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "id"))
    parts = found.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int"))
    few = parts.withColumn("rank", best("rep", "salt")).where(F.col("rank") <= k).drop("salt", "rank")
    return few.withColumn("rank", best("rep")).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", exact: bool = False) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` vectors of largest cosine found for each query.

    ``queries`` holds ids of ``vectors`` (one column); a query's own id is no
    candidate. Null ids, and vectors that are null, zero, of another length
    than most, or that hold null or non-finite numbers take no part. Ties go to
    the smaller id; ids should be distinct (repeated ones are candidates each).
    With fewer candidates all found are returned; empty inputs give no rows.
    With ``exact`` the large radius is that of all codes and every query takes
    it, so nothing is missed.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    common = rows.groupBy(F.size("v").alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return empty
    dim = common["n"]
    packed = written(rows.mapInArrow(lambda b: _packed(b, dim), "id long, vec binary"), "mih-vectors")
    sample = packed.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).collect()
    if not sample:
        return empty
    fitted = np.unique(np.frombuffer(b"".join(bytes(r["vec"]) for r in sample), np.float64).reshape(len(sample), dim), axis=0)
    fitted = fitted[np.random.default_rng(1).permutation(len(fitted))]
    if len(fitted) > 1:
        centre, projection = learn_codes(fitted)
    else:
        centre, projection = np.zeros(dim), np.random.default_rng(1).normal(size=(dim, BITS))
    wide = BITS if exact else wide_radius(fitted, codes(fitted, centre, projection), k)

    # equal vectors: the smallest k + 1 ids, of which one may be the query's own
    order = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    kept = packed.withColumn("n", order).where(F.col("n") <= k + 1)
    distinct = kept.groupBy("vec").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids")).select("rep", "vec", "ids")
    index = written(distinct.mapInArrow(lambda b: _coded(b, centre, projection), "rep long, vec binary, ids array<long>, code long"), "mih-index")
    asked_ids = queries.select(F.col(queries.columns[0]).cast("long").alias("id")).distinct()
    # queries of one vector are spread over salted keys here too
    spread = index.select("vec", "rep", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    salted = packed.join(asked_ids, "id").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int"))
    asked = salted.join(spread, ["vec", "salt"]).select(F.col("id").alias("query_id"), "rep")
    asked = written(asked, "mih-queries")
    probes = written(index.join(asked.select("rep").distinct(), "rep", "left_semi"), "mih-probes")

    # small radius: queries and codes meet in the buckets of the substrings
    part = lambda i: F.shiftrightunsigned("code", 16 * i).bitwiseAND(F.lit(0xFFFF))
    one = [F.lit(0), *(F.lit(1 << b) for b in range(16))]
    tables = [F.struct(F.lit(i).alias("part"), part(i).alias("bucket")) for i in range(PARTS)]
    probed = [F.struct(F.lit(i).alias("part"), part(i).bitwiseXOR(flip.cast("long")).alias("bucket")) for i in range(PARTS) for flip in one]
    left = probes.select(F.col("rep").alias("q"), F.col("code").alias("q_code"), F.explode(F.array(*probed)).alias("b")).select("q", "q_code", "b.*")
    right = index.select("rep", "code", F.explode(F.array(*tables)).alias("b")).select("rep", "code", "b.*")
    met = left.join(right, ["part", "bucket"]).where(F.bit_count(F.col("q_code").bitwiseXOR(F.col("code"))) <= NEAR).select("q", "rep").distinct()
    near = _rerank(met, probes, index, k)
    enough = 2.0 if exact else close_enough(NEAR)
    done = near.groupBy("rep").agg(F.count("*").alias("n"), F.min("score").alias("last")).where((F.col("n") == k + 1) & (F.col("last") >= enough))
    near = written(near.join(done.select("rep"), "rep", "left_semi").select("rep", "id", "score"), "mih-near")

    # large radius: the rest probe the index block by block
    rest = written(probes.join(near.select("rep").distinct(), "rep", "left_anti"), "mih-rest")
    n_index, n_query = -(-index.count() // INDEX_ROWS) or 1, -(-rest.count() // QUERY_ROWS) or 1
    block = lambda n: F.pmod(F.xxhash64("rep"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks = index.select(block(n_index).alias("i"), every(n_query).alias("j"), "rep", "vec", "ids", "code")
    asking = rest.select(every(n_index).alias("i"), block(n_query).alias("j"), "rep", "vec", "ids", "code")
    far = asking.groupBy("i", "j").cogroup(blocks.groupBy("i", "j")).applyInArrow(
        lambda a, b: _search(a, b, wide, k + 1), "rep long, id long, score double"
    )
    # one list for each vector that is asked for; its queries, however many, get it by salted keys
    found = _top(near.unionAll(far), k + 1).groupBy("rep").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("id")))).alias("found"))
    salt = F.pmod(F.xxhash64("query_id"), F.lit(SALT)).cast("int")
    spread = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    hits = asked.withColumn("salt", salt).join(spread, ["rep", "salt"])
    others = F.slice(F.filter("found", lambda f: f["id"] != F.col("query_id")), 1, k)
    ranked = hits.select("query_id", F.posexplode(others).alias("at", "f"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("f.id").alias("vec_id"), (-F.col("f.s")).alias("score"))


def _cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.float64).reshape(batch.num_rows, -1) for i in (1, 2))
        score = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(score)], names=["rep", "ids", "score"])


def _rerank(met: DataFrame, probes: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """The best ids of the pairs ``q, rep``, by their float vectors."""
    pairs = met.join(probes.select(F.col("rep").alias("q"), F.col("vec").alias("q_vec")), "q").join(index.select("rep", "vec", "ids"), "rep")
    scored = pairs.select("q", "q_vec", "vec", "ids").mapInArrow(_cosine, "rep long, ids array<long>, score double")
    return _top(scored.select("rep", F.explode("ids").alias("id"), "score"), k + 1)
