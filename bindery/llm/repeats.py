"""Blocks of documents, and the sorted rows that blocks exchange with groups.

Documents are packed into blocks of about 2 MB where they lie, without a
shuffle; a longer text is cut into parts that overlap, each a block of its own.
A block sends each of its distinct rows once, sorted and front-coded, in one
parcel for each group that it meets; a group answers every parcel row by row.
So what every document holds costs one row a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, written

BLOCK_BYTES = 2 << 20
#: A group answers for about so many bytes of text.
GROUP_BYTES = 6 << 20
#: Groups are no more than this (every task knows a bound of each, 8 MB in all); beyond it, that is from 6 TB on, they grow.
MOST_GROUPS = 1 << 20
#: A task of a shuffle takes about so many bytes of text.
TASK_BYTES = 24 << 20
#: Stands for the id of a document without one: it is in no order with others.
NO_ID = np.int64(2**63 - 1)
#: Bytes of text for which one group of names answers.
NAMES_BYTES = 12 << 20
U64 = np.uint64
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], U64)
BLOCKS = "block long, ids array<long>, ends array<long>, text binary, whole long, part int, head int, tail int, before long"

#: From a long text: where a part with its overlap starts, where its own bytes start and end, where the overlap ends, and the symbols before.
Cut = Callable[[bytes, int], Iterator[tuple[int, int, int, int, int]]]


def _pack(batches: Iterator[pa.RecordBatch], cut: Cut, most: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number, schema = TaskContext.get().partitionId() << 32, arrow_schema(BLOCKS)
    ids, texts, size = [], [], 0

    def packed(ids: list, texts: list[bytes], whole: int = 0, part: int = 0, head: int = 0, tail: int = 0, before: int = 0) -> pa.RecordBatch:
        ends = np.cumsum([len(t) for t in texts]).astype(np.int64).tolist()
        row = [number, ids, ends, zstandard.compress(b"".join(texts), 6), whole, part, head, tail, before]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), binary_column(batch, 1)):
            if text and len(text) > most:
                whole = number + 1
                for part, (start, own, end, stop, before) in enumerate(cut(text, most)):
                    yield packed([i], [text[start:stop]], whole, part, own - start, stop - end, before)
                    number += 1
                continue
            ids.append(i)
            texts.append(text or b"")
            size += len(texts[-1])
            if size >= most or len(ids) >= 20_000:
                yield packed(ids, texts)
                ids, texts, size, number = [], [], 0, number + 1
    if ids:
        yield packed(ids, texts)


def blocks_of(docs: DataFrame, id_col: str, text_col: str, cut: Cut) -> DataFrame:
    """The documents as rows of ``BLOCKS``, written."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    most = BLOCK_BYTES
    return written(rows.mapInArrow(lambda batches: _pack(batches, cut, most), BLOCKS), "blocks")


class Block:
    """One block: its texts, their ids, and where each starts and ends."""

    def __init__(self, row: dict):
        self.row = row
        self.number: int = row["block"]
        self.ids: list = row["ids"]
        self.id = np.array([NO_ID if i is None else i for i in self.ids], np.int64)
        self.text: bytes = zstandard.decompress(row["text"])
        self.ends = np.asarray(row["ends"], np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.whole, self.part, self.head, self.tail, self.before = (row[k] for k in ("whole", "part", "head", "tail", "before"))


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(f.split()[0], _ARROW[f.split()[1]]) for f in ddl.split(", ")])


# rows and numbers as bytes


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), 1)


def unsqueeze(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def big_endian(rows: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as columns of 64-bit numbers of the same order."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return list(wide.view(">u8").astype(np.uint64).T)


def sort_columns(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of rows given by columns, and where in it a new row begins."""
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    return order, new


def sort_bytes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of rows of bytes, and where in it a new row begins.

    Rows are compared as strings, by a sort that gains from runs in order, as
    the rows of several parcels are; a last byte keeps trailing zeros.
    """
    wide = np.ones((len(rows), rows.shape[1] + 1), np.uint8)
    wide[:, :-1] = rows
    text = wide.view(f"S{wide.shape[1]}").ravel()
    order = np.argsort(text, kind="stable")
    text = text[order]
    new = np.ones(len(order), bool)
    new[1:] = text[1:] != text[:-1]
    return order, new


def sort_mixed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``sort_bytes``, for rows without runs in order: faster, and equal rows come in any order."""
    return sort_numbers(big_endian(rows))


def sort_numbers(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """As ``sort_columns``, for unsigned 64-bit numbers without runs in order: faster, and equal rows come in any order."""
    order = np.argsort(columns[0])
    new = np.ones(len(order), bool)
    at, column, bits = np.arange(len(order)), columns[0][order], 0
    while True:
        fresh = np.ones(len(at), bool)
        fresh[1:] = column[1:] != column[:-1]
        new[at] = fresh
        # only rows that are equal so far need more
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        at, bits = at[tied], bits + (32 if bits else 64)
        if not len(at) or bits >= 64 * len(columns):
            return order, new
        part = order[at]
        column = columns[bits // 64][part] >> U64(32) if bits % 64 == 0 else columns[bits // 64][part] & U64(0xFFFFFFFF)
        column |= np.cumsum(new[at]).astype(U64) << U64(32)
        by = np.argsort(column)
        order[at], column = part[by], column[by]


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """How many leading elements each row shares with the one before (none for the first)."""
    out = np.zeros(len(rows), np.int32)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def shared_bytes(columns: list[np.ndarray]) -> np.ndarray:
    """As ``common_prefixes`` of the bytes of big-endian numbers; equal rows share all."""
    n = len(columns[0])
    out = np.zeros(n, np.uint8)
    same = np.ones(max(0, n - 1), bool)
    for c in columns:
        differ = c[1:] ^ c[:-1]
        for i in range(8):
            out[1:] += (differ < U64(1 << 8 * i)) & same
        same &= differ == 0
    return out


def front_code(rows: np.ndarray, starts: list[int], shared: np.ndarray | None = None) -> list[bytes]:
    """Runs of sorted rows, each as lengths of common prefixes and the rest of each row."""
    shared = (common_prefixes(rows) if shared is None else shared).astype(np.uint8)
    shared[starts] = 0
    width = rows.shape[1]
    rest = rows[np.arange(width, dtype=np.uint8) >= shared[:, None]]
    before = np.concatenate([[0], np.cumsum(width - shared.astype(np.int64))])
    return [zstandard.compress(shared[a:b].tobytes() + rest[before[a] : before[b]].tobytes(), 3) for a, b in zip(starts, [*starts[1:], len(rows)])]


def front_join(shared: list[np.ndarray], rest: list[np.ndarray], width: int) -> np.ndarray:
    """The rows of several parcels, one after another."""
    shared, rest = np.concatenate(shared), np.concatenate(rest)
    # element c of a row stands in the rest of the last row that shares no more than c
    base = np.cumsum(width - shared.astype(np.int64)) - width
    rows = np.empty((len(shared), width), rest.dtype)
    source = np.empty_like(base)
    for c in range(width):
        np.maximum.accumulate(np.where(shared <= c, base, 0), out=source)
        source += c
        rows[:, c] = rest[source]
    return rows


def front_decode(parcels: list[bytes], counts: list[int], width: int) -> np.ndarray:
    parts = [np.frombuffer(zstandard.decompress(p), np.uint8) for p in parcels]
    return front_join([p[:n] for p, n in zip(parts, counts)], [p[n:] for p, n in zip(parts, counts)], width)


# the exchange


PARCELS = "grp int, block long, n int, rows binary, marks binary"
ANSWERS = "block long, grp int, phase int, answer binary"


def parcels(block: int, groups: np.ndarray, rows: np.ndarray, marks: Callable[[slice], bytes], code: Callable[[np.ndarray], bytes] | None = None, shared: np.ndarray | None = None) -> pa.RecordBatch:
    """One parcel for each group met; ``rows`` are sorted by group, and within it.

    Rows are front-coded if no other code is given; ``shared`` may tell their common prefixes.
    """
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(groups)) + 1, [len(groups)]]) if len(groups) else np.zeros(1, np.int64)
    spans = [slice(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    coded = [code(rows[s]) for s in spans] if code else front_code(rows, [s.start for s in spans], shared)
    columns = [[int(groups[s.start]) for s in spans], [block] * len(spans), [s.stop - s.start for s in spans], coded, [marks(s) for s in spans]]
    schema = arrow_schema(PARCELS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def answered(sent: DataFrame, tasks: int, phase: int, answer: Callable[[pa.Table], list[bytes]], name: str) -> DataFrame:
    """``answer(the parcels of a group)``, one for each parcel, written."""
    schema = arrow_schema(ANSWERS)

    def run(table: pa.Table) -> pa.Table:
        columns = [table["block"], table["grp"], pa.array([phase] * len(table), pa.int32()), pa.array(answer(table), pa.binary())]
        return pa.table(columns, schema=schema)

    return written(sent.repartition(tasks, "grp").groupBy("grp").applyInArrow(run, ANSWERS), name)


def split(values: np.ndarray, counts: list[int]) -> list[np.ndarray]:
    return np.split(values, np.cumsum(counts)[:-1])


def answers_of(table: pa.Table, phase: int) -> list[bytes]:
    """The answers of one phase to a block, in the order of groups, in which its rows were sent."""
    part = table.filter(pa.array(table["phase"].to_numpy() == phase)).sort_by("grp")
    return part["answer"].to_pylist()


def bits_of(data: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.decompress(data), np.uint8), count=count).astype(bool)


# names: numbers made from strings, to ask which of them other blocks hold


def mix(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit name for each row of equally long arrays of names."""
    out = parts[0] * MULTIPLIERS[0]
    for p in parts[1:]:
        out ^= out >> U64(29)
        out += p
        out *= MULTIPLIERS[1]
    out ^= out >> U64(32)
    out *= MULTIPLIERS[2]
    out ^= out >> U64(29)
    return out


class NameSpace:
    """How names are cut and grouped for a corpus of ``total`` bytes.

    One name in 2**16 or fewer agrees with another by chance.
    """

    def __init__(self, total: int):
        self.bits = min(64, 26 + total.bit_length())
        self.groups = min(MOST_GROUPS, max(1, -(-total // NAMES_BYTES)))

    def group(self, names: np.ndarray) -> np.ndarray:
        return ((names >> U64(self.bits - 24)) * U64(self.groups) >> U64(24)).astype(np.int64)

    def parcels(self, block: int, names: np.ndarray) -> pa.RecordBatch:
        """Distinct names in order, of ``bits`` bits."""
        return parcels(block, self.group(names), names, lambda s: b"", lambda r: squeeze(np.diff(r, prepend=U64(0))))

    def told(self, answers: pa.Table, phase: int, names: np.ndarray) -> np.ndarray:
        """For the names sent: whether another block holds them."""
        if not len(names):
            return np.zeros(0, bool)
        sizes = np.diff(np.concatenate([[0], np.flatnonzero(np.diff(self.group(names))) + 1, [len(names)]]))
        return np.concatenate([bits_of(a, int(n)) for a, n in zip(answers_of(answers, phase), sizes)])


def held_elsewhere(table: pa.Table) -> list[bytes]:
    names = np.concatenate([np.cumsum(unsqueeze(d, U64), dtype=U64) for d in table["rows"].to_pylist()])
    order = np.argsort(names, kind="stable")
    same = names[order][1:] == names[order][:-1]
    told = np.zeros(len(names), bool)
    told[order[1:]] |= same
    told[order[:-1]] |= same
    return [zstandard.compress(np.packbits(b).tobytes()) for b in split(told, table["n"].to_pylist())]


def each_block(blocks: DataFrame, work: Callable[[Block], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield work(Block(batch.slice(i, 1).to_pylist()[0]))

    return blocks.mapInArrow(run, schema)


def with_answers(blocks: DataFrame, answers: DataFrame, tasks: int, work: Callable[[Block, pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``work(block, its answers)`` for every block."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = [work(Block(row), right) for row in left.to_pylist()]
        return pa.Table.from_batches(rows) if rows else arrow_schema(schema).empty_table()

    return blocks.repartition(tasks, "block").groupBy("block").cogroup(answers.repartition(tasks, "block").groupBy("block")).applyInArrow(both, schema)


def text_bytes(blocks: DataFrame) -> int:
    return blocks.agg(F.sum(F.element_at("ends", -1))).first()[0] or 0


def task_count(total: int) -> int:
    return max(4, -(-total // TASK_BYTES))


def least_ids(ids: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each run of a sorted order its least id."""
    return np.minimum.reduceat(ids, np.flatnonzero(new)) if len(ids) else ids


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie within ``size`` from one of the (distinct) starts."""
    edge = np.zeros(n + 1, np.int32)
    edge[starts] += 1
    edge[starts + size] -= 1
    return np.cumsum(edge[:-1]) > 0


def parts_joined(found: DataFrame, blocks: DataFrame, tasks: int, join: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """The rows of uncut texts as they are, and ``join(the parts of a text, in order)`` for the others."""
    if not blocks.where("whole != 0").limit(1).count():
        return found.drop("whole", "part")
    found = written(found, "parts")
    schema = found.drop("whole", "part").schema
    joined = found.where("whole != 0").repartition(tasks, "whole").groupBy("whole").applyInArrow(lambda t: join(t.sort_by("part")), schema)
    return found.where("whole = 0").drop("whole", "part").unionByName(joined)
