"""Repeated strings by a distributed difference-cover algorithm.

Suffixes are compared over their first 50 bytes. A difference cover of 21
samples 5 of 21 places, so that two equal strings, wherever they start, are
both sampled at one common offset below 21.

1. The triples at the sampled places (three characters of 7 bytes) are sorted
   over all blocks, by ranges of their bytes. Triples that occur twice or more
   get their rank as a name; the others decide every suffix that needs them.
2. Recursion: the names at a place, 21 and 42 bytes on form triples again. They
   decide 63 bytes, so one level is enough for 50. Sorted, adjacent equal ones
   tell which strings of 63 bytes start in an earlier document, and with them
   the 14 suffixes that start there or up to 13 bytes on.
3. The suffixes that remain are merged: within one name, those with the sampled
   place at offset d are ordered by the rank of the d characters before it and
   the rank of what follows up to 50 bytes; adjacent equal ones are one string.

All names are exact; no string stands for another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame

from .common import written
from .repeats import (
    BLOCKS,
    GROUP_BYTES,
    MOST_GROUPS,
    NO_ID,
    PARCELS,
    Block,
    answered,
    answers_of,
    arrow_schema,
    big_endian,
    blocks_of,
    common_prefixes,
    covered,
    each_block,
    front_decode,
    least_ids,
    parcels,
    parts_joined,
    shared_bytes,
    sort_bytes,
    sort_columns,
    sort_numbers,
    split,
    squeeze,
    task_count,
    text_bytes,
    unsqueeze,
    with_answers,
)

LENGTH = 50
#: A difference cover: every difference modulo PERIOD is one of two of its members.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
TRIPLE = 21
#: Where in a triple the 64-bit numbers start that it is sorted by.
NUMBERS = (0, 8, TRIPLE - 8)
#: Characters before and after a name that the suffixes around it may need.
LEFT, RIGHT = PERIOD - 1, LENGTH - TRIPLE
#: Bytes of a sent name of a triple of names, and of a name with its surroundings.
NAMES, AROUND = 20, 4 + LEFT + RIGHT + 2
#: So many sampled keys for each group help to place the bounds, but no more than the driver should hold.
SAMPLES, MOST_SAMPLES = 64, 1 << 23
U64 = np.uint64


def _cut(text: bytes, most: int) -> Iterator[tuple[int, int, int, int, int]]:
    for start in range(0, len(text), most):
        end = min(len(text), start + most)
        yield max(0, start - LENGTH + 1), start, end, min(len(text), end + LEFT + LENGTH), 0


class _Text:
    """The bytes of a block and what is asked of them."""

    def __init__(self, block: Block):
        self.block = block
        self.text = np.frombuffer(block.text, np.uint8)
        self.n = len(self.text)
        sizes = block.ends - block.starts
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)

    def end(self, at: np.ndarray) -> np.ndarray:
        return self.block.ends[self.doc[at]]

    def ids(self, at: np.ndarray) -> np.ndarray:
        return self.block.id[self.doc[at]]

    def sampled(self) -> np.ndarray:
        """Sampled places whose triple lies in one document that has an id."""
        at = (np.arange(0, self.n, PERIOD)[:, None] + np.array(COVER)).ravel()
        at = at[at + TRIPLE <= self.n]
        return at[(at + TRIPLE <= self.end(at)) & (self.ids(at) != NO_ID)]

    def triples(self, at: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.empty((0, TRIPLE), np.uint8)
        return np.ndarray((self.n - TRIPLE + 1,), f"V{TRIPLE}", self.text, strides=(1,))[at].view(np.uint8).reshape(-1, TRIPLE)

    def numbers(self, at: np.ndarray) -> list[np.ndarray]:
        """The triples as 64-bit numbers of the same order; the last holds bytes of the one before again."""
        if not len(at):
            return [np.empty(0, U64)] * len(NUMBERS)
        words = np.ndarray((self.n - 7,), ">u8", self.text, strides=(1,))
        return [words.take(at + i).astype(U64) for i in NUMBERS]

    def named(self) -> tuple[np.ndarray, np.ndarray]:
        """Places with a repeated triple, and its name: group and rank."""
        return np.cumsum(unsqueeze(self.block.row["places"], np.uint32), dtype=np.int64), unsqueeze(self.block.row["names"], U64)

    def suffixes(self) -> np.ndarray:
        """Whether a string of 50 bytes within one document starts at each place."""
        out = np.ones(self.n, bool)
        short = self.block.ends[:, None] - np.arange(1, LENGTH)
        out[short[short >= self.block.starts[:, None]]] = False
        return out


# 1. triples


def _send_triples(block: Block, bounds: np.ndarray) -> pa.RecordBatch:
    text = _Text(block)
    at = text.sampled()
    numbers = text.numbers(at)
    order, new = sort_numbers(numbers)
    first = np.flatnonzero(new)
    twice, order = np.diff(np.append(first, len(order))) > 1, order[first]
    numbers = [c[order] for c in numbers]
    shared = shared_bytes(numbers)
    shared[shared >= 16] -= 16 - NUMBERS[2]  # bytes that two numbers hold count once
    groups = np.searchsorted(bounds, numbers[0], side="right")
    return parcels(block.number, groups, text.triples(at[order]), lambda s: np.packbits(twice[s]).tobytes(), shared=shared)


def _rank_triples(table: pa.Table) -> list[bytes]:
    counts = table["n"].to_pylist()
    rows = front_decode(table["rows"].to_pylist(), counts, TRIPLE)
    twice = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(table["marks"].to_pylist(), counts)])
    n = len(rows)
    order, new = sort_bytes(rows)
    del rows
    first = np.flatnonzero(new)
    repeated = (np.diff(np.append(first, len(order))) > 1) | np.maximum.reduceat(twice[order], first).astype(bool)
    rank = np.zeros(n, np.uint32)
    rank[order] = (np.cumsum(repeated) * repeated)[np.cumsum(new) - 1]
    return [_ranks_coded(r) for r in split(rank, counts)]


def _ranks_coded(rank: np.ndarray) -> bytes:
    """Ranks of sorted rows, 0 for none; the others ascend, so differences are small."""
    held = zstandard.compress(np.packbits(rank > 0).tobytes())
    return len(rank).to_bytes(4, "little") + len(held).to_bytes(4, "little") + held + squeeze(np.diff(rank[rank > 0], prepend=np.uint32(0)))


def _ranks_decoded(data: bytes) -> np.ndarray:
    n, size = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
    held = np.unpackbits(np.frombuffer(zstandard.decompress(data[8 : 8 + size]), np.uint8), count=n).astype(bool)
    rank = np.zeros(n, U64)
    rank[held] = np.cumsum(unsqueeze(data[8 + size :], np.uint32), dtype=U64)
    return rank


def _name_places(block: Block, answers: pa.Table) -> pa.RecordBatch:
    """The block with the places of repeated triples, and their names."""
    text = _Text(block)
    at = text.sampled()
    name = np.zeros(len(at), U64)
    if len(at):
        order, new = sort_numbers(text.numbers(at))
        told = answers.sort_by("grp")
        ranks = [(U64(g) << U64(32) | r) * (r > 0) for g, r in zip(told["grp"].to_pylist(), map(_ranks_decoded, told["answer"].to_pylist()))]
        name[order] = np.concatenate(ranks)[np.cumsum(new) - 1]
    held = name > 0
    row = block.row | {"places": squeeze(np.diff(at[held], prepend=0).astype(np.uint32)), "names": squeeze(name[held])}
    schema = arrow_schema(NAMED)
    return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)


NAMED = BLOCKS + ", places binary, names binary"


# 2. triples of names


def _names_of_names(text: _Text) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Places that have three names in a row, their groups, and the sort columns."""
    at, name = text.named()
    dense = np.zeros(text.n + 2 * PERIOD, U64)
    dense[at] = name
    second, third = dense[at + PERIOD], dense[at + 2 * PERIOD]
    held = (second > 0) & (third > 0) & (at + 2 * PERIOD + TRIPLE <= text.end(at)) if len(at) else np.zeros(0, bool)
    return at[held], name[held], [name[held], second[held], third[held]]


def _send_names(block: Block) -> pa.RecordBatch:
    text = _Text(block)
    at, name, columns = _names_of_names(text)
    order, new = sort_columns(columns)
    first, least = order[new], least_ids(text.ids(at)[order], new)
    rows = np.stack([c[first] for c in columns], axis=1).astype(">u8").view(np.uint8).reshape(-1, 24)[:, 24 - NAMES :]
    return parcels(block.number, (name[first] >> U64(32)).astype(np.int64), rows, lambda s: squeeze(least[s]))


def _opened(table: pa.Table, width: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Parcels as their sizes, rows and ids."""
    counts = table["n"].to_pylist()
    return counts, front_decode(table["rows"].to_pylist(), counts, width), np.concatenate([unsqueeze(m, np.int64) for m in table["marks"].to_pylist()])


def _later(order: np.ndarray, new: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which rows have an equal one with a smaller id."""
    later = np.empty(len(order), bool)
    later[order] = ids[order] > least_ids(ids[order], new)[np.cumsum(new) - 1]
    return later


def _compare_names(table: pa.Table) -> list[bytes]:
    counts, rows, ids = _opened(table, NAMES)
    later = _later(*sort_bytes(rows), ids)
    return [zstandard.compress(b.tobytes()) for b in split(later, counts)]


def _decided(text: _Text, answers: list[bytes]) -> np.ndarray:
    """Places whose 50 bytes the names of names tell to start earlier."""
    at, _, columns = _names_of_names(text)
    out = np.zeros(text.n, bool)
    if len(at):
        order, new = sort_columns(columns)
        which, ids = np.empty(len(at), np.int64), text.ids(at)
        which[order] = np.cumsum(new) - 1
        told = np.concatenate([np.frombuffer(zstandard.decompress(a), bool) for a in answers])
        later = told[which] | (ids > least_ids(ids[order], new)[which])
        out |= covered(at[later], 2 * PERIOD + TRIPLE - LENGTH + 1, text.n)
    return out


# 3. the remaining suffixes


class _Surroundings:
    """Names with the characters around them, for the places that suffixes left undecided need."""

    def __init__(self, text: _Text, decided: np.ndarray):
        self.text = text
        at, name = text.named()
        left = np.concatenate([[0], np.cumsum(text.suffixes() & ~decided)])
        held = left[at + 1] > left[np.maximum(at - LEFT, 0)] if len(at) else np.zeros(0, bool)
        self.at, self.name = at[held], name[held]
        at, end = self.at, text.end(self.at)
        self.before = np.minimum(LEFT, at - text.block.starts[text.doc[at]])
        self.after = np.minimum(RIGHT, end - at - TRIPLE)
        rows = np.zeros((len(at), AROUND), np.uint8)
        rows[:, :4] = (self.name & U64(0xFFFFFFFF)).astype(">u4").view(np.uint8).reshape(-1, 4)
        wide = np.concatenate([np.zeros(LEFT, np.uint8), text.text, np.zeros(RIGHT, np.uint8)])
        if len(at):
            rows[:, 4 : 4 + LEFT] = sliding_window_view(wide, LEFT)[at][:, ::-1] * (np.arange(LEFT) < self.before[:, None])
            rows[:, 4 + LEFT : -2] = sliding_window_view(wide, RIGHT)[at + LEFT + TRIPLE] * (np.arange(RIGHT) < self.after[:, None])
        rows[:, -2], rows[:, -1] = self.before, self.after
        self.ids = text.ids(at)
        # the whole name, group and rank, leads
        self.order, new = sort_bytes(np.concatenate([self.name.astype(">u8").view(np.uint8).reshape(-1, 8), rows[:, 4:]], axis=1))
        self.rows = rows[self.order[new]]
        self.groups = (self.name[self.order[new]] >> U64(32)).astype(np.int64)
        self.least = least_ids(self.ids[self.order], new)
        self.which = np.empty(len(at), np.int64)
        self.which[self.order] = np.cumsum(new) - 1

    def starts(self, answers: list[bytes]) -> np.ndarray:
        """Suffixes told to start earlier."""
        out = np.zeros(self.text.n, bool)
        if len(self.at):
            told = np.concatenate([np.frombuffer(zstandard.decompress(a), np.uint8).reshape(-1, 3) for a in answers])
            told = np.unpackbits(told, axis=1)[self.which] | (self.ids > self.least[self.which])[:, None]
            for d in range(PERIOD):
                here = self.at[(told[:, d] > 0) & (self.before >= d) & (self.after >= RIGHT - d)]
                out[here - d] = True
        return out


def _send_suffixes(block: Block, answers: pa.Table) -> pa.RecordBatch:
    text = _Text(block)
    found = _Surroundings(text, _decided(text, answers_of(answers, 2)))
    return parcels(block.number, found.groups, found.rows, lambda s: squeeze(found.least[s]))


def _merge_suffixes(table: pa.Table) -> list[bytes]:
    counts, rows, ids = _opened(table, AROUND)
    before, after = rows[:, -2], rows[:, -1]
    sides = []
    for part in (rows[:, : 4 + LEFT], np.concatenate([rows[:, :4], rows[:, 4 + LEFT : -2]], axis=1)):
        order, _ = sort_bytes(part)
        shared = common_prefixes(part[order])
        shared[:1] = -1
        sides.append((order, shared))

    def ranks(side: int, depth: int) -> np.ndarray:
        """Rank of each row by its name and ``depth`` characters on one side."""
        order, shared = sides[side]
        out = np.empty(len(rows), U64)
        out[order] = np.cumsum(shared < 4 + depth)
        return out

    told = np.zeros((len(rows), 24), bool)
    for d in range(PERIOD):
        held = np.flatnonzero((before >= d) & (after >= RIGHT - d))
        if len(held):
            key = (ranks(0, d) << U64(32) | ranks(1, RIGHT - d))[held]
            told[held, d] = _later(*sort_numbers([key]), ids[held])
    return [zstandard.compress(b.tobytes()) for b in split(np.packbits(told, axis=1), counts)]


FOUND = "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary"
PARTS = FOUND + ", whole long, part int"


def _result(rows: list[list], ddl: str) -> pa.RecordBatch:
    schema = arrow_schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _remove(block: Block, answers: pa.Table) -> pa.RecordBatch:
    text = _Text(block)
    decided = _decided(text, answers_of(answers, 2))
    gone = decided | _Surroundings(text, decided).starts(answers_of(answers, 3))
    drop = covered(np.flatnonzero(gone), LENGTH, text.n)
    out = []
    for i, start, end in zip(block.ids, block.starts + block.head, block.ends - block.tail):
        own = drop[start:end]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]])))
        out.append([i, end - start, edge[::2], edge[1::2], text.text[start:end][~own].tobytes(), block.whole, block.part])
    return _result(out, PARTS)


def _join(parts: pa.Table) -> pa.Table:
    sizes = np.array(parts["n_bytes"].to_pylist())
    before = np.cumsum(sizes) - sizes
    starts, ends = (np.concatenate([np.asarray(x, np.int64) + b for x, b in zip(parts[c].to_pylist(), before)]) for c in ("starts", "ends"))
    apart = starts[1:] != ends[:-1]  # runs that meet at a cut are one
    row = [parts["doc_id"][0].as_py(), sizes.sum(), starts[np.append(True, apart)] if len(starts) else [], ends[np.append(apart, True)] if len(ends) else []]
    return pa.Table.from_batches([_result([[*row, b"".join(parts["kept"].to_pylist())]], FOUND)])


def _bounds(blocks: DataFrame, total: int) -> np.ndarray:
    """Bounds of the groups over the first 8 bytes of the triples, from a sample of bounded size."""
    groups = min(MOST_GROUPS, max(1, -(-total // GROUP_BYTES)))
    stride = max(1, total * len(COVER) // PERIOD // min(SAMPLES * groups, MOST_SAMPLES))

    def some(block: Block) -> pa.RecordBatch:
        text = _Text(block)
        rows = text.triples(text.sampled()[block.number % 7919 % stride :: stride])
        return pa.RecordBatch.from_arrays([pa.array(big_endian(rows[:, :8])[0].view(np.int64))], names=["key"])

    keys = np.sort(each_block(blocks, some, "key long").toArrow()["key"].to_numpy().view(U64))
    return np.unique(keys[np.arange(1, groups) * len(keys) // groups]) if len(keys) else keys


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, starts, ends, kept`` for every row.

    A byte goes when a string of 50 bytes that covers it also starts in a
    document with a smaller id, judged on the input. ``starts`` and ``ends``
    are the maximal removed runs and ``kept`` the bytes that are left. Rows
    with one id are documents of their own, none before the other. A row
    without an id is in no order with others: it loses nothing, and nobody
    loses anything to it. Null texts are empty; texts under 50 bytes lose
    nothing; an empty table gives no rows. Texts over 2 MB are worked on in
    overlapping parts and joined at the end, so only the text itself must fit
    in a task. Other columns are not read.
    """
    blocks = blocks_of(docs, id_col, text_col, _cut)
    total = text_bytes(blocks)
    tasks, bounds = task_count(total), _bounds(blocks, total)
    ranked = answered(each_block(blocks, lambda b: _send_triples(b, bounds), PARCELS), tasks, 1, _rank_triples, "sa-ranks")
    named = written(with_answers(blocks, ranked, tasks, _name_places, NAMED), "sa-named")
    told = answered(each_block(named, _send_names, PARCELS), tasks, 2, _compare_names, "sa-recursion")
    merged = answered(with_answers(named, told, tasks, _send_suffixes, PARCELS), tasks, 3, _merge_suffixes, "sa-merged")
    return parts_joined(with_answers(named, told.unionAll(merged), tasks, _remove, PARTS), blocks, tasks, _join)
