"""Repeated word windows by prefix-partitioned suffix trees.

The trees are sparse: a suffix stands for all windows of 20 words that have the
least of their first ten words (by hash, the leftmost of equal ones) where it
starts. Equal windows have it at the same offset and at least eleven words from
there on, so they are found below one node, eleven words deep or deeper.

1. Windows whose 20 words occur once are left out. Short names of all windows
   find them; a chance agreement of names only keeps a window that the tree
   then finds alone.
2. The suffixes at the least words of the others are split by prefixes of
   variable length. A prefix is a string of classes of words (256 classes by
   hash); the suffixes with each are counted, and one that is too frequent for
   a task's memory is made one word longer, up to eleven. Prefixes in a row form groups of a
   memory's size.
3. One task builds each group's subtree: its suffixes are sorted, and the words
   that neighbours share are the depths of the internal nodes; the words before
   the suffixes, backwards, form a tree likewise. A node of ``20 - d`` words or
   deeper together with one of ``d`` words before is a repeat of 20 words or more;
   of the suffixes below it all but the earliest start later.

Words stand in the trees by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .repeats import (
    BLOCKS,
    MOST_GROUPS,
    NO_ID,
    PARCELS,
    Block,
    NameSpace,
    answered,
    answers_of,
    arrow_schema,
    blocks_of,
    common_prefixes,
    covered,
    each_block,
    front_join,
    held_elsewhere,
    least_ids,
    mix,
    parcels,
    parts_joined,
    sort_columns,
    split,
    squeeze,
    task_count,
    text_bytes,
    unsqueeze,
    with_answers,
)

WINDOW = 20
#: The first words of a window, of which the least starts its suffix.
REACH = 10
#: Words sent with a suffix: its own and those before.
AROUND = WINDOW + REACH - 1
#: Suffixes in a group, of 312 bytes each.
GROUP_SUFFIXES = 1 << 17
U64 = np.uint64


def _cut(text: bytes, most: int) -> Iterator[tuple[int, int, int, int, int]]:
    letters = np.frombuffer(text, np.uint8)
    inside = np.concatenate([[False], (letters != 0x20) & ((letters < 9) | (letters > 13)), [False]])
    edge = np.flatnonzero(np.diff(inside))
    starts, ends = edge[::2], edge[1::2]
    n = len(starts)
    bounds = np.unique(np.concatenate([[0], np.searchsorted(starts, np.arange(most, len(text), most)), [n]])).tolist()
    if n == 0:
        yield 0, 0, len(text), len(text), 0
    for a, b in zip(bounds[:-1], bounds[1:]):
        own, end = (int(starts[a]) if a else 0), (int(starts[b]) if b < n else len(text))
        first = max(0, a - WINDOW + 1)
        yield (int(starts[first]) if first else 0), own, end, max(end, int(ends[min(n, b + WINDOW - 1) - 1])), first


class _Suffixes:
    """The words of a block and the windows that lie in one document."""

    def __init__(self, block: Block):
        self.block, self.words, counts = block, [], []
        for start, end in zip(block.starts, block.ends):
            words = block.text[start:end].split()
            self.words += words
            counts.append(len(words))
        self.counts = np.asarray(counts, np.int64)
        self.ends = np.cumsum(self.counts)
        self.n = len(self.words)
        self.one = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), U64, self.n)
        self.doc = np.repeat(np.arange(len(counts), dtype=np.int32), self.counts)
        at = np.arange(max(0, self.n - WINDOW + 1))
        self.at = at[at + WINDOW <= self.ends[self.doc[at]]]

    def ids(self, at: np.ndarray) -> np.ndarray:
        return self.block.id[self.doc[at]]

    def names(self, bits: int) -> np.ndarray:
        """Short names of all windows."""
        if not len(self.at):
            return np.empty(0, U64)
        two = mix(self.one[:-1], self.one[1:])
        four = mix(two[:-2], two[2:])
        eight = mix(four[:-4], four[4:])
        sixteen = mix(eight[:-8], eight[8:])
        return mix(sixteen[: self.n - WINDOW + 1], four[16:])[self.at] >> U64(64 - bits)

    def takes_part(self, at: np.ndarray) -> np.ndarray:
        """Places that places in other blocks may precede or follow."""
        return np.ones(len(at), bool) if self.block.whole else self.ids(at) != NO_ID

    def own(self) -> tuple[int, int]:
        """The words that are not overlap, in a part of a text."""
        text = self.block.text
        return len(text[: self.block.head].split()), self.n - len(text[len(text) - self.block.tail :].split())


# 1. leaves above the depth


def _send_names(block: Block, space: NameSpace) -> pa.RecordBatch:
    suffixes = _Suffixes(block)
    return space.parcels(block.number, np.unique(suffixes.names(space.bits)[suffixes.takes_part(suffixes.at)]))


KEPT = BLOCKS + ", places binary"


def _keep_repeated(block: Block, answers: pa.Table, space: NameSpace) -> pa.RecordBatch:
    """The block with the places of windows whose names occur elsewhere or twice here."""
    suffixes = _Suffixes(block)
    names, which, times = np.unique(suffixes.names(space.bits), return_inverse=True, return_counts=True)
    sent = np.zeros(len(names), bool)
    sent[which[suffixes.takes_part(suffixes.at)]] = True
    told = times > 1
    told[sent] |= space.told(answers, 1, names[sent])
    at = suffixes.at[told[which]]
    row = block.row | {"places": squeeze(np.diff(at, prepend=0).astype(np.uint32))}
    schema = arrow_schema(KEPT)
    return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)


# 2. prefixes


class _Trie:
    """Prefixes of word classes; each ends in a group. A negative child ``c`` is group ``~c``."""

    def __init__(self):
        self.child = np.full((1, 256), -1, np.int64)

    def walk(self, rows: np.ndarray, depth: int = WINDOW - REACH + 1) -> np.ndarray:
        """Node or group that each row (of word hashes) comes to."""
        node = np.zeros(len(rows), np.int64)
        for level in range(depth):
            inner = np.flatnonzero(node >= 0)
            if not len(inner):
                break
            node[inner] = self.child[node[inner], classes(rows[inner, level])]
        return node

    def grow(self, node: int, below: list[int]) -> list[int]:
        made = [len(self.child) + i for i in range(len(below))]
        self.child = np.concatenate([self.child, np.full((len(below), 256), -1, np.int64)])
        self.child[node, below] = made
        return made

    def deal(self, counts: dict[tuple[int, int], int], most: int) -> None:
        """Number the groups: prefixes in order, as many as keep within ``most``."""
        group = held = 0
        stack = [(0, 0)]
        while stack:
            node, start = stack.pop()
            for c in range(start, 256):
                if self.child[node, c] >= 0:
                    stack += [(node, c + 1), (int(self.child[node, c]), 0)]
                    break
                n = counts.get((node, c), 0)
                if held and held + n > most:
                    group, held = group + 1, 0
                held += n
                self.child[node, c] = ~group


def classes(words: np.ndarray) -> np.ndarray:
    """Classes of words; not by the leading bits, which are small in least words."""
    return (words & U64(255)).astype(np.int64)


class _Sparse:
    """The kept windows of a block, and the suffixes that stand for them with the words around."""

    def __init__(self, block: Block, trie: _Trie | None = None):
        self.suffixes = suffixes = _Suffixes(block)
        self.at = at = np.cumsum(unsqueeze(block.row["places"], np.uint32), dtype=np.int64)
        self.offset = sliding_window_view(suffixes.one, REACH)[at].argmin(axis=1) if len(at) else at
        self.ids = suffixes.ids(at)
        self.sent = np.flatnonzero(suffixes.takes_part(at))
        anchor, of = np.unique((at + self.offset)[self.sent], return_inverse=True)
        held = np.zeros(len(anchor), np.uint32)
        np.bitwise_or.at(held, of, np.uint32(1) << self.offset[self.sent].astype(np.uint32))
        end = suffixes.ends[suffixes.doc[anchor]]
        start = end - suffixes.counts[suffixes.doc[anchor]]
        wide = np.concatenate([np.zeros(REACH - 1, U64), suffixes.one, np.zeros(WINDOW, U64)])
        rows = np.zeros((len(anchor), AROUND), U64)
        if len(anchor):
            after = np.arange(WINDOW) < (end - anchor)[:, None]
            before = np.arange(REACH - 1) < (anchor - start)[:, None]
            rows[:, :WINDOW] = sliding_window_view(wide, WINDOW)[anchor + REACH - 1] * after
            rows[:, WINDOW:] = sliding_window_view(wide, REACH - 1)[anchor][:, ::-1] * before
        groups = ~trie.walk(rows) if trie else np.zeros(len(rows), np.int64)
        order, new = sort_columns([groups, *rows.T])
        first = order[new]
        self.rows, self.groups = rows[first], groups[first]
        self.least = least_ids(suffixes.ids(anchor)[order], new)
        self.held = np.bitwise_or.reduceat(held[order], np.flatnonzero(new)) if len(order) else held
        self.first = anchor[first] + block.before
        which = np.empty(len(rows), np.int64)
        which[order] = np.cumsum(new) - 1
        self.which = which[of]


def _partition(kept: DataFrame) -> _Trie:
    """Count prefixes, longer ones below those that are too frequent.

    The driver sees at most 256 counts for each prefix that is too frequent,
    of which there are no more than groups.
    """
    trie, counts, frontier, most = _Trie(), {}, [0], GROUP_SUFFIXES
    for depth in range(WINDOW - REACH + 1):

        def count(block: Block, trie=trie, depth=depth, frontier=frontier) -> pa.RecordBatch:
            rows = _Sparse(block).rows
            node = trie.walk(rows, depth)
            held = np.isin(node, frontier)
            key, n = np.unique(node[held] << 8 | classes(rows[held, depth]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

        got = {(r["key"] >> 8, r["key"] & 255): r["n"] for r in each_block(kept, count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()}
        counts |= got
        if depth == 0:
            most = max(GROUP_SUFFIXES, sum(got.values()) // MOST_GROUPS)
        large: dict[int, list[int]] = {}
        for (node, c), n in sorted(got.items()):
            if n > most and depth < WINDOW - REACH:
                large.setdefault(node, []).append(c)
        frontier = [made for node, below in large.items() for made in trie.grow(node, below)]
        if not frontier:
            break
    trie.deal(counts, most)
    return trie


# 3. subtrees


def _code(rows: np.ndarray) -> bytes:
    """Sorted rows: what each shares with the one before, a dictionary of the other words, and these."""
    shared = common_prefixes(rows)
    words, rest = np.unique(rows[np.arange(AROUND) >= shared[:, None]], return_inverse=True)
    known = squeeze(np.diff(words, prepend=U64(0)))
    return len(known).to_bytes(4, "little") + known + zstandard.compress(shared.astype(np.uint8).tobytes()) + squeeze(rest.astype(np.uint32))


def _send_suffixes(block: Block, trie: _Trie) -> pa.RecordBatch:
    sparse = _Sparse(block, trie)

    def marks(s: slice) -> bytes:
        numbers = [sparse.held[s].astype(np.int64), sparse.least[s], *([sparse.first[s]] if block.whole else [])]
        return block.whole.to_bytes(8, "little") + squeeze(np.concatenate(numbers))

    return parcels(block.number, sparse.groups, sparse.rows, marks, _code)


def _decode(parcels: list[bytes], counts: list[int]) -> np.ndarray:
    shared, rest = [], []
    for data, n in zip(parcels, counts):
        size = int.from_bytes(data[:4], "little")
        words = np.cumsum(unsqueeze(data[4 : 4 + size], U64), dtype=U64)
        unpacker = zstandard.ZstdDecompressor().decompressobj()
        shared.append(np.frombuffer(unpacker.decompress(data[4 + size :]), np.uint8))
        rest.append(words[unsqueeze(unpacker.unused_data, np.uint32)])
    return front_join(shared, rest, AROUND)


class Tree:
    """The tree of sorted rows: leaves in order, and what each shares with the leaf before."""

    def __init__(self, rows: np.ndarray):
        self.order, _ = sort_columns(list(rows.T))
        self.depths = common_prefixes(rows[self.order])

    def nodes(self, depth: int) -> np.ndarray:
        """For each row the topmost node of at least that depth above its leaf (the leaf itself if there is none)."""
        deep = self.depths >= depth
        deep[:1] = False
        out = np.empty(len(deep), U64)
        out[self.order] = np.cumsum(~deep)
        return out


def _subtree(table: pa.Table) -> list[bytes]:
    counts, marks = table["n"].to_pylist(), table["marks"].to_pylist()
    rows = _decode(table["rows"].to_pylist(), counts)
    whole = np.repeat(np.array([int.from_bytes(m[:8], "little") for m in marks], np.int64), counts)
    numbers = [unsqueeze(m[8:], np.int64) for m in marks]
    held, ids = (np.concatenate([x[i * n : (i + 1) * n] for x, n in zip(numbers, counts)]) for i in (0, 1))
    place = np.concatenate([x[2 * n :] if len(x) > 2 * n else np.zeros(n, np.int64) for x, n in zip(numbers, counts)])
    after, before = Tree(rows[:, :WINDOW]), Tree(rows[:, WINDOW:])
    told = np.zeros((len(rows), 16), bool)
    for d in range(REACH):
        at = np.flatnonzero(held >> d & 1)
        if not len(at):
            continue
        node = (after.nodes(WINDOW - d) << U64(32) | before.nodes(d))[at]
        order, new = sort_columns([node])
        leaf = at[order]
        least = least_ids(ids[leaf], new)[np.cumsum(new) - 1]
        told[leaf, d] = (ids[leaf] > least) & (ids[leaf] != NO_ID)
        cut = np.flatnonzero(whole[leaf])
        if len(cut):  # parts of one text: an earlier place of the same document
            by, new = sort_columns([np.cumsum(new)[cut], whole[leaf[cut]]])
            least = least_ids(place[leaf[cut[by]]], new)[np.cumsum(new) - 1]
            told[leaf[cut[by]], d] |= place[leaf[cut[by]]] > least
    return [zstandard.compress(b.tobytes()) for b in split(np.packbits(told, axis=1), counts)]


FOUND = "doc_id long, n_words long, n_removed long, kept string"
PARTS = FOUND + ", whole long, part int"


def _result(rows: list[list], ddl: str) -> pa.RecordBatch:
    schema = arrow_schema(ddl)
    columns = [[r[i] for r in rows] for i in range(len(schema))]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()).cast(pa.string()) if f.name == "kept" else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _remove(block: Block, answers: pa.Table, trie: _Trie) -> pa.RecordBatch:
    sparse = _Sparse(block, trie)
    suffixes, at, sent = sparse.suffixes, sparse.at, sparse.sent
    gone = np.zeros(len(at), bool)
    if len(sent):
        told = np.concatenate([np.frombuffer(zstandard.decompress(a), np.uint8).reshape(-1, 2) for a in answers_of(answers, 2)])
        told = np.unpackbits(told, axis=1)[sparse.which, sparse.offset[sent]].astype(bool)
        known = sparse.ids[sent] != NO_ID
        gone[sent] = told & (known | bool(block.whole)) | known & (sparse.ids[sent] > sparse.least[sparse.which])
    # earlier in the same document: equal names, compared by their words
    names = suffixes.names(64)[np.searchsorted(suffixes.at, at)]
    order, new = sort_columns([names, suffixes.doc[at].astype(np.int64)])
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    twice = np.flatnonzero(~new)
    rows = sliding_window_view(suffixes.one, WINDOW) if len(twice) else None
    for i in range(0, len(twice), 1 << 15):
        part = twice[i : i + (1 << 15)]
        gone[order[part]] |= (rows[at[order[part]]] == rows[at[first[part]]]).all(axis=1)
    drop = covered(at[gone], WINDOW, suffixes.n)
    out = []
    for i, count, end in zip(block.ids, suffixes.counts, suffixes.ends):
        a, b = suffixes.own() if block.whole else (end - count, end)
        own, words = drop[a:b], suffixes.words[a:b]
        out.append([i, b - a, int(own.sum()), b" ".join([w for w, d in zip(words, own) if not d] if own.any() else words), block.whole, block.part])
    return _result(out, PARTS)


def _join(parts: pa.Table) -> pa.Table:
    kept = b" ".join(k.encode() for k in parts["kept"].to_pylist() if k)
    return pa.Table.from_batches([_result([[parts["doc_id"][0].as_py(), sum(parts["n_words"].to_pylist()), sum(parts["n_removed"].to_pylist()), kept]], FOUND)])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every row.

    A word goes when a window of 20 words that covers it also starts earlier:
    in a document with a smaller id, or earlier in the same one; windows are
    judged on the input. ``kept`` is what is left, joined by single spaces.
    Rows with one id are documents of their own, none before the other; a row
    without an id loses only what it repeats itself, and nobody loses anything
    to it. Null and empty texts have no words; an empty table gives no rows.
    Texts over 2 MB are worked on in overlapping parts and joined at the end,
    so only the text itself must fit in a task. Other columns are not read.
    """
    blocks = blocks_of(docs, id_col, text_col, _cut)
    total = text_bytes(blocks)
    tasks, space = task_count(total), NameSpace(total)
    told = answered(each_block(blocks, lambda b: _send_names(b, space), PARCELS), tasks, 1, held_elsewhere, "st-names")
    kept = written(with_answers(blocks, told, tasks, lambda b, a: _keep_repeated(b, a, space), KEPT), "st-kept")
    trie = _partition(kept)
    told = answered(each_block(kept, lambda b: _send_suffixes(b, trie), PARCELS), tasks, 2, _subtree, "st-subtrees")
    return parts_joined(with_answers(kept, told, tasks, lambda b, a: _remove(b, a, trie), PARTS), blocks, tasks, _join)
