"""BPE encoding and decoding over a trie of the distinct words.

Every prefix of a word has one encoding, and that encoding ends in one *last
token*; what precedes it is the encoding of a shorter prefix. So the state of
a trie node is just the last token of its prefix, and words that share a
prefix share the work. A token ``t`` that ends at a node is the last token
when it may follow the last token of the node ``len(t)`` symbols above it,
that is, when no merge would cross the border between the two.

Texts are dealt to tasks as they are stored; each task keeps the encodings of
the words it has met twice in a piece (bounded, see ``CACHE_WORDS``), so nothing
is shuffled.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, worker_state

#: Encodings a task keeps, and neighbours, states and parts of tokens the encoder
#: keeps before it starts anew; these bound memory, not results.
CACHE_WORDS, CACHE_PAIRS, CACHE_STATES, CACHE_SPINES = 60_000, 100_000, 30_000, 10_000
#: Text that is encoded at once; what is made of it on the way takes some twenty times as much.
PIECE_BYTES = 1 << 20
END = "</w>"
#: Printable ASCII without "<", and Latin letters that no normal form changes:
#: the normalizer only lowers them.
PLAIN = re.compile("[!-;=-~À-ÖØ-öø-įı-ſ]+").fullmatch
#: The words of the file's pattern, over those characters.
PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ſ]+|[0-9]|[^a-z0-9À-ÖØ-öø-ſ]+").findall
#: The settings that the rules above, and decoding by spaces, are right for.
SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "decoder": None,
    "post_processor": None,
}
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Byte-level symbols: bytes that cannot be shown stand from code point 256 on, in order.
SYMBOLS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class State(NamedTuple):
    """The tokens that end a prefix, longest first, each with its length and left neighbours met.

    One of them is the last token, so the shortest, which stands apart, is it when no other is.
    """

    tail: str
    moves: dict
    inner: list
    inner_least: str
    final: list
    final_least: str


class TrieEncoder:
    """Encodes words (strings of byte-level symbols) with a merge table."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        model = json.loads(spec)
        # only the library's splitting is used, so it gets no tokens
        library = Tokenizer.from_str(json.dumps(model | {"model": model["model"] | {"vocab": {}, "merges": []}, "added_tokens": []}))
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        own = {t: t for t in model["model"]["vocab"]}  # one string for each token
        merges = [tuple(own[t] for t in (m.split(" ") if isinstance(m, str) else m)) for m in model["model"].pop("merges")]
        #: left part -> right part -> rank of their merge
        self.joins: dict[str, dict[str, int]] = {}
        for i, (left, right) in enumerate(merges):
            self.joins.setdefault(left, {})[right] = i
        self.parts = {own["".join(pair)]: pair for pair in merges}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        ids: dict[str, int] = model["model"]["vocab"] | self.special
        self.packed = {t: i.to_bytes(4, "little") for t, i in ids.items()}
        self.names = {i: t for t, i in ids.items()}
        self.spines: dict[tuple[str, int], dict[str, float]] = {}
        self._whole: dict[str, bool] = {}
        usable = [t for t in model["model"]["vocab"] if self.is_whole(t)]
        self.inner = {t for t in usable if not t.endswith(END)}
        self.final = {t.removesuffix(END) for t in usable if t.endswith(END)}
        self.starts = {t[:i] for t in self.inner | self.final for i in range(len(t) + 1)}
        #: right token -> left token -> whether they may stand side by side
        self.follows: dict[str, dict[str, bool]] = {}
        self.states: dict[str, State] = {}
        self.pairs = 0
        self._whole, self.spines = {}, {}

    def trim(self) -> None:
        """Drop what is kept for speed alone, when it has grown large."""
        if self.pairs > CACHE_PAIRS or len(self.states) > CACHE_STATES:
            for state in self.states.values():  # states lead to each other in cycles, and no collector runs meanwhile
                state.moves.clear()
            self.follows, self.states, self.pairs = {}, {}, 0
        if len(self.spines) > CACHE_SPINES:
            self.spines = {}

    def _spine(self, token: str, side: int) -> dict[str, float]:
        """Parts of a token that touch its border, each with the rank at which it is merged away."""
        known = self.spines.get((token, side))
        if known is None:
            known = self.spines[token, side] = {token: float("inf")}
            while token in self.parts:
                pair = self.parts[token]
                token = pair[side]
                known[token] = self.joins[pair[0]][pair[1]]
        return known

    def _crossed(self, left: str, right: str, before: float) -> bool:
        """Whether some merge joins the two tokens at a rank under ``before``."""
        ys = self._spine(right, 0)
        for x, x_gone in self._spine(left, 1).items():
            joined = self.joins.get(x)
            if joined is None or joined.keys().isdisjoint(ys):
                continue
            for y, y_gone in ys.items():
                r = joined.get(y)
                # of equal merges the leftmost goes first
                if r is not None and r < before and r < x_gone and r <= y_gone:
                    return True
        return False

    def is_whole(self, token: str) -> bool:
        """Whether encoding the token's own text gives the token back."""
        known = self._whole.get(token)
        if known is None:
            pair = self.parts.get(token)
            known = pair is None or (self.is_whole(pair[0]) and self.is_whole(pair[1]) and not self._crossed(*pair, self.joins[pair[0]][pair[1]]))
            self._whole[token] = known
        return known

    def may_follow(self, left: str, right: str, known: dict[str, bool]) -> bool:
        self.pairs += 1
        answer = known[left] = not self._crossed(left, right, float("inf"))
        return answer

    def state(self, tail: str) -> State:
        """The state for ``tail``, the longest end of a prefix that starts a token."""
        found = self.states.get(tail)
        if found is None:
            ends = [tail[i:] for i in range(len(tail))]
            *inner, inner_least = [t for t in ends if t in self.inner] or [""]
            *final, final_least = [t for t in ends if t in self.final] or [""]
            found = self.states[tail] = State(
                tail,
                {},
                [(t, len(t), self.follows.setdefault(t, {})) for t in inner],
                inner_least,
                [(t + END, len(t), self.follows.setdefault(t + END, {})) for t in final],
                final_least + END,
            )
        return found

    def move(self, state: State, symbol: str) -> State:
        tail = state.tail + symbol
        while tail not in self.starts:
            tail = tail[1:]
        found = state.moves[symbol] = self.state(tail)
        return found

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of each distinct word, by one depth-first walk over their trie.

        Sorted words spell their trie in depth-first order: a word goes back to
        the node where it leaves the one before, keeps the states above that
        node, and adds those of its own remaining symbols.
        """
        out: dict[str, bytes] = {}
        packed = self.packed
        # of the first i symbols on the way down: last token, and state
        above, path = [""], [self.state("")]
        before = ""
        for word in sorted(words):
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            before = word
            last = len(word) - 1
            if shared < len(above) - 1:
                del above[shared + 1 :]
            if shared < len(path) - 1:
                del path[shared + 1 :]
            tail, moves, inner, inner_least, final, final_least = state = path[shared]
            n = shared
            if n == len(above):  # the word before ended here and left no inner token
                above.append(self.inner_token(state, n, above))
            for symbol in word[shared:]:
                n += 1
                tail, moves, inner, inner_least, final, final_least = state = moves.get(symbol) or self.move(state, symbol)
                path.append(state)
                if n <= last:
                    for token, size, known in inner:
                        if size == n:
                            break
                        left = above[n - size]
                        ok = known.get(left)
                        if ok or ok is None and self.may_follow(left, token, known):
                            break
                    else:
                        token = inner_least
                    above.append(token)
            for token, size, known in final:
                if size == n:
                    break
                left = above[n - size]
                ok = known.get(left)
                if ok or ok is None and self.may_follow(left, token, known):
                    break
            else:
                token = final_least
                size = len(token) - len(END)
            ids, at = packed[token], n - size
            while at:
                token = above[at]
                ids = packed[token] + ids
                at -= len(token)
            out[word] = ids
        return out

    def inner_token(self, state: State, n: int, above: list[str]) -> str:
        for token, size, known in state.inner:
            if size == n or self.may_follow(above[n - size], token, known):
                return token
        return state.inner_least

    def split(self, chunk: str) -> list[str]:
        """Words (byte-level symbols) and special tokens in a chunk without white space."""
        if chunk.isascii() and chunk.isalpha():
            return [chunk.lower()]
        if PLAIN(chunk):
            text = chunk.lower()
            if text.isascii():
                return PLAIN_WORDS(text)
            return [w if w.isascii() else w.encode().decode("latin-1").translate(SYMBOLS) for w in PLAIN_WORDS(text)]
        out: list[str] = []
        for part in self.split_special.split(chunk):
            if part in self.special:
                out.append(part)
            elif part:
                out += [w for w, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(part)) if w]
        return out


def _encode(spec: str, batches: Iterator[pa.RecordBatch], words_per_trie: int) -> Iterator[pa.RecordBatch]:
    gc.disable()  # trim() breaks the cycles there are, and there are many small objects to look through
    try:
        yield from _encoded(spec, batches, words_per_trie)
    finally:
        gc.enable()
        pa.default_memory_pool().release_unused()


def _encoded(spec: str, batches: Iterator[pa.RecordBatch], words_per_trie: int) -> Iterator[pa.RecordBatch]:
    kept = worker_state("bpe_trie")
    if kept.get("spec") != spec:
        kept.clear()
        kept |= {"spec": spec, "encoder": TrieEncoder(spec), "packed": {}, "older": {}}
    encoder: TrieEncoder = kept["encoder"]
    names = pa.array([encoder.names.get(i, "") for i in range(max(encoder.names) + 1)])
    for batch in pieces(batches, 1, PIECE_BYTES):
        if len(kept["packed"]) > CACHE_WORDS // 2:  # of the older half stays what is met again
            kept["older"], kept["packed"] = kept["packed"], {}
        encoder.trim()
        yield _coded(encoder, kept["packed"], kept["older"], names, batch, words_per_trie)


def _coded(encoder: TrieEncoder, packed: dict[str, bytes], older: dict[str, bytes], names: pa.Array, batch: pa.RecordBatch, words_per_trie: int) -> pa.RecordBatch:
    """One piece; the encodings of what it holds more than once are kept in ``packed``."""
    # no token holds white space, so the chunks between it are encoded apart
    chunks = pc.ascii_split_whitespace(pc.fill_null(batch.column(1), ""))
    coded = chunks.values.dictionary_encode()
    index, offsets = coded.indices.to_numpy(), chunks.offsets.to_numpy()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist
    del chunks, coded
    spelled = [packed.get(c) or older.get(c) for c in distinct]
    new = [i for i, ids in enumerate(spelled) if ids is None]
    for at in range(0, len(new), words_per_trie):
        some = new[at : at + words_per_trie]
        split = [encoder.split(distinct[i]) for i in some]
        words = set(chain.from_iterable(split))
        special = words & encoder.special.keys()
        tokens = encoder.encode_words(list(words - special))
        tokens |= {w: encoder.packed[w] for w in special}
        for i, words in zip(some, split):
            spelled[i] = tokens[words[0]] if len(words) == 1 else b"".join([tokens[w] for w in words])
    often = np.flatnonzero(np.bincount(index, minlength=len(distinct)) > 1)
    packed |= {distinct[i]: spelled[i] for i in often.tolist()}
    # gather each chunk's ids in the order of the texts
    lengths = np.fromiter(map(len, spelled), np.int64, len(spelled)) // 4
    starts = np.cumsum(lengths) - lengths
    n = lengths[index]
    ends = np.cumsum(n)
    place = np.repeat(starts[index] - ends + n, n)
    place += np.arange(len(place))
    ids = np.frombuffer(b"".join(spelled), "<u4")[place]
    del place
    offsets = np.concatenate([[0], ends])[offsets].astype(np.int32)
    text = pc.binary_join(pa.ListArray.from_arrays(offsets, names.take(pa.array(ids))), " ")
    binary = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets * 4), pa.py_buffer(ids.tobytes())])
    return pa.RecordBatch.from_arrays([batch.column(0), binary, text], names=["doc_id", "ids", "decoded"])


def check_settings(spec: str) -> None:
    """Refuse a file whose texts would be split, or whose ids decoded, otherwise than here."""
    file = json.loads(spec)
    odd = [k for k, v in SETTINGS.items() if file.get(k) != v]
    if file["model"].get("end_of_word_suffix") != END or file["model"].get("dropout") or file["model"].get("ignore_merges"):
        odd.append("model")
    if odd:
        raise ValueError(f"this tokenizer file has another {', '.join(odd)} than a word-end BPE of this kind")


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", words_per_trie: int = 20_000) -> DataFrame:
    """Encode every whole text and decode it again.

    ``tokenizer_path`` is a word-end BPE file of the tokenizers library, read on
    the driver. Returns ``doc_id``, ``ids`` (binary: the ids as little-endian
    unsigned 32-bit integers), ``decoded`` (the tokens joined by spaces, as the
    file names no decoder). Null and empty texts give no ids and an empty text;
    rows with a null or repeated id are encoded like any other; other columns
    are not read. Marks such as ``<|endoftext|>`` inside a text are their ids. An
    empty table gives no rows. A text is one task's work, however long. A file
    with another normalizer, splitting, decoder or end mark raises ValueError.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    check_settings(spec)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _encode(spec, batches, words_per_trie), f"doc_id {kind}, ids binary, decoded string")
