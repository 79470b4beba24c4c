"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams and has their mean vector; a text is
the mean of its distinct words; a linear softmax reads the label off it. The
n-gram vectors and the softmax are trained together by gradient descent in
numpy on a bounded sample of labelled rows, on the driver. A misspelt or
inflected word that the sample lacks still shares n-grams with those it has.

The model is some hundred thousand small vectors, whatever the corpus; scoring
needs one number a word, which tasks remember for the words they have met.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import binary_column, free, pieces, worker_state

#: Labelled rows that the model is fitted on, at most (a sample by hash).
FIT_ROWS = 4_000
#: n-gram lengths in code points, over the word with its two borders.
SHORTEST, LONGEST = 3, 6
BUCKETS, DIM, EPOCHS, RATE = 1 << 17, 8, 120, 2.0
#: n-grams get a vector when their share of label 1 is so many deviations off, in so many texts.
LEAST_Z, LEAST_TEXTS = 5.0, 5
#: Words whose numbers a task keeps before it starts anew.
CACHE_WORDS = 100_000
_EDGES = b".,;:!?|*$%&#\"'()[]{}<>-_=+~/\\"


def words_of(text: bytes) -> set[bytes]:
    """Distinct words in lower case (ASCII), without punctuation around them."""
    return {w.strip(_EDGES) for w in text.lower().split()} - {b""}


def buckets_of(word: bytes) -> list[int]:
    """Hash buckets of the word's distinct n-grams and of the word itself."""
    marked = "<" + word.decode("utf-8", "replace") + ">"
    grams = {marked[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(marked) - n + 1)} | {marked}
    return [zlib.crc32(g.encode()) % BUCKETS for g in grams]


@dataclass(frozen=True)
class Model:
    """What each n-gram bucket with a vector adds to the margin of label 1 over label 0, and the bias."""

    margins: dict[int, float]
    bias: float

    def word_margin(self, word: bytes) -> float:
        grams = buckets_of(word)
        get = self.margins.get
        return sum([get(g, 0.0) for g in grams]) / len(grams)


class _Mean:
    """A sparse matrix of means: row ``i`` averages the rows of ``values`` that it lists."""

    def __init__(self, row: np.ndarray, col: np.ndarray, weight: np.ndarray, rows: int, cols: int):
        self.weight = weight[:, None].astype(np.float32)
        self.row, self.col, self.shape = row, col, (rows, cols)

    def _sum(self, values: np.ndarray, take: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
        picked = values[take] * self.weight
        return np.stack([np.bincount(to, picked[:, k], n) for k in range(values.shape[1])], axis=1).astype(np.float32)

    def mean(self, values: np.ndarray) -> np.ndarray:
        return self._sum(values, self.col, self.row, self.shape[0])

    def back(self, grad: np.ndarray) -> np.ndarray:
        return self._sum(grad, self.row, self.col, self.shape[1])


def fit(bags: Iterable[Iterable[bytes]], labels: list[int], seed: int = 7) -> Model:
    """Train n-gram vectors and softmax together, by gradient descent with momentum over the whole sample.

    Only n-grams that the labels bear on have a vector that moves; the others
    count in the means. With one label only, every score is its share.
    """
    share = (sum(labels) + 1) / (len(labels) + 2)
    prior = float(np.log(share / (1 - share)))
    if len(set(labels)) < 2:
        return Model({}, prior)
    y = np.asarray(labels)
    number: dict[bytes, int] = {}
    rows = [np.fromiter(sorted(number.setdefault(w, len(number)) for w in b), np.int32) for b in bags]
    size, flat = np.empty(len(number), np.int32), array("i")
    for i, w in enumerate(number):
        grams = buckets_of(w)
        size[i] = len(grams)
        flat.extend(grams)
    del number
    flat = np.frombuffer(flat, np.int32)
    ends = np.cumsum(size)
    texts, ones = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for ids, label in zip(rows, labels):
        held = np.unique(np.concatenate([flat[ends[i] - size[i] : ends[i]] for i in ids])) if len(ids) else np.empty(0, np.int64)
        texts[held] += 1
        ones[held] += label
    p = y.mean()
    z = (ones - texts * p) / np.sqrt(texts * p * (1 - p) * (1 - texts / len(y)) + 1e-9)
    kept = np.flatnonzero((np.abs(z) >= LEAST_Z) & (texts >= LEAST_TEXTS))
    if not len(kept):
        return Model({}, prior)
    place = np.full(BUCKETS, -1)
    place[kept] = np.arange(len(kept))
    at = np.flatnonzero(place[flat] >= 0)
    col, row = place[flat[at]], np.searchsorted(ends, at, side="right")
    told = np.unique(row)  # words with such an n-gram
    back = np.full(len(size), -1)
    back[told] = np.arange(len(told))
    words = _Mean(back[row], col, 1 / size[row], len(told), len(kept))
    n_words = np.maximum(np.fromiter(map(len, rows), np.int64, len(rows)), 1)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    word = back[np.concatenate(rows)]
    docs = _Mean(owner[word >= 0], word[word >= 0], (1 / n_words)[owner[word >= 0]], len(rows), len(told))
    rng = np.random.default_rng(seed)
    params = [
        rng.normal(0, 0.01, (len(kept), DIM)).astype(np.float32),
        rng.normal(0, 1, (DIM, 2)).astype(np.float32),
        np.log(np.array([1 - share, share], np.float32)),
    ]
    momentum, scale = [np.zeros_like(x) for x in params], [0.0] * 3
    wanted = np.eye(2, dtype=np.float32)[y]
    for step in range(1, EPOCHS + 1):
        vectors, softmax, bias = params
        mean = docs.mean(words.mean(vectors))
        logits = mean @ softmax + bias
        probs = np.exp(logits - logits.max(axis=1, keepdims=True))
        probs /= probs.sum(axis=1, keepdims=True)
        grad = (probs - wanted) / len(y)
        grads = [words.back(docs.back(grad @ softmax.T)), mean.T @ grad, grad.sum(axis=0)]
        for i, (x, g) in enumerate(zip(params, grads)):
            # one step length for a whole matrix, so that rare n-grams move little
            momentum[i] += 0.1 * (g - momentum[i])
            scale[i] += 0.05 * (float((g * g).max()) - scale[i])
            x -= (RATE if i == 0 else 0.02) * momentum[i] / (np.sqrt(scale[i] / (1 - 0.95**step)) + 1e-9)
    vectors, softmax, bias = params
    margin = vectors @ (softmax[:, 1] - softmax[:, 0])
    return Model(dict(zip(kept.tolist(), margin.astype(float).tolist())), float(bias[1] - bias[0]))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1):
        words = [b"\n".join(sorted(words_of(t or b""))) for t in binary_column(batch, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(words, pa.binary())], names=["doc_id", "label", "words"])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """Fit a model on at most ``fit_rows`` labelled rows, drawn by hash of the id.

    ``labels`` holds the rows that may be learnt from. Null ids and labels are
    left out; of repeated labels the largest counts, and of the texts of one id
    the least. With no rows at all (empty tables) every score is one half. Only
    the distinct words of a text reach the driver. Other columns are not read.
    """
    label = F.max((F.col(label_col) > 0).cast("int"))
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(label.alias("label"))
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    # fit_rows bounds what is broadcast
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(drawn), F.col("doc_id") == F.col("id"))
    bags = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    kind = bags.schema["doc_id"].dataType.simpleString()
    got = bags.mapInArrow(_bags, f"doc_id {kind}, label int, words binary").toArrow().sort_by("doc_id")
    return fit((w.as_py().split() for w in got["words"]), got["label"].to_pylist())


def _score(model: Model, at: int, kept_columns: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept = worker_state("toxicity")
    if kept.get("model") != model:
        kept.clear()
        kept |= {"model": model, "words": {}}
    for batch in pieces(batches, at):
        if len(kept["words"]) > CACHE_WORDS:
            kept["words"] = {}
        known: dict[bytes, float] = kept["words"]
        out = []
        for text in binary_column(batch, at):
            words = sorted(words_of(text or b""))  # one order, so that sums agree between runs
            for w in words:
                if w not in known:
                    known[w] = model.word_margin(w)
            out.append(model.bias + sum([known[w] for w in words]) / max(len(words), 1))
        scores = 1 / (1 + np.exp(-np.clip(out, -700, 700)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:kept_columns], pa.array(scores, pa.float64())], names=[*batch.schema.names[:kept_columns], "score"])


def score(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row, and ``score``, from its whole text alone.

    Null and empty texts get the score of the bias. Rows with null or repeated
    ids are scored like others; a column ``score`` of the input is replaced. An
    empty table gives no rows. A text is one task's work, however long.
    """
    names = [c for c in keep if c != "score"]
    rows, at = docs.select(*(F.col(f"`{c}`") for c in names)), len(names)
    if text_col in names and docs.schema[text_col].dataType == StringType():
        at = names.index(text_col)  # the text is sent once
    else:
        rows = docs.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text_col}`").cast("string").alias(free("text", docs)))
    schema = StructType([*rows.schema][: len(names)] + [StructField("score", DoubleType())])
    return rows.mapInArrow(lambda batches: _score(model, at, len(names), batches), schema)
