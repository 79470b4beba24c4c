"""Quality rules: measures of each text, and lines that many documents of a host share.

Lines are normalised and hashed, each document counts a line once, and a line
that more documents of its host hold than the limit is taken for boilerplate.
Its words are removed; a document that loses too much is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, pieces, written

#: Repeated words are judged in windows of this many.
WINDOW = 8
_KIND = np.zeros(256, np.int64)
_KIND[list(b" \t\n\v\f\r")] = 1  # white space
_KIND[list(b"#*$%&|<>")] = 2  # symbols
_KIND[0x80:0xC0] = 4  # not the first byte of a code point
_DIGITS = bytes.maketrans(b"123456789", b"0" * 9)


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that the text holds twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    # name windows of 2, 4, 8, ... words by the names of their halves: exact, no hashes
    width = 1
    while width < size:
        step = min(width, size - width)
        _, code = np.unique(code[: len(code) - step] * np.int64(len(words) + 1) + code[step:], return_inverse=True)
        width += step
    twice = np.bincount(code)[code] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    edge[at + size] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def line_key(words: list[bytes]) -> int:
    """Hash of a normalised line: single spaces, lower case (ASCII), digits alike."""
    return xxhash.xxh3_64_intdigest(b" ".join(words).lower().translate(_DIGITS))


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last two columns are a text and the keys of the lines to take out of it."""
    for batch in batches:
        texts = []
        for text, keys in zip(binary_column(batch, batch.num_columns - 2), batch.column(batch.num_columns - 1).to_pylist()):
            gone = set(np.asarray(keys or [], np.int64).view(np.uint64).tolist())
            lines = (text or b"").split(b"\n") if gone else []
            kept = [x for x in lines if not ((parts := x.split()) and line_key(parts) in gone)]
            texts.append(b"\n".join(kept) if gone else text)
        clean = pa.array(texts, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], clean], names=[*batch.schema.names[:-2], "clean_text"])


def _measure(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 2):
        out: list[list] = [[] for _ in range(7)]
        for text in binary_column(batch, 2):
            text = text or b""
            counts = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=5)
            words = text.split()
            seen: set[bytes] = set()
            again, lines = 0, {}
            for line in text.split(b"\n"):
                parts = line.split()
                if parts:
                    again += line in seen
                    seen.add(line)
                    key = line_key(parts)
                    lines[key] = lines.get(key, 0) + len(parts)
            for to, value in zip(
                out,
                (len(words), len(text) - counts[1] - counts[4], counts[2], again, repeated_words(words), np.fromiter(lines, np.uint64, len(lines)).view(np.int64), list(lines.values())),
            ):
                to.append(value)
        arrays = [pa.array(x, pa.int64()) for x in out[:5]] + [pa.array(x, pa.list_(pa.int64())) for x in out[5:]]
        more = [batch.column(2)] if with_text else []
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays, *more], names=[*_NAMES, *(["text"] if with_text else [])])


_NAMES = ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"]


def quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = 20,
    max_share: float = 0.002,
    least_words: int = 20,
    least_share: float = 0.5,
    most_docs: int = 1000,
    with_text: bool = False,
) -> DataFrame:
    """One row per input row: the measures, and the verdicts.

    A line is boilerplate when more than ``max_docs`` documents of its host and
    more than ``max_share`` of them hold it, and in any case when more than
    ``most_docs`` do, however large the host. ``removed_words`` counts the words
    of such lines; a document is depleted when fewer than ``least_words`` words
    or less than ``least_share`` of its words remain. ``base_failed`` is true
    under 20 words, or when over 30 % of the words are in repeated windows;
    ``kept`` is false for failed and depleted documents.

    ``with_text`` adds ``clean_text``, the text without the boilerplate lines.

    Null and empty texts have no words and fail. Documents without a host share
    the null one. Rows with one id and host are one document when documents are
    counted; rows without an id are one each. An empty table gives no rows. A
    text is one task's work, however long. Other columns are not read.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{host_col}`").cast("string").alias("host"), F.col(f"`{text_col}`").cast("string").alias("text")
    )
    schema = ", ".join(["doc_id long", "host string", *(f"{n} long" for n in _NAMES[2:7]), "lines array<long>", "line_words array<long>"])
    # the row's number within its written file part is its key: ids may be null or repeated
    measured = rows.mapInArrow(lambda batches: _measure(batches, with_text), schema + ", text string" * with_text)
    measured = written(measured.withColumn("row", F.monotonically_increasing_id()), "quality")
    counted = F.coalesce("doc_id", -1 - F.col("row")).alias("doc")
    held = measured.select("row", "doc_id", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("line")).select(
        "row", "doc_id", "host", F.col("line.lines").alias("line"), F.col("line.line_words").alias("words")
    )
    sizes = written(measured.select("host", counted).distinct().groupBy("host").agg(F.count("*").alias("docs")), "quality-hosts")
    counts = held.select("host", "line", counted).distinct().groupBy("host", "line").agg(F.count("*").alias("n"))
    over = counts.where(F.col("n") > max_docs)
    limit = F.least(F.greatest(F.lit(float(max_docs)), F.col("docs") * max_share), F.lit(float(most_docs)))
    common = written(over.join(sizes, over["host"].eqNullSafe(sizes["host"])).where(F.col("n") > limit).select(over["host"], "line"), "quality-lines")
    lost = (
        held.join(common.withColumnRenamed("host", "h").withColumnRenamed("line", "l"), F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")))
        .groupBy("row")
        .agg(F.sum("words").alias("removed_words"), *([F.collect_set("line").alias("gone")] if with_text else []))
    )
    removed = F.coalesce("removed_words", F.lit(0)).cast("long")
    left = F.col("n_words") - F.col("removed_words")
    found = (
        measured.drop("lines", "line_words")
        .join(written(lost, "quality-lost"), "row", "left")
        .withColumn("removed_words", removed)
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
        .withColumn("depleted", (left < least_words) | (left < least_share * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
        .drop("row", "host")
    )
    if not with_text:
        return found
    found = found.select(*(c for c in found.columns if c not in ("text", "gone")), "text", "gone")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in [*found.schema][:-2]) + ", clean_text string"
    return found.mapInArrow(_cleaned, schema)
