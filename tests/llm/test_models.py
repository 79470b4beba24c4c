import gc
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bindery.llm import bpe_trie
from bindery.llm.common import worker_state
from bindery.llm.multi_index import close_enough, learn_codes, nearest
from bindery.llm.queries import TOKENIZERS, held_out, op5_toxicity
from bindery.llm.toxicity import Model, buckets_of, fit, score, train

from .helpers import empty, frame


def labelled(n=900, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(10, 60))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["zzidiotic", "moronwz", "Zzidiots!", "moronwx"]))
        rows.append((i, " ".join(w), "s"))
        labels.append((i, toxic))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = labelled()
    docs = frame(spark, [*rows, (None, "zzidiotxy", "s"), (5000, None, "s"), (5001, "", "s")])
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = train(docs, table.where(~held_out()))
    got = score(docs, model, keep=docs.columns).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[5000] == by[5001] < 0.3
    out = [(by[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((s >= 0.3) == bool(y) for s, y in out)
    assert right >= 0.97 * len(out)
    unseen = score(frame(spark, [(1, "abc zzidiotics def", "s"), (2, "abc def", "s")]), model).collect()
    scores = {r["doc_id"]: r["score"] for r in unseen}
    assert scores[1] > 0.3 > scores[2]  # an unseen form shares n-grams
    again = train(docs, table.where(~held_out()))
    assert again == model


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "a b", "s"), (2, None, "s")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [round(r["score"], 6) for r in score(docs, train(docs, none)).collect()] == [0.5, 0.5]
    assert score(empty(spark), Model({}, 0.0)).count() == 0
    nulls = spark.createDataFrame([(None, 1), (1, None), (1, 1), (1, 0)], "doc_id long, toxic int")
    assert train(docs, nulls).margins == {}
    assert fit([], []).bias == 0
    assert len(buckets_of(b"ab")) == len(set(buckets_of(b"ab")))


def test_toxicity_held_out_mark(spark):
    got = spark.range(50).select("id", held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)
    r = op5_toxicity(spark, "/root/testdata/sf0.001")
    assert r.columns == ["doc_id", "held_out", "score", "predicted"]


def brute(vectors, queries, k):
    ids = [i for i, v in vectors if v is not None and len(v) == len(vectors[0][1]) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = {i: np.array(v, float) for i, v in vectors if i in set(ids)}
    out = {}
    for q in queries:
        if q in x:
            s = [(-(x[q] @ x[i]) / np.linalg.norm(x[q]) / np.linalg.norm(x[i]), i) for i in x if i != q]
            out[q] = [i for _, i in sorted((round(a, 12), i) for a, i in s)[:k]]
    return out


def test_nearest_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 32))
    vectors = [(i, (centres[i % 8] * (i % 3) + rng.normal(size=32)).astype(np.float32).astype(float).tolist()) for i in range(600)]
    hot = rng.normal(size=32).astype(np.float32).astype(float).tolist()
    vectors += [(1000 + i, hot) for i in range(120)]  # many equal vectors: ties by id
    vectors += [(2000 + i, (np.array(hot) + rng.normal(size=32) * 0.01).astype(np.float32).astype(float).tolist()) for i in range(60)]
    vectors += [(3000, [0.0] * 32), (3001, None), (3002, [1.0] * 31), (3003, [float("nan")] * 32), (3004, [None] + [1.0] * 31), (3005, [float("inf")] * 32)]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, rank int")
    asked = [i for i, _ in vectors if i % 20 == 0 or i >= 3000]
    got = nearest(df, df.where(F.col("vec_id").isin(asked)).select("vec_id")).collect()
    found: dict = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute(vectors, asked, 5)
    assert set(found) == set(want) and all(len(v) == 5 for v in found.values())
    hits = sum(len(set(found[q]) & set(want[q])) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    assert found[1000] == [1001, 1002, 1003, 1004, 1005] and found[1100] == [1000, 1001, 1002, 1003, 1004]
    x = {i: np.array(v, float) for i, v in vectors if v is not None and i < 3000}
    for r in got:
        a, b = x[r["query_id"]], x[r["vec_id"]]
        assert abs(r["score"] - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_nearest_of_few(spark):
    schema = "vec_id long, embedding array<double>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], schema)
    got = sorted(map(tuple, nearest(few, few.where("vec_id = 0").select("vec_id")).collect()))
    assert [r[:3] for r in got] == [(0, 1, 1), (0, 2, 2)] or [r[:3] for r in got][:1] == [(0, 1, 1)]
    one = few.where("vec_id = 0")
    assert nearest(one, one.select("vec_id")).count() == 0
    none = spark.createDataFrame([], schema)
    assert nearest(none, none.select("vec_id")).count() == 0
    assert nearest(few, none.select("vec_id")).count() == 0


def test_codes():
    centre, projection = learn_codes(np.random.default_rng(0).normal(size=(200, 16)))
    assert projection.shape == (16, 64) and centre.shape == (16,)
    assert 0 < close_enough(7) < close_enough(3) < 1


def test_trimmed_encoder_leaves_nothing_to_a_collector(monkeypatch):
    encoder = bpe_trie.TrieEncoder(Path(f"{TOKENIZERS}/word_bpe_49k.json").read_text())
    states = lambda: sum(isinstance(x, bpe_trie.State) for x in gc.get_objects())
    gc.collect()
    gc.disable()
    try:
        encoder.encode_words(["abracadabra", "banana", "cancan", "mississippi"])
        assert states() > 20
        monkeypatch.setattr(bpe_trie, "CACHE_STATES", 0)
        encoder.trim()
        assert states() == 0
    finally:
        gc.enable()


def test_encoder_keeps_what_is_met_again(monkeypatch):
    spec = Path(f"{TOKENIZERS}/word_bpe_49k.json").read_text()
    monkeypatch.setattr(bpe_trie, "PIECE_BYTES", 2_000)
    monkeypatch.setattr(bpe_trie, "CACHE_WORDS", 20)
    monkeypatch.setattr(bpe_trie, "CACHE_SPINES", 10, raising=False)
    texts = [f"often Again {i}x{i} often again {' '.join(f'only{i}w{j}' for j in range(100))}" for i in range(12)]
    texts[5:5] = [" ".join(f"pair{j} pair{j}" for j in range(30)), "", None]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    got = pa.Table.from_batches(bpe_trie._encode(spec, iter([batch]), 50))
    kept = worker_state("bpe_trie")
    held = kept["packed"] | kept.get("older", {})
    assert "often" in held and len(held) < 50 and not any(w.startswith("only") for w in held)
    assert len(kept["encoder"].spines) < 3_000
    library = Tokenizer.from_str(spec)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x.as_py(), "<u4").tolist() for x in got["ids"]] == want
    assert [x.as_py() for x in got["decoded"]] == [library.decode(x, skip_special_tokens=False) for x in want]
