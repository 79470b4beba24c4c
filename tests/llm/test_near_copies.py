"""The near-dedup stage against all pairs."""

import random
from pathlib import Path

import corpus_pipeline as pipeline
import numpy as np
from bindery.llm import common, near_copies, simhash
from pyspark.sql import functions as F

from .helpers import frame


def grams(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)}


def edited(rng, text, times):
    w = text.split()
    for _ in range(times):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_edited_copies_go(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choices(vocabulary, k=15))
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(3, 250))) + (" " + line if i % 2 else "") for i in range(60)]
    texts += ["", None, "  ", "one two", "One  TWO", "one two three", "same " * 9, "same " * 12, texts[3].upper(), texts[4], texts[4]]
    texts += [edited(rng, texts[i % 60], rng.randint(1, 5)) for i in range(120)]
    crowd = " ".join(rng.choices(vocabulary, k=120))
    other = crowd.split()[:70] + rng.choices(vocabulary, k=50)  # half way between similar and not
    texts += [edited(rng, crowd, rng.randint(0, 6)) for _ in range(120)] + [edited(rng, " ".join(other), rng.randint(0, 5)) for _ in range(60)]
    texts += [" ".join(crowd.split()[: 120 - i] + other[120 - i :]) for i in range(0, 50, 3)]  # a chain between the two
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    edits = 0
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                edits += sets[a] != sets[b]
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert edits > 30
    kept = pipeline.drop_near_duplicates(spark, frame(spark, [(i, t, "s") for i, t in enumerate(texts)]), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({find(i) for i in range(len(texts))})


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    rows = [(3, "a text that others copy word by word", "s"), (5, "nothing like it is found anywhere else here", "s"), (5, "a text that others copy word by word", "s")]
    rows += [(7, "twice the same row of one id", "b"), (7, "twice the same row of one id", "a"), (None, "no id", "s"), (None, "no id", "s")]
    kept = pipeline.drop_near_duplicates(spark, frame(spark, rows), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"], r["source"]) for r in kept) == sorted((d or 0, t, s) for d, t, s in rows[:2] + rows[4:6])  # copies without an id are copies too


def test_fingerprints_link_similar_sets(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choices(words, k=400) for _ in range(5)]
    texts = [" ".join(b) for b in base] + [edited(rng, " ".join(base[i % 5]), 1) for i in range(30)]
    sets = [near_copies.shingles(t.encode()) for t in texts]
    fps = [simhash.majority(s) for s in sets]
    bits = [[b >> i & 1 for b in map(int, sets[0])] for i in range(64)]
    assert fps[0] & (1 << 64) - 1 == sum((2 * sum(b) > len(b)) << i for i, b in enumerate(bits))
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "id long, fp long")
    met = {(r["a"], r["b"]) for r in simhash.meetings(rows).collect()}
    apart = lambda a, b: bin((fps[a] ^ fps[b]) & (1 << 64) - 1).count("1")
    close = [(a, b) for a in range(35) for b in range(a) if apart(a, b) <= 5]
    assert len(close) > 50 and all((a, b) in met or any({(a, c), (b, c)} <= met for c in range(b)) for a, b in close)
    lists = [(i, f, near_copies._parities(s).tolist(), s.view(np.int64).tolist()) for i, (f, s) in enumerate(zip(fps, sets))]
    frame_ = spark.createDataFrame(lists, "set long, fp long, parities array<long>, names array<long>").withColumn("n", F.size("names"))
    linked = {(r["a"], r["b"]) for r in near_copies.by_fingerprints(frame_).collect()}
    assert linked and all(5 * len(grams(texts[a]) & grams(texts[b])) >= 4 * len(grams(texts[a]) | grams(texts[b])) for a, b in linked)
    for a in range(35):
        for b in range(a):
            differ = sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(lists[a][2], lists[b][2]))
            assert differ <= len(np.setxor1d(sets[a], sets[b]))


def tables(spark):
    """Names of the tables that lie in the shared folder."""
    return {p.name for p in Path(common.shared_dir(spark), spark.sparkContext.applicationId).iterdir()}


def test_tables_of_the_stage_go_once_they_are_used(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdefghijk", k=60)) for _ in range(20)]
    rows = frame(spark, [(i, t, "s") for i, t in enumerate(texts + [edited(rng, t, 1) for t in texts] + texts[:5])])
    common.written(rows.select("doc_id"), "first")  # the folder is there
    before = tables(spark)
    kept = pipeline.drop_near_duplicates(spark, rows, "")
    left = {name.rsplit("-", 1)[0] for name in tables(spark) - before}
    assert kept.count() == 20 and "pipeline-others" in left
    assert not [name for name in left if name.split("-")[0] in ("blocks", "near", "cc", "simhash")]


def test_a_settled_table_outlives_what_it_was_made_of(spark):
    common.written(spark.range(1), "first")
    before = tables(spark)
    one = lambda: common.written(spark.range(4), "on-way").where("id > 1")
    two = lambda: common.settled(one, "inner").union(common.written(spark.range(1), "on-way"))
    out = common.settled(two, "outer")
    assert sorted(r["id"] for r in out.collect()) == [0, 2, 3]
    assert [name.rsplit("-", 1)[0] for name in tables(spark) - before] == ["outer"]


def test_only_rows_that_may_go_are_joined(spark):
    rows = spark.range(-20_000, 20_000).select(F.col("id"), F.xxhash64("id").alias("hash"), F.lit("b").alias("bucket"), F.lit("m").alias("marks"))
    gone = common.written(rows.where("pmod(id, 40) = 3").select("id", "hash"), "gone")
    wanted = [i for i in range(-20_000, 20_000) if i % 40 != 3]
    for most in (common.MOST_BITS, 64):  # the least there are is 2**15
        stay, others = common.parted(rows, gone, "hash", most)
        ids, rest = {r["id"] for r in stay.collect()}, {r["id"] for r in others.collect()}
        assert ids <= set(wanted) and len(ids) + len(rest) == 40_000 and stay.columns == others.columns == rows.columns
        assert len(ids) > 35_000
    assert sorted(r["id"] for r in common.without(rows, gone, ["id", "hash"], "hash").collect()) == wanted
    # two rows of one hash, of which one goes; nothing to go
    same = rows.select("id", F.lit(7).cast("long").alias("hash"))
    left = common.without(same, common.written(same.where("id = 5"), "gone"), ["id", "hash"], "hash")
    assert left.count() == 39_999 and not left.where("id = 5").count()
    assert common.without(rows, common.written(gone.where("id > 99999"), "gone"), ["id", "hash"], "hash").count() == 40_000
