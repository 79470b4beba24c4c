"""Operators against plain-Python versions of what they compute."""

import datetime
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from bindery.llm.multi_index import nearest
from bindery.llm.pseudonyms import COUNTRY_CODE, PATTERNS, pseudonymize
from bindery.llm.queries import table
from bindery.llm.toxicity import Model, buckets_of, score, words_of

from .helpers import corpus, frame

KEY = "some key"
SF = "/root/testdata/sf0.001"


def prf(kind, turn, value):
    return int(hashlib.sha256(f"{KEY}|{kind}|{turn}|{value}".encode()).hexdigest()[:12], 16)


def permuted(left, right, a, b, kind):
    for i in range(8):
        if i % 2 == 0:
            left = (left + prf(kind, i, right)) % a
        else:
            right = (right + prf(kind, i, left)) % b
    return left, right


def halves(digits, kind):
    """Digits permuted among those of their length."""
    u = len(digits) // 2
    v = len(digits) - u
    left, right = permuted(int(digits[:u] or 0), int(digits[u:]), 10**u, 10**v, kind)
    return (str(left).zfill(u) if u else "") + str(right).zfill(v)


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10


def filled(form, digits):
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in form)


def date(m, order, forms):
    parts = dict(zip(order, map(int, re.split("[./-]", m))))
    try:
        day = datetime.date(parts["y"], parts["m"], parts["d"])
    except ValueError:
        return None
    n = (day - datetime.date(1900, 1, 1)).days
    if not 0 <= n < 17 * 4297:
        return None
    left, right = permuted(n // 4297, n % 4297, 17, 4297, "date")
    new = datetime.date(1900, 1, 1) + datetime.timedelta(days=left * 4297 + right)
    short = re.search(r"(^|[./])\d[./]", m)
    return (forms[0] if short else forms[1]).format(y=new.year, m=new.month, d=new.day)


def pseudonym(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "mail":
        local, domain = m.split("@")
        half = len(local) // 2
        left, right = local[:half], local[half:]

        def moved(part, other, turn):
            out = ""
            for at, c in enumerate(part):
                low = 48 if c.isdigit() else 97 if "a" <= c <= "z" else 65 if "A" <= c <= "Z" else None
                out += c if low is None else chr((ord(c) - low + prf("mail", f"{turn}.{at}", other)) % (10 if low == 48 else 26) + low)
            return out

        for i in range(8):
            if i % 2 == 0:
                left = moved(left, right, i)
            else:
                right = moved(right, left, i)
        return f"{left}{right}@{domain}"
    if kind == "iso_date":
        return date(m, "ymd", ("{y:04}-{m:02}-{d:02}",) * 2)
    if kind == "us_date":
        return date(m, "mdy", ("{m}/{d}/{y:04}", "{m:02}/{d:02}/{y:04}"))
    if kind == "dot_date":
        return date(m, "dmy", ("{d}.{m}.{y:04}", "{d:02}.{m:02}.{y:04}"))
    if kind == "ip":
        o = list(map(int, m.split(".")))
        if max(o) > 255:
            return None
        left, right = permuted(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
        return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    if kind == "ssn":
        area, group, serial = map(int, m.split("-"))
        if not (1 <= area <= 899 and area != 666 and group and serial):
            return None
        left, right = permuted((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn")
        place = left // 99
        return f"{place + 1 + (place >= 665):03}-{left % 99 + 1:02}-{right + 1:04}"
    if kind == "phone":
        own = digits[1:] if len(digits) == 11 else digits
        left, right = permuted(int(own[:6]), int(own[6:]), 10**6, 10**4, "phone")
        return filled(m, ("1" if len(digits) == 11 else "") + f"{left:06}{right:04}")
    if kind == "foreign_phone":
        code = re.match(COUNTRY_CODE, digits)[0]
        return filled(m, code + halves(digits[len(code) :], "foreign_phone"))
    if luhn(digits):
        return None
    body = digits[0] + halves(digits[1:-1], "card")
    return filled(m, body + str((10 - luhn(body + "0")) % 10))


def brute(text):
    n = 0

    def one(m):
        nonlocal n
        new = pseudonym(m.lastgroup, m[0])
        n += new is not None
        return m[0] if new is None else new

    if text is None:
        return None, 0
    return re.sub("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()), one, text, flags=re.ASCII), n


def personal(n=150):
    rng = random.Random(9)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    make = [
        lambda: rng.choice(["4", "5", "3", "6"]) + d(rng.randrange(12, 19)),
        lambda: (x := "4" + d(14)) + str((10 - luhn(x + "0")) % 10),
        lambda: "-".join(["4111", "1111", "1111", "1111"]),
        lambda: f"{d(3)}-{d(2)}-{d(4)}",
        lambda: f"{rng.randrange(300)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}",
        lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}",
        lambda: f"({d(3)}) {d(3)} {d(4)}",
        lambda: f"{d(3)}.{d(3)}.{d(4)}",
        lambda: f"+{rng.choice(['44', '49 ', '351-', '7 '])}{d(3)} {d(3)}{d(rng.randrange(1, 5))}",
        lambda: f"{rng.randrange(1890, 2110)}-{rng.randrange(1, 14):02}-{rng.randrange(1, 32):02}",
        lambda: f"{rng.randrange(1, 14)}/{rng.randrange(1, 32)}/{rng.randrange(1890, 2110)}",
        lambda: f"{rng.randrange(1, 32):02}.{rng.randrange(1, 14):02}.{rng.randrange(1890, 2110)}",
        lambda: f"{rng.choice(['a', 'Jo.Doe9', 'x_y+z', 'q%7'])}@{rng.choice(['ex.org', 'a-b.example.com'])}",
        lambda: rng.choice(["\x01", "\x02", "\x03", "\x03\x05", "x", "é", "漢", "$1", "\\1"]),
    ]
    return ["".join(rng.choice([" ", ", ", " ", "", "\x01", "-"]) + rng.choice(make)() for _ in range(rng.randrange(1, 12))) for _ in range(n)] + [None, "", "plain", "\x01", "\x03\x04"]


def test_pseudonyms_against_plain_python(spark):
    texts = personal()
    got = {r["doc_id"]: (r["text"], r["n_values"]) for r in pseudonymize(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]), KEY).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t
    docs = table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pseudonymize(docs, KEY).collect():
        assert (r["text"], r["n_values"]) == brute(texts[r["doc_id"]])
    with pytest.raises(ValueError):
        pseudonymize(docs, "")


def test_scores_against_plain_python(spark):
    rng = random.Random(2)
    rows = corpus(40, 7)
    grams = sorted({b for _, t, _ in rows for w in words_of((t or "").encode()) for b in buckets_of(w)})
    model = Model({b: rng.uniform(-3, 3) for b in grams if rng.random() < 0.3}, -0.7)
    got = {r["doc_id"]: r["score"] for r in score(frame(spark, rows), model).collect()}
    for d, t, _ in rows:
        words = words_of((t or "").encode())
        margins = [sum(model.margins.get(b, 0.0) for b in buckets_of(w)) / len(buckets_of(w)) for w in words]
        assert got[d] == pytest.approx(1 / (1 + math.exp(-(model.bias + sum(margins) / max(1, len(words))))), abs=1e-9)


def cosines(vectors):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return unit @ unit.T


def test_nearest_recall_on_the_whole_table(spark):
    vectors = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = sorted((r["vec_id"], r["embedding"]) for r in vectors.collect() if r["embedding"] is not None)
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    asked = vectors.where("vec_id % 50 = 0").select("vec_id")
    near = cosines(x)
    np.fill_diagonal(near, -2)
    want = {int(ids[i]): set(ids[np.lexsort((ids, -near[i].round(12)))[:5]].tolist()) for i in np.flatnonzero(ids % 50 == 0)}
    for exact in (False, True):
        found: dict = {}
        for r in nearest(vectors, asked, exact=exact).collect():
            found.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert set(found) == set(want)
        recall = sum(len(found[q] & want[q]) for q in want) / (5 * len(want))
        assert recall == 1 if exact else recall >= 0.9


def test_nearest_of_huge_and_tiny_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8)) * np.array([1e200, 1e-170, 1.0, 1e-300, 5e307 / 8])[np.arange(60) % 5, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest(df, df.where("vec_id < 10").select("vec_id"), exact=True).collect()
    near = cosines(x / np.abs(x).max(axis=1, keepdims=True))
    np.fill_diagonal(near, -2)
    assert len(got) == 50
    for r in got:
        assert r["score"] == pytest.approx(near[r["query_id"], r["vec_id"]], abs=1e-12)
        assert np.argsort(-near[r["query_id"]])[r["rank"] - 1] == r["vec_id"]


def test_many_queries_of_one_vector(spark):
    df = spark.range(400).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 2 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.col("id").cast("double"), F.lit(1.0))).alias("embedding"))
    got = nearest(df, df.where("vec_id % 2 = 0").select("vec_id"))
    assert got.count() == 200 * 5
    assert {tuple(r) for r in got.where("query_id = 0").select("rank", "vec_id").collect()} == {(1, 2), (2, 4), (3, 6), (4, 8), (5, 10)}
