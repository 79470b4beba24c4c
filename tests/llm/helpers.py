"""Small tables with the awkward cases, and brute-force versions."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use themselves, or did.
CLASHES = "_id _doc _rules _found _text _masked _hash _copy id doc rules found parts masked own turn below times size s row line lines host word words fp cell point component known none label target".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int, hash long, copies int, " + ", ".join(f"{n} string" for n in CLASHES)


def words(text):
    return WORD.findall(text or "")


def frame(spark, rows, schema="doc_id long, text string, source string"):
    """Documents with extra columns that clash with names the operators use."""
    full = [(d, t, "en", s, len(t or ""), 0.5, 1, 7, 9, *CLASHES) for d, t, s in rows]
    return spark.createDataFrame(full, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def corpus(n=60, seed=3):
    """Random texts with copies, near copies, shared passages, nulls, empty and long texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = text(40)
    rows = []
    for i in range(n):
        t = text(rng.choice([0, 1, 5, 30, 120]))
        if i % 5 == 0:
            t = t + "\n" + passage + " " + text(10)
        if i % 7 == 0 and rows:
            t = rng.choice(rows)[1] or ""
        if i % 11 == 0 and t:
            w = t.split(" ")
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        rows.append((i, t, f"s{i % 4}" if i % 9 else None))
    rows += [(n, None, "s1"), (n + 1, "", "s2"), (n + 2, " \t\n\v\f\r ", "s2"), (n + 3, text(6000), "s0"), (n + 4, (passage + " ") * 30, "s0")]
    rows += [(n + 5, "ab cd " * 200, "s3"), (n + 6, "İstanbul ﬁ é ½ 漢字 'S don't <|endoftext|>x \x85 y", "s3")]
    rng.shuffle(rows)
    return rows
