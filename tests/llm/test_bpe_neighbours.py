"""What the encoder asks about tokens that stand side by side."""

import random

from bindery.llm.bpe_trie import END, SYMBOLS, TrieEncoder
from bindery.llm.queries import TOKENIZERS

PATH = f"{TOKENIZERS}/word_bpe_49k.json"


def encoder():
    with open(PATH, encoding="utf-8") as f:
        return TrieEncoder(f.read())


def some_words():
    rng = random.Random(4)
    letters = ["e", "t", "a", "o", "n", "i", "s", "r", "h", "th", "ing", "é", "ß", "q", "漢"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(3000)]


def test_the_shortest_token_is_taken_unasked():
    from tokenizers import Tokenizer

    own, asked = encoder(), []
    ask = own.may_follow
    own.may_follow = lambda left, right, known: asked.append(right) or ask(left, right, known)
    words = some_words()
    symbols = [w if w.isascii() else w.encode().decode("latin-1").translate(SYMBOLS) for w in words]
    coded, library = own.encode_words(symbols), Tokenizer.from_file(PATH)
    for word, spelled in zip(words, symbols):
        ids = library.encode(word, add_special_tokens=False).ids
        assert coded[spelled] == b"".join(i.to_bytes(4, "little") for i in ids)
    assert asked and all(len(t.removesuffix(END)) > 1 for t in asked)


def test_crossing_merges_are_those_of_all_pairs_of_parts():
    own, rng = encoder(), random.Random(8)
    rank = {(x, y): r for x, joined in own.joins.items() for y, r in joined.items()}
    inf = float("inf")

    def spine(token, side):
        out = [(token, inf)]
        while token in own.parts:
            pair = own.parts[token]
            token = pair[side]
            out.append((token, rank[pair]))
        return out

    lefts, rights, seen = sorted(own.inner), sorted(own.inner) + [t + END for t in sorted(own.final)], set()
    for _ in range(20_000):
        left, right = rng.choice(lefts), rng.choice(rights)
        found = [r for x, gone in spine(left, 1) for y, late in spine(right, 0) if (r := rank.get((x, y))) is not None and r < gone and r <= late]
        assert own._crossed(left, right, inf) == bool(found)
        seen.add(bool(found))
    assert seen == {True, False}
