"""A block of fewer bytes than a window."""

import numpy as np

from bindery.llm import repeats
from bindery.llm.suffix_array import remove_repeats

from .helpers import frame


def test_one_text_of_40_bytes(spark):
    for n in (29, 30, 40, 49):
        row = remove_repeats(frame(spark, [(1, ("abcdefghij" * 5)[:n], "s")])).first()
        assert (row["n_bytes"], bytes(row["kept"])) == (n, (b"abcdefghij" * 5)[:n])


def test_mixed_rows_are_sorted_as_strings_are():
    rng = np.random.default_rng(3)
    for n, width, top in ((0, 21, 3), (1, 21, 3), (5000, 21, 2), (5000, 9, 3), (5000, 8, 3), (3000, 30, 256)):
        rows = rng.integers(0, top, (n, width), np.uint8)
        rows[n // 2 :] = rows[: n - n // 2]
        (order, new), (right, right_new) = repeats.sort_mixed(rows), repeats.sort_bytes(rows)
        assert sorted(order) == list(range(n)) and (rows[order] == rows[right]).all() and (new == right_new).all()
