"""Sorting and front coding of the rows that blocks send."""

import numpy as np

from bindery.llm import repeats


def parcels_of(rows, cuts):
    """Distinct sorted rows for each run, coded, and as they are."""
    order, new = repeats.sort_bytes(rows)
    rows = rows[order[new]]
    starts = [c for c in cuts if c < len(rows)]
    return rows, starts, repeats.front_code(rows, starts)


def test_front_coded_runs_give_their_rows_back():
    rng = np.random.default_rng(5)
    for n, width, top in ((0, 21, 3), (1, 21, 3), (4000, 21, 2), (4000, 20, 256), (300, 55, 2)):
        rows, starts, coded = parcels_of(rng.integers(0, top, (n, width), np.uint8), [0, 1, 7, 100])
        counts = [b - a for a, b in zip(starts, [*starts[1:], len(rows)])]
        assert not coded if not n else (repeats.front_decode(coded, counts, width) == rows).all()


def test_numbers_share_the_bytes_that_their_rows_share():
    rng = np.random.default_rng(6)
    for n, width, top in ((0, 24, 3), (1, 24, 3), (5000, 24, 2), (5000, 16, 3), (5000, 8, 256)):
        rows = rng.integers(0, top, (n, width), np.uint8)
        rows[n // 2 :] = rows[: n - n // 2]
        rows = rows[repeats.sort_bytes(rows)[0]]
        assert (repeats.shared_bytes(repeats.big_endian(rows)) == repeats.common_prefixes(rows)).all()
