"""Plain versions of pipeline stages."""

from test_ngram_join import brute
from test_small_operators import brute_lines


def lines_of(rows):
    before, after = dict(rows), brute_lines(rows)
    return {i: t for i, t in after.items() if t == before[i] or (t or "").strip()}


def near_of(rows, k, percent):
    return {i for i, (_, c) in brute(rows, k, percent).items() if i == c}
