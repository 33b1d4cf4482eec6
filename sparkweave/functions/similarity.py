"""Similarities of strings and of token sets. Scores of strings run from 0 to 100."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave.functions.text import tokens


#: Pairs whose scores a worker remembers.
KNOWN = 100_000


def same_start(a: str, b: str) -> int:
    """How many characters two strings begin alike with."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def char_masks(a: str) -> dict[str, int]:
    """For each character the places it has in a, as bits."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def matched(masks: dict[str, int], m: int, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel: a zero bit of the row for each character matched."""
    full = row = (1 << m) - 1
    get = masks.get
    for c in b:
        if hit := row & get(c, 0):
            row = (row + hit | row - hit) & full
    return m - row.bit_count()


def common_subsequence(a: str, b: str) -> int:
    if len(a) > len(b):
        a, b = b, a
    n = same_start(a, b)
    a, b = a[n:], b[n:]
    k = same_start(a[::-1], b[::-1])
    a, b = a[: len(a) - k], b[: len(b) - k]
    return n + k + (matched(char_masks(a), len(a), b) if a else 0)


def indel(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths, in percent; 100 for two empty strings."""
    n = len(a) + len(b)
    return 100.0 if not n else 200.0 * common_subsequence(a, b) / n


def best_edge(masks: dict[str, int], m: int, b: str) -> float:
    """Best score against the starts of b that are shorter than m, all in one pass."""
    full = row = (1 << m) - 1
    best, got, get = 0.0, 0, masks.get
    for j, c in enumerate(b[: m - 1], 1):
        if hit := row & get(c, 0):
            row = (row + hit | row - hit) & full
            got = m - row.bit_count()
            best = max(best, 200.0 * got / (m + j))
    return best


def best_part(a: str, b: str) -> float:
    """Best score of the shorter string against windows of its length, and shorter ones at the edges of the longer; of two
    strings of one length either may be the shorter.

    From one window to the next the common subsequence changes by one at most, which bounds all windows between two known
    ones; only spans that may still hold a better one are halved.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    return windowed(a, b) if len(a) < len(b) else max(windowed(a, b), windowed(b, a))


def windowed(a: str, b: str) -> float:
    """best_part() of a that is no longer than b and not in it."""
    m, masks = len(a), char_masks(a)
    best = max(best_edge(masks, m, b), best_edge(char_masks(a[::-1]), m, b[::-1]))
    at = lambda i: matched(masks, m, b[i : i + m])
    last = len(b) - m
    first, final = at(0), at(last) if last else 0
    top = max(first, final)
    spans = [(-(first + final + last) // 2, 0, last, first, final)]
    while spans:
        bound, i, j, x, y = heapq.heappop(spans)
        if -bound <= top or -bound * 100.0 <= best * m or j - i < 2:
            if -bound <= top or -bound * 100.0 <= best * m:
                break
            continue
        mid = (i + j) // 2
        z = at(mid)
        top = max(top, z)
        for p, q, u, v in ((i, mid, x, z), (mid, j, z, y)):
            if q - p > 1:
                heapq.heappush(spans, (-((u + v + q - p) // 2), p, q, u, v))
    return max(best, 100.0 * top / m)


def word_sets(a: str, b: str) -> float:
    """Best of the common words, and them with either side's own words, against each other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = sorted(x & y)
    if both and len(both) in (len(x), len(y)):
        return 100.0
    left, right = (" ".join(both + sorted(w - set(both))) for w in (x, y))
    shared = len(" ".join(both))  # what both begin with is their common subsequence with either
    return max(indel(left, right), *(200.0 * shared / (shared + len(z)) for z in (left, right)))


def _known(score):
    known: dict[tuple[str, str], object] = {}

    def run(pair: tuple[str, str]):
        if pair not in known:
            if len(known) >= KNOWN:
                known.clear()
            known[pair] = score(pair[0] or "", pair[1] or "")
        return known[pair]

    return run


def _scored(score):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([*map(_known(score), zip(a, b))], dtype=float)

    return run


ratio = _scored(indel)
partial_ratio = _scored(best_part)
SCORES = T.StructType([T.StructField(c, T.DoubleType()) for c in ("ratio", "sort", "set", "partial")])


def all_scores(a: str, b: str) -> tuple[float, float, float, float]:
    return indel(a, b), sorted_indel(a, b), word_sets(a, b), best_part(a, b)


@F.pandas_udf(SCORES)
def string_scores(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The four scores of a pair of normalized strings at once, so that it reaches Python once."""
    return pd.DataFrame([*map(_known(all_scores), zip(a, b))], columns=SCORES.names, dtype=float)


def sorted_indel(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


@F.pandas_udf(T.StructType(SCORES.fields[:2]))
def two_scores(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The scores of strings and of sorted words."""
    return pd.DataFrame([*map(_known(lambda x, y: (indel(x, y), sorted_indel(x, y))), zip(a, b))], columns=SCORES.names[:2], dtype=float)


def sorted_words(text: Column) -> Column:
    return F.array_join(F.array_sort(tokens(text)), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio(sorted_words(a), sorted_words(b))


token_set_ratio = _scored(word_sets)


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(shared(a, b) / union)


def containment(a: Column, b: Column) -> Column:
    """Share of a's elements that are in b, with the small addend of the definition."""
    return F.when(F.size(a) == 0, 0.0).otherwise(shared(a, b) / (F.size(a) + 1e-5))


def overlap(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(shared(a, b) / least)
