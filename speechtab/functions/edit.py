"""Edit distances and alignments over words and characters.

Word distances are an Arrow UDF that works on the bits of arbitrary-precision integers, so a pair of n and m words takes
m steps over n bits. For short pairs there is a form within the JVM: words are mapped to single characters, as only
equality counts, for the built-in ``levenshtein``. Alignments and distances against bins of alternatives are Arrow UDFs
too: dynamic programming by rows, each row a few vector operations (the running minimum of value minus place does the
insertions).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _encoded(tokens: Column, vocabulary: Column) -> Column:
    """One character per token: its place in the vocabulary, as a code point from U+10000 on (surrogate pairs)."""

    def char(w: Column) -> Column:
        n = F.array_position(vocabulary, w) - 1
        high = F.lit(0xD800) + F.floor(n / 1024)
        return F.decode(F.unhex(F.concat(F.hex(high.cast("long")), F.hex((F.lit(0xDC00) + n % 1024).cast("long")))), "UTF-16BE")

    return F.array_join(F.transform(tokens, char), "")


def word_distance(reference: Column | str, hypothesis: Column | str) -> Column:
    """Word edit distance of two token arrays."""
    return F.pandas_udf(_pair_distances, "long")(reference, hypothesis)


def _pair_distances(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    return pd.Series([distance(list(r), list(h)) for r, h in zip(reference, hypothesis, strict=True)], dtype="int64")


def word_distance_native(reference: Column, hypothesis: Column) -> Column:
    """The same within the JVM; mapping a word is a scan of the pair's vocabulary, so it suits short texts."""
    vocabulary = F.array_distinct(F.concat(reference, hypothesis))
    return F.levenshtein(_encoded(reference, vocabulary), _encoded(hypothesis, vocabulary)).cast("long")


def char_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Character edit distance over the reference's length, spaces left out; 0 or 1 for an empty reference."""
    r, h = (F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit("")) for c in (reference, hypothesis))
    n = F.length(r)
    return F.when(n == 0, F.when(F.length(h) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(r, h) / n)


def _row(before: np.ndarray, equal: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The next row of the distance table; ``equal``: where the row's word matches."""
    now = before + 1
    np.minimum(now[1:], before[:-1] + ~equal, out=now[1:])
    return np.minimum.accumulate(now - places) + places


def _codes(*sides: list[str]) -> list[np.ndarray]:
    known: dict[str, int] = {}
    return [np.array([known.setdefault(w, len(known)) for w in s], dtype=np.int64) for s in sides]


def distance(reference: list[str], hypothesis: list[str]) -> int:
    """Word edit distance, a whole column of the table at once: bit i of ``up`` and ``down`` tells whether the value at i
    is one more, or one less, than the value before it."""
    low, ends = 0, min(len(reference), len(hypothesis))
    while low < ends and reference[low] == hypothesis[low]:
        low += 1
    high = 0
    while high < ends - low and reference[-1 - high] == hypothesis[-1 - high]:
        high += 1
    r, h = reference[low : len(reference) - high], hypothesis[low : len(hypothesis) - high]
    if not r or not h:
        return len(r) + len(h)
    where: dict[str, int] = {}
    for i, w in enumerate(r):
        where[w] = where.get(w, 0) | 1 << i
    every, last, value = (1 << len(r)) - 1, len(r) - 1, len(r)
    up, down = every, 0
    for w in h:
        match = where.get(w, 0) | down
        same = ((up + (match & up)) ^ up) | match  # the value equals the one diagonally before it
        more, less = down | (every & ~(up | same)), up & same  # against the value of the column before
        value += (more >> last & 1) - (less >> last & 1)
        more = more << 1 | 1
        up, down = (less << 1 | (every & ~(same | more))) & every, more & same & every
    return value


def bin_distance(bins: list[list[str]], hypothesis: list[str]) -> int:
    """Edit distance where a word matches any word of the bin at its place."""
    h = np.array(hypothesis, dtype=object)
    places = np.arange(len(h) + 1)
    row = places.copy()
    for b in bins:
        row = _row(row, np.isin(h, list(b)) if len(h) else np.zeros(0, bool), places)
    return int(row[-1])


def alignment(reference: list[str], hypothesis: list[str]) -> str:
    """Operations M, S, I, D; of equal costs, a deletion goes before an insertion before a substitution.

    Only every ``sqrt(n)``-th row of the table is kept; the rows between are made again for the way back.
    """
    r, h = _codes(reference, hypothesis)
    n, m = len(r), len(h)
    places = np.arange(m + 1)
    step = max(1, int(np.sqrt(n)))
    row, kept = places.copy(), [places.copy()]
    for i, w in enumerate(r, 1):
        row = _row(row, h == w, places)
        if i % step == 0:
            kept.append(row)
    out, i, j, low, rows = [], n, m, n + 1, []
    while i or j:
        if i and i - 1 < low:  # the rows from the last kept one below i
            low = (i - 1) // step * step
            rows = [kept[low // step]]
            for w in r[low : min(low + step, n)]:
                rows.append(_row(rows[-1], h == w, places))
        if i and j and r[i - 1] == h[j - 1]:
            out.append("M")
            i, j = i - 1, j - 1
        elif not j or (i and rows[i - 1 - low][j] + 1 == rows[i - low][j]):
            out.append("D")
            i -= 1
        elif not i or rows[i - low][j - 1] + 1 == rows[i - low][j]:
            out.append("I")
            j -= 1
        else:
            out.append("S")
            i, j = i - 1, j - 1
    return "".join(reversed(out))


def align(reference: Column | str, hypothesis: Column | str) -> Column:
    """Alignment strings of two token arrays."""
    return F.pandas_udf(_alignments, "string")(reference, hypothesis)


def _alignments(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    return pd.Series([alignment(list(r), list(h)) for r, h in zip(reference, hypothesis, strict=True)])


def lattice_distance(bins: Column | str, hypothesis: Column | str) -> Column:
    """Distance of a token array to a lattice (array of arrays of words)."""
    return F.pandas_udf(_bin_distances, "long")(bins, hypothesis)


def _bin_distances(bins: pd.Series, hypothesis: pd.Series) -> pd.Series:
    return pd.Series([bin_distance([list(x) for x in b], list(h)) for b, h in zip(bins, hypothesis, strict=True)], dtype="int64")
