"""Similarities of names in [0, 1]; JVM-side but for Jaro-Winkler, which no built-in expresses."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinledger.functions.text import acronym, common_prefix_length, tokens


def _grams(padded: Column) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1)))
    return F.array_distinct(F.filter(F.transform(starts, lambda i: F.substring(padded, i, F.lit(3))), lambda g: F.length(g) == 3))


def trigrams(c: Column) -> Column:
    """Set of 3-grams of the whole string, two blanks in front and one behind."""
    return _grams(F.concat(F.lit("  "), F.lower(F.trim(c)), F.lit(" ")))


def plain_words(c: Column) -> Column:
    """Lower-case words of letters and digits, one blank between them."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def word_trigrams(c: Column) -> Column:
    """Set of 3-grams with every word padded on its own, as the SQL search counts them."""
    words = tokens(plain_words(c))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: _grams(F.concat(F.lit("  "), w, F.lit(" "))))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets given as arrays; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def pg_similarity(a: Column, b: Column) -> Column:
    """32-bit, as the SQL functions return it."""
    return jaccard(word_trigrams(a), word_trigrams(b)).cast("float")


def token_jaccard(a: Column, b: Column) -> Column:
    return jaccard(F.array_distinct(tokens(a)), F.array_distinct(tokens(b)))


def token_containment(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    smaller = F.least(F.size(x), F.size(y))
    return F.when(smaller == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / smaller)


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def length_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(F.least(F.length(a), F.length(b)) / longest)


def prefix_ratio(a: Column, b: Column) -> Column:
    shortest = F.least(F.length(a), F.length(b))
    return F.when(shortest == 0, 0.0).otherwise(common_prefix_length(a, b) / shortest)


def digit_agreement(a: Column, b: Column) -> Column:
    """Tokens with digits: 1 if neither side has any, 0 if only one has, else the share of the longer list."""
    x, y = (F.filter(v, lambda t: t.rlike("[0-9]")) for v in (a, b))
    shared = F.size(F.filter(x, lambda t: F.array_contains(y, t)))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(shared / F.greatest(F.size(x), F.size(y)))


def acronym_match(core_a: Column, full_a: Column, core_b: Column, full_b: Column) -> Column:
    """Either side is the initials (two or more) of the other, of its core or of its full name."""
    squash = lambda c: F.regexp_replace(c, " ", "")
    hit = lambda words, other: (F.length(acronym(tokens(words))) >= 2) & (acronym(tokens(words)) == squash(other))
    return (hit(core_a, core_b) | hit(full_a, core_b) | hit(core_b, core_a) | hit(full_b, core_a)).cast("int")


def jaro(a: str, b: str) -> float:
    """Jaro with transpositions halved but not rounded."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    if a.isascii() and b.isascii() and "\0" not in a:
        # used letters become 0, so that the search for the next free one is the engine's
        held, met = bytearray(b, "ascii"), bytearray()
        for i, ch in enumerate(a.encode()):
            j = held.find(ch, max(0, i - reach), i + reach + 1)
            if j >= 0:
                held[j] = 0
                met.append(ch)
        m = len(met)
        if not m:
            return 0.0
        moved = sum(x != y for x, y in zip(met, (x for x, left in zip(b.encode(), held, strict=True) if left != x), strict=True)) / 2
        return (m / len(a) + m / len(b) + (m - moved) / m) / 3
    free = [True] * len(b)
    ours = []
    for i, ch in enumerate(a):
        j = next((k for k in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[k] and b[k] == ch), None)
        if j is not None:
            free[j] = False
            ours.append(ch)
    m = len(ours)
    if not m:
        return 0.0
    theirs = [ch for ch, f in zip(b, free, strict=True) if not f]
    moved = sum(x != y for x, y in zip(ours, theirs, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler_text(a: str, b: str) -> float:
    """A common prefix of up to 4 characters lifts any score above 0 by a tenth each of what is missing."""
    score = jaro(a, b)
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return score + same * 0.1 * (1 - score) if score else 0.0


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Null if either side is."""
    return pd.Series([None if x is None or y is None else jaro_winkler_text(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@lru_cache(maxsize=100_000)
def _sets(text: str) -> tuple[frozenset[str], frozenset[str]]:
    """Words and 3-grams as :func:`tokens` and :func:`trigrams` have them, made once a text."""
    padded = f"  {text.strip(' ').lower()} "
    return frozenset(t for t in text.split(" ") if t), frozenset(padded[i : i + 3] for i in range(len(padded) - 2))


@F.pandas_udf(T.DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The larger of :func:`token_jaccard` and :func:`trigram_similarity`, for many pairs of few texts; null if either is."""
    out = []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        best = 0.0
        for p, q in zip(_sets(x), _sets(y), strict=True):
            if shared := len(p & q):
                best = max(best, shared / (len(p) + len(q) - shared))
        out.append(best)
    return pd.Series(out, dtype="float64")
