"""String similarities."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    free, mine = [True] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == ch:
                free[j] = False
                mine.append(ch)
                break
    if not mine:
        return 0.0
    theirs = [ch for ch, f in zip(b, free, strict=True) if not f]
    m, swaps = len(mine), sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


#: Strings up to this length are compared many at a time, so many as stay in a core's cache.
SHORT, AT_A_TIME = 64, 4096


def _jaro_winklers(a: list[str], b: list[str]) -> np.ndarray:
    """_jaro_winkler of each two non-empty strings, place by place over all of them."""
    n, la, lb = len(a), np.array([len(x) for x in a]), np.array([len(x) for x in b])
    x, y = (np.array(s, f"<U{width.max()}").view(np.uint32).reshape(n, -1) for s, width in ((a, la), (b, lb)))
    xt, yt, reach = x.T.copy(), y.T.copy(), np.maximum(la, lb) // 2 - 1
    free, mine, far = np.arange(len(yt))[:, None] < lb, np.zeros(xt.shape, bool), int(reach.max())
    near = [reach >= d for d in range(far + 1)]
    for i in range(len(xt)):
        open_ = i < la
        for j in range(max(0, i - far), min(len(yt), i + far + 1)):
            hit = xt[i] == yt[j]
            hit &= free[j]
            hit &= open_
            hit &= near[abs(i - j)]
            free[j] ^= hit
            open_ ^= hit
            mine[i] |= hit
    used = (np.arange(len(yt))[:, None] < lb) & ~free
    m = mine.sum(axis=0)
    differ = x[mine.T] != y[used.T]
    swaps = np.bincount(np.repeat(np.arange(n), m)[differ], minlength=n) // 2
    some = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / la + m / lb + (m - swaps) / some) / 3, 0.0)
    prefix, same = np.zeros(n), np.ones(n, bool)
    for i in range(min(4, len(xt), len(yt))):
        same &= (xt[i] == yt[i]) & (i < la) & (i < lb)
        prefix += same
    out = np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)
    return np.where([p == q for p, q in zip(a, b, strict=True)], 1.0, out)


@F.pandas_udf(DoubleType())
def _jw(a: pd.Series, b: pd.Series) -> pd.Series:
    out, x, y = np.zeros(len(a)), a.to_list(), b.to_list()
    there = [k for k in range(len(x)) if x[k] and y[k]]
    short = [k for k in there if len(x[k]) <= SHORT and len(y[k]) <= SHORT]
    for at in range(0, len(short), AT_A_TIME):
        some = short[at : at + AT_A_TIME]
        out[some] = _jaro_winklers([x[k] for k in some], [y[k] for k in some])
    if len(short) < len(there):
        for k in there:
            if len(x[k]) > SHORT or len(y[k]) > SHORT:
                out[k] = _jaro_winkler(x[k], y[k])
    return pd.Series(out)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Of the lower-cased strings; 0 if one is null or empty."""
    return _jw(F.lower(a), F.lower(b))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def gestalt(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of the lower-cased strings."""
    return _ratio(F.lower(a), F.lower(b))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def token_set(a: Column) -> Column:
    """The different white-space-separated lower-cased tokens."""
    return F.array_distinct(F.array_remove(F.split(F.lower(a), r"\s+"), ""))


def set_jaccard(x: Column, y: Column) -> Column:
    """Of two arrays without repeats; 0 for two empty ones and for null."""
    both = F.size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(both, F.size(x) + F.size(y) - both), F.lit(0.0))


def token_jaccard(a: Column, b: Column) -> Column:
    """Of the sets of white-space-separated lower-cased tokens; 0 for two empty ones."""
    return set_jaccard(token_set(a), token_set(b))


def watchlist_score(a: Column, b: Column) -> Column:
    """0.4 token Jaccard + 0.6 Levenshtein ratio."""
    return 0.4 * token_jaccard(a, b) + 0.6 * levenshtein_ratio(a, b)


def phonetic(name: Column) -> Column:
    """First four letters, upper-cased."""
    return F.upper(F.substring(name, 1, 4))
