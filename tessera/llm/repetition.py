"""Repetition inside a text: suffix array, common-prefix values, union of maximal repeats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = "\x20\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
KIND = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "n_later", "longest_repeat")])


def suffix_order(key: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of a sequence, and ranks by the first 1, 2, 4, ... elements.

    Only groups that are still tied are sorted again, by the rank of what follows (prefix doubling).
    Ranks are the places where a group starts; they are equal just where the prefixes are.
    """
    n = len(key)
    sa = np.argsort(key, kind="stable")
    head = np.ones(n, bool)
    head[1:] = key[sa[1:]] != key[sa[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    levels, step = [rank.copy()], 1
    tied = np.flatnonzero(~head | ~np.append(head[1:], True))
    while len(tied):
        s = sa[tied]
        then = np.zeros(len(s), np.int64)
        ok = s + step < n
        then[ok] = rank[s[ok] + step] + 1
        k = rank[s] * (n + 1) + then
        o = np.argsort(k, kind="stable")
        s, k = s[o], k[o]
        sa[tied] = s
        head = np.ones(len(k), bool)
        head[1:] = k[1:] != k[:-1]
        rank[s] = tied[np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))]
        levels.append(rank.copy())
        tied = tied[~head | ~np.append(head[1:], True)]
        step *= 2
    return sa, levels


def common_prefixes(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Elements that neighbours in the suffix array share at their start; [i] is of sa[i - 1] and sa[i]."""
    n = len(sa)
    lcp = np.zeros(n, np.int64)
    a, b, at = sa[:-1].copy(), sa[1:].copy(), np.arange(1, n)
    same = levels[0][a] == levels[0][b]
    a, b, at = a[same], b[same], at[same]
    for j in range(len(levels) - 1, -1, -1):
        ok = (a < n) & (b < n)
        ok[ok] = levels[j][a[ok]] == levels[j][b[ok]]
        lcp[at[ok]] += 1 << j
        a[ok] += 1 << j
        b[ok] += 1 << j
    return lcp


def longest_repeats(sa: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each place, the longest repeat that starts there: the larger of its two common-prefix values."""
    out = np.empty(len(sa), np.int64)
    out[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    return out


def covered(repeat: np.ndarray, least: int) -> np.ndarray:
    """Which places lie in a repeat of at least `least` elements: the union of the maximal repeats' spans."""
    step = np.zeros(len(repeat) + 1, np.int64)
    start = np.flatnonzero(repeat >= least)
    step[start] += 1
    np.subtract.at(step, start + repeat[start], 1)
    return np.cumsum(step[:-1]) > 0


def repeated_again(sa: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Which places lie in a second or later occurrence of a run of `least` elements.

    Neighbours in the suffix array that share as much are an interval; all of its places but the first start one.
    """
    first = np.flatnonzero(lcp < least)
    later = np.ones(len(sa), bool)
    later[np.minimum.reduceat(sa, first)] = False
    step = np.zeros(len(sa) + 1, np.int64)
    start = np.flatnonzero(later)
    step[start] += 1
    np.subtract.at(step, start + least, 1)
    return np.cumsum(step[:-1]) > 0


def measure(texts: list[str], least: int) -> list[tuple[int, ...]]:
    """The fields of KIND for each text. One suffix array serves them all: words of different texts never match."""
    words = [t.encode().split() for t in texts]  # bytes: the six ASCII white spaces only
    sizes = np.array([len(w) for w in words], np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)
    ids: dict[bytes, int] = {}
    key = np.fromiter((ids.setdefault(x, len(ids)) for w in words for x in w), np.int64, int(sizes.sum()))
    counts = np.zeros((4, len(texts)), np.int64)
    if len(key):
        sa, levels = suffix_order(key + of * (len(ids) + 1))
        lcp = common_prefixes(sa, levels)
        repeat = longest_repeats(sa, lcp)
        counts[0] = np.bincount(of, covered(repeat, 3), len(texts))
        counts[1] = np.bincount(of, covered(repeat, least), len(texts))
        counts[2] = np.bincount(of, repeated_again(sa, lcp, least), len(texts))
        full = sizes > 0
        counts[3, full] = np.maximum.reduceat(repeat, (np.cumsum(sizes) - sizes)[full])
    out = []
    for t, n, c in zip(texts, sizes.tolist(), counts.T.tolist(), strict=True):
        lines = [x for x in t.split("\n") if x.strip(SPACES)]
        out.append((n, len(t) - sum(map(t.count, SPACES)), sum(map(t.count, SYMBOLS)), len(lines) - len(set(lines)), *c))
    return out


def repetition(text: Column, least: int = 10, piece: int = 1 << 20) -> Column:
    """A struct of counts of the whole text: words, code points in words, symbols, repeated lines, words in
    repeated windows of three, words covered by repeats of at least `least` words (all occurrences, and those
    but the first), and the longest repeat.

    A null text is empty, and an empty text has zeros. Equal rows have equal counts, no rows give none, and
    ties between equal suffixes do not matter to any count. Texts are worked on some `piece` characters at a
    time; a longer text is worked on whole.
    """

    @F.arrow_udf(KIND)
    def of(texts: pa.Array) -> pa.Array:
        out: list[tuple[int, ...]] = []
        held: list[str] = []
        size = 0
        for t in texts.to_pylist():
            held.append(t or "")
            size += len(held[-1])
            if size >= piece:
                out += measure(held, least)
                held, size = [], 0
        out += measure(held, least) if held else []
        cols = np.array(out, np.int64).reshape(-1, len(KIND.names)).T
        return pa.StructArray.from_arrays([pa.array(c) for c in cols], names=KIND.names)

    return of(text)


def repetition_rules(measured: Column, max_fraction: float = 0.15, max_longest: int = 50) -> Column:
    """True if second and later occurrences of repeats cover at most that fraction of the words and no repeat is longer than that.

    The first occurrence is not counted, so one repeated line does not weigh double in a short text.
    """
    m = measured
    return (m["n_later"] <= F.lit(max_fraction) * m["n_words"]) & (m["longest_repeat"] <= max_longest)
