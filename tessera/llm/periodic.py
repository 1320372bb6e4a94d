"""Periodic runs of words in a text: masking by repeated k-grams, then the splits of Main and Lorentz.

A run of period q and at least max(least, 2 q) words is a stretch that comes again q words on, all but its end, and that
overlap has half of `least` words or more. So every word of a run lies in a k-gram of that many words which the text has twice. Words
outside such k-grams are masked; what survives falls apart into segments, and a run lies in one of them. There the segments are
split in halves, quarters and so on: a run that holds a split is found by how far the words on both sides of it agree with
those a period away. All splits of one size, of all texts of a batch, are worked on at once, and agreement is read
off ranks of the first 1, 2, 4, ... words of each place, which are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import wordspans
from tessera.llm.repetition import suffix_order

WORD = wordspans.classes()
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
KIND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each number."""
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def in_repeated_grams(word: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that their text has twice. first: where each text starts, with the end. Equal hashes count as equal; that can only spare words."""
    n, inside = len(word), np.zeros(len(word) + 1, np.int32)
    size = np.diff(first)
    if not (size >= k).any():
        return np.zeros(n, bool)
    h, gram = _mixed(word), np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(gram)]
    ok = size >= k
    np.add.at(inside, first[:-1][ok], 1)
    np.subtract.at(inside, (first[1:] - k + 1)[ok], 1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    key = gram[at] ^ _mixed(np.searchsorted(first, at, side="right"))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, at[again], 1)
    np.subtract.at(step, at[again] + k, 1)
    return np.cumsum(step[:-1]) > 0


class Agreement:
    """How many elements agree from two places on, and before two places, by the ranks of suffix_order()."""

    def __init__(self, key: np.ndarray):
        self.n, self.levels = len(key), suffix_order(key)[1]

    def same(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether 2 ** level elements agree."""
        ok = (np.minimum(a, b) >= 0) & (np.maximum(a, b) < self.n)
        ok[ok] = self.levels[level][a[ok]] == self.levels[level][b[ok]]
        return ok

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            out[self.same(j, a + out, b + out)] += 1 << j
        return out

    def back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            out[self.same(j, a - out - (1 << j), b - out - (1 << j))] += 1 << j
        return out


def runs_of(word: np.ndarray, first: np.ndarray, least: int = 12, at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and period. word: numbers of the words of all texts; first: where each text starts, with the end."""
    none = (np.empty(0, np.int64),) * 3
    mask = in_repeated_grams(word, first, -(-least // 2))
    lo = wordspans.word_starts(mask, first)
    if not len(lo):
        return none
    stop = np.append(np.flatnonzero(mask[:-1] & ~mask[1:]) + 1, len(mask))
    hi = np.minimum(stop[np.searchsorted(stop, lo, side="right")], np.append(lo[1:], len(mask)))
    hi = np.minimum(hi, first[np.searchsorted(first, lo, side="right")])
    long = hi - lo >= least
    lo, hi = lo[long], hi[long]
    if not len(lo):
        return none
    # the segments one after the other, each with an end of its own that agrees with nothing
    size = hi - lo + 1
    end = np.cumsum(size)
    begin = end - size
    place = np.repeat(lo - begin, size) + np.arange(end[-1])
    place[end - 1] = lo
    key = np.unique(word[place], return_inverse=True)[1].astype(np.int64)
    key[end - 1] = int(key.max()) + 1 + np.arange(len(end))
    agree = Agreement(key)
    found, level = [], min(int(least > 4), len(agree.levels) - 1)
    for j in range(int(size.max() - 1).bit_length()):
        half = 1 << j
        # splits inside the segments, at odd multiples of the half from their start
        n = (size - 2 + half) // (2 * half)
        of = np.repeat(np.arange(len(lo)), n)
        mid = begin[of] + half + 2 * half * (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
        most = np.minimum(half, (size[of] - 1) // 2)
        for a_side in (True, False):
            room = np.minimum(most, mid - begin[of] if a_side else end[of] - 2 - mid)
            total, i = np.cumsum(room), 0
            while i < len(mid):
                k = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + at_once, "right")))
                r = room[i:k]
                p = np.arange(int(r.sum())) - np.repeat(np.cumsum(r) - r, r) + 1
                m = np.repeat(mid[i:k], r)
                i = k
                a = m - p if a_side else m
                # a run agrees over half of `least` elements or more around its split: with three, over two on a side of it
                near = agree.same(level, a, a + p) | agree.same(level, a - (1 << level), a + p - (1 << level))
                a, p = a[near], p[near]
                after, before = agree.ahead(a, a + p), agree.back(a, a + p)
                ok = (after + before >= p) & (after + before + p >= least)
                found.append(((a - before)[ok], (a + p + after)[ok], p[ok]))
    s, e, p = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((p, e, s))
    s, e, p = s[order], e[order], p[order]
    new = np.ones(len(s), bool)  # multiples of a period have the same stretch
    new[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    s, e, p = s[new], e[new], p[new]
    shift = (lo - begin)[np.searchsorted(end, s, side="right")]
    order = np.lexsort((p, s))
    return (s + shift)[order], (e + shift)[order], p[order]


def analyse(texts: pa.Array, least: int) -> pa.StructArray:
    """KIND for each text."""
    buf, at = wordspans.bytes_of(texts)
    inside = WORD[buf] != wordspans.BLANK
    start = wordspans.word_starts(inside, at)
    words = wordspans.spans_of(buf, inside, start)
    number, first = words.dictionary_encode().indices.to_numpy(), np.searchsorted(start, at)
    s, e, p = runs_of(number, first, least)
    step = np.zeros(len(number) + 1, np.int32)
    np.add.at(step, s + p, 1)
    np.subtract.at(step, e, 1)
    kept = np.cumsum(step[:-1]) == 0
    ends = np.concatenate([[0], np.cumsum(kept)])[first]
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.filter(pa.array(kept)).cast(pa.binary()))
    of = np.searchsorted(first, s, side="right") - 1
    runs = pa.StructArray.from_arrays([pa.array(s - first[of]), pa.array(e - s), pa.array(p)], names=RUN.names)
    by_text = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(first))), pa.int32()), runs)
    return pa.StructArray.from_arrays([pa.array(np.diff(first)), by_text, pc.binary_join(lists, b" ").cast(pa.string())], names=KIND.names)


def periodic_runs(text: Column, least: int = 12, piece: int = 1 << 20) -> Column:
    """A struct of n_words, runs and collapsed for the whole text.

    runs: start, length and period, by start and then period, of every stretch of at least max(least, 2 * period) words that are
    the same a period apart, that no neighbouring word extends and whose period is its smallest. collapsed: the words that no run
    contains after its first period, joined by spaces.

    A null text is empty and has no words; an empty text has no runs and collapses to the empty one. Equal rows have equal
    results, no rows give none. Texts are worked on some `piece` bytes at a time, a longer one whole; equal words of different texts
    never meet. Other columns are not read.
    """

    @F.arrow_udf(KIND)
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in texts:
            out = [analyse(b.column(0), least) for b in wordspans.pieces(iter([pa.RecordBatch.from_arrays([x], names=["t"])]), 0, piece)]
            yield pa.concat_arrays(out) if out else analyse(x, least)

    return of(text)
