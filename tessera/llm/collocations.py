"""Phrase collocations by the hashing passes of PCY and DHP, with the pruning of Apriori, before exact counting.

Pass n reads the texts, counts n-word phrases exactly and, on the way, adds the phrases of n + 1 words up in buckets, by hash. What
goes from a pass to the next is two tables of bits, of a size that is fixed by a parameter: buckets that reach the least count,
and phrases of n words that do. A phrase of n + 1 words is counted exactly only if its bucket is set and so are both
phrases of n words in it; bits that are set for others too only let more through. Counts are added up by word and phrase, as
text, in a shuffle that sees each phrase once a batch; bucket counts stop at the least count and travel as bytes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import wordspans
from tessera.llm.common import materialize, release, small_batches, written

INNER, MARK = 2, 1
#: Blanks, marks that end a piece, and all other bytes.
KIND = wordspans.classes(b"\x20\t", marks=b".,;:!?\n\x0b\x0c\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PART = 1 << 17  # buckets that travel together
FOUND = "lang string, phrase string, part int, f long, bits binary"


class Words:
    """The words of some texts: number, hash with the language, whether the next word follows in the same piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        buf, at = wordspans.bytes_of(texts)
        buf = LOWER[buf]
        kind = KIND[buf]
        inside = kind == INNER
        start = wordspans.word_starts(inside, at)
        number, words = wordspans.numbered(buf, inside, start)
        lang = langs.cast(pa.string()).fill_null("und").dictionary_encode()
        self.langs, own = lang.dictionary.to_pylist(), lang.indices.to_numpy()
        first = np.searchsorted(start, at)
        of = np.repeat(own, np.diff(first)).astype(np.int64)
        piece = np.cumsum(kind == MARK, dtype=np.int64)[start] if len(start) else start
        self.follows = np.zeros(len(start), bool)
        self.follows[:-1] = piece[1:] == piece[:-1]
        self.follows[(first[1:] - 1)[first[1:] > 0]] = False
        self.words = words.cast(pa.binary())
        # words by language: a word of two languages is two
        self.key, self.id = np.unique(of * max(1, len(words)) + number, return_inverse=True)
        seeds = [xxhash.xxh3_64_intdigest(x.encode()) for x in self.langs]
        of_key, word = np.divmod(self.key, max(1, len(words)))
        text = self.words.to_pylist()
        self.hash = np.fromiter((xxhash.xxh3_64_intdigest(text[w], seeds[k]) for k, w in zip(of_key.tolist(), word.tolist(), strict=True)), np.uint64, len(self.key))
        self.lang_of, self.word_of = of_key, word

    def phrase(self, ids: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
        """Languages and texts of phrases by the ids of their first, second, ... words."""
        words = [self.words.take(pa.array(self.word_of[i])) for i in ids]
        text = words[0] if len(words) == 1 else pc.binary_join_element_wise(*words, b" ")
        return pa.array(self.langs, pa.string()).take(pa.array(self.lang_of[ids[0]])), text.cast(pa.string())


def spot(hashes: list[np.ndarray], bits: int) -> np.ndarray:
    """The place of a phrase in a table of 2 ** bits, by the hashes of its words."""
    h = np.zeros(len(hashes[0]), np.uint64)
    for x in hashes:
        h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)


def is_set(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def distinct(ids: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct phrases and how often each is there."""
    if not len(ids[0]):
        return ids, np.empty(0, np.int64)
    key, width = ids[0], [int(x.max()) + 1 for x in ids]
    for x, w in zip(ids[1:], width[1:], strict=True):
        if int(key.max()) >= (1 << 62) // w:
            key = np.unique(key, return_inverse=True)[1]
        key = key * w + x
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return [x[first] for x in ids], n


def _pass(n: int, longest: int, least: int, bits: int, seen: Broadcast | None, piece: int) -> Callable:
    """Counts of the phrases of n words that can be frequent, and buckets of longer ones. seen: bits of buckets of n words, and of frequent phrases of n - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = np.zeros(1 << bits, np.uint8) if n < longest else None
        for b in wordspans.pieces(batches, 0, piece):
            w = Words(b.column(0), b.column(1))
            if not len(w.id):
                continue
            if n == 1:
                ids, at = [np.arange(len(w.key))], np.arange(len(w.id))
                count, ok = np.bincount(w.id, minlength=len(w.key)), w.follows
            else:
                candidate, frequent = seen.value
                at = starts(w, n)
                own = [w.id[at + k] for k in range(n)]
                ids, count = distinct(own)
                h = [w.hash[i] for i in ids]
                good = is_set(candidate, spot(h, bits)) & is_set(frequent, spot(h[1:], bits)) & is_set(frequent, spot(h[:-1], bits))
                ids, count = [i[good] for i in ids], count[good]
                if n < longest:  # where a phrase that is still in play starts
                    h = [w.hash[i] for i in own]
                    ok = np.zeros(len(w.id), bool)
                    ok[at] = is_set(candidate, spot(h, bits)) & is_set(frequent, spot(h[1:], bits)) & is_set(frequent, spot(h[:-1], bits))
            if buckets is not None:
                nxt = starts(w, n + 1)
                if n > 1:  # both phrases of n words in it must be in play
                    nxt = nxt[ok[nxt] & ok[nxt + 1]]
                more, many = distinct([w.id[nxt + k] for k in range(n + 1)])
                at = spot([w.hash[i] for i in more], bits).astype(np.int64)
                at, back = np.unique(at, return_inverse=True)
                buckets[at] = np.minimum(buckets[at] + np.bincount(back, many, len(at)), least)
            lang, text = w.phrase(ids)
            yield rows(lang, text, count)
        for k in range(0, len(buckets) if buckets is not None else 0, PART):
            part = buckets[k : k + PART]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string())] * 2 + [pa.array([k // PART], pa.int32()), pa.nulls(1, pa.int64()), pa.array([zstandard.compress(part.tobytes(), 3)])], names=["lang", "phrase", "part", "f", "bits"])

    def rows(lang: pa.Array, text: pa.Array, count: np.ndarray) -> pa.RecordBatch:
        none = lambda kind: pa.nulls(len(count), kind)
        return pa.RecordBatch.from_arrays([lang, text, none(pa.int32()), pa.array(count.astype(np.int64)), none(pa.binary())], names=["lang", "phrase", "part", "f", "bits"])

    return run


def starts(w: Words, n: int) -> np.ndarray:
    """Where phrases of n words start."""
    ok = np.ones(max(0, len(w.id) - n + 1), bool)
    for k in range(n - 1):
        ok &= w.follows[k : k + len(ok)]
    return np.flatnonzero(ok)


def _bucket_bits(parts: DataFrame, least: int) -> bytes:
    """The table of buckets that reach the least count. Tasks' counts of a part are added up as they come; no more than one part is held."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.int64(0), 0
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part, total = k, np.minimum(total + np.frombuffer(zstandard.decompress(x), np.uint8), least)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()])], names=["part", "bits"])

    return parts.groupBy("part").applyInArrow(add, "part int, bits binary")


def table_of(rows: list, bits: int) -> np.ndarray:
    """The whole table of a few parts."""
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        got = np.frombuffer(r.bits, np.uint8)
        out[r.part * PART // 8 : r.part * PART // 8 + len(got)] = got
    return out


def _phrase_bits(bits: int) -> Callable:
    """Places of phrases in the table, as parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, bool)
        for b in batches:
            lang = [xxhash.xxh3_64_intdigest(x.encode()) for x in b.column(0).to_pylist()]
            text = [x.encode().split(b" ") for x in b.column(1).to_pylist()]
            if not text:
                continue
            h = [np.fromiter((xxhash.xxh3_64_intdigest(t[k], s) for t, s in zip(text, lang, strict=True)), np.uint64, len(text)) for k in range(len(text[0]))]
            table[spot(h, bits).astype(np.int64)] = True
        for k in range(0, len(table), PART):
            if table[k : k + PART].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // PART], pa.int32()), pa.array([np.packbits(table[k : k + PART], bitorder="little").tobytes()])], names=["part", "bits"])

    return run


def _either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One part of which any of the parts sets a bit."""
    total, part = np.uint8(0), 0
    for b in batches:
        for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            part, total = k, total | np.frombuffer(x, np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.asarray(total).tobytes()])], names=["part", "bits"])


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10, bits: int | None = None, piece: int = 1 << 22) -> list[DataFrame]:
    """The number n of words by lang; then for 1 to `longest` words, (lang, phrase, f) of the phrases that occur `least` times or more in texts of the language.

    The tables are written. bits: 2 ** bits buckets; without it one for each 16 bytes of file, from 2 ** 20 to 2 ** 25 (32 MB in a
    worker, 4 MB as bits). Their number changes no result.
    """
    if not 2 <= least <= 255:
        raise ValueError("the least count must be from 2 to 255")
    spark = docs.sparkSession
    small_batches(spark)
    if bits is None:
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        bits = min(25, max(20, math.ceil(math.log2(max(1, size / 16)))))
    texts = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    out, seen, since = [], None, written()
    for n in range(1, longest + 1):
        both = materialize(texts.mapInArrow(_pass(n, longest, least, bits, seen, piece), FOUND), f"phrases-{n}")
        counted = both.where("part is null").select("lang", "phrase", "f")
        if n == 1:
            out.append(materialize(counted.groupBy("lang").agg(F.sum("f").alias("n")), "words"))
        out.append(materialize(counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least), f"counted-{n}"))
        if n < longest:
            buckets = _bucket_bits(both.where("part is not null").select("part", "bits"), least).collect()  # 2 ** bits bits in all
            often = out[-1].select("lang", "phrase").mapInArrow(_phrase_bits(bits), "part int, bits binary")
            often = often.groupBy("part").applyInArrow(_either, "part int, bits binary").collect()  # as many
            seen = spark.sparkContext.broadcast((table_of(buckets, bits), table_of(often, bits)))
        release(spark, since, tuple(out))
    return out


def _word(phrase: Column, a: int, n: int, words: int) -> Column:
    """n words of a phrase, from the a-th on."""
    head = phrase if a + n == words else F.substring_index(phrase, " ", a + n)
    return head if a == 0 else F.substring_index(head, " ", -n)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10, share: int = 50, top: int = 2000, bits: int | None = None, salts: int = 16) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of 2 to `longest` words that are most of what their parts are, for each language.

    a is the phrase's count in the language, n that of all words; l and r are the counts of the two parts at the cut with the
    least score floor(1000000 a a / (l r)), the first of equal ones. Phrases in a longer one that occurs in `share` percent of
    their cases or more are left out. The best `top` of a language are given, by score, count and phrase.

    Upper-case A-Z are lower-cased, pieces end at any of .,;:!? and line breaks, words at spaces and tabs. A null text is
    empty, a null language `und`. Repeated rows count each time; ties go by the phrase's bytes; an empty table has no rows, and no other column is
    read. Only tables of bits of bounded size are broadcast; counts meet in shuffles, and a language's best
    are taken from the best of some parts of it.
    """
    total, *often = frequent_phrases(docs, text_col, lang_col, longest, least, bits)
    wide = lambda c: c.cast("decimal(38,0)")
    parts = []
    for k in range(2, longest + 1):
        rows = often[k - 1].select("lang", "phrase", F.col("f").alias("a"))
        for cut in range(1, k):
            for name, at, n in ((f"l{cut}", 0, cut), (f"r{cut}", cut, k - cut)):
                part = often[n - 1].select("lang", F.col("phrase").alias("part"), F.col("f").alias(name))
                rows = rows.withColumn("part", _word(F.col("phrase"), at, n, k)).join(part, ["lang", "part"]).drop("part")
        score = lambda cut: F.call_function("div", wide(F.lit(1_000_000)) * wide(F.col("a")) * wide(F.col("a")), wide(F.col(f"l{cut}")) * wide(F.col(f"r{cut}")))  # noqa: B023, E731
        best = F.array_min(F.array(*[F.struct(score(c).alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")) for c in range(1, k)]))
        rows = rows.select("lang", "phrase", "a", best.alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
        for m in range(k + 1, longest + 1):  # a longer phrase holds m - k + 1 of these
            inner = F.explode(F.array_distinct(F.array(*[_word(F.col("phrase"), i, k, m) for i in range(m - k + 1)])))
            holds = often[m - 1].select("lang", F.col("f").alias("longer"), inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
            rows = rows.join(holds, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")
        parts.append(rows)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    place = lambda keys: f"row_number() over (partition by {keys} order by score desc, a desc, phrase)"
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("rank", F.expr(place("lang, salt"))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.expr(place("lang"))).where(F.col("rank") <= top).join(total, "lang")
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
