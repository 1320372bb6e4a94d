"""Removal of long byte strings that occur elsewhere, by suffix sorting of shards.

Every string of `length` bytes is dealt to a shard by the minimizer of its beginning, a window of some bytes: the
least hash of the short grams in it. Equal strings have equal minimizers, wherever they are, and so have equal windows.
Neighbouring strings of a document with one minimizer travel together as a context. Contexts of minimizers that occur once in all are left
where they are: their strings cannot occur twice. So are those that share neither what is left nor what is right
of the gram with another. Equal contexts travel once, with their number. Where
the contexts of one minimizer would overfill a shard by themselves, as those of many near copies of one passage
do, they are spread over tasks instead and their strings are dealt again by the minimizers of longer grams,
which few of them share.
Each shard is then suffix-sorted on disk (induced.py), and the common-prefix values tell which strings
start elsewhere too, and which shorter passages of many words do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import induced
from tessera.llm.common import clear_of, materialize, may_be_among, release, small_batches, text_or_empty, written

GRAM = 32
SIDE = 120  # bytes beside a gram, of which equal windows share those on one side or the other
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
RUN = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("row", pa.int64()), ("m", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("own", pa.int32()), ("twice", pa.bool_()), ("ch", pa.int64()), ("left", pa.int64()), ("right", pa.int64())])


def gram_hashes(buf: bytes, gram: int = GRAM) -> np.ndarray:
    """A hash of the bytes from each place, for grams of 32 bytes or a multiple."""
    n = len(buf) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for j in range(4):
        h += np.ndarray((n,), "<u8", buf, 8 * j, (1,)) * ODD[j]
        h ^= h >> np.uint64(29)
    h *= ODD[3]
    h ^= h >> np.uint64(32)
    if gram > GRAM:
        parts, n = h, len(buf) - gram + 1
        h = np.zeros(n, np.uint64)
        for j in range(gram // GRAM):
            h = (h ^ parts[GRAM * j : GRAM * j + n]) * ODD[j % 3]
            h ^= h >> np.uint64(31)
    return h


def sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours: least values of blocks from both sides."""
    n = len(h) - w + 1
    p = np.full(-(-len(h) // w) * w, np.uint64(2**64 - 1))
    p[: len(h)] = h
    p = p.reshape(-1, w)
    ahead, back = np.minimum.accumulate(p, axis=1).ravel(), np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def contexts(docs: list[bytes], length: int, gram: int = GRAM, window: int | None = None, longest: int = 4096) -> tuple[np.ndarray, ...]:
    """Runs of up to `longest` window starts with one minimizer: document, minimizer, start, bytes up to the end of the string
    that starts last (or of the document), how many windows start in the run, whether the minimizer's gram occurs twice
    in it, hashes of the bytes, and of those left and right of the gram. Where there
    are too few of these on a side the hash is the run's own."""
    window = window or length
    w, buf = window - gram + 1, b"".join(docs)
    size = np.fromiter(map(len, docs), np.int64, len(docs))
    start = np.cumsum(size) - size
    empty = tuple(np.empty(0, np.int64) for _ in range(9))
    if len(buf) < window or not (size >= window).any():
        return empty
    h = gram_hashes(buf, gram)
    least = sliding_least(h, w)
    inside = np.zeros(len(buf) + 1, np.int32)
    ok = size >= window
    inside[start[ok]] += 1
    np.subtract.at(inside, (start + size - window + 1)[ok], 1)
    at = np.flatnonzero(np.cumsum(inside) > 0)
    m, doc = least[at], np.repeat(np.arange(len(docs)), size)[at]
    cut = np.flatnonzero((m[1:] != m[:-1]) | (doc[1:] != doc[:-1])) + 1
    a = np.concatenate([[0], cut])
    if (np.diff(np.append(a, len(m))) > longest).any():  # a text that repeats a gram throughout; its pieces are mostly equal
        into = np.arange(len(m)) - np.repeat(a, np.diff(np.append(a, len(m))))
        a = np.flatnonzero(into % longest == 0)
        cut = a[1:]
    b = np.append(cut, len(m)) - 1
    twice = _occurs_twice(h, w, m[a], at[a], at[b])
    s, e = at[a], np.minimum(at[b] + length, (start + size)[doc[a]])
    ch = np.fromiter((xxhash.xxh3_64_intdigest(buf[i:j]) for i, j in zip(s.tolist(), e.tolist(), strict=True)), np.uint64, len(s))
    d, low = doc[a], m[a]
    last = at[b]
    # where the gram stands: it ended the run by being passed, or began it by coming in, or else it is looked for
    g = np.where(h[last] == low, last, s + w - 1)
    for i in np.flatnonzero((h[last] != low) & (h[np.minimum(s + w - 1, len(h) - 1)] != low)).tolist():
        g[i] = last[i] + int(h[last[i] : last[i] + w].argmin())
    side = min(SIDE, (w - 1) // 2)
    beside = lambda ok, i, salt: np.where(ok, _digests(buf, i, side, ok), ch + np.uint64(salt)).view(np.int64)
    left, right = beside(g - side >= s, g - side, 1), beside(g + gram + side <= e, g + gram, 2)
    return d, low.view(np.int64), s - start[d], e - s, b - a + 1, twice, ch.view(np.int64), left, right


def _occurs_twice(h: np.ndarray, w: int, low: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether a run's least hash stands at two places or more of its windows, which start from first to last.

    Places whose hash could be one of the runs' are found by some of its bits, so that few are sorted.
    """
    seen = np.zeros(1 << 20, bool)
    seen[low >> np.uint64(44)] = True
    places = np.flatnonzero(seen[h >> np.uint64(44)])
    values, of = np.unique(h[places], return_inverse=True)
    key = np.sort(of * len(h) + places)
    base = np.searchsorted(values, low) * len(h)
    return np.searchsorted(key, base + last + w - 1, "right") - np.searchsorted(key, base + first) > 1


def _digests(buf: bytes, at: np.ndarray, size: int, wanted: np.ndarray) -> np.ndarray:
    """Hashes of `size` bytes from each place that is wanted."""
    out = np.zeros(len(at), np.uint64)
    out[wanted] = np.fromiter((xxhash.xxh3_64_intdigest(buf[i : i + size]) for i in at[wanted].tolist()), np.uint64, int(wanted.sum()))
    return out


def _runs(length: int, gram: int, window: int, piece: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            texts, i = x.column(3).cast(pa.binary()).to_pylist(), 0
            while i < len(texts):
                j, n = i, 0
                while j < len(texts) and n < piece:
                    n, j = n + len(texts[j]), j + 1
                d, *cols = contexts(texts[i:j], length, gram, window)
                keys = [x.column(k).to_numpy()[i:j][d] for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*keys, *cols], RUN, strict=True)], schema=RUN)
                i = j

    return run


def _sort_shards(length: int, words: int | None, shard_bytes: int, ram: int):
    """Rows come by minimizer; a shard is closed between two minimizers, so all strings of one meet. Crowded contexts pass through."""
    schema = pa.schema([("m", pa.int64()), ("ch", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("passage", pa.bool_())]))), ("bytes", pa.binary())])
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    span = lambda a, b, passage=False: {"a": int(a), "b": int(b), "passage": passage}

    def whole(text: bytes) -> list[dict]:
        """Of a context that occurs again just so."""
        return [span(0, len(text))] * (len(text) >= length) + [span(0, len(text), True)] * (words is not None and len(text.split()) > words)

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        out = []
        found = induced.repeated([r[3] for r in rows], length, ram, words=words, own=[r[4] for r in rows])
        for (m, ch, many, text, _), (at, passages) in zip(rows, found, strict=True):
            spans = whole(text) if many else [span(*x, True) for x in passages]
            if not many and len(at):
                spans += [span(p[0], p[-1] + length) for p in np.split(at, np.flatnonzero(np.diff(at) > length) + 1)]
            if spans:
                out.append((m, ch, spans, None))
        if out:
            yield batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        n, before = 0, None
        for x in batches:
            passed = []
            for *r, crowded in zip(*(c.to_pylist() for c in x.columns), strict=True):
                again, before = before == r[:2], r[:2]
                if again:
                    continue  # a row of the documents was there twice
                if crowded:
                    passed.append((r[0], r[1], whole(r[3]) if r[2] else [], r[3]))
                    continue
                if n >= shard_bytes and rows[-1][0] != r[0]:
                    yield from solve(rows)
                    rows, n = [], 0
                rows.append(tuple(r))
                n += len(r[3])
            if passed:
                yield batch(passed)
        if rows:
            yield from solve(rows)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts that a document stands for."""
    names = ["m", "ch", "many", "bytes", "own", "crowded"]
    for x in batches:
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for t, cs in zip(x.column(0).cast(pa.binary()).to_pylist(), x.column(1).to_pylist(), strict=True):
            for c in cs:
                for to, v in zip(out, (c["m"], c["ch"], c["many"], t[c["start"] : c["start"] + c["size"]], c["own"], c["crowded"]), strict=True):
                    to.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.bool_()), strict=True)], names=names)


def _spans(texts: DataFrame, length: int, window: int, words: int | None, grams: tuple[int, ...], shard_bytes: int, ram: int) -> DataFrame:
    """(k1, k2, a, b, passage): what texts (k1, k2, row, text) share with each other or repeat; a row of one key is a copy."""
    runs = materialize(texts.select("k1", "k2", "row", "text").mapInArrow(_runs(length, grams[0], window), "k1 long, k2 long, row long, m long, start int, size int, own int, twice boolean, ch long, left long, right long"), "runs")
    # a context is (m, ch); its first row stands for all its copies
    each = runs.groupBy("m", "ch").agg(F.count("*").alias("copies"), F.min(F.struct("row", "start", "size", "own")).alias("first"), F.max("twice").alias("twice"), F.min("left").alias("left"), F.min("right").alias("right"))
    each = materialize(each, "contexts")
    again = each.groupBy("m").agg(F.sum("copies").alias("n"), F.max("twice").alias("t")).where("n > 1 or t")
    wanted = each.join(again.select("m", F.col("t").alias("any")), "m")
    for side in ("left", "right"):
        wanted = wanted.join(wanted.groupBy("m", side).agg(F.count("*").alias(f"n_{side}")).where(f"n_{side} > 1"), ["m", side], "left")
    # where the gram of some context of m comes twice, its strings can match at any of them
    wanted = materialize(wanted.where("any or copies > 1 or n_left is not null or n_right is not null").drop("left", "right", "n_left", "n_right"), "shared")
    bytes_of = wanted.groupBy("m").agg(F.sum(F.col("first.size").cast("long")).alias("bytes"))
    crowded = (F.col("bytes") > shard_bytes) if len(grams) > 1 else F.lit(False)
    wanted = wanted.join(bytes_of.select("m", crowded.alias("crowded")), "m")
    lists = wanted.groupBy("first.row").agg(F.collect_list(F.struct("m", "ch", "first.start", "first.size", "first.own", (F.col("copies") > 1).alias("many"), "crowded")).alias("cs"))
    lists = materialize(lists, "wanted")
    cut = may_be_among(texts.select("row", "text"), F.col("row"), lists, "row", "maybe").where("maybe").select("row", "text").join(lists, "row").select("text", "cs")
    shards = cut.mapInArrow(_cut, "m long, ch long, many boolean, bytes binary, own int, crowded boolean")
    spread = F.when(F.col("crowded"), F.pmod("ch", F.lit(1024))).otherwise(0)
    shards = shards.repartition("m", spread).sortWithinPartitions("m", "ch")
    solved = materialize(shards.mapInArrow(_sort_shards(length, words, shard_bytes, ram), "m long, ch long, spans array<struct<a:int,b:int,passage:boolean>>, bytes binary"), "solved")
    found = solved.select("m", "ch", F.explode("spans").alias("s")).select("m", "ch", "s.a", "s.b", "s.passage")
    inner = solved.where("bytes is not null")
    if len(grams) > 1 and not inner.isEmpty():
        inner = inner.where(F.octet_length("bytes") >= length).select(F.col("m").alias("k1"), F.col("ch").alias("k2"), F.xxhash64("m", "ch").alias("row"), F.col("bytes").alias("text"))
        deeper = _spans(inner, length, length, words, grams[1:], shard_bytes, ram)
        found = found.unionByName(deeper.select(F.col("k1").alias("m"), F.col("k2").alias("ch"), "a", "b", "passage"))
    spans = runs.select("m", "ch", "k1", "k2", "start").join(found, ["m", "ch"])
    return spans.select("k1", "k2", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"), "passage").distinct()


SPANS = "array<struct<start:int,end:int>>"


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, window: int = 340, words: int | None = 50,
    shard_bytes: int = 3 << 20, ram: int = 96 << 20,
) -> DataFrame:
    """docs with spans: array of (start, end) in UTF-8 bytes, end exclusive, in order and apart, that are covered by
    strings of `length` bytes which also start elsewhere, in this document or another; and with passages, likewise:
    what is covered by repeats of more than `words` words that are at least `window` bytes long (shorter ones are
    found where their window's minimizer happens to lie in them).

    Matches end with the document. A null text is empty; rows are documents, so a repeated row is a copy;
    texts shorter than `window` have none; null ids are kept; an empty table gives no rows. All rows and
    columns of docs are kept; columns named spans or passages stay as spans_in and passages_in.

    Only documents that may stand for a repeated context, and those that may have spans, are shuffled, once each.
    A text that a third of the rows share is one row between, and so is a context. Contexts of one minimizer that
    make more than `shard_bytes` in all are dealt again, by grams of some 2/3 and then all but the last bytes of
    the length. A shard is sorted in some `ram` bytes of memory, whatever its size.
    """
    if not 2 * GRAM <= window <= length:
        raise ValueError(f"window is {window}, length {length}; {2 * GRAM} <= window <= length is asked for")
    since = written()
    small_batches(docs.sparkSession)
    text = text_or_empty(F.col(text_col))
    k1, k2 = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    texts = docs.where(F.octet_length(text) >= window).select(k1.alias("k1"), k2.alias("k2"), F.xxhash64(k1, k2, F.col(id_col)).alias("row"), text.alias("text"))
    grams = tuple(sorted({GRAM, max(GRAM, length * 2 // 3 // GRAM * GRAM), (length - 1) // GRAM * GRAM}))
    spans = _spans(texts, length, window, words, grams, shard_bytes, ram)
    by_text = spans.groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(F.array_sort(F.collect_list(F.struct("a", "b", "passage"))).alias("s"))
    parts = [merge_spans(F.filter("s", lambda x: x["passage"] == p)).alias(n) for p, n in ((False, "__spans"), (True, "__passages"))]
    by_text = materialize(by_text.select("__k1", "__k2", *parts), "spans")
    release(docs.sparkSession, since, (by_text,))
    names = clear_of(docs.columns, ["spans", "passages"])
    text = text_or_empty(F.col(names[docs.columns.index(text_col)]))
    left = may_be_among(docs.toDF(*names).withColumn("__1", F.xxhash64(text)), F.col("__1"), by_text, "__k1", "__maybe")
    none = F.array().cast(SPANS)
    some = left.where("__maybe").withColumn("__2", F.xxhash64(F.lit(1), text))
    some = some.join(by_text, (F.col("__1") == F.col("__k1")) & (F.col("__2") == F.col("__k2")), "left")
    out = left.where("not __maybe").select(*names, none.alias("spans"), none.alias("passages"))
    return out.unionByName(some.select(*names, F.coalesce("__spans", none).alias("spans"), F.coalesce("__passages", none).alias("passages")))


def merge_spans(spans: Column) -> Column:
    """Sorted spans (a, b) as maximal runs (start, end); null as none."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def of(found: pa.Array) -> pa.Array:
        out = []
        for ss in found.to_pylist():
            merged: list[dict] = []
            for s in ss or ():
                if merged and s["a"] <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], s["b"])
                else:
                    merged.append({"start": s["a"], "end": s["b"]})
            out.append(merged)
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return of(spans)


def kept_bytes(text: Column, spans: Column) -> Column:
    """The bytes of a text outside the spans."""

    @F.arrow_udf("binary")
    def of(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, ss in zip(texts.cast(pa.binary()).to_pylist(), found.to_pylist(), strict=True):
            t, at, parts = t or b"", 0, []
            for s in ss or ():
                parts.append(t[at : s["start"]])
                at = s["end"]
            out.append(b"".join(parts) + t[at:])
        return pa.array(out, pa.binary())

    return of(text, spans)

