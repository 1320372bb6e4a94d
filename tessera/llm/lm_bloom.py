"""Language-model scoring: quantised n-gram counts in a log-frequency Bloom filter that all workers hold.

Learning: tasks hash tokens and pairs, add up what they have and send sorted, packed blocks by hash
range; each range is added up once. The filter stores (n-gram, 1 .. q) for an n-gram of quantised log
count q. Scoring probes an n-gram with 1, 2, ... until a probe misses; probabilities are smoothed from
the counts so found. The filter in every worker is bounded; what it does not know is asked of the hash
ranges by shuffle, a block a chunk of texts and range, so no count is left out at any size. Exact token
counts, which the add-one base score needs, are kept beside it: the most frequent in every worker (a
fixed number); the rest are asked of the same ranges by the same shuffle.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import clear_of, materialize, small_batches

END, START = xxhash.xxh64_intdigest(b" "), xxhash.xxh64_intdigest(b"\t")  # no word has white space
BASE = 1.5  # of the log that quantises counts
LEVELS = 64
LOW_BITS = 16  # dropped from the hash of a pair
ONE = np.uint64(1)
_RAW = (3, 5)  # how many low bytes of differences of 4 and 8 bytes are kept as they are


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text closed by one end, and how many each text has."""
    words = [(t or b"").lower().split() + [b" "] for t in texts]  # bytes: A-Z and the six ASCII white spaces only
    n = np.fromiter(map(len, words), np.int64, len(words))
    return np.fromiter(map(xxhash.xxh64_intdigest, itertools.chain.from_iterable(words)), np.uint64, int(n.sum())), n


def pairs(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hashes of each token with the one before it; a text's first follows the start."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[np.cumsum(n) - n] = START
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + h) >> np.uint64(LOW_BITS)


def add_up(h: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and the sum of their counts."""
    if c is None:
        h = np.sort(h)
    else:
        o = np.argsort(h)
        h, c = h[o], c[o]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    return h[first], np.diff(np.append(first, len(h))) if c is None else np.add.reduceat(c, first) if len(h) else c


def pack(h: np.ndarray, c: np.ndarray) -> bytes:
    """Sorted distinct values and counts: differences in 4 bytes where they fit, of which the leading compress well, counts in one where they fit."""
    d = np.diff(h, prepend=np.uint64(0))
    wide = bool(len(d) and d[1:].size and d[1:].max() >> np.uint64(32))
    over = c >= 255
    bytes_of = d[1:].astype(np.uint64 if wide else np.uint32)
    planes = bytes_of.view(np.uint8).reshape(-1, bytes_of.itemsize).T
    led = zstandard.compress(planes[_RAW[wide] :].tobytes(), 1)
    head = np.array([len(h), int(over.sum()), wide, d[0] if len(d) else 0, len(led)], np.uint64)
    return b"".join([head.tobytes(), planes[: _RAW[wide]].tobytes(), led, np.minimum(c, 255).astype(np.uint8).tobytes(), c[over].astype(np.uint64).tobytes()])


def unpack(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, over, wide, first, led = (int(x) for x in np.frombuffer(b, np.uint64, 5))
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    raw, kind = _RAW[wide], np.dtype(np.uint64 if wide else np.uint32)
    at = 40 + raw * (n - 1)
    planes = np.empty((n - 1, kind.itemsize), np.uint8)
    planes[:, :raw] = np.frombuffer(b, np.uint8, raw * (n - 1), 40).reshape(raw, -1).T
    planes[:, raw:] = np.frombuffer(zstandard.decompress(b[at : at + led]), np.uint8).reshape(kind.itemsize - raw, -1).T
    at += led
    c = np.frombuffer(b, np.uint8, n, at).astype(np.int64)
    c[c == 255] = np.frombuffer(b, np.uint64, over, at + n)
    h = np.empty(n, np.uint64)
    h[0], h[1:] = first, planes.view(kind)[:, 0]
    return np.cumsum(h, dtype=np.uint64), c


def pack_counts(c: np.ndarray) -> bytes:
    """Counts in one byte where they fit."""
    over = c >= 255
    return b"".join([np.uint64(len(c)).tobytes(), np.minimum(c, 255).astype(np.uint8).tobytes(), c[over].astype(np.uint64).tobytes()])


def unpack_counts(b: bytes) -> np.ndarray:
    n = int(np.frombuffer(b, np.uint64, 1)[0])
    c = np.frombuffer(b, np.uint8, n, 8).astype(np.int64)
    c[c == 255] = np.frombuffer(b, np.uint64, -1, 8 + n)
    return c


def pack_codes(codes: np.ndarray) -> bytes | None:
    """Rows of codes, by the first row in order, as their byte planes, which compress well; none if there are none."""
    if not codes.size:
        return None
    codes = codes[:, np.argsort(codes[0], kind="stable")]
    codes[0] = np.diff(codes[0], prepend=0)
    return zstandard.compress(codes.astype(np.int32, order="C").view(np.uint8).reshape(len(codes), -1, 4).transpose(0, 2, 1).tobytes(), 1)


def unpack_codes(b: bytes | None, rows: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b) if b else b"", np.uint8).reshape(rows, 4, -1 if b else 0)
    codes = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.int32).reshape(rows, -1).astype(np.int64)
    codes[0] = np.cumsum(codes[0])
    return codes


def level_of(c: np.ndarray) -> np.ndarray:
    """Quantised log counts: 1 for 1, then a step for each power of BASE."""
    return 1 + np.floor(np.log(np.maximum(c, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def _worth() -> np.ndarray:
    """The count that each level stands for: the middle of the counts that have it; 0 for level 0."""
    out = [0.0]
    for q in range(1, LEVELS):
        lo, hi = np.ceil(BASE ** (q - 1) - 1e-9), np.ceil(BASE**q - 1e-9) - 1
        out.append((lo + max(lo, hi)) / 2)
    return np.array(out)


WORTH = _worth()


def dealt(u: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], slices: int) -> pa.RecordBatch:
    """Sorted tokens and pairs with counts as packed blocks, one row for each hash range that has any."""
    shift = slices.bit_length() - 1
    of = lambda h, bits: (h >> np.uint64(bits - shift)).astype(np.int64) if shift else np.zeros(len(h), np.int64)
    su, sb = of(u[0], 64), of(b[0], 64 - LOW_BITS)
    names = np.unique(np.concatenate([su, sb]))
    cut = lambda s, x: zip(*(np.split(y, np.searchsorted(s, names[1:])) for y in x), strict=True)
    blocks = [pa.array([pack(*x) for x in cut(s, y)], pa.binary()) for s, y in ((su, u), (sb, b))] if len(names) else [pa.array([], pa.binary())] * 2
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *blocks], names=["slice", "u", "b"])


def _deal_finer(slices: int, flush: int):
    """Blocks of wide hash ranges, dealt to narrower ones; a task holds some `flush` entries at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], []]
        size = 0
        out = lambda: dealt(*(add_up(*(np.concatenate(y) for y in zip(*z, strict=True))) for z in held), slices)
        for x in batches:
            for blocks in zip(x.column(1).to_pylist(), x.column(2).to_pylist(), strict=True):
                for h, b in zip(held, map(unpack, blocks), strict=True):
                    h.append(b)
                    size += len(b[0])
                if size >= flush:
                    yield out()
                    held, size = [[], []], 0
        if held[0]:
            yield out()

    return run


def _count(slices: int, flush: int):
    """Tokens and pairs of texts, added up some `flush` tokens at a time and dealt to hash ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            return dealt(*(add_up(np.concatenate([x[i] for x in held])) for i in (0, 1)), slices)

        for x in batches:
            texts = x.column(0).cast(pa.binary()).to_pylist()
            for i in range(0, len(texts), 500):
                h, n = tokens(texts[i : i + 500])
                held.append((h, pairs(h, n)))
                size += len(h)
                if size >= flush:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


def _gather():
    """Adds up the blocks of each hash range; a range is one group of consecutive rows."""
    schema = pa.schema([("slice", pa.int32()), ("u", pa.binary()), ("b", pa.binary()), ("n_tokens", pa.int64()), ("levels_u", pa.list_(pa.int64())), ("levels_b", pa.list_(pa.int64())), ("once", pa.int64())])

    def done(s: int, us: list[bytes], bs: list[bytes]) -> pa.RecordBatch:
        (u, cu), (b, cb) = (add_up(*(np.concatenate(x) for x in zip(*map(unpack, z), strict=True))) for z in (us, bs))
        qu = level_of(cu)
        row = [s, pack(u, cu), pack(b, cb), int(cu.sum()), np.bincount(qu, minlength=LEVELS).tolist(), np.bincount(level_of(cb), minlength=LEVELS).tolist(), int((cu == 1).sum())]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, us, bs = None, [], []
        for x in batches:
            for s, u, b in zip(*(x.column(i).to_pylist() for i in range(3)), strict=True):
                if s != now:
                    if us:
                        yield done(now, us, bs)
                    now, us, bs = s, [], []
                us.append(u)
                bs.append(b)
                if len(us) >= 64:  # a range with many blocks is added up as they come
                    us, bs = ([pack(*add_up(*(np.concatenate(y) for y in zip(*map(unpack, z), strict=True))))] for z in (us, bs))
        if us:
            yield done(now, us, bs)

    return run


@dataclass
class Filter:
    """bits: 2**blocks blocks of 2**block_bits bits each; a key's block is its leading bits."""

    bits: np.ndarray
    blocks: int
    block_bits: int
    probes: int

    def first(self, key: np.ndarray, kind: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the probes of (key, level) start within the key's block, before the remainder, and their step."""
        x = mix(key + np.uint64((2 * level + kind) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        return x, (x >> np.uint64(33)) | ONE

    def places(self, key: np.ndarray, kind: int, level: int) -> Iterator[np.ndarray]:
        """Bit positions within the key's block."""
        x, step = self.first(key, kind, level)
        for _ in range(self.probes):
            yield x & np.uint64((1 << self.block_bits) - 1)
            x = x + step

    def block_of(self, key: np.ndarray, kind: int) -> np.ndarray:
        return key >> np.uint64((64 if kind == 0 else 64 - LOW_BITS) - self.blocks) if self.blocks else np.zeros(len(key), np.uint64)

    def levels(self, key: np.ndarray, kind: int) -> np.ndarray:
        """The quantised count of each key: probes for 1, 2, ... until one misses."""
        out, left = np.zeros(len(key), np.int64), np.arange(len(key))
        start = self.block_of(key, kind) << np.uint64(self.block_bits)
        for q in range(1, LEVELS):
            x, step = self.first(key[left], kind, q)
            for _ in range(self.probes):
                p = start[left] + (x & np.uint64((1 << self.block_bits) - 1))
                hit = (self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0
                left, x, step = left[hit], x[hit] + step[hit], step[hit]
            if not len(left):
                break
            out[left] = q
        return out


def _set_bits(shape: Filter, least: tuple[int, int], shift: int):
    """The bits that the n-grams of each hash range set in their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for s, *grams in zip(*(x.column(i).to_pylist() for i in range(3)), strict=True):
                bits = np.zeros(1 << shape.block_bits, bool)
                for kind, g in enumerate(grams):
                    key, c = unpack(g)
                    q = level_of(c)
                    ok = q >= least[kind]
                    key, q = key[ok], q[ok]
                    for j in range(1, int(q.max(initial=0)) + 1):
                        for p in shape.places(key[q >= j], kind, j):
                            bits[p.astype(np.int64)] = True
                yield pa.RecordBatch.from_arrays([pa.array([s >> shift], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    return run


def _or_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, bits = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["block", "bits"])
    for x in batches:
        for s, b in zip(*(x.column(i).to_pylist() for i in range(2)), strict=True):
            if s != now:
                if bits is not None:
                    yield row()
                now, bits = s, np.frombuffer(b, np.uint8).copy()
            else:
                bits |= np.frombuffer(b, np.uint8)
    if bits is not None:
        yield row()


DOC = ["no", "row", "n_tokens", "known", "base", "score", "tail", "open"]  # what a text has besides its chunk


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the asked tokens and levels of the asked pairs, in their order; in each range the model's blocks come first.

    Texts pass through on their way to the answers.
    """
    now, held, table, out, docs = None, [], None, [], []

    def done() -> pa.RecordBatch:
        found = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)]
        return pa.RecordBatch.from_arrays([*found, *(pa.nulls(len(out), t) for t in docs)], names=["chunk", "range", "u", "b", *DOC])

    for x in batches:
        docs = [x.schema.field(c).type for c in DOC]
        is_doc = x.column("n_tokens").is_valid()
        if is_doc.true_count:
            texts = x.filter(is_doc)
            nothing = [pa.nulls(texts.num_rows, t) for t in (pa.int32(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([texts.column("chunk"), *nothing, *(texts.column(c) for c in DOC)], names=["chunk", "range", "u", "b", *DOC])
            x = x.filter(pc.invert(is_doc))
        for r, chunk, *blocks in zip(*(x.column(c).to_pylist() for c in ("range", "chunk", "u", "b")), strict=True):
            if r != now:
                now, held, table = r, [], None
            (u, c), (b, n) = map(unpack, blocks)
            if chunk is None:
                held.append(((u, c), (b, level_of(n).astype(np.uint8))))
                continue
            if table is None:
                table = [tuple(np.concatenate(y) for y in zip(*z, strict=True)) for z in zip(*held, strict=True)] if held else [(np.empty(0, np.uint64), np.empty(0, t)) for t in (np.int64, np.uint8)]
                held = []
            found = []
            for (h, q), key in zip(table, (u, b), strict=True):
                at = np.minimum(np.searchsorted(h, key), max(len(h) - 1, 0))
                found.append(np.where(h[at] == key, q[at], 0).astype(q.dtype) if len(h) else np.zeros(len(key), q.dtype))
            out.append((chunk, r, pack_counts(found[0]), found[1].tobytes()))
            if len(out) >= 1000:
                yield done()
                out = []
    if out:
        yield done()


@dataclass
class Model:
    """What scoring needs. frequent: hashes, in order, and log10(count + 1) of the most frequent tokens.

    grams: all n-grams and counts as blocks of hash ranges, `slices` in all, for what the filter has no room for.
    """

    filter: Filter
    n_tokens: int
    n_words: int
    n_texts: int
    unknown: float  # probability of all tokens that the filter doesn't know
    known_mass: float  # sum of the filter's token counts
    weight: float  # how many observations the token's own probability counts for after a context
    frequent: tuple[np.ndarray, np.ndarray]
    least: tuple[int, int] = (1, 1)  # levels below are not in the filter
    grams: DataFrame | None = None
    slices: int = 1

    def parts(self) -> tuple:
        f = self.filter
        return f.bits, f.blocks, f.block_bits, f.probes, self.n_tokens, self.n_words, self.n_texts, self.unknown, self.known_mass, self.weight, self.frequent, self.least

    def log_probs(self, h: np.ndarray, n: np.ndarray, weight: float | None = None) -> np.ndarray:
        """log10 probability of each token after the one before it, by what the filter alone knows."""
        u, back = np.unique(h, return_inverse=True)
        c = WORTH[self.filter.levels(u, 0)][back]
        before = np.empty_like(c)
        before[1:] = c[:-1]
        before[np.cumsum(n) - n] = self.n_texts
        return self.terms(c, before, WORTH[self.filter.levels(pairs(h, n), 1)], self.weight if weight is None else weight)

    def terms(self, c: np.ndarray, before: np.ndarray, both: np.ndarray, w: float) -> np.ndarray:
        """log10 probabilities from the counts of tokens, of those before them and of the pairs."""
        own = np.where(c > 0, (1 - self.unknown) * c / max(self.known_mass, 1), self.unknown)
        both = np.where(c > 0, np.minimum(both, before), 0)
        return np.log10(np.maximum((both + w * own) / (before + w), 1e-300))


def model_of(p: tuple) -> Model:
    return Model(Filter(*p[:4]), *p[4:])


def train(docs: DataFrame, text_col: str = "text", max_bits: int = 1 << 28, bits_per_item: int = 12, frequent: int = 1 << 18, slice_bytes: int = 2 << 20, flush: int = 2_000_000, fan_out: int = 4096) -> tuple[Model, DataFrame]:
    """A pair model of all texts, and (h, c): the exact count of every token by its 64-bit hash.

    Tokens are lower-cased (A-Z) words and one end a text. The filter takes bits_per_item bits for each (n-gram, level), up to max_bits (32 MB),
    beyond which the least counts that it holds rise, pairs first: its size is bounded, whatever the
    corpus. It has no pairs seen once. score() asks the model's blocks for all that the filter leaves out. The smoothing weight comes from all
    counts (matched_weight).
    Null texts are empty; no texts give a model that knows no token.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    distinct = texts.groupBy(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")).agg(F.count("*").alias("copies"), F.max(size).alias("size"))
    n_texts, volume, single = (x or 0 for x in distinct.agg(F.sum("copies"), F.sum(F.col("copies") * F.col("size")), F.sum(F.when(F.col("copies") == 1, F.col("size")))).first())
    slices = 1 << max(4, (volume // slice_bytes).bit_length())
    # a task deals to fan_out ranges at most, so blocks stay large; more ranges are reached by dealing again
    wide = min(slices, fan_out)
    rows = texts.mapInArrow(_count(wide, flush), "slice int, u binary, b binary")
    while wide < slices:
        wide = min(slices, wide * fan_out)
        rows = rows.repartition("slice").sortWithinPartitions("slice").mapInArrow(_deal_finer(wide, flush), "slice int, u binary, b binary")
    grams = rows.repartition("slice").sortWithinPartitions("slice").mapInArrow(_gather(), "slice int, u binary, b binary, n_tokens long, levels_u array<long>, levels_b array<long>, once long")
    grams = materialize(grams, "grams")
    n_tokens, once = (x or 0 for x in grams.agg(F.sum("n_tokens"), F.sum("once")).first())
    hist = {k: np.zeros(LEVELS, np.int64) for k in ("levels_u", "levels_b")}
    for k, h in hist.items():
        for r in grams.select(F.posexplode(k).alias("q", "n")).groupBy("q").agg(F.sum("n").alias("n")).collect():
            h[r.q] = r.n
    # the filter's size, and what it holds
    least = [1, 2]  # pairs seen once, most of all, would fill it; scoring asks for them
    items = lambda: sum(int((hist[k][m:] * np.arange(m, LEVELS)).sum()) for k, m in zip(("levels_u", "levels_b"), least, strict=True))
    while items() * bits_per_item > max_bits:
        k = 1 if least[1] <= least[0] + 2 else 0
        least[k] += 1
    blocks = min(slices.bit_length() - 1, 12)
    total = min(max_bits, 1 << max(blocks + 10, (items() * bits_per_item).bit_length()))
    shape = Filter(np.empty(0, np.uint8), blocks, total.bit_length() - 1 - blocks, max(1, min(8, round(0.69 * total / max(1, items())))))
    set_bits = grams.select("slice", "u", "b").mapInArrow(_set_bits(shape, tuple(least), slices.bit_length() - 1 - blocks), "block int, bits binary")
    size = 1 << (shape.block_bits - 3)
    shape.bits = np.zeros(size << blocks, np.uint8)
    for r in set_bits.repartition("block").sortWithinPartitions("block").mapInArrow(_or_bits, "block int, bits binary").toLocalIterator():  # max_bits in all
        shape.bits[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)

    def counts(from_level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                for g in x.column(0).to_pylist():
                    h, c = unpack(g)
                    ok = level_of(c) >= from_level
                    yield pa.RecordBatch.from_arrays([pa.array(h[ok].view(np.int64)), pa.array(c[ok])], names=["h", "c"])

        return grams.select("u").mapInArrow(run, "h long, c long")

    exact = counts(1)
    # the most frequent: all tokens from the lowest level at which they are few enough, found without a sort
    upward = np.cumsum(hist["levels_u"][::-1])[::-1]
    from_level = max(1, int(np.argmax(upward <= frequent)))
    top = counts(from_level).toArrow()
    h, c = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
    o = np.argsort(h)
    unknown = min(0.5, max(once, 1) / max(n_tokens, 2))
    known_mass = float((hist["levels_u"] * WORTH).sum())
    weight = matched_weight(hist["levels_u"], int(hist["levels_b"][1]), n_tokens * single / max(volume, 1))
    return Model(shape, n_tokens, int(hist["levels_u"].sum()), n_texts, unknown, known_mass, weight, (h[o], np.log10(c[o] + 1.0)), tuple(least), grams.select("slice", "u", "b"), slices), exact


def matched_weight(levels: np.ndarray, once: int, tokens_of_single_texts: float) -> float:
    """The weight under which the tokens' own probabilities get the mass that pairs not seen have (Good and Turing).

    levels: how many tokens have each quantised count. Of the tokens in texts without exact copies the share in
    pairs seen once is what would be new if a text were left out; copies say nothing of that. With weight w a context of count c leaves
    w / (c + w) to the tokens' own probabilities; the mean over all tokens' contexts is to equal the share.
    """
    c = WORTH[: len(levels)]
    if not once or tokens_of_single_texts <= 0:
        return 1000.0
    share = min(once / tokens_of_single_texts, 0.999)
    low, high = -7.0, 30.0
    for _ in range(60):
        w = np.exp((low + high) / 2)
        if (levels * c * w / (c + w)).sum() < share * (levels * c).sum():
            low = np.log(w)
        else:
            high = np.log(w)
    return float(np.exp(high))


def _look_up(shared, kind: str, flush: int, ranges: int):
    """Rows with what the worker's filter and frequent counts tell, and what each chunk of texts has to ask.

    The first text of a chunk has for all of them: in `open` four packed values for each token that waits, that is the level
    of the pair, of the token and of the one before (LEVELS: a text's start), or -1 - i for the chunk's i-th asked pair or
    token, and the text's number; in `tail` i and the text's number for each token whose exact count is asked. Both go by
    what is asked, not by place, so the first value costs next to nothing. A chunk is named by its content and task: should
    a task run again over texts in another order, its texts find no answers, not wrong ones. Texts are dealt to ranges in turn.
    """
    names = ["range", "chunk", "slice", "u", "b", *DOC]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(shared.value)
        top, logs = m.frequent
        worth = np.append(WORTH, m.n_texts)
        made = 0

        def out() -> Iterator[pa.RecordBatch]:
            h, n = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            row = pa.chunked_array([x[2] for x in held]).combine_chunks()
            chunk = int(np.uint64(xxhash.xxh64_intdigest(np.concatenate([np.array([TaskContext.get().partitionId(), made], np.uint64), n.astype(np.uint64), h]))).view(np.int64))
            start = np.cumsum(n) - n
            code, asked = [], []
            for kind_no, x in enumerate((h, pairs(h, n))):
                key, back = np.unique(x, return_inverse=True)
                q = m.filter.levels(key, kind_no)
                miss = q < m.least[kind_no]
                ask = miss
                if kind_no == 0:
                    at = np.minimum(np.searchsorted(top, key), max(len(top) - 1, 0))
                    hit = top[at] == key if len(top) else np.zeros(len(key), bool)
                    ask = miss | ~hit
                    base = np.add.reduceat(np.where(hit, logs[at], 0.0)[back] if len(top) else np.zeros(len(h)), start)
                    hit = hit[back]
                    rare = (np.cumsum(ask) - 1).astype(np.int32)[back[~hit]]
                q[miss] = -np.cumsum(ask)[miss]
                code.append(q.astype(np.int32)[back])
                asked.append((key[ask], np.ones(int(ask.sum()), np.int64)))
            known = np.add.reduceat(hit.astype(np.int64), start)
            no = np.arange(len(n), dtype=np.int32)
            of = np.repeat(no, n)
            rest = [None] * (len(n) - 1)
            tail = pa.array([pack_codes(np.stack([rare, of[~hit]])), *rest], pa.binary())
            own, both = code
            before = np.empty_like(own)
            before[1:] = own[:-1]
            before[start] = LEVELS
            waits = (own < 0) | (before < 0) | (both < 0)
            prob = np.zeros(len(h))
            prob[~waits] = m.terms(*(worth[x[~waits]] for x in (own, before, both)), m.weight)
            late = pa.array([pack_codes(np.stack([x[waits] for x in (both, own, before, of)])), *rest], pa.binary())
            docs = [pa.array(no), row, pa.array(n), pa.array(known), pa.array(base), pa.array(np.add.reduceat(prob, start)), tail, late]
            nothing = [pa.nulls(len(n), t) for t in (pa.int32(), pa.binary(), pa.binary())]
            ranged = pa.array(((chunk + np.arange(len(n))) % ranges).astype(np.int32))
            yield pa.RecordBatch.from_arrays([ranged, pa.array(np.full(len(n), chunk)), *nothing, *docs], names=names)
            ask = dealt(*asked, ranges)
            if ask.num_rows:
                yield pa.RecordBatch.from_arrays([ask.column(0), pa.array(np.full(ask.num_rows, chunk)), *ask.columns, *(pa.nulls(ask.num_rows, x.type) for x in docs)], names=names)

        held, size = [], 0
        for x in batches:
            for i in range(0, x.num_rows, 500):
                part = x.slice(i, 500)
                h, n = tokens(part.column(0).cast(pa.binary()).to_pylist())
                held.append((h, n, part.column(1)))
                size += len(h)
                if size >= flush:
                    yield from out()
                    made += 1
                    held, size = [], 0
        if held:
            yield from out()

    return run, f"range int, chunk long, slice int, u binary, b binary, no int, row {kind}, n_tokens long, known long, base double, score double, tail binary, open binary"


def _resolve(shared, kind: str):
    """Texts with the answers that they waited for; of each chunk the answers come first, in the order of ranges."""

    def added(m: Model, worth: np.ndarray, tail: bytes | None, waits: bytes | None, us: list[bytes], bs: list[bytes]) -> dict[str, np.ndarray]:
        """What the answers add to each text of a chunk."""
        counts = np.concatenate([np.empty(0, np.int64), *map(unpack_counts, us)])
        own, both = np.where(counts > 0, level_of(counts), 0), np.frombuffer(b"".join(bs), np.uint8)
        rare, of = unpack_codes(tail, 2)
        out = {"known": np.bincount(of[counts[rare] > 0]), "base": np.bincount(of, np.log10(counts[rare] + 1.0))}
        *codes, of = unpack_codes(waits, 4)
        for q, c in zip((both, own, own), codes, strict=True):
            c[c < 0] = q[-1 - c[c < 0]]
        pair, token, before = (worth[c] for c in codes)
        return out | {"score": np.bincount(of, m.terms(token, before, pair, m.weight))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(shared.value)
        worth = np.append(WORTH, m.n_texts)
        now, answers = None, [[], []]
        late: dict[str, np.ndarray] = {}
        for x in batches:
            chunk = x.column("chunk").to_numpy()
            is_answer = x.column("range").is_valid().to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((chunk[1:] != chunk[:-1]) | (is_answer[1:] != is_answer[:-1])) + 1
            for s, e in zip([0, *cut], [*cut, len(chunk)], strict=True):
                if s == e:
                    continue
                if chunk[s] != now:
                    now, answers, late = chunk[s], [[], []], {}
                part = x.slice(s, e - s)
                if is_answer[s]:
                    for a, c in zip(answers, ("u", "b"), strict=True):
                        a += part.column(c).to_pylist()
                    continue
                no = part.column("no").to_numpy()
                if no[0] == 0:
                    late = added(m, worth, *(part.column(c)[0].as_py() for c in ("tail", "open")), *answers)
                known, base, score = (part.column(c).to_numpy() + np.append(late[c], np.zeros(max(0, no[-1] + 1 - len(late[c])), late[c].dtype))[no] for c in ("known", "base", "score"))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("n_tokens"), pa.array(known), pa.array(base), pa.array(score)], names=DOC[1:6])

    return run, f"row {kind}, n_tokens long, known long, base double, score double"


def score(docs: DataFrame, model: Model, exact: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), flush: int = 1_000_000, fan_out: int = 4096) -> DataFrame:
    """(id, *keep, n_tokens, n_known, train_tokens, base_score, score) for each row.

    base_score adds log10((c + 1) / (N + V + 1)) over the tokens with exact counts c; score is the
    model's log10 probability. A null text is empty and has one token, its end. Repeated rows are each
    scored, ties in chunks do not matter, and no rows give none; a long text is scored whole. Other columns are
    only read if kept; a kept column with the name of a result ends in _in.

    exact is not read: the model's blocks have the same counts. Nothing is written for it, and kept columns are
    dealt twice: what a chunk asks goes to the hash ranges together with its rows, and the answers with the rows to the chunk.
    """
    small_batches(docs.sparkSession)
    chosen = docs.select(F.col(text_col).alias("__text"), F.struct(F.col(id_col).alias("id"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]).alias("row"))
    kind = chosen.schema["row"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())
    ranges = min(model.slices, fan_out)
    rows = chosen.mapInArrow(*_look_up(shared, kind, flush, ranges))
    coarse = (model.slices // ranges).bit_length() - 1
    held = model.grams.select(F.shiftright("slice", coarse).alias("range"), "slice", "u", "b")
    answered = held.unionByName(rows, allowMissingColumns=True).repartition("range").sortWithinPartitions("range", "chunk", "slice")
    answered = answered.mapInArrow(_answer, f"chunk long, range int, u binary, b binary, no int, row {kind}, n_tokens long, known long, base double, score double, tail binary, open binary")
    out = answered.repartition("chunk").sortWithinPartitions("chunk", F.col("range").isNull(), "range", "no").mapInArrow(*_resolve(shared, kind))
    each = float(np.log10(model.n_tokens + model.n_words + 1.0))
    made = [id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    names = clear_of(list(keep), made)
    return out.select(
        F.col("row.id").alias(id_col), *[F.col(f"row.k{i}").alias(c) for i, c in enumerate(names)], "n_tokens",
        F.col("known").alias("n_known"), F.lit(model.n_tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * each).alias("base_score"), "score",
    )
