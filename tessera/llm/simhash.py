"""SimHash near-duplicates: pigeonhole blocks find candidates, Hamming distance verifies them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.common import materialize, may_be_among, release, small_batches, written
from tessera.llm.components import connected_components

FULL = (1 << 64) - 1


def shingles(words: list[bytes], n: int) -> Iterator[bytes]:
    """Runs of n words; of fewer words, the whole sequence."""
    return iter([b" ".join(words)]) if len(words) < n else map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))


def simhash(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of word shingles, unsigned. No words: 0. Fewer words than a shingle: one shingle of all."""
    words = text.lower().split()  # bytes: A-Z and the six ASCII white spaces only
    return majority(np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in shingles(words, shingle)), np.uint64)) if words else 0


def majority(h: np.ndarray, piece: int = 1 << 15) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), piece):
        ones += np.unpackbits(h[i : i + piece].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = 3, seed: int = 42) -> Column:
    """The SimHash as a signed long; a null text is empty."""

    @F.arrow_udf(T.LongType())
    def of(texts: pa.Array) -> pa.Array:
        out = np.fromiter((simhash(t or b"", shingle, seed) for t in texts.cast(pa.binary()).to_pylist()), np.uint64, len(texts))
        return pa.array(out.view(np.int64))

    return of(text)


def as_hex(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def chunks_of(bits: list[int], n: int) -> list[int]:
    """Masks that share out the given bit positions evenly."""
    return [sum(1 << b for b in part) for part in (bits[len(bits) * i // n : len(bits) * (i + 1) // n] for i in range(n)) if part]


def block_masks(distance: int, blocks: int) -> list[int]:
    """Two values at the distance or less agree on one of these masks at least."""
    return [sum(c) for c in combinations(chunks_of(list(range(64)), blocks), blocks - distance)]


def finer(mask: int, distance: int) -> list[int]:
    """Masks that also hold one of distance + 1 shares of the free bits: the pigeonhole once more, within a bucket."""
    return [mask | m for m in chunks_of([i for i in range(64) if not mask >> i & 1], distance + 1)]


def _keyed(df: DataFrame, masks: Column) -> DataFrame:
    return df.select("fp", "node", "check", F.explode(masks).alias("mask")).withColumn("bucket", F.col("fp").bitwiseAND(F.col("mask")))


def _mask_array(masks: list[int]) -> Column:
    return F.array(*[F.lit(signed(m)) for m in masks])


def spanning_links(fp: np.ndarray, distance: int, check: np.ndarray | None = None, check_distance: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """Links (one index, many indexes) that connect all that close pairs connect: one fewer than members each.

    Pairs are close within the distance, and by their check words within check_distance. A value that
    has been reached is not compared again, so a dense group costs few comparisons and emits a tree of
    links rather than all its pairs.
    """
    rest = np.arange(len(fp))
    while len(rest) > 1:
        root, frontier, rest = rest[0], [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = np.bitwise_count(fp[rest] ^ fp[x]) <= distance
            if check is not None and near.any():
                near[near] = np.bitwise_count(check[rest[near]] ^ check[x]).sum(axis=1) <= check_distance
            if near.any():
                found, rest = rest[near], rest[~near]
                frontier.extend(found)
                yield root, found


def _link(distance: int, check_distance: int | None):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(key: np.ndarray, fp: np.ndarray, node: np.ndarray, check: np.ndarray | None) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            starts, ends = np.concatenate([[0], cut]), np.append(cut, len(fp))
            a, b = [], []
            for i in np.flatnonzero(ends - starts > 1):
                s, e = starts[i], ends[i]
                for one, many in spanning_links(fp[s:e], distance, None if check is None else check[s:e], check_distance or 0):
                    a.append(np.full(len(many), node[s + one]))
                    b.append(node[s + many])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], schema=schema)

        held: list[np.ndarray] = []
        for x in batches:
            if not x.num_rows:
                continue
            n = x.num_rows
            new = [np.stack([x.column(i).to_numpy() for i in (0, 1)], axis=1), x.column(2).to_numpy().view(np.uint64), x.column(3).to_numpy()]
            new.append(None if check_distance is None else x.column(4).flatten().to_numpy().view(np.uint64).reshape(n, -1))
            held = [u if u is None else np.concatenate([h, u]) for h, u in zip(held, new, strict=True)] if held else new
            other = np.flatnonzero((held[0] != held[0][-1]).any(axis=1))
            if len(other):
                last = int(other[-1]) + 1  # the last bucket may go on
                yield from links(*[h if h is None else h[:last] for h in held])
                held = [h if h is None else h[last:] for h in held]
        if held:
            yield from links(*held)

    return run


def near_links(prints: DataFrame, column: str, distance: int = 3, blocks: int = 5, node: str | None = None, check: str | None = None, check_distance: int = 0, max_bucket: int = 20_000) -> DataFrame:
    """(a, b): links between distinct 64-bit values, enough to connect all that lie within the distance.

    Values are cut into blocks; each choice of blocks - distance blocks is a key on which close pairs
    must meet. A bucket of over max_bucket distinct values is dealt out again by shares of its
    remaining bits, level by level, until the buckets are small (the free bits bound them), so no
    bucket grows with the data and none is cut short. node: the ids to link (the values themselves if
    none); check: an array of longs of which check_distance bits may differ at most.
    """
    spark = prints.sparkSession
    prints = prints.select(F.col(column).alias("fp"), F.col(node or column).alias("node"), (F.col(check) if check else F.lit(None).cast("array<long>")).alias("check"))
    masks = block_masks(distance, blocks)
    level, done = _keyed(prints, _mask_array(masks)), []
    while True:
        big = materialize(level.groupBy("mask", "bucket").count().where(F.col("count") > max_bucket).drop("count"), "buckets")
        children = {m: finer(m, distance) for m in masks}
        if min(64 - m.bit_count() for m in masks) <= max(distance + 1, 14) or big.isEmpty():
            done.append(level)
            break
        done.append(level.join(big, ["mask", "bucket"], "left_anti"))
        table = spark.createDataFrame([(signed(m), [signed(c) for c in cs]) for m, cs in children.items()], "mask long, masks array<long>")
        hot = materialize(level.join(big, ["mask", "bucket"], "left_semi").join(F.broadcast(table), "mask").select("fp", "node", "check", "masks"), "hot")  # one row a mask, fixed by the parameters
        level, masks = _keyed(hot, F.col("masks")).distinct(), sorted({c for cs in children.values() for c in cs})
    names = ["mask", "bucket", "fp", "node"] + ["check"] * bool(check)
    rows = done[0].select(*names)
    for x in done[1:]:
        rows = rows.unionByName(x.select(*names))
    rows = rows.repartition("mask", "bucket").sortWithinPartitions("mask", "bucket", "fp")
    return rows.mapInArrow(_link(distance, check_distance if check else None), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3, seed: int = 42) -> DataFrame:
    """(id, fingerprint_bits, component_id) for each row; component_id is the least id reachable over links.

    Exact copies share a fingerprint, so only distinct fingerprints are compared. Null and empty texts
    have fingerprint 0 and are linked like others. Rows are the nodes: repeated ids are each kept, a
    null id is kept and never a component's id unless all ids of the component are null. Other columns
    are not read. An empty table gives no rows.
    """
    since = written()
    small_batches(docs.sparkSession)
    rows = materialize(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle, seed).alias("fp")), "fingerprints")
    prints = materialize(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "prints")
    comps = materialize(connected_components(near_links(prints, "fp", distance), "a", "b").select(F.col("node").alias("fp"), "root"), "components")
    named = prints.join(comps, "fp").groupBy("root").agg(F.min("first_id").alias("component"))
    known = comps.join(named, "root").select("fp", "component")
    labels = materialize(prints.join(known, "fp", "left").select("fp", F.coalesce("component", "first_id").alias("component_id")), "labels")
    release(docs.sparkSession, since, (rows, labels))
    return rows.join(labels, "fp", "left").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint_bits"), "component_id")


def min_bands(h: np.ndarray, bands: int, width: int, piece: int = 1 << 12) -> np.ndarray:
    """A key for each band: its `width` least values of the hashes under as many orders. Sets of similarity s share one with s ** width."""
    odd = np.random.default_rng(7).integers(0, 1 << 63, (2, bands * width), np.uint64) << np.uint64(1) | np.uint64(1)
    least = np.full(bands * width, FULL, np.uint64)
    for i in range(0, len(h), piece):
        x = h[i : i + piece, None] * odd[0]
        np.minimum(least, (x ^ (x >> np.uint64(29))).min(axis=0), out=least)
    return (least * odd[1]).reshape(bands, width).sum(axis=1, dtype=np.uint64).view(np.int64)


def signature(text: Column, shingle: int = 5, seed: int = 42, bands: int = 12, width: int = 5) -> Column:
    """[SimHash of the distinct words, two SimHashes of the distinct shingles, keys of min-hash bands of these]."""

    @F.arrow_udf("array<long>")
    def of(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.cast(pa.binary()).to_pylist():
            w = (t or b"").lower().split()
            if not w:
                out.append([0] * (3 + bands))
                continue
            grams = set(shingles(w, shingle))
            hs = [np.fromiter((xxhash.xxh64_intdigest(g, s) for g in fs), np.uint64, len(fs)) for fs, s in ((set(w), seed), (grams, seed + 1), (grams, seed + 2))]
            out.append([signed(majority(h)) for h in hs] + min_bands(hs[1], bands, width).tolist())
        return pa.array(out, pa.list_(pa.int64()))

    return of(text)


def similar_groups(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The least index that each set reaches over pairs of at least that Jaccard similarity.

    Lists of the sets that hold a value give intersections. A set that has been reached leaves the lists,
    so a dense group costs few comparisons.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    ends = np.cumsum(sizes)
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    o = np.argsort(ids, kind="stable")
    holder, of = np.repeat(np.arange(len(sets)), sizes)[o], ids[o]
    label = np.full(len(sets), -1, np.int64)
    left = listed = len(sets)
    first = np.searchsorted(of, np.arange(len(values) + 1))
    for i in range(len(sets)):
        if label[i] >= 0:
            continue
        label[i], frontier = i, [i]
        left -= 1
        while frontier and left:
            x = frontier.pop()
            mine = ids[ends[x] - sizes[x] : ends[x]]
            n = first[mine + 1] - first[mine]
            met = holder[np.repeat(first[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            other, both = np.unique(met[label[met] < 0], return_counts=True)
            found = other[both >= similarity * (sizes[x] + sizes[other] - both) - 1e-9]
            label[found] = i
            left -= len(found)
            frontier.extend(found.tolist())
            if 2 * left < listed:
                keep = label[holder] < 0
                holder, of, listed = holder[keep], of[keep], left
                first = np.searchsorted(of, np.arange(len(values) + 1))
    return label


def _verify(shingle: int, similarity: float):
    """Groups of similar texts among the candidates of each root, which are consecutive rows; equal texts follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        nodes: list[int] = []
        sets: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            a = np.array(nodes, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(a[similar_groups(sets, similarity)])], names=["node", "component"])

        for x in batches:
            for root, node, text in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(2).cast(pa.binary()).to_pylist(), strict=True):
                if root != now:
                    if nodes:
                        yield out()
                    now, nodes, sets = root, [], []
                if not nodes or node != nodes[-1]:
                    grams = set(shingles((text or b"").lower().split(), shingle))
                    nodes.append(node)
                    sets.append(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, len(grams)))
        if nodes:
            yield out()

    return run


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, distance: int = 6, blocks: int = 8, check_distance: int = 30, similarity: float = 0.8) -> DataFrame:
    """(id, text_hash, component) for each row: groups of texts linked by pairs with 0.8 or more of their five-word shingles in common.

    Two searches find candidates. A SimHash of shingles is too far apart for such pairs (9 of 64 bits at a
    similarity of 0.8), so pigeonhole blocks join on the SimHash of the distinct words (3 or 4 bits apart, 6
    or fewer in 95 of 100 pairs) and 128 bits of shingle SimHash; and bands of min-hashes of the shingles are
    shared by 991 of 1,000 pairs at 0.8. What either links is a set of candidates, in which the Jaccard
    similarity of the shingles themselves decides. A task holds the shingles of one such set of distinct texts.
    component is the least text_hash (64 bits) of the group. Null and empty texts are one group. Only texts that
    may stand for a set's member are shuffled, one row a distinct text.
    """
    small_batches(docs.sparkSession)
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = materialize(docs.select(F.col(id_col).alias("id"), hashed.alias("text_hash"), signature(F.col(text_col), shingle).alias("s")), "signatures")
    named = materialize(rows.groupBy(F.col("text_hash").alias("node")).agg(F.first("s").alias("s"), F.min("id").alias("id")), "prints")
    links = near_links(named.select(F.col("s")[0].alias("fp"), "node", F.slice("s", 2, 2).alias("check")), "fp", distance, blocks, "node", "check", check_distance)
    keys = named.select("node", F.posexplode(F.slice("s", 4, 1 << 20)).alias("band", "key"))
    shared = keys.select("node", F.min("node").over(Window.partitionBy("band", "key")).alias("a")).where("a != node")
    comps = materialize(connected_components(links.unionByName(shared.select("a", F.col("node").alias("b"))), "a", "b"), "components")
    stands = materialize(comps.join(named.select("node", "id"), "node").select("node", "root", F.xxhash64("node", "id").alias("key")), "stands")
    first = docs.select(hashed.alias("node"), F.xxhash64(hashed, F.col(id_col)).alias("key"), F.col(text_col).alias("text"))
    texts = may_be_among(first, F.col("key"), stands, "key", "maybe").where("maybe").select("node", "key", "text").join(stands, ["key", "node"]).select("root", "node", "text")
    labels = materialize(texts.repartition("root").sortWithinPartitions("root", "node").mapInArrow(_verify(shingle, similarity), "node long, component long"), "labels")
    return rows.select("id", "text_hash").join(labels, F.col("text_hash") == F.col("node"), "left").select(F.col("id").alias(id_col), "text_hash", F.coalesce("component", "text_hash").alias("component"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without near copies: of each group of similar_documents() the row of least id stays (nulls last), whole.

    Ties of ids go to the text of least hash. Rows equal in id and text are copies of each other and one stays.
    Null and empty texts are one group. All columns are kept, whatever their names; an empty table stays empty.
    Rows that surely stay are passed on as they are; only those that may go are shuffled.
    """
    since = written()
    groups = similar_documents(docs, id_col, text_col, **how).withColumnRenamed(id_col, "id")
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "text_hash")).alias("f")).select(F.col("f.id").alias("first_id"), F.col("f.text_hash").alias("first_hash"))
    each = groups.groupBy("id", "text_hash").agg(F.count("*").alias("n"))  # rows meet the first ones by what they are, not by their group, which may be a third of all
    each = each.join(first, (F.col("text_hash") == F.col("first_hash")) & F.col("id").eqNullSafe(F.col("first_id")), "left")
    stays = F.col("first_hash").isNotNull()
    acted = each.select(F.col("id").alias("__id"), F.col("text_hash").alias("__h"), F.xxhash64("text_hash", "id").alias("__key"), stays.alias("__stays"), F.col("n").alias("__n"))
    acted = materialize(acted.where("not __stays or __n > 1"), "acted")
    release(docs.sparkSession, since, (acted,))
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    key = F.xxhash64(h, F.col(id_col))
    marked = may_be_among(docs, key, acted, "__key", "__maybe")
    found = marked.where("__maybe").join(acted, (key == acted["__key"]) & marked[id_col].eqNullSafe(acted["__id"]) & (h == acted["__h"]), "left")
    out = marked.where("not __maybe").select(*docs.columns).unionByName(found.where("__stays is null").select(*docs.columns))
    if acted.where("__stays").isEmpty():
        return out
    return out.unionByName(found.where("__stays").dropDuplicates(["__key", "__id", "__h"]).select(*docs.columns))
