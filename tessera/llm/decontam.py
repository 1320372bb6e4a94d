"""Benchmark decontamination: prefix-filtered join of word windows, verified exactly."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, beside, materialize, may_be_among, small_batches, text_or_empty

#: Words are runs outside this class: ASCII but for digits and letters.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: One pass that lower-cases A-Z and makes each separator a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
RESULT = "n_words long, n_hit long, item_ids array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)] or ([tuple(words)] if words else [])


def prefix_index(items: list[tuple[str, bytes]], size: int, seen: dict[bytes, int]) -> tuple[dict, dict]:
    """Item windows by their rarest word, and the windows' owners.

    For a containment of 1 the necessary prefix of a window in rarity order is one word: a window can
    only occur where that word does. Its place in the window fixes where the window would start, so a
    candidate needs one comparison.
    """
    owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for i, text in items:
        for w in windows_of(words_of(text), size):
            owners[w].add(i)
    places: dict[bytes, set[tuple[int, int]]] = defaultdict(set)
    for w in owners:
        at = min(range(len(w)), key=lambda k: (seen.get(w[k], 0), w[k], k))
        places[w[at]].add((at, len(w)))
    return {w: tuple(sorted(p)) for w, p in places.items()}, {w: tuple(sorted(o)) for w, o in owners.items()}


def find(words: list[bytes], places: dict, owners: dict) -> tuple[int, set[str]]:
    """How many words lie in occurrences of windows, and whose windows they are."""
    n, hit, upto, items, spans = len(words), 0, 0, set(), []
    for i, w in enumerate(words):
        if w in places:
            for at, size in places[w]:
                s = i - at
                if s >= 0 and s + size <= n and (found := owners.get(tuple(words[s : s + size]))):
                    spans.append((s, s + size))
                    items.update(found)
    for a, b in sorted(spans):
        hit += max(0, b - max(a, upto))
        upto = max(upto, b)
    return hit, items


def _counted(docs: DataFrame, vocabulary: frozenset[bytes] | None, flush: int = 1 << 20) -> DataFrame:
    """(w, n): how often words occur in all documents (text), of a vocabulary or all; tasks add up some `flush` words before they are shuffled."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, counts = known.value, Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["w", "n"])
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                counts.update(words_of(t) if vocab is None else filter(vocab.__contains__, words_of(t)))
            if len(counts) > flush:
                yield out()
                counts.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _word_counts(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often each benchmark word occurs in all documents: as many rows as the benchmark has words at most."""
    return {bytes(r.w): r.n for r in _counted(docs, frozenset(vocabulary)).collect()}


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    size: int = 10, max_broadcast: int = 16 << 20,
) -> DataFrame:
    """docs with contamination: a struct of n_words, n_hit and the ids of items of which a window occurs.

    A window is `size` consecutive words of an item, or a whole shorter item; a document word is hit if
    it lies in an occurrence of one. Null texts have no words; items without words never occur; items
    that share an id are one item; a null item id reads as the empty string. Of equally rare words of a
    window one is taken; repeated rows each have their result; long texts are read whole; no documents give no
    rows. All rows and columns of docs are kept; one named contamination stays as contamination_in. Items of up to max_broadcast bytes in all (measured first) go to the tasks as an
    index; larger sets are joined by shuffles instead.
    """
    small_batches(docs.sparkSession)
    bench = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), text_or_empty(F.col(item_text)).alias("text"))
    volume = bench.agg(F.sum(F.octet_length("text") + F.octet_length("item") + 16)).first()[0] or 0
    if volume > max_broadcast:
        return _by_shuffle(docs, bench, text_col, size)
    pairs = [(r["item"], r.text.encode()) for r in bench.collect()]
    seen = _word_counts(docs.select(F.col(text_col).alias("text")), {w for _, t in pairs for w in words_of(t)})
    shared = docs.sparkSession.sparkContext.broadcast(prefix_index(pairs, size, seen))

    @F.arrow_udf(RESULT)
    def of(texts: pa.Array) -> pa.Array:
        (places, owners), out = shared.value, []
        for t in texts.cast(pa.binary()).to_pylist():
            w = words_of(t)
            n, found = find(w, places, owners)
            out.append((len(w), n, sorted(found)))
        a, b, c = zip(*out, strict=True) if out else ([], [], [])
        return pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.list_(pa.string()))], names=["n_words", "n_hit", "item_ids"])

    both = docs.select(F.struct(*docs.columns).alias("d"), of(F.col(text_col)).alias("c"))
    return both.select(*beside(docs.columns, F.col("d"), ["contamination"]), F.col("c").alias("contamination"))


def _by_shuffle(docs: DataFrame, bench: DataFrame, text_col: str, size: int) -> DataFrame:
    """The same for benchmarks of any size: windows and documents meet on the window's rarest word.

    How rare words are is counted in the tasks first, so that of the documents only occurrences of windows' rarest
    words are shuffled; candidate starts go back to their documents, where the window is compared.
    """
    words = lambda c: F.filter(F.split(ascii_lower(c), BREAK), lambda x: x != "")
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("row_no"), F.struct(*docs.columns).alias("d")), "rows")
    w = words(F.col("text"))
    slices = F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1))), lambda i: F.slice(w, i, size))).when(F.size(w) > 0, F.array(w))
    windows = materialize(bench.select("item", F.explode(slices).alias("window")).groupBy("window").agg(F.collect_set("item").alias("items")), "windows")
    seen = _counted(numbered.select(F.col("d")[text_col].alias("text")), None).select(F.decode("w", "UTF-8").alias("w"), "n")
    rare = windows.select("window", F.posexplode("window").alias("at", "w")).join(seen, "w", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w", "at")).alias("r"))
    rare = materialize(rare.where("r.n > 0"), "rare")
    tokens = numbered.select("row_no", F.posexplode(words(text_or_empty(F.col("d")[text_col]))).alias("pos", "w"))
    tokens = may_be_among(tokens, F.xxhash64("w"), rare.select(F.xxhash64("r.w").alias("key")).distinct(), "key", "maybe").where("maybe")
    starts = tokens.join(rare.select("window", F.col("r.w").alias("w"), F.col("r.at").alias("at")), "w").select("row_no", "window", (F.col("pos") - F.col("at")).alias("s")).where("s >= 0")
    texts = numbered.select("row_no", words(text_or_empty(F.col("d")[text_col])).alias("ws"))
    found = starts.join(texts, "row_no").where(F.slice("ws", F.col("s") + 1, F.size("window")) == F.col("window")).join(windows, "window")
    spans = found.select("row_no", "items", F.explode(F.sequence(F.col("s"), F.col("s") + F.size("window") - 1)).alias("p"))
    hits = spans.groupBy("row_no").agg(F.countDistinct("p").alias("n_hit"))
    owners = found.select("row_no", F.explode("items").alias("i")).groupBy("row_no").agg(F.array_sort(F.collect_set("i")).alias("ids"))
    out = numbered.join(hits, "row_no", "left").join(owners, "row_no", "left")
    n_words = F.size(words(text_or_empty(F.col("d")[text_col]))).cast("long")
    result = F.struct(n_words.alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("ids", F.array().cast("array<string>")).alias("item_ids"))
    return out.select(*beside(docs.columns, F.col("d"), ["contamination"]), result.alias("contamination"))


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
