"""Token counts: pieces once per distinct pre-token, joined to each text's pre-token frequencies.

One pass over the texts splits them into pre-tokens and adds up each text's frequencies. The pieces of the
commonest pre-tokens, a number fixed by a parameter, are counted first and are in every worker; they meet
the frequencies where the text is. The other pre-tokens of a text are written out with their frequencies;
each distinct one is counted once in all, and a join by pre-token brings its pieces to the texts that have it.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from operator import mul

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import clear_of, materialize, small_batches

#: The published byte-level pre-token pattern (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points on which all versions of Unicode agree for that pattern; other texts are split by the library itself.
SETTLED = r"[^\t\n\r\x20-\x7e¡-ȳ]"


class Splitter:
    """Pre-token frequencies of texts, and pieces of pre-tokens, for a tokenizer file of the tokenizers library.

    Added tokens inside texts count as the library's default has it. `joins` tells whether the tokenizer's
    pre-tokens can be counted apart from each other (byte-level BPE); otherwise whole() counts a text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        self.model = None
        if path.endswith(".model"):
            import sentencepiece

            self.model, self.joins = sentencepiece.SentencePieceProcessor(model_file=path), False
            return
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        added = self.tok.get_added_tokens_decoder().values()
        plain = all(not (a.lstrip or a.rstrip or a.single_word or a.normalized) for a in added)
        self.joins = plain and self.tok.normalizer is None and str(self.tok.pre_tokenizer).startswith("ByteLevel(add_prefix_space=False")
        self.specials = re.compile("|".join(re.escape(a.content) for a in sorted(added, key=lambda a: -len(a.content)))) if added else None
        self.find, self.odd = regex.compile(BYTE_LEVEL).findall, re.compile(SETTLED).search

    def frequencies(self, text: str) -> tuple[Counter[str], int]:
        """Pre-tokens of a text with their frequencies, and the number of added tokens in it."""
        parts = self.specials.split(text) if self.specials and self.specials.search(text) else [text]
        table: Counter[str] = Counter()
        for p in parts:
            table.update(self.find(p) if not self.odd(p) else [p[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(p)])
        return table, len(parts) - 1

    def pieces(self, pre_tokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tok.encode_batch_fast(pre_tokens, add_special_tokens=False)]

    def whole(self, text: str) -> int:
        return len(self.model.encode(text) if self.model else self.tok.encode(text, add_special_tokens=False).ids)


class Known(dict):
    """Pieces by pre-token; what is missing counts as 0 and is noted."""

    def __init__(self, items: dict[str, int]):
        super().__init__(items)
        self.missing: list[str] = []

    def __missing__(self, p: str) -> int:
        self.missing.append(p)
        return 0


def commonest(texts: DataFrame, path: str, most: int, sample: int, longest: int = 64) -> dict[str, int]:
    """Pieces of at most `most` pre-tokens, the commonest in some `sample` texts that a hash picks; a choice that changes no count."""
    n = texts.count()
    if not (n and most):
        return {}
    part = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.lit(min(1 << 20, (sample << 20) // n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = Splitter(path), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(split.frequencies(t or "")[0])
            if len(seen) > 4 * most:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["p", "n"])
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["p", "n"])

    counts = texts.where(part).select("text").mapInArrow(run, "p string, n long").where(F.length("p") <= longest).groupBy("p").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "p").limit(most).select("p").toArrow().column("p").to_pylist()
    split = Splitter(path)
    return {p: k for i in range(0, len(top), 20_000) for p, k in zip(top[i : i + 20_000], split.pieces(top[i : i + 20_000]), strict=True)}


def _count(shared, path: str, kind: str) -> tuple[Callable, str]:
    """Rows with the count that the known pre-tokens make, and the other pre-tokens with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = Splitter(path), Known(shared.value)
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            sums, rest, freq, ends = [], [], [], [0]
            for t in b.column(0).to_pylist():
                if split.joins:
                    table, n = split.frequencies(t or "")
                    n += sum(map(mul, map(known.__getitem__, table), table.values()))
                    rest += known.missing
                    freq += map(table.__getitem__, known.missing)
                    known.missing.clear()
                else:
                    n = split.whole(t or "")
                sums.append(n)
                ends.append(len(rest))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(number, number + b.num_rows)), b.column(1), pa.array(sums, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(rest, pa.string())), pa.ListArray.from_arrays(ends, pa.array(freq, pa.int32()))],
                names=["row_no", "row", "n", "p", "f"],
            )
            number += b.num_rows

    return run, f"row_no long, row {kind}, n long, p array<string>, f array<int>"


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(split.pieces(b.column(0).to_pylist()), pa.int32())], names=["p", "k"])

    return run


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), most: int = 1 << 18, sample: int = 4000) -> DataFrame:
    """(id, *keep, n_bytes, n_tokens) for each row: UTF-8 bytes and tokens of its whole text by the tokenizer file at `path`.

    Tokens are as the file's library gives them, without begin, end or added special tokens, padding or
    truncation. Null and empty texts have none. Repeated rows are each counted, null ids are kept, an empty
    table gives no rows, and other columns are only read if kept; a kept column with the name of a result ends in _in.

    The pieces of at most `most` pre-tokens of 64 characters or fewer go to the workers (some 20 MB). The table
    of all other distinct pre-tokens is made by one shuffle and joined by another; a pre-token that a hot
    source has throughout is common, so it is not a key of that join. Tokenizers whose pre-tokens can't be
    counted apart have each text counted by the library.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(commonest(docs.select(F.col(text_col).alias("text")), path, most, sample) if Splitter(path).joins else {})
    row = F.struct(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    chosen = docs.select(F.col(text_col).alias("text"), row.alias("row"))
    rows = materialize(chosen.mapInArrow(*_count(shared, path, chosen.schema["row"].dataType.simpleString())), "counted")
    rest = rows.select("row_no", F.explode(F.arrays_zip("p", "f")).alias("x")).select("row_no", "x.p", "x.f")
    pieces = materialize(rest.select("p").distinct().mapInArrow(_pieces(path), "p string, k int"), "pieces")
    more = rest.join(pieces, "p").groupBy("row_no").agg(F.sum(F.col("f") * F.col("k").cast("long")).alias("more"))
    out = rows.select("row_no", "row", "n").join(more, "row_no", "left")
    names = clear_of(list(keep), [id_col, "n_bytes", "n_tokens"])
    return out.select(F.col("row.id").alias(id_col), *[F.col(f"row.k{i}").alias(c) for i, c in enumerate(names)], "row.n_bytes", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n_tokens"))
