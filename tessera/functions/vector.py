"""Vectors as array columns; native higher-order expressions over doubles."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine, negatives as 0; 0 for null vectors, different lengths or a zero norm."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (norm > 0)
    return F.when(ok, F.greatest(F.lit(0.0), dot(a, b) / norm)).otherwise(F.lit(0.0))


def fuse(image: Column, text: Column, share: float = 0.6) -> Column:
    """share of the image and the rest of the text; one null: the other; lengths differ: the image."""
    both = F.zip_with(doubles(image), doubles(text), lambda x, y: x * F.lit(share) + y * F.lit(1 - share))
    return F.when(image.isNull(), doubles(text)).when(text.isNull() | (F.size(image) != F.size(text)), doubles(image)).otherwise(both)


def node_text(name: Column, summary: Column, tags: Column, path: Column) -> Column:
    """What is embedded of a node: name, summary, tags and file, where present."""
    part = lambda c: F.when(c != "", c)
    label = lambda s, c: F.when(c != "", F.concat(F.lit(s), c))
    return F.concat_ws(". ", part(name), part(summary), label("Tags: ", F.array_join(tags, ", ")), label("File: ", path))


def embed(text: Column, embedder: Callable[[list[str]], list[list[float] | None]], batch: int = 64, tries: int = 3) -> Column:
    """Vectors of texts by any embedder of lists, in order; null for an empty text and where it fails `tries` times.

    The embedder is sent to the workers and called there; how many work at once is the number of partitions.
    """

    @F.arrow_udf("array<float>")
    def of(texts: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        out: list[list[float] | None] = [None] * len(values)
        ask = [i for i, t in enumerate(values) if t]
        for k in range(0, len(ask), batch):
            part = ask[k : k + batch]
            for _ in range(tries):
                try:
                    for i, v in zip(part, embedder([values[i] for i in part]), strict=True):
                        out[i] = v
                    break
                except Exception:  # an outside service; a null says that it failed
                    continue
        return pa.array(out, pa.list_(pa.float32()))

    return of(text)


def mime_type(name: Column) -> Column:
    """The media type of an image by its name or data address; PNG if it does not say."""
    n = F.lower(F.coalesce(name, F.lit("")))
    found = F.regexp_extract(n, r"^data:(image/[a-z+]+)[;,]", 1)
    return F.when(found != "", found).when(n.rlike(r"\.jpe?g$"), "image/jpeg").when(n.endswith(".webp"), "image/webp").when(n.endswith(".gif"), "image/gif").otherwise("image/png")
