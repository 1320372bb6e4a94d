"""Quality by compression: zstandard dictionaries of good and bad text, and a calibrated score."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import beside, small_batches, text_or_empty


@dataclass
class Model:
    """Two dictionaries, and the calibration: the log odds of a good text are linear in its normalised difference."""

    good: bytes
    bad: bytes
    level: int
    weights: list[float]


def compressors(good: bytes, bad: bytes, level: int) -> list:
    out = []
    for d in (good, bad):
        kept = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO) if d else None
        if kept:
            kept.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(level=level, dict_data=kept, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def difference(text: bytes, zs: list) -> float:
    """Bytes saved by the good dictionary over the bad one, by byte of text: the normalised compressed-size difference."""
    g, b = (len(z.compress(text)) for z in zs)
    return (b - g) / (len(text) + 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, on standardised columns; the first is constant."""
    mean, dev = x.mean(axis=0), x.std(axis=0) + 1e-9
    mean[0], dev[0] = 0, 1
    z, w = (x - mean) / dev, np.zeros(x.shape[1])
    keep = ridge * np.eye(len(w))
    keep[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + keep, z.T @ (p - y) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    w = w / dev
    w[0] -= (w[1:] * mean[1:]).sum()
    return w


def dictionary(texts: list[bytes], size: int, piece: int = 2048) -> bytes:
    """A zstandard dictionary of the texts, or their raw bytes where they are too few to train on."""
    parts = [t[i : i + piece] for t in texts for i in range(0, len(t), piece)]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-size:]


def fit(sample: list[tuple[str | None, int]], dict_size: int = 1 << 16, level: int = 3, folds: int = 2) -> Model:
    """Dictionaries from all of the sample; the calibration is fitted on folds that the dictionaries have not seen.

    With one class, or none, the score is the share of good rows throughout.
    """
    texts, y = [(t or "").encode() for t, _ in sample], np.array([q for _, q in sample], float)
    share = min(max((y.sum() + 1) / (len(y) + 2), 1e-3), 1 - 1e-3)
    if not (0 < y.sum() < len(y)) or min(y.sum(), len(y) - y.sum()) < 2 * folds:
        return Model(b"", b"", level, [math.log(share / (1 - share)), 0.0])
    pick = lambda q, f: [t for i, t in enumerate(texts) if y[i] == q and (f is None or i % folds != f)]
    x = np.ones((len(y), 2))
    for f in range(folds):
        zs = compressors(dictionary(pick(1, f), dict_size), dictionary(pick(0, f), dict_size), level)
        for i in range(f, len(y), folds):
            x[i, 1] = difference(texts[i], zs)
    return Model(dictionary(pick(1, None), dict_size), dictionary(pick(0, None), dict_size), level, fit_logistic(x, y).tolist())


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int, max_bytes: int) -> list[tuple[str | None, int]]:
    """At most per_class labelled rows of each class, those with the least hash of their id, in that order.

    Of these, whole texts as long as all before them and they make max_bytes at most. A document with several
    labels counts as bad if one says so; null labels and ids do not count.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.min(label_col) > 0).cast("int").alias("y"))
    known = known.withColumn("o", F.xxhash64("id"))
    chosen = [r.id for y in (0, 1) for r in known.where(F.col("y") == y).orderBy("o", "id").limit(per_class).collect()]
    if not chosen:
        return []
    kind = dict(labels.dtypes)[id_col]
    ids = docs.sparkSession.createDataFrame([(i,) for i in chosen], f"id {kind}").join(known, "id")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(ids), "id")  # 2 * per_class ids at most
    order = [F.col(c) for c in ("o", "id", "size", "digest")]
    each = rows.withColumns({"size": F.coalesce(F.octet_length("t"), F.lit(0)).cast("long"), "digest": F.xxhash64("t")})
    sizes = each.select(*order).orderBy(*order).limit(4 * per_class).collect()  # numbers only, so that no more texts than the bound leave their task
    total, last = 0, None
    for r in sizes:
        if total + r["size"] > max_bytes:
            break
        total, last = total + r["size"], r
    if last is None:
        return []
    within = F.struct(*order) <= F.struct(*[F.lit(last[c]).cast(dict(each.dtypes)[c]) for c in ("o", "id", "size", "digest")])
    return [(r.t, r.y) for r in each.where(within).orderBy(*order).limit(4 * per_class).collect()]


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    per_class: int = 2000, max_bytes: int = 64 << 20, dict_size: int = 1 << 16,
) -> Model:
    """A model from a bounded sample: 2 * per_class labelled rows and max_bytes of whole texts, the same at every size of input."""
    return fit(labelled_sample(docs, labels, id_col, text_col, label_col, per_class, max_bytes), dict_size)


def quality_score(text: Column, model: Model) -> Column:
    """The probability that a whole text is good, 0 to 1, from its normalised compressed-size difference alone; null counts as empty."""

    @F.arrow_udf(T.DoubleType())
    def of(texts: pa.Array) -> pa.Array:
        zs, (a, b) = compressors(model.good, model.bad, model.level), model.weights
        x = np.array([difference(t or b"", zs) for t in texts.cast(pa.binary()).to_pylist()], float)
        return pa.array(1 / (1 + np.exp(-np.clip(a + b * x, -30, 30))))

    return of(text_or_empty(text))


def score_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score, the probability of a good text; every row and column is kept.

    Null and empty texts have the score of no difference; repeated rows are each scored; an empty table gives
    no rows. A column of docs named score stays as score_in.
    """
    small_batches(docs.sparkSession)
    scored = docs.select(F.struct(*docs.columns).alias("d"), quality_score(F.col(text_col), model).alias("s"))
    return scored.select(*beside(docs.columns, F.col("d"), ["score"]), F.col("s").alias("score"))
