"""Toxicity by a linear classifier on character n-grams with naive Bayes scaling.

Every text is a set of hashed character n-grams. A feature's value is the log
ratio of its smoothed share in toxic and in clean training texts, and a logistic
regression weighs these values (Wang and Manning, ACL 2012).

* Fitting reads at most ``fit_rows`` labelled texts (by hash of the id). Counts
  leave a task as at most ``2 ** log2_buckets`` numbers, and the model is one
  number for each bucket, so nothing that grows with the corpus is broadcast.
* Scoring is one pass without a shuffle over all whole texts. Only the text
  decides a score.
* Null and empty texts get the score of a text without any known n-gram. Without
  labels, or with one class only, every score is the smoothed share of that class.
  A doc_id labelled twice counts as toxic if any label says so; rows without a
  doc_id are scored and never learnt from. Repeated rows get equal scores, an
  empty table an empty result; further columns are ignored (``score_toxicity``)
  or kept (``drop_toxic``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit.llm.common import columns_of, lower_codes, map_columns, slices, stage

HELD_OUT_PARTS, HELD_OUT_PART = 4, 2
THRESHOLD = 0.3


@dataclass(frozen=True)
class ToxicityConfig:
    sizes: tuple[int, ...] = (3, 4, 5)
    log2_buckets: int = 18
    features: int = 1 << 14  # buckets kept, by the significance of their log ratio
    smoothing: float = 1.0
    fit_rows: int = 20_000  # bound of the labelled sample that the classifier is fitted on
    iterations: int = 60
    penalty: float = 1e-4


@dataclass(frozen=True)
class ToxicityModel:
    """``weights[b]`` is coefficient times log ratio of bucket ``b``."""

    sizes: tuple[int, ...]
    weights: np.ndarray
    intercept: float

    @property
    def shift(self) -> int:
        return 32 - (len(self.weights).bit_length() - 1)


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from; false for a null id."""
    part = F.crc32(doc_id.cast("string")) % HELD_OUT_PARTS
    return F.coalesce(part == HELD_OUT_PART, F.lit(False))


def _buckets(codes: np.ndarray, size: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram and whether it lies inside one text."""
    n = max(len(codes) - size + 1, 0)
    value = np.full(n, size * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
    whole = np.ones(n, dtype=bool)
    for i in range(size):
        part = codes[i : i + n]
        value += part * np.uint32(pow(0x85EBCA6B, i + 1, 1 << 32))
        # The zero before a text is kept as first character: it marks the beginning.
        if i:
            whole &= part != 0
    value ^= value >> np.uint32(15)
    value *= np.uint32(0x2C1B3C6D)
    return value >> np.uint32(shift), whole


def _present(column: pa.Array, sizes: tuple[int, ...], shift: int, wanted: np.ndarray | None):
    """(row, bucket) of the distinct wanted n-grams of each text, chunk by chunk."""
    for first, codes, rows in lower_codes(column):
        keys = []
        for size in sizes:
            bucket, whole = _buckets(codes, size, shift)
            if wanted is not None:
                whole &= wanted[bucket]
            at = np.flatnonzero(whole)
            keys.append((rows[at] << (32 - shift)) | bucket[at])
        key = np.unique(np.concatenate(keys))
        yield first + (key >> (32 - shift)), key & ((1 << (32 - shift)) - 1)


def _fit_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents outside the held-out part."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = (
        known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    return docs.join(F.broadcast(chosen), "doc_id").select("text", "label")


def fit_toxicity(documents: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Fit on ``documents(doc_id, text)`` and ``labels(doc_id, toxic)``."""
    docs, marks = columns_of(documents, "doc_id", "text"), columns_of(labels, "doc_id", "toxic")
    sample = stage(_fit_sample(docs, marks, config.fit_rows))
    buckets, shift = 1 << config.log2_buckets, 32 - config.log2_buckets
    sizes = config.sizes

    def count(batches):
        counts = np.zeros((2, buckets), dtype=np.int64)
        rows = np.zeros(2, dtype=np.int64)
        for batch in slices(batches):
            label = np.asarray(batch.column("label"), dtype=np.int64)
            rows += np.bincount(label, minlength=2)
            for row, bucket in _present(batch.column("text"), sizes, shift, None):
                for y in (0, 1):
                    counts[y] += np.bincount(bucket[label[row] == y], minlength=buckets)
        seen = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array(np.append(seen, -1), pa.int32()),
            "clean": pa.array(np.append(counts[0, seen], rows[0])),
            "toxic": pa.array(np.append(counts[1, seen], rows[1])),
        })

    # At most one row for each bucket comes to the driver.
    found = sample.mapInArrow(count, "bucket int, clean long, toxic long").groupBy("bucket").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    ).toPandas()
    total = found[found.bucket < 0]
    n_clean, n_toxic = int(total.clean.sum()), int(total.toxic.sum())
    weights = np.zeros(buckets)
    if not n_clean or not n_toxic:
        share = (n_toxic + config.smoothing) / (n_clean + n_toxic + 2 * config.smoothing)
        return ToxicityModel(sizes, weights, float(np.log(share / (1 - share))))
    found = found[found.bucket >= 0].sort_values("bucket")
    toxic = found.toxic.to_numpy() + config.smoothing
    clean = found.clean.to_numpy() + config.smoothing
    ratio = np.log((toxic / (n_toxic + 2 * config.smoothing)) / (clean / (n_clean + 2 * config.smoothing)))
    order = np.argsort(-np.abs(ratio) / np.sqrt(1 / toxic + 1 / clean), kind="stable")[: config.features]
    kept = np.sort(found.bucket.to_numpy()[order])
    values = np.zeros(buckets)
    values[found.bucket.to_numpy()] = ratio
    wanted = np.zeros(buckets, dtype=bool)
    wanted[kept] = True

    def make():
        def work(batch):
            lists = [np.zeros(0, dtype=np.int64)] * batch.num_rows
            for row, bucket in _present(batch.column("text"), sizes, shift, wanted):
                cut = np.flatnonzero(np.diff(row)) + 1
                for r, part in zip(row[np.append(0, cut)] if len(row) else [], np.split(bucket, cut)):
                    lists[int(r)] = part
            return {"buckets": pa.array(lists, pa.list_(pa.int64()))}

        return work

    def vector(found_buckets):
        return Vectors.sparse(len(kept), np.searchsorted(kept, found_buckets), values[np.array(found_buckets, dtype=np.int64)])

    rows = stage(map_columns(sample, make, ["text", "label"], "buckets array<long>").select("label", "buckets"))
    to_vector = F.udf(vector, VectorUDT())
    training = rows.select(F.col("label").cast("double").alias("label"), to_vector("buckets").alias("features"))
    fitted = LogisticRegression(
        maxIter=config.iterations, regParam=config.penalty, elasticNetParam=0.0, standardization=False
    ).fit(training)
    weights[kept] = fitted.coefficients.toArray() * values[kept]
    return ToxicityModel(sizes, weights, float(fitted.intercept))


def _scored(df: DataFrame, text: str, model: ToxicityModel, name: str) -> DataFrame:
    sizes, weights, intercept, shift = model.sizes, model.weights, model.intercept, model.shift
    keep = df.columns

    def make():
        wanted = weights != 0

        def work(batch):
            logit = np.full(batch.num_rows, intercept)
            for row, bucket in _present(batch.column(text), sizes, shift, wanted):
                logit += np.bincount(row, weights=weights[bucket], minlength=batch.num_rows)
            return {name: pa.array(1.0 / (1.0 + np.exp(-np.clip(logit, -500, 500))))}

        return work

    return map_columns(df, make, keep, f"{name} double")


def score_toxicity(documents: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = _scored(columns_of(documents, "doc_id", "text"), "text", model, "score")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(documents: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` that score below ``threshold``, with all their columns."""
    names = documents.columns
    plain = documents.toDF(*[f"c{i}" for i in range(len(names))])
    scored = _scored(plain, f"c{names.index('text')}", model, "s")
    return scored.filter(F.col("s") < threshold).drop("s").toDF(*names)
