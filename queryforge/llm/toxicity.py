"""Toxicity: a character n-gram linear classifier on features scaled by naive Bayes log-count ratios.

Features are the distinct hashed n-grams of code points of the lower-cased text.  From a
bounded sample of labelled documents come the log-count ratio of every feature and, on the
features with the strongest evidence, a logistic regression over the scaled features.
Scoring reads every text whole and needs only the table of weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_rows, keep_rows, materialize

BITS = 18
_STEP = np.uint32(0x01000193)
_SPREAD = np.uint32(0x9E3779B1)
#: An ASCII character that is no letter or digit counts as a blank; A-Z count as a-z; all other characters stay.
_ASCII = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(128)], np.uint32)


def ngrams(text: str | None, sizes: tuple[int, ...]) -> np.ndarray:
    """Hashed character n-grams of the text between two blanks, one per place."""
    data = np.frombuffer(f" {text or ''} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    data = np.where(data < 128, _ASCII[np.minimum(data, 127)], data)
    out, h = [], np.zeros(len(data), np.uint32)
    for n in range(1, max(sizes) + 1):
        if n > len(data):
            break
        h = (h[:len(data) - n + 1] * _STEP) ^ data[n - 1:]
        if n in sizes:
            out.append(((h ^ np.uint32(n)) * _SPREAD) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


@dataclass
class Model:
    """``weights`` of all hashed features (0: not used) and the intercept."""

    weights: np.ndarray
    intercept: float
    sizes: tuple[int, ...]

    def score(self, text: str | None) -> float:
        found = ngrams(text, self.sizes)
        found = np.unique(found[self.weights[found] != 0])
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[found].sum(), -500, 500))))


def _featured(sizes: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                rows = [np.unique(ngrams(t.as_py(), sizes)).astype(np.int32).tobytes() for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(rows, pa.binary())], ["toxic", "features"])
    return run


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in how many documents of either class each feature occurs, as two arrays."""
    counts, rows = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        for y, x in zip(batch.column("toxic").to_pylist(), batch.column("features").to_pylist()):
            counts[y, np.frombuffer(x, np.int32)] += 1
            rows[y] += 1
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(rows), pa.array([c.tobytes() for c in counts], pa.binary())],
                                     ["toxic", "rows", "counts"])


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 8_000, most_features: int = 1 << 14, sizes: tuple[int, ...] = (3, 4, 5),
          smoothing: float = 0.5, ridge: float = 0.003, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most ``most_rows`` labelled documents, those with the smallest hash of their doc_id.

    A doc_id labelled twice counts as toxic if any label says so; null labels and those other than 0 and 1 are ignored;
    a document that occurs several times counts as often.  Labels of one class, or none, tell nothing of the other: the
    model then scores every text 0.5, below the threshold, and rejects none.  Features of equal evidence are taken by number.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import SparseVector, VectorUDT

    labels = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).dropna()
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic in (0, 1)")
    sample = materialize(labels.orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(most_rows), "labels")
    texts = doc_rows(docs, id_col, text_col).join(F.broadcast(sample), "doc_id")  # at most most_rows narrow rows
    rows = materialize(texts.select("toxic", "text").mapInArrow(_featured(sizes), "toxic int, features binary"), "features").coalesce(8)
    found = rows.mapInArrow(_document_counts, "toxic int, rows bigint, counts binary").collect()  # 8 tasks, two arrays each
    n, counts = np.zeros(2), np.zeros((2, 1 << BITS))
    for r in found:
        n[r["toxic"]] += r["rows"]
        counts[r["toxic"]] += np.frombuffer(r["counts"], np.int64)
    weights = np.zeros(1 << BITS)
    if not n.all():
        return Model(weights, 0.0, sizes)
    share = (counts + smoothing) / (n[:, None] + 2 * smoothing)
    ratio = np.log(share[1] / share[0])
    evidence = np.abs(ratio) * np.sqrt(counts.sum(axis=0))
    used = np.sort(np.argsort(-evidence, kind="stable")[:most_features])
    used = used[evidence[used] > 0]
    place = np.full(1 << BITS, -1)
    place[used] = np.arange(len(used))
    scale, width = ratio[used], len(used)

    def scaled(features: bytes) -> SparseVector:
        at = place[np.frombuffer(features, np.int32)]
        at = np.sort(at[at >= 0])
        return SparseVector(width, at, scale[at])

    share = F.when(F.col("toxic") == 1, float(n.sum() / (2 * n[1]))).otherwise(float(n.sum() / (2 * n[0])))  # both classes weigh the same
    vectors = rows.select(F.col("toxic").cast("double").alias("label"), share.alias("share"),
                          F.udf(scaled, VectorUDT())("features").alias("features"))
    fitted = LogisticRegression(regParam=ridge, maxIter=60, standardization=False, weightCol="share").fit(vectors)
    weights[used] = fitted.coefficients.toArray() * scale
    return Model(weights, float(fitted.intercept), sizes)


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, score (0 to 1) and predicted (1 from ``threshold`` on, itself included) of every row.

    A null text scores as an empty one; null and repeated doc_ids pass through, one row each; other columns are ignored; an
    empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 2**18 weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            scores = pa.array([own.score(t.as_py()) for t in batch.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), scores], ["doc_id", "text_hash", "score"])

    rows = doc_rows(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return (rows.mapInArrow(run, "doc_id bigint, text_hash bigint, score double")
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents predicted toxic; all columns stay."""
    scored = materialize(score(docs, model, threshold, id_col, text_col), "scores")
    kept = scored.select("doc_id", "text_hash", (F.col("predicted") == 0).alias("kept"))
    return keep_rows(docs, kept, id_col, text_col, one_of_repeats=False)
