"""Operator 6, toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each counted once: its words, word pairs, pairs that skip one or two words, and
prefixes of words (so that inflected forms share a feature), all hashed into ``BITS`` bits.
Learning rates are kept per coordinate and an L1 term holds all other weights at zero, so the
model is a short list of weights that is broadcast; scoring is one pass over the texts.

Fitting takes a bounded sample: the ``SAMPLE_ROWS`` labelled rows with the smallest hash. They are
dealt by a hash of the id to one task for each ``LEARNER_ROWS`` of them; each runs over its rows,
and the learners' weights are averaged, coordinate by coordinate, by the evidence behind them. Rows of the held-out fold are never read for fitting.

Cases: null text counts as empty, and texts without words get the score of the bias alone; if the
labels hold one class only, or none, scores lean to it (or are 0.5); different labels of one id count
as several rows; of documents that share an id, one is used for fitting; a null id or label is not
used for fitting; repeated documents get equal scores;
an empty table gives an empty result; extra columns are ignored (``reject`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.scratch import written
from weftline.llm.text import documents, whole
from weftline.llm.wordhash import mixed, slices, words

BITS = 20
PREFIXES = (3, 4, 5, 6, 7, 8, 10)
SAMPLE_ROWS, LEARNER_ROWS, EPOCHS = 16_000, 4_000, 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 2.0, 0.2
THRESHOLD = 0.5
FOLDS, HELD_OUT = 5, 0


def fold(doc_id: str | Column = "doc_id", folds: int = FOLDS) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % folds


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(text, feature)`` of every occurrence."""
    found = words(data, offsets)
    shift = np.uint64(64 - BITS)
    texts, features = [found.text], [mixed(found.hash, 1) >> shift]
    for gap, salt in ((1, 2), (2, 3), (3, 4)):
        if len(found.text) > gap:
            same = found.text[gap:] == found.text[:-gap]
            pair = found.hash[:-gap] * np.uint64(3) + found.hash[gap:]
            texts.append(found.text[gap:][same])
            features.append(mixed(pair[same], salt) >> shift)
    for length in PREFIXES:
        which, prefix = found.prefix(length)
        texts.append(found.text[which])
        features.append(mixed(prefix, 100 + length) >> shift)
    return np.concatenate(texts), np.concatenate(features).astype(np.int64)


@dataclass
class Model:
    """Sparse weights; ``bias`` is added to every text."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        dense = np.zeros(1 << BITS, np.float32)
        dense[self.features] = self.weights
        return dense


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and sums of squared gradients after ``epochs`` passes; the last coordinate is the bias.

    ``rows``: (distinct features, label).
    """
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS  # the last coordinate, without L1

    def weights(at: np.ndarray) -> np.ndarray:
        l1 = np.where(at == bias, 0.0, L1)
        zs = z[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for features, label in rows:
            at = np.append(features, bias)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
            if g:
                z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
                n[at] += g * g
    return weights(np.arange(bias + 1)), n


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        labels = batch["label"].to_pylist()
        for first, data, offsets in slices(batch["text"]):
            text, feature = grams(data, offsets)
            keys = np.unique(text << BITS | feature)
            parts = np.split((keys & (1 << BITS) - 1).astype(np.int32), np.searchsorted(keys >> BITS, np.arange(1, len(offsets) - 1)))
            rows += zip(parts, labels[first : first + len(offsets) - 1], strict=True)
    if rows:
        order = np.random.default_rng(0).permutation(len(rows))
        w, n = ftrl([rows[i] for i in order])
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at]), pa.array(n[at])], names=["feature", "weight", "evidence"])


def sample(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, label``: the rows with the smallest hash; at most ``rows``."""
    order = F.xxhash64(F.col("doc_id"), F.lit(6))
    return labelled.where("doc_id IS NOT NULL AND label IS NOT NULL").select("doc_id", "label").orderBy(order, "doc_id", "label").limit(rows)


def sampled_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``doc_id, label, text, tie`` of a sample; of rows that share an id, the one whose text has the smallest hash.

    ``chosen`` is bounded, and so is the result, however often an id occurs.
    """
    rows = docs.select("doc_id", whole().alias("text")).join(F.broadcast(chosen.distinct()), "doc_id")
    one = rows.groupBy("doc_id", F.col("label").cast("int").alias("label")).agg(F.min(F.struct(F.xxhash64("text").alias("tie"), "text")).alias("row"))
    return one.select("doc_id", "label", "row.text", "row.tie")


def dealt(rows: DataFrame, learners: int) -> DataFrame:
    """``learner, text, label`` of a sample, one learner per task, each with its share of either label.

    A label with fewer rows than learners makes for fewer learners, so that each has both labels.
    """
    counts = [r["count"] for r in rows.groupBy("label").count().collect()]  # a row per label
    learners = max(1, min([learners, *counts]))
    place = F.row_number().over(W.partitionBy("label").orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id", "tie"))  # of a bounded sample
    turned = rows.withColumn("learner", F.pmod(place, F.lit(learners)))
    return turned.repartitionById(learners, "learner").sortWithinPartitions("doc_id", "label").select("learner", "text", "label")


def fit(docs: DataFrame, labelled: DataFrame) -> Model:
    """``labelled``: ``doc_id, label`` (0 or 1), without the rows to hold out."""
    chosen = sample(labelled)  # at most SAMPLE_ROWS short rows: broadcast
    rows = written(sampled_texts(docs, chosen), "toxicity-sample")
    found = dealt(rows, max(1, chosen.count() // LEARNER_ROWS)).mapInArrow(_learn, "feature long, weight double, evidence double")
    merged = found.groupBy("feature").agg((F.sum(F.col("weight") * F.col("evidence")) / F.sum("evidence")).alias("weight"))
    # Sparse by L1, and at most 2^BITS + 1 rows of eight bytes.
    rows = merged.where("weight <> 0").select(F.col("feature").cast("int").alias("feature"), F.col("weight").cast("float").alias("weight")).toArrow()
    features, weights = rows["feature"].to_numpy(), rows["weight"].to_numpy()
    real = features < 1 << BITS
    return Model(features[real], weights[real], float(weights[~real].sum()))


def _score(model, text_column: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = model.value.table(), model.value.bias
        for batch in batches:
            scores = np.full(batch.num_rows, bias, np.float64)
            for first, data, offsets in slices(batch[text_column]):
                text, feature = grams(data, offsets)
                hit = np.flatnonzero(table[feature])
                keys = np.unique(text[hit] << BITS | feature[hit])
                scores[first : first + len(offsets) - 1] += np.bincount(keys >> BITS, table[keys & (1 << BITS) - 1], len(offsets) - 1)
            value = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array(value)], names=[*names, "weftline_score"])

    return run


def score(docs: DataFrame, model: Model, *columns: str) -> DataFrame:
    """The named columns of ``docs`` and ``weftline_score``."""
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*columns).dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sent = docs.select(*columns) if "text" in columns else docs.select(*columns, "text")
    return sent.mapInArrow(_score(shared, "text", list(columns)), f"{schema}, weftline_score double")


def training_labels(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    return labels.select("doc_id", F.col(label).alias("label")).where(fold("doc_id", folds) != held_out)


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with the columns of ``docs``."""
    return score(docs, model, *docs.columns).where(F.col("weftline_score") < threshold).select(*docs.columns)


def toxicity_model(spark: SparkSession, sf_dir: str) -> Model:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fit(documents(spark, sf_dir), training_labels(labels, "toxic", FOLDS, HELD_OUT))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(documents(spark, sf_dir), toxicity_model(spark, sf_dir), "doc_id")
    return found.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), F.col("weftline_score").alias("score"), (F.col("weftline_score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6}
ORACLES: dict[str, str] = {}
