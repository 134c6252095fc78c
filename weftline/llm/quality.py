"""Operator 7, quality: a linear-chain conditional random field over the lines of a text.

Every line is good or bad. A line's features are shares of its bytes by kind, repetition of words
inside it and of the lines around it, and the same features of its neighbours; a transition score
ties neighbouring labels. Forward-backward gives each line's probability of being good, and a
text's quality is a logistic function of the length-weighted evidence of its lines.

Only texts carry labels, so the field is fitted in rounds: first each line takes its text's label,
then lines of bad texts that the field finds good are relabelled, as long as one bad line stays.
Fitting takes a bounded sample, the ``SAMPLE_ROWS`` labelled rows with the smallest hash, whole. They
are dealt to ``LEARNERS`` tasks, each of which fits a field to its texts; the fields' few weights are
averaged on the driver. For fitting alone, long texts are chains of ``SEGMENT`` lines in a row, all of
them, so that steps stay short. A last pass counts the evidence of the sample's texts in hundredths,
per label, and the logistic function is fitted to those counts. Scoring reads whole texts, in batches,
on the executors.

Cases: null text counts as one empty line; if the labels hold one class only, or none, every text
gets that class (or 0.5); a null id or label is not used for fitting, and of documents that share an
id one is; repeated documents get equal scores; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.scratch import written
from weftline.llm.text import documents, whole
from weftline.llm.toxicity import dealt, fold, sample, sampled_texts, training_labels
from weftline.llm.wordhash import NON_SPACE, slices, words

SAMPLE_ROWS, LEARNERS, SEGMENT = 6_000, 4, 64
ROUNDS, STEPS, RATE, DECAY = 3, 120, 0.2, 1e-4
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2

KINDS = np.zeros(256, np.int64)  # other bytes: control, white space
KINDS[97:123] = KINDS[128:256] = 1
KINDS[65:91] = 2
KINDS[48:58] = 3
for _c in b".,;:'\"()-":
    KINDS[_c] = 4
for _c in b"!?":
    KINDS[_c] = 5
for _c in b"#$%&*+/<=>@[\\]^_`{}~":
    KINDS[_c] = 6
KINDS[ord("|")] = 7
OWN = 14


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, bytes, features)`` of every line of a run of texts; lines end at line feeds."""
    ends = np.flatnonzero(data == 10)
    counts = np.bincount(np.searchsorted(offsets, ends, "right") - 1, minlength=len(offsets) - 1) + 1
    lines = int(counts.sum())
    text = np.repeat(np.arange(len(offsets) - 1), counts)
    firsts = np.cumsum(counts) - counts
    stops = np.empty(lines, np.int64)
    is_last = np.zeros(lines, bool)
    is_last[firsts + counts - 1] = True
    stops[is_last] = offsets[1:]
    stops[~is_last] = ends
    begins = np.empty(lines, np.int64)
    begins[firsts] = offsets[:-1]
    later = np.ones(lines, bool)
    later[firsts] = False
    begins[later] = ends + 1
    size = stops - begins
    length = np.maximum(size, 1)
    shares = []
    kinds = KINDS[data]
    for kind in range(1, 8):
        sums = np.concatenate([[0], np.cumsum(kinds == kind)])
        shares.append((sums[stops] - sums[begins]) / length)
    found = words(data, offsets, NON_SPACE)
    line = np.searchsorted(begins, found.start, "right") - 1
    # Empty lines share a place with the next line; a word belongs to the last line that begins there.
    n_words = np.maximum(np.bincount(line, minlength=lines), 1)
    again = np.zeros(len(line), bool)
    again[1:] = (found.hash[1:] == found.hash[:-1]) & (line[1:] == line[:-1])
    repeats = np.bincount(line[again], minlength=lines) / n_words
    spread = np.bincount(line, weights=(found.end - found.start), minlength=lines) / n_words
    place = np.arange(len(line)) - np.searchsorted(line, line)  # so that order counts in a line's hash
    salted = (found.hash * (2 * place + 1).astype(np.uint64)) >> np.uint64(12)
    digest = np.bincount(line, weights=salted.astype(np.float64), minlength=lines)
    equal = np.zeros(lines, bool)
    equal[1:] = (digest[1:] == digest[:-1]) & (text[1:] == text[:-1]) & (size[1:] > 0)
    near = equal.copy()
    near[:-1] |= equal[1:]
    features = np.stack([*shares, repeats, near, np.minimum(spread / 20, 2), np.log1p(size) / 10, n_words < 4, size == 0, np.ones(lines)], axis=1)
    return text, size, features.astype(np.float32)


def with_neighbours(text: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Own features, and those of the lines before and after in the same text (zero at its ends)."""
    same = (text[1:] == text[:-1])[:, None]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1] * same
    after[:-1] = own[1:] * same
    return np.concatenate([own, before, after], axis=1)


def marginals(score: np.ndarray, text: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and expected transitions (2, 2) summed over all lines.

    ``score``: of the label good, bad being zero. All texts advance together, line by line; texts
    with no more lines drop out.
    """
    n = len(score)
    p, expected = np.zeros(n), np.zeros((2, 2))
    if not n:
        return p, expected
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    counts = np.diff(np.append(first, n))
    order = np.argsort(-counts, kind="stable")
    first, counts = first[order], counts[order]
    longest = int(counts[0])
    active = [int(np.searchsorted(-counts, -t, "left")) for t in range(longest)]  # texts with more than t lines
    emission = np.stack([np.zeros(n), score], axis=1)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    alpha[first] = emission[first]
    for t in range(1, longest):
        at = first[: active[t]] + t
        prior = alpha[at - 1]
        alpha[at, 0] = np.logaddexp(prior[:, 0] + transition[0, 0], prior[:, 1] + transition[1, 0])
        alpha[at, 1] = np.logaddexp(prior[:, 0] + transition[0, 1], prior[:, 1] + transition[1, 1])
        alpha[at] += emission[at]
        alpha[at] -= alpha[at].max(axis=1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        at = first[: active[t + 1]] + t
        ahead = beta[at + 1] + emission[at + 1]
        beta[at, 0] = np.logaddexp(transition[0, 0] + ahead[:, 0], transition[0, 1] + ahead[:, 1])
        beta[at, 1] = np.logaddexp(transition[1, 0] + ahead[:, 0], transition[1, 1] + ahead[:, 1])
        beta[at] -= beta[at].max(axis=1, keepdims=True)
    total = alpha + beta
    p = 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -60, 60)))
    if n > 1:
        joint = alpha[:-1, :, None] + transition[None] + (emission + beta)[1:, None, :]
        joint = joint[text[1:] == text[:-1]]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True)) if len(joint) else joint
        expected = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0) if len(joint) else expected
    return p, expected


@dataclass
class Field:
    weights: np.ndarray
    transition: np.ndarray
    #: logistic over a text's evidence: slope and intercept
    slope: float
    intercept: float

    def lines(self, text: np.ndarray, own: np.ndarray) -> np.ndarray:
        return marginals(with_neighbours(text, own) @ self.weights, text, self.transition)[0]

    def texts(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.intercept, -30, 30)))


def evidence(text: np.ndarray, size: np.ndarray, good: np.ndarray, n: int) -> np.ndarray:
    """The log-odds of a text's length-weighted share of good lines."""
    weight = size + 1.0
    share = np.bincount(text, weight * good, n) / np.maximum(np.bincount(text, weight, n), 1)
    share = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(share / (1 - share))


def _ascend(gradient, x: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Adam."""
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x


def segments(text: np.ndarray, most: int = SEGMENT) -> np.ndarray:
    """Lines in chains of at most ``most``: a number for each line's chain."""
    new = np.concatenate([[True], text[1:] != text[:-1]]) if len(text) else np.zeros(0, bool)
    place = np.arange(len(text)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(text) else np.zeros(0, np.int64)
    return np.cumsum(place % most == 0)


def ascent(full: np.ndarray, chain: np.ndarray, y: np.ndarray):
    """The gradient of the mean log-likelihood of labels ``y`` of the lines, less the decay."""
    d, n, same = full.shape[1], len(chain), chain[1:] == chain[:-1]
    seen = np.array([[np.sum((y[:-1] == a) & (y[1:] == b) & same) for b in (0, 1)] for a in (0, 1)], np.float64)
    wanted = full.T @ y

    def gradient(x: np.ndarray) -> np.ndarray:
        p, expected = marginals(full @ x[:d], chain, x[d:].reshape(2, 2))
        return np.concatenate([wanted - full.T @ p, (seen - expected).ravel()]) / n - DECAY * x

    return gradient


def fit_weights(text: np.ndarray, own: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights of the features, then of the transitions. ``text``: index of each line's text; ``labels``: of the texts."""
    full, chain = with_neighbours(text, own).astype(np.float64), segments(text)
    d = full.shape[1]
    y, x = labels[text].astype(np.float64), np.zeros(d + 4)
    for _ in range(ROUNDS):
        x = _ascend(ascent(full, chain, y), x, STEPS, RATE)
        good = marginals(full @ x[:d], chain, x[d:].reshape(2, 2))[0]
        worst = np.ones(len(labels))
        np.minimum.at(worst, text, good)
        y = np.where(labels[text] == 1, 1.0, ((good > 0.5) & (good > worst[text])).astype(float))
    return x


def calibrated(seen: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic function over evidence, by label and count."""
    share = counts / counts.sum()

    def gradient(x: np.ndarray) -> np.ndarray:
        miss = (labels - 1 / (1 + np.exp(-np.clip(x[0] * seen + x[1], -30, 30)))) * share
        return np.array([np.sum(miss * seen), np.sum(miss)]) - 1e-3 * x

    slope, intercept = _ascend(gradient, np.zeros(2), 400, 0.1)
    return float(slope), float(intercept)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the weights of a learner's texts, or none if all labels are alike, for all learners then."""
    texts, owns, labels, n = [], [], [], 0
    for batch in batches:
        labels.append(batch["label"].to_numpy())
        for first, data, offsets in slices(batch["text"]):
            text, _, own = line_features(data, offsets)
            texts.append(text + n + first)
            owns.append(own)
        n += batch.num_rows
    if n:
        known = np.concatenate(labels)
        weights = fit_weights(np.concatenate(texts), np.concatenate(owns), known).tolist() if len(set(known.tolist())) > 1 else None
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([int(known.sum())], pa.int64()), pa.array([weights], pa.list_(pa.float64()))], names=["texts", "good", "weights"])


def fit(docs: DataFrame, labelled: DataFrame, learners: int = LEARNERS) -> Field:
    """``labelled``: ``doc_id, label`` (0 or 1), without the rows to hold out."""
    d = 3 * OWN
    rows = written(sampled_texts(docs, sample(labelled, SAMPLE_ROWS)), "quality-sample")
    found = dealt(rows, learners).mapInArrow(_learn, "texts long, good long, weights array<double>").collect()  # a row a learner
    n, good = sum(r["texts"] for r in found), sum(r["good"] for r in found)
    if good in (0, n):
        only = good / n if n else 0.5
        return Field(np.zeros(d), np.zeros((2, 2)), 0.0, float(np.clip((only - 0.5) * 12, -6, 6)))
    found.sort(key=lambda r: r["weights"])
    x = np.average([r["weights"] for r in found], axis=0, weights=[r["texts"] for r in found])
    field = Field(x[:d], x[d:].reshape(2, 2), 1.0, 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    seen = rows.select("label", "text").mapInArrow(_evidence(shared), "label int, hundredths int")
    counts = sorted(tuple(r) for r in seen.groupBy("label", "hundredths").count().collect())  # evidence lies within 10
    label, hundredths, count = np.array(counts, np.float64).T
    field.slope, field.intercept = calibrated(hundredths / 100, label, count)
    return field


def _evidence(field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for first, data, offsets in slices(batch["text"]):
                text, size, own = line_features(data, offsets)
                n = len(offsets) - 1
                out[first : first + n] = evidence(text, size, field.value.lines(text, own), n)
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array(np.round(out * 100).astype(np.int32))], names=["label", "hundredths"])

    return run


def _score(field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = field.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for first, data, offsets in slices(batch["text"]):
                text, size, own = line_features(data, offsets)
                n = len(offsets) - 1
                scores[first : first + n] = model.texts(evidence(text, size, model.lines(text, own), n))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id, score``."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).mapInArrow(_score(shared), "doc_id long, score double")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = documents(spark, sf_dir)
    found = score(docs, fit(docs, training_labels(labels, "quality", FOLDS, HELD_OUT)))
    return found.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op7_quality": op7}
ORACLES: dict[str, str] = {}
