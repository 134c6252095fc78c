"""A corpus pipeline: five stages over ``documents``, each one of the llm operators.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``docs``.

* toxicity: a model is fitted on the labelled rows (see ``toxicity``); documents that score at or
  over the threshold go.
* exact dedup: of equal texts, the row with the largest id stays.
* simhash near-dedup: of each component of near fingerprints, the row with the smallest id stays.
* mixing: documents are repeated, or left out, by Poisson counts towards the target weights; a
  document that occurs twice has two rows with one id.
* packing: pieces of token ids in sequences of a fixed window.

Null texts count as empty texts in every stage. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import exact_dedup, mixing, packing, simhash, toxicity
from weftline.llm.scratch import written
from weftline.llm.text import documents
from weftline.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, toxicity.training_labels(labels, "toxic", toxicity.FOLDS, toxicity.HELD_OUT))
    return toxicity.reject(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, mixing.QUERY_WEIGHTS, seed=mixing.QUERY_SEED)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.packed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenizers and fitted models are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
