"""Rows of a wide table by verdicts on their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.scratch import written


def kept_rows(docs: DataFrame, key: Column, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``verdicts`` (``weftline_key, kept``, a row for each) keeps; of rows of one key, one.

    Only keys are grouped. Documents are joined with the keys that go or repeat: where these are few,
    Spark finds so as it runs and broadcasts them, and no text moves; where they are many, it merges.
    Repeats are reduced to one row in each task before they meet.
    """
    groups = verdicts.groupBy("weftline_key").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    odd = written(groups.where("NOT kept OR n > 1").select("weftline_key", "kept"), "odd-keys")
    marked = docs.withColumn("weftline_key", key)
    single = marked.join(odd.select("weftline_key"), "weftline_key", "left_anti")
    repeated = marked.join(odd.where("kept").select("weftline_key"), "weftline_key", "left_semi").dropDuplicates(["weftline_key"])
    return single.unionByName(repeated).select(*docs.columns)
