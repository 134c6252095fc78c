"""Tables written to the shared folder to cut lineage.

A written table survives the loss of any executor, unlike cached blocks. The folder is the
session's ``spark.checkpoint.dir``; only where that is unset (tests, a laptop) a folder of the
warehouse is used, which is shared by definition.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    return found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/weftline-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(table: DataFrame) -> None:
    """Delete a table of ``written`` that no later action reads."""
    spark = table.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
