"""Files as rows: folders, patterns, dropped trees and journals.

Spark lists the files; names and times become rows without any content being read. Spark itself
leaves out names that begin with a dot or an underscore, and follows links.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftline.functions.strings import glob_pattern
from weftline.operators.detect import _sql_format, text_format
from weftline.operators.provenance import JOURNAL
from weftline.plans import catalog
from weftline.session import table

#: A receipt beside an output, numbered or not.
SIDECAR = r"\.receipt( \([0-9]*\))?\.json$"
MAX_DEPTH = 16


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; empty where nothing precedes the dot."""
    return F.lower(F.regexp_extract(name, r"(?s).\.([^./]*)$", 1))


def droppable(path: Column) -> Column:
    """A known extension, and not a receipt; a numbered receipt counts as any other JSON file."""
    name = file_name(path)
    return ~F.endswith(name, F.lit(".receipt.json")) & extension(name).isin([r[4] for r in catalog.format_rows()])


def listed(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """``path, length, modificationTime`` of the files in a folder, or of all below it."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length", "modificationTime")


def scan_folder(spark: SparkSession, folder: str, target: str | None = None) -> DataFrame:
    """Inputs of a batch: no receipts, nothing that has the target's extension already; by path."""
    files = listed(spark, folder).where(~F.regexp_like(file_name(F.col("path")), F.lit(SIDECAR)))
    done = [r[4] for r in catalog.format_rows() if r[1] == target]
    return files.where(~extension(file_name(F.col("path"))).isin(done)).orderBy("path") if done else files.orderBy("path")


def expand_glob(spark: SparkSession, pattern: str) -> DataFrame:
    """Files whose name matches ``*`` and ``?``; a wildcard in a folder's name is an error."""
    folder, _, name = pattern.rpartition("/")
    if set(folder) & set("*?"):
        raise ValueError("wildcards are matched in file names only")
    return listed(spark, folder or ".").where(F.regexp_like(file_name(F.col("path")), F.lit(glob_pattern(name)))).orderBy("path")


def drop_walk(spark: SparkSession, folder: str, depth: int = MAX_DEPTH) -> DataFrame:
    """All files up to ``depth`` folders deep, with ``droppable``: those to queue; the others are counted as skipped."""
    root = folder.rstrip("/")
    below = F.size(F.split(F.substring_index("path", root + "/", -1), "/"))
    return listed(spark, root, recursive=True).where(below <= depth).withColumn("droppable", droppable(F.col("path")))


def _entries(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    read = spark.read.schema(JOURNAL + ", _corrupt_record string").option("mode", "PERMISSIVE").option("pathGlobFilter", "*.jsonl").json(paths)
    placed = read.select("*", F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("journal"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return placed.where("_corrupt_record IS NULL")


def newest_journals(spark: SparkSession, folder: str, limit: int) -> list[str]:
    """The newest journals that together hold ``limit`` whole lines, or all.

    Names and times come first, without any content; then journals are counted, newest first, twice as
    many each time. At most twice the journals that were needed are read, however many there are.
    """
    files = listed(spark, folder).where(F.endswith("path", F.lit(".jsonl"))).select("path", "modificationTime")
    found, lines, step = [], 0, 4
    while lines < limit:
        here = [r["path"] for r in files.orderBy(F.desc("modificationTime"), F.desc("path")).offset(len(found)).limit(step).collect()]
        if not here:
            break
        # A count alone would read no field, and Spark tells torn lines only by reading one.
        lines += _entries(spark, here).agg(F.count_if(F.length(F.coalesce("source_name", F.lit(""))) >= 0)).first()[0]
        found += here
        step = len(found)
    return found


def history(spark: SparkSession, folder: str, limit: int) -> DataFrame:
    """The last ``limit`` journal entries: newest journal first, last line first; torn lines are skipped.

    Lines are ordered by their file's time and name, the block they were read from and their place
    there, so no file has to fit one task. Journals older than needed are not read.
    """
    newest = newest_journals(spark, folder, limit)
    entries = _entries(spark, newest) if newest else _entries(spark, folder)
    kept = entries.orderBy(F.desc("at"), F.desc("journal"), F.desc("block"), F.desc("line")).limit(limit)
    return kept.select("source_name", "output_name", "content_id", "outcome", "reason", "output_bytes", "receipt_path", "at")


@F.pandas_udf(StringType())
def _folded(names: pd.Series) -> pd.Series:
    return names.map(lambda s: unicodedata.normalize("NFC", s).lower(), na_action="ignore")


def collision_key(name: Column) -> Column:
    """Names that some file systems hold for one: composed, in lower case."""
    return _folded(name)


def by_format(files: DataFrame, name: str, order: str) -> DataFrame:
    """Groups of files by format in order of their first file: ``name, ord, files``."""
    groups = files.groupBy(name).agg(F.min(order).alias("first"), F.count("*").alias("files"))  # a row per format
    return groups.select(name, F.row_number().over(W.orderBy("first")).alias("ord"), "files")


# -- queries ---------------------------------------------------------------------------------

_EXTENSIONS = ["png", "JPG", "receipt.json", "exe", "md", "tar.gz"]


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.pmod("doc_id", F.lit(len(_EXTENSIONS))) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/in/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), kind).alias("path"))


def drop_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as dropped files: queued and skipped ones per extension."""
    found = _names(spark, sf_dir).select(extension(file_name(F.col("path"))).alias("ext"), droppable(F.col("path")).alias("queued"))
    return found.groupBy("ext").agg(F.count_if("queued").alias("queued"), F.count_if(~F.col("queued")).alias("skipped"))


def collision_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts that meet once composed and in lower case."""
    accent = F.when(F.pmod("p_partkey", F.lit(2)) == 0, F.lit("É")).otherwise(F.lit("é"))
    named = table(spark, sf_dir, "part").select(collision_key(F.concat(F.upper("p_brand"), accent, F.col("p_size").cast("string"))).alias("name"))
    return named.groupBy("name").agg(F.count("*").alias("files"))


def format_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", text_format(F.col("text")).alias("format"))
    return by_format(found, "format", "doc_id")


_KNOWN = ", ".join(f"'{r[4]}'" for r in catalog.format_rows())
QUERIES = {"drop_filter": drop_filter, "collision_keys": collision_keys, "format_groups": format_groups}
ORACLES = {
    "drop_filter": f"""
WITH n AS (SELECT {_EXTENSIONS!r}[doc_id % {len(_EXTENSIONS)} + 1] AS e FROM documents), x AS (SELECT lower(split_part(e, '.', -1)) AS ext, e <> 'receipt.json' AND lower(split_part(e, '.', -1)) IN ({_KNOWN}) AS queued FROM n)
SELECT ext, count(*) FILTER (queued) AS queued, count(*) FILTER (NOT queued) AS skipped FROM x GROUP BY ext""",
    "collision_keys": "SELECT lower(nfc_normalize(upper(p_brand) || CASE WHEN p_partkey % 2 = 0 THEN 'E' || chr(769) ELSE chr(233) END || p_size)) AS name, count(*) AS files FROM part GROUP BY 1",
    "format_groups": f"SELECT format, row_number() OVER (ORDER BY first)::INTEGER AS ord, files FROM (SELECT {_sql_format('text')} AS format, min(doc_id) AS first, count(*) AS files FROM documents GROUP BY 1)",
}
