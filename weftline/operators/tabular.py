"""Tables as text: CSV to JSON objects and back, and cell grids.

CSV text is sequential (quotes may hold line breaks), so one Arrow-fed generator per batch of files
cuts it into cells; everything after that (names for extra cells counted over the whole file, last
duplicate header wins, nulls for short rows) is aggregation over the cell table. Values stay text.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.session import table

#: Rows of a file that are joined with its header together.
BLOCK = 4096
CELLS = "file string, row long, pos int, value string, width int"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("row", pa.int64()), ("pos", pa.int32()), ("value", pa.string()), ("width", pa.int32())])
    csv.field_size_limit(1 << 31)
    for batch in batches:
        for file, content in zip(batch["file"].to_pylist(), batch["content"].to_pylist(), strict=True):
            columns: tuple[list, ...] = ([], [], [], [])
            number = 0
            for record in csv.reader(io.StringIO(content or "", newline="")):
                if not record:
                    continue
                for place, value in enumerate(record):
                    for column, x in zip(columns, (number, place, value, len(record)), strict=True):
                        column.append(x)
                number += 1
                if len(columns[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(columns[0])), *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]], schema=schema)
                    columns = ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(columns[0]), pa.string()), *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]], schema=schema)


def csv_cells(files: DataFrame) -> DataFrame:
    """``(file, content)`` to one row per cell; row 0 is the header."""
    return files.select("file", "content").mapInArrow(_cut, CELLS)


def csv_fields(cells: DataFrame) -> DataFrame:
    """``file, row, key, value``: fields of every data row, as an object has them.

    Cells beyond the header are ``extra_column_N``, N counting over the whole file; a missing cell is
    null; of two columns with one name the last wins.
    """
    header = cells.where("row = 0").select("file", "pos", F.col("value").alias("key"))
    width = header.groupBy("file").agg(F.count("*").alias("columns"))
    # The header joins blocks of rows, so that no task has all of a large file.
    block = F.floor(F.col("row") / BLOCK).alias("block")
    blocks = cells.where("row > 0").select("file", block).distinct()
    data = cells.where("row > 0").withColumn("block", block).join(blocks.join(width, "file"), ["file", "block"])
    beyond = data.where("pos >= columns").select("file", "block", "row", "pos", "value")
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = beyond.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    number = F.col("before") + F.row_number().over(W.partitionBy("file", "block").orderBy("row", "pos"))
    extra = beyond.join(before, ["file", "block"]).select("file", "row", "pos", F.concat(F.lit("extra_column_"), number).alias("key"), "value")
    headers = blocks.join(header, "file")
    named = data.where("pos < columns").join(headers, ["file", "block", "pos"]).select("file", "row", "pos", "key", "value")
    short = data.where("pos = 0 AND width < columns").select("file", "block", "row", F.explode(F.sequence("width", F.col("columns").cast("int") - 1)).alias("pos"))
    missing = short.join(headers, ["file", "block", "pos"]).select("file", "row", "pos", "key", F.lit(None).cast("string").alias("value"))
    every = named.unionByName(extra).unionByName(missing)
    return every.groupBy("file", "row", "key").agg(F.max_by(F.struct("value"), "pos")["value"].alias("value"))


def csv_to_json(files: DataFrame) -> DataFrame:
    """``file, row, object``: one JSON object per data row, keys in order of name, nulls kept."""
    fields = csv_fields(csv_cells(files))
    entry = lambda e: F.concat(F.to_json(F.array(e["key"])), F.lit(":"), F.coalesce(F.to_json(F.array(e["value"])), F.lit("[null]")))
    bare = lambda e: F.regexp_replace(entry(e), r"^\[(.*)\]:\[(.*)\]$", "$1:$2")
    objects = fields.groupBy("file", "row").agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("fields"))
    return objects.select("file", "row", F.concat(F.lit("{"), F.array_join(F.transform("fields", bare), ","), F.lit("}")).alias("object"))


def csv_line(values: Column) -> Column:
    """An array of strings as one CSV record; null cells are empty."""
    from weftline.functions.strings import csv_quote

    return F.array_join(F.transform(values, lambda v: csv_quote(F.coalesce(v, F.lit("")))), ",")


def json_columns(objects: DataFrame) -> DataFrame:
    """``name, ord``: columns of a table of flat objects, in order of first appearance, sorted within a row."""
    keys = objects.select("row", F.explode(F.array_sort(F.json_object_keys("object"))).alias("name"))
    first = keys.groupBy("name").agg(F.min("row").alias("row"))
    return first.select("name", F.row_number().over(W.orderBy("row", "name")).alias("ord"))


def json_to_csv(objects: DataFrame) -> DataFrame:
    """``row, line``: the header is row 0. A nested value is an error, as it has no honest cell."""
    columns = json_columns(objects)
    header = columns.agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("columns"))
    kept = objects.select("row", F.from_json("object", "map<string,variant>").alias("m"), "object")
    text = lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT") | F.schema_of_variant(v).startswith("ARRAY"), F.raise_error(F.lit("a nested value has no cell"))).otherwise(F.try_variant_get(v, "$", "string"))
    lines = kept.crossJoin(F.broadcast(header)).select("row", csv_line(F.transform("columns", lambda c: text(F.try_element_at("m", c["name"])))).alias("line"))
    return header.select(F.lit(0).cast("long").alias("row"), csv_line(F.transform("columns", lambda c: c["name"])).alias("line")).unionByName(lines)


def cell_text(kind: Column, text: Column, number: Column, flag: Column) -> Column:
    """A typed cell as text: whole numbers below 1e15 without a fraction."""
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(kind == "number", F.when(whole, number.cast("decimal(38,0)").cast("string")).otherwise(number.cast("string"))).when(kind == "bool", F.upper(flag.cast("string"))).when(kind == "empty", "").otherwise(text)


def grid_json(cells: DataFrame) -> DataFrame:
    """``sheet, row, col, text`` to each sheet's array of arrays of strings."""
    rows = cells.groupBy("sheet", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda c: c["text"]).alias("cells"))
    return rows.groupBy("sheet").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda r: r["cells"])).alias("grid"))


def sheet_rows(cells: DataFrame) -> DataFrame:
    """``doc, sheet, row, col`` and typed values to ``doc, row, values``: the first sheet of each workbook as a full grid of strings.

    The grid spans the rows and columns in use, gaps are empty strings, and rows count from 0.
    """
    kept = cells.select("doc", "sheet", "row", "col", cell_text(F.col("type"), F.col("str"), F.col("num"), F.col("bool")).alias("text"))
    sheets = kept.groupBy("doc", "sheet").agg(*[f(x).alias(f"{n}_{x}") for x in ("row", "col") for n, f in (("first", F.min), ("last", F.max))])
    first = sheets.groupBy("doc").agg(F.min_by(F.struct("*"), "sheet").alias("s")).select("doc", "s.sheet", "s.first_row", "s.last_row", "s.first_col", "s.last_col")
    rows = kept.groupBy("doc", "sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("found"))
    grid = first.withColumn("row", F.explode(F.sequence("first_row", "last_row"))).join(rows, ["doc", "sheet", "row"], "left")
    values = F.transform(F.sequence("first_col", "last_col"), lambda c: F.coalesce(F.try_element_at("found", c), F.lit("")))
    return grid.select("doc", (F.col("row") - F.col("first_row")).alias("row"), values.alias("values"))


def sheet_csv(cells: DataFrame) -> DataFrame:
    """``doc, row, line``: the first sheet of each workbook as CSV lines."""
    return sheet_rows(cells).select("doc", "row", csv_line(F.col("values")).alias("line"))


# -- queries ---------------------------------------------------------------------------------


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each segment written as CSV files with odd names, a thousand ids a file, and read back as fields."""
    odd = F.concat(F.col("c_name"), F.when(F.col("c_custkey") % 3 == 0, F.lit(', "the\nsecond"')).otherwise(""))
    lines = table(spark, sf_dir, "customer").select(F.concat_ws("/", "c_mktsegment", F.floor(F.col("c_custkey") / 1000).cast("string")).alias("file"), "c_custkey", csv_line(F.array(F.col("c_custkey").cast("string"), odd, F.col("c_nationkey").cast("string"))).alias("line"))
    files = lines.groupBy("file").agg(F.concat(F.lit("key,name,nation\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "line"))), lambda r: r["line"]), "\n")).alias("content"))
    fields = csv_fields(csv_cells(files))
    return fields.groupBy("file", "row").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in ("key", "name", "nation")]).drop("row").withColumn("file", F.regexp_replace("file", "/[0-9]+$", ""))


def csv_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short, long and doubled columns: a file per nation with the same shape."""
    files = table(spark, sf_dir, "nation").select(F.col("n_name").alias("file"), F.concat(F.lit("h1,h2,h1\na\nc,d,e,extra\n\n1,2,3,x,y\n"), F.col("n_nationkey").cast("string"), F.lit(",\n")).alias("content"))
    return csv_to_json(files)


def json_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of all event properties in order of first appearance."""
    return json_columns(table(spark, sf_dir, "events").select(F.col("event_id").alias("row"), F.col("props").alias("object")))


def json_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as JSON objects, written as CSV."""
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("row"), F.to_json(F.struct(F.col("p_size").alias("size"), F.col("p_name").alias("name"), F.col("p_partkey").alias("key"))).alias("object"))
    return json_to_csv(parts)


def grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a sheet per nation, cells typed and printed."""
    s = table(spark, sf_dir, "supplier")
    cells = s.select(F.col("s_nationkey").alias("sheet"), F.col("s_suppkey").alias("row"), F.explode(F.array(
        F.struct(F.lit(0).alias("col"), cell_text(F.lit("number"), F.lit(None).cast("string"), F.col("s_suppkey").cast("double"), F.lit(None).cast("boolean")).alias("text")),
        F.struct(F.lit(1).alias("col"), cell_text(F.lit("text"), F.col("s_name"), F.lit(None).cast("double"), F.lit(None).cast("boolean")).alias("text")),
        F.struct(F.lit(2).alias("col"), cell_text(F.lit("bool"), F.lit(None).cast("string"), F.lit(None).cast("double"), F.col("s_acctbal") > 0).alias("text")),
    )).alias("c")).select("sheet", "row", "c.col", "c.text")
    return grid_json(cells)


QUERIES = {"csv_roundtrip": csv_roundtrip, "csv_ragged": csv_ragged, "json_key_union": json_key_union, "json_csv_lines": json_csv_lines, "grid_json": grid_rows}
ORACLES = {
    "csv_roundtrip": """SELECT c_mktsegment AS file, c_custkey::VARCHAR AS "key", c_name || CASE WHEN c_custkey % 3 = 0 THEN ', "the' || chr(10) || 'second"' ELSE '' END AS name, c_nationkey::VARCHAR AS nation FROM customer""",
    "csv_ragged": """
SELECT n_name AS file, "row"::BIGINT AS "row", replace(object, '#', n_nationkey::VARCHAR) AS object FROM nation, (VALUES (1, '{"h1":null,"h2":null}'), (2, '{"extra_column_1":"extra","h1":"e","h2":"d"}'),
  (3, '{"extra_column_2":"x","extra_column_3":"y","h1":"3","h2":"2"}'), (4, '{"h1":null,"h2":""}')) v("row", object)""",
    "json_key_union": "SELECT name, row_number() OVER (ORDER BY r, name)::INTEGER AS ord FROM (SELECT name, min(event_id) AS r FROM (SELECT event_id, unnest(json_keys(props)) AS name FROM events) GROUP BY name)",
    "json_csv_lines": """SELECT 0::BIGINT AS "row", 'key,name,size' AS line UNION ALL SELECT p_partkey + 1, p_partkey || ',' || p_name || ',' || p_size FROM part""",
    "grid_json": """
SELECT s_nationkey AS sheet, '[' || string_agg('["' || s_suppkey || '","' || s_name || '","' || CASE WHEN s_acctbal > 0 THEN 'TRUE' ELSE 'FALSE' END || '"]', ',' ORDER BY s_suppkey) || ']' AS grid FROM supplier GROUP BY 1""",
}
