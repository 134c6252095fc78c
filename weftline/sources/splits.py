"""One large CSV file or JSON array, read by many tasks.

Spark cuts a file into blocks and blocks into lines. What a line means depends on whether a quote is open
where it begins, so each line is turned into its effect: the state it ends in for each state it may begin
in, two bits. Effects compose, and a running composition gives every line its state: as a function of two
states either forgets its argument, keeps it or swaps it, that is the last line that forgets, and the
parity of swaps since, both of which ``prefix`` finds without putting a file into one task. Then lines
are joined to records, which are parsed apart.

* CSV: lines end at line feeds and carriage returns; a quote opens a field only at its start, a doubled
  one stays inside. A record never leaves its quotes by accident, wherever a block ends.
* JSON: "lines" end at ``}``, so that an array in one line is cut too. Inside strings nothing counts;
  outside, brackets give depths, and an object ends where the depth is back at the array's. Pieces are not
  sorted: their blocks are numbered, and a slot is a bounded run of a block's pieces.

A folder may hold one logical file in parts, in order of their names. Blank lines are no records; a last
record without its closing quote ends with the file, less its last line end.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.prefix import filled, numbered, ordered, summed
from weftline.operators.tabular import CELLS, csv_fields, csv_line, json_to_csv
from weftline.scratch import scratch_path, written
from weftline.session import table


def lines(spark: SparkSession, path: str, sep: str = "\n", parts: bool = False) -> DataFrame:
    """``file, part, size, block, line, text``: the lines of files; ``parts``: a folder of parts is one file."""
    found = spark.read.option("lineSep", sep).text(path)
    name = F.col("_metadata.file_path")
    file = F.regexp_replace(name, "/[^/]*$", "") if parts else name
    return found.select(file.alias("file"), name.alias("part"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))


def _effects(rows: DataFrame, from_out: Column, from_in: Column) -> DataFrame:
    effect = rows.withColumn("_out", from_out).withColumn("_in", from_in)
    return effect.withColumn("_swap", (F.col("_out") & ~F.col("_in")).cast("int"))


def with_effects(rows: DataFrame, from_out: Column, from_in: Column, *order: str) -> DataFrame:
    """Rows of files, ``ordered``, with their effects: whether the state at their end is the inner one, for a row that begins outside, or inside."""
    return ordered(_effects(rows, from_out, from_in), "file", *order)


def with_state(effects: DataFrame) -> DataFrame:
    """Rows of ``with_effects`` with ``_ends``: whether the state at their end is the inner one. Files begin outside."""
    placed = summed(effects, "file", "_swap", "_swaps")
    fixed = F.when(F.col("_out") == F.col("_in"), F.struct(F.col("_out").alias("state"), F.col("_swaps").alias("swaps")))
    placed = filled(placed.withColumn("_fixed", fixed), "file", "_fixed")
    ends = F.coalesce("_fixed.state", F.lit(False)).cast("int") + F.col("_swaps") - F.coalesce("_fixed.swaps", F.lit(0))
    return placed.withColumn("_ends", ends % 2 == 1)


def _before(placed: DataFrame, name: str, default: Column) -> DataFrame:
    """The value of ``name`` in the row before, in the order of ``ordered``, within a file."""
    last = placed.groupBy("file", "_slot").agg(F.max_by(name, "_at").alias("_carry"))
    earlier = W.partitionBy("file").orderBy("_slot")
    carried = last.select(F.col("file").alias("_group"), F.col("_slot").alias("_from"), F.lag("_carry").over(earlier).alias("_carry"), F.row_number().over(earlier).alias("_n")).where("_n > 1").drop("_n")
    joined = placed.join(F.broadcast(carried), (F.col("file") == F.col("_group")) & (F.col("_slot") == F.col("_from")), "left")
    return joined.withColumn("inside", F.coalesce(F.lag(name).over(W.partitionBy("file", "_slot").orderBy("_at")), "_carry", default)).drop("_group", "_from", "_carry")


# -- CSV -------------------------------------------------------------------------------------

_START, _BARE, _QUOTED, _CLOSED = range(4)


def _ends_inside(text: Column, start: int) -> Column:
    """Whether a quote is open after the line, begun at a field's start or inside quotes.

    The line is taken by the stretches between its quotes; only whether a stretch is empty or ends in
    a comma matters.
    """
    stretch = lambda s, x: F.when(x == "", s).when(s == _QUOTED, s).when(F.endswith(x, F.lit(",")), _START).otherwise(_BARE)
    quote = lambda s: F.element_at(F.array(*map(F.lit, (_QUOTED, _BARE, _CLOSED, _QUOTED))), s + 1)
    parts = F.split(text, '"')
    first = stretch(F.lit(start), F.get(parts, 0))
    return F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), first, lambda s, x: stretch(quote(s), x)) == _QUOTED


def csv_records(found: DataFrame) -> DataFrame:
    """``lines`` to ``file, row, record``: the text of every record, in order from 0."""
    pieces = F.split(F.coalesce("text", F.lit("")), "\r")
    each = found.select("file", "part", "block", "line", F.posexplode(pieces).alias("piece", "text"), (F.size(pieces) - 1).alias("last"))
    # The end that a piece had, wanted where a record goes on behind it.
    each = each.withColumn("end", F.when(F.col("piece") < F.col("last"), F.lit("\r")).otherwise(F.lit("\n"))).drop("last")
    placed = with_state(with_effects(each, _ends_inside(F.col("text"), _START), _ends_inside(F.col("text"), _QUOTED), "part", "block", "line", "piece"))
    placed = _before(placed, "_ends", F.lit(False)).withColumn("begins", (~F.col("inside")).cast("int"))
    whole = summed(placed.select("file", "_at", "_slot", "text", "end", "begins"), "file", "begins", "record_no")
    joined = F.array_sort(F.collect_list(F.struct("_at", "text", "end")))
    n = F.size("pieces")
    records = whole.groupBy("file", "record_no").agg(joined.alias("pieces")).select(
        "file", "record_no", F.concat(F.array_join(F.transform(F.slice("pieces", F.lit(1), n - 1), lambda p: F.concat(p["text"], p["end"])), ""), F.element_at("pieces", -1)["text"]).alias("record")
    )
    return numbered(records.where("record <> ''"), "file", "record_no", name="row").select("file", "row", "record")


def _fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(1 << 31)
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for file, row, record in zip(*(batch[c].to_pylist() for c in ("file", "row", "record")), strict=True):
            values = next(csv.reader(io.StringIO(record, newline="")))
            for at, value in enumerate(values):
                for column, x in zip(out, (file, row, at, value, len(values)), strict=True):
                    column.append(x)
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["file", "row", "pos", "value", "width"])


def csv_file_cells(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """The cells of large CSV files, as ``tabular.csv_cells`` has them of small ones."""
    return csv_records(lines(spark, path, parts=parts)).mapInArrow(_fields, CELLS)


# -- JSON ------------------------------------------------------------------------------------


def _walked(text: Column, inside: bool) -> Column:
    """``(inside, depth)`` after a piece, without a ``}`` behind it: whether a string is open, and by how much brackets open."""
    count = lambda x, signs: F.length(x) - F.length(F.translate(x, signs, ""))
    step = lambda s, i, d: F.struct(i.alias("inside"), d.cast("int").alias("depth"))
    escaped = lambda x: F.length(F.regexp_extract(x, r"\\*$", 0)) % 2 == 1
    outer = lambda x: count(x, "{[") - count(x, "}]")
    # Every stretch but the last is followed by a quote, which opens a string, or closes one unless it is escaped.
    quoted = lambda s, x: step(s, F.when(s["inside"], escaped(x)).otherwise(True), s["depth"] + F.when(s["inside"], 0).otherwise(outer(x)))
    parts = F.split(text, '"')
    until = F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), F.struct(F.lit(inside).alias("inside"), F.lit(0).alias("depth")), quoted)
    return F.struct(until["inside"].alias("inside"), (until["depth"] + F.when(until["inside"], 0).otherwise(outer(F.element_at(parts, -1)))).alias("depth"))


#: A piece's place in its block has so many bits, of which the lower ones are its place in a slot.
_PLACE_BITS, _SLOT_BITS = 36, 15


def _blocks(pieces: DataFrame) -> DataFrame:
    """A row per block that holds pieces: its ``place`` in its file, and what its part's first and last piece need.

    ``id`` stands for the file. A ``}`` is behind every piece but a part's last, which may end with the part instead:
    then the part has a byte less than its pieces and as many ``}`` (``brace``). (Where the reader skips a byte order
    mark, both have three bytes more.) A compressed part counts as one that does not end in ``}``.

    Backslashes that a part ends in may escape what the next begins with. Its last piece loses these ``cut``, and the
    next piece has them in front (``carry``), so that every piece holds its escapes whole and the text stays as it is.
    """
    tail = F.length("text") - F.length(F.rtrim("text", F.lit("\\")))
    last = lambda x: F.max_by(x, "line")
    found = pieces.groupBy("file", "part", "block").agg(
        F.max("size").alias("size"), F.count("*").alias("n"), F.sum(F.octet_length("text") + F.lit(1).cast("long")).alias("bytes"), F.min("line").alias("first"), F.max("line").alias("last"),
        last(tail).alias("tail"), last(tail == F.length("text")).alias("only"),
    )
    runs = written(found, "blocks")
    parts = runs.groupBy("file", "part").agg(
        (F.max("size") - F.sum("bytes")).isin(0, 3).alias("brace"), F.min_by("first", "block").alias("begin"), F.max_by("last", "block").alias("end"),
        F.max_by("tail", "block").alias("cut"), ((F.sum("n") == 1) & F.max_by("only", "block")).alias("whole"),
    )
    file, order = W.partitionBy("file"), W.partitionBy("file").orderBy("part")
    parts = parts.withColumn("final", F.col("part") == F.max("part").over(file))
    parts = parts.withColumn("cut", F.when(F.col("brace") | F.col("final"), 0).otherwise(F.col("cut"))).withColumn("whole", F.col("whole") & ~F.col("brace") & ~F.col("final"))
    parts = parts.withColumn("sum", F.sum("cut").over(order))
    # What parts of backslashes only have in front goes on with their own.
    since = F.last(F.when(~F.col("whole"), F.col("sum") - F.col("cut")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    carry = F.when(F.col("whole"), 0).otherwise(F.coalesce(F.lag("sum").over(order), F.lit(0)) - F.coalesce(since, F.lit(0)))
    parts = parts.withColumn("carry", carry.cast("int")).withColumn("cut", F.col("cut").cast("int"))
    place = F.row_number().over(W.partitionBy("file").orderBy("part", "block")).cast("long")
    numbered_ = runs.select("file", "part", "block", "first", F.min("first").over(file).alias("id"), place.alias("place"))
    return written(numbered_.join(parts.drop("sum", "whole"), ["file", "part"]), "blocks")


def _placed(pieces: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pieces as ``prefix.ordered`` has rows, with ``closed``: whether a ``}`` is behind them in their object.

    The last piece of a file is behind all objects, with its ``}`` if there is one.
    """
    found = pieces.drop("file", "size").join(F.broadcast(blocks), ["part", "block"])
    begin, end = F.col("line") == F.col("begin"), F.col("line") == F.col("end")
    text = F.when(end & (F.col("cut") > 0), F.expr("left(text, length(text) - cut)")).otherwise(F.col("text"))
    text = F.when(begin & (F.col("carry") > 0), F.concat(F.repeat(F.lit("\\"), F.col("carry")), text)).otherwise(text)
    brace = end & F.col("final") & F.col("brace")
    at = F.shiftleft("place", _PLACE_BITS) + F.col("line") - F.col("first")
    return found.select(F.col("id").alias("file"), at.alias("_at"), F.shiftright(at, _SLOT_BITS).alias("_slot"), text.alias("text"), (~end | (F.col("brace") & ~F.col("final"))).alias("closed"), F.coalesce(brace, F.lit(False)).alias("brace"))


def json_objects(found: DataFrame) -> DataFrame:
    """Pieces of ``lines(..., sep="}")`` to ``file, row, object``: the objects of each file's array, from 1.

    A file that is not one array of objects is an error.
    """
    # Dealt out by runs of a block, since blocks may be few and large, or many and small.
    pieces = written(found.withColumn("text", F.coalesce("text", F.lit(""))).repartition("part", "block", F.shiftright("line", _SLOT_BITS)), "pieces")
    blocks = _blocks(pieces)
    walked = _placed(pieces, blocks).withColumn("o", _walked(F.col("text"), False)).withColumn("i", _walked(F.col("text"), True))
    walked = written(walked.withColumn("text", F.when(F.col("brace"), F.concat("text", F.lit("}"))).otherwise(F.col("text"))).drop("brace"), "walked")
    placed = _before(with_state(_effects(walked, F.col("o.inside"), F.col("i.inside"))), "_ends", F.lit(False))
    ends = F.col("closed") & ~F.col("_ends")
    delta = F.when(F.col("inside"), F.col("i.depth")).otherwise(F.col("o.depth")) - ends.cast("int")
    placed = placed.select("file", "_at", "_slot", "text", "closed", "_ends", delta.alias("delta"))
    deep = summed(placed, "file", "delta", "depth").withColumn("done", (ends & (F.col("depth") == 1)).cast("int"))
    # A piece belongs to the object that ends with it or next.
    known = summed(deep, "file", "done", "upto").withColumn("row", F.col("upto") - F.col("done") + 1)
    texts = known.groupBy("file", "row").agg(F.array_sort(F.collect_list(F.struct("_at", "text", "closed"))).alias("pieces"), F.max("done").alias("done"))
    names = blocks.select("file", F.col("id").alias("_id")).distinct()
    texts = texts.withColumnRenamed("file", "_id").join(F.broadcast(names), "_id").select("file", "row", "done", F.array_join(F.transform("pieces", lambda p: F.concat(p["text"], F.when(p["closed"], "}").otherwise(""))), "").alias("text"))
    before = F.when(F.col("row") == 1, r"(?s)^\s*\[\s*(\{.*)$").otherwise(r"(?s)^\s*,\s*(\{.*)$")
    fault = lambda why: F.raise_error(F.concat(F.lit(f"{why}: "), F.col("file")))
    # What is left behind the last object must close the array.
    tail = F.when(F.col("row") == 1, r"^\s*\[\s*\]\s*$").otherwise(r"^\s*\]\s*$")
    head = F.regexp(F.col("text"), before)
    object_ = F.when(head, F.regexp_extract(F.col("text"), r"(?s)^[\s\[,]*(\{.*)$", 1)).otherwise(fault("not an array of objects"))
    checked = F.when(F.col("done") == 1, object_).when(F.regexp(F.col("text"), tail), F.lit(None)).otherwise(fault("this array does not end"))
    return texts.select("file", "row", checked.alias("object")).where("object IS NOT NULL")


def json_file_csv(spark: SparkSession, path: str) -> DataFrame:
    """``row, line``: one large JSON array of flat objects as CSV."""
    return json_to_csv(json_objects(lines(spark, path, "}")).drop("file"))


# -- queries ---------------------------------------------------------------------------------


def _as_parts(rows: DataFrame, order: str, text: str, name: str) -> str:
    """A folder that holds one logical text in parts, by order."""
    folder = scratch_path(rows.sparkSession, name)
    rows.repartitionByRange(order).sortWithinPartitions(order).select(F.col(text).alias("value")).write.option("lineSep", "\n").text(folder)
    return folder


def csv_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one CSV file, texts with their line breaks and quotes, read in blocks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(F.lit('say "'), F.col("text"), F.lit('", ')).alias("text"), "n_chars")
    records = docs.select("doc_id", csv_line(F.array(F.col("doc_id").cast("string"), "lang", "text", F.col("n_chars").cast("string"))).alias("text"))
    header = spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("doc_id,lang,text,n_chars").alias("text"))
    fields = csv_fields(written(csv_file_cells(spark, _as_parts(header.unionByName(records), "doc_id", "text", "csv"), parts=True), "csv-cells"))
    value = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    found = fields.groupBy("row").agg(value("doc_id").alias("doc_id"), value("lang").alias("lang"), F.md5(value("text").cast("binary")).alias("text_md5"), value("n_chars").alias("n_chars"))
    return found.select("row", "doc_id", "lang", "text_md5", "n_chars")


def json_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one JSON array, with objects and quotes in strings, read in blocks."""
    events = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_id", F.concat("props", F.lit('}]"\\')).alias("props"), F.array("user_id", F.lit(1)).alias("ids"), F.struct("event_type").alias("kind"))).alias("text"))
    marks = spark.range(2).select(F.when(F.col("id") == 0, -1).otherwise(1 << 62).alias("event_id"), F.when(F.col("id") == 0, "[").otherwise("]").alias("text"))
    first = events.agg(F.min("event_id")).first()[0]
    each = events.withColumn("text", F.concat(F.when(F.col("event_id") == first, "").otherwise(", "), "text"))
    found = json_objects(lines(spark, _as_parts(marks.unionByName(each), "event_id", "text", "json"), "}", parts=True))
    return found.select("row", F.get_json_object("object", "$.event_id").cast("long").alias("event_id"), F.get_json_object("object", "$.props").alias("props"), F.get_json_object("object", "$.kind.event_type").alias("event_type"))


QUERIES = {"csv_split": csv_split, "json_split": json_split}
ORACLES = {
    "csv_split": """SELECT row_number() OVER (ORDER BY doc_id) AS "row", doc_id::VARCHAR AS doc_id, lang, md5('say "' || text || '", ') AS text_md5, n_chars::VARCHAR AS n_chars FROM documents""",
    "json_split": """SELECT row_number() OVER (ORDER BY event_id) AS "row", event_id, props || '}]"\\' AS props, event_type FROM events""",
}
