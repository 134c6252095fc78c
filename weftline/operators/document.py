"""Documents: markup and glyphs to ordered paragraphs, and paragraphs to text, Markdown and HTML.

Reading markup is sequential and runs in Arrow-fed generators, one document at a time; everything
else (writers, glyph layout) is expressions, windows and ordered aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.batches import slices
from weftline.functions import markup
from weftline.functions.strings import collapse_whitespace, html_escape, indent_continuation, longest_run, markdown_escape
from weftline.session import dealt, table

PARAGRAPHS = "doc long, pos int, text string, style string, level int, number int"


def _reading(read: Callable[[str], list[markup.Paragraph]]):
    schema = pa.schema([("doc", pa.int64()), ("pos", pa.int32()), ("text", pa.string()), ("style", pa.string()), ("level", pa.int32()), ("number", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(doc, pos, *p) for doc, source in zip(batch["doc"].to_pylist(), batch["source"].to_pylist(), strict=True) for pos, p in enumerate(read(source or ""))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def html_paragraphs(sources: DataFrame) -> DataFrame:
    """``(doc, source)`` to paragraphs in order of ``pos``."""
    return sources.select("doc", "source").mapInArrow(_reading(markup.html_paragraphs), PARAGRAPHS)


def markdown_paragraphs(sources: DataFrame) -> DataFrame:
    return sources.select("doc", "source").mapInArrow(_reading(markup.markdown_paragraphs), PARAGRAPHS)


def notebook_paragraphs(sources: DataFrame) -> DataFrame:
    return sources.select("doc", "source").mapInArrow(_reading(markup.notebook_paragraphs), PARAGRAPHS)


def _ordered(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "style", "level", "number"))).alias("ps"))


def to_text(paragraphs: DataFrame) -> DataFrame:
    """``doc, text``: a blank line between paragraphs, one line feed at the end."""
    return _ordered(paragraphs).select("doc", F.concat(F.array_join(F.transform("ps", lambda p: F.trim(p["text"])), "\n\n"), F.lit("\n")).alias("text"))


def _markdown(p: Column) -> Column:
    text, depth = F.trim(p["text"]), F.repeat(F.lit("  "), p["level"])
    marker = F.concat(p["number"].cast("string"), F.lit(". "))
    fence = F.repeat(F.lit("`"), F.greatest(longest_run(text), F.lit(2)) + 1)
    return (
        F.when(p["style"] == "heading", F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), F.greatest(F.lit(1), p["level"]))), F.lit(" "), collapse_whitespace(text)))
        .when(p["style"] == "bullet", F.concat(depth, F.lit("- "), indent_continuation(text, p["level"] * 2 + 2)))
        .when(p["style"] == "ordered", F.concat(depth, marker, indent_continuation(text, p["level"] * 2 + F.length(marker))))
        .when(p["style"] == "code", F.concat(fence, F.lit("\n"), text, F.lit("\n"), fence))
        .when(p["style"] == "quote", F.concat(F.lit("> "), F.replace(text, F.lit("\n"), F.lit("\n> "))))
        .otherwise(markdown_escape(text))
    )


def to_markdown(paragraphs: DataFrame) -> DataFrame:
    return _ordered(paragraphs.where("trim(text) <> ''")).select("doc", F.concat(F.array_join(F.transform("ps", _markdown), "\n\n"), F.lit("\n")).alias("markdown"))


def to_html(paragraphs: DataFrame) -> DataFrame:
    """``doc, body``: the elements of each document's body; lists open and close around their runs.

    What a paragraph closes and opens follows from the lists open before it, so the fold keeps the
    text so far and the open lists, outermost first (true: numbered).
    """
    tags = lambda kinds, start: F.array_join(F.transform(kinds, lambda o: F.when(o, f"{start}ol>\n").otherwise(f"{start}ul>\n")), "")

    def step(acc: Column, p: Column) -> Column:
        listed, ordered, text = p["style"].isin("bullet", "ordered"), p["style"] == "ordered", html_escape(p["text"])
        level = F.when(listed, p["level"] + 1).otherwise(0)
        depth = F.least(F.size(acc["open"]), level)
        kept = F.when((depth == level) & (level > 0) & (F.get(acc["open"], level - 1) != ordered), level - 1).otherwise(depth)
        closed = F.reverse(F.slice(acc["open"], kept + 1, F.size(acc["open"])))
        opened = F.array_repeat(ordered, level - kept)
        heading = F.least(F.lit(6), F.greatest(F.lit(1), p["level"])).cast("string")
        body = (
            F.when(listed, F.concat(F.lit("<li>"), text, F.lit("</li>\n"))).when(p["style"] == "heading", F.concat(F.lit("<h"), heading, F.lit(">"), text, F.lit("</h"), heading, F.lit(">\n")))
            .when(p["style"] == "code", F.concat(F.lit("<pre><code>"), text, F.lit("</code></pre>\n"))).when(p["style"] == "quote", F.concat(F.lit("<blockquote><p>"), text, F.lit("</p></blockquote>\n")))
            .otherwise(F.concat(F.lit("<p>"), text, F.lit("</p>\n")))
        )
        return F.struct(F.concat(acc["out"], tags(closed, "</"), tags(opened, "<"), body).alias("out"), F.concat(F.slice(acc["open"], 1, kept), opened).alias("open"))

    empty = F.struct(F.lit("").alias("out"), F.array().cast("array<boolean>").alias("open"))
    return _ordered(paragraphs).select("doc", F.aggregate("ps", empty, step, lambda a: F.concat(a["out"], tags(F.reverse(a["open"]), "</"))).alias("body"))


# -- glyphs ----------------------------------------------------------------------------------


def glyph_lines(glyphs: DataFrame) -> DataFrame:
    """``doc, page, ch, left, right, bottom, top, size`` to lines: ``doc, page, line, text, left, right, mid_y, size``.

    A line is a run of glyphs, top down and left to right, each within half the taller height of the
    glyph before it. Order within a line is by left edge; a gap wider than half the type becomes a
    space. Medians are the lower middle.
    """
    g = glyphs.where("top > bottom AND NOT regexp_like(ch, '^[\\\\x00-\\\\x1F\\\\x7F-\\\\x9F]$')").withColumn("mid", (F.col("bottom") + F.col("top")) / 2).withColumn("height", F.col("top") - F.col("bottom"))
    page = W.partitionBy("doc", "page").orderBy(F.desc("mid"), "left", "right", "ch")
    far = F.abs(F.col("mid") - F.lag("mid").over(page)) > F.greatest("height", F.lag("height").over(page)) * 0.5
    g = g.withColumn("line", F.sum(F.when(far, 1).otherwise(0)).over(page))
    line = W.partitionBy("doc", "page", "line").orderBy("left", "right", "ch")
    blank = F.regexp_like("ch", F.lit(r"^(?U)\s$"))
    gap = F.col("left") - F.lag("right").over(line)
    piece = F.when(blank, " ").when(gap > F.greatest("size", "height") * 0.5, F.concat(F.lit(" "), F.col("ch"))).otherwise(F.col("ch"))
    pieces = g.withColumn("piece", piece).withColumn("place", F.row_number().over(line))
    lower = "percentile_disc(0.5) WITHIN GROUP (ORDER BY {})"
    made = pieces.groupBy("doc", "page", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda p: p["piece"]), "").alias("text"),
        F.min_by("left", "place").alias("left"), F.max_by("right", "place").alias("right"), F.expr(lower.format("mid")).alias("mid_y"), F.expr(lower.format("greatest(size, height)")).alias("size"),
    )
    return made.withColumn("text", F.trim(F.regexp_replace("text", " +", " "))).where("text <> ''")


SHORT, GAP, HEADING, TOP_HEADING = 0.20, 1.45, 1.18, 1.55


def line_paragraphs(lines: DataFrame) -> DataFrame:
    """Lines to paragraphs of each page: ``doc, page, pos, text, style, level``."""
    page = W.partitionBy("doc", "page")
    order = page.orderBy("line")
    lower = "percentile_disc(0.5) WITHIN GROUP (ORDER BY {})"
    spaced = lines.withColumn("gap", F.abs(F.col("mid_y") - F.lag("mid_y").over(order)))
    stats = spaced.groupBy("doc", "page").agg(F.expr(lower.format("size")).alias("body"), F.expr(lower.format("gap")).alias("spacing"), F.greatest(F.max("right"), F.lit(0.0)).alias("margin"), F.min("left").alias("least"))
    s = spaced.join(stats, ["doc", "page"])
    ratio = F.col("size") / F.col("body")
    level = F.when(ratio >= TOP_HEADING, 1).when(ratio >= HEADING, 2).otherwise(0)
    s = s.withColumn("level", F.when(F.col("body") > 0, level).otherwise(0))
    width = F.col("margin") - F.col("least")
    starts = (
        ((F.coalesce("spacing", F.lit(0.0)) > 0) & (F.col("gap") > F.col("spacing") * GAP)) | ((width > 0) & (F.col("margin") - F.lag("right").over(order) > width * SHORT))
        | (F.col("left") - F.lag("left").over(order) > F.col("size"))
    )
    new = F.lag("line").over(order).isNull() | (F.col("level") > 0) | (F.lag("level").over(order) > 0) | starts
    s = s.withColumn("pos", F.sum(F.when(new, 1).otherwise(0)).over(order) - 1)
    joined = s.groupBy("doc", "page", "pos").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("ls"), F.min_by("level", "line").alias("level"))
    join = F.aggregate("ls", F.lit(""), lambda a, x: F.when(a == "", x["text"]).when(a.endswith("-"), F.concat(F.regexp_replace(a, "-$", ""), x["text"])).otherwise(F.concat(a, F.lit(" "), x["text"])))
    return joined.select("doc", "page", "pos", join.alias("text"), F.when(F.col("level") > 0, "heading").otherwise("body").alias("style"), "level")


# -- queries ---------------------------------------------------------------------------------


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), F.col("html").alias("source"))


def html_to_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_paragraphs(_pages(spark, sf_dir))


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_text(html_paragraphs(_pages(spark, sf_dir)))


def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_markdown(html_paragraphs(_pages(spark, sf_dir)))


def html_to_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_html(html_paragraphs(_pages(spark, sf_dir)))


def md_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown_paragraphs(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("source")))


def notebook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as notebooks: user turns are Markdown cells, the others code with an output."""
    cell = F.when(F.col("role") == "user", F.to_json(F.struct(F.lit("markdown").alias("cell_type"), F.col("text").alias("source")))).otherwise(
        F.to_json(F.struct(F.lit("code").alias("cell_type"), F.split("text", "(?<=\n)").alias("source"), F.array(F.struct(F.lit("stream").alias("output_type"), F.col("role").alias("text"))).alias("outputs")))
    )
    books = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", cell.alias("c")))), lambda x: x["c"]), ",").alias("cells"))
    return notebook_paragraphs(books.select("doc", F.concat(F.lit('{"nbformat":4,"cells":['), "cells", F.lit("]}")).alias("source")))


def _turn_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    style = F.when(F.col("role") == "user", "heading").when(F.col("turn") % 3 == 1, "bullet").when(F.col("turn") % 3 == 2, "ordered").otherwise("body")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").cast("int").alias("pos"), "text", style.alias("style"), F.when(style == "heading", 2).otherwise(0).alias("level"), F.col("turn").cast("int").alias("number"))


def conversations_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_text(_turn_paragraphs(spark, sf_dir))


def conversations_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_markdown(_turn_paragraphs(spark, sf_dir).where("style <> 'body'"))


COLUMNS = 60


def _glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations set in lines of 60 glyphs; user turns in larger type."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.when(F.col("role") == "user", 16.0).otherwise(10.0).alias("size"), F.split("text", "").alias("chars"))
    # Each turn is some hundred glyphs: dealt out by page before that, so that no glyph is moved, and few are sorted at a time.
    turns = dealt(turns, 1024, "doc", "page")
    g = turns.select("doc", "page", "size", F.posexplode("chars").alias("i", "ch"))
    left = (F.col("i") % COLUMNS) * F.col("size") * 0.5
    bottom = 800.0 - F.floor(F.col("i") / COLUMNS) * F.col("size") * 1.25
    return g.select("doc", "page", "ch", left.alias("left"), (left + F.col("size") * 0.5).alias("right"), bottom.alias("bottom"), (bottom + F.col("size")).alias("top"), "size")


def glyph_line_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyph_lines(_glyphs(spark, sf_dir)).select("doc", "page", "line", "text", "mid_y")


def glyph_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_paragraphs(glyph_lines(_glyphs(spark, sf_dir)))


QUERIES = {"html_paragraphs": html_to_paragraphs, "html_to_txt": html_to_text, "html_to_md": html_to_markdown, "html_to_html": html_to_html, "md_paragraphs": md_paragraphs, "notebook_paragraphs": notebook_cells,
           "conversations_txt": conversations_text, "conversations_md": conversations_markdown, "glyph_lines": glyph_line_table, "glyph_paragraphs": glyph_paragraphs}
ORACLES = {
    "conversations_txt": "SELECT conv_id AS doc, string_agg(trim(text, ' '), chr(10) || chr(10) ORDER BY turn) || chr(10) AS text FROM conversations GROUP BY conv_id",
    "conversations_md": r"""
WITH p AS (SELECT conv_id AS doc, turn, trim(text, ' ') AS t, CASE WHEN role = 'user' THEN 'heading' WHEN turn % 3 = 1 THEN 'bullet' WHEN turn % 3 = 2 THEN 'ordered' ELSE 'body' END AS style FROM conversations)
SELECT doc, string_agg(CASE style WHEN 'heading' THEN '## ' || trim(regexp_replace(t, '\s+', ' ', 'g')) WHEN 'bullet' THEN '- ' || replace(t, chr(10), chr(10) || '  ')
  ELSE turn || '. ' || replace(t, chr(10), chr(10) || repeat(' ', length(turn || '. '))) END, chr(10) || chr(10) ORDER BY turn) || chr(10) AS markdown FROM p WHERE style <> 'body' AND t <> '' GROUP BY doc""",
    "glyph_lines": """
WITH t AS (SELECT conv_id AS doc, turn AS page, CASE WHEN role = 'user' THEN 16.0 ELSE 10.0 END::DOUBLE AS size, text FROM conversations),
g AS (SELECT doc, page, size, i - 1 AS i, substr(text, i, 1) AS ch FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM t)),
l AS (SELECT doc, page, i // 60 AS n, string_agg(CASE WHEN ch = ' ' THEN ' ' ELSE ch END, '' ORDER BY i) AS raw, min(800.0 - (i // 60) * size * 1.25 + size / 2) AS mid_y FROM g WHERE NOT regexp_matches(ch, '[\\x00-\\x1F\\x7F-\\x{9F}]') GROUP BY 1, 2, 3),
k AS (SELECT doc, page, row_number() OVER (PARTITION BY doc, page ORDER BY n) - 1 AS line, trim(regexp_replace(raw, ' +', ' ', 'g')) AS text, mid_y FROM l)
SELECT doc, page, line, text, mid_y FROM k WHERE text <> ''""",
}
