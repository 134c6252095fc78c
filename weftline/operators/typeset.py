"""Pages of a typesetter: paragraphs to wrapped lines, lines to pages, for documents of any length.

A page breaks greedily, so where one begins depends on where the last one began. But what begins the
next page after a line that begins one is known for every line by itself: heights are summed once, and a
line's page ends at the last line whose sum stays within a page of it. These steps compose: the lines that
begin pages are those reached from a document's first line, found by taking 1, 2, 4, ... steps at once, in
as many joins as the number of pages has binary digits. No document is gathered or walked through.

Heights are whole numbers of thousandths of a point, so that no sum depends on its order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.strings import win_ansi
from weftline.operators.prefix import filled, numbered, ordered, summed
from weftline.scratch import written
from weftline.session import dealt, table

# Geometry of a page in points, sizes by style, and what they are multiplied by.
PAGE_W, PAGE_H, MARGIN, INDENT = 595, 842, 56, 18
SIZES = {"heading1": 20.0, "heading2": 15.0, "code": 9.5, "body": 11.0}
LEADING, GLYPH, HEADING_GAP, GAP = 1.32, 0.5, 0.9, 0.45
#: What a page holds, in thousandths of a point.
ROOM = (PAGE_H - 2 * MARGIN) * 1000


def _size(style: Column, level: Column) -> Column:
    """Six levels of headings, two sizes."""
    return F.when(style == "heading", F.when(level <= 1, SIZES["heading1"]).otherwise(SIZES["heading2"])).when(style == "code", SIZES["code"]).otherwise(SIZES["body"])


def _indent(style: Column, level: Column) -> Column:
    return MARGIN + INDENT * F.when(style.isin("bullet", "ordered"), level).when(style == "quote", 1).otherwise(0)


def _room(size: Column, indent: Column) -> Column:
    return F.greatest(F.floor((PAGE_W - MARGIN - indent) / (size * GLYPH)), F.lit(8)).cast("int")


def wrap(text: Column, room: Column) -> Column:
    """Lines of at most ``room`` characters, cut at spaces; a longer word is broken into lines of its own. At least one line."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    chunk = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / room).cast("int")), lambda i: F.struct(F.substr(w, i * room + 1, room).alias("w"), F.lit(True).alias("alone")))
    pieces = F.flatten(F.transform(words, lambda w: F.when(F.length(w) > room, chunk(w)).otherwise(F.array(F.struct(w.alias("w"), F.lit(False).alias("alone"))))))
    state = lambda done, line: F.struct(done.alias("done"), line.alias("line"))
    pushed = lambda a: F.when(a["line"] == "", a["done"]).otherwise(F.array_append(a["done"], a["line"]))

    def step(a: Column, p: Column) -> Column:
        fits = F.length(a["line"]) + 1 + F.length(p["w"]) <= room
        return F.when(p["alone"], state(F.array_append(pushed(a), p["w"]), F.lit(""))).when(a["line"] == "", state(a["done"], p["w"])).when(fits, state(a["done"], F.concat(a["line"], F.lit(" "), p["w"]))).otherwise(state(pushed(a), p["w"]))

    found = F.aggregate(pieces, state(F.array().cast("array<string>"), F.lit("")), step, pushed)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))


def lines(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs (``doc, pos, text, style, level, number``) to ``doc, pos, line, text, size, x, gap, leading, lost, cut``.

    Code keeps its lines and is cut at the measure (``cut``); other text is wrapped. ``lost`` counts, on a
    paragraph's first line, the characters that the encoding has no place for. A list's or quotation's
    marker stands before its first line, whose text it moves.
    """
    style, level = F.col("style"), F.coalesce("level", F.lit(0))
    sized = paragraphs.select("doc", "pos", "text", "style", "number", level.alias("level"), _size(style, level).alias("size"), _indent(style, level).cast("double").alias("x0"))
    measured = sized.withColumn("room", _room(F.col("size"), F.col("x0")))
    code = F.transform(F.regexp_extract_all(F.concat("text", F.when(F.endswith("text", F.lit("\n")) | (F.col("text") == ""), "").otherwise("\n")), F.lit(r"(?s)([^\n]*)\n"), F.lit(1)), lambda t: F.struct(win_ansi(F.regexp_replace(t, r"\r$", ""))["text"].alias("text"), win_ansi(F.regexp_replace(t, r"\r$", ""))["lost"].alias("lost")))
    plain = win_ansi(F.col("text"))
    kept = F.transform(wrap(plain["text"], F.col("room")), lambda t, i: F.struct(t.alias("text"), F.when(i == 0, plain["lost"]).otherwise(0).cast("long").alias("lost"), F.lit(False).alias("cut")))
    cut = F.transform(code, lambda c: F.struct(F.substr(c["text"], F.lit(1), F.col("room")).alias("text"), c["lost"].cast("long").alias("lost"), (F.length(c["text"]) > F.col("room")).alias("cut")))
    # Code without a line still leaves its gap: a row without height.
    each = measured.select("doc", "pos", "style", "number", "size", "x0", F.posexplode_outer(F.when(style == "code", cut).otherwise(kept)).alias("line", "l")).withColumn("line", F.coalesce("line", F.lit(0)))
    marker = F.when(style == "bullet", "- ").when(style == "ordered", F.concat(F.col("number").cast("string"), F.lit(". "))).when(style == "quote", "| ").otherwise("")
    leading = F.when(F.col("l").isNull(), 0).otherwise(F.round(F.col("size") * LEADING * 1000)).cast("long")
    gap = F.when(F.col("line") == 0, F.round(F.col("size") * LEADING * F.when(style == "heading", HEADING_GAP).otherwise(GAP) * 1000)).otherwise(0).cast("long")
    # A bullet is three bytes before it is encoded, and so long is the room that it leaves to the lines below.
    moved = F.octet_length(F.when(style == "bullet", "• ").otherwise(marker)) * F.col("size") * GLYPH
    x = F.when(F.col("line") == 0, F.col("x0")).otherwise(F.col("x0") + moved)
    return each.select("doc", "pos", "line", F.concat(F.when(F.col("line") == 0, marker).otherwise(""), F.col("l.text")).alias("text"), "size", x.alias("x"), gap.alias("gap"), leading.alias("leading"), F.col("l.lost").alias("lost"), F.col("l.cut").alias("cut"))


def _next_starts(sums: DataFrame, room: int) -> DataFrame:
    """``doc, n, to``: the line that begins the next page, if line ``n`` begins one."""
    ends = sums.select("doc", F.col("upto").alias("at"), F.lit(0).alias("kind"), F.lit(1).alias("one"), F.lit(None).cast("long").alias("n"))
    asked = sums.select("doc", (F.col("upto") - F.col("leading") + room).alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("one"), "n")
    found = summed(ordered(ends.unionByName(asked), "doc", "at", "kind"), "doc", "one", "to").where("kind = 1")
    return found.select("doc", "n", F.greatest("to", F.col("n") + 1).alias("to"))  # a line too high for a page has one of its own


def page_starts(sums: DataFrame, room: int = ROOM) -> DataFrame:
    """``doc, n`` of the lines that begin pages. ``sums``: ``doc, n, leading, upto``, heights with gaps summed up to each line."""
    last = sums.groupBy("doc").agg(F.max("n").alias("last"))
    jumps = written(_next_starts(sums, room).join(last, "doc").where("to <= last").select("doc", "n", "to"), "page-jumps")
    found = written(sums.where("n = 0").select("doc", "n"), "page-starts")
    while True:
        more = found.join(jumps, ["doc", "n"]).select("doc", F.col("to").alias("n"))
        following = written(found.unionByName(more).distinct(), "page-starts")
        if following.count() == found.count():
            return found
        found = following
        second = jumps.select("doc", F.col("n").alias("to"), F.col("to").alias("beyond"))
        jumps = written(jumps.join(second, ["doc", "to"]).select("doc", "n", F.col("beyond").alias("to")), "page-jumps")


def paginated(lines: DataFrame, room: int = ROOM) -> DataFrame:
    """Lines (``doc, pos, line, gap, leading`` and others) with ``n``, ``page`` from 0, and ``y``, the points below the top margin.

    A gap at the top of a page is left out. Rows without height add their gap to what follows, and go.
    """
    heights = summed(ordered(lines.withColumn("height", F.col("gap") + F.col("leading")), "doc", "pos", "line"), "doc", "height", "upto")
    sums = written(numbered(heights.where("leading > 0").select(*lines.columns, "upto"), "doc", "pos", "line", name="n"), "page-sums")
    starts = page_starts(sums.select("doc", "n", "leading", "upto"), room).withColumn("starts", F.lit(1))
    marked = ordered(sums.join(starts, ["doc", "n"], "left").withColumn("top", F.when(F.col("starts") == 1, F.col("upto") - F.col("leading"))), "doc", "n")
    done = filled(summed(marked, "doc", "starts", "pages"), "doc", "top")
    return done.select(*lines.columns, "n", (F.col("pages") - 1).alias("page"), ((F.col("upto") - F.col("top")) / 1000).alias("y"))


def _document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of the documents as a paragraph, styled by its place."""
    each = dealt(table(spark, sf_dir, "documents"), 2048).select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    style = F.when(F.col("pos") % 9 == 0, "heading").when(F.col("pos") % 9 == 4, "code").when(F.col("pos") % 9 == 5, "bullet").when(F.col("pos") % 9 == 6, "ordered").when(F.col("pos") % 9 == 7, "quote").otherwise("body")
    return each.select("doc", "pos", "text", style.alias("style"), F.when(F.col("pos") % 9 == 0, F.col("pos") % 4 + 1).otherwise(1).alias("level"), F.col("pos").alias("number"))


def page_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where pages break if each line of a document is one line, by turns a heading, code or text."""
    shown = _document_lines(spark, sf_dir).withColumn("size", _size(F.col("style"), F.col("level")))
    heights = shown.select("doc", "pos", F.lit(0).alias("line"), F.round(F.col("size") * 6 * F.when(F.col("style") == "heading", 900).otherwise(450)).cast("long").alias("gap"), F.round(F.col("size") * 6000).cast("long").alias("leading"))
    return paginated(heights).groupBy("doc", "page").agg(F.min("n").alias("first"), F.count("*").alias("lines"), F.round(F.max("y"), 3).alias("height"))


def typeset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents wrapped and set: lines, characters and losses of every page."""
    # Written, as sampling the order would wrap every text twice more; of a line only its length goes to the pages.
    set_ = lines(_document_lines(spark, sf_dir)).select("doc", "pos", "line", "gap", "leading", F.length("text").alias("chars"), "lost", "cut")
    found = paginated(written(set_, "typeset-lines"))
    return found.groupBy("doc", "page").agg(F.count("*").alias("lines"), F.sum("chars").alias("chars"), F.sum("lost").alias("lost"), F.count_if("cut").alias("cut"))


QUERIES = {"page_breaks": page_breaks, "typeset_pages": typeset_pages}
ORACLES = {
    "page_breaks": f"""
WITH RECURSIVE d AS (SELECT doc_id AS doc, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
z AS (SELECT doc, n, CASE WHEN n % 9 = 0 THEN CASE WHEN n % 4 = 0 THEN 20.0 ELSE 15.0 END WHEN n % 9 = 4 THEN 9.5 ELSE 11.0 END AS size FROM d),
h AS (SELECT doc, n, round(size * 6000)::BIGINT AS led, round(size * 6 * CASE WHEN n % 9 = 0 THEN 900 ELSE 450 END)::BIGINT AS gap FROM z),
c AS (SELECT *, sum(gap + led) OVER (PARTITION BY doc ORDER BY n)::BIGINT AS upto FROM h),
j AS (SELECT a.doc, a.n, min(b.n) AS nxt FROM c a JOIN c b ON b.doc = a.doc AND b.n > a.n AND b.upto - a.upto + a.led > {ROOM} GROUP BY 1, 2),
p AS (SELECT doc, 0::BIGINT AS first, 0::BIGINT AS page FROM d WHERE n = 0 UNION ALL SELECT p.doc, j.nxt, p.page + 1 FROM p JOIN j ON j.doc = p.doc AND j.n = p.first),
q AS (SELECT p.*, lead(first) OVER (PARTITION BY doc ORDER BY page) AS stop FROM p)
SELECT q.doc, page, first, count(*) AS lines, round(max(c.upto - s.upto + s.led) / 1000.0, 3) AS height
FROM q JOIN c ON c.doc = q.doc AND c.n >= first AND (stop IS NULL OR c.n < stop) JOIN c s ON s.doc = q.doc AND s.n = first GROUP BY 1, 2, 3""",
}
