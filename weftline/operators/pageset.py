"""Page sets: the selection grammar, complements, splits and orders, over arrays of page numbers.

A specification such as ``1-3,7,9-`` is parsed inside Spark's expressions: split, classify each
part, expand to a sequence, sort and deduplicate. A wrong part gives an error text, never a guess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.plans.catalog import sql_values
from weftline.session import table


def parse_spec(spec: Column, have: Column) -> Column:
    """A struct of ``pages`` (sorted, distinct) and ``error``; one of the two is null."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")
    low = lambda p: F.trim(F.split_part(p, F.lit("-"), F.lit(1)))
    high = lambda p: F.trim(F.regexp_replace(p, "^[^-]*-?", ""))
    number = lambda x: F.when(F.regexp_like(x, F.lit("^[0-9]{1,9}$")), x.cast("int"))
    first = lambda p: number(low(p))
    last = lambda p: F.when(~F.contains(p, F.lit("-")), first(p)).when(high(p) == "", have).otherwise(number(high(p)))
    problem = lambda p: (
        F.when(F.contains(p, F.lit("-")) & (low(p) == ""), "no first page")
        .when(first(p).isNull() | last(p).isNull(), "not a page number")
        .when((first(p) == 0) | (last(p) == 0), "pages start at 1")
        .when((first(p) > have) | (last(p) > have), "no such page")
        .when(last(p) < first(p), "runs backwards")
    )
    problems = F.filter(F.transform(parts, problem), lambda e: e.isNotNull())
    error = F.when(have == 0, "no pages").when(F.size(parts) == 0, "no pages were named").otherwise(F.get(problems, F.lit(0)))
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(first(p), last(p))))))
    return F.struct(F.when(error.isNull(), pages).alias("pages"), error.alias("error"))


def parse_values(text: Column, arity: int) -> Column:
    """``3:90;5:180`` to a struct of ``values``, an array of ``page`` and ``numbers``, and ``error``; one of the two is null.

    Each page carries ``arity`` numbers, parted by commas. Blank text names no page. The first wrong entry is
    the error, as a part of what was asked for must not be done alone.
    """
    entries = F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda e: F.trim(e) != "")
    page = lambda e: F.trim(F.split_part(e, F.lit(":"), F.lit(1)))
    rest = lambda e: F.split(F.regexp_replace(e, "^[^:]*:", ""), ",")
    numbers = lambda e: F.transform(rest(e), lambda v: F.trim(v).try_cast("double"))
    plain = lambda v: F.regexp_like(F.trim(v), F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"))
    problem = lambda e: (
        F.when(~F.contains(e, F.lit(":")), "not page:value")
        .when(~F.regexp_like(page(e), F.lit("^[+]?[0-9]{1,18}$")), "not a page number")
        .when(page(e).try_cast("long") == 0, "pages are numbered from 1")
        .when(F.exists(rest(e), lambda v: ~plain(v)), "not a number")
        .when(F.size(rest(e)) != arity, "wrong number of values")
        .when(F.exists(numbers(e), lambda v: F.abs(v) > 3.4028235e38), "not a number")
    )
    problems = F.filter(F.transform(entries, problem), lambda x: x.isNotNull())
    values = F.transform(entries, lambda e: F.struct(page(e).try_cast("long").alias("page"), numbers(e).alias("numbers")))
    error = F.get(problems, F.lit(0))
    return F.struct(F.when(error.isNull(), values).alias("values"), error.alias("error"))


def cropped(media: Column, current: Column, insets: Column) -> Column:
    """The crop box that insets leave of the current one, within the media box; null if they leave nothing.

    Boxes are structs of ``x0, y0, x1, y1``; insets an array of left, bottom, right and top.
    """
    at = lambda i: F.get(insets, F.lit(i))
    box = [F.greatest(current["x0"] + at(0), media["x0"]), F.greatest(current["y0"] + at(1), media["y0"]), F.least(current["x1"] - at(2), media["x1"]), F.least(current["y1"] - at(3), media["y1"])]
    return F.when((box[2] > box[0]) & (box[3] > box[1]), F.struct(*[c.alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)]))


def complement(pages: Column, have: Column) -> Column:
    """The other pages; null if none would be left."""
    rest = F.array_except(F.sequence(F.lit(1), have), pages)
    return F.when(F.size(rest) > 0, rest)


def split_every(have: Column, n: int) -> Column:
    """Parts of ``n`` pages: an array of (first, last)."""
    return F.transform(F.sequence(F.lit(1), have, F.lit(n)), lambda a: F.struct(a.alias("first"), F.least(a + (n - 1), have).alias("last")))


def split_at(have: Column, cuts: Column) -> Column:
    """Parts that end after each cut; null if a cut leaves nothing on one side."""
    ordered = F.array_sort(F.array_distinct(cuts))
    good = ~F.exists(ordered, lambda c: (c <= 0) | (c >= have))
    starts = F.concat(F.array(F.lit(1)), F.transform(ordered, lambda c: c + 1))
    ends = F.concat(ordered, F.array(have))
    return F.when(good, F.transform(F.arrays_zip(starts.alias("first"), ends.alias("last")), lambda p: F.struct(p["first"].alias("first"), p["last"].alias("last"))))


def reorder(pages: DataFrame, order: Column) -> DataFrame:
    """``doc, page`` and an array of page numbers per document: the pages in that order, numbered anew."""
    wanted = pages.select("doc", order.alias("order")).distinct().select("doc", F.posexplode("order").alias("place", "page"))
    return pages.join(wanted, ["doc", "page"]).select("doc", (F.col("place") + 1).alias("place"), "page")


#: Lines per page when a text is read as pages.
def merge(pages: DataFrame, group: str, order: str) -> DataFrame:
    """``group, order, page`` to one page set per group: all pages of its sources, in order, as ``place`` from 1.

    Counts per source are summed over the sources; pages themselves are never put in order.
    """
    counts = pages.groupBy(group, order).agg(F.max("page").alias("have"))
    before = F.coalesce(F.sum("have").over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(group, order, before.alias("before"))
    return pages.join(starts, [group, order]).withColumn("place", F.col("page") + F.col("before")).drop("before")


def page_count(pages: DataFrame, *keys: str) -> DataFrame:
    return pages.groupBy(*keys).agg(F.count("*").alias("pages"))


PAGE_LINES = 2
SPECS = [(1, "1-3,7"), (2, "2-"), (3, "3,1,1-2"), (4, "-3"), (5, "9-"), (6, ",,"), (7, "1"), (8, "2-2, 4 - 5"), (9, "x"), (10, "5-2"), (11, "0-1")]


def _pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.size(F.split("text", "\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.ceil(lines / F.lit(PAGE_LINES)).cast("int").alias("have"))


def page_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every specification against every document's number of pages."""
    specs = spark.createDataFrame(SPECS, "spec_id int, spec string")
    found = _pages_of(spark, sf_dir).crossJoin(F.broadcast(specs)).withColumn("r", parse_spec(F.col("spec"), F.col("have")))
    return found.select("doc_id", "spec_id", F.array_join(F.col("r.pages").cast("array<string>"), ",").alias("pages"), "r.error")


def page_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _pages_of(spark, sf_dir).withColumn("odd", F.filter(F.sequence(F.lit(1), F.col("have")), lambda p: p % 2 == 1))
    return found.select("doc_id", F.array_join(complement(F.col("odd"), F.col("have")).cast("array<string>"), ",").alias("pages"))


def page_split_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _pages_of(spark, sf_dir).select("doc_id", F.posexplode(split_every(F.col("have"), 3)).alias("part", "p"))
    return parts.select("doc_id", "part", "p.first", "p.last")


def page_split_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.array((F.col("have") / 2).cast("int"), F.lit(1))
    parts = _pages_of(spark, sf_dir).select("doc_id", F.posexplode(split_at(F.col("have"), cut)).alias("part", "p"))
    return parts.select("doc_id", "part", "p.first", "p.last")


def page_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even pages backwards, of each document."""
    have = _pages_of(spark, sf_dir)
    pages = have.select(F.col("doc_id").alias("doc"), "have", F.explode(F.sequence(F.lit(1), F.col("have"))).alias("page"))
    order = F.reverse(F.filter(F.sequence(F.lit(1), F.col("have")), lambda p: p % 2 == 0))
    return reorder(pages, order)


def page_rotate_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter turn of every page and the number of distinct turns; equal values grouped with their pages."""
    pages = _pages_of(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(1), F.col("have"))).alias("page"))
    turned = pages.withColumn("turn", (F.col("page") * 90 + 270) % 360)
    return turned.groupBy("doc_id", "turn").agg(F.array_join(F.array_sort(F.collect_list("page")).cast("array<string>"), ",").alias("pages"))


#: Crops asked for by turns; the fourth and later ones are wrong.
CROPS = ("1:10,20,30,40; 2 : -5,0,0.5,1e1 ;", "", "3:300,0,300,0", "2", "x:1,1,1,1", "0:1,1,1,1", "1:1,2,3", "1:1,2,3,y", "1:1,2,3,inf")


def page_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops of the documents' pages: boxes that are left, or why a request is refused."""
    asked = F.element_at(F.array(*map(F.lit, CROPS)), (F.col("doc_id") % len(CROPS) + 1).cast("int"))
    parsed = table(spark, sf_dir, "documents").select("doc_id", "n_chars", parse_values(asked, 4).alias("p"))
    box = lambda a, b, c, d: F.struct(*[x.cast("double").alias(n) for x, n in zip((a, b, c, d), ("x0", "y0", "x1", "y1"), strict=True)])
    each = parsed.select("doc_id", "n_chars", "p.error", F.explode_outer("p.values").alias("v"))
    media, current = box(F.lit(0), F.lit(0), F.lit(595), F.lit(842)), box(F.lit(5), F.lit(0), F.lit(590), F.col("n_chars") % 900)
    return each.select("doc_id", "v.page", "error", cropped(media, current, F.col("v.numbers")).alias("c")).select("doc_id", "page", "error", "c.x0", "c.y0", "c.x1", "c.y1")


def page_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ten documents by id merged into one: where each of their pages comes to be."""
    pages = _pages_of(spark, sf_dir).select(F.floor(F.col("doc_id") / 10).alias("merged"), "doc_id", F.explode(F.sequence(F.lit(1), F.col("have"))).alias("page"))
    return merge(pages, "merged", "doc_id").select("merged", "doc_id", "page", "place")


def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages_of(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(1), F.col("have"))).alias("page"))
    return page_count(pages, "doc_id")


_HAVE = "SELECT doc_id, ceil(len(string_split(text, chr(10))) / 2.0)::INTEGER AS have FROM documents"
QUERIES = {"page_spec": page_spec, "page_complement": page_complement, "page_split_every": page_split_every, "page_split_boundaries": page_split_boundaries, "page_reorder": page_reorder, "page_rotate_crop": page_rotate_crop, "page_merge": page_merge, "page_counts": page_counts, "page_crops": page_crops}
ORACLES = {
    "page_merge": f"""
SELECT doc_id // 10 AS merged, doc_id, page::INTEGER AS page, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id, page) AS place FROM (SELECT doc_id, unnest(range(1, have + 1)) AS page FROM ({_HAVE}))""",
    "page_counts": f"SELECT doc_id, have::BIGINT AS pages FROM ({_HAVE}) WHERE have > 0",
    "page_spec": f"""
WITH h AS ({_HAVE}), s AS (SELECT * FROM {sql_values(SPECS, 'spec_id, spec')}),
p AS (SELECT doc_id, spec_id, have, unnest(string_split(spec, ',')) AS raw, generate_subscripts(string_split(spec, ','), 1) AS i FROM h, s),
t AS (SELECT doc_id, spec_id, have, i, trim(raw) AS part FROM p WHERE trim(raw) <> ''),
u AS (SELECT *, TRY_CAST(trim(split_part(part, '-', 1)) AS INTEGER) AS a, CASE WHEN NOT contains(part, '-') THEN TRY_CAST(part AS INTEGER) WHEN trim(split_part(part, '-', 2)) = '' THEN have ELSE TRY_CAST(trim(split_part(part, '-', 2)) AS INTEGER) END AS b FROM t),
e AS (SELECT *, CASE WHEN contains(part, '-') AND trim(split_part(part, '-', 1)) = '' THEN 'no first page' WHEN a IS NULL OR b IS NULL THEN 'not a page number' WHEN a = 0 OR b = 0 THEN 'pages start at 1'
  WHEN a > have OR b > have THEN 'no such page' WHEN b < a THEN 'runs backwards' END AS err FROM u),
g AS (SELECT doc_id, spec_id, first(err ORDER BY i) FILTER (err IS NOT NULL) AS error, list(CASE WHEN err IS NULL THEN range(a, b + 1) ELSE []::BIGINT[] END) AS lists FROM e GROUP BY 1, 2)
SELECT h.doc_id, s.spec_id, CASE WHEN g.error IS NULL AND g.doc_id IS NOT NULL THEN array_to_string(list_sort(list_distinct(flatten(g.lists))), ',') END AS pages,
  CASE WHEN g.doc_id IS NULL THEN 'no pages were named' ELSE g.error END AS error FROM h CROSS JOIN s LEFT JOIN g ON g.doc_id = h.doc_id AND g.spec_id = s.spec_id""",
    "page_complement": f"SELECT doc_id, CASE WHEN have >= 2 THEN array_to_string(list_filter(range(1, have + 1), lambda p: p % 2 = 0), ',') END AS pages FROM ({_HAVE})",
    "page_split_every": f"SELECT doc_id, ((a - 1) // 3)::INTEGER AS part, a::INTEGER AS first, least(a + 2, have)::INTEGER AS last FROM (SELECT doc_id, have, unnest(range(1, have + 1, 3)) AS a FROM ({_HAVE}))",
    "page_split_boundaries": f"""
WITH h AS ({_HAVE}), c AS (SELECT doc_id, have, list_sort(list_distinct([have // 2, 1])) AS cuts FROM h), g AS (SELECT * FROM c WHERE len(list_filter(cuts, lambda x: x <= 0 OR x >= have)) = 0),
z AS (SELECT doc_id, list_prepend(1, list_transform(cuts, lambda x: x + 1)) AS firsts, list_append(cuts, have) AS lasts FROM g)
SELECT doc_id, (i - 1)::INTEGER AS part, firsts[i]::INTEGER AS first, lasts[i]::INTEGER AS last FROM (SELECT *, unnest(range(1, len(firsts) + 1)) AS i FROM z)""",
    "page_reorder": f"SELECT doc_id AS doc, row_number() OVER (PARTITION BY doc_id ORDER BY page DESC)::INTEGER AS place, page::INTEGER AS page FROM (SELECT doc_id, unnest(range(1, have + 1)) AS page FROM ({_HAVE})) WHERE page % 2 = 0",
    "page_rotate_crop": f"SELECT doc_id, ((page * 90 + 270) % 360)::INTEGER AS turn, string_agg(page::VARCHAR, ',' ORDER BY page) AS pages FROM (SELECT doc_id, unnest(range(1, have + 1)) AS page FROM ({_HAVE})) GROUP BY 1, 2",
    "page_crops": """
WITH d AS (SELECT doc_id, (n_chars % 900)::DOUBLE AS h, (doc_id % 9)::INTEGER AS k FROM documents),
w(k, page, error, a, b, c, d) AS (VALUES (0, 1, NULL, 10.0, 20.0, 30.0, 40.0), (0, 2, NULL, -5.0, 0.0, 0.5, 10.0), (1, NULL, NULL, NULL, NULL, NULL, NULL), (2, 3, NULL, 300.0, 0.0, 300.0, 0.0), (3, NULL, 'not page:value', NULL, NULL, NULL, NULL),
  (4, NULL, 'not a page number', NULL, NULL, NULL, NULL), (5, NULL, 'pages are numbered from 1', NULL, NULL, NULL, NULL), (6, NULL, 'wrong number of values', NULL, NULL, NULL, NULL), (7, NULL, 'not a number', NULL, NULL, NULL, NULL), (8, NULL, 'not a number', NULL, NULL, NULL, NULL)),
x AS (SELECT doc_id, page, error, greatest(5 + a, 0)::DOUBLE AS x0, greatest(b, 0)::DOUBLE AS y0, least(590 - c, 595)::DOUBLE AS x1, least(h - w.d, 842)::DOUBLE AS y1 FROM d JOIN w USING (k))
SELECT doc_id, page::BIGINT AS page, error, CASE WHEN x1 > x0 AND y1 > y0 THEN x0 END AS x0, CASE WHEN x1 > x0 AND y1 > y0 THEN y0 END AS y0, CASE WHEN x1 > x0 AND y1 > y0 THEN x1 END AS x1, CASE WHEN x1 > x0 AND y1 > y0 THEN y1 END AS y1 FROM x""",
}
