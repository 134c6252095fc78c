"""Detection: what a blob is, from its bytes and structure, and whether its name agrees.

Binary blobs are matched against the signature table, a constant array that each row filters by
slices of its head, so nothing is joined or shuffled; blobs without a signature, and all texts, go
through an ordered CASE of structural tests. More than one signature outside one family is a
polyglot, which takes the first match and is refused by the planner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans import catalog
from weftline.session import table

HEAD = 4096
#: Bytes in which the document type of an EBML header is sought, and entries of a TIFF directory that are read.
EBML_WINDOW, IFD_ENTRIES = 1024, 512
_DXF = r"^0\s*[\r\n]+\s*SECTION\s*[\r\n]+\s*2\s*[\r\n]+\s*(HEADER|CLASSES|TABLES|BLOCKS|ENTITIES|OBJECTS)[ \t]*(\r?\n|$)"
#: Control characters other than tab, line feed and carriage return.
_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"


def first_line(text: Column) -> Column:
    return F.regexp_replace(F.split_part(text, F.lit("\n"), F.lit(1)), r"\r$", "")


def structural(text: Column) -> Column:
    """The format of a text without a signature."""
    t = F.regexp_replace(text, r"^(?U)\s+", "")
    line = first_line(t)
    return (
        F.when(t.startswith("{") | t.startswith("["), F.when(F.contains(t, F.lit('"cells"')) & F.contains(t, F.lit('"cell_type"')), "Ipynb").otherwise("Json"))
        .when(t.startswith("<?xml") | t.startswith("<svg"), F.when(F.contains(t, F.lit("<svg")), "Svg").otherwise("Unknown"))
        .when(F.regexp_like(t, F.lit(_DXF)), "Dxf")
        .when((line != "") & ~F.regexp_like(line, F.lit(r"[\x00-\x1F\x7F-\x9F]")) & F.contains(line, F.lit(",")), "Csv")
        .when((text != "") & ~F.regexp_like(text, F.lit(_CONTROL)), "Txt")
        .otherwise("Unknown")
    )


def text_format(text: Column) -> Column:
    """As ``structural``, after the signatures that a text can have; null is Unknown."""
    head = F.coalesce(text, F.lit(""))
    html = head.startswith("<!DOCTYPE html") | head.startswith("<!doctype html") | head.startswith("<html")
    other = F.when(head.startswith("%PDF-"), "Pdf").when(head.startswith("%!PS"), "PostScript").when(head.startswith("GIF87a") | head.startswith("GIF89a"), "Gif").when(head.startswith("BM"), "Bmp")
    return F.when(html, "Html").otherwise(F.coalesce(other, structural(head)))


def is_dng(head: Column) -> Column:
    """Whether the first directory of a TIFF has the DNGVersion tag; what lies beyond the head counts as absent."""
    h = F.hex(head)
    little = h.startswith("4949")
    byte = lambda at: F.substring(h, at * 2 + 1, F.lit(2))
    number = lambda at, n: F.conv(F.when(little, F.concat(*[byte(at + i) for i in reversed(range(n))])).otherwise(F.concat(*[byte(at + i) for i in range(n)])), 16, 10).cast("long")
    start = F.least(number(F.lit(4), 4), F.lit(HEAD)).cast("int")
    entries = F.least(F.coalesce(number(start, 2), F.lit(0)), F.lit(IFD_ENTRIES)).cast("int")
    tag = F.when(little, "12C6").otherwise("C612")
    found = F.exists(F.sequence(F.lit(1), entries), lambda i: F.substring(h, (start + 2 + (i - 1) * 12) * 2 + 1, F.lit(4)) == tag)
    return (entries > 0) & found


def sniffed(blobs: DataFrame) -> DataFrame:
    """Adds ``detected`` and ``polyglot`` to a table with a binary column ``content``, of which the head is all that is read.

    Each step is a column of its own, so that it is worked out once for all that refer to it.
    """
    magics = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(at).alias("at"), F.unhex(F.lit(x)).alias("signature")) for i, at, x in catalog.magic_rows()])
    family = F.create_map(*[F.lit(x) for pair in catalog.FAMILIES.items() for x in pair])
    head, ids, families = F.col("_head"), F.col("_ids"), F.col("_families")
    hits = F.filter(magics, lambda m: F.substring(head, m["at"] + 1, F.length(m["signature"])) == m["signature"])
    found = (
        blobs.withColumn("_head", F.substring("content", 1, HEAD))
        .withColumn("_ids", F.array_distinct(F.transform(hits, lambda m: m["id"])))
        .withColumn("_families", F.array_distinct(F.transform(ids, lambda i: F.coalesce(F.try_element_at(family, i), F.concat(F.lit("="), i)))))
        .withColumn("_text", F.when((F.size(ids) == 0) & F.is_valid_utf8(head.cast("string")), head.cast("string")))
    )
    has = lambda needle, window=HEAD: F.contains(F.substring(head, F.lit(1), F.lit(window)).cast("string"), F.lit(needle))
    zipped = (
        F.when(has("mimetypeapplication/vnd.oasis.opendocument.text"), "Odt").when(has("mimetypeapplication/vnd.oasis.opendocument.spreadsheet"), "Ods")
        .when(has("mimetypeapplication/vnd.oasis.opendocument.presentation"), "Odp").when(has("mimetypeapplication/epub+zip") | has("META-INF/container.xml"), "Epub")
        .when(has("word/"), "Docx").when(has("ppt/"), "Pptx").when(has("xl/"), "Xlsx").when(has("[Content_Types].xml"), "Docx").otherwise("Zip")
    )
    tiff = F.when(F.array_contains(ids, "Cr2"), "Cr2").when(F.array_contains(ids, "Nef"), "Nef").when(is_dng(head), "Dng").otherwise("Tiff")
    first = F.try_element_at(ids, F.lit(1))
    # Without a document type, the first of the family.
    ebml = F.when(has("webm", EBML_WINDOW), "Webm").when(has("matroska", EBML_WINDOW), "Mkv").otherwise(first)
    one = F.try_element_at(families, F.lit(1))
    detected = (
        F.when(F.size(ids) == 0, F.coalesce(structural(F.col("_text")), F.lit("Unknown")))
        .when(F.size(families) > 1, first)
        .when(one == "zip", zipped).when(one == "ebml", ebml).when(one == "tiff", tiff).otherwise(first)
    )
    return found.withColumn("detected", F.coalesce(detected, F.lit("Unknown"))).withColumn("polyglot", F.coalesce(F.size(families) > 1, F.lit(False))).drop("_head", "_ids", "_families", "_text")


def sniff(blobs: DataFrame) -> DataFrame:
    """``(path, content)`` to ``(path, detected, polyglot)``, row by row; null content is Unknown."""
    return sniffed(blobs.select("path", "content")).select("path", "detected", "polyglot")


def identified(blobs: DataFrame) -> DataFrame:
    """``(path, content)`` to ``(path, content_id, bytes, detected, polyglot)``: hash and kind in one read."""
    return sniffed(blobs.select("path", "content")).select("path", F.sha2("content", 256).alias("content_id"), F.length("content").alias("bytes"), "detected", "polyglot")


def extension_of(name: Column) -> Column:
    """After the last dot of the last path component; a leading dot opens no extension."""
    return F.lower(F.regexp_extract(name, r"[^/]\.([^./]+)$", 1))


def stem_of(name: Column) -> Column:
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.when(extension_of(base) != "", F.regexp_replace(base, r"\.[^.]+$", "")).otherwise(base)


def declared(spark: SparkSession, named: DataFrame, name: str) -> DataFrame:
    """Adds ``declared``: the format that a name's extension claims, or null."""
    claims = catalog.formats(spark).select(F.col("extension").alias("ext"), F.col("id").alias("declared"))
    return named.withColumn("ext", extension_of(F.col(name))).join(F.broadcast(claims), "ext", "left").drop("ext")


def _counts(df: DataFrame, text: str) -> DataFrame:
    return df.select(text_format(F.col(text)).alias("detected"), F.col(text)).groupBy("detected").agg(F.count("*").alias("files"), F.sum(F.length(text)).alias("chars"))


def _sql_format(x: str) -> str:
    t = f"regexp_replace({x}, '^\\s+', '')"
    line = f"regexp_replace(split_part({t}, chr(10), 1), '\\r$', '')"
    return f"""CASE WHEN {x} LIKE '<!DOCTYPE html%' OR {x} LIKE '<!doctype html%' OR {x} LIKE '<html%' THEN 'Html'
      WHEN {x} LIKE '\\%PDF-%' ESCAPE '\\' THEN 'Pdf' WHEN {x} LIKE '\\%!PS%' ESCAPE '\\' THEN 'PostScript' WHEN {x} LIKE 'GIF87a%' OR {x} LIKE 'GIF89a%' THEN 'Gif' WHEN {x} LIKE 'BM%' THEN 'Bmp'
      WHEN {t} LIKE '{{%' OR {t} LIKE '[%' THEN CASE WHEN contains({t}, '"cells"') AND contains({t}, '"cell_type"') THEN 'Ipynb' ELSE 'Json' END
      WHEN {t} LIKE '<?xml%' OR {t} LIKE '<svg%' THEN CASE WHEN contains({t}, '<svg') THEN 'Svg' ELSE 'Unknown' END
      WHEN regexp_matches({t}, '{_DXF}') THEN 'Dxf'
      WHEN {line} <> '' AND NOT regexp_matches({line}, '[\\x00-\\x1F\\x7F-\\x{{9F}}]') AND contains({line}, ',') THEN 'Csv'
      WHEN {x} <> '' AND NOT regexp_matches({x}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}]') THEN 'Txt' ELSE 'Unknown' END"""


def detect_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(table(spark, sf_dir, "pages"), "html")


def detect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(table(spark, sf_dir, "documents"), "text")


def detect_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(table(spark, sf_dir, "conversations"), "text")


def detect_event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(table(spark, sf_dir, "events"), "props")


def _counts_sql(name: str, x: str) -> str:
    return f"SELECT {_sql_format(x)} AS detected, count(*) AS files, sum(length({x}))::BIGINT AS chars FROM {name} GROUP BY 1"


def ext_claim_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose address claims a format other than the one detected."""
    named = declared(spark, table(spark, sf_dir, "pages").select("page_id", "url", text_format(F.col("html")).alias("detected")), "url")
    return named.select("page_id", "declared", "detected", F.coalesce(F.col("declared") != F.col("detected"), F.lit(False)).alias("mismatched"))


def content_id_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that occur more than once, by content id."""
    ids = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_id"))
    return ids.groupBy("content_id").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


# Heads, each put before a page by turns, that have every signature or need a second read.
_HEADS = [
    *[f"{'00' * at}{x}" for _, at, x in catalog.magic_rows()], "", "00", "7B22612220", "504B0304" + b"word/document.xml".hex().upper(), "504B0304" + b"mimetypeapplication/epub+zip".hex().upper(),
    "1A45DFA3" + b"....webm".hex().upper(), "1A45DFA3" + b"....matroska".hex().upper(), "49492A0008000000010012C601000400", "4D4D002A000000080001C61200010004", "49492A00FFFFFFFF", "49492A000800000001000001C612",
]


def sniff_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash and kind of every page behind a head by turns."""
    heads = F.array(*[F.unhex(F.lit(x)) for x in _HEADS])
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.concat(F.element_at(heads, (F.pmod("page_id", F.lit(len(_HEADS))) + 1).cast("int")), F.col("html").cast("binary")).alias("content"))
    return identified(pages)


_SNIFF_SQL = f"""
WITH m AS (SELECT * FROM {catalog.sql_values([(k, i, at, x, catalog.FAMILIES.get(i, '=' + i)) for k, (i, at, x) in enumerate(catalog.magic_rows())], 'ord, id, place, sig, family')}),
b AS (SELECT page_id AS path, {_HEADS!r}[page_id % {len(_HEADS)} + 1] || hex(encode(html)) AS h FROM pages),
hits AS (SELECT path, arg_min(id, ord) AS first, count(DISTINCT family) AS families, arg_min(family, ord) AS family, list(id) AS ids FROM b JOIN m ON substr(h, place * 2 + 1, length(sig)) = sig GROUP BY path)
SELECT b.path, sha256(unhex(h)) AS content_id, (length(h) // 2)::INTEGER AS bytes, coalesce(families > 1, false) AS polyglot,
  CASE WHEN families IS NULL THEN CASE WHEN h LIKE '00%' THEN 'Unknown' WHEN h LIKE '7B%' THEN 'Json' ELSE 'Txt' END WHEN families > 1 THEN first
    WHEN family = 'zip' THEN CASE WHEN h LIKE '504B0304' || hex('word/') || '%' THEN 'Docx' WHEN h LIKE '504B0304' || hex('mimetypeapplication/epub') || '%' THEN 'Epub' ELSE 'Zip' END
    WHEN family = 'ebml' THEN CASE WHEN contains(substr(h, 1, 2048), hex('webm')) THEN 'Webm' WHEN contains(substr(h, 1, 2048), hex('matroska')) THEN 'Mkv' ELSE first END
    WHEN family = 'tiff' THEN CASE WHEN list_contains(ids, 'Cr2') THEN 'Cr2' WHEN list_contains(ids, 'Nef') THEN 'Nef' WHEN h LIKE '49492A0008000000010012C6%' OR h LIKE '4D4D002A000000080001C612%' THEN 'Dng' ELSE 'Tiff' END
    ELSE first END AS detected
FROM b LEFT JOIN hits ON b.path = hits.path"""

_EXTENSIONS = catalog.sql_values([(r[4], r[1]) for r in catalog.format_rows()], "ext, id")

QUERIES = {"detect_pages": detect_pages, "detect_documents": detect_documents, "detect_conversations": detect_conversations, "detect_event_props": detect_event_props, "ext_claim_mismatch": ext_claim_mismatch, "content_id_dups": content_id_dups, "sniff_blobs": sniff_blobs}
ORACLES = {
    "sniff_blobs": _SNIFF_SQL,
    "detect_pages": _counts_sql("pages", "html"),
    "detect_documents": _counts_sql("documents", "text"),
    "detect_conversations": _counts_sql("conversations", "text"),
    "detect_event_props": _counts_sql("events", "props"),
    "ext_claim_mismatch": f"""
SELECT page_id, v.id AS declared, detected, coalesce(v.id <> detected, false) AS mismatched
FROM (SELECT page_id, lower(regexp_extract(url, '[^/]\\.([^./]+)$', 1)) AS ext, {_sql_format('html')} AS detected FROM pages) p LEFT JOIN {_EXTENSIONS} ON p.ext = v.ext""",
    "content_id_dups": "SELECT sha256(text) AS content_id, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
}
