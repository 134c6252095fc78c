"""Scalar text functions as column expressions, with the edge semantics that conversion needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.session import table

#: White space of Unicode, which Java's plain class is not.
SPACE = r"(?U)\s+"


def collapse_whitespace(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, SPACE, " "))


def html_escape(s: Column) -> Column:
    """Ampersands first; control characters other than tab, line feed and carriage return go."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return F.regexp_replace(s, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def xml_escape(s: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return F.regexp_replace(s, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


#: A line that Markdown would read as structure.
BLOCK_START = r"(?m)^([ \t]*)(?=[#>`~|]|[-*+] |[0-9]+[.)] )"


def markdown_escape(s: Column) -> Column:
    """A backslash before lines that would start a block, and nowhere else."""
    return F.regexp_replace(s, BLOCK_START, r"$1\\")


def indent_continuation(s: Column, width: Column) -> Column:
    return F.replace(s, F.lit("\n"), F.concat(F.lit("\n"), F.repeat(F.lit(" "), width)))


def longest_run(s: Column, char: str = "`") -> Column:
    runs = F.regexp_extract_all(s, F.lit(f"{char}+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0))


def blank_line_collapse(s: Column) -> Column:
    """Trailing blanks of lines go, at most one empty line stays, ends are trimmed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def csv_quote(s: Column) -> Column:
    return F.when(F.regexp_like(s, F.lit('[,"\r\n]')), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def pdf_literal(s: Column) -> Column:
    return F.regexp_replace(s, r"([\\()])", r"\\$1")


# What stands for characters that a western single-byte encoding lacks or that look alike in it.
_LOOK_ALIKES = {"'": "\u2018\u2019\u201b", '"': "\u201c\u201d\u201f", "-": "\u2013\u2014\u2212\u2022", " ": "\u00a0\u2007\u202f\t"}


def win_ansi(s: Column) -> Column:
    """``text, lost``: the text in characters below 256, and how many had no place there and became ``?``.

    Quotes, dashes, bullets and spaces have look-alikes, an ellipsis three dots. Control characters,
    line feeds among them, have no place.
    """
    plain = F.replace(F.translate(s, "".join(_LOOK_ALIKES.values()), "".join(k * len(v) for k, v in _LOOK_ALIKES.items())), F.lit("\u2026"), F.lit("..."))
    strange = r"[^\x20-\x7E\xA0-\xFF]"
    return F.struct(F.regexp_replace(plain, strange, "?").alias("text"), F.regexp_count(plain, F.lit(strange)).cast("long").alias("lost"))


def _byte_alphabet() -> tuple[str, str]:
    """The bytes that byte-level vocabularies write as other characters, as Latin-1, and those characters."""
    moved = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
    return "".join(map(chr, moved)), "".join(chr(256 + i) for i in range(len(moved)))


def byte_level(s: Column) -> Column:
    """Text as byte-level vocabularies write it: one printable character for each byte of its UTF-8."""
    plain, written = _byte_alphabet()
    # NUL ends no string here, but a translation cannot name it.
    return F.translate(F.replace(F.decode(s.cast("binary"), "ISO-8859-1"), F.lit("\0"), F.lit(written[0])), plain[1:], written[1:])


def byte_decoded(s: Column) -> Column:
    """Back to text: characters outside the alphabet are left out, and broken UTF-8 becomes U+FFFD."""
    plain, written = _byte_alphabet()
    known = F.regexp_replace(s, r"[^!-~\u00A1-\u00AC\u00AE-\u0143]", "")
    data = F.encode(F.replace(F.translate(known, written[1:], plain[1:]), F.lit(written[0]), F.lit("\0")), "ISO-8859-1")
    return F.make_valid_utf8(data.cast("string"))


def display_safe(s: Column) -> Column:
    """Controls, direction overrides and other invisible characters become a visible mark."""
    return F.regexp_replace(s, r"\p{C}", "�")


def folder_key(path: Column) -> Column:
    return F.lower(F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1))


def timestamp(seconds: Column) -> Column:
    """HH:MM:SS.mmm."""
    ms = F.round(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", (ms / 3600000).cast("long"), ((ms % 3600000) / 60000).cast("long"), ((ms % 60000) / 1000).cast("long"), ms % 1000)


def parse_time(s: Column) -> Column:
    """``SS``, ``MM:SS`` or ``HH:MM:SS`` with an optional fraction, to milliseconds; null if it is none of them."""
    good = F.regexp_like(s, F.lit(r"^([0-9]{1,6}:){0,2}[0-9]{1,6}([.][0-9]{1,3})?$"))
    total = F.aggregate(F.split(s, ":"), F.lit(0.0), lambda a, p: a * 60 + p.cast("double"))
    return F.when(good, F.round(total * 1000).cast("long"))


def render_template(template: Column, name: Column, ext: Column, date: Column, index: Column) -> Column:
    for token, value in (("{name}", name), ("{ext}", ext), ("{date}", date), ("{index}", index.cast("string"))):
        template = F.replace(template, F.lit(token), value)
    return template


def unknown_tokens(template: Column) -> Column:
    """Tokens that no name has; braces without a name inside are literal."""
    tokens = F.regexp_extract_all(template, F.lit(r"\{([A-Za-z0-9_]+)\}"), F.lit(1))
    return F.array_except(tokens, F.array(*[F.lit(t) for t in ("name", "ext", "date", "index")]))


RESERVED = r"(?i)^(con|prn|aux|nul|com[0-9]|lpt[0-9])([.].*)?$"


def name_problem(name: Column) -> Column:
    """Why a file name is refused, or null."""
    return (
        F.when(name == "", "empty").when(F.regexp_like(name, F.lit(r"[/\\]")), "separator").when(name.isin(".", ".."), "traversal").when(F.contains(name, F.lit(":")), "stream")
        .when(F.regexp_like(name, F.lit(r"\p{Cc}")), "control").when(F.regexp_like(name, F.lit("[‪-‮⁦-⁩]")), "direction").when(F.regexp_like(name, F.lit(RESERVED)), "reserved")
        .when(F.regexp_like(name, F.lit(r"[. ]$")), "trailing").when(F.octet_length(name) > 255, "too long")
    )


def glob_pattern(glob: str) -> str:
    """A regular expression for a pattern of ``*`` and ``?``."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c for c in glob) + "$"


def human_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024 * 1024, F.format_string("%.1f KB", F.bround(n / 1024, 1))).otherwise(F.format_string("%.1f MB", F.bround(n / 1048576, 1)))


def suffixed(names: DataFrame, name: str, order: str) -> DataFrame:
    """Adds ``output_name``: the second and later uses of a name get `` (2)`` and so on before the extension."""
    nth = F.row_number().over(W.partitionBy(F.lower(name)).orderBy(order))
    base, ext = F.regexp_replace(F.col(name), r"(?<=.)\.[^.]+$", ""), F.regexp_extract(F.col(name), r".(\.[^.]+)$", 1)
    return names.withColumn("output_name", F.when(nth == 1, F.col(name)).otherwise(F.concat(base, F.lit(" ("), nth.cast("string"), F.lit(")"), ext)))


# -- queries ---------------------------------------------------------------------------------


def ws_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(collapse_whitespace(F.col("text")).cast("binary")).alias("digest"))


def html_escape_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(html_escape(F.col("html")).cast("binary")).alias("digest"))


def md_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the documents, prefixed by turns so that all rules occur."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    starts = F.array(*[F.lit(x) for x in ("", "# ", "- ", "-3", "12. ", "1975 ", "> ", "  * ", "|", "3) ")])
    return lines.withColumn("line", F.concat(F.element_at(starts, (F.pmod("pos", F.lit(10)) + 1).cast("int")), F.col("line"))).select("doc_id", "pos", markdown_escape(F.col("line")).alias("escaped"))


def win_ansi_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the documents in a single-byte encoding, with odd characters added by turns."""
    odd = F.element_at(F.array(*map(F.lit, ("\u201cquoted\u201d \u2014 yes\u2026", "hello \u4e16\u754c", "a\u00a0b\tc\u2022"))), (F.col("doc_id") % 3 + 1).cast("int"))
    found = win_ansi(F.concat("text", odd))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("f")).select("doc_id", F.md5(F.col("f.text").cast("binary")).alias("md5"), "f.lost", F.octet_length(F.encode("f.text", "ISO-8859-1")).cast("long").alias("bytes"))


def byte_level_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in the alphabet of byte-level vocabularies and back."""
    written = byte_level(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(written).cast("long").alias("chars"), F.md5(byte_decoded(written).cast("binary")).alias("md5"), F.regexp_count(written, F.lit("\u0120")).cast("long").alias("spaces"))


def text_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through the escapes for XML, PDF literals, screens and runs of blank lines."""
    page = table(spark, sf_dir, "pages").select("page_id", F.concat("html", F.lit(" \t\n\n\n\nend (\\) \u202e\n")).alias("t"))
    digest = lambda c: F.md5(c.cast("binary"))
    return page.select("page_id", digest(xml_escape(F.col("t"))).alias("xml"), digest(pdf_literal(F.col("t"))).alias("pdf"), digest(display_safe(F.col("t"))).alias("display"), digest(blank_line_collapse(F.col("t"))).alias("blank"))


def md_escape_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the documents, whole, prefixed by turns so that all rules occur."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    starts = F.array(*[F.lit(x) for x in ("", "# ", "- ", "-3", "12. ", "1975 ", "> ", "  * ", "|", "3) ")])
    return lines.select("doc_id", "pos", markdown_escape(F.concat(F.element_at(starts, (F.pmod("pos", F.lit(10)) + 1).cast("int")), F.col("line"))).alias("escaped"))


def csv_quote_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("c_name"), F.when(F.col("c_custkey") % 3 == 0, F.lit(', "x"')).when(F.col("c_custkey") % 3 == 1, F.lit("\n")).otherwise(""))
    return table(spark, sf_dir, "customer").select("c_custkey", csv_quote(text).alias("quoted"))


def ts_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.col("l_orderkey") * 7 + F.col("l_linenumber") / F.lit(8.0)
    shown = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", timestamp(seconds).alias("shown"))
    return shown.withColumn("back_ms", parse_time(F.col("shown")))


def folder_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", folder_key(F.col("url")).alias("folder_key"))


def template_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = F.array(F.lit("{name}-{index}.{ext}"), F.lit("{date}/{name}"), F.lit("{nope}{}{name"))
    t = F.element_at(templates, (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int"))
    shown = render_template(t, F.col("o_orderpriority"), F.lower("o_orderstatus"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("rendered"), F.size(unknown_tokens(t)).alias("unknown"))


def name_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("a.txt", "a/b", "..", "CON", "nul.txt", "x.", "y ", "a:b", "", "lpt1", "console")])
    return table(spark, sf_dir, "customer").select("c_custkey", name_problem(F.element_at(names, (F.pmod("c_custkey", F.lit(11)) + 1).cast("int"))).alias("problem"))


def name_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lower("p_brand"), F.lit(".csv")).alias("name"))
    return suffixed(names, "name", "p_partkey").select("p_partkey", "output_name")


def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", human_bytes(F.col("n_chars") * 37).alias("shown"))


def backtick_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("role", F.repeat(F.lit("`"), (F.col("turn") % 5).cast("int")), "text", F.lit("``"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.greatest(longest_run(text), F.lit(2)) + 1).alias("fence"))


QUERIES = {"ws_collapse": ws_collapse, "html_escape": html_escape_pages, "md_escape": md_escape, "md_escape_lines": md_escape_lines, "csv_quote": csv_quote_names, "ts_format": ts_format, "folder_key": folder_keys, "template_render": template_render, "name_checks": name_checks, "name_suffixes": name_suffixes, "human_sizes": human_sizes, "backtick_fences": backtick_fences, "win_ansi_texts": win_ansi_texts, "byte_level_texts": byte_level_texts, "text_escapes": text_escapes}
ORACLES = {
    "ws_collapse": "SELECT doc_id, md5(trim(regexp_replace(text, '[\\s\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'))) AS digest FROM documents",
    "html_escape": "SELECT page_id, md5(regexp_replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) AS digest FROM pages",
    "md_escape": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
p AS (SELECT doc_id, pos, ['', '# ', '- ', '-3', '12. ', '1975 ', '> ', '  * ', '|', '3) '][pos % 10 + 1] || line AS line FROM l)
SELECT doc_id, pos::INTEGER AS pos, CASE WHEN regexp_matches(line, '^[ \t]*([#>`~|]|[-*+] |[0-9]+[.)] )') THEN regexp_replace(line, '^([ \t]*)', '\1\\') ELSE line END AS escaped FROM p""",
    "md_escape_lines": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
p AS (SELECT doc_id, pos, ['', '# ', '- ', '-3', '12. ', '1975 ', '> ', '  * ', '|', '3) '][pos % 10 + 1] || line AS line FROM l)
SELECT doc_id, pos::INTEGER AS pos, CASE WHEN regexp_matches(line, '^[ \t]*([#>`~|]|[-*+] |[0-9]+[.)] )') THEN regexp_replace(line, '^([ \t]*)', '\1\\') ELSE line END AS escaped FROM p""",
    "csv_quote": """
WITH t AS (SELECT c_custkey, c_name || CASE c_custkey % 3 WHEN 0 THEN ', "x"' WHEN 1 THEN chr(10) ELSE '' END AS s FROM customer)
SELECT c_custkey, CASE WHEN contains(s, ',') OR contains(s, '"') OR contains(s, chr(10)) OR contains(s, chr(13)) THEN '"' || replace(s, '"', '""') || '"' ELSE s END AS quoted FROM t""",
    "ts_format": """
WITH t AS (SELECT l_orderkey, l_linenumber, round((l_orderkey * 7 + l_linenumber / 8.0::DOUBLE) * 1000)::BIGINT AS ms FROM lineitem)
SELECT l_orderkey, l_linenumber, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms % 3600000 // 60000, ms % 60000 // 1000, ms % 1000) AS shown, ms AS back_ms FROM t""",
    "folder_key": "SELECT page_id, lower(string_split(regexp_replace(url, '/+$', ''), '/')[-1]) AS folder_key FROM pages",
    "template_render": """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority || '-' || o_orderkey || '.' || lower(o_orderstatus) WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || '/' || o_orderpriority ELSE '{nope}{}{name' END AS rendered,
  CASE o_orderkey % 3 WHEN 2 THEN 1 ELSE 0 END AS unknown FROM orders""",
    "name_checks": "SELECT c_custkey, [NULL, 'separator', 'traversal', 'reserved', 'reserved', 'trailing', 'trailing', 'stream', 'empty', 'reserved', NULL][c_custkey % 11 + 1] AS problem FROM customer",
    "name_suffixes": "SELECT p_partkey, CASE WHEN n = 1 THEN lower(p_brand) || '.csv' ELSE lower(p_brand) || ' (' || n || ').csv' END AS output_name FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_brand) ORDER BY p_partkey) AS n FROM part)",
    "human_sizes": "SELECT doc_id, CASE WHEN n_chars * 37 < 1024 THEN printf('%d B', n_chars * 37) WHEN n_chars * 37 < 1048576 THEN printf('%.1f KB', n_chars * 37 / 1024.0::DOUBLE) ELSE printf('%.1f MB', n_chars * 37 / 1048576.0::DOUBLE) END AS shown FROM documents",
    "backtick_fences": "SELECT conv_id, turn, greatest(turn % 5, 2, coalesce(list_max(list_transform(regexp_extract_all(text || '``', '`+'), lambda x: length(x))), 0))::INTEGER + 1 AS fence FROM conversations",
    "win_ansi_texts": r"""
WITH t AS (SELECT doc_id, text || [chr(8220) || 'quoted' || chr(8221) || ' ' || chr(8212) || ' yes' || chr(8230), 'hello ' || chr(19990) || chr(30028), 'a' || chr(160) || 'b' || chr(9) || 'c' || chr(8226)][doc_id % 3 + 1] AS t FROM documents),
p AS (SELECT doc_id, replace(translate(t, chr(8216) || chr(8217) || chr(8219) || chr(8220) || chr(8221) || chr(8223) || chr(8211) || chr(8212) || chr(8722) || chr(8226) || chr(160) || chr(8199) || chr(8239) || chr(9), repeat(chr(39), 3) || repeat(chr(34), 3) || '----    '), chr(8230), '...') AS p FROM t)
SELECT doc_id, md5(regexp_replace(p, '[^\x20-\x7E\x{A0}-\x{FF}]', '?', 'g')) AS md5, len(regexp_extract_all(p, '[^\x20-\x7E\x{A0}-\x{FF}]')) AS lost, length(p) AS bytes FROM p""",
    "byte_level_texts": "SELECT doc_id, strlen(text) AS chars, md5(text) AS md5, length(text) - length(replace(text, ' ', '')) AS spaces FROM documents",
    "text_escapes": r"""
WITH p AS (SELECT page_id, html || ' ' || chr(9) || repeat(chr(10), 4) || 'end (\) ' || chr(8238) || chr(10) AS t FROM pages)
SELECT page_id, md5(regexp_replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS xml,
  md5(replace(replace(replace(t, '\', '\\'), '(', '\('), ')', '\)')) AS pdf, md5(regexp_replace(t, '[\p{Cc}\p{Cf}\p{Co}]', chr(65533), 'g')) AS display,
  md5(trim(regexp_replace(regexp_replace(t, '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10))) AS blank FROM p""",
}
