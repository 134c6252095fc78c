"""Office files: zipped XML to paragraphs and cells, and paragraphs and cells to zipped XML.

Reading and writing one file is sequential; each runs in an Arrow-fed generator, file by file. A
file that is not what it should be gives no rows.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.batches import slices
from weftline.functions import markup
from weftline.operators.document import PARAGRAPHS, _pages, html_paragraphs
from weftline.operators.tabular import sheet_csv
from weftline.scratch import written
from weftline.session import table

CELLS = "doc long, sheet int, sheet_name string, row int, col int, type string, str string, num double, bool boolean"
MAX_ROWS = 1_048_576
CODE_STYLES, QUOTE_STYLES = ("Preformatted", "HTMLPreformatted"), ("Quote", "IntenseQuote")


def _tag(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2]


def _attr(node: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == name), None)


def _text(node: ElementTree.Element) -> str:
    """Text with tabs, breaks and repeated spaces as their elements say."""
    out = [node.text or ""]
    for child in node:
        kind = _tag(child)
        out.append("\t" if kind == "tab" else "\n" if kind in ("br", "line-break") else " " * int(_attr(child, "c") or 1) if kind == "s" else _text(child))
        out.append(child.tail or "")
    return "".join(out)


def _numbering(z: zipfile.ZipFile) -> dict[tuple[str, int], int]:
    """Where the numbered levels of a docx file's lists begin, by list and level; other lists are bullets."""
    if "word/numbering.xml" not in z.namelist():
        return {}
    value = lambda node, kind, default: next((_attr(n, "val") or default for n in node if _tag(n) == kind), default)
    root = ElementTree.fromstring(z.read("word/numbering.xml"))
    kinds = {_attr(a, "abstractNumId"): {int(_attr(n, "ilvl") or 0): int(value(n, "start", "1")) for n in a if _tag(n) == "lvl" and value(n, "numFmt", "decimal") not in ("bullet", "none")} for a in root if _tag(a) == "abstractNum"}
    out = {}
    for num in (n for n in root if _tag(n) == "num"):
        levels = kinds.get(value(num, "abstractNumId", ""), {})
        begins = {int(_attr(n, "ilvl") or 0): int(value(n, "startOverride", "1")) for n in num if _tag(n) == "lvlOverride"}
        # A definition has nine levels at most; deeper ones are like its last.
        out |= {(_attr(num, "numId") or "", level): begin for level, begin in (levels | {k: v for k, v in begins.items() if min(k, 8) in levels}).items()}
    return out


def docx_paragraphs(z: zipfile.ZipFile) -> list[markup.Paragraph]:
    out = []
    begins = _numbering(z)
    counts: dict[str, dict[int, int]] = {}
    for p in ElementTree.fromstring(z.read("word/document.xml")).iter():
        if _tag(p) != "p":
            continue
        text = "".join(_text(r) for r in p.iter() if _tag(r) == "r")
        style = next((_attr(s, "val") or "" for s in p.iter() if _tag(s) == "pStyle"), "")
        listed = next((s for s in p.iter() if _tag(s) == "numPr"), None)
        heading = re.fullmatch(r"[Hh]eading ?([1-6])", style)
        if style not in CODE_STYLES:
            text = " ".join(text.split())
        if not text:
            continue
        if heading:
            out.append((text, "heading", int(heading[1]), 0))
        elif listed is not None:
            at = {_tag(n): _attr(n, "val") for n in listed}
            of, level = at.get("numId") or "", int(at.get("ilvl") or 0)
            # Deeper levels of a list begin anew.
            counts[of] = {k: n for k, n in counts.get(of, {}).items() if k <= level}
            if (begin := begins.get((of, level))) is not None:
                counts[of][level] = counts[of].get(level, begin - 1) + 1
            out.append((text, "bullet", level, 0) if begin is None else (text, "ordered", level, counts[of][level]))
        else:
            out.append((text, "code" if style in CODE_STYLES else "quote" if style in QUOTE_STYLES else "body", 0, 0))
    return out


def odt_paragraphs(z: zipfile.ZipFile) -> list[markup.Paragraph]:
    out: list[markup.Paragraph] = []

    def walk(node: ElementTree.Element, depth: int) -> None:
        kind = _tag(node)
        if kind in ("h", "p"):
            text = " ".join(_text(node).split())
            if text:
                level = int(_attr(node, "outline-level") or 1)
                out.append((text, "heading", min(6, level), 0) if kind == "h" else (text, "bullet", depth - 1, 0) if depth else (text, "body", 0, 0))
            return
        for child in node:
            walk(child, depth + (kind == "list"))

    body = next((n for n in ElementTree.fromstring(z.read("content.xml")).iter() if _tag(n) == "text"), None)
    if body is not None:
        walk(body, 0)
    return out


def _targets(z: zipfile.ZipFile, rels: str, base: str) -> dict[str, str]:
    return {r.get("Id", ""): posixpath.normpath(posixpath.join(base, r.get("Target", ""))) for r in ElementTree.fromstring(z.read(rels))}


def pptx_paragraphs(z: zipfile.ZipFile) -> list[markup.Paragraph]:
    """Slides in the order of the presentation; without one, by the number in their names."""
    try:
        targets = _targets(z, "ppt/_rels/presentation.xml.rels", "ppt")
        order = [targets[i] for n in ElementTree.fromstring(z.read("ppt/presentation.xml")).iter() if _tag(n) == "sldId" for i in [n.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id", "")] if i in targets]
    except (KeyError, ElementTree.ParseError):
        order = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    out = []
    for slide in order:
        for shape in ElementTree.fromstring(z.read(slide)).iter():
            if _tag(shape) != "sp":
                continue
            title = any(_tag(n) == "ph" and n.get("type") in ("title", "ctrTitle") for n in shape.iter())
            for p in (n for n in shape.iter() if _tag(n) == "p"):
                text = " ".join("".join(t.text or "" for t in p.iter() if _tag(t) == "t").split())
                if text:
                    depth = next((int(n.get("lvl", 0)) for n in p if _tag(n) == "pPr"), 0)
                    out.append((text, "heading", 2, 0) if title else (text, "bullet", depth, 0))
    return out


def epub_paragraphs(z: zipfile.ZipFile) -> list[markup.Paragraph]:
    """Chapters in the order of the spine."""
    if "META-INF/encryption.xml" in z.namelist():
        return []
    package = next(n.get("full-path", "") for n in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if _tag(n) == "rootfile")
    root = ElementTree.fromstring(z.read(package))
    manifest = {n.get("id"): n.get("href", "") for n in root.iter() if _tag(n) == "item"}
    out = []
    for ref in (n.get("idref") for n in root.iter() if _tag(n) == "itemref"):
        part = posixpath.normpath(posixpath.join(posixpath.dirname(package), manifest.get(ref, "")))
        if not part.startswith("..") and part in z.namelist():
            out += markup.html_paragraphs(z.read(part).decode("utf-8", "replace"))
    return out


def office_paragraphs(data: bytes) -> list[markup.Paragraph]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = set(z.namelist())
            for member, read in (("word/document.xml", docx_paragraphs), ("META-INF/container.xml", epub_paragraphs), ("ppt/presentation.xml", pptx_paragraphs), ("content.xml", odt_paragraphs)):
                if member in names:
                    return read(z)
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration, ValueError):
        pass
    return []


Cell = tuple[int, str, int, int, str, str | None, float | None, bool | None]


def xlsx_cells(z: zipfile.ZipFile) -> list[Cell]:
    shared = [_text(n) for n in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _tag(n) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
    targets = _targets(z, "xl/_rels/workbook.xml.rels", "xl")
    out: list[Cell] = []
    sheets = [n for n in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _tag(n) == "sheet"]
    for index, sheet in enumerate(sheets):
        part = targets[sheet.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id", "")]
        for c in (n for n in ElementTree.fromstring(z.read(part)).iter() if _tag(n) == "c"):
            letters, digits = re.fullmatch(r"([A-Z]+)([0-9]+)", c.get("r", "A1")).groups()
            col = 0
            for x in letters:
                col = col * 26 + ord(x) - 64
            if int(digits) > MAX_ROWS:
                continue
            value = next((v.text or "" for v in c if _tag(v) == "v"), None)
            kind = c.get("t", "n")
            if kind == "inlineStr":
                value = "".join(_text(v) for v in c if _tag(v) == "is")
            at = (index, sheet.get("name", ""), int(digits) - 1, col - 1)
            if value is None:
                out.append((*at, "empty", None, None, None))
            elif kind == "b":
                out.append((*at, "bool", None, None, value == "1"))
            elif kind == "e":
                out.append((*at, "error", value, None, None))
            elif kind == "n":
                out.append((*at, "number", None, float(value), None))
            else:
                out.append((*at, "text", shared[int(value)] if kind == "s" else value, None, None))
    return out


def ods_cells(z: zipfile.ZipFile) -> list[Cell]:
    out: list[Cell] = []
    tables = [n for n in ElementTree.fromstring(z.read("content.xml")).iter() if _tag(n) == "table"]
    for index, sheet in enumerate(tables):
        row = 0
        for r in (n for n in sheet.iter() if _tag(n) == "table-row"):
            repeat, col = int(_attr(r, "number-rows-repeated") or 1), 0
            cells = []
            for c in r:
                if _tag(c) not in ("table-cell", "covered-table-cell"):
                    continue
                times, kind = int(_attr(c, "number-columns-repeated") or 1), _attr(c, "value-type")
                text = "\n".join(_text(p) for p in c if _tag(p) == "p")
                if kind:
                    cells += [(col + i, kind, text, _attr(c, "value"), _attr(c, "boolean-value")) for i in range(min(times, 16_384))]
                col += times
            for k in range(min(repeat, MAX_ROWS - row) if cells else 0):
                for place, kind, text, value, flag in cells:
                    at = (index, _attr(sheet, "name") or "", row + k, place)
                    out.append((*at, "bool", None, None, flag == "true") if kind == "boolean" else (*at, "number", None, float(value), None) if value is not None else (*at, "text", text, None, None))
            row += repeat
    return out


def workbook_cells(data: bytes) -> list[Cell]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return ods_cells(z) if "content.xml" in z.namelist() else xlsx_cells(z)
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, AttributeError, IndexError):
        return []


def _reading(read: Callable[[bytes], list[tuple]], schema: pa.Schema, numbered: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc, data in zip(batch["doc"].to_pylist(), batch["content"].to_pylist(), strict=True):
                found = read(data or b"")
                rows += [(doc, i, *x) for i, x in enumerate(found)] if numbered else [(doc, *x) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return run


_PARAGRAPH_SCHEMA = pa.schema([("doc", pa.int64()), ("pos", pa.int32()), ("text", pa.string()), ("style", pa.string()), ("level", pa.int32()), ("number", pa.int32())])
_CELL_SCHEMA = pa.schema([("doc", pa.int64()), ("sheet", pa.int32()), ("sheet_name", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("type", pa.string()), ("str", pa.string()), ("num", pa.float64()), ("bool", pa.bool_())])


def read_documents(files: DataFrame) -> DataFrame:
    """``(doc, content)`` of docx, odt, pptx, odp and epub files to paragraphs."""
    return files.select("doc", "content").mapInArrow(_reading(office_paragraphs, _PARAGRAPH_SCHEMA, True), PARAGRAPHS)


def read_workbooks(files: DataFrame) -> DataFrame:
    """``(doc, content)`` of xlsx and ods files to typed cells; dates stay numbers."""
    return files.select("doc", "content").mapInArrow(_reading(workbook_cells, _CELL_SCHEMA, False), CELLS)


# -- writing ---------------------------------------------------------------------------------

_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _xml(text: str) -> str:
    return escape(_CONTROL.sub("", text))


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
    return out.getvalue()


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


_DOCX_STYLES = "".join(f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{name}"/>{how}</w:style>' for i, name, how in (
    *((f"Heading{n}", f"heading {n}", f'<w:pPr><w:keepNext/><w:outlineLvl w:val="{n - 1}"/></w:pPr><w:rPr><w:b/></w:rPr>') for n in range(1, 7)),
    ("Quote", "Quote", "<w:rPr><w:i/></w:rPr>"), ("Preformatted", "HTML Preformatted", '<w:rPr><w:rFonts w:ascii="Courier New" w:hAnsi="Courier New"/></w:rPr>'),
))
_DOCX_LISTS = "".join(f'<w:abstractNum w:abstractNumId="{i}">' + "".join(f'<w:lvl w:ilvl="{n}"><w:start w:val="1"/><w:numFmt w:val="{kind}"/><w:lvlText w:val="{f"%{n + 1}." if i else "•"}"/></w:lvl>' for n in range(9)) + "</w:abstractNum>" for i, kind in enumerate(("bullet", "decimal")))


def _run(text: str) -> str:
    """A run's text; line breaks and tabs are elements, as a reader may take them for spaces."""
    parts = re.split(r"([\n\t])", text)
    piece = lambda x: "<w:br/>" if x == "\n" else "<w:tab/>" if x == "\t" else f'<w:t xml:space="preserve">{_xml(x)}</w:t>'.replace("\r", "&#13;")
    return f'<w:r>{"".join(piece(x) for x in parts if x)}</w:r>'


def docx_bytes(paragraphs: list[dict]) -> bytes:
    """Bullets are list 1; numbers that do not go on from those before on their level begin a list of their own."""
    body, lists = [], []
    going: dict[int, tuple[int, int]] = {}  # by level: list and next number
    for p in paragraphs:
        kind, level = p["style"], p["level"]
        going = {k: v for k, v in going.items() if k <= level or kind not in ("bullet", "ordered")}
        listed = 1
        if kind == "ordered":
            if going.get(level, (0, None))[1] != p["number"]:
                going[level] = (len(lists) + 2, p["number"])
                lists.append(f'<w:num w:numId="{len(lists) + 2}"><w:abstractNumId w:val="1"/><w:lvlOverride w:ilvl="{level}"><w:startOverride w:val="{p["number"]}"/></w:lvlOverride></w:num>')
            listed = going[level][0]
            going[level] = (listed, p["number"] + 1)
        named = {"heading": f"Heading{level}", "code": "Preformatted", "quote": "Quote"}.get(kind)
        style = f'<w:pPr><w:pStyle w:val="{named}"/></w:pPr>' if named else f'<w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{listed}"/></w:numPr></w:pPr>' if kind in ("bullet", "ordered") else ""
        body.append(f"<w:p>{style}{_run(p['text'])}</w:p>")
    part = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    return _zipped({
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>' + "".join(f'<Override PartName="/word/{name}.xml" ContentType="{part}.{kind}+xml"/>' for name, kind in (("document", "document.main"), ("styles", "styles"), ("numbering", "numbering"))) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{_R}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/_rels/document.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{_R}/{x}" Target="{x}.xml"/>' for i, x in enumerate(("styles", "numbering"))) + "</Relationships>",
        "word/document.xml": f"<w:document {_W}><w:body>{''.join(body)}</w:body></w:document>",
        "word/styles.xml": f"<w:styles {_W}>{_DOCX_STYLES}</w:styles>",
        "word/numbering.xml": f'<w:numbering {_W}>{_DOCX_LISTS}<w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num>{"".join(lists)}</w:numbering>',
    })


def odt_bytes(paragraphs: list[dict]) -> bytes:
    body = []
    for p in paragraphs:
        text = _xml(p["text"])
        body.append(f'<text:h text:outline-level="{p["level"]}">{text}</text:h>' if p["style"] == "heading" else f"<text:list><text:list-item><text:p>{text}</text:p></text:list-item></text:list>" if p["style"] in ("bullet", "ordered") else f"<text:p>{text}</text:p>")
    office = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    return _zipped({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": f"<office:document-content {office}><office:body><office:text>{''.join(body)}</office:text></office:body></office:document-content>"})


def xlsx_bytes(cells: list[dict]) -> bytes:
    def name(col: int) -> str:
        out, col = "", col + 1
        while col:
            col, rest = divmod(col - 1, 26)
            out = chr(65 + rest) + out
        return out

    sheets: dict[int, dict[int, list[str]]] = {}
    titles: dict[int, str] = {}
    for c in cells:
        titles[c["sheet"]] = c["sheet_name"] or f"Sheet{c['sheet'] + 1}"
        at = f'r="{name(c["col"])}{c["row"] + 1}"'
        cell = f'<c {at}><v>{c["num"]!r}</v></c>' if c["type"] == "number" else f'<c {at} t="b"><v>{int(c["bool"])}</v></c>' if c["type"] == "bool" else f'<c {at} t="inlineStr"><is><t xml:space="preserve">{_xml(c["str"] or "")}</t></is></c>'
        sheets.setdefault(c["sheet"], {}).setdefault(c["row"], []).append(cell)
    numbers = sorted(sheets)
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/></Types>',
        "xl/workbook.xml": f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{_R}"><sheets>' + "".join(f'<sheet name="{_xml(titles[n])}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(numbers)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{_R}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(numbers))) + "</Relationships>",
    }
    for i, n in enumerate(numbers):
        rows = "".join(f'<row r="{r + 1}">{"".join(cs)}</row>' for r, cs in sorted(sheets[n].items()))
        parts[f"xl/worksheets/sheet{i + 1}.xml"] = f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{rows}</sheetData></worksheet>'
    return _zipped(parts)


def _writing(write: Callable[[list[dict]], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array([write(x) for x in batch["rows"].to_pylist()], pa.binary())], names=["doc", "content"])

    return run


def write_documents(paragraphs: DataFrame, kind: str) -> DataFrame:
    """``doc, content``: docx or odt files."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "text", "style", "level", "number"))).alias("rows")
    return paragraphs.groupBy("doc").agg(rows).mapInArrow(_writing(docx_bytes if kind == "docx" else odt_bytes), "doc long, content binary")


def write_workbooks(cells: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("sheet", "row", "col", "sheet_name", "type", "str", "num", "bool"))).alias("rows")
    return cells.groupBy("doc").agg(rows).mapInArrow(_writing(xlsx_bytes), "doc long, content binary")


STYLES = ("body", "heading", "bullet", "ordered", "code", "quote")


def docx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to docx files and back: paragraphs by style, before and after, and how many came back as they were.

    ``same``: with their place, text, style, level and number. Pages without paragraphs have a row, too.
    """
    pages = _pages(spark, sf_dir)
    before = written(html_paragraphs(pages), "paragraphs")
    after = read_documents(write_documents(before, "docx"))
    facts = lambda rows, b, a: rows.select("doc", "pos", "style", "level", "number", F.length("text").alias("chars"), F.sha2("text", 256).alias("digest"), F.lit(b).alias("b"), F.lit(a).alias("a"))
    none = pages.select("doc", *[F.lit(None).cast(t).alias(n) for n, t in (("pos", "int"), ("style", "string"), ("level", "int"), ("number", "int"), ("chars", "int"), ("digest", "string"))], F.lit(0).alias("b"), F.lit(0).alias("a"))
    both = facts(before, 1, 0).unionByName(facts(after, 0, 1)).unionByName(none).repartition("doc")
    kinds = both.groupBy("doc", "pos", "style", "level", "number", "chars", "digest").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    of = lambda n, style: F.sum(F.when(F.col("style") == style, F.col(n)).otherwise(0))
    chars = lambda n: F.coalesce(F.sum(F.col(n) * F.col("chars")), F.lit(0))
    return kinds.groupBy("doc").agg(
        F.sum("a").alias("paragraphs"), of("a", "heading").alias("headings"), chars("a").alias("chars"), F.sum("b").alias("paragraphs_before"), chars("b").alias("chars_before"), F.sum(F.least("a", "b")).alias("same"),
        *[of(n, style).alias(f"{style}_{when}") for style in STYLES for n, when in (("b", "before"), ("a", "after"))],
    )


def odt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = read_documents(write_documents(html_paragraphs(_pages(spark, sf_dir)), "odt"))
    return after.groupBy("doc").agg(F.count("*").alias("paragraphs"), F.count_if(F.col("style") == "heading").alias("headings"), F.sum(F.length("text")).alias("chars"))


def xlsx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as workbooks of a nation, a thousand ids each, written and read back."""
    s = table(spark, sf_dir, "supplier")
    cell = lambda col, kind, text, num, flag: F.struct(F.lit(col).alias("col"), F.lit(kind).alias("type"), text.cast("string").alias("str"), num.cast("double").alias("num"), flag.cast("boolean").alias("bool"))
    none = F.lit(None)
    part = F.col("s_nationkey").cast("long") * (1 << 40) + F.floor(F.col("s_suppkey") / 1000)
    cells = s.select(part.alias("doc"), F.lit(0).alias("sheet"), F.lit("suppliers").alias("sheet_name"), F.col("s_suppkey").cast("int").alias("row"), F.explode(F.array(cell(0, "text", F.col("s_name"), none, none), cell(1, "number", none, F.col("s_acctbal"), none), cell(28, "bool", none, none, F.col("s_acctbal") > 0))).alias("c"))
    return read_workbooks(write_workbooks(cells.select("doc", "sheet", "sheet_name", "row", "c.*"))).select(F.expr("doc div (1L << 40)").alias("doc"), "row", "col", "type", "str", "num", "bool")


def convert_workbooks(files: DataFrame) -> DataFrame:
    """``(doc, content)`` of xlsx or ods files to xlsx files: values only, no formulas or formats."""
    return write_workbooks(read_workbooks(files))


def workbook_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as workbooks of a hundred ids with a gap per ten, converted to a workbook and to CSV."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 10 <> 3")
    none = F.lit(None)
    cell = lambda col, kind, text, num: F.struct(F.lit(col).alias("col"), F.lit(kind).alias("type"), text.cast("string").alias("str"), num.cast("double").alias("num"), none.cast("boolean").alias("bool"))
    at = [F.floor(F.col("s_suppkey") / 100).alias("doc"), F.lit(0).alias("sheet"), F.lit("suppliers").alias("sheet_name"), (F.col("s_suppkey") % 100).cast("int").alias("row")]
    cells = s.select(*at, F.explode(F.array(cell(1, "text", F.concat("s_name", F.lit(', "x"')), none), cell(3, "number", none, F.col("s_suppkey")))).alias("c")).select("doc", "sheet", "sheet_name", "row", "c.*")
    return sheet_csv(read_workbooks(convert_workbooks(write_workbooks(cells))))


QUERIES = {"docx_roundtrip": docx_roundtrip, "odt_roundtrip": odt_roundtrip, "xlsx_roundtrip": xlsx_roundtrip, "workbook_csv": workbook_csv}
ORACLES = {
    "workbook_csv": """
WITH s AS (SELECT s_suppkey // 100 AS doc, (s_suppkey % 100) AS r, s_name, s_suppkey FROM supplier WHERE s_suppkey % 10 <> 3), g AS (SELECT doc, min(r) AS lo, unnest(range(min(r), max(r) + 1)) AS r FROM s GROUP BY doc)
SELECT g.doc::BIGINT AS doc, (g.r - lo)::INTEGER AS "row", CASE WHEN s_name IS NULL THEN ',,' ELSE '"' || s_name || ', ""x""' || '",,' || s_suppkey END AS line FROM g LEFT JOIN s ON s.doc = g.doc AND s.r = g.r""",
    "xlsx_roundtrip": """
SELECT s_nationkey::BIGINT AS doc, s_suppkey::INTEGER AS "row", 0 AS col, 'text' AS type, s_name AS str, NULL::DOUBLE AS num, NULL::BOOLEAN AS bool FROM supplier UNION ALL
SELECT s_nationkey, s_suppkey, 1, 'number', NULL, s_acctbal, NULL FROM supplier UNION ALL SELECT s_nationkey, s_suppkey, 28, 'bool', NULL, NULL, s_acctbal > 0 FROM supplier""",
}
