import json
import re
from html.parser import HTMLParser

import pytest

from weftline.functions import markup
from weftline.functions.markup import decoded, html_paragraphs, markdown_paragraphs, notebook_paragraphs
from weftline.operators import document


@pytest.mark.parametrize(
    "source, wanted",
    [
        ("<p>a <em>b</em> c</p>", [("a b c", "body", 0, 0)]),
        ("<h2>Title</h2>text", [("Title", "heading", 2, 0), ("text", "body", 0, 0)]),
        ("<ul><li>a<ol><li>b<li>c</ol>d</ul>", [("a", "bullet", 0, 0), ("b", "ordered", 1, 1), ("c", "ordered", 1, 2), ("d", "body", 0, 0)]),
        ("<script>if (a < b) '</p>'</script>x", [("x", "body", 0, 0)]),
        ("<head><title>t</title></head><body>x</body>", [("x", "body", 0, 0)]),
        ("<pre>a\n  b\n</pre>", [("a\n  b", "code", 0, 0)]),
        ("<blockquote>q</blockquote>", [("q", "quote", 0, 0)]),
        ("<tr><td>a</td><td>b</td></tr>", [("a b", "body", 0, 0)]),
        ('<a title="x > y">k</a>', [("k", "body", 0, 0)]),
        ("a &lt; b &amp;lt; &foo; &#65;&#x42;", [("a < b &lt; &foo; AB", "body", 0, 0)]),
        ("a < b <!-- gone --> c", [("a < b c", "body", 0, 0)]),
        ("a <unfinished attr='", [("a", "body", 0, 0)]),
        ("a<!-- never closed", [("a", "body", 0, 0)]),
        ("</ul></pre></blockquote>x", [("x", "body", 0, 0)]),
        ("", []),
    ],
)
def test_html(source, wanted):
    assert html_paragraphs(source) == wanted


def test_html_is_linear():
    for source in ("<" * 200_000, "<a '" * 50_000, "&" * 200_000, "<!--" * 50_000, "<script>" + "</" * 100_000):
        html_paragraphs(source)


def test_references():
    assert decoded("&amp;amp; &nope; & &#xD800; &#99999999;") == "&amp; &nope; & &#xD800; &#99999999;"


@pytest.mark.parametrize(
    "source, wanted",
    [
        ("# A #\n\ntext *em* `c*d`", [("A", "heading", 1, 0), ("text em c*d", "body", 0, 0)]),
        ("Title\n===\nb", [("Title", "heading", 1, 0), ("b", "body", 0, 0)]),
        ("- a\n  - b\n- c", [("a", "bullet", 0, 0), ("b", "bullet", 1, 0), ("c", "bullet", 0, 0)]),
        ("3. x\n4. y", [("x", "ordered", 0, 3), ("y", "ordered", 0, 4)]),
        ("```py\na\n\n b\n```\nz", [("a\n\n b", "code", 0, 0), ("z", "body", 0, 0)]),
        ("> q\n> r\n\nb", [("q r", "quote", 0, 0), ("b", "body", 0, 0)]),
        ("a\nb\n\n---\n\n[t](u) ~~s~~", [("a b", "body", 0, 0), ("t s", "body", 0, 0)]),
        ("<div>\n\nx <b>y</b>", [("x y", "body", 0, 0)]),
    ],
)
def test_markdown(source, wanted):
    assert markdown_paragraphs(source) == wanted


def test_notebook():
    book = {"nbformat": 4, "cells": [{"cell_type": "markdown", "source": ["# T\n", "x"]}, {"cell_type": "code", "source": "a=1", "outputs": [{"output_type": "stream", "text": ["1\n"]}, {"output_type": "display_data", "data": {"image/png": "", "text/plain": "f"}}, {"output_type": "error", "ename": "E", "evalue": "v"}]}]}
    assert [p[:2] for p in notebook_paragraphs(json.dumps(book))] == [("T", "heading"), ("x", "body"), ("a=1", "code"), ("1", "code"), ("[figure]", "body"), ("E: v", "code")]
    assert notebook_paragraphs("{not json") == notebook_paragraphs("[]") == []


def test_writers(spark):
    rows = [(1, 0, "A & B", "heading", 1, 0), (1, 1, "x", "bullet", 0, 0), (1, 2, "y", "ordered", 1, 3), (1, 3, "z", "ordered", 0, 1), (1, 4, "# not", "body", 0, 0), (1, 5, "a```b", "code", 0, 0), (1, 6, "q\nr", "quote", 0, 0)]
    df = spark.createDataFrame(rows, document.PARAGRAPHS)
    assert document.to_markdown(df).first()["markdown"] == "# A & B\n\n- x\n\n  3. y\n\n1. z\n\n\\# not\n\n````\na```b\n````\n\n> q\n> r\n"
    assert document.to_html(df).first()["body"] == (
        "<h1>A &amp; B</h1>\n<ul>\n<li>x</li>\n<ol>\n<li>y</li>\n</ol>\n</ul>\n<ol>\n<li>z</li>\n</ol>\n<p># not</p>\n<pre><code>a```b</code></pre>\n<blockquote><p>q\nr</p></blockquote>\n"
    )
    assert document.to_text(df).first()["text"].endswith("q\nr\n")


def _line(text, y, size=10.0, left=0.0, page=1):
    return [(1, page, c, left + i * size * 0.5, left + (i + 1) * size * 0.5, float(y), y + size, size) for i, c in enumerate(text)]


def test_glyph_layout(spark):
    glyphs = _line("A title", 700, 20.0) + _line("the first line of a para-", 670) + _line("graph goes on to the end.", 658) + _line("short", 646) + _line("next one here that is long", 634)
    df = spark.createDataFrame(glyphs, "doc long, page int, ch string, left double, right double, bottom double, top double, size double")
    lines = document.glyph_lines(df)
    assert [r["text"] for r in lines.orderBy("line").collect()][0] == "A title"
    found = document.line_paragraphs(lines).orderBy("pos").collect()
    assert [(r["text"], r["level"]) for r in found] == [("A title", 1), ("the first line of a paragraph goes on to the end. short", 0), ("next one here that is long", 0)]


def test_a_canary_survives_every_document_format(spark):
    from weftline.sources import office

    pages = spark.createDataFrame([(1, "<h1>Top</h1><p>the canary sings</p><ul><li>one</li></ul>")], "doc long, source string")
    paragraphs = document.html_paragraphs(pages)
    for kind in ("docx", "odt"):
        back = office.read_documents(office.write_documents(paragraphs, kind)).orderBy("pos").collect()
        assert [(r["text"], r["style"]) for r in back] == [("Top", "heading"), ("the canary sings", "body"), ("one", "bullet")]
    assert office.read_documents(spark.createDataFrame([(1, bytearray(b"junk"))], "doc long, content binary")).count() == 0


LISTS = "<h2>T</h2><blockquote>q &amp; q</blockquote><pre>\n if x:\n\ty = '  &lt;'\n\n</pre><ol><li>a</li><li>b<ul><li>c<ul><li>d</li></ul></li></ul></li><li>e<ol><li>f</li></ol></li></ol><p>between</p><ol><li>g</li><li>h</li></ol><h6>U</h6>" + "<ul>" * 12 + "<li>deep" + "</ul>" * 12 + "<ol>" * 12 + "<li>deep<li>er"


def test_docx_keeps_every_style_level_and_number(spark):
    """Code with its spaces and lines, quotes, lists with depths and numbers that go on or begin anew."""
    from weftline.sources import office

    wanted = html_paragraphs(LISTS)
    assert {p[1] for p in wanted} == set(office.STYLES) and ("a", "ordered", 0, 1) in wanted
    assert office.office_paragraphs(office.docx_bytes([dict(zip(("text", "style", "level", "number"), p, strict=True)) for p in wanted])) == wanted
    odd = [{"text": x, "style": "ordered", "level": l, "number": n} for x, l, n in (("a", 0, 7), ("b", 1, 1), ("c", 0, 8), ("d", 1, 2), ("e", 1, 3), ("f", 0, 0), ("g", 0, 5))] + [{"text": "x\r\ny \t", "style": "code", "level": 0, "number": 0}]
    assert office.office_paragraphs(office.docx_bytes(odd)) == [(p["text"], p["style"], p["level"], p["number"]) for p in odd]


def test_docx_roundtrip_tells_before_from_after(spark, tmp_path):
    """Each page has a row: what went in, what came back, and how much of it as it was."""
    from weftline.sources import office

    rows = [(1, "u", LISTS), (2, "u", ""), (3, "u", None), (4, "u", "<p>a\x01b</p><p>c</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r["doc"]: r.asDict() for r in office.docx_roundtrip(spark, str(tmp_path)).collect()}
    n = len(html_paragraphs(LISTS))
    assert (found[1]["paragraphs"], found[1]["paragraphs_before"], found[1]["same"], found[1]["headings"]) == (n, n, n, 2) and found[1]["chars"] == found[1]["chars_before"]
    assert all(found[1][f"{s}_before"] == found[1][f"{s}_after"] == sum(p[1] == s for p in html_paragraphs(LISTS)) for s in office.STYLES)
    assert all(v == 0 for d in (2, 3) for k, v in found[d].items() if k != "doc")
    assert [found[4][k] for k in ("paragraphs", "paragraphs_before", "same", "chars", "chars_before")] == [2, 2, 1, 3, 4]  # XML has no such character


class Plainly(HTMLParser):
    """Another reading of a page, by the standard library's parser and a stack of open tags."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out, self.text, self.stack, self.item, self.skip = [], "", [], None, 0

    def cut(self):
        tags = [t for t, _ in self.stack]
        headings = [t for t in tags if t[0] == "h"]
        style = ("code", 0, 0) if "pre" in tags else ("heading", int(headings[-1][1]), 0) if headings else self.item or (("quote" if "blockquote" in tags else "body"), 0, 0)
        text = self.text.strip("\n") if style[0] == "code" else " ".join(self.text.split())
        self.out += [(text, *style)] if text else []
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag in markup.OPAQUE:
            self.cut()
            self.skip += 1
        elif tag in ("td", "th"):
            self.text += " "
        elif re.fullmatch("h[1-6]", tag) or tag in ("ul", "ol", "li", "pre", "blockquote") or tag in markup.BLOCK:
            self.cut()
            if tag[0] == "h" and tag[1:].isdigit():
                self.stack = [x for x in self.stack if x[0][0] != "h"]
            if tag == "li":
                lists = [x for x in self.stack if x[0] in ("ul", "ol")]
                self.item = ("bullet", max(0, len(lists) - 1), 0)
                if lists and lists[-1][0] == "ol":
                    lists[-1][1] += 1
                    self.item = ("ordered", len(lists) - 1, lists[-1][1])
            elif tag not in markup.BLOCK:
                self.stack.append([tag, 0])

    def handle_endtag(self, tag):
        if tag in markup.OPAQUE:
            self.skip = max(0, self.skip - 1)
        elif re.fullmatch("h[1-6]", tag) or tag in ("ul", "ol", "li", "pre", "blockquote", "body", "html") or tag in markup.BLOCK:
            self.cut()
            if tag[0] == "h" and tag[1:].isdigit():
                self.stack = [x for x in self.stack if not re.fullmatch("h[1-6]", x[0])]
            else:
                found = [i for i, x in enumerate(self.stack) if x[0] == tag or (tag in ("ul", "ol") and x[0] in ("ul", "ol"))]
                self.stack = self.stack[: found[-1]] + self.stack[found[-1] + 1 :] if found else self.stack
            if tag in ("li", "ul", "ol"):
                self.item = None

    def handle_data(self, data):
        self.text += "" if self.skip else data

    def handle_entityref(self, name):
        self.handle_data(decoded(f"&{name};"))

    def handle_charref(self, name):
        self.handle_data(decoded(f"&#{name};"))


def test_pages_against_another_reader(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    for row in pages:
        other = Plainly()
        other.feed(row["html"])
        other.close()
        other.cut()
        assert html_paragraphs(row["html"]) == other.out


def test_deep_pages_stay_linear():
    assert html_paragraphs("<ul>" * 30_000 + "<li>x")[0] == ("x", "bullet", 255, 0)
    assert html_paragraphs("<blockquote>" * 30_000 + "</blockquote>" * 29_999 + "q</blockquote>b") == [("q", "quote", 0, 0), ("b", "body", 0, 0)]
    assert html_paragraphs("<h1>a<h2>b</h2>c<pre> x\n</pre><script>y") == [("a", "heading", 1, 0), ("b", "heading", 2, 0), ("c", "body", 0, 0), (" x", "code", 0, 0)]
