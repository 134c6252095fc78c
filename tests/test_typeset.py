"""Lines and pages against a walk through the document; encodings and byte-level text."""

import random
import re

import pytest

from weftline.functions import strings
from weftline.operators import typeset
from weftline.operators.typeset import F


def encode(text):
    out, lost = [], 0
    for ch in text:
        if ch in "‘’‛":
            out.append("'")
        elif ch in "“”‟":
            out.append('"')
        elif ch in "–—−•":
            out.append("-")
        elif ch == "…":
            out.append("...")
        elif ch in "   \t":
            out.append(" ")
        elif ord(ch) < 256 and not (ord(ch) < 32 or 127 <= ord(ch) < 160):
            out.append(ch)
        else:
            out.append("?")
            lost += 1
    return "".join(out), lost


def fold(text, room):
    out, line = [], ""
    for word in text.split(" "):
        if not word:
            continue
        if len(word) > room:
            out += [line] if line else []
            line = ""
            out += [word[i : i + room] for i in range(0, len(word), room)]
            continue
        if len(line) + bool(line) + len(word) > room:
            out.append(line)
            line = ""
        line += (" " if line else "") + word
    return out + ([line] if line else []) or [""]


def walk(paragraphs):
    """One document's lines with their page and the points below the top, as a typesetter goes."""
    out, page, y, used = [], 0, 0.0, False
    for text, style, level, number in paragraphs:
        size = (20.0 if level <= 1 else 15.0) if style == "heading" else 9.5 if style == "code" else 11.0
        leading, indent = size * 1.32, 56 + 18 * (level if style in ("bullet", "ordered") else style == "quote")
        room = max(8, int((595 - 56 - indent) // (size * 0.5)))
        if used:
            y += leading * (0.9 if style == "heading" else 0.45)
        lost = 0
        if style == "code":
            lines = []
            for line in re.findall(r"[^\n]*\n|[^\n]+", text):
                encoded, n = encode(line.rstrip("\n").removesuffix("\r"))
                lines.append((encoded[:room], n, len(encoded) > room))
        else:
            encoded, lost = encode(text)
            lines = [(x, lost if i == 0 else 0, False) for i, x in enumerate(fold(encoded, room))]
        marker = {"bullet": "- ", "ordered": f"{number}. ", "quote": "| "}.get(style, "")
        for i, (line, n, cut) in enumerate(lines):
            if y + leading > 730 + 1e-6:
                page, y, used = page + 1, 0.0, False
            y += leading
            used = True
            out.append(((marker if i == 0 else "") + line, page, round(y, 3), n, cut))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_pages_against_a_walk(spark, seed):
    rng = random.Random(seed)
    styles = ["heading", "code", "bullet", "ordered", "quote", "body", "body", "body"]
    words = ["a", "word", "longer", "x" * 30, "y" * 200, "“q”", "世", "", "tab\tb", "é…"]
    docs = {d: [("".join(rng.choice(words) + rng.choice([" ", " ", "\n" if i % 3 == 0 else " "]) for _ in range(rng.randint(0, 60))), rng.choice(styles), rng.randint(1, 4), i) for i in range(n)] for d, n in enumerate([0, 1, 3, 40, 120, 12])}
    rows = [(d, i, *p) for d, ps in docs.items() for i, p in enumerate(ps)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc long, pos int, text string, style string, level int, number int")
    got = {}
    for r in typeset.paginated(typeset.lines(frame)).orderBy("doc", "n").collect():
        got.setdefault(r["doc"], []).append((r["text"], r["page"], round(r["y"], 3), r["lost"], r["cut"]))
    assert got == {d: walk(ps) for d, ps in docs.items() if walk(ps)}


def test_long_documents_take_few_steps(spark):
    """2,000 pages: steps of 1, 2, 4, ... reach them all; lines higher than a page have one of their own."""
    lines = spark.range(6000).select(F.lit(1).alias("doc"), F.col("id").alias("pos"), F.lit(0).alias("line"), F.lit(0).cast("long").alias("gap"), F.when(F.col("id") == 7, 5000).otherwise(1000).cast("long").alias("leading"))
    pages = typeset.paginated(lines, room=3000).groupBy("page").agg(F.count("*").alias("n"), F.min("pos").alias("first")).orderBy("page").collect()
    assert [r["first"] for r in pages[:5]] == [0, 3, 6, 7, 8] and sum(r["n"] for r in pages) == 6000 and len(pages) == 2002
    assert typeset.paginated(lines.limit(0)).count() == 0


def test_an_unbreakable_word_is_broken(spark):
    one = spark.createDataFrame([(1, 0, "x" * 400, "body", 0, 0)], "doc long, pos int, text string, style string, level int, number int")
    found = [r["text"] for r in typeset.lines(one).orderBy("line").collect()]
    assert len(found) > 1 and "".join(found) == "x" * 400 and all(len(t) * 11 * 0.5 <= 595 - 2 * 56 for t in found)


def test_encodings(spark):
    texts = ["“quoted” — yes", "hello 世界", "\U0001f600\x07\x7f\x9fÿ", "", "a\r\nb", "…  "]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strings.win_ansi(F.col("t")).alias("f")).collect()
    assert {r["t"]: (r["f"]["text"], r["f"]["lost"]) for r in frame} == {t: encode(t) for t in texts}
    odd = ["", "\0a b\n", "é中😀", "".join(map(chr, range(1, 600)))]
    back = spark.createDataFrame([(t,) for t in odd], "t string").select("t", strings.byte_decoded(strings.byte_level(F.col("t"))).alias("b"), strings.byte_level(F.col("t")).alias("l")).collect()
    assert all(r["b"] == r["t"] for r in back) and {r["t"]: r["l"] for r in back}["\0a b\n"] == "ĀaĠbĊ"
    broken = spark.createDataFrame([("Ã©", ), ("Ã", ), ("a中 b", )], "t string").select(strings.byte_decoded(F.col("t")).alias("b")).collect()
    assert [r["b"] for r in broken] == ["é", "�", "ab"]
