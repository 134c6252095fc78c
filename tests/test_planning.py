from collections import Counter

import pytest

from weftline.plans import catalog, planner


def test_catalogue_counts():
    routes = catalog.route_rows()
    assert len(catalog.format_rows()) == 50
    assert len(routes) == 268 and len({r[1:3] for r in routes}) == 262
    assert Counter(r[3] for r in routes) == {"A": 34, "B": 167, "C": 53, "D": 14}
    ids = {r[1] for r in catalog.format_rows()}
    assert {x for r in routes for x in (*r[1:3], *r[5])} <= ids
    assert {e for r in routes for e in r[4]} <= {*catalog.ENGINES, "StreamsCompatible", "AudioCompatible"}


def test_copies_come_before_encodings():
    first = {}
    for _, source, target, kind, *_ in catalog.route_rows():
        first.setdefault((source, target), []).append(kind)
    assert [k for k in first.values() if len(k) > 1] == [["A", "B"]] * 6


@pytest.mark.parametrize(
    "request_, wanted",
    [
        ((1, "Mkv", "Mp4", False, "h264", "aac", "D"), ("A", "Mp4", None)),
        ((2, "Mkv", "Mp4", False, "vp9", "aac", "D"), ("B", "Mp4", None)),
        ((3, "Mkv", "Mka", False, "h264", None, "D"), (None, None, "RequirementUnmet:AudioCompatible")),
        ((4, "Zip", "Gzip", True, None, None, "D"), (None, None, "Polyglot")),
        ((5, "Unknown", "Pdf", False, None, None, "D"), (None, None, "UnknownInput")),
        ((6, "Docx", "Webp", False, None, None, "C"), ("C", "Pdf>Png>Webp", None)),
        ((7, "Wav", "Txt", False, None, None, "B"), (None, None, "ClassCeiling:D")),
        ((8, "Png", "Mp3", False, None, None, "D"), (None, None, "CrossKind")),
        ((9, "Ttf", "Otf", False, None, None, "D"), (None, None, "UnsupportedPair")),
    ],
)
def test_plans(spark, request_, wanted):
    row = planner.plan(spark.createDataFrame([request_], planner.REQUEST), dict.fromkeys(catalog.ENGINES, True)).first()
    assert (row["class"], row["steps"], row["reason"]) == wanted


def test_steps_or_a_reason(spark):
    for available in ({}, dict.fromkeys(catalog.ENGINES, True)):
        found = planner._planned(spark, "/root/testdata/sf0.01", "B", available)
        assert found.where("(steps IS NULL) = (reason IS NULL)").count() == 0


def test_sniff(spark):
    import io
    import zipfile

    from weftline.operators.detect import sniff

    def zipped(name):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, "x")
        return out.getvalue()

    blobs = {
        "png": (b"\x89PNG\r\n\x1a\n123", "Png"), "mkv": (b"\x1aE\xdf\xa3 matroska", "Mkv"), "webm": (b"\x1aE\xdf\xa3 webm", "Webm"), "docx": (zipped("word/document.xml"), "Docx"), "zip": (zipped("a.txt"), "Zip"),
        "odt": (b"PK\x03\x04....mimetypeapplication/vnd.oasis.opendocument.text", "Odt"), "tiff": (b"II*\x00rest", "Tiff"), "tar": (b"a" * 257 + b"ustar", "Tar"), "json": (b' {"a":1}', "Json"), "csv": (b"a,b\n1,2", "Csv"),
        "tabs": (b"a\t,b\n", "Txt"), "text": (b"hello", "Txt"), "empty": (b"", "Unknown"), "control": (b"a\x01b", "Unknown"), "latin": (b"\xff\xfeab", "Unknown"), "html": (b"<!DOCTYPE html><p>", "Html"), "nb": (b'{"cells":[{"cell_type":"raw"}]}', "Ipynb"),
        "dxf": (b"0\nSECTION\n2\nHEADER\n", "Dxf"), "svg": (b"<?xml?><svg/>", "Svg"),
    }
    df = spark.createDataFrame([(k, bytearray(v[0])) for k, v in blobs.items()], "path string, content binary")
    assert {r["path"]: r["detected"] for r in sniff(df).collect()} == {k: v[1] for k, v in blobs.items()}
    two = spark.createDataFrame([("both", bytearray(b"BM\x00\x00WEBPWEBP"))], "path string, content binary")
    assert sniff(two).first()["polyglot"]


# Routes typed in by hand, apart from the catalogue: class, requirements and steps, in order of preference.
EXPECTED = """
Mkv Mp4: A StreamsCompatible Mp4 | B video Mp4
Mkv Webm: A StreamsCompatible Webm | B video Webm
Webm Mp4: A StreamsCompatible Mp4 | B video Mp4
Webm Mkv: A StreamsCompatible Mkv | B video Mkv
Mp4 Mkv: A StreamsCompatible Mkv | B video Mkv
Mp4 Webm: A StreamsCompatible Webm | B video Webm
Mov Webm: A StreamsCompatible Webm
Mov Mka: A AudioCompatible Mka
Avi Mp4: A StreamsCompatible Mp4
Avi Mkv: A StreamsCompatible Mkv
Avi Mka: A AudioCompatible Mka
Mkv Wav: B audio Wav
Mkv Mp3: B mp3-encoder Mp3
Mkv Ogg: B opus-encoder Ogg
Webm Flac: B audio Flac
Webm Mp3: B mp3-encoder Mp3
Mp4 Wav: B audio Wav
Mp4 Ogg: B opus-encoder Ogg
Mov Wav: B audio Wav
Mov Flac: B audio Flac
Png Gif: B - Gif
Jpeg Webp: B - Webp
Webp Png: B - Png
Gif Png: B - Png
Bmp Png: A - Png
Tiff Png: B - Png
Jpeg Pdf: B - Pdf
Bmp Pdf: B - Pdf
Avif Webp: B images Webp
Bmp Avif: B images Avif
Heic Webp: B images Webp
Jxl Webp: B images Webp
Svg Png: B images Png
Svg Gif: B images Gif
Pdf Gif: B documents,images Png>Gif
Cr2 Png: B images Png
Cr2 Avif: B images Avif
Cr3 Bmp: B images Bmp
Nef Webp: B images Webp
Arw Jpeg: B images Jpeg
Arw Tiff: B images Tiff
Dng Gif: B images Gif
Flac Wav: A audio Wav
Mp3 Mp3: B mp3-encoder Mp3
Mp3 Ogg: B opus-encoder Ogg
Mp3 Flac: B audio Flac
Gzip Tar: A archive Tar
SevenZip Gzip: B archive Tar>Gzip
Pptx Html: C documents Html
Odp Markdown: C documents Markdown
Epub Txt: C documents Txt
Epub Odt: C documents Odt
"""


def test_routes_typed_in_apart():
    found = {}
    for _, source, target, kind, needs, via in catalog.route_rows():
        found.setdefault(f"{source} {target}", []).append(f"{kind} {','.join(needs) or '-'} {'>'.join([*via, target])}")
    rows = [line.split(": ") for line in EXPECTED.strip().splitlines()]
    assert len(rows) >= 50 and {pair: " | ".join(found[pair]) for pair, _ in rows} == dict(rows)


def test_plans_of_events_take_the_first_route_that_holds(spark):
    """The plans of the registered query against the rows above, for the requests that ask for them."""
    rows = dict(line.split(": ") for line in EXPECTED.strip().splitlines())
    sf, seen = "/root/testdata/sf0.1", set()
    asked = {r["req_id"]: r for r in planner._requests(spark, sf).where(planner.F.concat_ws(" ", "source", "target").isin(list(rows))).collect()}
    plans = planner.plan_first_match(spark, sf).where(planner.F.col("req_id").isin(list(asked)[:4000])).collect()
    carries = {("Mp4", "h264"), ("Mp4", "h265"), ("Mp4", "av1"), ("Webm", "vp9"), ("Webm", "av1"), *(("Mkv", x) for x in ("h264", "h265", "av1", "vp9", "aac", "opus", "mp3")), ("Mp4", "aac"), ("Mp4", "mp3"), ("Webm", "opus"), *(("Mka", x) for x in ("aac", "opus", "mp3"))}
    for p in plans:
        q = asked[p["req_id"]]
        pair = f"{q['source']} {q['target']}"
        able = lambda x: x is None or (q["target"], x) in carries  # noqa: B023, E731
        wanted = None
        for option in rows[pair].split(" | "):
            kind, needs, steps = option.split(" ")
            if not (needs == "StreamsCompatible" and not (able(q["video"]) and able(q["audio"])) or needs == "AudioCompatible" and not (q["audio"] and able(q["audio"]))):
                wanted = (kind, steps)
                break
        assert (p["class"], p["steps"]) == (wanted or (None, None)), (pair, q)
        seen.add((pair, p["class"]))
    assert len(seen) > 45 and {("Mkv Mp4", "A"), ("Mkv Mp4", "B"), ("Avi Mp4", None)} <= seen
