"""Dimensions of conversion planning: formats, signatures, routes, engines, codecs, priors.

They are small, fixed tables; each becomes a DataFrame that Spark broadcasts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Id, kind, name, extension, whether a memory-safe parser reads it.
_FORMATS = """
Png image png png 1
Jpeg image jpeg jpg 1
Webp image webp webp 1
Gif image gif gif 1
Bmp image bmp bmp 1
Tiff image tiff tiff 1
Heic image heic heic 0
Avif image avif avif 0
Jxl image jxl jxl 0
Svg image svg svg 1
Wav audio wav wav 0
Flac audio flac flac 0
Mp3 audio mp3 mp3 0
Ogg audio ogg ogg 0
M4a audio m4a m4a 0
Mp4 video mp4 mp4 1
Mov video mov mov 1
Avi video avi avi 1
Mkv video mkv mkv 1
Webm video webm webm 1
Mka audio mka mka 1
Pdf document pdf pdf 0
Docx document docx docx 0
Odt document odt odt 0
Pptx document pptx pptx 0
Odp document odp odp 0
Epub document epub epub 0
Xlsx spreadsheet xlsx xlsx 0
Ods spreadsheet ods ods 0
Dxf document dxf dxf 1
PostScript document postscript ps 0
Ttf font ttf ttf 0
Otf font otf otf 0
Woff font woff woff 0
Woff2 font woff2 woff2 0
Zip archive zip zip 0
Tar archive tar tar 0
Gzip archive gzip gz 0
SevenZip archive 7z 7z 0
Cr3 image cr3 cr3 0
Cr2 image cr2 cr2 0
Nef image nef nef 0
Arw image arw arw 0
Dng image dng dng 0
Csv tabular csv csv 1
Json tabular json json 1
Ipynb document notebook ipynb 1
Txt document txt txt 1
Markdown document markdown md 1
Html document html html 1
"""

# Format, offset, signature bytes in hex.
_MAGICS = """
Png 0 89504E470D0A1A0A
Jpeg 0 FFD8FF
Webp 8 57454250
Gif 0 474946383761
Gif 0 474946383961
Bmp 0 424D
Tiff 0 49492A00
Tiff 0 4D4D002A
Heic 4 6674797068656963
Heic 4 6674797068656978
Heic 4 667479706D696631
Avif 4 6674797061766966
Jxl 0 FF0A
Jxl 0 0000000C4A584C200D0A870A
Wav 8 57415645
Flac 0 664C6143
Mp3 0 494433
Mp3 0 FFFB
Mp3 0 FFF3
Ogg 0 4F676753
M4a 4 667479704D3441
M4a 4 667479704D344220
Mp4 4 6674797069736F6D
Mp4 4 667479706D703432
Mp4 4 667479704D345620
Mov 4 6674797071742020
Avi 8 41564920
Mkv 0 1A45DFA3
Webm 0 1A45DFA3
Mka 0 1A45DFA3
Pdf 0 255044462D
Docx 0 504B0304
Odt 0 504B0304
Pptx 0 504B0304
Odp 0 504B0304
Epub 0 504B0304
Xlsx 0 504B0304
Ods 0 504B0304
PostScript 0 25215053
Ttf 0 00010000
Ttf 0 74727565
Otf 0 4F54544F
Woff 0 774F4646
Woff2 0 774F4632
Zip 0 504B0304
Tar 257 7573746172
Gzip 0 1F8B
SevenZip 0 377ABCAF271C
Cr3 4 66747970637278
Cr2 0 49492A00100000004352
Cr2 0 4D4D002A100000004352
Nef 0 49492A00100000004E4546
Arw 0 00000008534F4E59
Dng 0 49492A00
Dng 0 4D4D002A
Html 0 3C21444F43545950452068746D6C
Html 0 3C21646F63747970652068746D6C
Html 0 3C68746D6C
"""

FAMILIES = {"Mkv": "ebml", "Webm": "ebml", "Mka": "ebml", "Docx": "zip", "Odt": "zip", "Pptx": "zip", "Odp": "zip", "Epub": "zip", "Xlsx": "zip", "Ods": "zip", "Zip": "zip", "Tiff": "tiff", "Cr2": "tiff", "Nef": "tiff", "Dng": "tiff"}

#: Engines that this library can run are available; codecs, renderers and models are not.
ENGINES = {"archive": True, "documents": True, "images": False, "audio": False, "mp3-encoder": False, "opus-encoder": False, "video": False, "ocr": False, "speech": False}

# Codecs that a container can carry.
VIDEO_CARRY = {"Mkv": ("h264", "h265", "av1", "vp8", "vp9"), "Mp4": ("h264", "h265", "av1"), "Webm": ("vp8", "vp9", "av1")}
AUDIO_CARRY = {"Mkv": ("aac", "mp3", "alac", "opus", "vorbis", "flac", "pcm"), "Mka": ("aac", "mp3", "alac", "opus", "vorbis", "flac", "pcm"), "Mp4": ("aac", "mp3", "alac"), "Webm": ("opus", "vorbis")}

# How usual a target is, and pairs with a prior of their own.
DESTINATION_WEIGHTS = {
    1.0: "Jpeg Png Pdf Mp4 Mp3", 0.8: "Webp Docx Flac Json Woff2", 0.6: "Avif M4a Mkv Wav Txt Markdown Html", 0.5: "Gif Ogg Webm Csv Zip", 0.4: "Woff",
    0.3: "Tiff Odt Jxl Svg", 0.2: "Mka Gzip Tar SevenZip Ttf Otf", 0.1: "Pptx Odp Epub Xlsx Ods Dxf Bmp Heic PostScript Mov Avi", 0.05: "Ipynb Cr2 Cr3 Nef Arw Dng",
}
PRIOR_PAIRS = {
    ("Heic", "Jpeg"): 0.85, ("Mkv", "Mp4"): 0.80, ("Docx", "Pdf"): 0.75, ("Webm", "Mp4"): 0.70, ("Odt", "Pdf"): 0.70, ("Flac", "Mp3"): 0.65, ("Wav", "Mp3"): 0.60,
    ("Png", "Jpeg"): 0.55, ("Csv", "Json"): 0.50, ("Webp", "Png"): 0.45, ("Webp", "Jpeg"): 0.40, ("Wav", "Flac"): 0.35, ("Jpeg", "Png"): 0.30,
}
LOSSLESS = "Png Bmp Tiff Flac Wav Cr2 Cr3 Nef Arw Dng".split()
LOSSY = "Jpeg Webp Avif Jxl Heic Gif Mp3 Ogg M4a Mp4 Webm".split()

#: Fixed values, by rule where several formats share a row: sources, targets, class, requirement, intermediate formats; order is preference.
_RASTER = "Jpeg Png Webp Gif Bmp Tiff Avif"
_DOCUMENT = "Txt Markdown Html Pdf Docx Odt"
_ROUTE_RULES = [
    ("Mkv Webm", "Mp4", "A", "StreamsCompatible"), ("Webm", "Mkv", "A", "StreamsCompatible"), ("Mkv", "Webm", "A", "StreamsCompatible"), ("Mkv Webm", "Mka", "A", "AudioCompatible"),
    ("Mp4", "Mkv Webm", "A", "StreamsCompatible"), ("Mp4", "Mka", "A", "AudioCompatible"), ("Mov Avi", "Mp4 Mkv Webm", "A", "StreamsCompatible"), ("Mov Avi", "Mka", "A", "AudioCompatible"),
    ("Mp4", "Webm Mkv", "B", "video"), ("Mkv", "Mp4 Webm", "B", "video"), ("Webm", "Mp4 Mkv", "B", "video"),
    *[(source, target, "B", engine) for source in ("Mkv", "Webm", "Mp4", "Mov") for target, engine in (("Wav", "audio"), ("Flac", "audio"), ("Mp3", "mp3-encoder"), ("Ogg", "opus-encoder"))],
    *[rule for source in ("Png", "Jpeg") for rule in ((source, " ".join(t for t in "Jpeg Png Webp Gif Bmp Tiff".split() if t != source), "B", ""), (source, "Avif", "B", "images"))],
    ("Webp", "Png Jpeg Gif Bmp Tiff", "B", ""), ("Gif", "Png Jpeg Webp Bmp Tiff", "B", ""), ("Bmp", "Png", "A", ""), ("Bmp", "Jpeg Webp Gif Tiff", "B", ""), ("Tiff", "Png Jpeg Webp Gif Bmp", "B", ""),
    ("Jpeg Png Tiff Webp Gif Bmp", "Pdf", "B", ""), ("Heic", "Jpeg Png", "B", "images"), ("Avif", "Png Jpeg Webp", "B", "images"), ("Jxl", "Png Jpeg", "B", "images"),
    ("Webp Gif Bmp Tiff", "Avif", "B", "images"), ("Avif", "Gif Bmp Tiff", "B", "images"), ("Heic Jxl", "Webp Gif Bmp Tiff Avif", "B", "images"), ("Svg", "Png Jpeg Webp Bmp Tiff Gif Avif", "B", "images"),
    ("Pdf", "Png Jpeg", "B", "documents"), ("Pdf", "Webp Gif Bmp Tiff Avif", "B", "documents images", "Png"), ("Cr2 Cr3 Nef Arw Dng", _RASTER, "B", "images"),
    ("Wav", "Flac", "A", "audio"), ("Flac", "Wav", "A", "audio"), ("Mp3 Ogg", "Wav", "B", "audio"), ("Wav Flac Mp3 Ogg M4a", "Mp3", "B", "mp3-encoder"), ("Wav Flac Mp3 Ogg M4a", "Ogg", "B", "opus-encoder"),
    ("M4a", "Wav Flac", "B", "audio"), ("Mp3 Ogg", "Flac", "B", "audio"),
    ("Zip", "Tar", "A", "archive"), ("Tar", "Zip Gzip", "A", "archive"), ("Gzip", "Tar", "A", "archive"), ("SevenZip", "Tar Zip", "B", "archive"), ("Gzip", "Zip", "A", "archive", "Tar"), ("Zip", "Gzip", "A", "archive", "Tar"), ("SevenZip", "Gzip", "B", "archive", "Tar"),
    ("Dxf", "Pdf Svg", "C", "documents"), ("Pptx Odp Epub", _DOCUMENT, "C", "documents"), ("Xlsx Ods", "Csv Json", "C", "documents"), ("Ods", "Xlsx", "C", "documents"),
    ("Ttf Otf", "Woff Woff2", "A", "archive"), ("Woff", "Woff2", "A", "archive"), ("Woff", "Ttf Otf", "A", "archive"),
    ("Png Jpeg Webp Bmp Tiff Gif", "Txt", "D", "ocr"), ("Docx Odt", "Txt", "B", "documents"), ("Docx Odt Pdf", "Markdown", "B", "documents"), ("Txt", "Pdf", "C", "documents"), ("Txt", "Docx Odt Html Markdown", "B", "documents"),
    ("Ipynb", "Markdown Html Txt Pdf Docx Odt", "C", "documents"), ("Ipynb", "Png", "C", "documents", "Pdf"), ("Html", "Pdf Docx Odt Markdown Txt", "C", "documents"), ("Pdf", "Html", "B", "documents"), ("Pdf", "Odt", "C", "documents"),
    ("Docx Odt", "Html", "B", "documents"), ("Txt", "Png Jpeg", "C", "documents", "Pdf"), ("Docx", "Odt", "B", "documents"), ("Odt", "Docx", "B", "documents"), ("Docx Odt", "Pdf", "C", "documents"),
    ("Docx", "Png Jpeg", "C", "documents", "Pdf"), ("Docx", "Webp Avif Gif Bmp Tiff", "C", "documents images", "Pdf Png"), ("Odt", "Png Jpeg", "C", "documents", "Pdf"), ("Pdf", "Txt", "B", "documents"), ("Pdf", "Docx", "C", "documents"),
    ("Wav Flac Mp3 Ogg M4a Mkv Webm Mp4", "Txt", "D", "speech"), ("Csv", "Json", "A", ""), ("Json", "Csv", "B", ""),
]


def format_rows() -> list[tuple[int, str, str, str, str, bool]]:
    return [(i, *line.split()[:4], line.split()[4] == "1") for i, line in enumerate(_FORMATS.strip().splitlines())]


def magic_rows() -> list[tuple[str, int, str]]:
    return [(f, int(at), signature) for f, at, signature in (line.split() for line in _MAGICS.strip().splitlines())]


def route_rows() -> list[tuple[int, str, str, str, list[str], list[str]]]:
    """``(ord, source, target, class, requires, via)`` in order of preference."""
    rows = []
    for sources, targets, kind, needs, *via in _ROUTE_RULES:
        for source in sources.split():
            for target in targets.split():
                rows.append((len(rows), source, target, kind, needs.split(), via[0].split() if via else []))
    return rows


def weight_rows() -> list[tuple[str, float]]:
    return [(f, w) for w, names in DESTINATION_WEIGHTS.items() for f in names.split()]


def fidelity_rows() -> list[tuple[str, str]]:
    return [(f, "lossless") for f in LOSSLESS] + [(f, "lossy") for f in LOSSY]


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(format_rows(), "ord int, id string, kind string, name string, extension string, safe_parser boolean")


def magics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(magic_rows(), "id string, at int, signature_hex string")


def routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(route_rows(), "ord int, source string, target string, class string, requires array<string>, via array<string>")


def engines(spark: SparkSession, available: dict[str, bool] | None = None) -> DataFrame:
    return spark.createDataFrame(sorted((available or ENGINES).items()), "engine string, available boolean")


def codec_carry(spark: SparkSession) -> DataFrame:
    rows = [(c, "video", x) for c, xs in VIDEO_CARRY.items() for x in xs] + [(c, "audio", x) for c, xs in AUDIO_CARRY.items() for x in xs]
    return spark.createDataFrame(rows, "container string, stream string, codec string")


def priors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b, p) for (a, b), p in PRIOR_PAIRS.items()], "source string, target string, pair_prior double")


def weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(weight_rows(), "id string, weight double")


def fidelities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fidelity_rows(), "id string, fidelity string")


def sql_values(rows: list[tuple], columns: str) -> str:
    """Rows as an SQL table expression."""

    def literal(x) -> str:
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, (list, tuple)):
            return "[" + ", ".join(map(literal, x)) + "]::VARCHAR[]"
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return repr(x) if x is not None else "NULL"

    return f"(VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS v({columns})"
