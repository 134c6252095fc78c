"""Operator 11, fill-in-middle: content-defined chunks, counted once each, locate a document's cuts.

A text's UTF-8 bytes are cut into chunks where a rolling hash of the last ``WINDOW`` bytes says so,
so that equal passages give equal chunks wherever they stand. What a cut needs to know of a chunk is
its boundary summary: its code points, its line ends with the code points up to each, and whether it
ends a line. A bounded cache keeps summaries by the hash of the chunk, and a cached summary counts only
if the cached bytes equal the chunk's, so a collision costs time but no result. A document's counts are
sums of its chunks' counts; a cut after ``u`` lines is found by binary search over their running sums,
then in one chunk's line ends. The cache is a worker's own: no task waits for another, and a lost
executor loses nothing but time. Rows stay where they are; there is no shuffle.

``transformed`` adds the output text and its measures to each row; ``restored`` builds the text back.

Lines are ``[^\\n]*\\n|[^\\n]+``. Four numbers of a document come from the SHA-256 of ``seed:doc_id``:
two give the cuts, one whether the form is plain, one whether suffix or prefix comes first.

Cases: null text counts as empty; empty texts, and texts that contain a marker, are plain and have null
for ``prefix_chars`` and ``middle_chars``; a null id counts as an empty one in ``seed:``; rows of one id
are treated one by one; an empty table gives an empty one; other columns pass through, but one whose
name is that of a new column is replaced. A text is
hashed in blocks, so that memory beside a batch of texts grows by a few bytes a chunk only.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from weftline.llm.text import documents, whole

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, PLAIN_FROM, SPM_BELOW = 7, 100, 50
#: Bytes the rolling hash covers; a cut has ``MEAN_BITS`` zero bits; chunk lengths lie between the bounds.
WINDOW, MEAN_BITS, SHORTEST, LONGEST = 32, 10, 128, 16_384
#: Bytes hashed at a time, and bytes of chunks and line ends that a worker's cache may hold.
BLOCK, CACHE = 1 << 20, 32 << 20
_GEAR = np.random.default_rng(20).integers(1 << 32, size=256, dtype=np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte, a hash of it and the 31 before: their table values, shifted by their distance."""
    found = _GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        found[shift:] = found[shift:] + (found[:-shift] << np.uint32(shift))
    return found


def chunk_ends(data: np.ndarray) -> list[int]:
    """Where chunks end, the last at the end of ``data``."""
    ends, last = [], 0
    for low in range(0, len(data), BLOCK):
        before = min(low, WINDOW - 1)
        marks = np.flatnonzero(rolling(data[low - before : low + BLOCK])[before:] < 1 << (32 - MEAN_BITS)) + low + 1
        for mark in marks.tolist():
            while mark - last > LONGEST:
                ends.append(last := last + LONGEST)
            if mark - last >= SHORTEST:
                ends.append(last := mark)
    while len(data) - last > LONGEST:
        ends.append(last := last + LONGEST)
    if last < len(data):
        ends.append(len(data))
    return ends


@dataclass(frozen=True)
class Summary:
    """What a document's cuts need of a chunk: counts add up, whichever chunks stand around it."""

    content: bytes
    chars: int
    line_ends: np.ndarray  # code points up to and with each line end
    ends_line: bool


def summary(content: bytes) -> Summary:
    data = np.frombuffer(content, np.uint8)
    starts = (data & 0xC0) != 0x80  # each code point has one byte that is no continuation
    breaks = np.flatnonzero(data == 10)
    return Summary(content, int(np.count_nonzero(starts)), np.cumsum(starts, dtype=np.int64)[breaks], content.endswith(b"\n"))


class ChunkCache:
    """Summaries of the chunks used last, by hash; a hit counts only if the bytes are equal."""

    def __init__(self, most: int = CACHE):
        self.most, self.held, self.found = most, 0, OrderedDict()
        self.hits = self.misses = 0

    @staticmethod
    def size(of: Summary) -> int:
        return len(of.content) + of.line_ends.nbytes + 200

    def of(self, content: bytes, key: int | None = None) -> Summary:
        key = xxhash.xxh3_64_intdigest(content) if key is None else key
        known = self.found.get(key)
        if known is not None and known.content == content:
            self.found.move_to_end(key)
            self.hits += 1
            return known
        self.misses += 1
        if known is not None:
            self.held -= self.size(self.found.pop(key))
        made = self.found[key] = summary(content)
        self.held += self.size(made)
        while self.held > self.most:
            self.held -= self.size(self.found.popitem(last=False)[1])
        return made


_CACHE = ChunkCache()


def cuts(data: np.ndarray, h1: int, h2: int, cache: ChunkCache) -> tuple[int, int, int]:
    """Number of lines, code points of the prefix, code points of the middle."""
    parts = [cache.of(data[a:b].tobytes()) for a, b in pairwise([0, *chunk_ends(data)])]
    if not parts:
        return 0, 0, 0
    lines = np.cumsum([0, *(len(p.line_ends) for p in parts)])
    chars = np.cumsum([0, *(p.chars for p in parts)])
    n = int(lines[-1]) + (not parts[-1].ends_line)

    def after(units: int) -> int:
        if units in (0, n):
            return int(chars[-1]) if units else 0
        k = int(np.searchsorted(lines, units)) - 1  # the chunk that holds the line end
        return int(chars[k] + parts[k].line_ends[units - lines[k] - 1])

    low, high = sorted((after(h1 % (n + 1)), after(h2 % (n + 1))))
    return n, low, high - low


_CUTS = pa.struct([("n", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])


@F.arrow_udf(StructType([StructField(f.name, LongType()) for f in _CUTS]))
def located(data: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    rows = []
    for text, a, b in zip(data, h1.to_pylist(), h2.to_pylist(), strict=True):
        rows.append(cuts(np.frombuffer(text.as_buffer(), np.uint8), a, b, _CACHE))
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([],) * 3)], fields=list(_CUTS))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of the hash, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transformed(docs: DataFrame, seed: int = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """``docs`` with ``n, form, prefix_chars, middle_chars, output``.

    Of a hundred documents, those from ``plain_from`` on stay plain; of the rest, ``spm_below`` in a
    hundred have the suffix first.
    """
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    text = whole()
    marked = text == ""
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(marker))
    form = F.when(marked | (h3 % 100 >= plain_from), "plain").when(h4 % 100 < spm_below, "spm").otherwise("psm")
    plain = F.col("form") == "plain"
    found = docs.withColumn("form", form).withColumn("cut", located(text.cast("binary"), h1, h2))
    a, b = F.col("cut.prefix_chars"), F.col("cut.middle_chars")
    piece = lambda start, length: F.substring(text, start.cast("int"), length.cast("int"))
    prefix, middle, suffix = piece(F.lit(1), a), piece(a + 1, b), piece(a + b + 1, F.length(text))
    output = F.when(plain, text).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    output = output.otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    new = {"n": F.col("cut.n"), "prefix_chars": F.when(~plain, a), "middle_chars": F.when(~plain, b), "output": output}
    kept = [F.col(c) for c in docs.columns if c not in ("form", "cut", *new)]
    return found.select(*kept, new["n"].alias("n"), "form", *(c.alias(name) for name, c in list(new.items())[1:]))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No marker overlaps the text, as each has one ``<``, in front."""
    first = F.when(form == "psm", SUFFIX).otherwise(PREFIX)  # the marker after the leading one
    end = len(PREFIX)
    second, third = F.call_function("instr", output, first), F.call_function("instr", output, F.lit(MIDDLE))
    cut = lambda start, stop: F.substring(output, start, stop - start)
    one, two = cut(F.lit(end + 1), second), cut(second + end, third)
    middle = F.substring(output, third + end, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    found = transformed(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES = {"op11_fill_in_middle": op11}
ORACLES = {
    "op11_fill_in_middle": """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), counted AS (
  SELECT doc_id, text, length(text) - length(replace(text, chr(10), '')) + CAST(text <> '' AND right(text, 1) <> chr(10) AS BIGINT) AS n,
         string_split(text, chr(10)) AS lines,
         [('0x' || substr(h, 1 + 8 * k, 8))::BIGINT FOR k IN [0, 1, 2, 3]] AS d
  FROM drawn
), formed AS (
  SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS low, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 100 THEN 'plain'
              WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM counted
), cut AS (
  SELECT *, CASE WHEN low = 0 THEN '' WHEN low = n THEN text ELSE array_to_string(lines[1:low], chr(10)) || chr(10) END AS prefix,
         CASE WHEN high = 0 THEN '' WHEN high = n THEN text ELSE array_to_string(lines[1:high], chr(10)) || chr(10) END AS head
  FROM formed
), pieces AS (
  SELECT *, substr(head, length(prefix) + 1) AS middle, substr(text, length(head) + 1) AS suffix FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM pieces
"""
}
