"""Operator 4, packing by non-negative least squares over a histogram of lengths.

A document's ids are cut into full windows and a remainder shorter than a window. Remainders of
one length are interchangeable, so the whole problem is the histogram of remainder lengths: at
most ``window - 1`` counts, whatever the size of the corpus. On the driver, shallow combinations
of up to four remainders of one or two lengths that fill a window exactly are enumerated, repeat
counts are solved against the histogram by non-negative least squares, rounded down, and what is
left is packed greedily, largest first, cutting a remainder where nothing fits a gap. The last,
short sequence is cut at powers of two, where sequences need no padding.

The plan says which ranks of each length go where. Spark ranks the remainders: rows of one length
are dealt into lanes of bounded size by a hash of the row, ranked within their lane, and shifted by
the counts of the lanes before; then each document cuts itself by the broadcast plan, whose size
depends on the window alone.

Cases: null text counts as empty, so a document is at least its end id; repeated rows are packed
one by one; a null ``doc_id`` is packed like any other; an empty table gives no pieces; very long
texts become many full windows; extra columns are not carried.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.scratch import written
from weftline.llm.text import documents, whole
from weftline.llm.tokens import encoder

WINDOW, END_ID = 2048, 1
PARTS = 4
SWEEPS = 40
#: Rows of one length in a lane, about; a lane is sorted in one task, and has one row in the table of shifts.
LANE_ROWS = 512


# -- the plan, from the histogram ------------------------------------------------------------


def combinations(window: int, present: np.ndarray, parts: int = PARTS) -> list[tuple[tuple[int, int], ...]]:
    """``((length, times), ...)`` of one or two present lengths and at most ``parts`` parts that fill a window.

    Half a window, if a power of two, is also a full sequence of its own.
    """
    found = [((n, 1),) for n in present.tolist() if 2 * n == window and n & (n - 1) == 0]
    here = set(present.tolist())
    found += [((window // k, k),) for k in range(2, parts + 1) if window % k == 0 and window // k in here]
    for i in range(1, parts):
        for j in range(1, parts - i + 1):
            for a in present.tolist():
                b, rest = divmod(window - i * a, j)
                if not rest and b > 0 and b != a and b in here and (i, a) > (j, b):
                    found.append(((a, i), (b, j)))
    return found


def nnls(columns: list[tuple[tuple[int, int], ...]], target: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Coordinate descent on ``|Ax - target|^2`` with ``x >= 0``; A's columns are sparse."""
    residual = target.astype(float).tolist()
    x = [0.0] * len(columns)
    norms = [float(sum(k * k for _, k in column)) for column in columns]
    for _ in range(sweeps):
        moved = 0.0
        for at, column in enumerate(columns):
            step = max(-x[at], sum(k * residual[n] for n, k in column) / norms[at])
            if step:
                x[at] += step
                moved = max(moved, abs(step))
                for n, k in column:
                    residual[n] -= k * step
        if moved < 0.25:
            break
    return np.array(x)


@dataclass
class Plan:
    """``pieces[r]``: rows ``(lo, hi, start, length, sequence, offset)`` for ranks lo to hi of remainder r."""

    window: int
    pieces: dict[int, list[tuple[int, int, int, int, int, int]]] = field(default_factory=lambda: defaultdict(list))
    sequences: int = 0

    def lookup(self) -> dict[int, tuple[list[int], list[list[tuple[int, int, int, int, int, int]]]]]:
        """For each remainder: where ranges begin, and the rows that cover each range, in order of start."""
        out = {}
        for r, rows in self.pieces.items():
            begins = sorted({x for row in rows for x in row[:2]})
            covers: list[list] = [[] for _ in begins]
            index = {x: i for i, x in enumerate(begins)}
            for row in sorted(rows, key=lambda p: p[2]):
                for i in range(index[row[0]], index[row[1]]):
                    covers[i].append(row)
            out[r] = (begins, covers)
        return out


def plan(histogram: dict[int, int], window: int = WINDOW, first_sequence: int = 0) -> Plan:
    """Place every remainder of the histogram. ``histogram``: remainder length to count."""
    made = Plan(window, sequences=first_sequence)
    stock: dict[int, deque] = defaultdict(deque)  # by length left: [remainder, lo, hi, start]
    counts = np.zeros(window, np.int64)
    for r, n in sorted(histogram.items()):
        if r and n:
            stock[r].append((r, 0, n, 0))
            counts[r] = n

    def put(length: int, times: int, offset: int, use: int) -> None:
        """The next ``times`` pieces of ``length`` go to as many sequences; the first ``use`` ids of each."""
        sequence, left = made.sequences, times
        while left:
            r, lo, hi, start = stock[length].popleft()
            cut = min(hi, lo + left)
            if cut < hi:
                stock[length].appendleft((r, cut, hi, start))
            made.pieces[r].append((lo, cut, start, use, sequence, offset))
            if use < length:
                stock[length - use].append((r, lo, cut, start + use))
            sequence, left = sequence + cut - lo, left - (cut - lo)
        counts[length] -= times
        if use < length:
            counts[length - use] += times

    # Repeat counts by least squares, rounded down and held to what is there.
    columns = combinations(window, np.flatnonzero(counts))
    repeats = np.floor(nnls(columns, counts) + 1e-9).astype(np.int64)
    for at in np.argsort(-repeats, kind="stable"):
        times = min([int(repeats[at]), *(int(counts[n]) // k for n, k in columns[at])])
        if times > 0:
            offset = 0
            for n, k in columns[at]:
                for _ in range(k):
                    put(n, times, offset, n)
                    offset += n
            made.sequences += times

    # The rest greedily: the largest first, then the largest that fits, then a cut.
    while (left := np.flatnonzero(counts)).size:
        avail = counts.copy()
        chosen: list[tuple[int, int]] = []  # (length, ids used)
        gap = window
        while gap:
            fits = left[: np.searchsorted(left, gap, "right")]
            fits = fits[avail[fits] > 0]
            if fits.size:
                n = use = int(fits[-1])
            else:
                larger = left[avail[left] > 0]
                if not larger.size:
                    break
                n, use = int(larger[0]), gap
            chosen.append((n, use))
            avail[n] -= 1
            gap -= use
        need: dict[int, int] = defaultdict(int)
        for n, _ in chosen:
            need[n] += 1
        if gap:  # all that is left, less than a window: sequences of powers of two
            total = sum(use for _, use in chosen)
            _last(made, stock, [n for n, _ in chosen], total)
            break
        times = min(int(counts[n]) // k for n, k in need.items())
        offset = 0
        for n, use in chosen:
            put(n, times, offset, use)
            offset += use
        made.sequences += times
    return made


def _last(made: Plan, stock: dict[int, deque], lengths: list[int], total: int) -> None:
    """Cut the last pieces into sequences whose lengths are powers of two."""
    room = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    at, offset = 0, 0
    for n in lengths:
        r, lo, hi, start = stock[n].popleft()
        if hi - lo > 1:
            stock[n].appendleft((r, lo + 1, hi, start))
        while n:
            use = min(n, room[at] - offset)
            made.pieces[r].append((lo, lo + 1, start, use, made.sequences, offset))
            start, n, offset = start + use, n - use, offset + use
            if offset == room[at]:
                at, offset = at + 1, 0
                made.sequences += 1


# -- over documents --------------------------------------------------------------------------


def _few(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, so that what Python makes of a batch is a small part of it."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        end, width, done = np.array([end_id], code.dtype).tobytes(), np.dtype(code.dtype).itemsize, 0
        for batch in _few(batches):
            packed = [code.ids(text) + end for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(x) // width for x in packed], pa.int64()), pa.array(packed, pa.binary()), pa.array(range(done, done + len(packed)), pa.int64())], names=["doc_id", "doc_tokens", "ids", "nth"])
            done += batch.num_rows

    return run


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """``doc_id, doc_tokens, ids`` with packed ids, and ``nth``, the row's place in its task; written out so that texts are encoded once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    return written(rows.mapInArrow(_encode(tokenizer, end_id), "doc_id long, doc_tokens long, ids binary, nth long"), "packing-ids")


def _cut(placed, window: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = placed.value
        types = [pa.int64()] * 7 + [pa.binary()]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        for batch in _few(batches):
            out: list[list] = [[] for _ in names]

            def add(doc_id, start, length, n, sequence, offset, ids):
                raw = ids[start : start + length]
                row = (doc_id, start, length, zlib.crc32(raw.astype("<u4")), n, sequence, offset, raw.tobytes())
                for column, value in zip(out, row, strict=True):
                    column.append(value)

            for doc_id, n, data, rank, full in zip(*(batch[c].to_pylist() for c in ("doc_id", "doc_tokens", "ids", "rank", "full_before")), strict=True):
                ids = np.frombuffer(data, dtype)
                windows, rest = divmod(n, window)
                for i in range(windows):
                    add(doc_id, i * window, window, n, full + i, 0, ids)
                if rest:
                    begins, covers = ranges[rest]
                    for lo, _, start, length, sequence, offset in covers[bisect_right(begins, rank) - 1]:
                        add(doc_id, windows * window + start, length, n, sequence + rank - lo, offset, ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return run


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece, with its packed ids."""
    spark = docs.sparkSession
    rows = encoded(docs, tokenizer, end_id).withColumn("rest", (F.col("doc_tokens") % window).cast("int")).withColumn("windows", F.expr(f"doc_tokens div {window}"))
    found = rows.groupBy("rest").agg(F.count("*").alias("n"), F.sum("windows").alias("windows")).collect()  # at most one row per length
    before, full = {}, 0
    for x in sorted(found):
        before[x["rest"]] = full
        full += x["windows"]
    made = plan({x["rest"]: x["n"] for x in found}, window, first_sequence=full)
    lanes = F.create_map(*[F.lit(v) for x in found for v in (x["rest"], -(-x["n"] // LANE_ROWS))]) if found else F.create_map(F.lit(0), F.lit(1))
    laned = rows.withColumn("lane", F.pmod(F.xxhash64("doc_id", F.crc32("ids"), "nth"), lanes[F.col("rest")]))
    prior = W.partitionBy("rest").orderBy("lane").rowsBetween(W.unboundedPreceding, -1)
    bases = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.create_map(F.lit(0), F.lit(0))
    shifts = (
        laned.groupBy("rest", "lane").agg(F.count("*").alias("n"), F.sum("windows").alias("w"))
        .select("rest", "lane", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("rank_base"), (F.coalesce(F.sum("w").over(prior), F.lit(0)) + bases[F.col("rest")]).alias("full_base"))
    )
    lane = W.partitionBy("rest", "lane").orderBy("doc_id", "ids", "nth")
    ranked = laned.withColumn("r", F.row_number().over(lane) - 1).withColumn("f", F.sum("windows").over(lane.rowsBetween(W.unboundedPreceding, 0)) - F.col("windows"))
    joined = ranked.join(shifts.hint("merge"), ["rest", "lane"])
    wide = joined.select("doc_id", "doc_tokens", "ids", (F.col("r") + F.col("rank_base")).alias("rank"), (F.col("f") + F.col("full_base")).alias("full_before"))
    dtype = encoder(tokenizer).dtype
    return wide.mapInArrow(_cut(spark.sparkContext.broadcast(made.lookup()), window, dtype), PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, length, ids``: the pieces of each sequence in order; at most a window each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    grouped = pieces.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("length"))
    return grouped.select("sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def packed_documents(docs: DataFrame) -> DataFrame:
    """The pieces as the contract has them."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir))


QUERIES = {"op4_packing": op4}
ORACLES: dict[str, str] = {}
