"""Operator 8, substring dedup by collinear chaining.

Seeds are hashes of five words in a row, thinned to the smallest of every eight in a row, so that
any run of 12 words that two documents share yields a common seed. A seed also makes a long seed with
the next one that ends ``LONG`` words or more after its start. Every occurrence of a seed, short or long, is
linked to its first one (in the smallest document) and to the one before, never pairwise, so a passage in
thousands of documents costs thousands of links. The first occurrences show where the pieces of a
passage come from; the one before shows who held them together last. Matches of a document with another are chained in order, with
gap costs, through a Fenwick tree; chains are extended across unequal words while more than two in three agree, and aligned word by word. Those that agree
in less than 0.8 of their words are cut at their worst gaps, and the parts that agree stay. Passages that touch are merged per document, since their
seeds may have first occurred in different documents, and those of ``MIN_WORDS`` words or more are
reported.

Words are runs without white space, A-Z lower-cased; positions count words from 0, ends exclusive.

Cases: null text counts as empty and has no passages; texts shorter than five words have no seeds;
a document that repeats a passage of another has each copy reported, one that only repeats its own
words none; rows that share an id are told apart by a
64-bit hash of their text, and identical rows are one document; rows with a null id are reported with a null
id; an empty table gives an empty result; extra columns are ignored (``without_repeats`` keeps
them).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.scratch import forget, written
from weftline.llm.text import documents, whole
from weftline.llm.wordhash import NON_SPACE, mixed, slices, words

K, THIN, LONG = 5, 8, 16
#: More than the words from the start of a long seed to that of its second part.
STEPS = 32
#: Words that a pair reads beyond its outermost seeds. Longer agreement has long seeds of its own, which
#: link it to the document where they first occurred.
MARGIN = 64
#: Words of a block, the unit in which documents are read for alignment.
BLOCK = 256
MIN_CHAIN, MIN_WORDS, SIMILARITY = 16, 40, 0.8
#: Matches of a pair that call for an alignment where the matches themselves span too little for a passage.
FEW = 2
#: Documents of a seed among which one before is sought.
NEAR_ROWS = 1000
#: A seed is worth its words; a word of gap on either side costs this much.
GAP = 0.1
TOUCH = 12
NO_ID = -(1 << 63)


def keyed(docs: DataFrame) -> DataFrame:
    """``id, part, text``: a key that tells rows of one id apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(whole()).alias("part"), whole().alias("text"))


def seeds_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, position, hash)`` of the seeds of a run of texts, equal ones included."""
    found = words(data, offsets, NON_SPACE)
    n = len(found.text) - K + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = np.zeros(n, np.uint64)
    for j in range(K):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + found.hash[j : j + n]
    place = np.arange(n)
    inside = found.text[:n] == found.text[K - 1 :]
    place, text, grams = place[inside], found.text[:n][inside], mixed(grams[inside], 8)
    if not len(place):
        return place, text, grams.view(np.int64)
    picked = []
    if len(place) >= THIN:
        views = np.lib.stride_tricks.sliding_window_view(grams, THIN)
        whole_window = np.flatnonzero(text[: len(views)] == text[THIN - 1 :])
        picked.append(whole_window + views[whole_window].argmin(axis=1))
    counts = np.bincount(text, minlength=len(offsets) - 1)
    short = np.flatnonzero((counts[text] < THIN))
    if len(short):  # fewer than a window: the smallest of all
        order = short[np.lexsort((grams[short], text[short]))]
        picked.append(order[np.concatenate([[True], text[order][1:] != text[order][:-1]])])
    at = np.unique(np.concatenate(picked))
    text, grams, place = text[at], grams[at], place[at]
    first_word = np.searchsorted(found.text, text)
    return text, place - first_word, grams.view(np.int64)


def long_seeds(text: np.ndarray, place: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(index, step, hash)``: seeds joined with the first whose end lies LONG words or more from their start.

    Thinned to those that start with the smallest of three seeds in a row, as a passage holds several.
    """
    hashes, key = grams.view(np.uint64), (text << 32) + place
    to = np.searchsorted(key, key + LONG - K)
    picked = np.bincount(text, minlength=1)[text] < 3 if len(text) else np.zeros(0, bool)
    if len(text) > 2:
        three = np.flatnonzero(text[:-2] == text[2:])
        picked[three + np.lib.stride_tricks.sliding_window_view(hashes, 3)[three].argmin(axis=1)] = True
    index = np.flatnonzero(picked & (to < len(key)))
    index = index[text[to[index]] == text[index]]
    step = place[to[index]] - place[index]
    first, second = hashes[index], hashes[to[index]]
    return index, step, mixed(first * np.uint64(3) + second * np.uint64(0x9E3779B97F4A7C15) + step.astype(np.uint64), 9).view(np.int64)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, parts = batch["id"].to_numpy(), batch["part"].to_numpy()
        for first, data, offsets in slices(batch["text"]):
            text, place, grams = seeds_of(data, offsets)
            index, step, joined = long_seeds(text, place, grams)
            row, at = first + np.concatenate([text, text[index]]), np.concatenate([place * STEPS, place[index] * STEPS + step])
            columns = [pa.array(np.concatenate([grams, joined])), pa.array(ids[row]), pa.array(parts[row]), pa.array(at)]
            yield pa.RecordBatch.from_arrays(columns, names=["seed", "id", "part", "at"])


def repeated_seeds(docs: DataFrame) -> DataFrame:
    """``seed, id, part, at, n, head_id`` of the seeds that occur again, written out.

    The aggregation over all seeds keeps plain numbers only, which are hashed and not sorted; what
    is left after it is a small part.
    """
    seeds = written(keyed(docs).mapInArrow(_seeds, "seed long, id long, part long, at long"), "seeds")
    again = written(seeds.groupBy("seed").agg(F.count("*").alias("n"), F.min("id").alias("head_id")).where("n > 1").select("seed", "n", "head_id"), "repeated-seeds")
    repeated = written(seeds.join(again.hint("merge"), "seed"), "seeds-again")
    forget(seeds)
    forget(again)
    return repeated


def matches(repeated: DataFrame) -> DataFrame:
    """``id, part, other, other_part, pos, other_pos``: seeds linked to their first occurrence and to the one before, long ones by both of theirs.

    The pieces of a passage may each have occurred somewhere before; the document that holds them together
    is found as the last one before, by its short seeds. A seed of very many documents is dealt into groups of about
    ``NEAR_ROWS`` of them, and is linked to the one before in its group.
    """
    heads = repeated.where("id = head_id").groupBy("seed").agg(F.min(F.struct("part", "at")).alias("head"))
    heads = written(heads, "seed-heads")  # so that AQE can split a seed of many documents
    linked = repeated.join(heads.hint("merge"), "seed").where("id <> head_id OR part <> head.part")
    links = linked.select("id", "part", "at", F.col("head_id").alias("other"), F.col("head.part").alias("other_part"), F.col("head.at").alias("other_at"))
    group = F.pmod(F.xxhash64("id", "part"), F.ceil(F.col("n") / NEAR_ROWS))
    before = F.lag(F.struct("id", "part", "at")).over(W.partitionBy("seed", "group").orderBy("id", "part", "at"))
    near = repeated.where(f"n > 2 AND at % {STEPS} = 0").withColumn("group", group).withColumn("before", before).where("before.id > head_id AND (before.id <> id OR before.part <> part)")
    links = links.unionByName(near.select("id", "part", "at", F.col("before.id").alias("other"), F.col("before.part").alias("other_part"), F.col("before.at").alias("other_at")))
    step = F.col("at") % STEPS
    pos, other = F.expr(f"cast(at div {STEPS} as int)"), F.expr(f"cast(other_at div {STEPS} as int)")
    ends = F.when(step > 0, F.array(F.lit(0), step.cast("int"))).otherwise(F.array(F.lit(0)))
    each = links.select("id", "part", "other", "other_part", pos.alias("pos"), other.alias("other_pos"), F.explode(ends).alias("by"))
    return each.select("id", "part", "other", "other_part", (F.col("pos") + F.col("by")).alias("pos"), (F.col("other_pos") + F.col("by")).alias("other_pos"))


def linked(x: np.ndarray, y: np.ndarray) -> list[list[int]]:
    """Collinear chains of matches, as places in ``x`` and ``y``; the best first, each match in one.

    ``x`` ascends. The value of a chain is K for each seed less GAP for each word between seeds on
    either side; a Fenwick tree over the order of y gives each match its best predecessor. Matches
    that another chain leaves over at a fork are chains of their own.
    """
    n = len(x)
    diagonal = x - y
    if (diagonal == diagonal[0]).all():  # all in order already: cut where a gap outweighs a seed
        cuts = (np.flatnonzero(2 * GAP * np.diff(x) > K) + 1).tolist()
        return [list(range(a, b)) for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
    ranks = (np.searchsorted(np.unique(y), y) + 1).tolist()
    xs, ys = x.tolist(), y.tolist()
    size = max(ranks)
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (size + 1)
    value, parent = [0.0] * n, [-1] * n
    at = 0
    while at < n:
        stop = at
        while stop < n and xs[stop] == xs[at]:
            stop += 1
        for i in range(at, stop):
            best, j = (-1e18, -1), ranks[i] - 1
            while j > 0:
                best = max(best, tree[j])
                j &= j - 1
            gained = best[0] - GAP * (xs[i] + ys[i])
            value[i], parent[i] = (K + gained, best[1]) if gained > 0 else (float(K), -1)
        for i in range(at, stop):  # matches at one place of x never follow each other
            entry, j = (value[i] + GAP * (xs[i] + ys[i]), i), ranks[i]
            while j <= size:
                tree[j] = max(tree[j], entry)
                j += j & -j
        at = stop
    used, found = bytearray(n), []
    for i in sorted(range(n), key=lambda i: -value[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = 1
            chain.append(i)
            i = parent[i]
        if chain:
            found.append(chain[::-1])
    return found


def chains(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """``(x from, x to, y from, y to, seeds)`` of ``linked``, ends exclusive."""
    return [(int(x[c[0]]), int(x[c[-1]]) + K, int(y[c[0]]), int(y[c[-1]]) + K, len(c)) for c in linked(x, y)]


_CHAIN = "id long, part long, other long, other_part long, x0 int, x1 int, low int, high int, x array<int>, y array<int>"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by pair, then place; a pair may go on in the next batch.

    ``low`` and ``high`` bound y - x over the matches ``x, y`` of a chain.
    """
    names = ["id", "part", "other", "other_part"]
    kept: list[np.ndarray] | None = None

    def found(columns: list[np.ndarray], last: bool):
        n = len(columns[0])
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0)) + 1
        bounds = [0, *new.tolist(), n]
        done = len(bounds) - 1 if last else len(bounds) - 2
        out = []
        for a, b in zip(bounds[:done], bounds[1 : done + 1], strict=True):
            pair = [int(c[a]) for c in columns[:4]]
            x, y = columns[4][a:b], columns[5][a:b]
            if b - a > 1:  # rows that are alike in all give equal matches
                fresh = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
                x, y = x[fresh], y[fresh]
            for chain in linked(x, y) if len(x) > 1 else [[0]]:
                cx, cy = x[chain], y[chain]
                apart = cy - cx
                out.append((*pair, int(cx[0]), int(cx[-1]) + K, int(apart.min()), int(apart.max()), cx, cy))
        return out, [c[bounds[done] :] for c in columns]

    def emitted(rows):
        types = [*[pa.int64()] * 4, *[pa.int32()] * 4, *[pa.list_(pa.int32())] * 2]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[*names, "x0", "x1", "low", "high", "x", "y"])

    for batch in batches:
        columns = [batch[c].to_numpy() for c in [*names, "pos", "other_pos"]]
        columns = columns if kept is None else [np.concatenate(c) for c in zip(kept, columns, strict=True)]
        if len(columns[0]):
            rows, kept = found(columns, last=False)
            if rows:
                yield emitted(rows)
    if kept is not None and len(kept[0]):
        rows, _ = found(kept, last=True)
        if rows:
            yield emitted(rows)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word hashes of each text, four bytes a word, in rows of BLOCK words."""
    for batch in batches:
        ids, parts = batch["id"].to_numpy(), batch["part"].to_numpy()
        for first, data, offsets in slices(batch["text"]):
            found = words(data, offsets, NON_SPACE)
            bounds = np.searchsorted(found.text, np.arange(len(offsets)))
            short = found.hash.astype("<u4")
            at = [(first + i, k, short[a : min(a + BLOCK, high)].tobytes()) for i, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) for k, a in enumerate(range(low, high, BLOCK))]
            row, block, raw = zip(*at, strict=True) if at else ((), (), ())
            row = np.array(row, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(parts[row]), pa.array(block, pa.int32()), pa.array(raw, pa.binary())], names=["id", "part", "block", "words"])


def blocks(docs: DataFrame) -> DataFrame:
    """``id, part, block, words``; identical rows give one, reduced before they are shuffled."""
    return keyed(docs).mapInArrow(_blocks, "id long, part long, block int, words binary").groupBy("id", "part", "block").agg(F.first("words").alias("words"))


def few_edits(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The edit distance if it is at most ``most``: how far each diagonal gets with ever more edits."""
    stops: dict[int, list[int]] = {}  # of each diagonal: where words differ, then its end

    def slide(i: int, d: int) -> int:
        if d not in stops:
            low, high = max(0, -d), min(len(a), len(b) - d)
            stops[d] = [*(np.flatnonzero(a[low:high] != b[low + d : high + d]) + low).tolist(), high]
        at = bisect_left(stops[d], i)
        return stops[d][at] if at < len(stops[d]) else i

    goal = len(b) - len(a)
    reached = {0: slide(0, 0)}
    for edits in range(most + 1):
        if reached.get(goal, -1) >= len(a):
            return edits
        following = {}
        for d in range(max(-len(a), -edits - 1), min(len(b), edits + 1) + 1):
            i = max(reached.get(d - 1, -1), reached.get(d, -2) + 1, reached.get(d + 1, -2) + 1)
            i = min(i, len(a), len(b) - d)
            if i >= max(0, -d):
                following[d] = slide(i, d)
        reached = following
    return None


def banded(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The edit distance if it is at most ``most``, else something larger."""
    place = np.arange(-most, most + 1)
    row = np.where(place >= 0, place, 10**9).astype(np.int64)
    for i in range(1, len(a) + 1):
        at = i + place  # columns of b, 1-based
        same = b[np.clip(at - 1, 0, len(b) - 1)] == a[i - 1]
        step = np.minimum(row + ~same, np.append(row[1:], 10**9) + 1)
        step[(at < 0) | (at > len(b))] = 10**9
        step[at == 0] = i
        row = np.minimum.accumulate(step - place) + place  # insertions, from the left
        row[(at < 0) | (at > len(b))] = 10**9
    last = len(b) - len(a) + most
    return int(row[last]) if 0 <= last < len(row) else 10**9


def agreement(a: np.ndarray, b: np.ndarray) -> float:
    """Aligned equal words, as a share of the longer side: 1 - edit distance / length."""
    n = max(len(a), len(b))
    if not n:
        return 1.0
    short = min(len(a), len(b))
    unequal = np.flatnonzero(a[:short] != b[:short])
    head = int(unequal[0]) if len(unequal) else short
    a, b = a[head:], b[head:]
    if not len(a) or not len(b):
        return 1 - max(len(a), len(b)) / n
    most = int((1 - SIMILARITY) * n) + 1  # more edits cannot pass
    few = min(most, isqrt(50 * len(a)))  # beyond that, rows are faster than diagonals
    distance = few_edits(a, b, few)
    if distance is None:
        distance = banded(a, b, most) if most > few else n
    return 1 - min(distance, n) / n


def alike(a: np.ndarray, b: np.ndarray) -> int:
    """How many words agree from the start."""
    n, at, step = min(len(a), len(b)), 0, 32
    while at < n:
        stop = min(n, at + step)
        unequal = np.flatnonzero(a[at:stop] != b[at:stop])
        if len(unequal):
            return at + int(unequal[0])
        at, step = stop, 2 * step
    return n


def onward(a: np.ndarray, b: np.ndarray, price: int) -> tuple[int, int]:
    """How far two runs of words go on alike from the start, unequal words among them, and how many of those.

    An equal word gains 1 and an unequal one costs ``price``; the run ends where the sum is largest, and is
    given up where it lies ``DROP`` below that.
    """
    near = -(-DROP // price)
    if not (a[: min(near, len(b))] == b[: min(near, len(a))]).any():  # given up before anything is gained
        return 0, 0
    n, at, size, total, best, end, unequal, bad = min(len(a), len(b)), 0, 128, 0, 0, 0, 0, 0
    while at < n:
        stop = min(n, at + size)
        same = a[at:stop] == b[at:stop]
        sums = total + np.cumsum(np.where(same, 1, -price))
        tops = np.maximum.accumulate(np.maximum(sums, best))
        lost = np.flatnonzero(tops - sums >= DROP)
        seen = int(lost[0]) if len(lost) else len(sums)
        if seen and int(sums[:seen].max()) > best:
            k = int(sums[:seen].argmax())
            best, end, bad = int(sums[k]), at + k + 1, unequal + int(np.count_nonzero(~same[: k + 1]))
        if len(lost):
            break
        unequal += int(np.count_nonzero(~same))
        total, at, size = int(sums[-1]), stop, 2 * size
    return end, bad


def extended(a: np.ndarray, b: np.ndarray, x: tuple[int, int], y: tuple[int, int], price: int) -> tuple[int, int, int]:
    """How many words before and after the spans belong to them, and how many of those are unequal."""
    before, left = onward(a[: x[0]][::-1], b[: y[0]][::-1], price)
    after, right = onward(a[x[1] :], b[y[1] :], price)
    return before, after, left + right


def gap_edits(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """From each match to the next: no fewer edits than it takes, exact where both sides are short.

    Matches of one distance are compared word by word, all at once; where the distance changes, the
    words between two matches are aligned.
    """
    apart, out = y - x, np.zeros(len(x) - 1, np.int64)
    turns = np.flatnonzero(np.diff(apart))
    starts, ends = np.append(0, turns + 1), np.append(turns, len(x) - 1)
    for i, j in zip(starts.tolist(), ends.tolist(), strict=True):
        if j > i:
            x0, x1 = int(x[i]), int(x[j])
            unequal = np.append(0, np.cumsum(a[x0:x1] != b[x0 + apart[i] : x1 + apart[i]]))
            out[i:j] = np.diff(unequal[x[i : j + 1] - x0])
    for i in turns.tolist():
        left, right = a[x[i] : x[i + 1]], b[y[i] : y[i + 1]]
        head = alike(left, right)
        left, right = left[head:], right[head:]
        tail = alike(left[::-1], right[::-1])
        left, right = left[: len(left) - tail], right[: len(right) - tail]
        edits = max(len(left), len(right))
        if len(left) and len(right):
            if len(left) == len(right):
                edits = int(np.count_nonzero(left != right))
            if 1 < edits <= 32:
                edits = few_edits(left, right, edits)
        out[i] = edits
    return out


#: What an unequal word costs an extension: first little, then so much that no extension lowers an agreement below SIMILARITY.
PRICES, DROP = (2, 4), 12
#: Chains that miss SIMILARITY by their seeds' alignment, but not this, are aligned afresh.
NEARLY = 0.7


def agreeing(a: np.ndarray, b: np.ndarray, x: list[int], y: list[int]) -> Iterator[tuple[int, int, int, int, int, float]]:
    """``(x from, x to, y from, y to, seeds, identity)`` of a chain of matches, or of its parts.

    The alignment goes through the matches, and ``identity`` is the share of words that it leaves
    unedited. A chain that agrees in too few words is cut where most edits lie between two
    matches, until each part agrees; one match alone always does.
    """
    xs, ys = np.array(x), np.array(y)
    edits = np.append(0, np.cumsum(gap_edits(a, b, xs, ys))) if len(x) > 1 else np.zeros(1, np.int64)
    todo = [(0, len(x))]
    while todo:
        low, high = todo.pop()
        span = (x[low], x[high - 1] + K), (y[low], y[high - 1] + K)
        made, size = int(edits[high - 1] - edits[low]), max(span[0][1] - span[0][0], span[1][1] - span[1][0])
        if made <= (1 - NEARLY) * size:
            for price in PRICES:
                before, after, unequal = extended(a, b, *span, price)
                x0, x1, y0, y1 = span[0][0] - before, span[0][1] + after, span[1][0] - before, span[1][1] + after
                identity = 1 - (made + unequal) / (size + before + after)
                if identity >= SIMILARITY:
                    break
            else:
                identity = agreement(a[x0:x1], b[y0:y1])
            if identity >= SIMILARITY:
                yield x0, x1, y0, y1, high - low, identity
                continue
        if high - low > 1:
            cut = low + 1 + int(np.diff(edits[low:high]).argmax())
            todo += [(cut, high), (low, cut)]


def pieces(a: np.ndarray, b: np.ndarray, found: list[tuple[list[int], list[int]]]) -> list[tuple[int, int, int, int, int, float]]:
    """What agrees of the chains of a pair, in order; pieces that touch have MIN_CHAIN words or more."""
    covered, out = np.zeros(len(a), bool), []
    for x, y in sorted(found, key=lambda c: (-len(c[0]), c)):
        if not covered[x[0] : x[-1] + K].all():
            for piece in agreeing(a, b, x, y):
                covered[piece[0] : piece[1]] = True
                out.append(piece)
    kept, island, reach = [], [], 0
    for piece in [*sorted(out), None]:
        if island and (piece is None or piece[0] > reach + TOUCH):
            if reach - island[0][0] >= MIN_CHAIN:
                kept += island
            island, reach = [], 0
        if piece is not None:
            island.append(piece)
            reach = max(reach, piece[1])
    return kept


_ALIGNED = "id long, part long, other long, other_part long, x0 int, x1 int, y0 int, y1 int, seeds int, identity double"


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [*[pa.int64()] * 4, *[pa.int32()] * 5, pa.float64()]
    names = [c.split()[0] for c in _ALIGNED.split(", ")]
    for batch in batches:
        rows, columns = [], [batch[c].to_pylist() for c in batch.schema.names]
        for values in zip(*columns, strict=True):
            at = dict(zip(batch.schema.names, values, strict=True))
            a, b = (np.frombuffer(b"".join([x["words"] for x in at["read"] if x["side"] == side]), "<u4") for side in (0, 1))
            a0, b0 = at["a0"], at["b0"]
            found = [([v - a0 for v in c["x"]], [v - b0 for v in c["y"]]) for c in at["chains"]]
            pair = [at[c] for c in names[:4]]
            rows += [(*pair, x0 + a0, x1 + a0, y0 + b0, y1 + b0, seeds, identity) for x0, x1, y0, y1, seeds, identity in pieces(a, b, found)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def grouped(found: DataFrame) -> DataFrame:
    """The chains of each pair by region of the document that shared words may fill, and the words to read.

    Words that agree go on from a seed to the next, whatever its first occurrence, and less than
    THIN words beyond the last. So no passage leaves its region, and none is in one too small.
    """
    pair = ["id", "part", "other", "other_part"]
    doc = W.partitionBy("id", "part").orderBy("x0", "x1", "other", "other_part", "low")
    reach = F.max("x1").over(doc.rowsBetween(W.unboundedPreceding, -1))
    regions = found.withColumn("new", F.when(F.col("x0") <= reach + TOUCH + 2 * THIN, 0).otherwise(1)).withColumn("region", F.sum("new").over(doc.rowsBetween(W.unboundedPreceding, 0)))
    region = W.partitionBy("id", "part", "region")
    sized = regions.withColumn("a0", F.greatest(F.lit(0), F.min("x0").over(region) - THIN)).withColumn("a1", F.max("x1").over(region) + THIN)
    gathered = sized.groupBy(*pair, "a0", "a1").agg(F.collect_list(F.struct("x", "y")).alias("chains"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("x0").alias("first"), F.max("x1").alias("last"), F.sum(F.size("x")).alias("n"))
    gathered = gathered.where((F.col("a1") - F.col("a0") >= MIN_WORDS) | (F.col("n") >= FEW))
    gathered = gathered.withColumn("a0", F.greatest(F.lit(0), F.col("first") - MARGIN)).withColumn("a1", F.col("last") + MARGIN)
    return gathered.select(*pair, "chains", "a0", "a1", F.greatest(F.lit(0), F.col("a0") + F.col("low")).alias("b0"), (F.col("a1") + F.col("high")).alias("b1"))


def aligned(docs: DataFrame) -> DataFrame:
    """Parts of chains whose words agree: ``id, part, other, other_part, x0, x1, y0, y1, seeds, identity``."""
    pair = ["id", "part", "other", "other_part"]
    repeated = repeated_seeds(docs)
    sorted_matches = matches(repeated).repartition(*pair).sortWithinPartitions(*pair, "pos", "other_pos")
    found = sorted_matches.mapInArrow(_chain, _CHAIN)
    groups = written(grouped(found).withColumn("group", F.monotonically_increasing_id()), "chains")
    forget(repeated)
    spans = groups.select("group", "id", "part", F.col("a0").alias("a"), F.col("a1").alias("b"), F.lit(0).alias("side")).unionByName(
        groups.select("group", F.col("other").alias("id"), F.col("other_part").alias("part"), F.col("b0").alias("a"), F.col("b1").alias("b"), F.lit(1).alias("side"))
    )
    # Of each document only the blocks that a span touches go on, and of those only the span's words.
    first, last = F.expr(f"cast(a div {BLOCK} as int)"), F.expr(f"cast(greatest(a, b - 1) div {BLOCK} as int)")
    touched = spans.withColumn("block", F.explode(F.sequence(first, last)))
    low, high = F.greatest(F.col("a") - F.col("block") * BLOCK, F.lit(0)), F.least(F.col("b") - F.col("block") * BLOCK, F.lit(BLOCK))
    read = touched.join(blocks(docs).hint("merge"), ["id", "part", "block"]).select("group", "side", "block", F.substring("words", (low * 4 + 1).cast("int"), ((high - low) * 4).cast("int")).alias("words"))
    gathered = read.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("side", "block", "words"))).alias("read"))
    return groups.join(gathered.hint("merge"), "group").select(*pair, "chains", "a0", "b0", "read").mapInArrow(_align, _ALIGNED)


def passages(docs: DataFrame) -> DataFrame:
    """Aligned chains with the merged passage that each belongs to, of MIN_WORDS words or more."""
    doc = W.partitionBy("id", "part").orderBy("x0", "x1", "other", "other_part", "y0")
    reach = F.max("x1").over(doc.rowsBetween(W.unboundedPreceding, -1))
    islands = aligned(docs).withColumn("new", F.when(F.col("x0") <= reach + TOUCH, 0).otherwise(1)).withColumn("island", F.sum("new").over(doc.rowsBetween(W.unboundedPreceding, 0)))
    island = W.partitionBy("id", "part", "island")
    sized = islands.withColumn("passage_start", F.min("x0").over(island)).withColumn("passage_end", F.max("x1").over(island))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return sized.where(F.col("passage_end") - F.col("passage_start") >= MIN_WORDS).select(
        real("id").alias("doc_id"), "part", F.col("x0").alias("start_word"), F.col("x1").alias("end_word"), real("other").alias("other_id"),
        F.col("y0").alias("other_start"), F.col("y1").alias("other_end"), "seeds", F.round("identity", 6).alias("identity"), "passage_start", "passage_end",
    )


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, cuts in zip(batch["text"].to_pylist(), batch["weftline_cuts"].to_pylist(), strict=True):
            if text is not None and cuts:
                raw = text.encode()
                data = np.frombuffer(raw, np.uint8)
                found = words(data, np.array([0, len(data)]), NON_SPACE)
                pieces, at = [], 0
                for cut in sorted(cuts, key=lambda c: c["passage_start"]):
                    a, b = int(found.start[cut["passage_start"]]), int(found.end[cut["passage_end"] - 1])
                    pieces.append(raw[at:a])
                    at = b
                text = b"".join([*pieces, raw[at:]]).decode()
            out.append(text)
        columns = [pa.array(out, batch.schema.field("text").type) if c == "text" else batch[c] for c in batch.schema.names if c != "weftline_cuts"]
        yield pa.RecordBatch.from_arrays(columns, names=[c for c in batch.schema.names if c != "weftline_cuts"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with every repeated passage cut from all documents but the first that holds it."""
    cuts = passages(docs).select(F.col("doc_id").alias("weftline_id"), F.col("part").alias("weftline_part"), "passage_start", "passage_end").distinct()
    cuts = cuts.groupBy("weftline_id", "weftline_part").agg(F.collect_list(F.struct("passage_start", "passage_end")).alias("weftline_cuts"))
    marked = docs.withColumn("weftline_of", F.xxhash64(whole()))
    same = marked["doc_id"].eqNullSafe(cuts["weftline_id"]) & (marked["weftline_of"] == cuts["weftline_part"])
    joined = marked.join(cuts, same, "left").select(*docs.columns, "weftline_cuts")
    return joined.mapInArrow(_without, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(documents(spark, sf_dir)).drop("part")


QUERIES = {"op8_passages": op8}
ORACLES: dict[str, str] = {}
