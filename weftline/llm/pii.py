"""Operator 9, personal data: fixed patterns, and a bootstrapped contextual extraction on top.

The fixed patterns (email, ip, card, phone) give the base spans; they are also the seeds. Texts are
read as words, parted by white space and by base spans. A mention, that is a base span or a word of
four digits or more, has lexical patterns: the two words before it, and the words on either side of
it. Spark scores the graph of patterns and instances in rounds: a pattern is as reliable, for a
kind, as the mean score of the instances it surrounds, if enough of them support it; an instance
scores by the reliable patterns that surround it.

Reliable patterns then propose identifiers of any form: a second scan takes the word, or the run of
words of digits and marks, that such a pattern surrounds, anywhere in the corpus. A pattern's
confidence is counted anew over all that it surrounds there, ordinary words included, so one that
merely precedes identifiers now and then falls. What scores ``ACCEPT`` or more is added as a span of
that kind. The second scan skips words by a bitmap of ``BITMAP`` bits, whatever the number of
patterns; the patterns themselves are joined. Base spans always stay.

Cases: null text counts as empty; repeated rows and rows with the same or a null id are handled
one by one; an empty table gives an empty result; extra columns are ignored. All scans are linear
in the length of a text, whatever it holds.

Skew: a word pair may surround a large share of all mentions. Edges are made distinct and summed
before they are shuffled, and the joins are sort-merge joins that AQE can split.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.scratch import written
from weftline.llm.text import documents, whole

KINDS = ("email", "ip", "card", "phone")
ROUNDS, SUPPORT, RELIABLE, ACCEPT = 3, 5, 0.5, 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"\S+")
_NUMBER = re.compile(r"(?=[^0-9]*+[0-9])[0-9()+./#-]++")
#: Bits of the filters that the second scan takes: half a megabyte each.
BITMAP = 1 << 22
#: Longer words are named by a digest.
LONG_WORD = 64


def emails(text: str) -> list[tuple[int, int]]:
    """Looks back from each @ to where its name may begin, so that no character is read twice."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if place % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by kind as listed, then start; code points, end exclusive."""
    out = [("email", *x) for x in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _word(word: str) -> str:
    plain = "".join("0" if c.isdigit() else c for c in word.lower().strip(".,;:!?()[]{}\"'*$%&#|"))
    return plain if len(plain) <= LONG_WORD else "#" + hashlib.sha256(plain.encode()).hexdigest()


def tokens(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, bool]]:
    """``(start, end, whether base spans)``: words, parted by base spans; those that overlap are one token."""
    islands: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if islands and a < islands[-1][1]:
            islands[-1][1] = max(islands[-1][1], b)
        else:
            islands.append([a, b])
    out, done, k = [], 0, 0
    for m in _WORD.finditer(text):
        at, stop = max(m.start(), done), m.end()
        while k < len(islands) and islands[k][0] < stop:
            a, done = islands[k]
            if a > at:
                out.append((at, a, False))
            out.append((a, done, True))
            at, k = max(at, done), k + 1
        if at < stop:
            out.append((at, stop, False))
    return out


def _context(text: str, found: list[tuple[int, int, bool]]):
    """The word at a place of ``found``, as contexts name it; none beyond the ends."""
    return lambda i: "<id>" if found[i][2] else _word(text[found[i][0] : found[i][1]])


def lexical_patterns(named, n: int, first: int, last: int) -> list[str]:
    """The patterns around the tokens from ``first`` to ``last`` of ``n``."""
    left = named(first - 1) if first else None
    found = []
    if first > 1:
        earlier = named(first - 2)
        if earlier or left:
            found.append(f"L\t{earlier}\t{left}")
    if left is not None and last + 1 < n:
        right = named(last + 1)
        if left or right:
            found.append(f"B\t{left}\t{right}")
    return found


def mentions(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    """Base spans, then words with four digits or more that touch none of them."""
    if not base and not _DIGIT.search(text):
        return []
    found, out, around = tokens(text, base), [], {}
    named, n = _context(text, found), len(found)
    for i, (start, end, is_base) in enumerate(found):
        if is_base:
            around[start] = lexical_patterns(named, n, i, i)
            continue
        beside = (i and found[i - 1][2] and found[i - 1][1] == start) or (i + 1 < n and found[i + 1][2] and found[i + 1][0] == end)
        word = text[start:end]
        if not beside and sum("0" <= c <= "9" for c in word) >= 4:
            out.append({"kind": None, "start": start, "end": end, "instance": word.lower(), "patterns": lexical_patterns(named, n, i, i)})
    starts = sorted(around)
    return [{"kind": k, "start": a, "end": b, "instance": text[a:b].lower(), "patterns": around[starts[bisect_right(starts, a) - 1]]} for k, a, b in base] + out


_MENTION = "array<struct<kind:string,start:long,end:long,instance:string,patterns:array<string>>>"
_MENTION_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))
_SCANNED = f"doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, mentions {_MENTION}"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, found = [], [], []
        for text in batch["text"].to_pylist():
            base = base_spans(text)
            kinds = [k for k, _, _ in base]
            counts.append([kinds.count(k) for k in KINDS])
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            found.append(mentions(text, base))
        by_kind = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["text_key"], *by_kind, pa.array(digests, pa.string()), pa.array(found, _MENTION_TYPE)],
            names=["doc_id", "text_key", *[f"n_{k}" for k in KINDS], "base_sha256", "mentions"],
        )


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, text``; rows alike in the first two have the same text, so the same spans."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole()).alias("text_key"), whole().alias("text"))


def scanned(docs: DataFrame) -> DataFrame:
    """Base counts and digest, and all mentions, of each row; written out."""
    return written(keyed(docs).mapInArrow(_scan, _SCANNED), "mentions")


def graph(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``seeds`` (instance, kind), ``scores`` (instance, kind, score) and ``reliable`` (pattern, kind, weight, confidence, and the number of seeds of any kind)."""
    each = found.select(F.explode("mentions").alias("m"))
    edges = written(each.select(F.col("m.instance").alias("instance"), F.explode("m.patterns").alias("pattern")).distinct(), "pattern-edges")
    seeds = each.where("m.kind IS NOT NULL").groupBy(F.col("m.instance").alias("instance"), F.col("m.kind").alias("kind")).agg(F.lit(1.0).alias("score"))
    seeds = written(seeds, "seeds")
    known = seeds.select("instance").distinct().hint("merge")
    degrees = edges.join(known.withColumn("of_seeds", F.lit(1)).hint("merge"), "instance", "left").groupBy("pattern").agg(F.count("*").alias("degree"), F.count("of_seeds").alias("seeds"))
    degrees = written(degrees.where(F.col("degree") >= support), "pattern-degrees")
    scores = reliable = seeds
    for _ in range(rounds):
        backed = edges.join(scores.hint("merge"), "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("weight")).where(F.col("weight") >= support)
        rated = backed.join(degrees.hint("merge"), "pattern").withColumn("confidence", F.col("weight") / F.col("degree"))
        reliable = written(rated.where(F.col("confidence") >= RELIABLE).select("pattern", "kind", "weight", "confidence", "seeds"), "reliable-patterns")
        votes = edges.join(reliable.hint("merge"), "pattern")
        raised = votes.groupBy("instance", "kind").agg(_either("confidence").alias("score")).join(known, "instance", "left_anti")
        scores = written(seeds.unionByName(raised), "instance-scores")
    return seeds, scores, reliable


def _either(confidence: str) -> Column:
    """The chance that at least one of several patterns is right."""
    return 1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col(confidence)))))


def accepted(scores: DataFrame, seeds: DataFrame) -> DataFrame:
    """``instance, kind``: the best kind of each unseen instance that scores ``ACCEPT`` or more."""
    fresh = scores.join(seeds.select("instance").distinct().hint("merge"), "instance", "left_anti").where(F.col("score") >= ACCEPT)
    return fresh.groupBy("instance").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))


def discovered(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT) -> DataFrame:
    """``instance, kind``: unseen mentions that reliable patterns surround."""
    seeds, scores, _ = graph(found, rounds, support)
    return accepted(scores, seeds)


def bitmap(values: DataFrame) -> bytes:
    """A filter of ``BITMAP`` bits over a column of strings, built by Spark; at most 128 rows of 4 KB come here."""
    place = F.pmod(F.xxhash64(values.columns[0]), F.lit(BITMAP))
    rows = values.select(place.alias("place")).groupBy((F.col("place") / 32768).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.col("place") % 32768).alias("bits")).collect()
    out = bytearray(BITMAP // 8)
    for r in rows:
        out[r["part"] * 4096 : r["part"] * 4096 + len(r["bits"])] = r["bits"]
    return bytes(out)


def _hit(bits: bytes, value: str) -> bool:
    place = xxhash.xxh64_intdigest(value.encode(), 42) % BITMAP
    return bool(bits[place >> 3] >> (place & 7) & 1)


_TRIM_LEFT, _TRIM_RIGHT = "\"'([{<", "\"')]}>.,;:!?"


def surrounded(text: str, left, wanted) -> list[tuple[str, int, int]]:
    """``(pattern, start, end)`` of the words, or runs of number-like words, in wanted patterns.

    ``left``: whether a word may be next to something sought; ``wanted``: whether a pattern is.
    """
    if not any(map(left, text.split())):
        return []
    found, out = tokens(text, base_spans(text)), []
    named, n = _context(text, found), len(found)
    numbers = [not is_base and _NUMBER.fullmatch(text, a, b) is not None for a, b, is_base in found]
    for i in range(1, n):
        a, b, is_base = found[i]
        if is_base or (numbers[i] and numbers[i - 1]) or not (found[i - 1][2] or left(text[found[i - 1][0] : found[i - 1][1]])):
            continue
        last = i
        while numbers[i] and last + 1 < n and numbers[last + 1]:
            last += 1
        b = found[last][1]
        if not numbers[i]:
            while a < b and text[a] in _TRIM_LEFT:
                a += 1
        while a < b and text[b - 1] in (".,;:!?" if numbers[i] else _TRIM_RIGHT):
            b -= 1
        if a < b:
            out += [(p, a, b) for p in lexical_patterns(named, n, i, last) if wanted(p)]
    return out


class _Left(dict):
    """Whether a word is a left neighbour in the filter, remembered for words up to a bound."""

    def __init__(self, bits: bytes):
        super().__init__()
        self.bits = bits

    def __missing__(self, word: str) -> bool:
        found = _hit(self.bits, _word(word))
        if len(self) < 200_000 and len(word) < LONG_WORD:
            self[word] = found
        return found


_PROPOSED = "doc_id long, text_key long, pattern string, instance string, start long, end long"


def _propose(filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_bits, pattern_bits = filters.value
        left = _Left(left_bits).__getitem__
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = []
            for doc_id, key, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "text_key", "text")), strict=True):
                rows += [(doc_id, key, p, text[a:b].lower(), a, b) for p, a, b in surrounded(text, left, lambda p: _hit(pattern_bits, p))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in _PROPOSED.split(", ")])

    return run


def proposed(docs: DataFrame, reliable: DataFrame, seeds: DataFrame) -> DataFrame:
    """``doc_id, text_key, kind, start, end``: what reliable patterns surround, if it scores ``ACCEPT`` or more."""
    patterns = reliable.select("pattern").distinct()
    parts = F.split("pattern", "\t")
    left = reliable.select(F.when(parts[0] == "L", parts[2]).otherwise(parts[1]).alias("word")).distinct()
    shared = docs.sparkSession.sparkContext.broadcast((bitmap(left), bitmap(patterns)))
    places = written(keyed(docs).mapInArrow(_propose(shared), _PROPOSED), "proposed")
    edges = written(places.select("instance", "pattern").distinct().join(patterns.hint("merge"), "pattern"), "proposed-edges")
    unseen = edges.groupBy("pattern").agg(F.count("*").alias("unseen"))
    # Everything that a pattern surrounds counts now: the seeds, and all that is not one.
    rated = reliable.join(unseen.hint("merge"), "pattern").withColumn("confidence", F.least(F.lit(1.0), F.col("weight") / (F.col("seeds") + F.col("unseen"))))
    scores = edges.join(rated.select("pattern", "kind", "confidence").hint("merge"), "pattern").groupBy("instance", "kind").agg(_either("confidence").alias("score"))
    return places.join(accepted(scores, seeds).hint("merge"), "instance").select("doc_id", "text_key", "kind", "start", "end").distinct()


def extract(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: base counts and digest, and all spans in order."""
    found = scanned(docs)
    seeds, scores, reliable = graph(found)
    fresh = written(accepted(scores, seeds), "discovered")
    unseen = found.select("doc_id", "text_key", F.explode("mentions").alias("m")).where("m.kind IS NULL").select("doc_id", "text_key", F.col("m.instance").alias("instance"), F.col("m.start").alias("start"), F.col("m.end").alias("end"))
    more = unseen.join(fresh.hint("merge"), "instance").select("doc_id", "text_key", "kind", "start", "end").distinct()
    if reliable.limit(1).count():
        more = more.unionByName(proposed(docs, reliable, seeds)).distinct()
        # Of spans that overlap, the first and longest stays; a text's spans fit in a task as the text does.
        text = W.partitionBy("doc_id", "text_key").orderBy("start", F.desc("end"), "kind")
        reach = F.max("end").over(text.rowsBetween(W.unboundedPreceding, -1))
        more = more.withColumn("reach", F.coalesce(reach, F.lit(0))).where("start >= reach").drop("reach")
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = lambda kind, start, end: F.struct(order.alias("o"), start.alias("start"), end.alias("end"), kind.alias("kind"))
    added = more.groupBy(F.col("doc_id").alias("in_doc"), F.col("text_key").alias("in_text")).agg(F.collect_list(span(F.col("kind"), F.col("start"), F.col("end"))).alias("added"))
    base = F.transform(
        F.filter("mentions", lambda m: m["kind"].isNotNull()),
        lambda m: F.struct(F.array_position(F.array(*[F.lit(k) for k in KINDS]), m["kind"]).alias("o"), m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind")),
    )
    both = F.sort_array(F.concat(base, F.coalesce("added", F.array().cast("array<struct<o:bigint,start:bigint,end:bigint,kind:string>>"))))
    text = F.array_join(F.transform(both, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    same = (found["text_key"] == added["in_text"]) & found["doc_id"].eqNullSafe(added["in_doc"])
    return found.join(added.hint("merge"), same, "left").select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", text.alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_discovered"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(documents(spark, sf_dir))


QUERIES = {"op9_pii": op9}
ORACLES: dict[str, str] = {}
