"""Operator 12, conversation repair: run-length dynamic programming over roles and faults.

Rows are sorted by conversation and turn over range partitions, each row with a number of its own as the
last key, so that even equal rows of one conversation are spread. A task streams its rows: a conversation
that lies inside the partition and within the bounds of a piece is repaired on the spot. The others, that
is the first and last of each partition and those that are too long, are written as pieces of bounded
size and put together by their summaries:

1. each piece gives its counts and its transition, a 4 x 4 min-plus matrix (``minplus``);
2. per conversation, costs to go are carried from the last piece to the first, 16 numbers a piece;
3. each piece, knowing its costs to go, tells in which state it ends for each state it may begin in;
4. per conversation, states are carried from the first piece to the last;
5. each piece writes its edits and its repaired rows;
6. per conversation, edits are joined and the repaired rows hashed as a stream, piece by piece, since a
   hash is sequential. No step holds more than one piece of text.

Within a piece, equal consecutive symbols are runs, advanced through cached binary powers.

Faults: blank, duplicate (role and text seen earlier in the conversation), truncated. A row with a null
role or text has a space there. Rows go by turn, nulls first; rows of one turn by the SHA-256 of role and
text, so that repeats are adjacent. Roles are told apart by their initial; any but s, u and a fits nowhere
and is illegal next to all. Rows for which ``present`` is false are not there, but their conversation
is: a conversation without rows has zeros, no edits and the hash of nothing. A null ``conv_id`` is a
conversation like any other. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weftline.llm import minplus
from weftline.llm.minplus import END, FREE, MUST_GO, PRICED
from weftline.llm.scratch import written

#: A piece of a conversation has at most so many rows and, but for its last row, so many code points.
PIECE_ROWS, PIECE_CHARS = 4096, 4_000_000
_BLANKS = " \t\n\x0b\x0c\r"
_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ROW = "part int, piece int, seq long, turn long, role string, text string, digest binary, present boolean, is_blank boolean, is_cut boolean"
_COUNTS = "rows long, blank long, duplicate long, truncated long, illegal long, head string, tail string, turns long, low long, high long"


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


@dataclass
class Counts:
    """What a piece counts; ``head`` and ``tail`` are its first and last initials, ``low`` and ``high`` turns."""

    rows: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    head: str | None = None
    tail: str | None = None
    turns: int = 0
    low: int | None = None
    high: int | None = None

    def then(self, next_: Counts) -> Counts:
        if not self.rows or not next_.rows:
            return self if self.rows else next_
        own = lambda name: getattr(self, name) + getattr(next_, name)
        known = [x for x in (self.low, next_.low) if x is not None]
        return Counts(
            *(own(n) for n in ("rows", "blank", "duplicate", "truncated")), own("illegal") + (self.tail + next_.head not in ("su", "ua", "au")), self.head, next_.tail,
            own("turns") - (self.high is not None and self.high == next_.low), known[0] if known else None, next_.high if next_.high is not None else self.high,
        )

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def judged(rows: list[dict]) -> tuple[Counts, list[int]]:
    """Counts and symbols of the rows that are there; ``first`` says that no earlier row is the same."""
    counts, symbols = Counts(), []
    for r in rows:
        blank, again = r["is_blank"], not r["is_blank"] and not r["first"]
        cut = r["is_cut"] and not blank and not again
        initial, turn = r["role"][:1], r["turn"]
        counts = counts.then(Counts(1, int(blank), int(again), int(cut), 0, initial, initial, int(turn is not None), turn, turn))
        symbols.append(minplus.symbol(initial, MUST_GO if blank or again else PRICED if cut else FREE))
    return counts, symbols


def edited(rows: list[dict], audit: str, state: int) -> str:
    """The repaired rows, a line each, or no text if none are left."""
    left, at = [], iter(rows)
    for letter in audit:
        role, row = minplus.WANTED[state], next(at) if letter != "I" else None
        if letter == "D":
            continue
        if letter == "K":
            role = row["role"]
            state = minplus.S if role.startswith("s") else minplus.NEXT[state]
        else:
            state = minplus.NEXT[state]
        left.append(f"{role}:{row['text'] if row else ''}")
    return "\n".join(left)


def repaired_rows(rows: list[dict]) -> dict:
    """A whole conversation at once."""
    rows = [r for r in rows if r["present"]]
    seen: set[bytes] = set()
    for r in rows:
        r["first"] = r["digest"] not in seen
        seen.add(r["digest"])
    counts, symbols = judged(rows)
    runs = minplus.collapse(symbols)
    audit, state = minplus.unrolled(runs, END, minplus.START)
    audit += minplus.closing(state)
    cost = minplus.apply(minplus.product(runs), END)[minplus.START]
    text = edited(rows, audit, minplus.START)
    return {"gaps": counts.gaps(), **{k: getattr(counts, k) for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}


def _stream(batches: Iterator[pa.RecordBatch], schema: pa.Schema, most_rows: int, most_chars: int) -> Iterator[pa.RecordBatch]:
    """Rows in order; repairs the conversations that are whole here, and hands on the others in pieces."""
    part, piece, seq = TaskContext.get().partitionId(), 0, 0
    held: list[dict] = []
    chars, open_, last = 0, True, []  # the first conversation may have begun in another partition

    def flush(whole: bool) -> Iterator[dict]:
        nonlocal piece, seq, chars
        if whole:
            yield {"conv_id": held[0]["conv_id"], "done": repaired_rows(held)}
        else:
            for r in held:
                yield {"conv_id": r["conv_id"], "row": {"part": part, "piece": piece, "seq": seq} | r}
                seq += 1
            piece += 1
        held.clear()
        chars = 0

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if last and r["conv_id"] != last[0]:
                out += flush(not open_) if held else ()
                open_ = False
            last = [r["conv_id"]]
            held.append(r)
            chars += len(r["text"])
            if len(held) >= most_rows or chars >= most_chars:
                open_ = True
                out += flush(False)
        if out:
            yield _rows(out, schema)
    if held:
        yield _rows(list(flush(False)), schema)


def _summed(table: pa.Table, schema: pa.Schema) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["seq"])
    counts, symbols = judged([r for r in rows if r["present"]])
    runs = minplus.collapse(symbols)
    row = {k: rows[0][k] for k in ("conv_id", "part", "piece")} | {"counts": vars(counts), "matrix": [x for line in minplus.product(runs) for x in line], "symbols": [s for s, _ in runs], "lengths": [n for _, n in runs]}
    return pa.Table.from_batches([_rows([row], schema)])


def _carried_back(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """Costs to go after each piece; the conversation's counts and cost beside its first piece."""
    pieces = sorted(table.to_pylist(), key=lambda r: (r["part"], r["piece"]))
    to_go, counts, out = END, Counts(), []
    for p in reversed(pieces):
        out.append({k: p[k] for k in ("conv_id", "part", "piece")} | {"after": list(to_go)})
        to_go = minplus.apply([p["matrix"][k : k + 4] for k in (0, 4, 8, 12)], to_go)
        counts = Counts(**p["counts"]).then(counts)
    out[0]["last"] = True
    out[-1] |= {"total": {"gaps": counts.gaps(), **{k: getattr(counts, k) for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": to_go[minplus.START]}}
    return pa.Table.from_batches([_rows(out, schema)])


def _exits(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            runs = list(zip(r.pop("symbols"), r.pop("lengths"), strict=True))
            r["exits"] = [minplus.unrolled(runs, tuple(r["after"]), s)[1] for s in range(4)]
        yield _rows(rows, schema)


def _carried_on(table: pa.Table, schema: pa.Schema) -> pa.Table:
    pieces, state = sorted(table.to_pylist(), key=lambda r: (r["part"], r["piece"])), minplus.START
    for p in pieces:
        p["entry"], state = state, p.pop("exits")[state]
    return pa.Table.from_batches([_rows(pieces, schema)])


def _edited(left: pa.Table, right: pa.Table, schema: pa.Schema) -> pa.Table:
    rows, (piece,) = sorted(left.to_pylist(), key=lambda r: r["seq"]), right.to_pylist()
    rows = [r for r in rows if r["present"]]
    audit, state = minplus.unrolled(minplus.collapse(judged(rows)[1]), tuple(piece["after"]), piece["entry"])
    audit += minplus.closing(state) if piece["last"] else ""
    row = {k: piece[k] for k in ("conv_id", "part", "piece", "total")} | {"audit": audit, "text": edited(rows, audit, piece["entry"])}
    return pa.Table.from_batches([_rows([row], schema)])


def _hashed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pieces in order: edits joined, texts hashed as they pass."""
    state: dict | None = None

    def close() -> pa.RecordBatch:
        return _rows([{"conv_id": state["conv_id"], "done": state["total"] | {"audit": "".join(state["audit"]), "repaired_sha256": state["hash"].hexdigest()}}], schema)

    for batch in batches:
        for r in batch.to_pylist():
            if r["total"] is not None:  # a conversation's first piece
                if state:
                    yield close()
                state = {"conv_id": r["conv_id"], "total": r["total"], "audit": [], "hash": hashlib.sha256(), "any": False}
            state["audit"].append(r["audit"])
            if r["text"]:
                state["hash"].update((("\n" if state["any"] else "") + r["text"]).encode())
                state["any"] = True
    if state:
        yield close()


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def marked(rows: DataFrame, present: Column) -> DataFrame:
    """``conv_id, turn, role, text, digest, present, is_blank, is_cut``."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    found = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), present.alias("present"))
    end = F.rtrim("text", F.lit(_BLANKS))
    same = F.substring(F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)), 1, 16)
    return found.select("*", same.alias("digest"), (end == "").alias("is_blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("is_cut"))


def repaired(rows: DataFrame, present: Column | None = None, piece_rows: int = PIECE_ROWS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("digest"), F.asc("own")]
    ordered = marked(rows, F.lit(True) if present is None else present).withColumn("own", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order).drop("own")
    first = f"conv_id {kind}, done struct<{_RESULT.replace(' ', ':').replace(',:', ',')}>, row struct<{_ROW.replace(' ', ':').replace(',:', ',')}>"
    found = written(ordered.mapInArrow(partial(_stream, schema=_arrow(first), most_rows=piece_rows, most_chars=piece_chars), first), "conversations")
    whole = found.where("done IS NOT NULL").select("conv_id", "done.*")
    return whole.unionByName(_joined(found.where("row IS NOT NULL").select("conv_id", "row.*"), kind))


def _grouped(f: Callable[[pa.Table, pa.Schema], pa.Table], ddl: str) -> tuple[Callable[[pa.Table], pa.Table], str]:
    schema = _arrow(ddl)
    return lambda table: f(table, schema), ddl


def _mapped(f: Callable[[Iterator[pa.RecordBatch], pa.Schema], Iterator[pa.RecordBatch]], ddl: str) -> tuple[Callable, str]:
    return partial(f, schema=_arrow(ddl)), ddl


def _joined(rows: DataFrame, kind: str) -> DataFrame:
    """Conversations in pieces."""
    nested = lambda ddl: ddl.replace(", ", ",").replace(" ", ":")
    key, total = f"conv_id {kind}, part int, piece int", "total struct<gaps:long,blank:long,duplicate:long,truncated:long,illegal:long,cost:long>"
    firsts = rows.where("present").groupBy("conv_id", "digest").agg(F.min(F.struct("part", "seq")).alias("at")).select("at.part", "at.seq", F.lit(True).alias("first"))
    rows = written(rows.join(firsts, ["part", "seq"], "left").withColumn("first", F.coalesce("first", F.lit(False))), "conversation-rows")
    summed = f"{key}, counts struct<{nested(_COUNTS)}>, matrix array<long>, symbols array<int>, lengths array<int>"
    pieces = written(rows.drop("text", "digest").groupBy("part", "piece").applyInArrow(*_grouped(_summed, summed)), "conversation-pieces")
    carried = f"{key}, after array<long>, last boolean, {total}"
    back = pieces.drop("symbols", "lengths").groupBy("conv_id").applyInArrow(*_grouped(_carried_back, carried))
    exits = f"{carried}, exits array<int>"
    known = back.join(pieces.select("part", "piece", "symbols", "lengths"), ["part", "piece"]).select("conv_id", "part", "piece", "after", "last", "total", "symbols", "lengths").mapInArrow(*_mapped(_exits, exits))
    entered = f"{carried}, entry int"
    chosen = written(known.groupBy("conv_id").applyInArrow(*_grouped(_carried_on, entered)), "conversation-states")
    texts = f"{key}, {total}, audit string, text string"
    schema = _arrow(texts)
    done = rows.groupBy("part", "piece").cogroup(chosen.groupBy("part", "piece")).applyInArrow(lambda left, right: _edited(left, right, schema), texts)
    done = written(done, "conversation-texts").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    last = f"conv_id {kind}, done struct<{nested(_RESULT)}>"
    return done.mapInArrow(*_mapped(_hashed, last)).select("conv_id", "done.*")


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, present``: rows damaged by the checksum of ``conv_id:turn``, nulls as a space."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    what = F.crc32(F.concat(filled[0], F.lit(":"), filled[1]).cast("binary")) % 20
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("what") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("what") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    found = rows.select("conv_id", "turn", filled[2].alias("role"), filled[3].alias("text"), what.alias("what"))
    return found.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("what") != 0).alias("present"), F.explode(copies).alias("copy")).drop("copy")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), F.col("present"))


QUERIES = {"op12_conversation_repair": op12}
#: The cheapest edits are beyond SQL; tests hold them against all edit sequences.
ORACLES: dict[str, str] = {}
