"""Line dedup against plain loops, over insertions and deletions, and the cuckoo filters alone."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tests.helpers import same, views
from weftline.llm import cuckoo, line_dedup
from weftline.llm.line_dedup import F

SF = "/root/testdata/sf0.001"


def key(line):
    line = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)


def brute(docs):
    """``(doc_id, text)`` to n_lines, n_dropped and the kept text of each; a null id comes last."""
    keeper = {}
    order = lambda d: (d is None, d or 0)
    for d, t in docs:
        for line in (t or "").split("\n"):
            keeper[key(line)] = min(keeper.get(key(line), d), d, key=order)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or keeper[key(x)] == d]
        out.append((d, t, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def check(rows, docs):
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in rows]
    assert sorted(got, key=order) == sorted(brute(docs), key=order)


ROWS = [(1, "Shared line one\nown words here a\n"), (2, " shared LINE one\t\nshort\nshort"), (2, " shared LINE one\t\nshort\nshort"), (None, "shared line one\nonly null ids have this"), (None, "only null ids have this\n\n"),
        (3, None), (4, ""), (5, "É twelve chars\n\n\n\xa0É twelve chars"), (6, "É TWELVE chars\né twelve chars"), (7, "long line number one\n" * 30_000), (8, "long line number one\nlast\r"), (-5, "negative ids come first\nshared line one"), (9, "negative ids come first")]


def test_dirty_rows_and_clashing_names(spark):
    clash = spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x") for r in ROWS], "doc_id long, text string, row string, pos string, key string, gone string, n_lines string, weftline_k string")
    index = line_dedup.fresh_index(spark)
    found = line_dedup.rendered(clash, index.ingest(clash).dropped)
    assert found.columns == ["doc_id", "text", "row", "pos", "key", "gone", "weftline_k", "n_lines", "n_dropped", "kept_text"]
    check(found.collect(), ROWS)
    empty = index.ingest(clash.limit(0)).dropped
    assert empty.count() == 0 and line_dedup.rendered(clash.limit(0), empty).count() == 0


def test_insertions_and_deletions_are_reversible(spark):
    rng = random.Random(1)
    pool = [f"line number {i} of the pool" for i in range(25)]
    index, there, state = line_dedup.LineIndex(spark, "lines_there_and_back", shards=3), {}, set()
    ids = rng.sample(range(100), 60)
    for step in range(5):
        if step in (2, 4):
            out = rng.sample(sorted(there), 12)
            ids += out
            change = index.delete(spark.createDataFrame([(i,) for i in [*out, 1000]], "doc_id long"))
            for i in out:
                state -= {x for x in state if x[0] == i}
                del there[i]
        else:
            new = {i: "\n".join(rng.choices(pool, k=3)) for i in (ids.pop() for _ in range(14))}
            there |= new
            change = index.ingest(spark.createDataFrame(sorted(new.items()), "doc_id long, text string"))
        state |= {(r["doc_id"], r["pos"]) for r in change.dropped.collect()}
        state -= {(r["doc_id"], r["pos"]) for r in change.restored.collect()}
        docs = spark.createDataFrame(sorted(there.items()), "doc_id long, text string")
        dropped = index.dropped()
        assert {(r["doc_id"], r["pos"]) for r in dropped.collect()} == state
        check(line_dedup.rendered(docs, dropped).collect(), list(there.items()))
        # The filters hold one copy of each key that has references, as if only these had come.
        refs = defaultdict(int)
        for t in there.values():
            for line in t.split("\n"):
                refs[line] += 1
        counts = {bytes(r["key"]): r["refs"] for r in index.counts().collect()}
        assert sorted(counts.values()) == sorted(refs.values())
        rows = spark.table(index.tables("filters")[-1][2]).collect()
        shard = {bytes(r["key"]): r["shard"] for r in index.counts().select("key", F.pmod(F.xxhash64("key"), F.lit(3)).alias("shard")).collect()}
        for s in range(3):
            filters = cuckoo.CuckooFilter([bytes(r["data"]) for r in sorted(rows, key=lambda r: r["slot"]) if r["shard"] == s])
            mine = [k for k in counts if shard[k] == s]
            assert filters.held() == len(mine) and (not mine or filters.contains(np.frombuffer(b"".join(mine), np.uint8).reshape(-1, 16)).all())
    index.drop()
    assert not index.tables("lines")


def test_denied_keys_skip_the_exact_table(spark):
    index = line_dedup.fresh_index(spark)
    index.ingest(spark.createDataFrame([(1, "seen before, in one\nonly here, first")], "doc_id long, text string"), "one")
    entries = index.entries(line_dedup.lines_of(spark.createDataFrame([(2, "seen before, in one\nnot seen, in two")], "doc_id long, text string")).select("key"), line_dedup._INSERT)
    asked = index.filters(2, entries).mapInArrow(line_dedup._probe, "key binary, refs long, keep_id long, spread boolean, maybe boolean")
    assert sorted(r["maybe"] for r in asked.collect()) == [False, True]
    plan = index.counts(asked.where("maybe").select("key"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftSemi" in plan


def test_a_batch_is_run_again(spark, monkeypatch):
    index = line_dedup.fresh_index(spark)
    docs = spark.createDataFrame([(1, "a line that is shared"), (2, "a line that is shared")], "doc_id long, text string")
    monkeypatch.setattr(line_dedup.LineIndex, "close", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.ingest(docs, "one")
    monkeypatch.undo()
    with pytest.raises(ValueError, match="one has not ended"):
        index.ingest(docs, "two")
    for _ in range(2):
        assert [r["doc_id"] for r in index.ingest(docs, "one").dropped.collect()] == [2]
    assert index.counts().collect()[0]["refs"] == 2


@pytest.mark.parametrize("n", [0, 1, 5_000, cuckoo.SLOT_KEYS * 2 + 500])
def test_cuckoo_filters(n):
    rng = np.random.default_rng(n)
    keys, strangers = (rng.integers(0, 256, (m, 16), dtype=np.uint8) for m in (n, 50_000))
    filters = cuckoo.CuckooFilter()
    for part in np.array_split(keys, 3):
        filters.insert(part)
    again = cuckoo.CuckooFilter([s.tobytes() for s in filters.slots])
    assert again.held() == n and again.contains(keys).all() and again.contains(strangers).mean() < 0.001
    assert len(filters.slots) <= 1 + -(-n // cuckoo.SLOT_KEYS)
    some = rng.random(n) < 0.5
    again.delete(keys[some])
    assert again.held() == n - some.sum() and again.contains(keys[~some]).all()
    assert not n or again.contains(keys[some]).mean() < 0.01
    if n:
        with pytest.raises(ValueError, match="not in the filter"):
            cuckoo.CuckooFilter().delete(keys[:1])


def test_crowded_buckets_spill_into_a_new_slot():
    keys = np.zeros((30, 16), np.uint8)
    keys[:, 0] = 7  # one fingerprint, two buckets: eight places a slot
    filters = cuckoo.CuckooFilter()
    filters.insert(keys)
    assert filters.held() == 30 and len(filters.slots) >= 4
    filters.delete(keys[:29])
    assert filters.held() == 1 and filters.contains(keys[:1]).all()


def test_query(spark):
    same(line_dedup.op13(spark, SF), views(SF), line_dedup.ORACLES["op13_line_dedup"])
    assert not spark.sql("SHOW TABLES LIKE 'weftline_lines*b1'").collect()
