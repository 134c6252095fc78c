"""Numbers, halos and recurrences over slots; chunks, means and resampling against plain loops."""

import math
import random

import numpy as np
import pytest

from weftline.operators import prefix, signal, timeline
from weftline.operators.prefix import F
from weftline.streaming import journal


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module", autouse=True)
def many_slots(spark):
    """Small tables too are dealt to as many slots as there are partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def skewed(spark):
    """A hot group with a hot order, sparse orders, nulls in both; ``v`` tells rows apart."""
    rng = random.Random(4)
    rows = [("hot", 7 if i % 2 else rng.randint(-(10**15), 10**15), i) for i in range(600)]
    rows += [(None, None if i % 3 else i, 1000 + i) for i in range(60)] + [(f"g{i}", i, 2000 + i) for i in range(40)] + [("g1", 5, None)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, o long, v long").repartition(5)


def test_numbers_and_sums_over_slots(skewed):
    rows, frame = skewed
    by_group = {}
    for g, o, v in rows:
        by_group.setdefault(g, []).append((o is not None, o or 0, v))
    for column, found in (("nth", prefix.numbered(frame, "g", "o")), ("total", prefix.running_sum(frame, "g", "o", F.col("v"), "total"))):
        got = {}
        for r in found.collect():
            got.setdefault(r["g"], []).append(((r["o"] is not None, r["o"] or 0), r[column], r["v"]))
        assert found.columns == ["g", "o", "v", column]
        for g, members in by_group.items():
            mine = sorted(got[g], key=lambda x: (x[0], x[1], x[2] is not None))
            assert [x[0] for x in mine] == sorted(x[:2] for x in members)
            if column == "nth":
                assert [x[1] for x in mine] == list(range(len(members)))
            else:  # rows of one order follow each other in any order, so compare where an order ends
                sums = {}
                for known, o, v in members:
                    sums[known, o] = sums.get((known, o), 0) + (v or 0)
                at = 0
                for order in sorted(sums):
                    at += sums[order]
                    assert max(x[1] for x in mine if x[0] == order) == at


def test_no_slot_holds_the_hot_group(skewed):
    _, frame = skewed
    sizes = [r["count"] for r in prefix.ordered(frame, "g", "o").groupBy("_slot").count().collect()]
    assert len(sizes) > 2 and max(sizes) < 0.6 * sum(sizes)


@pytest.mark.parametrize("keep", [0.5, 0.99, 0.9999])
def test_recurrence(spark, monkeypatch, keep):
    if keep == 0.9999:  # blocks that do not forget, so that many are read back
        monkeypatch.setattr(prefix.math, "log", lambda x: -0.4)
    rng = random.Random(1)
    tracks = {t: [rng.choice([None, rng.uniform(-1, 1) * 10 ** rng.randint(0, 9)]) for _ in range(n)] for t, n in (("a", 3000), ("b", 1), (None, 700))}
    frame = spark.createDataFrame([(t, i, v) for t, vs in tracks.items() for i, v in enumerate(vs)], "track string, nth long, v double")
    for start in (None, -60.0):
        found = signal.smoothed(frame, keep, None if start is None else F.lit(start))
        got = {(r["track"], r["nth"]): r["mean"] for r in found.collect()}
        for t, vs in tracks.items():
            y = (vs[0] or 0.0) if start is None else start
            for i, v in enumerate(vs):
                y = keep * y + (1 - keep) * (v or 0.0)
                assert math.isclose(got[t, i], y, rel_tol=1e-9, abs_tol=1e-6), (t, i)


def test_chunks_with_context(spark):
    tracks = {"a": np.random.default_rng(2).random(1200), "one": np.array([3.0]), "even": np.arange(1024.0), "none": np.array([])}
    frame = spark.createDataFrame([(t, i, float(v)) for t, vs in tracks.items() for i, v in enumerate(vs)], "track string, nth long, v double")
    found = signal.chunks(frame)
    got = {(r["track"], r["chunk"]): r["xs"] for r in found.collect()}
    wanted = {}
    for t, vs in tracks.items():
        context = np.zeros(64)
        for c in range(0, len(vs), 512):
            buf = np.zeros(576)
            buf[:64] = context
            buf[64 : 64 + len(vs[c : c + 512])] = vs[c : c + 512]
            wanted[t, c // 512] = buf.tolist()
            context = buf[-64:]
    assert got == wanted
    assert "Window" not in plan(found)


def one_pass(values, source, target):
    out, k = [], 0
    while values and k * source <= (len(values) - 1) * target:
        i, rest = divmod(k * source, target)
        out.append(values[i] if rest == 0 else values[i] + (values[i + 1] - values[i]) * rest / target)
        k += 1
    return out


@pytest.mark.parametrize("source,target", [(48_000, 16_000), (44_100, 16_000), (22_050, 16_000), (16_000, 16_000), (8_000, 16_000)])
def test_resampled_tracks(spark, source, target):
    tracks = {t: [math.sin(i * 0.31) for i in range(n)] for t, n in (("a", 9000 if source == 44_100 else 500), ("b", 1), ("c", 2))}
    frame = spark.createDataFrame([(t, i, v) for t, vs in tracks.items() for i, v in enumerate(vs)], "track string, nth long, v double")
    found = signal.resampled_tracks(frame, source, target)
    got = {(r["track"], r["k"]): r["v"] for r in found.collect()}
    wanted = {(t, k): v for t, vs in tracks.items() for k, v in enumerate(one_pass(vs, source, target))}
    assert got.keys() == wanted.keys() and all(math.isclose(got[x], wanted[x], abs_tol=1e-12) for x in wanted)
    assert "_block" in plan(found)  # windows see a block, not a track


def test_any_cut_into_packets_gives_one_pass(spark, tmp_path):
    rng = random.Random(9)
    channels, source, target = 2, 44_100, 16_000
    tracks = {t: [(math.sin(i * 0.031) * 0.7, math.cos(i * 0.0007) * 0.3) for i in range(n)] for t, n in ((1, 3000), (2, 1), (3, 777))}
    packets = []
    for t, frames in tracks.items():
        at, n = 0, 0
        while at < len(frames):
            size = rng.choice([0, 1, 2, 128, 333])
            odd = [9.9] if rng.random() < 0.2 and size == 0 else []  # half a frame
            packets.append((t, n, [x for f in frames[at : at + size] for x in f] + odd))
            at, n = at + size, n + 1
    folder, schema = str(tmp_path / "packets"), "track long, ord long, interleaved array<double>"
    cut = len(packets) // 3
    for part in (packets[:cut], packets[cut : 2 * cut], packets[2 * cut :]):
        rng.shuffle(part)  # within a batch, packets come in any order
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = journal.resampled_stream(stream, source, target, channels).writeStream.format("memory").queryName("resampled").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    streamed = {(r["track"], r["k"]): r["v"] for r in spark.table("resampled").collect()}
    wanted = {(t, k): v for t, fs in tracks.items() for k, v in enumerate(one_pass([sum(f) / channels for f in fs], source, target))}
    assert streamed.keys() == wanted.keys() and all(math.isclose(streamed[x], wanted[x], abs_tol=1e-12) for x in wanted)
    batch = signal.resampled_tracks(signal.samples_of(spark.createDataFrame(packets, schema), channels), source, target)
    assert {(r["track"], r["k"]): round(r["v"], 9) for r in batch.collect()} == {x: round(v, 9) for x, v in streamed.items()}


def test_a_missing_packet_is_an_error(spark, tmp_path):
    folder, schema = str(tmp_path / "packets"), "track long, ord long, interleaved array<double>"
    spark.createDataFrame([(1, 0, [0.5]), (1, 2, [0.5])], schema).write.parquet(folder)
    query = journal.resampled_stream(spark.readStream.schema(schema).parquet(folder), 2, 1).writeStream.format("memory").queryName("gap").outputMode("append").start()
    with pytest.raises(Exception, match="packet 1 is missing"):
        query.processAllAvailable()


def test_ticks_are_exact(spark):
    """Quotients next to a whole number, of either sign, and beyond the largest."""
    scales = [1, 3, 41_666_667, 9_999_999_967]
    rows = [(sign * (k * s + d), s) for s in scales for k in (0, 1, 7, 41_000_001) for d in (-1, 0, 1) for sign in (1, -1)]
    rows += [(next(m for m in range(1, 10**9) if 0 < -m * 10**6 % 41_666_667 < 20), 41_666_667), (2**62, 1), (9_223_372_036_854, 1), (9_223_372_036_855, 1), (5, 0)]
    found = spark.createDataFrame(rows, "ms long, s long").select("ms", "s", timeline.ms_to_ticks(F.col("ms"), F.col("s")).alias("t")).collect()
    assert [r["t"] for r in found] == [min(m * 10**6 // max(s, 1), 2**63 - 1) for m, s in rows]
