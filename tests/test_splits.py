"""Files read in blocks equal the same files read whole, wherever a block ends; order statistics; sample tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import samples, selection, tabular
from weftline.sources import splits


@pytest.fixture
def tiny_blocks(spark):
    """Blocks of a few bytes, each a task of its own."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def size(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield size
    for k, v in was.items():
        spark.conf.set(k, v)


CSV = 'name,amount\n"Doe, Jane",1.50\nBob,\n"two\nlines","say ""hi""\r\nthere"\n\na"b"c,"x"y"z\nlast,"""\n,\n"""\r\none,two,three\r\n"q\n\n\nq",""\nno end,1'


@pytest.mark.parametrize("block", [1, 3, 13])
def test_csv_at_every_border(spark, tmp_path, tiny_blocks, block):
    path = tmp_path / "a.csv"
    path.write_bytes(CSV.encode())
    whole = tabular.csv_cells(spark.createDataFrame([("f", CSV)], "file string, content string")).collect()
    tiny_blocks(block)
    cells = splits.csv_file_cells(spark, str(path))
    assert block > 3 or splits.lines(spark, str(path)).rdd.getNumPartitions() > 5
    assert sorted(tuple(r)[1:] for r in cells.collect()) == sorted(tuple(r)[1:] for r in whole)


def test_random_csv_files_together(spark, tmp_path, tiny_blocks):
    rng = random.Random(3)
    texts = {}
    for i in range(12):
        texts[f"f{i}.csv"] = "".join(rng.choice(['"', '"', ",", "\n", "\n", "\r\n", "a", '""', ' "', "é"]) for _ in range(rng.randint(1, 120))).rstrip("\r\n") + "z"
        (tmp_path / f"f{i}.csv").write_bytes(texts[f"f{i}.csv"].encode())
    tiny_blocks(7)
    got = sorted((r["file"].rsplit("/", 1)[-1], *tuple(r)[1:]) for r in splits.csv_file_cells(spark, str(tmp_path)).collect())
    assert got == sorted(tuple(r) for r in tabular.csv_cells(spark.createDataFrame(list(texts.items()), "file string, content string")).collect())


def test_csv_semantics(spark, tmp_path):
    """Short rows get nulls, long ones keep extras, values stay text."""
    (tmp_path / "a.csv").write_text("h1,h2\na\nc,d,extra\n")
    found = {(r["row"], r["key"]): r["value"] for r in tabular.csv_fields(splits.csv_file_cells(spark, str(tmp_path / "a.csv"))).collect()}
    assert found == {(1, "h1"): "a", (1, "h2"): None, (2, "h1"): "c", (2, "h2"): "d", (2, "extra_column_1"): "extra"}


OBJECTS = [{"a": "}], {[\"", "b": {"c": [1, {"d": "\\"}]}}, {}, {"é": "\\\\\"}", "n": None}, {"x": "\n,\t"}, {"last": "{" * 5}]


@pytest.mark.parametrize("block", [1, 7])
@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays_at_every_border(spark, tmp_path, tiny_blocks, block, indent):
    path = tmp_path / "a.json"
    path.write_text("  " + json.dumps(OBJECTS, indent=indent, ensure_ascii=False) + "\n\n")
    tiny_blocks(block)
    found = splits.json_objects(splits.lines(spark, str(path), "}")).orderBy("row").collect()
    assert [json.loads(r["object"]) for r in found] == OBJECTS and [r["row"] for r in found] == list(range(1, 6))


@pytest.mark.parametrize("size", [3, 40])
def test_a_json_array_in_parts(spark, tmp_path, tiny_blocks, size):
    """Parts may end between any characters: behind a brace, in a string, or with a line feed of their own."""
    text = json.dumps(OBJECTS, ensure_ascii=False, indent=1)
    for i, at in enumerate(range(0, len(text), size)):
        (tmp_path / f"part-{i:05d}.txt").write_text(text[at : at + size])
    tiny_blocks(1 << 20)
    found = splits.json_objects(splits.lines(spark, str(tmp_path), "}", parts=True)).orderBy("row").collect()
    assert [json.loads(r["object"]) for r in found] == OBJECTS
    (tmp_path / "lines").mkdir()
    for i, piece in enumerate(["[\n", '{"a": "}"}\n', ', {"b": {}}\n', "]\n"]):
        (tmp_path / "lines" / f"part-{i}").write_text(piece)
    assert [r["object"] for r in splits.json_objects(splits.lines(spark, str(tmp_path / "lines"), "}", parts=True)).orderBy("row").collect()] == ['{"a": "}"}', '{"b": {}}']


@pytest.mark.parametrize("backslashes", [1, 2, 3, 4])
def test_backslashes_at_the_end_of_a_part_escape_what_the_next_begins_with(spark, tmp_path, tiny_blocks, backslashes):
    """Parts of one character: of backslashes only, too."""
    wanted = [{"a": "\\" * backslashes + '"}, {"'}, {"b": "}\\"}]
    for i, c in enumerate(json.dumps(wanted)):
        (tmp_path / f"part-{i:05d}").write_text(c)
    tiny_blocks(1 << 20)
    found = splits.json_objects(splits.lines(spark, str(tmp_path), "}", parts=True)).orderBy("row").collect()
    assert [json.loads(r["object"]) for r in found] == wanted


@pytest.mark.parametrize("bits", [1, 3])
def test_slots_of_a_json_array_are_bounded(spark, tmp_path, tiny_blocks, monkeypatch, bits):
    """However many pieces a block or a file has, no slot has more than its bound, and the objects are the same."""
    monkeypatch.setattr(splits, "_SLOT_BITS", bits)
    wanted = [{"a": '}"\\{' * (n % 4), "b": {"n": n}} for n in range(60)]
    for name in ("x", "y"):
        (tmp_path / name).write_text(json.dumps(wanted))
    tiny_blocks(400)
    pieces = splits.lines(spark, str(tmp_path), "}").withColumn("text", F.coalesce("text", F.lit("")))
    placed = splits._placed(pieces, splits._blocks(pieces))
    sizes = placed.groupBy("file", "_slot").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 1 << bits and sizes[1] >= placed.count() >> bits
    found = splits.json_objects(splits.lines(spark, str(tmp_path), "}")).orderBy("file", "row").collect()
    assert [json.loads(r["object"]) for r in found] == wanted * 2 and [r["row"] for r in found] == [*range(1, 61)] * 2


@pytest.mark.parametrize("text", ['[{"a": 1}, {"b": 2}', '[{"a": 1}]}', '\ufeff[{"a": 1}'])
def test_an_array_that_ends_in_a_brace_is_an_error(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="does not end"):
        splits.json_objects(splits.lines(spark, str(tmp_path / "a.json"), "}")).collect()


@pytest.mark.parametrize("text,why", [("{not json", "does not end"), ('{"a": 1}', "does not end"), ('[1, {"a": 1}]', "not an array"), ('[{"a": 1}', "does not end"), ('[{"a": 1}] [', "does not end"), ('[{"a": 1} {"b": 2}]', "not an array")])
def test_what_is_no_array_of_objects_is_an_error(spark, tmp_path, text, why):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match=why):
        splits.json_objects(splits.lines(spark, str(tmp_path / "a.json"), "}")).collect()


def test_json_to_csv(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"b": 2, "a": 1}, {"a": 3, "c": null}]')
    assert [r["line"] for r in splits.json_file_csv(spark, str(tmp_path / "a.json")).orderBy("row").collect()] == ["a,b,c", "1,2,", "3,,"]
    (tmp_path / "b.json").write_text('[{"a": {"n": 1}}]')
    with pytest.raises(Exception, match="nested"):
        splits.json_file_csv(spark, str(tmp_path / "b.json")).collect()
    (tmp_path / "c.json").write_text(" [ ] ")
    assert splits.json_objects(splits.lines(spark, str(tmp_path / "c.json"), "}")).count() == 0


@pytest.mark.parametrize("bins", [2, 7, 1 << 12])
def test_selected_ranks(spark, bins):
    rng = random.Random(bins)
    values = [rng.choice([0, 5, -3, rng.randint(-(2**63), 2**63 - 1), rng.randint(-50, 50)]) for _ in range(41)] + [7] * 30
    frame = spark.createDataFrame([(v,) for v in [*values, None]], "v long")
    for rank in (0, 13, 35, 70):
        assert selection.selected(frame, "v", rank, bins) == sorted(values)[rank]
    assert selection.selected(frame, "v", 71, bins) is None and selection.selected(frame.limit(0), "v", 0) is None
    assert selection.median(frame, "v") == sorted(values)[35] == selection.median(frame, "v", upper=False)
    four = spark.createDataFrame([(v,) for v in (1, 2, 9, 10)], "v long")
    assert (selection.median(four, "v"), selection.median(four, "v", upper=False)) == (9, 2)


def walk(timescale, times, offsets, runs, chunks, sizes, syncs):
    """Sample by sample, stepping through the runs."""
    out, nth, ticks, t, o = [], 0, 0, 0, 0
    t_left, o_left = (times[0][0] if times else 0), (offsets[0][0] if offsets else 0)
    for c, at in enumerate(chunks):
        per = next((p for first, p in reversed(runs) if first <= c + 1), 0)
        for _ in range(per):
            if nth == len(sizes):
                break
            while t_left == 0 and t + 1 < len(times):
                t += 1
                t_left = times[t][0]
            while o_left == 0 and o + 1 < len(offsets):
                o += 1
                o_left = offsets[o][0]
            shown = offsets[o][1] if o_left else 0
            out.append((nth, ticks * 1000 // timescale, int(shown * 1000 / timescale), at, sizes[nth], not syncs or nth + 1 in syncs))
            t_left, o_left = max(0, t_left - 1), max(0, o_left - 1)
            ticks += times[t][1] if times else 0
            at += sizes[nth]
            nth += 1
    return out


def test_sample_tables_against_a_walk(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(8)
    movies, wanted = {}, []
    for track in range(8):
        n = rng.randint(0, 40)
        times = [(rng.choice([0, 0, 1, 3, 9]), rng.randint(1, 3000)) for _ in range(rng.randint(1, 8))]
        offsets = [(rng.choice([0, 1, 4]), rng.randint(-900, 900)) for _ in range(rng.randint(0, 8))]
        firsts = sorted(rng.sample(range(1, 12), rng.randint(1, 3)))
        runs = [(f, rng.randint(0, 5)) for f in firsts]
        chunks = [rng.randint(0, 10**6) for _ in range(12)]
        movies[track] = (rng.choice([600, 90_000, 44_100]), times, offsets, runs, chunks, [rng.randint(0, 500) for _ in range(n)], set(rng.sample(range(1, 41), rng.choice([0, 5]))))
        wanted += [(track, *row) for row in walk(*movies[track])]
    frame = lambda part, schema, row: spark.createDataFrame([(t, *row(i, x)) for t, m in movies.items() for i, x in enumerate(m[part])], f"track int, {schema}")
    found = samples.sample_table(
        spark.createDataFrame([(t, m[0]) for t, m in movies.items()], "track int, timescale long"), frame(1, "run long, count long, delta long", lambda i, x: (i, *x)), frame(2, "run long, count long, offset long", lambda i, x: (i, *x)),
        frame(3, "first long, per long", lambda i, x: x), frame(4, "chunk long, at long", lambda i, x: (i, x)), frame(5, "nth long, size long", lambda i, x: (i, x)), frame(6, "nth long", lambda i, x: (x,)),
    )
    assert sorted(tuple(r) for r in found.collect()) == sorted(wanted)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
