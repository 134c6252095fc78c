"""Outputs and receipts are placed together, over nothing that exists, all of a job or none."""

import os
import random

import pytest

from weftline.sources import sink

SCHEMA = "name string, content binary, receipt string"


def rows(spark, *names, receipt="{}"):
    return spark.createDataFrame([(n, bytearray(f"new {i}".encode()), receipt) for i, n in enumerate(names)], SCHEMA).coalesce(1)


def held(folder):
    return {f: (folder / f).read_text() for f in sorted(os.listdir(folder))}


def test_an_existing_file_is_never_replaced(spark, tmp_path):
    (tmp_path / "report.pdf").write_text("IRREPLACEABLE")
    sink.write_outputs(rows(spark, "report.pdf"), str(tmp_path))
    assert held(tmp_path) == {"report.pdf": "IRREPLACEABLE", "report (2).pdf": "new 0", "report (2).pdf.receipt.json": "{}\n"}


def test_skip_leaves_what_is_there(spark, tmp_path):
    (tmp_path / "a.txt").write_text("KEEP")
    sink.write_outputs(rows(spark, "a.txt", "b.txt"), str(tmp_path), "skip")
    assert held(tmp_path) == {"a.txt": "KEEP", "b.txt": "new 1", "b.txt.receipt.json": "{}\n"}


def test_fail_refuses_the_whole_job(spark, tmp_path):
    (tmp_path / "b.txt").write_text("KEEP")
    with pytest.raises(Exception, match="already exists"):
        sink.write_outputs(rows(spark, "a.txt", "b.txt", "c.txt"), str(tmp_path), "fail")
    assert held(tmp_path) == {"b.txt": "KEEP"}
    with pytest.raises(Exception, match="already exists"):  # a receipt is an output too
        (tmp_path / "c.txt.receipt.json").write_text("OLD")
        sink.write_outputs(rows(spark, "c.txt"), str(tmp_path), "fail")
    assert held(tmp_path) == {"b.txt": "KEEP", "c.txt.receipt.json": "OLD"}


def test_plain_and_climbing_names(spark, tmp_path):
    (tmp_path / "x.txt").write_text("1")
    (tmp_path / "x (2).txt").write_text("2")
    sink.write_outputs(rows(spark, "new.txt", "x.txt", "x.txt", ".bashrc", ".bashrc", "noext", "noext", receipt=None), str(tmp_path))
    assert held(tmp_path) == {"new.txt": "new 0", "x.txt": "1", "x (2).txt": "2", "x (3).txt": "new 1", "x (4).txt": "new 2", ".bashrc": "new 3", ".bashrc (2)": "new 4", "noext": "new 5", "noext (2)": "new 6"}
    assert list(sink.candidates("archive.tar.gz", "suffix"))[:2] == ["archive.tar.gz", "archive.tar (2).gz"]
    assert len(list(sink.candidates("a", "suffix"))) == 999


def test_a_task_killed_between_output_and_receipt_leaves_neither(spark, tmp_path):
    dying = rows(spark, "a.txt", "b.txt").withColumn("receipt", sink.F.when(sink.F.col("name") == "b.txt", sink.F.raise_error(sink.F.lit("killed"))).otherwise("{}"))
    with pytest.raises(Exception, match="killed"):
        sink.write_outputs(dying, str(tmp_path))
    assert held(tmp_path) == {}
    for name in ("x/y", "", ".."):
        with pytest.raises(Exception, match="not a file name"):
            sink.write_outputs(rows(spark, "a.txt", name), str(tmp_path))
    assert held(tmp_path) == {}


def test_a_job_that_died_while_placing_is_undone(tmp_path):
    """The state of a driver lost between the links of an output and of its receipt."""
    (tmp_path / "old.txt").write_text("KEEP")
    staged = tmp_path / (sink.STAGED + "1")
    staged.mkdir()
    for name in ("0.out", "0.receipt", "1.out"):
        (staged / name).write_text(name)
    assert sink.take(str(staged / "0.out"), str(tmp_path), "old.txt", "suffix") == "old (2).txt"
    assert sink.recover(str(tmp_path)) == 1 and held(tmp_path) == {"old.txt": "KEEP"}
    assert sink.recover(str(tmp_path)) == 0


def test_many_tasks_and_no_rows(spark, tmp_path):
    many = spark.range(60).select(sink.F.lit("same.bin").alias("name"), sink.F.col("id").cast("string").cast("binary").alias("content"), sink.F.lit(None).cast("string").alias("receipt")).repartitionByRange(6, "content")
    sink.write_outputs(many, str(tmp_path / "out"))
    assert sorted(held(tmp_path / "out").values()) == sorted(map(str, range(60))) and len(os.listdir(tmp_path / "out")) == 60
    sink.write_outputs(many.limit(0), f"file://{tmp_path}/none")
    assert os.listdir(tmp_path / "none") == []


def test_what_was_placed_is_returned_and_read_back(spark, tmp_path):
    (tmp_path / "b [1].txt").write_text("KEEP")
    some = rows(spark, "a.txt", "b [1].txt", "a.txt").unionByName(rows(spark, "c", receipt=None).withColumn("content", sink.F.lit(None).cast("binary")))
    placed = sink.write_outputs(some.coalesce(1), str(tmp_path), "suffix")
    assert sorted(map(tuple, placed.collect())) == [("a.txt", "a (2).txt", "a (2).txt.receipt.json"), ("a.txt", "a.txt", "a.txt.receipt.json"), ("b [1].txt", "b [1] (2).txt", "b [1] (2).txt.receipt.json"), ("c", "c", None)]
    found = {r["name"]: (bytes(r["content"]), r["receipt"] and bytes(r["receipt"])) for r in sink.read_outputs(placed, f"file://{tmp_path}").collect()}
    assert found == {"a.txt": (b"new 0", b"{}\n"), "b [1] (2).txt": (b"new 1", b"{}\n"), "a (2).txt": (b"new 2", b"{}\n"), "c": (b"", None)}
    assert [tuple(r) for r in sink.write_outputs(rows(spark, "a.txt", "d"), str(tmp_path), "skip").collect()] == [("d", "d", "d.receipt.json")]


def test_no_output_is_listed_on_the_driver(spark):
    """Only the table of what was placed; once every file of the folder, and a task for each 32 of them."""
    read = sink.output_files(spark, "/root/testdata/sf0.001")
    assert all("outputs-placed" in path for path in read.inputFiles()) and read.rdd.getNumPartitions() < 8 and read.count() == 200


def test_names_that_meet_are_taken_in_turn_by_tasks(spark, tmp_path):
    """As by a plain loop over the rows, whatever task takes a name."""
    rng = random.Random(6)
    parts = ["x", "y", ".", ".txt", " (2)", " (3)", ".receipt.json", ".receipt", ".json", "(2)", " (", "\n"]
    names = [n for n in ("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(300)) if n not in (".", "..")]
    taken, wanted = {"x.txt"}, {}
    (tmp_path / "x.txt").write_text("KEEP")
    for i, name in enumerate(names):
        out = next(c for c in sink.candidates(name, "suffix") if c not in taken)
        taken.add(out)
        receipt = next(c for c in sink.candidates(f"{out}.receipt.json", "suffix") if c not in taken)
        taken.add(receipt)
        wanted |= {out: str(i), receipt: f"receipt {i}\n"}
    many = spark.createDataFrame([(i, n, bytearray(str(i).encode()), f"receipt {i}") for i, n in enumerate(names)], f"i int, {SCHEMA}").repartitionByRange(5, "i").sortWithinPartitions("i")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sink.write_outputs(many, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert held(tmp_path) == wanted | {"x.txt": "KEEP"}


def test_a_task_that_is_run_again_finds_the_names_it_took(tmp_path):
    for name in ("0.out", "0.receipt", "1.out"):
        (tmp_path / name).write_text(name)
    out = tmp_path / "out"
    out.mkdir()
    for _ in range(2):
        for conflict in ("suffix", "skip", "fail"):
            assert sink.take_both(str(tmp_path / "0.out"), str(tmp_path / "0.receipt"), str(out), "a.txt", conflict) == ("a.txt", "a.txt.receipt.json")
        assert sink.take(str(tmp_path / "1.out"), str(out), "a.txt", "suffix") == "a (2).txt"
        assert sink.take(str(tmp_path / "1.out"), str(out), "a.txt", "skip") is None
    (out / "b").symlink_to(out / "nothing")
    assert sink.take(str(tmp_path / "1.out"), str(out), "b", "suffix") == "b (2)"


def test_a_job_that_died_while_its_folder_was_removed_is_done(tmp_path):
    """Some of the job's own files are gone: once, the outputs of the others were taken back."""
    staged = tmp_path / (sink.STAGED + "1")
    (staged / "0-0").mkdir(parents=True)
    for name in ("a", "b"):
        (staged / "0-0" / name).write_text(name)
        sink.take(str(staged / "0-0" / name), str(tmp_path), name, "fail")
    done = sink._end(str(staged))
    os.unlink(f"{done}/0-0/a")
    assert sink.recover(str(tmp_path)) == 0 and held(tmp_path) == {"a": "a", "b": "b"}


def test_the_data_source_places_by_itself(spark, tmp_path):
    spark.dataSource.register(sink.OutputFiles)
    (tmp_path / "a").write_text("KEEP")
    write = lambda *names, conflict: rows(spark, *names).write.format("weftline_files").option("conflict", conflict).mode("append").save(str(tmp_path))
    write("a", "b", conflict="suffix")
    with pytest.raises(Exception, match="already exists"):
        write("c", "a", conflict="fail")
    assert held(tmp_path) == {"a": "KEEP", "a (2)": "new 0", "a (2).receipt.json": "{}\n", "b": "new 1", "b.receipt.json": "{}\n"}
