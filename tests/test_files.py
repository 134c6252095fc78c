import json
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.operators import features, pageset, receipts, tabular
from weftline.sources import files


def test_folders_globs_and_drops(spark, tmp_path):
    for name in ("a.png", "b.JPG", "c.exe", "a.receipt.json", "a.receipt (2).json", "sub/d.md", "sub/deep/e.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    names = lambda df: [os.path.basename(r["path"]) for r in df.collect()]
    assert names(files.scan_folder(spark, str(tmp_path))) == ["a.png", "b.JPG", "c.exe"]
    assert names(files.scan_folder(spark, str(tmp_path), "Jpeg")) == ["a.png", "c.exe"]
    assert names(files.expand_glob(spark, f"{tmp_path}/?.p*")) == ["a.png"]
    with pytest.raises(ValueError, match="file names"):
        files.expand_glob(spark, "/in*/a.png")
    walked = files.drop_walk(spark, str(tmp_path))
    assert sorted(names(walked.where("droppable"))) == ["a.png", "a.receipt (2).json", "b.JPG", "d.md", "e.csv"] and walked.where("NOT droppable").count() == 2
    assert sorted(names(files.drop_walk(spark, str(tmp_path), 2).where("droppable"))) == ["a.png", "a.receipt (2).json", "b.JPG", "d.md"]


def test_history_is_newest_first_and_skips_torn_lines(spark, tmp_path):
    for age, batch in enumerate(("new", "old")):
        lines = [json.dumps({"source_name": f"{batch}{i}", "outcome": "completed"}) for i in range(3)]
        (tmp_path / f"{batch}.jsonl").write_text("\n".join([*lines[:2], '{"source_name": "torn', lines[2]]) + "\n")
        os.utime(tmp_path / f"{batch}.jsonl", (1_700_000_000 - age, 1_700_000_000 - age))
    assert [r["source_name"] for r in files.history(spark, str(tmp_path), 5).collect()] == ["new2", "new1", "new0", "old2", "old1"]


BODIES = "id string, converted_at long, source_name string, body string"



def test_history_reads_no_more_journals_than_needed(spark, tmp_path):
    for i in range(60):
        path = tmp_path / f"j{i:02}.jsonl"
        path.write_text(f'{{"source_name": "s{i}a"}}\n{{torn\n{{"source_name": "s{i}b"}}\n')
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    assert [r["source_name"] for r in files.history(spark, str(tmp_path), 5).collect()] == ["s59b", "s59a", "s58b", "s58a", "s57b"]
    for limit, most in ((1, 4), (8, 4), (9, 8), (1000, 60)):
        read = files.newest_journals(spark, str(tmp_path), limit)
        assert len(read) == most and read[0].endswith("j59.jsonl")
    (tmp_path / "empty").mkdir()
    assert files.newest_journals(spark, str(tmp_path / "empty"), 3) == []


def test_receipts_are_inserted_once_and_forgotten(spark, tmp_path):
    store = str(tmp_path / "store")
    assert receipts.receipts(spark, store).count() == 0
    rows = [(str(i), i, None, json.dumps({"output": f"o{i}", "output_bytes": i, "tool": 3})) for i in range(5)] + [("torn", 9, "s", '{"output"'), ("none", 9, "s", None)]
    for batch, part in (("b1", rows[:3]), ("b2", rows[3:]), ("b1", rows[:3])):
        receipts.insert(spark.createDataFrame(part, BODIES), store, batch)
    assert receipts.receipts(spark, store).count() == 5
    receipts.delete(spark.createDataFrame([("1",), ("7",)], "id string"), store, "d1")
    receipts.delete(spark.createDataFrame([("4",)], "id string"), store, "d2")
    page = receipts.newest(receipts.receipts(spark, store), 2)
    assert [(r["id"], r["date"], r["output_name"], r["output_bytes"]) for r in page.collect()] == [("3", "1970-01-01T00:00:03Z", "o3", 3), ("2", "1970-01-01T00:00:02Z", "o2", 2)]
    receipts.compact(spark, store, str(tmp_path / "other"))
    assert receipts.receipts(spark, str(tmp_path / "other")).count() == 3
    assert receipts.delete_all(spark, store) == 3 and receipts.receipts(spark, store).count() == 0


def slow_boxes(mask):
    seen, out = set(), []
    h, w = mask.shape
    for y in range(h):
        for x in range(w):
            if mask[y, x] and (y, x) not in seen:
                part, todo = set(), [(y, x)]
                while todo:
                    a, b = todo.pop()
                    if 0 <= a < h and 0 <= b < w and mask[a, b] and (a, b) not in part:
                        part.add((a, b))
                        todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
                seen |= part
                out.append((min(b for _, b in part), min(a for a, _ in part), max(b for _, b in part), max(a for a, _ in part)))
    return out


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**31), st.floats(0.2, 0.8))
def test_boxes_against_flooding(h, w, seed, p):
    mask = (np.random.default_rng(seed).random((h, w)) < p).astype(np.uint8)
    assert features.boxes_of(mask) == slow_boxes(mask)


def test_mel_of_a_tone_peaks_in_its_band(spark):
    filters = features.mel_filters()
    tone = np.sin(2 * np.pi * 1000 * np.arange(16_000) / 16_000)
    found = features.mel_of(tone, filters)
    assert found.shape == (3000, 80) and abs(int(found[50].argmax()) - int(filters[:, 25].argmax())) <= 1
    assert np.isclose(found.min(), found.max() - 2) and np.allclose(features.mel_of(np.array([]), filters), -1.5)
    n = np.arange(400)
    frame = tone[50 * 160 - 200 : 50 * 160 + 200] * (0.5 - 0.5 * np.cos(2 * np.pi * n / 400))
    power = np.array([abs(np.sum(frame * np.exp(-2j * np.pi * k * n / 400))) ** 2 for k in range(201)])
    logs = np.log10(np.maximum(filters @ power, 1e-10))
    assert np.allclose(found[50], (np.maximum(logs, found.max() * 4 - 4 - 8) + 4) / 4)
    rows = spark.createDataFrame([(1, [0.5] * 10), (2, None)], "id long, xs array<double>")
    assert features.log_mel(rows).count() == 6000


def test_sheets_and_merged_pages(spark):
    cells = spark.createDataFrame([(1, 1, 5, 0, "text", "other", None, None), (1, 0, 2, 1, "text", "a,b", None, None), (1, 0, 4, 2, "number", None, 2.0, None), (1, 0, 4, 1, "bool", None, None, True)], "doc long, sheet int, row int, col int, type string, str string, num double, bool boolean")
    assert [(r["row"], r["line"]) for r in tabular.sheet_csv(cells).orderBy("row").collect()] == [(0, '"a,b",'), (1, ","), (2, "TRUE,2")]
    pages = spark.createDataFrame([(1, 9, 1), (1, 4, 1), (1, 4, 2), (2, 5, 1)], "g int, src int, page int")
    assert [tuple(r) for r in pageset.merge(pages, "g", "src").select("g", "src", "page", "place").orderBy("g", "place").collect()] == [(1, 4, 1, 1), (1, 4, 2, 2), (1, 9, 1, 3), (2, 5, 1, 1)]
