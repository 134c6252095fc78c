import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import pageset, provenance, receipts, signal, tabular, timeline
from weftline.sources import archives


def test_csv_keeps_everything(spark):
    files = spark.createDataFrame([("f", 'name,amount\n"Doe, ""J""\nx",1.50\nBob,\nshort\na,b,c,d\n')], "file string, content string")
    rows = [json.loads(r["object"]) for r in tabular.csv_to_json(files).orderBy("row").collect()]
    assert rows == [{"name": 'Doe, "J"\nx', "amount": "1.50"}, {"name": "Bob", "amount": ""}, {"name": "short", "amount": None}, {"name": "a", "amount": "b", "extra_column_1": "c", "extra_column_2": "d"}]


def test_json_columns_by_first_appearance(spark):
    df = spark.createDataFrame([(1, '{"b":2,"a":"x,y"}'), (2, '{"c":null,"a":true}')], "row long, object string")
    assert [r["line"] for r in tabular.json_to_csv(df).orderBy("row").collect()] == ["a,b,c", '"x,y",2,', "true,,"]
    with pytest.raises(Exception, match="nested"):
        tabular.json_to_csv(spark.createDataFrame([(1, '{"a":{"n":1}}')], "row long, object string")).collect()


SAMPLES = "track int, ord int, ts long, keyframe boolean"


def test_trim_snaps_back_to_a_keyframe(spark):
    rows = [(1, i, i * 10, i in (1, 4, 7)) for i in range(1, 10)] + [(2, i, i * 10, False) for i in range(1, 10)] + [(3, 1, 5, True)]
    found = timeline.trim(spark.createDataFrame(rows, SAMPLES), 55, 80)
    kept = {t: [r["ord"] for r in found.where(f"track = {t}").orderBy("ord").collect()] for t in (1, 2, 3)}
    assert kept == {1: [4, 5, 6, 7], 2: [6, 7], 3: []}


def test_trim_end_is_a_filter(spark):
    rows = [(1, 1, 0, True), (1, 2, 90, False), (1, 3, 20, False)]
    assert [r["ord"] for r in timeline.trim(spark.createDataFrame(rows, SAMPLES), 0, 50).orderBy("ord").collect()] == [1, 3]


def test_concat_is_monotone(spark):
    one = spark.createDataFrame([(1, 1, 100, True)], SAMPLES)
    assert [r["ts"] for r in timeline.concat(one, one).orderBy("ts").collect()] == [100, 201]


@pytest.mark.parametrize("n, buckets", [(5, 8), (10, 3), (96, 96), (7, 7)])
def test_peaks_by_rule(spark, n, buckets):
    rows = [(1, f, (f + 1) / n * (-1) ** f) for f in range(n)]
    found = {r["bucket"]: r["peak"] for r in timeline.peaks(spark.createDataFrame(rows, "track int, frame long, v double"), buckets).collect()}
    wanted = {}
    for b in range(buckets):
        start = b * n // buckets
        end = min(max((b + 1) * n // buckets, start + 1), n)
        wanted[b] = int(max(abs(rows[f][2]) for f in range(start, end)) * 255 + 0.5)
    assert found == wanted


def test_page_specs(spark):
    df = spark.createDataFrame([(s,) for s in ("1-3,7", "2-", "3,1,1-2", "-3", "9-", ",,", "8-7")], "spec string")
    from pyspark.sql import functions as F

    found = [r["r"] for r in df.select(pageset.parse_spec(F.col("spec"), F.lit(8)).alias("r")).collect()]
    assert [(x["pages"], x["error"]) for x in found] == [([1, 2, 3, 7], None), (list(range(2, 9)), None), ([1, 2, 3], None), (None, "no first page"), (None, "no such page"), (None, "no pages were named"), (None, "runs backwards")]


def test_sequences(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([0, 1, 1, 0, 1, 2, 2, 0],), ([5, 7, 8, 7, 8, 7, 8],), ([1, 2, 3],), ([],)], "xs array<int>")
    assert [r[0] for r in df.select(signal.ctc_collapse(F.col("xs"))).collect()] == [[1, 1, 2], [5, 7, 8, 7, 8, 7, 8], [1, 2, 3], []]
    assert [r[0] for r in df.select(signal.cut_loop(F.col("xs"))).collect()] == [[0, 1, 1, 0, 1, 2, 2, 0], [5, 7, 8], [1, 2, 3], []]


def test_journal_skips_torn_lines(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"source_name":"a","outcome":"completed","output_name":"x"}\n{"source_name":"b"\n{"source_name":"a","outcome":"failed"}\n')
    journal = provenance.read_journal(spark, str(tmp_path))
    assert sorted(r["outcome"] for r in journal.collect()) == ["completed", "failed"]


def test_resume(spark):
    from pyspark.sql import functions as F

    journal = spark.createDataFrame([(1, "a", "completed", "x"), (2, "b", "completed", "y"), (3, "b", "failed", None), (4, "c", "completed", "gone")], "n int, source_name string, outcome string, output_name string")
    files = spark.createDataFrame([(x,) for x in "abcd"], "source_name string")
    outputs = spark.createDataFrame([("x",), ("y",)], "output_name string")
    assert sorted(r[0] for r in provenance.resume(files, journal, F.col("n"), outputs).collect()) == ["b", "c", "d"]


def test_archives_refuse(spark):
    good = archives.packed([("a/b.txt", b"x")], "zip")
    bad = archives.packed([("../b.txt", b"x")], "tar")
    df = spark.createDataFrame([("good", bytearray(good)), ("bad", bytearray(bad)), ("junk", bytearray(b"zz")), ("null", None)], "path string, content binary")
    found = {r["path"]: (r["name"], r["error"]) for r in archives.entries(df).collect()}
    assert found["good"] == ("a/b.txt", None) and "escapes" in found["bad"][1] and found["junk"][1] == found["null"][1] == "not an archive"
    tight = archives.entries(df.where("path = 'good'"), archives.Limits(total=0)).first()
    assert "limit" in tight["error"]


def test_journal_stream(spark, tmp_path):
    from weftline.streaming import journal

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"source_name":"a","content_id":"1","at":"2024-01-01T00:00:00"}\n{"source_name":"b","content_id":"1","at":"2024-01-01T00:01:00"}\n{torn\n')
    seen = []
    query = journal.follow(journal.once(journal.journal_stream(spark, str(folder))), lambda df, n: seen.extend(df.collect()), str(tmp_path / "state"))
    query.awaitTermination()
    assert [r["content_id"] for r in seen] == ["1"]


def test_times_of_receipts_beyond_the_year_9999(spark):
    rows = [(253_402_300_799,), (253_402_300_800,), (86_399 * 5_999_999,), (-5,)]
    found = spark.createDataFrame(rows, "s long").select(receipts.iso_time(F.col("s")).alias("t")).collect()
    assert [r["t"] for r in found] == ["9999-12-31T23:59:59Z", "10000-01-01T00:00:00Z", "18397-04-01T13:20:01Z", "1970-01-01T00:00:00Z"]
