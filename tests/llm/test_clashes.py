"""Extra columns whose names the operators use inside, with nulls, repeats, ties and long texts beside them."""

import pytest

from weftline.llm import passages, pii, quality, toxicity

PASSAGE = " ".join(f"shared{i}" for i in range(60))
ROWS = [(3, f"own words first {PASSAGE} and then others"), (7, f"something else {PASSAGE}"), (7, f"something else {PASSAGE}"), (None, PASSAGE), (9, None), (8, ""), (5, "call me at +1 555 010 1234 or a@b.example now"), (4, "w " * 60_000)]


def clashing(spark, *names):
    return spark.createDataFrame([(*r, *["x"] * len(names)) for r in ROWS], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))


def test_quality(spark):
    labelled = spark.createDataFrame([(3, 1), (7, 0), (9, 1), (8, 0)], "doc_id long, label int")
    docs = clashing(spark, "label", "score", "learner", "tie", "row", "hundredths", "weights")
    field = quality.fit(docs, labelled)
    found = quality.score(docs, field).collect()
    assert len(found) == len(ROWS) and all(0 <= r["score"] <= 1 for r in found)
    assert {r["score"] for r in found if r["doc_id"] == 7} == {r["score"] for r in quality.score(docs.select("doc_id", "text"), field).where("doc_id = 7").collect()}
    assert quality.score(docs.limit(0), field).count() == 0


def test_toxicity(spark):
    labelled = spark.createDataFrame([(3, 1), (7, 0), (9, 1), (8, 0)], "doc_id long, label int")
    docs = clashing(spark, "label", "score", "learner", "tie", "feature", "weight", "evidence")
    kept = toxicity.reject(docs, toxicity.fit(docs, labelled), 1.1)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)


@pytest.mark.parametrize("names", [("id", "part", "seed", "at", "other"), ("block", "words", "group", "side", "x0", "island", "passage_start", "n")])
def test_passages(spark, names):
    docs = clashing(spark, *names)
    found = {(r["doc_id"], r["start_word"], r["end_word"], r["other_id"]) for r in passages.passages(docs).collect()}
    # A null id is the smallest, so its text is the first that holds the passage.
    assert {f[:3] for f in found} == {(3, 3, 63), (7, 2, 62)}
    cut = passages.without_repeats(docs)
    assert cut.columns == docs.columns
    texts = {(r["doc_id"], " ".join((r["text"] or "").split())[:40], r[names[0]]) for r in cut.collect()}
    assert (3, "own words first and then others", "x") in texts and (7, "something else", "x") in texts and (None, PASSAGE[:40], "x") in texts
    assert cut.count() == len(ROWS) and passages.without_repeats(docs.limit(0)).count() == 0


def test_personal_data(spark):
    docs = clashing(spark, "spans", "kind", "instance", "pattern", "base", "key", "n_email")
    found = {r["doc_id"]: r for r in pii.extract(docs).collect()}
    assert found[5]["spans"] == "email:30:41,phone:11:26" and found[3]["spans"] == "" and found[9]["spans"] == ""
    assert pii.extract(docs).count() == len(ROWS) and pii.extract(docs.limit(0)).count() == 0
