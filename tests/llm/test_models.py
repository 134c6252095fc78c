"""Mixing, the two classifiers, personal data and the pipeline."""

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import same, views
from weftline.llm import mixing, pii, quality, registry, toxicity
from weftline.llm.text import documents

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_oracle(spark, name):
    same(registry.queries()[name](spark, SF), views(SF), registry.oracles()[name])


MIX = "doc_id long, text string, source string, weight string, rate string"
ROWS = [(i, "word " * (i % 7), "hot" if i % 3 else f"s{i % 5}", None, None) for i in range(3000)] + [(None, None, None, None, None), (5, "x", "never", None, None)]


def test_mixture_reaches_its_weights(spark):
    df = spark.createDataFrame(ROWS, MIX)
    weights = {"hot": 1.0, "s0": 1.0, "s1": 1.0, "never": 0.0}
    out = mixing.mixed(df, weights, seed=3)
    assert out.columns == df.columns and out.where("source = 'never'").count() == 0
    mass = {r["source"]: r["m"] for r in out.selectExpr("source", "length(coalesce(text, '')) + 1 AS m").groupBy("source").agg({"m": "sum"}).withColumnRenamed("sum(m)", "m").collect()}
    share = sum(len(r[1] or "") + 1 for r in ROWS) / 7  # seven sources with weight 1: three named, s2 to s4, and null
    assert all(abs(mass[s] / share - 1) < 0.2 for s in ("hot", "s0", "s1"))
    assert mixing.mixed(df.limit(0), weights).count() == 0
    again = mixing.mixed(df.repartition(7), weights, seed=3)
    assert sorted(map(repr, out.collect())) == sorted(map(repr, again.collect()))


def test_high_rates_are_sums(spark):
    df = spark.createDataFrame([(i, "a", "few") for i in range(40)] + [(1000 + i, "a", "many") for i in range(4000)], "doc_id long, text string, source string")
    out = mixing.replicate(df, {"few": 1.0, "many": 1.0}).where("source = 'few'")
    per_doc = [r["n"] for r in out.groupBy("doc_id").agg({"doc_id": "count"}).withColumnRenamed("count(doc_id)", "n").collect()]
    assert abs(np.mean(per_doc) - 50.5) < 4 and 20 < np.var(per_doc) < 120


def test_salted_rates_agree(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, MIX)
    plain = sorted(map(repr, mixing.mixed(df, {"hot": 2.0}).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(repr, mixing.mixed(df, {"hot": 2.0}).collect())) == plain


# -- toxicity --------------------------------------------------------------------------------


def marked(n, seed, words):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = int(rng.random() < 0.2)
        text = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randint(3, 60))]
        if label:
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text).capitalize(), label))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = marked(1500, 1, ["vile", "rotten!", "Scoundrel", "zzqed", "zzqing", "zzqly"])
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(df.drop("label"), df.where("doc_id < 1000").select("doc_id", "label"))
    assert len(model.features) < 20_000
    found = toxicity.score(df, model, "doc_id", "label").where("doc_id >= 1000").collect()
    assert np.mean([(r["weftline_score"] >= 0.5) == (r["label"] == 1) for r in found]) > 0.97
    assert all(0 <= r["weftline_score"] <= 1 for r in found)


def test_toxicity_corners(spark):
    odd = spark.createDataFrame([(1, None, "l"), (2, "", "l"), (None, "vile", "l"), (3, "é " * 90_000, "l"), (3, "é " * 90_000, "l"), (4, "...", "l")], "doc_id long, text string, weftline string")
    model = toxicity.fit(odd, spark.createDataFrame([(1, 0), (1, 1), (None, 1), (2, None)], "doc_id long, label int"))
    scores = [r["weftline_score"] for r in toxicity.score(odd, model, "doc_id").collect()]
    assert len(scores) == 6 and all(0 <= s <= 1 for s in scores)
    nothing = toxicity.fit(odd.limit(0), spark.createDataFrame([], "doc_id long, label int"))
    assert nothing.bias == 0 and {r["weftline_score"] for r in toxicity.score(odd, nothing, "doc_id").collect()} == {0.5}
    assert toxicity.reject(odd, nothing, 0.4).count() == 0 and toxicity.reject(odd, nothing, 0.6).columns == odd.columns


def test_grams_count_within_texts_only():
    data = np.frombuffer(b"one two" + b"three", np.uint8)
    text, feature = toxicity.grams(data, np.array([0, 7, 12]))
    alone = [toxicity.grams(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[1] for x in (b"ONE, two", b"three")]
    assert sorted(feature[text == 0]) == sorted(alone[0]) and sorted(feature[text == 1]) == sorted(alone[1])


def test_folds_keep_out_the_held_out_rows(spark):
    import zlib

    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    kept = {r["doc_id"] for r in toxicity.training_labels(labels, "toxic", 5, 0).collect()}
    assert kept == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5}


# -- quality ---------------------------------------------------------------------------------


def brute_marginals(score, transition):
    n, total, good = len(score), 0.0, np.zeros(len(score))
    for labels in itertools.product((0, 1), repeat=n):
        weight = np.exp(sum(score[i] * labels[i] for i in range(n)) + sum(transition[labels[i]][labels[i + 1]] for i in range(n - 1)))
        total += weight
        good += weight * np.array(labels)
    return good / total


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(0)
    sizes = [3, 1, 7, 5]
    score, text, transition = rng.normal(size=sum(sizes)), np.repeat(range(4), sizes), rng.normal(size=(2, 2))
    p, expected = quality.marginals(score, text, transition)
    wanted = np.concatenate([brute_marginals(score[text == t], transition) for t in range(4)])
    assert np.allclose(p, wanted) and np.isclose(expected.sum(), sum(sizes) - 4)


def test_field_ascends_its_likelihood():
    """The gradient of the fit against differences of a likelihood that enumerates all labellings."""
    rng = np.random.default_rng(4)
    full, chain, y = rng.normal(size=(7, 3)), np.array([0, 0, 0, 1, 1, 2, 2]), np.array([1.0, 0, 1, 1, 1, 0, 0])
    x = rng.normal(size=7)

    def likelihood(x):
        total = 0.0
        for c in range(3):
            at = np.flatnonzero(chain == c)
            score = lambda ys: sum((full[i] @ x[:3]) * v for i, v in zip(at, ys, strict=True)) + sum(x[3:].reshape(2, 2)[int(a), int(b)] for a, b in zip(ys[:-1], ys[1:], strict=True))  # noqa: B023, E731
            total += score(y[at]) - np.log(sum(np.exp(score(ys)) for ys in itertools.product((0, 1), repeat=len(at))))
        return total / 7 - quality.DECAY / 2 * (x @ x)

    slopes = [(likelihood(x + e) - likelihood(x - e)) / 2e-5 for e in 1e-5 * np.eye(7)]
    assert np.allclose(quality.ascent(full, chain, y)(x), slopes, atol=1e-5)


def test_chains_hold_every_line():
    text = np.repeat([0, 1, 2, 5], [1, 64, 65, 200])
    chain = quality.segments(text)
    assert np.bincount(chain)[1:].tolist() == [1, 64, 64, 1, 64, 64, 64, 8] and all(len(set(text[chain == c])) == 1 for c in set(chain.tolist()))
    assert len(quality.segments(np.zeros(0, np.int64))) == 0


def test_ftrl_against_a_plain_loop():
    rng = random.Random(2)
    rows = [(np.array(sorted(rng.sample(range(30), rng.randint(1, 6))), np.int32), rng.randint(0, 1)) for _ in range(60)]
    z, n, bias = {}, {}, 1 << toxicity.BITS

    def weight(i):
        l1 = 0.0 if i == bias else toxicity.L1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(3):
        for features, label in rows:
            at = [*features.tolist(), bias]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - label
            for i in at:
                z[i] = z.get(i, 0.0) + g - ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / toxicity.ALPHA * w[i]
                n[i] = n.get(i, 0.0) + g * g
    found, evidence = toxicity.ftrl(rows, 3)
    assert all(abs(found[i] - weight(i)) < 1e-9 and abs(evidence[i] - n[i]) < 1e-9 for i in n) and np.count_nonzero(evidence) == len(n)


def test_lines():
    texts = [b"Abc de\n\n|x|", b"", b"\n", b"same\nsame"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    text, size, features = quality.line_features(data, offsets)
    assert text.tolist() == [0, 0, 0, 1, 2, 2, 3, 3] and size.tolist() == [6, 0, 3, 0, 0, 0, 4, 4]
    assert features[0, 1] == pytest.approx(1 / 6) and features[2, 6] == pytest.approx(2 / 3) and features[6:, 8].tolist() == [1, 1]


def test_quality_on_held_out_rows(spark):
    rng = random.Random(3)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(9)) + "."
    junk = [lambda: "BUY NOW!!! $$$ ### " * 3, lambda: "a | b | c | d", lambda: "go go go go go go go"]
    rows = []
    for i in range(600):
        label = int(rng.random() < 0.7)
        lines = [line() for _ in range(rng.randint(1, 12))]
        if not label:
            at = rng.randrange(len(lines))
            lines[at:at] = [rng.choice(junk)() for _ in range(rng.randint(len(lines), 2 * len(lines)))]
        rows.append((i, "\n".join(lines), label))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    field = quality.fit(df, df.where("doc_id < 400").select("doc_id", "label"))
    found = {r["doc_id"]: r["score"] for r in quality.score(df, field).collect()}
    assert np.mean([(found[i] >= 0.7) == (label == 1) for i, _, label in rows[400:]]) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "\n" * 5000), (3, "\n" * 5000)], "doc_id long, text string")
    scores = [r["score"] for r in quality.score(odd, field).collect()]
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores) and scores[3] == scores[4]
    one = quality.fit(df, df.where("label = 1").select("doc_id", "label"))
    assert min(r["score"] for r in quality.score(df, one).collect()) > 0.9
    none = quality.fit(df, df.limit(0).select("doc_id", "label"))
    assert {r["score"] for r in quality.score(df, none).collect()} == {0.5}


# -- personal data ---------------------------------------------------------------------------


def brute_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        if 16 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_spans():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("a@.1+- (9_b.@%0é") for _ in range(rng.randint(0, 40)))
        if rng.random() < 0.3:
            text += "".join(rng.choice("0123456789-  .") for _ in range(30))
        assert pii.base_spans(text) == brute_spans(text), text
    for text in ("a" * 300_000, "9" * 300_000, "@" * 300_000, "a@" * 100_000, "+1" * 100_000, "1." * 100_000, "a.b-" * 100_000):
        pii.mentions(text, pii.base_spans(text))


def test_discovery(spark):
    """Order numbers after a phrase that surrounds known phones are found; others are not."""
    rows = [(i, f"Please reach me at: +1 (555) 010-{1000 + i} before noon. Ref{i} is 77{i:04d} here.") for i in range(30)]
    rows += [(100 + i, f"Well, reach me at: 555-88{i:02d} before noon.") for i in range(3)] + [(200, None), (201, ""), (None, "x"), (201, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.extract(df).collect()}
    assert all(found[100 + i]["n_discovered"] == 1 and found[100 + i]["spans"] == "phone:19:27" for i in range(3))
    assert all(found[i]["n_discovered"] == 0 and found[i]["n_phone"] == 1 for i in range(30))
    assert found[200]["spans"] == "" and pii.extract(df).count() == len(rows) and pii.extract(df.limit(0)).count() == 0


def test_odd_forms_are_found_by_their_contexts(spark):
    """Obfuscated addresses, grouped and short numbers, a very long word; ordinary words in the same places are left alone."""
    rows = [(i, f"Kindly write an email to user{i}@mail.example today. Or dial number +1 (555) 010-{1000 + i} for help. We walk towards place{i}x quickly.") for i in range(40)]
    odd = [(100, "Kindly write an email to jane(at)corp.example today."), (101, "Please dial number (030) 123 456 for help."), (102, "They dial number 911 for help."), (103, f"an email to {'z' * 300}(at)corp today.")]
    plain = [(200 + i, f"Nobody talks to word{i} anyway.") for i in range(40)]
    found = {r["doc_id"]: r for r in pii.extract(spark.createDataFrame(rows + odd + plain, "doc_id long, text string")).collect()}
    at = lambda text, part: (text.index(part), text.index(part) + len(part))
    for (i, text), kind, part in zip(odd, ("email", "phone", "phone", "email"), ("jane(at)corp.example", "(030) 123 456", "911", "z" * 300 + "(at)corp"), strict=True):
        a, b = at(text, part)
        assert found[i]["spans"] == f"{kind}:{a}:{b}", (text, found[i])
    assert all(found[i]["n_discovered"] == 0 for i, _ in rows + plain)


def plain_graph(texts, rounds=pii.ROUNDS, support=pii.SUPPORT):
    """The graph's rounds as loops over dictionaries."""
    edges, seeds = set(), {}
    for text in texts:
        for m in pii.mentions(text, pii.base_spans(text)):
            edges |= {(m["instance"], p) for p in m["patterns"]}
            if m["kind"]:
                seeds[m["instance"], m["kind"]] = 1.0
    degree, scores, known = {}, dict(seeds), {i for i, _ in seeds}
    for _, p in edges:
        degree[p] = degree.get(p, 0) + 1
    for _ in range(rounds):
        weight, miss = {}, {}
        for i, p in edges:
            for k in pii.KINDS:
                if (i, k) in scores:
                    weight[p, k] = weight.get((p, k), 0) + scores[i, k]
        sure = {(p, k): w / degree[p] for (p, k), w in weight.items() if w >= support and w / degree[p] >= pii.RELIABLE}
        for i, p in edges:
            for k in pii.KINDS:
                if (p, k) in sure and i not in known:
                    miss[i, k] = miss.get((i, k), 1) * max(1e-9, 1 - sure[p, k])
        scores = seeds | {key: 1 - m for key, m in miss.items()}
    best = {}
    for (i, k), score in scores.items():
        if i not in known and score >= pii.ACCEPT:
            best[i] = max(best.get(i, (0, "")), (score, k))
    return {i: k for i, (_, k) in best.items()}


def test_discovery_against_plain_loops(spark):
    rng = random.Random(3)
    numbers = [f"{rng.randint(1000, 9999)}-{i}" for i in range(40)]
    texts = []
    for i in range(400):
        what = f"+1 555 010 {rng.randint(1000, 1040)}" if i % 2 else f"a{rng.randint(0, 90)}{rng.choice('cde')}@b.example"
        before = rng.choice(["call me", "see item"] if i % 2 else ["reach us", "see item"])
        if rng.random() < 0.1:
            what, before = rng.choice(numbers), rng.choice(["call me", "reach us", "see item", "at row"])
        texts.append(f"so {before} {what} {rng.choice(['now', 'please', '.'])}")
    found = pii.discovered(pii.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    wanted = plain_graph(texts)
    assert wanted and {r["instance"]: r["kind"] for r in found.collect()} == wanted


def test_scans_are_linear():
    times = []
    for n in (4_000, 16_000):
        text = "a@b.example 123456 " * n + "x@y.zz," * n
        began = time.perf_counter()
        pii.mentions(text, pii.base_spans(text))
        pii.surrounded(text, lambda w: True, lambda p: False)
        times.append(time.perf_counter() - began)
    assert times[1] < 10 * times[0]


def test_pii_query(spark):
    texts = {r["doc_id"]: r["text"] for r in documents(spark, SF).collect()}
    for r in pii.op9(spark, SF).collect():
        spans = brute_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]


# -- pipeline --------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline
    from tests.llm.test_pairs import brute_components, brute_fingerprint
    from tests.llm.test_tokens import check_pieces

    docs = documents(spark, SF)
    columns, before = docs.columns, docs
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = spark.createDataFrame(stage(spark, before, SF).collect(), before.schema)
        assert before.columns == columns, name
        kept.append({r["doc_id"]: r["text"] for r in before.collect()})
    clean, exact, near, mix = kept
    lowered = {}
    for d, t in clean.items():
        key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        lowered[key] = max(d, lowered.get(key, -1))
    assert set(exact) == set(lowered.values())
    components = brute_components({d: brute_fingerprint(t) for d, t in exact.items()})
    assert set(near) == set(components.values())
    assert set(mix) <= set(near)
    rows = before.collect()
    check_pieces(corpus_pipeline.STAGES[-1][1](spark, before, SF).collect(), [(r["doc_id"], r["text"]) for r in rows])


@pytest.mark.parametrize("good", [500, 7, 1])
def test_every_sampled_row_has_a_learner(spark, good):
    rows = spark.createDataFrame([(i, int(i < good), f"text {i}", i) for i in range(600)], "doc_id long, label int, text string, tie long")
    shares = {}
    for r in toxicity.dealt(rows, 4).withColumn("task", F.spark_partition_id()).collect():
        shares.setdefault(r["learner"], []).append((r["label"], r["task"]))
    assert len(shares) == min(4, good) and sum(map(len, shares.values())) == 600
    for rows in shares.values():
        assert len({task for _, task in rows}) == 1 and {label for label, _ in rows} == {0, 1}
    sizes = [len(rows) for rows in shares.values()]
    assert max(sizes) - min(sizes) <= 2


@pytest.mark.parametrize("module,label,folds,held_out", [(toxicity, "toxic", 5, 0), (quality, "quality", 4, 2)])
def test_registered_classifiers(spark, module, label, folds, held_out):
    """The query over its table: every row, the contract's fold, few mistakes on it."""
    (query,) = module.QUERIES.values()
    folder = SF.replace("0.001", "0.01")
    rows = {r["doc_id"]: r for r in query(spark, folder).collect()}
    assert len(rows) == documents(spark, folder).count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % folds == held_out) and 0 <= r["score"] <= 1 for d, r in rows.items())
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    unseen = [d for d in labels if d in rows and rows[d]["held_out"]]
    assert sum(rows[d]["predicted"] == labels[d] for d in unseen) >= 0.9 * len(unseen)


def test_pipeline_on_dirty_rows(spark):
    """Nulls, repeated rows, ties and an empty table through every stage."""
    import corpus_pipeline
    from tests.llm.test_pairs import brute_components, brute_fingerprint
    from tests.llm.test_tokens import check_pieces

    docs = documents(spark, SF)
    rows = [tuple(r) for r in docs.limit(30).collect()]
    rows += rows[:5] + [(None, rows[0][1], None, None, None), (None, None, None, "src0", None), (901, None, "en", "src0", 0), (902, "", "en", "src1", 0), (903, rows[1][1].upper() if rows[1][1].isascii() else "A b", "en", None, 3), (904, "word " * 40_000, "en", "src2", None)]
    tables = [spark.createDataFrame(rows, docs.schema), spark.createDataFrame([], docs.schema)]
    for table in tables:
        before = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, before, SF)
            assert after.columns == docs.columns, name
            had, got = [tuple(r) for r in before.collect()], [tuple(r) for r in after.collect()]
            assert set(got) <= set(had), name
            if name == "exact dedup":
                lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
                best = {}
                for r in had:
                    best[lower(r[1])] = max(best.get(lower(r[1]), -1), -1 if r[0] is None else r[0])
                assert sorted((lower(r[1]), -1 if r[0] is None else r[0]) for r in got) == sorted(best.items())
                texts = {-1 if r[0] is None else r[0]: r[1] or "" for r in got}
            if name == "simhash near-dedup":
                groups = brute_components({d: brute_fingerprint(t) for d, t in texts.items() if d != -1})
                assert {r[0] for r in got if r[0] is not None} >= set(groups.values()) - ({min(texts)} if -1 in texts else set())
                assert len(got) == len({r[0] for r in got})
            before = spark.createDataFrame(got, docs.schema)
        check_pieces(corpus_pipeline.STAGES[-1][1](spark, before, SF).collect(), [(r[0], r[1]) for r in got])
    assert not [r for r in spark.sql("SHOW TABLES").collect() if r["tableName"].startswith("weftline_digests")]


def test_few_drops_move_no_text(spark):
    from weftline.llm import exact_dedup

    docs = spark.createDataFrame([(i, f"text number {i // 2 if i < 6 else i}") for i in range(400)], "doc_id long, text string").repartition(6)
    kept = exact_dedup.keep_first(docs)
    assert kept.count() == 397
    rows = kept.collect()
    plan = kept._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(rows) == 397 and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
