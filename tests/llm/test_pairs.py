"""Exact dedup, SimHash near-dedup and substring dedup against brute force."""

import random
import re
import string

import numpy as np
import pytest
import xxhash

from weftline.llm import exact_dedup, golay, passages, simhash
from weftline.llm.components import connected
from weftline.llm.text import documents

SF = "/root/testdata/sf0.001"
DIRTY = "doc_id long, text string, digest string, keep_id string, fp string"
ROWS = [(1, "A b c d e", "x", "p", "z"), (2, "a B c d e", "x", "p", "z"), (2, "a B c d e", "x", "p", "z"), (None, "q", None, None, None), (3, None, "n", None, None), (4, "", "e", None, None), (None, None, "n", None, None), (5, "w " * 50_000, "x", None, None)]


def test_exact_dedup_keeps_the_largest_id(spark):
    rows = exact_dedup.ingest(spark.createDataFrame(ROWS, DIRTY), exact_dedup.fresh_index(spark)).collect()
    found = sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in rows if r["group_size"] == 3)
    assert found == [(0, 4, 3, False), (1, 2, 3, False), (2, 2, 3, True), (2, 2, 3, True), (3, 4, 3, False), (4, 4, 3, True)]


def test_exact_dedup_against_an_index(spark):
    index = exact_dedup.fresh_index(spark)
    first = spark.createDataFrame(ROWS, DIRTY)
    assert sorted(r["doc_id"] or 0 for r in exact_dedup.keep_new(first, index).collect()) == [0, 2, 4, 5]
    later = spark.createDataFrame([(9, "A B C D E", None, None, None), (10, "new", None, None, None)], DIRTY)
    kept = exact_dedup.keep_new(later, index)
    assert kept.columns == later.columns and [r["doc_id"] for r in kept.collect()] == [10]
    assert exact_dedup.keep_new(first.limit(0), index).count() == 0
    assert index.read().groupBy("digest").count().where("count > 1").count() == 0


def test_exact_dedup_reads_the_index_without_a_shuffle(spark):
    index = exact_dedup.fresh_index(spark)
    exact_dedup.ingest(spark.createDataFrame(ROWS, DIRTY), index)
    plan = index.new_groups(index.read())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    # The batch's digests are shuffled and sorted once; the index is read as it lies.
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [digest") == 1, plan


def test_a_batch_that_died_is_found_new_again(spark):
    index = exact_dedup.fresh_index(spark)
    exact_dedup.keep_new(spark.createDataFrame(ROWS[:2], DIRTY), index, "early").collect()
    later = spark.createDataFrame([*ROWS, (9, "only here", None, None, None)], DIRTY)
    exact_dedup.ingest(later, index, "late")  # appended, and its result lost
    again = exact_dedup.keep_new(later, index, "late")
    assert sorted(r["doc_id"] or 0 for r in again.collect()) == [0, 4, 5, 9]
    index.compact()
    assert len(index.runs()) == 1
    assert sorted(r["doc_id"] or 0 for r in exact_dedup.keep_new(later, index, "late").collect()) == [0, 4, 5, 9]
    assert exact_dedup.keep_new(later, index, "third").count() == 0


def test_runs_are_merged(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_RUNS", 2)
    index = exact_dedup.fresh_index(spark)
    kept = [exact_dedup.keep_new(spark.createDataFrame([(i, f"t{j}") for j in range(i, i + 3)], "doc_id long, text string"), index).count() for i in range(6)]
    assert kept == [3, 1, 1, 1, 1, 1] and len(index.runs()) <= 4 and index.read().count() == 8
    index.drop()
    assert not index.runs()


def test_two_batches_agree_with_one(spark):
    rows = exact_dedup.ingest_all(spark.createDataFrame(ROWS, DIRTY), exact_dedup.fresh_index(spark)).collect()
    found = sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in rows if r["group_size"] == 3)
    assert found == [(0, 4, 3, False), (1, 2, 3, False), (2, 2, 3, True), (2, 2, 3, True), (3, 4, 3, False), (4, 4, 3, True)]
    nothing = spark.createDataFrame([], DIRTY)
    assert exact_dedup.ingest_all(nothing, exact_dedup.fresh_index(spark)).count() == 0
    nulls = exact_dedup.ingest_all(spark.createDataFrame([(None, "a"), (None, "A")], "doc_id long, text string"), exact_dedup.fresh_index(spark))
    assert [(r["keep_id"], r["group_size"], r["kept"]) for r in nulls.collect()] == [(None, 2, True)] * 2


def test_hot_digests_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 4)
    rows = [(i, "hot" if i % 2 else f"t{i}") for i in range(60)]
    found = exact_dedup.ingest(spark.createDataFrame(rows, "doc_id long, text string"), exact_dedup.fresh_index(spark)).collect()
    assert {(r["keep_id"], r["group_size"]) for r in found if r["doc_id"] % 2} == {(59, 30)} and sum(r["kept"] for r in found) == 31


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = [w for w in re.split("[\x20\x09-\x0d]+", lowered) if w]
    if not parts:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(parts[i : i + 4]).encode(), seed=42) for i in range(max(1, len(parts) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in fps}


@pytest.mark.parametrize("text", ["", " \t", "one", "a b c d", "A  b\nC d e", "é ß ñ x y z", "x" * 9, "a b " * 300, "\x1c a\x85b c d e"])
def test_fingerprints(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_simhash_on_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in documents(spark, SF).collect()}
    fps = {d: brute_fingerprint(t) for d, t in texts.items()}
    wanted = {d: (format(fps[d], "016x"), c) for d, c in brute_components(fps).items()}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op10(spark, SF).collect()} == wanted


def test_links_lose_nothing_in_crowded_balls(spark):
    """Fingerprints crowded around a few centers, where buckets hold many components."""
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(40):
            x = center
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5, 6, 9])):
                x ^= 1 << b
            fps.add(x)
    wanted = {f: c for f, c in brute_components({np.uint64(f).astype(np.int64).item(): f for f in fps}).items()}
    df = spark.createDataFrame([(f,) for f in wanted], "fp long")
    found = {r["node"]: r["root"] for r in simhash.links(df).collect()}
    assert {f: found.get(f, f) for f in wanted} == wanted


def test_keep_one(spark):
    kept = simhash.keep_one(spark.createDataFrame(ROWS, DIRTY))
    assert kept.columns == [f.split()[0] for f in DIRTY.split(", ")]
    assert sorted(((r["doc_id"] or 0), r["text"][:1] if r["text"] else "") for r in kept.collect()) == [(0, "q"), (1, "A"), (3, ""), (5, "w")]
    assert simhash.keep_one(spark.createDataFrame([], DIRTY)).count() == 0


def test_golay_code_is_perfect():
    sample = np.random.default_rng(0).integers(0, 1 << 23, 3000)
    around, valid = golay.keys(sample)
    assert set(valid.sum(axis=1).tolist()) <= {1, 6}
    for flips in ((3,), (3, 17)):
        other = sample.copy()
        for b in flips:
            other ^= 1 << b
        keys, ok = golay.keys(other)
        assert all(set(a[v]) & set(b[w]) for a, v, b, w in zip(around, valid, keys, ok, strict=True))


def test_fuzzy_keys_meet_within_four_bits():
    rng = np.random.default_rng(1)
    a = rng.integers(-(1 << 63), (1 << 63) - 1, 1500)
    b = a.copy()
    for i in range(len(b)):
        low, high = [(0, 64), (0, 23), (23, 46), (46, 64)][i % 4]
        for bit in rng.choice(np.arange(low, high), 4, replace=False):
            b.view(np.uint64)[i] ^= np.uint64(1) << np.uint64(bit)
    keys = [set(zip(*(x.tolist() for x in simhash.fuzzy_keys(f)), strict=True)) for f in (a, b)]
    assert {row for row, _ in keys[0] & keys[1]} == set(range(len(a)))


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    found = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {v: r for v, r in root.items() if v != r}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        following = [i]
        for j, y in enumerate(b, 1):
            following.append(min(row[j] + 1, following[-1] + 1, row[j - 1] + (x != y)))
        row = following
    return row[-1]


def test_agreement_is_edit_distance():
    rng = random.Random(3)
    for _ in range(800):
        a = [rng.randint(0, 6) for _ in range(rng.randint(1, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = [rng.randint(0, 6)] * rng.randint(0, 1)
        true = 1 - edit_distance(a, b) / max(len(a), len(b))
        found = passages.agreement(np.array(a, "<u4"), np.array(b, "<u4"))
        assert found == pytest.approx(true) or max(found, true) < passages.SIMILARITY


def test_both_ways_to_count_edits():
    rng = random.Random(8)
    for _ in range(500):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(1, 25))] for _ in range(2))
        if rng.random() < 0.7:
            b = a[: rng.randint(0, len(a))] + b[:3] + a[rng.randint(0, len(a)) :]
        true, most = edit_distance(a, b), rng.randint(1, 12)
        left, right = np.array(a, "<u4"), np.array(b, "<u4")
        assert passages.few_edits(left, right, most) == (true if true <= most else None)
        assert min(passages.banded(left, right, most), most + 1) == min(true, most + 1) if len(b) else True


def brute_chain(x, y):
    value = [0.0] * len(x)
    for i in range(len(x)):
        best = max((value[j] - passages.GAP * (x[i] - x[j] + y[i] - y[j]) for j in range(i) if x[j] < x[i] and y[j] < y[i]), default=0)
        value[i] = passages.K + max(0, best)
    return max(value)


def test_chains_are_optimal():
    rng = random.Random(4)
    for _ in range(200):
        points = sorted({(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(rng.randint(2, 25))})
        x, y = (np.array(c) for c in zip(*points, strict=True))
        found = passages.chains(x, y)
        values = []
        for x0, x1, y0, y1, seeds in found:
            values.append(passages.K * seeds - passages.GAP * (x1 - passages.K - x0 + y1 - passages.K - y0))
        assert max(values) == pytest.approx(brute_chain(x.tolist(), y.tolist()))


def test_planted_passages(spark):
    """A passage in many documents, fuzzy and exact; clean documents stay out."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    passage, rows = text(60), []
    for i in range(30):
        body = text(rng.randint(20, 200))
        if i < 20:
            copy = list(passage)
            if i % 2:
                for at in rng.sample(range(60), 4):
                    copy[at] = word()
            at = rng.randint(0, len(body))
            body[at:at] = copy
        rows.append((i, " ".join(body)))
    rows += [(100, None), (101, ""), (102, "a b"), (None, " ".join(text(30) + passage)), (103, " ".join(text(5) * 400))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.passages(df).collect()
    assert {r["doc_id"] for r in found} | {r["other_id"] for r in found} == {*range(20), None}
    assert all(r["passage_end"] - r["passage_start"] <= 64 for r in found)
    cut = {r["doc_id"]: len((r["text"] or "").split()) for r in passages.without_repeats(df).collect()}
    before = {i: len((t or "").split()) for i, t in rows}
    assert all(cut[i] == before[i] for i in [*range(20, 30), 100, 101, 102, 103]) and sum(cut[i] < before[i] - 40 for i in [*range(20), None]) == 20
    assert passages.passages(df.limit(0)).count() == 0


def words_of(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


def test_rows_of_one_id_stay_apart(spark):
    """Two rows of one id whose 64-bit hashes agree in their last 15 bits share a passage."""
    rng = random.Random(8)
    passage, seen = " ".join(words_of(rng, 60)), {}
    for n in range(10_000):
        text = f"{n} {passage} {n} end"
        other = seen.setdefault(xxhash.xxh64_intdigest(text.encode(), seed=42) % (1 << 15), text)
        if other != text:
            break
    for doc_id in (7, None):
        df = spark.createDataFrame([(doc_id, other), (doc_id, text)], "doc_id long, text string")
        assert df.selectExpr("count(DISTINCT pmod(xxhash64(text), 32768))").first()[0] == 1
        assert [(r["doc_id"], r["passage_start"], r["passage_end"]) for r in passages.passages(df).collect()] == [(doc_id, 1, 61)]
        assert sorted(len(r["text"].split()) for r in passages.without_repeats(df).collect()) == [3, 63]


def test_chains_leave_no_match_over():
    rng = random.Random(5)
    for _ in range(200):
        points = sorted({(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(rng.randint(2, 25))})
        x, y = (np.array(c) for c in zip(*points, strict=True))
        found = passages.linked(x, y)
        assert sorted(i for c in found for i in c) == list(range(len(points)))
        assert all((np.diff(x[c]) > 0).all() and (np.diff(y[c]) > 0).all() for c in found)


def test_two_passages_of_a_pair(spark):
    """Pages with one header and one footer around bodies of their own, of unequal lengths."""
    rng = random.Random(9)
    header, footer = words_of(rng, 60), words_of(rng, 60)
    bodies = [60, 80, 40, 150, 60]
    df = spark.createDataFrame([(i, " ".join([*header, *words_of(rng, n), *footer])) for i, n in enumerate(bodies)], "doc_id long, text string")
    found = {(r["doc_id"], r["passage_start"], r["passage_end"]) for r in passages.passages(df).collect()}
    assert found == {(i, *span) for i, n in enumerate(bodies) if i for span in ((0, 60), (60 + n, 120 + n))}
    assert {r["doc_id"]: len(r["text"].split()) for r in passages.without_repeats(df).collect()} == {i: n if i else 180 for i, n in enumerate(bodies)}


@pytest.mark.parametrize("length", [6, 9, 12, 15, 20])
def test_repeated_lines(spark, length):
    """A block of one line, ten times over, in three documents; once in a fourth."""
    rng = random.Random(length)
    line = words_of(rng, length)
    rows = [(i, " ".join([*words_of(rng, 30 + i), *line * 10, *words_of(rng, 25)])) for i in range(1, 4)]
    rows.append((0, " ".join([*words_of(rng, 30), *line, *words_of(rng, 30)])))
    for some in (rows[:3], rows) if length >= 12 else (rows[:3],):  # shorter lines may lack a seed of their own
        found = passages.passages(spark.createDataFrame(some, "doc_id long, text string")).collect()
        first = min(i for i, _ in some)
        assert {(r["doc_id"], r["passage_start"], r["passage_end"]) for r in found} == {(i, 30 + i, 30 + i + 10 * length) for i in range(1, 4) if i > first}


def test_copies_within_a_document(spark):
    """Each copy of a passage is found whole: two in one document, and one after half a copy."""
    rng = random.Random(10)
    passage, own = words_of(rng, 100), lambda: words_of(rng, 50)
    rows = [(0, [*own(), *passage, *own()]), (1, [*own(), *passage, *own(), *passage, *own()]), (2, [*own(), *passage[:50], *own(), *passage, *own()])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    found = {(r["doc_id"], r["passage_start"], r["passage_end"]) for r in passages.passages(df).collect()}
    assert found == {(1, 50, 150), (1, 200, 300), (2, 50, 100), (2, 150, 250)}
    assert {r["doc_id"]: len(r["text"].split()) for r in passages.without_repeats(df).collect()} == {0: 200, 1: 150, 2: 150}


def test_passages_whose_words_came_before_in_parts(spark):
    """The seeds of a passage first occur in ten documents of 15 of its words each."""
    rng = random.Random(31)
    shared = words_of(rng, 80)
    rows = [(i, " ".join(words_of(rng, 30) + shared[8 * i : 8 * i + 15] + words_of(rng, 30))) for i in range(10)]
    rows += [(i, " ".join(words_of(rng, 40) + shared + words_of(rng, 40))) for i in (50, 51)]
    found = [r for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"] == 51]
    assert any(r["other_id"] == 50 and r["end_word"] - r["start_word"] >= 80 for r in found)
    assert {(r["passage_start"], r["passage_end"]) for r in found} == {(40, 120)}


def covered_by_any(texts, least):
    """Places of words in runs of ``least`` words or more that any other document has, by all pairs."""
    grams = {}
    split = {i: t.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)).split() for i, t in texts.items()}
    for i, w in split.items():
        for k in range(len(w) - least + 1):
            grams.setdefault(tuple(w[k : k + least]), set()).add(i)
    out = {}
    for i, w in split.items():
        out[i] = {k + j for k in range(len(w) - least + 1) if len(grams[tuple(w[k : k + least])]) > 1 for j in range(least)}
    return out


def test_recall_of_verbatim_passages_against_all_pairs(spark):
    """Of the words in runs of MIN_WORDS or more that two documents share, those in passages, on either side."""
    texts = {r["doc_id"]: r["text"] or "" for r in documents(spark, SF).collect()}
    found = {i: set() for i in texts}
    for r in passages.passages(documents(spark, SF)).collect():
        found[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
        found[r["other_id"]] |= set(range(r["other_start"], r["other_end"]))
    wanted = covered_by_any(texts, passages.MIN_WORDS)
    hit, total = sum(len(wanted[i] & found[i]) for i in texts), sum(map(len, wanted.values()))
    assert total > 500 and hit / total >= 0.99, (hit, total)


@pytest.mark.parametrize("seen", [False, True])
def test_fuzzy_passages(spark, seen):
    """Passages of 80 words with words replaced, between strange words; also where their pieces occurred before."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(20_000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs, planted, copies = [], {}, set()
    for rate in (0.05, 0.10, 0.15, 0.18):
        for _ in range(30):
            passage = some(80)
            for at in range(0, 66, 8) if seen else ():
                docs.append(some(20) + passage[at : at + 15] + some(20))
            docs.append(some(60) + passage + some(60))
            copy = [rng.choice(vocabulary) if rng.random() < rate else w for w in passage]
            if sum(a == b for a, b in zip(copy, passage, strict=True)) >= 64:
                planted[len(docs)] = rate
            copies.add(len(docs))
            docs.append(some(60) + copy + some(60))
    found = {}
    for r in passages.passages(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")).collect():
        found.setdefault(r["doc_id"], set()).update(range(r["passage_start"], r["passage_end"]))
    assert set(found) <= copies  # strangers share nothing
    words = {}
    for d, rate in planted.items():
        got = found.get(d, set())
        assert all(56 <= w < 144 for w in got)
        words.setdefault(rate, []).append(len(got & set(range(60, 140))) / 80)
    shares = [x for xs in words.values() for x in xs]
    assert sum(shares) >= 0.9 * len(shares)
    assert all(sum(xs) >= (0.9 if rate < 0.18 else 0.85) * len(xs) for rate, xs in words.items()), {r: sum(x) / len(x) for r, x in words.items()}


def test_a_link_has_its_whole_extent(spark):
    """Two documents share 400 words whose halves occurred before apart from each other."""
    rng = random.Random(12)
    some = lambda n: [f"v{rng.randrange(30_000)}" for _ in range(n)]
    shared = some(400)
    docs = [(1, some(30) + shared[:200] + some(30)), (2, some(30) + shared[200:] + some(30)), (10, some(40) + shared + some(40)), (11, some(50) + shared + some(50))]
    rows = passages.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")).where("doc_id = 11 AND other_id = 10").collect()
    assert [(r["start_word"], r["end_word"], r["other_start"], r["other_end"]) for r in rows] == [(50, 450, 40, 440)]


def test_onward_by_a_plain_loop():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n, price = int(rng.integers(0, 200)), int(rng.choice([2, 4]))
        a = rng.integers(0, 9, n)
        b = np.where(rng.random(n) < rng.choice([0.05, 0.3, 0.9]), 99, a)
        total, best, end, unequal, bad = 0, 0, 0, 0, 0
        for i in range(n):
            total += 1 if a[i] == b[i] else -price
            unequal += a[i] != b[i]
            if total > best:
                best, end, bad = total, i + 1, unequal
            if best - total >= passages.DROP:
                break
        assert passages.onward(a, b, price) == (end, bad)
