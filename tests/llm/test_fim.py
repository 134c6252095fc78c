"""Fill-in-middle against plain slices, and its chunks against a byte-by-byte hash."""

import hashlib
import random
import re

import numpy as np
import pytest

from tests.helpers import same, views
from weftline.llm import fim

SF = "/root/testdata/sf0.001"
DIRTY = "doc_id long, text string, n string, form string, cut string, output string"
ROWS = [(1, "one\ntwo\nthree"), (1, "one\ntwo\nthree"), (2, None), (3, ""), (4, "\n\n\n"), (None, "a\nb\n"), (5, "has <S> in it\nyes"), (6, "ends in <\nor <P\n<M"), (7, "é中\n😀\r\nx\x0by\n" * 40_000), (8, "no line end " * 60_000), (9, "x\n")]


def brute(doc_id, text, plain_from=100, spm_below=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, h = len(units), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= plain_from:
        return n, "plain", None, None, text
    if h4 % 100 < spm_below:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(rows, docs, **options):
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    got = sorted([(r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in rows], key=key)
    assert got == sorted([(d, t, *brute(d, t, **options)) for d, t in docs], key=key)


def test_dirty_rows_and_clashing_names(spark):
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in ROWS], DIRTY)
    found = fim.transformed(docs)
    assert sorted(found.columns) == sorted(["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"])
    check(found.collect(), ROWS)
    assert fim.transformed(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    rng = random.Random(seed)
    shared = ["".join(rng.choice("ab é\n中") for _ in range(3000)) for _ in range(4)]
    docs = [(i, "".join(rng.choice([rng.choice(shared), "\n", "x" * rng.randint(0, 99), "\n\nz", "<"]) for _ in range(rng.randint(0, 6)))) for i in range(150)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = fim.transformed(frame, plain_from=70, spm_below=30).withColumn("back", fim.restored(fim.F.col("output"), fim.F.col("form"))).collect()
    check(rows, docs, plain_from=70, spm_below=30)
    assert all(r["back"] == r["text"] for r in rows) and len({r["form"] for r in rows}) == 3


def test_chunks_are_defined_by_content(monkeypatch):
    monkeypatch.setattr(fim, "BLOCK", 5_000)
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 60_000, dtype=np.uint8)
    hashed = fim.rolling(data[:500])
    for i in (0, 5, 31, 32, 499):
        assert hashed[i] == sum(int(fim._GEAR[data[i - k]]) << k for k in range(min(i + 1, 32))) % (1 << 32)
    ends = fim.chunk_ends(data)
    monkeypatch.setattr(fim, "BLOCK", 1 << 20)
    assert ends == fim.chunk_ends(data) and ends[-1] == len(data)
    lengths = np.diff([0, *ends])
    assert lengths.max() <= fim.LONGEST and lengths[:-1].min() >= fim.SHORTEST and 300 < lengths.mean() < 3000
    moved = set(len(data) + 777 - np.array(fim.chunk_ends(np.concatenate([rng.integers(97, 123, 777, dtype=np.uint8), data])))) & set(len(data) - np.array(ends))
    assert len(moved) > 0.9 * len(ends)


def test_the_cache_checks_bytes_and_is_bounded():
    cache = fim.ChunkCache(most=5_000)
    one, two = cache.of(b"a\nb", key=1), cache.of(b"ccc\n", key=1)  # one hash, two chunks
    assert (one.chars, one.line_ends.tolist(), one.ends_line) == (3, [2], False)
    assert (two.chars, two.line_ends.tolist(), two.ends_line) == (4, [4], True)
    assert cache.of(b"a\nb", key=1) == one or cache.misses == 3
    for i in range(200):
        cache.of(b"%d" % i * 30)
    assert cache.held <= 5_000 and cache.held == sum(map(cache.size, cache.found.values()))
    text = np.frombuffer(b"line of a shared passage\n" * 3 + bytes(range(128)) * 900, np.uint8)
    shared = fim.ChunkCache()
    assert fim.cuts(text, 2, 3, shared) == fim.cuts(text, 2, 3, shared) and shared.hits > 0


def test_query(spark):
    same(fim.op11(spark, SF), views(SF), fim.ORACLES["op11_fill_in_middle"])
