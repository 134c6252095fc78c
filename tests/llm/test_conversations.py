"""Conversation repair against all edit sequences, and against a plain recursion for long ones."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from weftline.llm import conversations, minplus

SF = "/root/testdata/sf0.001"
LEGAL = re.compile("(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_edit(rows):
    """The cheapest edit sequence, of all that cost no more than deleting everything."""
    kinds, most = faults(rows), 2 * len(rows)
    found = []

    def go(i, cost, audit, kept):
        if cost > most or not re.match("s?[ua]*$", "".join(r[:1] for r, _ in kept)):
            return
        for role in ("user", "assistant"):
            go(i, cost + 5, audit + "I", (*kept, (role, "")))
        if i == len(rows):
            if LEGAL.fullmatch("".join(r[:1] for r, _ in kept)):
                found.append((cost, audit, kept))
            return
        role, text = rows[i]
        go(i + 1, cost + 2, audit + "D", kept)
        if kinds[i] not in ("blank", "duplicate"):
            more = 5 * (kinds[i] == "truncated")
            go(i + 1, cost + more, audit + "K", (*kept, (role, text)))
            for new in ("user", "assistant"):
                go(i + 1, cost + more + 1, audit + "R", (*kept, (new, text)))

    go(0, 0, "", ())
    return min(found)


def recursion(rows):
    """The same by costs to go, a row at a time."""
    kinds = faults(rows)
    then = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i, state, inserts=0):
        options = [(0, "", None)] if i == len(rows) and state in ("", "a") else []
        if inserts < 3:
            options.append((5 + best(i, then[state], inserts + 1)[0], "I", then[state]))
        if i < len(rows):
            initial = rows[i][0][:1]
            options.append((2 + best(i + 1, state)[0], "D", state))
            if kinds[i] not in ("blank", "duplicate"):
                more = 5 * (kinds[i] == "truncated")
                if initial == then[state] or (initial == "s" and state == ""):
                    options.append((more + best(i + 1, initial)[0], "K", initial))
                options.append((more + 1 + best(i + 1, then[state])[0], "R", then[state]))
        return min(options) if options else (10**9, "", None)

    for i in range(len(rows), -1, -50):
        for s in then:
            best(i, s)
    i, state, audit, kept, inserts = 0, "", "", [], 0
    cost = best(0, "")[0]
    while (move := best(i, state, inserts))[1]:
        letter, after = move[1], move[2]
        if letter in "RI":
            kept.append((full[after], rows[i][1] if letter == "R" else ""))
        elif letter == "K":
            kept.append(rows[i])
        i, state, audit, inserts = i + (letter != "I"), after, audit + letter, inserts + 1 if letter == "I" else 0
    return cost, audit, tuple(kept)


def expected(rows, solve=recursion):
    """rows: (turn, role, text, digest order), sorted."""
    kinds = faults([(r, t) for _, r, t in rows])
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, kept = solve([(r, t) for _, r, t in rows]) if rows else (0, "", ())
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    text = "\n".join(f"{r}:{t}" for r, t in kept)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def in_order(rows):
    same = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()[:16]
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, same(x[1], x[2])))


def check(frame, by_id, solve=recursion):
    got = {r["conv_id"]: tuple(r)[1:] for r in frame.collect()}
    assert got == {c: expected(in_order(rows), solve) for c, rows in by_id.items()}


def chat(rng, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", " "]
    texts = ["", " \t", "Fine.", "No end", "Why?", "Go! ", "x", "é.\x0b"]
    return [(rng.choice([None, rng.randint(0, n)]), rng.choice(roles[: rng.choice([2, 5, 7])]), rng.choice(texts) if rng.random() < 0.7 else f"t{rng.random()}.") for _ in range(n)]


def frame(spark, by_id, rng=random.Random(0)):
    rows = [(c, *r) for c, rs in by_id.items() for r in rs]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


def test_all_edit_sequences(spark):
    rng = random.Random(5)
    by_id = {i: chat(rng, rng.randint(1, 4)) for i in range(120)} | {None: chat(rng, 3)}
    check(conversations.repaired(frame(spark, by_id)), by_id, every_edit)


@pytest.mark.parametrize("piece_rows", [4096, 3])
def test_long_and_hot_conversations(spark, piece_rows):
    rng = random.Random(piece_rows)
    by_id = {i: chat(rng, rng.randint(1, 30)) for i in range(30)}
    by_id[7] = chat(rng, 900)
    by_id[8] = [(i, "user" if i % 97 else "assistant", f"row {i}.") for i in range(700)]
    by_id[9] = [(4, "user", "the same row.")] * 800 + [(5, "assistant", "yes.")]
    found = conversations.repaired(frame(spark, by_id), piece_rows=piece_rows, piece_chars=4_000_000 if piece_rows > 3 else 40)
    check(found, by_id)


def test_powers_are_repeated_steps():
    rng = random.Random(2)
    for _ in range(200):
        sym, n = rng.randrange(12), rng.randint(0, 40)
        slow = minplus.UNIT
        for _ in range(n):
            slow = minplus.times(slow, minplus.step(sym))
        assert minplus.power(sym, n) == slow
        assert minplus.advanced(sym, n, minplus.END) == minplus.apply(slow, minplus.END)
    assert minplus.collapse([1, 1, 2, 1]) == [(1, 2), (2, 1), (1, 1)] and minplus.collapse([]) == []


def damage(conv_id, turn, role, text):
    fill = lambda x: " " if x is None else x
    role, text = fill(role), fill(text)
    what = zlib.crc32(f"{fill(conv_id)}:{fill(turn)}".encode()) % 20
    text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
    return [] if what == 0 else [(turn, "user" if what == 4 else role, text)] * (1 + (what == 3))


def test_dirty_rows_and_clashing_names(spark):
    rows = [(1, None, "user", None), (1, None, None, "Yes."), (None, 1, "user", "Hm."), (None, 1, "user", "Hm."), (2, 0, "user", ""), (2, 1, "assistant", "w " * 50_000), (3, 5, "", "No role."), (3, 9, "sUser", "Yes!")] + [(20, t, None, None) for t in range(50)]
    clash = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], "conv_id long, turn long, role string, text string, present string, done string, part string, what string")
    by_id = {r[0]: [] for r in rows}
    for r in rows:
        by_id[r[0]] += damage(*r)
    check(conversations.repaired(conversations.damaged(clash), conversations.F.col("present")), by_id)
    assert conversations.repaired(conversations.damaged(clash.limit(0)), conversations.F.col("present")).count() == 0


def test_query(spark):
    by_id = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        by_id.setdefault(r["conv_id"], []).extend(damage(r["conv_id"], r["turn"], r["role"], r["text"]))
    check(conversations.op12(spark, SF), by_id)
