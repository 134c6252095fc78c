"""Cheapest edits of a conversation's roles, as min-plus steps over four states.

A row is a symbol: the initial of its role (s, u, a or another) and what holds for it (kept freely, must
go, or kept at a price). A state is what the kept roles so far end in: nothing, s, u or a. A symbol's
transition is a 4 x 4 matrix of costs, insertions before the row included; the transition of a run of
equal symbols is a power of it, put together from cached squares. Costs to go are computed from the end.
The edits are then chosen from the start: at each place the ASCII-least of those that are cheapest, which
gives the ASCII-least of all cheapest sequences, as edits of different letters never agree further on.
"""

from __future__ import annotations

from functools import cache, lru_cache

START, S, U, A = range(4)
FREE, MUST_GO, PRICED = range(3)
FAR = 1 << 60
REROLE, DELETE, INSERT, PRICE = 1, 2, 5, 5
#: What a missing row would add in each state, and the state then.
WANTED = ("user", "user", "assistant", "user")
NEXT = (U, U, A, U)
#: Costs to go after the last row: only nothing and ``a`` may end a conversation.
END = (0, 2 * INSERT, INSERT, 0)
UNIT = tuple(tuple(0 if s == t else FAR for t in range(4)) for s in range(4))
Vector, Matrix = tuple[int, ...], tuple[tuple[int, ...], ...]


def symbol(initial: str, fault: int) -> int:
    return 3 * ("sua".find(initial) if initial in ("s", "u", "a") else 3) + fault


@cache
def choices(sym: int, state: int) -> tuple[tuple[str, int, int], ...]:
    """``(letter, cost, state after)`` for a row, in ASCII order, insertions aside."""
    initial, fault = divmod(sym, 3)
    found = [("D", DELETE, state)]
    if fault != MUST_GO:
        price = PRICE if fault == PRICED else 0
        if initial == 0 and state == START:
            found.append(("K", price, S))
        elif initial in (1, 2) and NEXT[state] == initial + 1:
            found.append(("K", price, NEXT[state]))
        found.append(("R", REROLE + price, NEXT[state]))
    return tuple(found)


def times(left: Matrix, right: Matrix) -> Matrix:
    return tuple(tuple(min(left[s][k] + right[k][t] for k in range(4)) for t in range(4)) for s in range(4))


@cache
def step(sym: int) -> Matrix:
    """Insertions, then the row."""
    row = [[FAR] * 4 for _ in range(4)]
    inserted = [[FAR] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, after in choices(sym, state):
            row[state][after] = min(row[state][after], cost)
        at = state
        for k in range(4):
            inserted[state][at] = min(inserted[state][at], INSERT * k)
            at = NEXT[at]
    return times(tuple(map(tuple, inserted)), tuple(map(tuple, row)))


@cache
def square(sym: int, bit: int) -> Matrix:
    """The transition of ``2 ** bit`` equal rows."""
    return step(sym) if bit == 0 else times(square(sym, bit - 1), square(sym, bit - 1))


def power(sym: int, n: int) -> Matrix:
    found = UNIT
    for bit in range(n.bit_length()):
        if n >> bit & 1:
            found = times(found, square(sym, bit))
    return found


def apply(matrix: Matrix, to_go: Vector) -> Vector:
    return tuple(min(c + w for c, w in zip(row, to_go, strict=True)) for row in matrix)


@lru_cache(1 << 16)
def _advanced(sym: int, n: int, to_go: Vector) -> Vector:
    for bit in range(n.bit_length()):
        if n >> bit & 1:
            to_go = apply(square(sym, bit), to_go)
    return to_go


def advanced(sym: int, n: int, to_go: Vector) -> Vector:
    """Costs to go before ``n`` equal rows, from those after them; cached by their differences."""
    least = min(to_go)
    return tuple(x + least for x in _advanced(sym, n, tuple(x - least for x in to_go)))


def collapse(symbols: list[int]) -> list[tuple[int, int]]:
    """Runs ``(symbol, length)``."""
    runs: list[tuple[int, int]] = []
    for sym in symbols:
        runs.append((sym, runs.pop()[1] + 1) if runs and runs[-1][0] == sym else (sym, 1))
    return runs


def product(runs: list[tuple[int, int]]) -> Matrix:
    found = UNIT
    for sym, n in runs:
        found = times(found, power(sym, n))
    return found


def unrolled(runs: list[tuple[int, int]], after: Vector, state: int) -> tuple[str, int]:
    """The edits for rows whose costs to go after them are ``after``, entered in ``state``; the state then."""
    ends = [after]
    for sym, n in reversed(runs):
        ends.append(advanced(sym, n, ends[-1]))
    letters: list[str] = []
    for (sym, n), end in zip(runs, reversed(ends[:-1]), strict=True):
        inside = [end]
        for _ in range(n):
            inside.append(advanced(sym, 1, inside[-1]))
        for here, then in zip(inside[:0:-1], inside[-2::-1], strict=True):
            while True:
                best = {letter: (cost + then[at], at) for letter, cost, at in choices(sym, state)}
                best["I"] = (INSERT + here[NEXT[state]], NEXT[state])
                letter = min(x for x, (cost, _) in best.items() if cost == here[state])
                letters.append(letter)
                state = best[letter][1]
                if letter != "I":
                    break
    return "".join(letters), state


def closing(state: int) -> str:
    """The insertions that end a conversation."""
    return "I" * (END[state] // INSERT)
