"""Cheapest edits of a row sequence, as min-plus matrices over a Re-Pair grammar.

A row is one of nine symbols: whether it must go, may stay or stays at a price (truncated),
and which role it has. Edits of a row: Keep (0), Rerole to user or assistant (1), Delete
(2); a truncated row that is not deleted adds 5; Insert of a user or assistant row (5) may
come anywhere. The roles left over must spell ``(s?(ua)+)?``, an automaton of four states.

A sequence's *transfer* holds for each pair of states the least cost of getting from one to
the other over the whole sequence, and which audit (string of edit initials) of that cost
is least. Audits are not stored: an entry keeps the state in the middle, which points at
an entry of each half (a rope), and its rank among the audits that leave the same state.
That is enough to compare ropes: an audit and its first state tell the last state, and no
audit is the beginning of another over the same rows (inserts are counted to the row that
follows them, so every audit ends in a row's own edit). Hence of two ropes the one with the
lesser left half is less, whatever follows, and ranks of halves give ranks of wholes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STATES = 4  # nothing yet, after s, after u, after ua
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FAR = 1 << 40  # cost of what cannot be reached
ROLES = "sua?"  # any other role cannot stay as it is
DEAD = 8  # the symbol of a row that must go; 0-3 sound rows by role, 4-7 truncated ones
TERMINALS = 9

#: next state by (state, role): s, u, a.
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTING = (0, 3)


def _inserts(state: int) -> list[tuple[int, str]]:
    """(state, inserts) reachable by inserted rows alone; a state met again is never cheaper."""
    out, seen, text = [(state, "")], {state}, ""
    while True:
        state = _STEP.get((state, "u"), _STEP.get((state, "a")))
        text += "I"
        if state in seen:
            return out
        seen.add(state)
        out.append((state, text))


def _terminal(symbol: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(from, to) -> (cost, audit) of one row and the inserts before it."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in range(STATES):
        for state, text in _inserts(start):
            ways = [(state, DELETE, "D")]
            if symbol != DEAD:
                extra, role = TRUNCATED * (symbol >= 4), ROLES[symbol % 4]
                if (state, role) in _STEP:
                    ways.append((_STEP[state, role], KEEP + extra, "K"))
                ways += [(_STEP[state, r], REROLE + extra, "R") for r in "ua" if (state, r) in _STEP]
            for end, cost, edit in ways:
                found = (INSERT * len(text) + cost, text + edit)
                best[start, end] = min(best.get((start, end), (FAR, "~")), found)
    return best


TERMINAL_WAYS = [_terminal(s) for s in range(TERMINALS)]


def _ranked(keys: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Rank of each entry among those of its row; entries out of reach come last."""
    keys = np.where(far, np.iinfo(np.int64).max, keys)
    return np.argsort(np.argsort(keys, axis=-1, kind="stable"), axis=-1, kind="stable")


def terminal_transfers() -> tuple[np.ndarray, np.ndarray]:
    cost = np.full((TERMINALS, STATES, STATES), FAR, np.int64)
    rank = np.zeros((TERMINALS, STATES, STATES), np.int64)
    for s, ways in enumerate(TERMINAL_WAYS):
        for (i, j), (c, _) in ways.items():
            cost[s, i, j] = c
        for i in range(STATES):
            texts = sorted(ways[i, j][1] for j in range(STATES) if (i, j) in ways)
            for j in range(STATES):
                rank[s, i, j] = texts.index(ways[i, j][1]) if (i, j) in ways else STATES
    return cost, rank


def joined(cost_a, rank_a, cost_b, rank_b):
    """(cost, rank, middle) of two halves in turn, for many pairs of transfers at once."""
    total = np.minimum(cost_a[..., :, :, None] + cost_b[..., None, :, :], FAR)
    middle = np.argmin(total * 8 + np.minimum(rank_a, 7)[..., :, :, None], axis=-2)
    cost = np.take_along_axis(total, middle[..., :, None, :], -2)[..., 0, :]
    left = np.take_along_axis(rank_a, middle, -1)
    right = np.empty_like(middle)
    for j in range(STATES):
        right[..., j] = np.take_along_axis(rank_b[..., j], middle[..., j], -1)
    return cost, _ranked(left * 8 + right, cost >= FAR), middle


def ending(cost: np.ndarray, rank: np.ndarray) -> tuple[int, int, str]:
    """(cost, last state before closing inserts, closing inserts) of a whole sequence from state 0."""
    best = []
    for state in range(STATES):
        for end, text in _inserts(state):
            if end in ACCEPTING and cost[0, state] < FAR:
                best.append((int(cost[0, state]) + INSERT * len(text), int(rank[0, state]), state, text))
    total, _, state, text = min(best)
    return total, state, text


@dataclass
class Grammar:
    """Rules in the order they were made: rule r replaces ``pairs[r]`` and is symbol TERMINALS + r."""
    pairs: list[tuple[int, int]]

    def __post_init__(self):
        cost, rank = terminal_transfers()
        self.middle = np.zeros((TERMINALS + len(self.pairs), STATES, STATES), np.int64)
        self.cost = np.concatenate([cost, np.zeros((len(self.pairs), STATES, STATES), np.int64)])
        self.rank = np.concatenate([rank, np.zeros((len(self.pairs), STATES, STATES), np.int64)])
        for r, (a, b) in enumerate(self.pairs):  # bottom-up: a rule names earlier symbols only
            s = TERMINALS + r
            self.cost[s], self.rank[s], self.middle[s] = joined(self.cost[a], self.rank[a], self.cost[b], self.rank[b])
        self._audits: dict[tuple[int, int, int], str] = {}

    def audit(self, symbol: int, i: int, j: int) -> str:
        """The rope of one entry, written out; halves are shared."""
        key = (symbol, i, j)
        if key not in self._audits:
            if symbol < TERMINALS:
                self._audits[key] = TERMINAL_WAYS[symbol][i, j][1]
            else:
                a, b = self.pairs[symbol - TERMINALS]
                k = int(self.middle[symbol, i, j])
                self._audits[key] = self.audit(a, i, k) + self.audit(b, k, j)
        return self._audits[key]

    def parsed(self, strings: list[bytes], first: int = 0) -> list[np.ndarray]:
        """Each string as symbols after all rules, applied to all strings at once."""
        flat, sizes = [], []
        for s in strings:
            flat.append(np.frombuffer(s, np.uint8).astype(np.int32))
            flat.append(np.array([-1], np.int32))
        line = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        for r, (a, b) in enumerate(self.pairs):
            at = np.flatnonzero((line[:-1] == a) & (line[1:] == b))
            if a == b and len(at):  # of a run aaa only every second place
                run = np.concatenate([[0], np.cumsum(np.diff(at) != 1)])
                head = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])
                at = at[(np.arange(len(at)) - head[run]) % 2 == 0]
            line[at] = TERMINALS + r
            line = np.delete(line, at + 1)
        sizes = np.flatnonzero(line == -1)
        return [line[lo:hi] for lo, hi in zip([0, *(sizes[:-1] + 1).tolist()], sizes.tolist(), strict=True)]

    def transfer(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(cost, rank, middles) of symbols in turn; middles lead back from the end."""
        cost, rank, middles = self.cost[symbols[0]], self.rank[symbols[0]], []
        for s in symbols[1:].tolist():
            cost, rank, middle = joined(cost, rank, self.cost[s], self.rank[s])
            middles.append(middle)
        return cost, rank, middles

    def written(self, symbols: np.ndarray, middles: list[np.ndarray], i: int, j: int) -> str:
        """The audit from state i to j over parsed symbols."""
        parts = []
        for s, middle in zip(symbols[:0:-1].tolist(), reversed(middles), strict=True):
            k = int(middle[i, j])
            parts.append(self.audit(s, k, j))
            j = k
        parts.append(self.audit(int(symbols[0]), i, j))
        return "".join(reversed(parts))


def pair_counts(lines: list[np.ndarray], weights: list[int]) -> dict[tuple[int, int], int]:
    """How often each two symbols follow each other; of a run aaa every second place counts."""
    out: dict[tuple[int, int], int] = {}
    for line, w in zip(lines, weights, strict=True):
        skip = False
        for a, b in zip(line.tolist(), line[1:].tolist(), strict=False):
            if skip and a == b == last:
                skip = False
                continue
            out[a, b] = out.get((a, b), 0) + w
            skip, last = a == b, b
    return out


def repaired(audit: str, rows: list[tuple[str, str]], state: int) -> tuple[list[tuple[str, str, str, int]], int]:
    """(rows (edit, role, text, place of the source row or -1), state) after an audit's edits."""
    names = {"u": "user", "a": "assistant"}
    out, at = [], 0
    for edit in audit:
        role, text = rows[at] if edit != "I" else ("", "")
        wanted = "a" if state == 2 else "u"
        if edit == "D":
            at += 1
            continue
        if edit == "K":
            state = _STEP[state, role[0]]
            out.append((edit, role, text, at))
        else:
            state = _STEP[state, wanted]
            out.append((edit, names[wanted], text, at if edit == "R" else -1))
        at += edit != "I"
    return out, state
