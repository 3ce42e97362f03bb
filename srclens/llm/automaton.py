"""A weighted automaton over the rows of a conversation, determinised as far as it is asked for.

The states of the underlying automaton say what the repaired conversation ends
with: nothing, a system turn, a user turn, an assistant turn.  A cost vector has
the least cost from each of them to the end.  Vectors whose least entry is taken
off are the states of the deterministic automaton; they are numbered as they
turn up, and what a row's symbol makes of one is kept in a table.  Rows are
scanned from the last to the first by that table; the scan's vectors say which
edits are tight, and a trace from the first row on takes the ASCII-least one.
"""

from __future__ import annotations

from dataclasses import dataclass

INF = 1 << 60
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted or re-roled turn leads to, and its letter.
NEXT = (USER, USER, ASSISTANT, USER)
LETTER = "  ua"
#: Where a kept row of an initial leads to.
KEPT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}


@dataclass(frozen=True)
class Costs:
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


class Automaton:
    """Symbols: s, u, a or o (any other) for a row's initial, upper case for a truncated row, x for one that must go.

    A token is what is done at a row: ``Iu`` or ``Ia`` for turns put before it,
    then ``K``, ``Ru``, ``Ra`` or ``D``.
    """

    def __init__(self, costs: Costs = Costs()):
        self.costs = costs
        self.numbers: dict[tuple[int, ...], int] = {}
        self.vectors: list[tuple[int, ...]] = []
        self.steps: dict[tuple[int, str], tuple[int, int]] = {}
        self.arcs: dict[tuple[int, str, int], tuple[str, int]] = {}
        # only a conversation that is empty or ends with an assistant turn is whole
        self.end = (0, 2 * costs.insert, costs.insert, 0)

    def number(self, vector) -> tuple[int, int]:
        """The number of a vector's normal form, and what was taken off."""
        least = min(vector)
        key = tuple(v if v >= INF else v - least for v in vector)
        if key not in self.numbers:
            self.numbers[key] = len(self.vectors)
            self.vectors.append(key)
        return self.numbers[key], least

    def before(self, vector, symbol: str) -> list[int]:
        """The cost vector before a row, from the one behind it."""
        c, initial = self.costs, symbol.lower()
        late = c.truncated if symbol != initial else 0
        out = []
        for q in range(4):
            ways = [c.delete + vector[q]]
            if symbol != "x":
                ways.append(c.rerole + late + vector[NEXT[q]])
                if (to := KEPT.get(initial, {}).get(q)) is not None:
                    ways.append(late + vector[to])
            out.append(min(ways))
        for _ in range(2):  # two turns put in lead wherever any number does
            out = [min(v, c.insert + out[NEXT[q]]) for q, v in enumerate(out)]
        return [min(v, INF) for v in out]

    def scan(self, symbols: str, vector) -> tuple[list[int], tuple[int, ...]]:
        """The numbers of the vectors behind each row, and the vector before the first row."""
        now, total = self.number(vector)
        behind = [0] * len(symbols)
        for i in range(len(symbols) - 1, -1, -1):
            behind[i] = now
            key = (now, symbols[i])
            if key not in self.steps:
                self.steps[key] = self.number(self.before(self.vectors[now], symbols[i]))
            now, cost = self.steps[key]
            total += cost
        return behind, tuple(v if v >= INF else v + total for v in self.vectors[now])

    def arc(self, number: int, symbol: str, q: int) -> tuple[str, int]:
        """The ASCII-least tight edits at a row from a state, and the state behind them."""
        vector = self.vectors[number]
        ahead, c, initial = self.before(vector, symbol), self.costs, symbol.lower()
        late, token = c.truncated if symbol != initial else 0, ""
        while True:
            if c.delete + vector[q] == ahead[q]:
                return token + "D", q
            if c.insert + ahead[NEXT[q]] == ahead[q]:
                q = NEXT[q]
                token += "I" + LETTER[q]
                continue
            to = KEPT.get(initial, {}).get(q)
            if symbol != "x" and to is not None and late + vector[to] == ahead[q]:
                return token + "K", to
            return token + "R" + LETTER[NEXT[q]], NEXT[q]

    def trace(self, symbols: str, behind: list[int], q: int) -> tuple[list[str], int]:
        """The tokens of the rows from a state on, and the state behind the last."""
        out = []
        for number, symbol in zip(behind, symbols, strict=True):
            key = (number, symbol, q)
            if key not in self.arcs:
                self.arcs[key] = self.arc(*key)
            token, q = self.arcs[key]
            out.append(token)
        return out, q

    def closing(self, q: int) -> str:
        """What is put behind the last row."""
        return {NOTHING: "", SYSTEM: "IuIa", USER: "Ia", ASSISTANT: ""}[q]

    def matrix(self, symbols: str) -> list[list[int]]:
        """The least cost of these rows from each state to each state behind them."""
        columns = [self.scan(symbols, tuple(0 if p == q else INF for p in range(4)))[1] for q in range(4)]
        return [[columns[q][p] for q in range(4)] for p in range(4)]


def through(matrix, vector) -> list[int]:
    """The vector before some rows, from their matrix and the vector behind them."""
    return [min(min(m + v for m, v in zip(row, vector, strict=True)), INF) for row in matrix]
