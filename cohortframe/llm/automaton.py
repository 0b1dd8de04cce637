"""Rule regexes as one minimal deterministic automaton over bytes, in flat transition arrays.

Patterns know literals, escapes (``\\x20``, ``\\.``), classes, groups, ``|``, ``?``, ``*``, ``+`` and ``{m}``, ``{m,}``,
``{m,n}``.  They are read into one position automaton (positions and what may follow them), made deterministic by subset
construction over classes of equal bytes, and minimised by refining the partition of its states.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SEPARATOR = 255         # a byte UTF-8 never has; it leads back to the start


@dataclass
class _Part:
    """A piece of a pattern: positions that can begin it, positions that can end it, and whether it can be empty."""
    first: frozenset[int]
    last: frozenset[int]
    empty: bool


class _Reader:
    """Positions of a pattern, the bytes each stands for, and which positions may follow which."""

    def __init__(self):
        self.bytes: list[frozenset[int]] = []
        self.follow: list[set[int]] = []

    def read(self, pattern: str) -> _Part:
        self.text, self.at = pattern, 0
        part = self._either()
        if self.at != len(pattern):
            raise ValueError(f"cannot read {pattern!r} at {self.at}")
        return part

    def _peek(self) -> str:
        return self.text[self.at:self.at + 1]

    def _take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def _then(self, a: _Part, b: _Part) -> _Part:
        for p in a.last:
            self.follow[p] |= b.first
        return _Part(a.first | b.first if a.empty else a.first, a.last | b.last if b.empty else b.last, a.empty and b.empty)

    def _either(self) -> _Part:
        part = self._sequence()
        while self._peek() == "|":
            self._take()
            other = self._sequence()
            part = _Part(part.first | other.first, part.last | other.last, part.empty or other.empty)
        return part

    def _sequence(self) -> _Part:
        part = _Part(frozenset(), frozenset(), True)
        while self._peek() not in ("", "|", ")"):
            part = self._then(part, self._repeated())
        return part

    def _repeated(self) -> _Part:
        start = self.at
        part = self._atom()
        least, most = 1, 1
        if (sign := self._peek()) and sign in "?*+":
            self._take()
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[sign]
        elif sign == "{":
            stop = self.text.index("}", self.at)
            low, comma, high = self.text[self.at + 1:stop].partition(",")
            least, most = int(low), (int(high) if high else None) if comma else int(low)
            self.at = stop + 1
        after = self.at

        def again() -> _Part:           # another copy of the atom, with positions of its own
            self.at = start
            copy = self._atom()
            self.at = after
            return copy

        out = _Part(frozenset(), frozenset(), True)
        for k in range(max(least, 1 if most is None else most)):
            copy = part if k == 0 else again()
            if most is None and k == max(least, 1) - 1:
                for p in copy.last:
                    self.follow[p] |= copy.first
            out = self._then(out, _Part(copy.first, copy.last, copy.empty or k >= least))
        return out

    def _atom(self) -> _Part:
        c = self._take()
        if c == "(":
            if self.text.startswith("?:", self.at):
                self.at += 2
            part = self._either()
            if self._take() != ")":
                raise ValueError("missing )")
            return part
        chars = self._class() if c == "[" else frozenset([self._byte(c)])
        self.bytes.append(chars)
        self.follow.append(set())
        only = frozenset([len(self.bytes) - 1])
        return _Part(only, only, False)

    def _byte(self, c: str) -> int:
        if c != "\\":
            return ord(c)
        c = self._take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2:self.at], 16)
        return ord(c)

    def _class(self) -> frozenset[int]:
        out: set[int] = set()
        while (c := self._take()) != "]":
            low = self._byte(c)
            if self._peek() == "-" and self.text[self.at + 1] != "]":
                self._take()
                out |= set(range(low, self._byte(self._take()) + 1))
            else:
                out.add(low)
        return frozenset(out)


class Automaton:
    """``step[state * classes + of_byte[b]]`` is the next state times ``classes``; ``accept[state]`` has a bit per rule.

    With ``search`` a rule may begin at any byte; without, at the first byte only, and state ``dead`` is where no rule can
    match any more.
    """

    def __init__(self, patterns: list[str], search: bool):
        reader = _Reader()
        rules = [reader.read(p) for p in patterns]
        if any(r.empty for r in rules):
            raise ValueError("a rule matches the empty text")
        begin = frozenset().union(*(r.first for r in rules))
        ends = {p: 1 << k for k, r in enumerate(rules) for p in r.last}
        has = np.zeros((256, len(reader.bytes)), bool)
        for p, chars in enumerate(reader.bytes):
            has[list(chars), p] = True
        has[SEPARATOR] = False
        alike, self.of_byte = np.unique(has, axis=0, return_inverse=True)
        self.of_byte = self.of_byte.reshape(-1).astype(np.int32)
        allowed = [frozenset(np.flatnonzero(row).tolist()) for row in alike]
        # subset construction: a state is the set of positions that may be next
        number, todo, table, marks = {begin: 0}, [(begin, 0)], [], [0]
        for state, _ in todo:
            row = []
            for chars in allowed:
                hit = state & chars
                after = frozenset().union(*(reader.follow[p] for p in hit)) | (begin if search else frozenset())
                mark = 0
                for p in hit:
                    mark |= ends.get(p, 0)
                key = after if not mark else (after, mark)          # states differ by what they accept, too
                if key not in number:
                    number[key] = len(number)
                    todo.append((after, mark))
                    marks.append(mark)
                row.append(number[key])
            table.append(row)
        step, mark = np.array(table), np.array(marks)
        # minimisation: split states by what they accept, then by where they lead, until nothing splits
        block = np.unique(mark, return_inverse=True)[1].reshape(-1)
        while True:
            finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].reshape(-1)
            if finer.max() == block.max():
                break
            block = finer
        shift = (block - block[0]) % (block.max() + 1)                # the start is state 0
        chosen = np.zeros(block.max() + 1, np.int64)
        chosen[shift] = np.arange(len(shift))
        self.classes, self.states = len(alike), len(chosen)
        self.step = (shift[step[chosen]] * self.classes).astype(np.int32).reshape(-1)
        self.accept = mark[chosen].astype(np.uint32)
        stuck = [s for s in range(self.states) if not self.accept[s] and (self.step[s * self.classes:(s + 1) * self.classes] == s * self.classes).all()]
        self.dead = stuck[0] if stuck and not search else -1

    def run(self, data: np.ndarray, lanes: int = 4096) -> np.ndarray:
        """Accept bits after each byte, in one pass over ``data``.

        The bytes are cut into lanes that step together, each from the start state.  A lane whose left neighbour ends
        elsewhere is stepped again from there, only until it meets its first run; the result is that of one long run.
        """
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32)
        lanes = max(1, min(lanes, n // 64))
        length = -(-n // lanes)
        padded = np.full(lanes * length, SEPARATOR, np.uint8)
        padded[:n] = data
        chars = np.ascontiguousarray(self.of_byte[padded].reshape(lanes, length).T)
        seen = np.empty((length, lanes), np.int32)
        state = np.zeros(lanes, np.int32)
        for i in range(length):
            state = self.step[state + chars[i]]
            seen[i] = state
        began = np.zeros(lanes, np.int32)
        while True:
            want = np.concatenate([[0], seen[-1, :-1]]).astype(np.int32)
            wrong = np.flatnonzero(want != began)
            if not len(wrong):
                break
            began[wrong], state, lane = want[wrong], want[wrong], wrong
            for i in range(length):
                state = self.step[state + chars[i, lane]]
                differs = state != seen[i, lane]
                lane, state = lane[differs], state[differs]
                if not len(lane):
                    break
                seen[i, lane] = state
        return self.accept[(seen // self.classes).T.reshape(-1)[:n]]
