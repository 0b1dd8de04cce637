"""Secret scan (operator 6): all rules in one pass of a combined deterministic automaton.

The pass tells for every byte which rules have a match ending there.  Only rows and rules with such an end are looked at
again: the rule's own minimal automaton, run from the first byte a match can begin with, gives its leftmost, longest,
non-overlapping matches, and those that fail the rule's check are dropped without a retry.  Spans count code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cohortframe.llm.automaton import SEPARATOR, Automaton
from cohortframe.llm.common import texts_by_id, with_long_id


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    keep: Callable[[bytes], bool] = lambda match: True
    run: int = 1        # a match worth keeping has at least so many bytes in a row at which the rule can end


def _either_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


_ASSIGN = ("(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_VALUE = re.compile(rb"[^:=]*[:=]\x20*[\"']?(.*)", re.S)
BASE = [
    Rule("assign", _ASSIGN, lambda m: len(_VALUE.fullmatch(m)[1]) >= 6),
    Rule("access", "AKIA[A-Z0-9]+", lambda m: len(m) >= 20),
    Rule("hex", "[0-9a-f]+", lambda m: len(m) >= 24, 24),
]
# key formats that their issuers document
MORE = [
    Rule("private_key", "-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("github", "gh[opsur]_[A-Za-z0-9]+", lambda m: len(m) >= 40),
    Rule("slack", "xox[abeoprs]-[A-Za-z0-9-]+", lambda m: len(m) >= 20),
    Rule("google", "AIza[A-Za-z0-9_-]+", lambda m: len(m) >= 39),
    Rule("stripe", "[rs]k_(live|test)_[A-Za-z0-9]+", lambda m: len(m) >= 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", lambda m: len(m) >= 40),
]
RULES = BASE + MORE
BLOCK = 1 << 20         # bytes stepped at once; a longer text is one block


class Scanner:
    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.all = Automaton([r.pattern for r in rules], search=True)
        self.each = [Automaton([r.pattern], search=False) for r in rules]
        self.begins = [a.step[a.of_byte] != a.dead * a.classes for a in self.each]

    def _matches(self, k: int, text: bytes) -> Iterator[tuple[int, int]]:
        one, rule = self.each[k], self.rules[k]
        step, of_byte, accept, dead, classes = one.step, one.of_byte, one.accept, one.dead * one.classes, one.classes
        done = 0
        for start in np.flatnonzero(self.begins[k][np.frombuffer(text, np.uint8)]).tolist():
            if start < done:
                continue
            state, stop = 0, -1
            for at in range(start, len(text)):
                state = step[state + of_byte[text[at]]]
                if state == dead:
                    break
                if accept[state // classes]:
                    stop = at + 1
            if stop > 0:
                done = stop
                if rule.keep(text[start:stop]):
                    yield start, stop

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """Per text the spans (start, rule, end) in code points, sorted."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        marks = self.all.run(np.frombuffer(bytes([SEPARATOR]).join([*texts, b""]), np.uint8))
        stops = np.cumsum([len(t) + 1 for t in texts])
        again: set[tuple[int, int]] = set()         # (text, rule)
        rare = sum(1 << k for k, r in enumerate(self.rules) if r.run == 1)
        at = np.flatnonzero(marks & np.uint32(rare))
        for d, bits in zip(np.searchsorted(stops, at, "right").tolist(), marks[at].tolist()):
            again |= {(d, k) for k, r in enumerate(self.rules) if r.run == 1 and bits >> k & 1}
        for k, rule in enumerate(self.rules):
            if rule.run > 1:
                on = np.zeros(len(marks) + 2, np.int8)
                on[1:-1] = marks >> np.uint32(k) & np.uint32(1)
                edge = np.flatnonzero(np.diff(on))
                long = edge[::2][edge[1::2] - edge[::2] >= rule.run]
                again |= {(d, k) for d in np.searchsorted(stops, long, "right").tolist()}
        for d in {d for d, _ in again}:
            point = np.cumsum((np.frombuffer(texts[d], np.uint8) & 0xC0) != 0x80)
            for k in range(len(self.rules)):
                if (d, k) in again:
                    for start, stop in self._matches(k, texts[d]):
                        out[d].append((int(point[start]) - 1, k, int(point[stop - 1])))
            out[d].sort()
        return out


def blocks(texts: Iterable[bytes], size: int = BLOCK) -> Iterator[list[bytes]]:
    held, n = [], 0
    for text in texts:
        held.append(text)
        n += len(text)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def joined(spans: list[tuple[int, int, int]], kinds: list[str]) -> str:
    return ",".join(f"{kinds[k]}:{start}:{stop}" for start, k, stop in spans)


def find_secrets(docs: DataFrame, more: list[Rule] | None = None) -> DataFrame:
    """One row per input row: ``doc_id``, counts of the base kinds, digest of the base spans, all spans.

    Null texts are empty and have no span; extra columns are ignored; repeated rows are scanned one by one.
    """
    rules = BASE + (MORE if more is None else more)
    kinds, base = [r.kind for r in rules], len(BASE)
    scanner = Scanner(rules)            # compiled once, here; the tasks get its arrays

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [s for held in blocks(t.encode() for t in frame["text"]) for s in scanner.scan(held)]
            own = [[x for x in s if x[1] < base] for s in found]
            out = {"doc_id": frame["doc_id"]}
            for k in range(base):
                out[f"n_{kinds[k]}"] = [sum(x[1] == k for x in s) for s in own]
            out["base_sha256"] = [hashlib.sha256(joined(s, kinds).encode()).hexdigest() for s in own]
            out["spans"] = [joined(s, kinds) for s in found]
            yield pd.DataFrame(out)

    return with_long_id(texts_by_id(docs).mapInPandas(scan, "doc_id string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"))
