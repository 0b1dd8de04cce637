"""Personal data (operator 1): candidate spans scored by gradient-boosted trees.

* Rules with checks (address pattern, octets, Luhn, digit counts) give the base spans; those always stay.
* High-recall generators propose overlapping spans of other writings: addresses with "(at)" and "dot", numbers without
  their plus sign or with other separators, every run of consecutive digit groups.
* One ensemble of boosted trees per kind judges a span by its format and context.  There are no labels for personal data,
  so it learns from base spans of a bounded sample of rows, rewritten in the other writings in their own context
  (right), against every other span the generators propose there and rewritten spans with broken checks (wrong).
* Probabilities are calibrated on windows kept out of the boosting, and a kind's threshold is the smallest one that is
  precise enough there.  Of overlapping accepted spans the likeliest stays; none may touch a base span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.llm.boosting import Trees, precise_threshold
from cohortframe.llm.common import stored, texts_by_id, with_long_id
from cohortframe.llm.secrets import joined

KINDS = ["email", "ip", "card", "phone"]
SAMPLE_ROWS = 750           # rows per kind the trees are fitted on, at most
SAMPLE_SPANS = 20           # spans of one sampled row, at most
CONTEXT = 60                # chars kept on each side of a sampled span
PRECISION = 0.98
LEAST_EXAMPLES = 40         # right spans a kind needs before it may add any

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]     # start, kind, end


def luhn(digits: str) -> bool:
    values = np.frombuffer(digits.encode(), np.uint8)[::-1].astype(np.int64) - 48
    values[1::2] *= 2
    return int((values - 9 * (values > 9)).sum()) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octets(text: str) -> bool:
    parts = [p.lstrip("0") for p in re.findall("[0-9]+", text)]         # of any length
    return all(len(p) < 3 or (len(p) == 3 and p <= "255") for p in parts)


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that pass their check, by start and kind."""
    out: list[Span] = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in _EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _octets(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# ---- candidates

_AT = r"(?:@| ?[(\[{] ?(?:at|AT) ?[)\]}] ?| at )"
_DOT = r"(?:\.| ?[(\[{] ?(?:dot|DOT) ?[)\]}] ?| dot )"
_SIGN = re.compile(_AT)
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_STRIDE = 256               # chars looked back at first for the beginning of a local part
_DOMAIN = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+")
_NUMBER = re.compile(r"[+(]{0,2}[0-9]+(?:[\x20()./_\[\]-]{1,3}[0-9]+)*")
_GROUP = re.compile("[0-9]+")
MOST_DIGITS = 19            # of a card, the longest number


def _local_part(text: str, stop: int) -> int:
    """Where the local part that ends at ``stop`` begins, however long it is."""
    back = _STRIDE
    while True:
        local = _LOCAL.match(text[max(0, stop - back):stop][::-1])
        if local is None or local.end() < back or back >= stop:
            return stop - (local.end() if local else 0)
        back *= 2


def candidates(text: str) -> Iterator[Span]:
    """Overlapping spans, generously."""
    for m in _SIGN.finditer(text):
        domain = _DOMAIN.match(text, m.end())
        if domain and (start := _local_part(text, m.start())) < m.start():
            yield start, 0, domain.end()
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in _GROUP.finditer(m[0])]
        for i in range(len(groups)):
            n = 0
            for j in range(i, len(groups)):
                n += groups[j][1] - groups[j][0]
                if n > MOST_DIGITS:
                    break
                start = m.start() if i == 0 else groups[i][0] - (text[groups[i][0] - 1] in "+(")
                if j - i == 3 and n <= 12:
                    yield start, 1, groups[j][1]
                if n >= 12:
                    yield start, 2, groups[j][1]
                if 7 <= n <= 15:
                    yield start, 3, groups[j][1]


_CUES = [("mail", "contact", "write", "reach"), ("ip", "host", "server", "addr", "from", "node"), ("card", "visa", "cc", "credit", "pay", "mastercard", "amex"),
         ("tel", "phone", "call", "fax", "mobile", "cell")]
_WORD = re.compile(r"[A-Za-z]+")
N_FEATURES = 35


def _side(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4 if c in ".,;:!?" else 5


def features(text: str, span: Span) -> list[int]:
    """Format and context of a span as numbers from 0 to 31."""
    start, _, stop = span
    body = text[start:stop]
    groups, digits = _GROUP.findall(body), _digits(body)
    sizes = [len(g) for g in groups] or [0]
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 30):start])[-3:]]
    labels = re.split(_DOT, re.split(_AT, body)[-1]) if any(c.isalpha() for c in body) else []
    out = [len(digits), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1], sizes[-2] if len(sizes) > 1 else 0,
           sizes[1] if len(sizes) > 1 else 0, sizes[2] if len(sizes) > 2 else 0, int(body[:1] in "+("), int(body[:1].isdigit()),
           int(len(digits) > 1 and luhn(digits)), int(bool(groups) and _octets(body)), int("+" in body), int("(" in body),
           body.count("."), body.count("-"), body.count(" "), sum(body.count(c) for c in "/_[]"), int("@" in body),
           sum(c.isalpha() for c in body), len(labels), len(labels[-1]) if labels else 0, int(bool(labels) and labels[-1].isalpha()),
           len(set(digits)), int(digits[:1] or 0), _side(text[start - 1:start]), _side(text[stop:stop + 1]),
           int(text[max(0, start - 2):start].strip(" ().-/_")[-1:].isdigit()), int(text[stop:stop + 2].strip(" ().-/_")[:1].isdigit()), int(len(set(sizes)) == 1)]
    out += [int(any(w in cue for w in before)) for cue in _CUES]
    return [min(31, v) for v in out]


# ---- training

def _rewritings(kind: int, body: str) -> list[tuple[str, bool]]:
    """Other writings of a base span; false: it would not be one any more."""
    groups, digits = _GROUP.findall(body), _digits(body)
    if kind == 0:
        name, _, domain = body.partition("@")
        right = [(name + at + dot.join(domain.split(".")), True) for at, dot in ((" (at) ", "."), ("[at]", "[dot]"), (" at ", " dot "), (" at ", "."))]
        word, first = "".join(c for c in name if c.isalpha())[:6] or "it", domain.split(".")[0]
        return right + [(f"{word} at {first}.The", False), (f"{word} at 5.30", False), (f"{first} (at) {word}.And", False), (f"9 at {first}.{word}er", False)]
    if kind == 1:
        wrong = groups[:2] + [str(int(groups[2]) + 256)] + groups[3:]
        return [("[.]".join(groups), True), (" . ".join(groups), True), ("-".join(groups[:4]), False), ("[.]".join(wrong), False), (".".join(wrong), False)]
    fours = [digits[i:i + 4] for i in range(0, len(digits), 4)]
    if kind == 2:
        wrong = digits[:-1] + str((int(digits[-1]) + 3) % 10)
        return [(".".join(fours), True), ("/".join(fours), True), (wrong, False), (".".join([*fours[:-1], wrong[-len(fours[-1]):]]), False)]
    home = digits[1:] if digits[0] == "1" and len(digits) == 11 else digits[-10:]
    cut = [home[:3], home[3:6], home[6:]]
    return [(f"({cut[0]}) {cut[1]}-{cut[2]}", True), ("-".join(cut), True), (".".join(cut), True), (" ".join(cut), True), (digits[:2] + digits, False),
            (f"{home[:2]} {home[2:4]} {home[4:6]} 19{home[6:8]}", False), (f"20{home[:2]}-{home[2:4]}-{home[4:6]} {home[6:8]}", False), (f"{cut[0]}.{cut[1]}", False)]


def _examples(windows: list[tuple[str, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, kind, label and fold of every proposed span in the windows (text, start, kind, end) and their rewritings."""
    x, kinds, label, held = [], [], [], []
    for text, start, kind, stop in windows:
        fold = xxhash.xxh3_64_intdigest(text.encode()) % 4 == 0
        whole, lead = text[start:stop], f"{_digits(text[start:stop])[:3]}-{_digits(text[start:stop])[3:7]} "
        leads = [(lead, whole, True)] if kind == 2 else []             # a card's number right after another number
        for before, body, right in [("", whole, True), *leads, *(("", b, r) for b, r in _rewritings(kind, whole))]:
            said, at = text[:start] + before + body + text[stop:], start + len(before)
            seen = {(s, k, e) for s, k, e in candidates(said) if s < at + len(body) and e > start}
            for span in sorted(seen):
                x.append(features(said, span))
                kinds.append(span[1])
                label.append(right and span == (at, kind, at + len(body)))
                held.append(fold)
    return np.array(x, np.int64).reshape(-1, N_FEATURES), np.array(kinds), np.array(label, np.float64), np.array(held, bool)


class Judge:
    """A calibrated ensemble and threshold per kind; a kind with too few examples adds nothing."""

    def __init__(self, windows: list[tuple[str, int, int, int]], precision: float = PRECISION):
        x, kinds, label, held = _examples(windows)
        self.trees: list[Trees | None] = []
        self.threshold: list[float] = []
        for k in range(len(KINDS)):
            own = kinds == k
            y, h = label[own], held[own]
            if min(y[~h].sum(), y[h].sum() * 3, (1 - y[~h]).sum(), (1 - y[h]).sum() * 3) < LEAST_EXAMPLES:
                self.trees.append(None)
                self.threshold.append(1.1)
                continue
            trees = Trees().fit(x[own], y, h)
            self.trees.append(trees)
            self.threshold.append(precise_threshold(trees.probability(x[own][h]), y[h], precision))

    def added(self, text: str, base: list[Span]) -> list[Span]:
        found = sorted({c for c in candidates(text)} - set(base))
        found = [c for c in found if not any(c[0] < e and s < c[2] for s, _, e in base)] if len(base) < 50 else _clear_of(found, base)
        if not found:
            return []
        x = np.array([features(text, c) for c in found], np.int64)
        kinds = np.array([c[1] for c in found])
        accepted: list[tuple[float, Span]] = []
        for k, trees in enumerate(self.trees):
            own = np.flatnonzero(kinds == k)
            if trees is not None and len(own):
                p = trees.probability(x[own])
                accepted += [(-float(q), found[i]) for q, i in zip(p, own) if q >= self.threshold[k]]
        out: list[Span] = []
        taken = np.zeros(0, np.int64)
        for _, c in sorted(accepted):
            at = np.searchsorted(taken, [c[0], c[2]], "right")
            if at[0] == at[1] and at[0] % 2 == 0 and not (at[0] < len(taken) and taken[at[0]] < c[2]):
                taken = np.insert(taken, at[0], [c[0], c[2] - 1])
                out.append(c)
        return out


def _clear_of(found: list[Span], base: list[Span]) -> list[Span]:
    """The spans that touch no base span, by the furthest end of the base spans that begin before them."""
    starts = np.array([s for s, _, _ in base])
    reach = np.maximum.accumulate([e for _, _, e in base])
    at = np.searchsorted(starts, [c[2] for c in found], "left") - 1
    return [c for c, i in zip(found, at.tolist()) if i < 0 or reach[i] <= c[0]]


def _windows(text: str) -> list[tuple[str, int, int, int]]:
    out = []
    for start, kind, stop in base_spans(text)[:SAMPLE_SPANS]:
        if stop - start <= 100:
            left = max(0, start - CONTEXT)
            out.append((text[left:stop + CONTEXT], start - left, kind, stop - left))
    return out


# what a row with a base span of the kind is sure to hold
_HINTS = ["@[A-Za-z0-9-]+[.]", "[0-9][.][0-9]+[.][0-9]+[.][0-9]", "[0-9]([ -]?[0-9]){11}", "[+][0-9][ ().0-9-]{7}"]


def fit_judge(docs: DataFrame, sample: int = SAMPLE_ROWS) -> Judge:
    """Fit on at most ``sample`` rows of each kind: those with the smallest hash of doc_id that may hold a base span of it.

    Of a row at most ``SAMPLE_SPANS`` spans of up to 100 characters are learned from.
    """
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([w for t in frame["text"] for w in _windows(t)], columns=["text", "start", "kind", "stop"])

    hints = F.array(*[F.when(F.col("text").rlike(hint), F.lit(k)) for k, hint in enumerate(_HINTS)])
    hinted = stored(docs.where(F.col("text").rlike("@|[0-9][^A-Za-z]+[0-9]")).select("doc_id", F.explode(F.array_compact(hints)).alias("kind")), "hinted")
    ids = None
    for k in range(len(KINDS)):
        own = hinted.where(F.col("kind") == k).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        ids = own if ids is None else ids.union(own)
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(ids.distinct()), "doc_id").select("text")     # at most ``sample`` ids a kind
    got = rows.mapInPandas(cut, "text string, start int, kind int, stop int").collect()
    return Judge(sorted((r["text"], r["start"], r["kind"], r["stop"]) for r in got))


def find_personal_data(docs: DataFrame, judge: Judge) -> DataFrame:
    """One row per input row: ``doc_id``, counts of base spans, their digest, all spans.

    Null texts are empty and have no span; extra columns are ignored; repeated rows are searched one by one.
    """
    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            base = [base_spans(t) for t in frame["text"]]
            out = {"doc_id": frame["doc_id"]}
            for k, kind in enumerate(KINDS):
                out[f"n_{kind}"] = [sum(s[1] == k for s in spans) for spans in base]
            out["base_sha256"] = [hashlib.sha256(joined(s, KINDS).encode()).hexdigest() for s in base]
            out["spans"] = [joined(sorted(s + judge.added(t, s)), KINDS) for t, s in zip(frame["text"], base)]
            yield pd.DataFrame(out)

    return with_long_id(texts_by_id(docs).mapInPandas(
        find, "doc_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"))
