"""Quality classifier (operator 10): a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])

The bracket is the sum over all pairs of features of their interaction <v_i, v_j> x_i x_j in time linear in the features.
The model is fitted on the driver on at most ``SAMPLE`` labelled rows (those with the smallest hash of doc_id outside
the held-out fold); every row's whole text is scored in the tasks.  Features: distinct words hashed to ``BUCKETS``
numbers, about twenty statistics of the text cut at the sample's deciles, and the n_chars column as metadata.
doc_id, lang, source and labels are never features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cohortframe.llm.common import begin, crc_fold, word_hashes, words

SAMPLE = 8_000          # labelled rows the model is fitted on, at most
BUCKETS = 1 << 13
RANK = 4
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
BINS = 10
META = 18               # features of n_chars: missing, differs from the text, or its power of two
EPOCHS, BATCH, RATE, DECAY = 8, 256, 0.1, 1e-4

_GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".,", b"!?", b"*#%&$@~^", b"|<>{}[]()=+_/\\", b"-:;'\"`"]
_IN_GROUP = np.zeros((256, len(_GROUPS)), np.float64)
for _g, _chars in enumerate(_GROUPS):
    _IN_GROUP[list(_chars), _g] = 1
N_STATS = len(_GROUPS) + 9


def statistics(text: str, found: list[bytes]) -> np.ndarray:
    """Structure of a text; zeros where a share has no base (empty text)."""
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, lines = max(1, len(raw)), [x for x in raw.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, found), np.int64, len(found)) if found else np.zeros(1, np.int64)
    share = counts @ _IN_GROUP / n
    return np.concatenate([share, [
        counts[128:].sum() / n, np.log1p(len(raw)), np.log1p(len(found)), sizes.mean(), sizes.max(),
        len(set(found)) / max(1, len(found)), len(set(lines)) / max(1, len(lines)), len(raw) / max(1, len(lines)),
        (sizes <= 3).sum() / max(1, len(found))]])


def _meta(n_chars: float, text: str) -> int:
    if n_chars != n_chars or n_chars < 0:
        return 0
    return 1 if int(n_chars) != len(text) else min(META - 1, 2 + int(n_chars).bit_length())


def parts(text: str | None, n_chars: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct word buckets, statistics and metadata feature of one row; null text is empty."""
    text = text or ""
    found = words(text)
    return np.unique(word_hashes(found) & np.uint64(BUCKETS - 1)).astype(np.int32), statistics(text, found), _meta(n_chars, text)


class Machine:
    """Cut points, weights and factors; feature order: words, binned statistics, metadata."""

    def __init__(self, cuts: np.ndarray, bias: float):
        size = BUCKETS + N_STATS * BINS + META
        self.cuts, self.w0 = cuts, bias
        self.w = np.zeros(size, np.float32)
        self.v = np.random.default_rng(7).normal(0, 0.05, (size, RANK)).astype(np.float32)

    def rows(self, batch: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers, values and the start of each row.  The words of a row together have length one."""
        at, value, starts, n = [], [], [], 0
        base = BUCKETS + np.arange(N_STATS) * BINS
        for hashed, stats, meta in batch:
            binned = base + (stats[:, None] > self.cuts).sum(1)
            at += [hashed, binned.astype(np.int32), np.array([BUCKETS + N_STATS * BINS + meta], np.int32)]
            value += [np.full(len(hashed), 1 / np.sqrt(max(1, len(hashed))), np.float32), np.full(N_STATS + 1, 0.25, np.float32)]
            starts.append(n)
            n += len(hashed) + N_STATS + 1
        return np.concatenate(at), np.concatenate(value), np.array(starts)

    def margin(self, at: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score before the sigmoid, and each row's sum of v x."""
        vx = self.v[at] * value[:, None]
        total = np.add.reduceat(vx, starts)
        pairs = 0.5 * (total ** 2 - np.add.reduceat(vx ** 2, starts)).sum(1)
        return self.w0 + np.add.reduceat(self.w[at] * value, starts) + pairs, total

    def score(self, batch: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
        z = self.margin(*self.rows(batch))[0].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, batch: list[tuple[np.ndarray, np.ndarray, int]], label: np.ndarray) -> Machine:
        """Adagrad on the logistic loss; the order of the rows is fixed by the seed."""
        rng, size = np.random.default_rng(11), len(self.w)
        gw, gv = np.full(size, 1e-4, np.float32), np.full((size, RANK), 1e-4, np.float32)
        g0 = 1e-4
        for _ in range(EPOCHS):
            order = rng.permutation(len(batch))
            for i in range(0, len(order), BATCH):
                pick = order[i:i + BATCH]
                at, value, starts = self.rows([batch[j] for j in pick])
                z, total = self.margin(at, value, starts)
                slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[pick]) / len(pick)
                row = np.repeat(np.arange(len(pick)), np.diff(np.append(starts, len(at))))
                d = (slope[row] * value).astype(np.float32)
                d0 = float(slope.sum())
                g0 += d0 * d0
                self.w0 -= RATE * d0 / g0 ** 0.5
                dw = np.bincount(at, d, size).astype(np.float32) + DECAY / len(batch) * self.w
                gw += dw ** 2
                self.w -= RATE * dw / np.sqrt(gw)
                each = d[:, None] * (total[row] - self.v[at] * value[:, None])
                dv = np.stack([np.bincount(at, each[:, f], size) for f in range(RANK)], 1).astype(np.float32) + DECAY / len(batch) * self.v
                gv += dv ** 2
                self.v -= RATE * dv / np.sqrt(gv)
        return self


class Constant:
    """Without rows of both labels there is nothing to learn: the share of label 1, one half without any row."""

    def __init__(self, share: float):
        self.share = share

    def score(self, batch: list) -> np.ndarray:
        return np.full(len(batch), self.share)


def _n_chars(docs: DataFrame) -> Column:
    return (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("double")


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The training rows: ``text, n_chars, quality``.  A doc_id with two labels counts with the smaller one."""
    known = (labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
             .where(crc_fold("doc_id", FOLDS) != HELD_OUT).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = docs.select("doc_id", "text", _n_chars(docs).alias("n_chars"))
    return rows.join(F.broadcast(known), "doc_id").select("text", "n_chars", "quality")      # at most ``sample`` rows


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine | Constant:
    """Fit on the bounded sample; only features travel to the driver, at most BUCKETS + 20 small numbers a row."""
    def featured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [parts(t, n) for t, n in zip(frame["text"], frame["n_chars"])]
            yield pd.DataFrame({"hashed": [g[0].astype("<u2").tobytes() for g in got], "stats": [g[1].tobytes() for g in got],
                                "meta": [g[2] for g in got], "quality": frame["quality"]})

    rows = labelled(docs, labels, sample).mapInPandas(featured, "hashed binary, stats binary, meta int, quality int").collect()
    rows.sort(key=lambda r: (r["stats"], r["hashed"], r["meta"], r["quality"]))          # whatever the partitioning
    label = np.array([r["quality"] == 1 for r in rows], np.float64)
    if not len(rows) or label.min() == label.max():
        return Constant(float(label.mean()) if len(rows) else 0.5)
    batch = [(np.frombuffer(r["hashed"], "<u2").astype(np.int32), np.frombuffer(r["stats"]), r["meta"]) for r in rows]
    cuts = np.quantile(np.stack([b[1] for b in batch]), np.arange(1, BINS) / BINS, axis=0).T
    return Machine(cuts, float(np.log(label.mean() / (1 - label.mean())))).fit(batch, label)


def scorer(model: Machine | Constant):
    """A column function (text, n_chars) -> score for the fitted model."""
    def score(text: pd.Series, n_chars: pd.Series) -> pd.Series:
        begin("quality")
        out, held, size = [], [], 0
        for t, n in zip(text, n_chars):
            held.append(parts(t, n))
            size += len(held[-1][0])
            if size > 100_000:
                out.append(model.score(held))
                held, size = [], 0
        if held:
            out.append(model.score(held))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))
    return F.pandas_udf(score, DoubleType())


def quality_scores(docs: DataFrame, model: Machine | Constant, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.  Extra columns are ignored."""
    scored = docs.select("doc_id", scorer(model)(F.col("text"), _n_chars(docs)).alias("score"))
    return scored.select("doc_id", (crc_fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def good(docs: DataFrame, model: Machine | Constant, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``threshold``."""
    return docs.where(scorer(model)(F.col("text"), _n_chars(docs)) >= threshold)
