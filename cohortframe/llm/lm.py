"""Language-model scoring (operator 9).

Model: a causal self-attention model over subword ids (``attention``).  It predicts the class of the next id; the id
within its class follows the corpus counts.  Classes are runs of ids, by falling count, of about equal count.  Documents
are cut into overlapping windows so that every token is scored once, with at least ``CONTEXT`` tokens before it where
the document has them.

What is learned from the training rows: the counts of all ids, and the weights, in ``ROUNDS`` rounds of averaging.  In a
round every task fits the weights of the round before on its own rows, on one window in ``ROUNDS`` of all of them, another
in each round, so that all windows are learned from once, and every id is a target once, in the window that scores it; the
tasks' weights are averaged by the number of windows they saw.  Vectors of all tasks are summed by an aggregation, so the
driver sees one vector.  The work grows with the corpus; nothing has a size of its own.

Base: the add-one unigram score over words.  Words are counted in hash buckets that grow with the corpus; a bucket holds
a word's occurrences of all rows, gives each row its share of the sum, and shares meet per group of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.llm import attention
from cohortframe.llm.attention import CONTEXT, STRIDE, WINDOW, Attention
from cohortframe.llm.common import crc_fold, stored, texts_by_id, with_long_id, words
from cohortframe.llm.subwords import subwords, vocabulary_path

FOLDS, HELD_OUT = 7, 2
CLASSES = 32
FREQUENT = 2000         # ids with an embedding of their own; the others share SHARED
SHARED = 48
ROUNDS = 3              # rounds of averaging; each learns from its share of the windows, and together from all
STEP = 64               # windows scored at once: their arrays stay in a core's cache
BATCH, RATE = 32, 0.3   # windows of a step, each asked about half its ids; the first round's rate
PER_BUCKET = 6_000_000  # subword ids of the corpus per word bucket
CHUNK = 4096            # numbers of a summed vector in one row
BLOCK = 500_000         # ids handled at once in a task
COUNTED = 4 * BLOCK     # ids whose words go to the buckets together


# ---- ids of whole texts

def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """One row per input row: ``row, doc_id, held_out, n_tokens, n_ids, ids``; written once and read by every later step.

    ``ids``: for each word of the text the subword ids of a space and the word, two bytes each, then the end id.  The
    vocabulary must have fewer than 65,536 ids.
    """
    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = subwords(path, literal=True)
        end = bpe.tokenizer.get_vocab_size() - 1
        tail = np.array([end], "<u2").tobytes()
        for frame in frames:
            n_tokens, ids = [], []
            for block in _blocks(frame["text"], frame["text"].str.len(), 2 * BLOCK):
                found = [words(t) for t in block]
                n_tokens += [len(f) + 1 for f in found]
                ids += [raw + tail for raw in bpe.encode_words(found)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_tokens": n_tokens, "n_ids": [len(i) // 2 for i in ids], "ids": ids})

    rows = with_long_id(texts_by_id(docs).mapInPandas(encode, "doc_id string, n_tokens long, n_ids long, ids binary"))
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", (crc_fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
                              "n_tokens", "n_ids", "ids"), "tokens", compression="zstd")


def _blocks(items: Iterable, sizes: Iterable[int], most: int) -> Iterator[list]:
    held, n = [], 0
    for item, size in zip(items, sizes):
        held.append(item)
        n += size
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def summed(rows: DataFrame, vector: Callable[[Iterator[pd.DataFrame]], np.ndarray], size: int) -> np.ndarray:
    """The sum over all tasks of ``vector`` (``size`` numbers) of the task's rows, added up in the cluster piece by piece."""
    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = np.asarray(vector(frames), np.float64)
        if v.any():
            yield pd.DataFrame({"at": range(0, size, CHUNK), "v": [v[i:i + CHUNK].tobytes() for i in range(0, size, CHUNK)]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": frame["at"][:1], "v": [sum(np.frombuffer(b) for b in frame["v"]).tobytes()]})

    # first within groups of tasks, then over the groups: no piece gathers the vectors of all tasks at once
    near = rows.mapInPandas(emit, "at int, v binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    part = near.groupBy("at", "salt").applyInPandas(lambda f: add(f[["at", "v"]]), "at int, v binary")
    out = np.zeros(size)
    for r in part.groupBy("at").applyInPandas(add, "at int, v binary").collect():
        out[r["at"]:r["at"] + CHUNK] += np.frombuffer(r["v"])
    return out


# ---- the model

class Model:
    """Counts to classes and symbols, and the weights."""

    def __init__(self, counts: np.ndarray, classes: int = CLASSES):
        order = np.argsort(-counts, kind="stable")
        mass = np.cumsum(counts[order] + 1) - (counts[order] + 1)
        self.of_class = np.empty(len(counts), np.int32)
        self.of_class[order] = np.minimum(classes - 1, mass * classes / (counts.sum() + len(counts))).astype(np.int32)
        inside = np.bincount(self.of_class, counts + 1, classes)
        self.log_inside = np.log((counts + 1) / inside[self.of_class]).astype(np.float32)
        rank = np.empty(len(counts), np.int64)
        rank[order] = np.arange(len(counts))
        self.symbol = np.where(rank < FREQUENT, rank, FREQUENT + np.arange(len(counts)) % SHARED).astype(np.int32)
        self.net = Attention(FREQUENT + SHARED + 1, classes)        # the last symbol begins a text

    def laid(self, ids: list[np.ndarray], pick: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None):
        """Windows of input symbols, target ids, positions to score, and the text of each window.

        ``pick`` takes the text and the number within it of each window and tells which to lay.
        """
        lengths = np.array([len(i) for i in ids])
        target = np.concatenate(ids)
        symbols = np.empty(len(target) + 1, np.int32)
        symbols[1:] = self.symbol[target]
        first = np.cumsum(lengths) - lengths
        symbols[first] = FREQUENT + SHARED
        start, of = attention.windows(lengths)
        if pick is not None:
            chosen = pick(of, (start - first[of]) // STRIDE)
            start, of = start[chosen], of[chosen]
        at = start[:, None] + np.arange(WINDOW)
        valid = at < (first + lengths)[of][:, None]
        scored = valid & ((np.arange(WINDOW) >= CONTEXT) | (start == first[of])[:, None])
        at = np.minimum(at, len(target) - 1)
        return symbols[at], target[at], valid, scored, of

    def score(self, ids: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each text."""
        out = np.zeros(len(ids))
        symbols, target, _, scored, of = self.laid(ids)
        for own in _by_kind(scored, np.arange(len(of))):
            for i in range(0, len(own), STEP):
                s = own[i:i + STEP]
                there, goal = scored[s], target[s]
                logs = self.net.log_classes(symbols[s], self.of_class[goal], there) + self.log_inside[goal[there]]
                out += np.bincount(np.repeat(of[s], there.sum(1)), logs, len(ids))
        return out / math.log(10)

    def learn(self, ids: list[np.ndarray], rate: float, pick: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> int:
        """Learns from each window what it scores, so that every id is a target once.  How many windows there were."""
        symbols, target, _, scored, of = self.laid(ids, pick)
        rng = np.random.default_rng(5)
        steps = [own[i:i + BATCH] for own in _by_kind(scored, rng.permutation(len(of))) for i in range(0, len(own), BATCH)]
        for i in rng.permutation(len(steps)):
            s = steps[i]
            self.net.learn(symbols[s], self.of_class[target[s]], scored[s], rate)
        return len(of)


def _by_kind(scored: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of ``order`` that begin a text, and the later ones, of which only what follows their context is asked."""
    begins = scored[order, 0]
    return order[begins], order[~begins]


def _ids(frame: pd.DataFrame) -> Iterator[list[np.ndarray]]:
    for block in _blocks(frame["ids"], frame["ids"].str.len(), 2 * BLOCK):
        yield [np.frombuffer(b, "<u2").astype(np.int64) for b in block]


def fit(rows: DataFrame, vocabulary: int) -> Model:
    """Counts and weights from all training rows; without any, no counts and the weights as they were drawn."""
    train = rows.where("NOT held_out").select("row", "ids")

    def count(frames: Iterator[pd.DataFrame]) -> np.ndarray:
        total = np.zeros(vocabulary)
        for frame in frames:
            for ids in _ids(frame):
                total += np.bincount(np.concatenate(ids), minlength=vocabulary)
        return total

    model = Model(summed(train, count, vocabulary))
    for turn in range(ROUNDS):
        began = model.net.flat()

        def further(frames: Iterator[pd.DataFrame]) -> np.ndarray:
            model.net.load(began)
            seen = 0
            for frame in frames:
                number, at = frame["row"].to_numpy(np.int64), 0
                for ids in _ids(frame):
                    own = number[at:at + len(ids)]
                    seen += model.learn(ids, RATE / (turn + 1), lambda of, k: np.flatnonzero((own[of] + k) % ROUNDS == turn))
                    at += len(ids)
            return np.append(model.net.flat() * seen, seen)

        total = summed(train, further, len(began) + 1)
        if total[-1]:
            model.net.load(total[:-1] / total[-1])
    return model


def scored(rows: DataFrame, model: Model) -> DataFrame:
    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = frame.pop("ids")
            frame["score"] = np.concatenate([model.score(b) for b in _ids(ids.to_frame("ids"))]) if len(ids) else 0.0
            yield frame

    named = rows.select("row", F.col("doc_id").cast("string"), "held_out", "n_tokens", "ids")
    return with_long_id(named.mapInPandas(score, "row long, doc_id string, held_out boolean, n_tokens long, score double"))


# ---- the base score

_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]


def _word_counts(ids: list[np.ndarray], begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word hash, count) of the words of each text; a word is the ids from one that begins with a space to the next."""
    lengths = np.array([len(i) - 1 for i in ids])           # without the end
    flat = np.concatenate([i[:-1] for i in ids])
    if not len(flat):
        return (np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * 2)
    starts = np.flatnonzero(begins[flat])
    place = np.arange(len(flat), dtype=np.uint64) - np.repeat(starts.astype(np.uint64), np.diff(np.append(starts, len(flat))))
    h = (flat.astype(np.uint64) + (place << np.uint64(16)) + np.uint64(1)) * _MIX[0]
    for shift, mix in ((30, _MIX[1]), (27, _MIX[2])):
        h ^= h >> np.uint64(shift)
        h *= mix
    h ^= h >> np.uint64(31)
    h = np.add.reduceat(h, starts)
    text = np.searchsorted(np.cumsum(lengths), starts, "right")
    key = h + (text.astype(np.uint64) + np.uint64(1)) * _MIX[1]       # of the text and the word; one sort finds the repeats
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    first = order[at]
    return text[first], h[first], np.diff(np.append(at, len(key)))


def _narrow(values: np.ndarray) -> bytes:
    """Two bytes each where that is enough, else four; ``_wide`` tells by the length."""
    return values.astype("<u2" if values.max(initial=0) < 1 << 16 else "<u4").tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.int64)


def base_sums(rows: DataFrame, path: str) -> tuple[DataFrame, int]:
    """Per row the sum of count x log10(c + 1) over its words and the known tokens among them; and the number of distinct training words.

    A block of rows of a task sends each bucket its words as (row's place in the block, hash, count and fold); the bucket
    answers the block with (place, share, known).  The block's row numbers travel once, with one of the buckets.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum("n_ids")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PER_BUCKET))
    begins = subwords(path, literal=True).begins()

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            numbers, train = frame["row"].to_numpy(np.int64), ~frame["held_out"].to_numpy(bool)
            raw = frame["ids"].array
            for pick in _blocks(range(len(raw)), frame["ids"].str.len(), 2 * COUNTED):
                text, h, n = _word_counts([np.frombuffer(raw[i], "<u2") for i in pick], begins)
                if not len(h):
                    continue
                bucket = ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                text, h, n = text[order], h[order], n[order] * 2 + train[pick][text[order]]
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                out = []
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    s = slice(cuts[b], cuts[b + 1])
                    out.append((b, int(numbers[pick[0]]), None if out else numbers[pick].tobytes(), _narrow(text[s]), h[s].tobytes(), _narrow(n[s])))
                yield pd.DataFrame(out, columns=["bucket", "block", "rows", "place", "hash", "n"])

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        sizes = [len(b) // 8 for b in frame["hash"]]
        h = np.concatenate([np.frombuffer(b, np.uint64) for b in frame["hash"]])
        marked = np.concatenate([_wide(b, k) for b, k in zip(frame["n"], sizes)])
        word, at = np.unique(h, return_inverse=True)
        n = (marked >> 1).astype(np.float64)
        c = np.bincount(at, n * (marked & 1), len(word))
        worth, known = n * np.log10(c + 1)[at], n * (c > 0)[at]
        out, lo = [], 0
        for block, numbers, raw, size in zip(frame["block"], frame["rows"], frame["place"], sizes):
            place = _wide(raw, size)
            share, seen = np.bincount(place, worth[lo:lo + size]), np.bincount(place, known[lo:lo + size]).astype(np.int64)
            own = np.unique(place)
            out.append((block, numbers, _narrow(own), share[own].tobytes(), _narrow(seen[own]), 0))
            lo += size
        out.append((-1, None, b"", b"", b"", int((c > 0).sum())))
        return pd.DataFrame(out, columns=["block", "rows", "place", "share", "known", "words"])

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        row = np.frombuffer(next(b for b in frame["rows"] if b is not None), np.int64)
        share, known = np.zeros(len(row)), np.zeros(len(row), np.int64)
        for raw, s, k in zip(frame["place"], frame["share"], frame["known"]):
            place = _wide(raw, len(s) // 8)
            share[place] += np.frombuffer(s)
            known[place] += _wide(k, len(place))
        return pd.DataFrame({"row": row, "share": share, "known": known})

    spread = rows.select("row", "held_out", "ids").mapInPandas(emit, "bucket int, block long, rows binary, place binary, hash binary, n binary")
    shares = stored(spread.groupBy("bucket").applyInPandas(count, "block long, rows binary, place binary, share binary, known binary, words long"), "shares", compression="zstd")
    distinct = shares.agg(F.sum("words")).first()[0] or 0
    return shares.where("block >= 0").groupBy("block").applyInPandas(gather, "row long, share double, known long"), distinct


def score_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Null texts are empty: they have the end token alone.  Repeated rows count and are scored one by one; a null doc_id
    folds as empty text.  Without training rows N and V are 0 and the model keeps its first weights.
    """
    path = path or vocabulary_path()
    rows = tokenised(docs, path)
    known = rows.where("NOT held_out").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("texts")).first()
    train_tokens, ends = known["n"] or 0, known["texts"]
    shares, distinct = base_sums(rows, path)
    model = fit(rows, subwords(path, literal=True).tokenizer.get_vocab_size())
    size = train_tokens + distinct + (ends > 0) + 1
    out = scored(rows, model).join(shares, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.coalesce("known", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.coalesce("share", F.lit(0.0)) + F.lit(math.log10(ends + 1)) - F.col("n_tokens") * F.lit(math.log10(size))).alias("base_score"), "score")
