"""Sequence packing by minimum bin slack (operator 8).

Only the lengths matter for the plan, and there are at most ``capacity`` of them, so the histogram of piece lengths is
all the driver sees, at any corpus size.  Per bin, a bitset subset-sum over the lengths still available (bit ``s`` of a
Python integer: the sum ``s`` can be made) finds the combination that, together with the longest piece left, fills the
bin best; it is then removed.  The same combination stays the fullest as long as it is available, so it is removed for
as many bins as the counts allow, and the number of steps depends on the number of lengths, not on the number of
pieces.  Pieces learn their place from their rank among those of equal length; no bin is ever gathered in a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.llm.common import begin, stored, texts_by_id, with_long_id
from cohortframe.llm.subwords import subwords, vocabulary_path
from cohortframe.operators.ranking import ranked

CAPACITY = 2048
END_ID = 0


def fullest(counts: np.ndarray, room: int) -> dict[int, int]:
    """The pieces (length -> copies, at most ``counts[length]``) with the largest sum of at most ``room``; long ones first."""
    mask, sums, steps = (1 << (room + 1)) - 1, 1, []
    for length in np.flatnonzero(counts[:room + 1])[::-1].tolist():
        left, copies = min(int(counts[length]), room // length), 1
        while left and not sums >> room & 1:
            copies = min(copies, left)
            grown = (sums | sums << copies * length) & mask
            if grown != sums:
                steps.append((copies, length, sums))
                sums = grown
            left -= copies
            copies *= 2
        if sums >> room & 1:
            break
    at, chosen = sums.bit_length() - 1, {}
    for copies, length, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + copies
            at -= copies * length
    return chosen


def slack_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, length -> copies per bin) until every piece of the histogram is placed."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    plan = []
    while counts.any():
        longest = int(np.flatnonzero(counts)[-1])
        counts[longest] -= 1
        combo = fullest(counts, capacity - longest)
        counts[longest] += 1
        combo[longest] = combo.get(longest, 0) + 1
        bins = min(int(counts[length]) // copies for length, copies in combo.items())
        for length, copies in combo.items():
            counts[length] -= bins * copies
        plan.append((bins, combo))
    return plan


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, remembered: int | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each row's ids and the end id, cut into pieces of ``capacity``, the first may be shorter.

    A null text is empty and has the end id alone.  Rows that repeat a doc_id are each cut; a null doc_id is kept.
    ``remembered`` bounds the chunks a worker knows the ids of (``subwords.LIMIT``): memory against CPU, not the result.
    """
    path = path or vocabulary_path()
    end = np.array([END_ID], "<u4").tobytes()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin("subwords")
        for frame in frames:
            rows, of = [], []
            for r, ids in enumerate(subwords(path, limit=remembered).encode(frame["text"])):
                ids += end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                for k, start in enumerate([0, *range(first, n, capacity)]):
                    stop = start + (capacity if k else first)
                    rows.append((k, start, stop - start, zlib.crc32(memoryview(ids)[4 * start:4 * stop])))
                    of.append(r)
            out = pd.DataFrame(rows, columns=["piece", "start", "length", "ids_crc32"])
            out.insert(0, "doc_id", frame["doc_id"].to_numpy(object)[of] if of else [])
            yield out

    return with_long_id(texts_by_id(docs).mapInPandas(cut, "doc_id string, piece int, start long, length long, ids_crc32 long"))


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a table of pieces; ``cut`` should be stored, it is read three times."""
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}   # capacity rows at most
    keys, of = [], []
    used: dict[int, int] = {}
    base = 0
    for bins, combo in slack_plan(histogram, capacity):
        offset = 0
        for length in sorted(combo, reverse=True):
            copies = combo[length]
            keys.append(length << 48 | used.get(length, 0))
            of.append((used.get(length, 0), copies, base, offset))
            used[length] = used.get(length, 0) + bins * copies
            offset += copies * length
        base += bins
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    keys, of = np.array(keys, np.int64)[order], np.array(of, np.int64).reshape(-1, 4)[order]

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rank, length = frame.pop("rank").to_numpy(np.int64) - 1, frame["length"].to_numpy(np.int64)
            first, copies, bin0, offset = of[np.searchsorted(keys, length << 48 | rank, "right") - 1].T
            frame["sequence_id"] = bin0 + (rank - first) // copies
            frame["offset"] = offset + (rank - first) % copies * length
            yield frame

    numbered = ranked(cut, ["doc_id", "piece"], by=["length"], name="rank").withColumn("doc_id", F.col("doc_id").cast("string"))
    return with_long_id(numbered.mapInPandas(place, "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, remembered: int | None = None) -> DataFrame:
    return pack(stored(pieces(docs, path, capacity, remembered), "pieces"), capacity)
