"""Neighbours of genotype rows by column blocks: donors for missing cells, nearest samples by Hamming distance.

No row is ever held whole.  Columns are dealt into blocks of at most ``COLS``, rows into blocks of at most ``ROWS`` alike
ones, and a tile, one of each, holds hard calls as three bit planes (present, at least 1, equal to 2), so about 100 kB.
Two row blocks meet in one task, which reads their tiles column block by column block and keeps only sums over pairs of
rows.  Partial sums bound the distance from below; a pair beyond its rows' bounds is stopped, and once no pair is left
the remaining tiles are not even unpacked.

1. Every group of row blocks meets itself: rows near each other are together, so this gives good answers and an upper bound per row.
2. All pairs of row blocks meet on an eighth of the columns.  Those in which every pair is hopeless are done.
3. The others meet on all columns, and what they find is merged with the first answers.

Meanwhile a task keeps no more than the nearest donors of each gap, and what it has found bounds what it still looks for.
Hamming distances in a single column block have nothing to stop early; there two groups meet in a few products.

Alikeness only saves work; the result is exact for any order of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortframe.operators.ranking import ranked
from cohortframe.session import cut_lineage, measured

ROWS, COLS = 256, 1024      # of a tile, at most
LEAST_BLOCKS = 8            # row blocks of a small table, for enough tasks
PROBE = 8                   # one in so many column blocks is tried on all pairs of row blocks
PIVOTS = 16                 # rows of one column block that sort the others by likeness
SIDES = 64                  # groups of row blocks, so a tile is sent to about as many tasks, while a group fits
HELD = 32 << 20             # bytes of the tiles of a group
GATHERED = 200_000          # donors that come before those beyond the k nearest go
BATCH = 100_000             # donors given back at once
TOGETHER = 16               # row blocks of base rows that queries meet at once
BOUND, WORK = -1, -2        # marks in place of a column: a row's bound, a meeting's (pairs completed, pairs)

_FOUND = "row string, idx long, donor string, distance double, value double"
_HEAD = ["ids", "present", "wants", "gives", "bound"]


def pack(values: np.ndarray) -> bytes:
    """A tile of values, NaN where there is none: bit planes if all are hard calls, else a byte each that names one of a few
    numbers, else the numbers themselves."""
    there = ~np.isnan(values)
    if np.isin(values[there], (0.0, 1.0, 2.0)).all():
        return b"\1" + np.packbits(np.stack([there, values >= 1.0, values == 2.0])).tobytes()
    book, named = np.unique(values[there], return_inverse=True)
    if len(book) < 256:
        codes = np.zeros(values.shape, np.uint8)
        codes[there] = named + 1
        return b"\2" + bytes([len(book)]) + book.tobytes() + codes.tobytes()
    return b"\0" + values.tobytes()


def unpack(data: bytes, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Values, 0 where there is none, and which are there."""
    if data[0] == 2:
        book = np.frombuffer(data, float, count=data[1], offset=2)
        codes = np.frombuffer(data, np.uint8, offset=2 + 8 * data[1]).reshape(rows, width)
        return np.concatenate([[0.0], book])[codes], codes > 0
    if data[0]:
        planes = np.unpackbits(np.frombuffer(data, np.uint8, offset=1), count=3 * rows * width).reshape(3, rows, width)
        return (planes[1] + planes[2]).astype(np.float32), planes[0].astype(bool)
    values = np.frombuffer(data[1:]).reshape(rows, width)
    there = ~np.isnan(values)
    return np.where(there, values, 0.0), there


def _squares(a, ma, b, mb) -> tuple[np.ndarray, np.ndarray]:
    """Squared differences and shared columns of every pair of rows."""
    xa, xb = ma.astype(a.dtype), mb.astype(b.dtype)
    return np.hstack([a * a, xa, -2 * a]) @ np.hstack([xb, b * b, b]).T, xa @ xb.T


def _mismatches(a, ma, b, mb) -> tuple[np.ndarray, np.ndarray]:
    """Columns that differ; missing equals missing only."""
    same = (~ma).astype(np.float32) @ (~mb).astype(np.float32).T
    for v in np.intersect1d(a[ma], b[mb]):
        same += ((a == v) & ma).astype(np.float32) @ ((b == v) & mb).astype(np.float32).T
    return a.shape[1] - same, np.zeros_like(same)


class _Meeting:
    """Two row blocks (or one with itself): sums over the column blocks so far, the pairs not yet hopeless, what they find."""

    def __init__(self, kind: str, p: int, n_cb: int, k: int, own: bool):
        self.kind, self.p, self.n_cb, self.k, self.own = kind, p, n_cb, k, own
        self.width = math.ceil(p / n_cb)
        self.heads: list = [None, None]
        self.held = self.distance = None

    def take(self, t) -> list | None:
        if t.step == 0:
            self.heads[t.side] = t
            if self.own:
                self.heads[1] = t
            if self.heads[0] is not None and self.heads[1] is not None:
                self._open()
        elif not self.alive.any():
            return None
        elif self.own:
            return self._tile(t, t)
        elif t.side == 0:
            self.held = t
        else:
            return self._tile(self.held, t)
        return None

    def _open(self) -> None:
        a, b = self.heads
        self.n = [len(a.ids), len(b.ids)]
        self.names = [np.asarray(h.ids, object) for h in (a, b)]
        self.limit = [np.full(n, np.inf) if h.bound is None else np.asarray(h.bound, float) for h, n in zip((a, b), self.n)]
        self.left = [np.asarray(h.present, float) for h in (a, b)]
        self.ahead = np.asarray(a.wants, bool)[:, None] & np.asarray(b.gives, bool)[None, :]       # rows of the first ask
        self.back = np.zeros_like(self.ahead) if self.own else np.asarray(a.gives, bool)[:, None] & np.asarray(b.wants, bool)[None, :]
        if self.own:
            np.fill_diagonal(self.ahead, False)
        self.asked = np.asarray(a.wants, bool)
        self.pairs = int((self.ahead | self.back).sum())
        self.worst = np.full(self.n[0], -np.inf)
        self.sums, self.both = np.zeros(self.n), np.zeros(self.n)
        self.alive = self.ahead | self.back

    def _tile(self, t, u) -> list | None:
        a, ma = unpack(t.data, self.n[0], self.width)
        b, mb = (a, ma) if self.own else unpack(u.data, self.n[1], self.width)
        if t.step == 1:
            i, j = np.flatnonzero(self.alive.any(1)), np.flatnonzero(self.alive.any(0))
            sums, both = (_squares if self.kind == "euclid" else _mismatches)(a[i], ma[i], b[j], mb[j])
            self.sums[np.ix_(i, j)] += sums
            self.both[np.ix_(i, j)] += both
            self.left = [self.left[0] - ma.sum(1), self.left[1] - mb.sum(1)]
            if not self.own:
                self._stop()
            return None
        if self.distance is None:
            self._close()
            by_name = [np.argsort(n.astype(str), kind="stable") for n in self.names]
            self.order = [[g[np.argsort(d[g], kind="stable")] for d in m] for m, g in (
                (np.where(self.ahead, self.distance, np.inf), by_name[1]), (np.where(self.back, self.distance, np.inf).T, by_name[0]))]
        out = [(0, self._donors(0, int(t.cb), ma, b, mb))]
        return out if self.own else [*out, (1, self._donors(1, int(t.cb), mb, a, ma))]

    def named(self, out: list | None) -> Iterator[pd.DataFrame]:
        for side, (r, idx, o, distance, value) in out or ():
            if len(r):
                yield pd.DataFrame({"row": self.names[side][r], "idx": idx, "donor": self.names[1 - side][o], "distance": distance, "value": value})

    def _stop(self) -> None:
        """Drop the pairs whose distance, whatever the columns to come hold, is beyond the asking row's bound."""
        if self.kind == "euclid":
            shared = self.both + np.minimum(np.maximum(self.left[0], 0)[:, None], np.maximum(self.left[1], 0)[None, :])
            least, limit = self.sums * self.p / np.maximum(shared, 1.0), [m * m for m in self.limit]
        else:
            least, limit = self.sums / self.p, self.limit
        limit = [np.where(np.isneginf(m), -1.0, x * (1 + 1e-9) + 1e-9) for m, x in zip(self.limit, limit)]
        self.ahead &= least <= limit[0][:, None]
        self.back &= least <= limit[1][None, :]
        self.alive = self.ahead | self.back

    def _close(self) -> None:
        if self.kind == "euclid":
            with np.errstate(divide="ignore", invalid="ignore"):
                d = np.sqrt(np.maximum(np.rint(self.sums * 1e9) / 1e9, 0.0) * self.p / self.both)
            self.distance = np.where(self.alive & (self.both > 0), d, np.inf)
        else:
            self.distance = np.where(self.alive, self.sums / self.p, np.inf)

    def _donors(self, side: int, cb: int, asks: np.ndarray, values: np.ndarray, there: np.ndarray) -> list[np.ndarray]:
        """The k nearest donors of this block pair for every gap of the asking rows in one column block; rows by their place."""
        distance, mask = (self.distance, self.ahead) if side == 0 else (self.distance.T, self.back.T)
        inside = np.arange(self.width) * self.n_cb + cb < self.p
        found = []
        for r in np.flatnonzero(mask.any(1) | (self.asked if self.own else False)):
            gaps = np.flatnonzero(~asks[r] & inside)
            if not len(gaps):
                continue
            order = self.order[side][r]
            order = order[mask[r][order] & np.isfinite(distance[r][order])]
            has = there[np.ix_(order, gaps)]
            place = np.cumsum(has, axis=0)
            o, g = np.nonzero(has & (place <= self.k))
            if self.own:
                whole = len(order) and (place[-1] >= self.k).all()
                self.worst[r] = max(self.worst[r], distance[r][order[o]].max() if whole else np.inf)
            found.append((np.full(len(o), r), gaps[g] * self.n_cb + cb, order[o], distance[r][order[o]], values[order[o], gaps[g]]))
        kinds = (np.int64, np.int64, np.int64, float, float)
        return [np.concatenate(c).astype(t) for c, t in zip(zip(*found), kinds)] if found else [np.empty(0, t) for t in kinds]

    def end(self) -> pd.DataFrame:
        """Bounds (a block with itself) or nearest distances (Hamming), and the work done."""
        if self.distance is None:
            self._close()
        rows = [(None, WORK, None, float(self.pairs), float(self.alive.sum()))]
        if self.kind == "hamming":
            for names, d in ((self.names[0], np.where(self.ahead, self.distance, np.inf)), (self.names[1], np.where(self.back, self.distance, np.inf).T)):
                near = d.min(1, initial=np.inf)
                rows += [(names[r], BOUND, None, near[r], None) for r in np.flatnonzero(np.isfinite(near))]
        elif self.own:
            rows += [(self.names[0][r], BOUND, None, self.worst[r], None) for r in np.flatnonzero(self.asked)]
        return pd.DataFrame(rows, columns=["row", "idx", "donor", "distance", "value"])


class _Gathered:
    """What the meetings of two groups find: the nearest of a row, the k nearest donors of a gap.  Rows are numbers here, and
    whenever ``GATHERED`` more donors have come, all beyond the k nearest go and the rows' bounds become tighter."""

    def __init__(self, kind: str, p: int, k: int, heads: dict):
        self.kind, self.p, self.k = kind, p, k
        first, self.base = 0, {}
        for rb in sorted(heads):
            self.base[rb] = first
            first += len(heads[rb].ids)
        each = [heads[rb] for rb in sorted(heads)]
        self.names = np.concatenate([np.asarray(h.ids, object) for h in each])
        self.by_name = np.argsort(self.names.astype(str), kind="stable")
        self.place = np.empty(first, np.int64)
        self.place[self.by_name] = np.arange(first)
        self.wants = np.concatenate([np.asarray(h.wants, bool) for h in each])
        self.gaps = p - np.concatenate([np.asarray(h.present, np.int64) for h in each])
        self.limit = np.concatenate([np.full(len(h.ids), np.inf) if h.bound is None else np.asarray(h.bound, float) for h in each])
        self.near = np.full(first, np.inf)
        self.found, self.n, self.kept = [], 0, 0
        self.pairs = self.completed = 0.0

    def rows(self, rb: int, n: int) -> slice:
        return slice(self.base[rb], self.base[rb] + n)

    def add(self, ends: tuple[int, int], out: list | None) -> None:
        for side, (r, idx, o, distance, value) in out or ():
            if len(r):
                self.found.append(((self.base[ends[side]] + r) * self.p + idx, self.place[self.base[ends[1 - side]] + o], distance, value))
                self.n += len(r)
        if self.n > 2 * self.kept + GATHERED:
            self.settle()

    def end(self, ends: tuple[int, int], meeting: _Meeting) -> None:
        if meeting.distance is None:
            meeting._close()
        self.pairs, self.completed = self.pairs + meeting.pairs, self.completed + meeting.alive.sum()
        if self.kind == "hamming":
            for side, d in ((0, np.where(meeting.ahead, meeting.distance, np.inf)), (1, np.where(meeting.back, meeting.distance, np.inf).T)):
                at = self.rows(ends[side], len(d))
                self.near[at] = np.minimum(self.near[at], d.min(1, initial=np.inf))
                self.limit[at] = np.minimum(self.limit[at], self.near[at])
        elif meeting.own:
            at = self.rows(ends[0], meeting.n[0])
            self.limit[at] = np.where(meeting.asked, np.minimum(self.limit[at], meeting.worst), self.limit[at])

    def settle(self) -> None:
        if not self.found:
            return
        gap, donor, distance, value = (np.concatenate(c) for c in zip(*self.found))
        order = np.lexsort((donor, distance, gap))
        gap = gap[order]
        new = np.flatnonzero(np.append(True, gap[1:] != gap[:-1]))
        place = np.arange(len(gap)) - np.repeat(new, np.diff(np.append(new, len(gap))))
        near = place < self.k
        last = order[place == self.k - 1]               # of a gap with k donors, the farthest
        row = gap[place == self.k - 1] // self.p
        whole = np.bincount(row, minlength=len(self.gaps)) == self.gaps
        worst = np.full(len(self.gaps), -np.inf)
        np.maximum.at(worst, row, distance[last])
        self.limit = np.where(whole & (self.gaps > 0), np.minimum(self.limit, worst), self.limit)
        order = order[near]
        self.found = [(gap[near], donor[order], distance[order], value[order])]
        self.n = self.kept = len(order)

    def records(self, bounds: bool) -> Iterator[pd.DataFrame]:
        self.settle()
        yield pd.DataFrame([(None, WORK, None, float(self.pairs), float(self.completed))], columns=["row", "idx", "donor", "distance", "value"])
        told = self.near if self.kind == "hamming" else np.where(self.wants & bounds, self.limit, np.inf)
        at = np.flatnonzero(np.isfinite(told))
        yield pd.DataFrame({"row": self.names[at], "idx": BOUND, "donor": None, "distance": told[at], "value": np.nan})
        for gap, donor, distance, value in self.found:
            for lo in range(0, len(gap), BATCH):
                part = slice(lo, lo + BATCH)
                yield pd.DataFrame({"row": self.names[gap[part] // self.p], "idx": gap[part] % self.p, "donor": self.names[self.by_name[donor[part]]],
                                    "distance": distance[part], "value": value[part]})


def _grouped(met: Callable[[list, dict, dict], Iterator[pd.DataFrame]]):
    """Records sorted by pair of groups, step, row block and column block: the pairs of row blocks wanted, heads, tiles."""
    def run(batches):
        key, held = None, ([], {}, {})
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                if (t.gi, t.gj) != key:
                    yield from met(*held)
                    key, held = (t.gi, t.gj), ([], {}, {})
                wanted, heads, tiles = held
                if t.step < 0:
                    wanted.append((t.rb, t.cb))
                elif t.step == 0:
                    heads[t.rb] = t
                else:
                    tiles.setdefault(t.rb, []).append(t)
        yield from met(*held)
    return run


def _met_all(kind: str, p: int, n_cb: int, k: int, steps: list[int], probe: bool, bounds: bool):
    """Two groups are held as packed tiles; their row blocks meet one pair after the other, those that meet themselves first."""
    def met(wanted, heads, tiles):
        if not wanted:
            return
        got = _Gathered(kind, p, k, heads)
        for i, j in sorted(wanted, key=lambda ends: (ends[0] != ends[1], ends)):
            meeting = _Meeting(kind, p, n_cb, k, i == j)
            for side, rb in enumerate((i, j)[:1 + (i != j)]):
                meeting.take(heads[rb]._replace(side=side, bound=got.limit[got.rows(rb, len(heads[rb].ids))]))
            for step in steps:
                for t, u in zip(tiles[i], tiles[j]):
                    if not meeting.alive.any():
                        break
                    got.add((i, j), meeting.take(t._replace(step=step)))
                    if i != j:
                        got.add((i, j), meeting.take(u._replace(step=step, side=1)))
            if not probe:
                got.end((i, j), meeting)
            elif meeting.alive.any():
                yield pd.DataFrame({"i": [i], "j": [j]})
        if not probe:
            yield from got.records(bounds)
    return met


# four points as far from each other: the product of two is 3 if they are the same and else -1
_FOUR = np.array([[1, 1, 1], [1, -1, -1], [-1, 1, -1], [-1, -1, 1]], np.float32)


def _coded(data: bytes, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a tile, and per cell 0 where there is none, else one more than its number's place among them."""
    if data[0] == 2:
        return np.frombuffer(data, float, count=data[1], offset=2), np.frombuffer(data, np.uint8, offset=2 + 8 * data[1]).reshape(rows, width)
    values, there = unpack(data, rows, width)
    if data[0]:
        return np.arange(3.0), (values.astype(np.uint8) + 1) * there
    book, named = np.unique(values, return_inverse=True)
    return book, (named.reshape(rows, width) + 1) * there


def _nearest_groups(p: int, group: int):
    """As ``_met_all`` for Hamming distances in one column block, where no partial sum can stop a pair: all queries and base
    rows of two groups in a few products.  Of a pair, the columns that agree come from points for each kind of call."""
    def met(wanted, heads, tiles):
        if not wanted:
            return
        first, second = ([rb for rb in sorted(heads) if rb // group == end // group] for end in wanted[0])
        sides = [(first, second)] if first == second else [(first, second), (second, first)]
        coded = {rb: _coded(tiles[rb][0].data, len(heads[rb].ids), p) for rb in heads}
        near = {}
        for asking, giving in sides:
            asks = [(rb, np.flatnonzero(np.asarray(heads[rb].wants, bool))) for rb in asking]
            gives = [(rb, np.flatnonzero(np.asarray(heads[rb].gives, bool))) for rb in giving]
            asks, gives = ([(rb, at) for rb, at in x if len(at)] for x in (asks, gives))
            if not asks or not gives:
                continue
            met = [np.unique(np.concatenate([coded[rb][0][np.flatnonzero(np.bincount(coded[rb][1][at].reshape(-1), minlength=len(coded[rb][0]) + 1)[1:])] for rb, at in x]))
                   for x in (asks, gives)]
            kinds = np.intersect1d(*met)
            four = len(kinds) < 4 and min(len(m) for m in met) == len(kinds)      # one side has no other calls than these
            points = _FOUR if four else np.eye(len(kinds) + 1, dtype=np.float32)

            def placed(rb, at):
                """A point per cell, none where the other side has no such call, and how many cells have one."""
                book, codes = coded[rb]
                table = np.zeros((len(book) + 1, points.shape[1]), np.float32)
                table[0] = points[0]
                known = np.isin(book, kinds)
                table[1:][known] = points[1 + np.searchsorted(kinds, book[known])]
                codes = codes[at]
                return table[codes].reshape(len(at), -1), np.append(True, known)[codes].sum(1)

            for lo in range(0, len(gives), TOGETHER):
                base, told = (np.concatenate(x) for x in zip(*[placed(rb, at) for rb, at in gives[lo:lo + TOGETHER]]))
                for rb, at in asks:
                    query, said = placed(rb, at)
                    same = query @ base.T
                    if four:                        # 3 for each cell that agrees, -1 for each other that both have
                        same += (told - p).astype(np.float32)
                        most = (same.max(1).astype(np.float64) + said) / 4
                    else:
                        most = same.max(1).astype(np.float64)
                    near.setdefault(rb, np.full(len(heads[rb].ids), np.inf))
                    near[rb][at] = np.minimum(near[rb][at], (p - most) / p)
        for rb, d in near.items():
            at = np.flatnonzero(np.isfinite(d))
            yield pd.DataFrame({"row": np.asarray(heads[rb].ids, object)[at], "idx": BOUND, "donor": None, "distance": d[at], "value": np.nan})
    return _grouped(met)


def _meet(kind: str, p: int, n_cb: int, k: int, probe: bool):
    """Records sorted by block pair, step, column block and side; one block pair is held at a time."""
    def run(batches):
        key = meeting = None
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                if (t.i, t.j) != key:
                    if meeting is not None:
                        yield from done(key, meeting)
                    key, meeting = (t.i, t.j), _Meeting(kind, p, n_cb, k, t.i == t.j)
                yield from meeting.named(meeting.take(t))
        if meeting is not None:
            yield from done(key, meeting)

    def done(key, meeting):
        if not probe:
            yield meeting.end()
        elif meeting.alive.any():
            yield pd.DataFrame({"i": [key[0]], "j": [key[1]]})
    return run


def _likeness(probe: DataFrame, width: int) -> DataFrame:
    """(row, cell): the nearest of some rows picked by hash, over one column block."""
    picked = probe.orderBy(F.xxhash64("row"), "row").select("pos", "val").limit(PIVOTS).collect()      # PIVOTS x COLS numbers at most

    def widen(rows):
        out = np.full((len(rows), width), np.nan)
        for r, (pos, val) in enumerate(rows):
            out[r, np.asarray(pos, int)] = np.asarray(val, float)
        there = ~np.isnan(out)
        return np.where(there, out, 0.0), there

    pivots = widen([(r.pos, r.val) for r in picked])

    def nearest(batches):
        for pdf in batches:
            sq, both = _squares(*widen(list(zip(pdf["pos"], pdf["val"]))), *pivots)
            yield pd.DataFrame({"row": pdf["row"], "cell": np.where(both > 0, sq / np.maximum(both, 1), np.inf).argmin(1).astype("int64") if len(pdf) else []})

    return probe.select("row", "pos", "val").mapInPandas(nearest, "row string, cell long")


class _Laid:
    """A table of cells (row, idx, val) as tiles, and the passes over it."""

    def __init__(self, cells: DataFrame, p: int, kind: str, k: int, wants: Column, gives: Column):
        self.spark, self.p, self.kind, self.k = cells.sparkSession, p, kind, k
        self.n_cb = max(1, math.ceil(p / COLS))
        width = math.ceil(p / self.n_cb)
        at = cells.select("row", F.expr(f"cast(idx % {self.n_cb} AS bigint)").alias("cb"),
                          F.struct(F.expr(f"cast(idx div {self.n_cb} AS int)").alias("pos"), F.col("val").cast("double").alias("val")).alias("_c"))
        pieces = cut_lineage(at.groupBy("row", "cb").agg(F.collect_list("_c").alias("_c")).select(
            "row", "cb", F.col("_c.pos").alias("pos"), F.col("_c.val").alias("val")))
        totals = pieces.groupBy("row").agg(F.sum(F.size("pos")).alias("present"))
        cell = _likeness(pieces.where(F.col("cb") == 0), width)
        laid = totals.join(cell, "row", "left").withColumn("cell", F.coalesce("cell", F.lit(-1)))
        order = cut_lineage(ranked(laid, ["cell", F.xxhash64("row"), "row"], name="_r"))
        n = order.count()
        size = max(1, min(ROWS, math.ceil(n / LEAST_BLOCKS)))
        self.n_rb, p, n_cb = math.ceil(n / size), self.p, self.n_cb
        self.roster = order.select("row", "present", wants.alias("wants"), gives.alias("gives"),
                                   F.expr(f"(_r - 1) div {size}").alias("rb"), F.expr(f"cast((_r - 1) % {size} AS int)").alias("slot"))
        whole = self.spark.range(self.n_rb).withColumnRenamed("id", "rb").withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_cb - 1)).cast("array<bigint>")))
        filled = pieces.join(measured(self.roster.select("row", "rb", "slot")), "row").groupBy("rb", "cb").agg(
            F.collect_list(F.struct("slot", "pos", "val")).alias("_v"))
        filled = whole.join(filled, ["rb", "cb"], "left").select("rb", "cb", F.col("_v.slot").alias("slot"), F.col("_v.pos").alias("pos"), F.col("_v.val").alias("val"))

        def tile(batches):
            for pdf in batches:
                data = []
                for t in pdf.itertuples(index=False):
                    block = np.full((min(size, n - t.rb * size), width), np.nan)
                    for slot, pos, val in zip(*(() if c is None else c for c in (t.slot, t.pos, t.val))):
                        block[slot, np.asarray(pos, int)] = np.asarray(val, float)
                    data.append(pack(block))
                yield pd.DataFrame({"rb": pdf["rb"], "cb": pdf["cb"], "data": data})

        self.tiles = cut_lineage(filled.mapInPandas(tile, "rb long, cb long, data binary"))
        largest = self.tiles.agg(F.max(F.length("data")).alias("n")).first().n or 1
        self.group = max(1, min(math.ceil(self.n_rb / SIDES), HELD // (n_cb * largest)))

    def _heads(self, bounds: DataFrame | None) -> DataFrame:
        rows = self.roster.withColumn("bound", F.lit(None).cast("double"))
        if bounds is not None:                  # a row without a bound may still be given any distance
            rows = self.roster.join(bounds.select("row", F.col("distance").alias("bound")), "row", "left").withColumn(
                "bound", F.coalesce("bound", F.lit(float("inf"))))
        inner = F.sort_array(F.collect_list(F.struct("slot", F.col("row").alias("ids"), "present", "wants", "gives", "bound")))
        bound = F.col("_h.bound") if bounds is not None else F.lit(None).cast("array<double>")
        return rows.groupBy("rb").agg(inner.alias("_h")).select("rb", *[F.col(f"_h.{c}").alias(c) for c in _HEAD[:4]], bound.alias("bound"))

    def _sent(self, pairs: DataFrame, heads: DataFrame, tiles: DataFrame, steps: list[int]) -> DataFrame:
        """Heads and tiles of both blocks of each pair (i, j), one side only where a block meets itself."""
        none = [F.lit(None).cast(heads.schema[c].dataType).alias(c) for c in _HEAD]
        body = tiles.select("rb", F.explode(F.array(*[F.lit(s) for s in steps])).alias("step"), "cb", "data", *none).unionByName(
            heads.select("rb", F.lit(0).alias("step"), F.lit(0).cast("long").alias("cb"), F.lit(None).cast("binary").alias("data"), *_HEAD))
        low = pairs.select("i", "j", F.col("i").alias("rb")).join(body, "rb").withColumn("side", F.lit(0))
        high = pairs.where("i < j").select("i", "j", F.col("j").alias("rb")).join(body, "rb").withColumn("side", F.lit(1))
        return low.unionByName(high).drop("rb")

    def _sent_groups(self, pairs: DataFrame, heads: DataFrame, tiles: DataFrame) -> DataFrame:
        """Heads and tiles of both groups of each pair of groups, once, and the pairs of row blocks that are to meet there."""
        def group(name):
            return F.expr(f"{name} div {self.group}")

        none = [F.lit(None).cast(heads.schema[c].dataType).alias(c) for c in _HEAD]
        no_data = F.lit(None).cast("binary").alias("data")
        body = tiles.select(group("rb").alias("g"), F.lit(1).alias("step"), "rb", "cb", "data", *none).unionByName(
            heads.select(group("rb").alias("g"), F.lit(0).alias("step"), "rb", F.lit(0).cast("long").alias("cb"), no_data, *_HEAD))
        wanted = pairs.select(group("i").alias("gi"), group("j").alias("gj"), F.lit(-1).alias("step"),
                              F.col("i").alias("rb"), F.col("j").alias("cb"), no_data, *none)
        groups = wanted.select("gi", "gj").distinct()
        low = groups.withColumn("g", F.col("gi")).join(body, "g").drop("g")
        high = groups.where("gi < gj").withColumn("g", F.col("gj")).join(body, "g").drop("g")
        return wanted.unionByName(low).unionByName(high).withColumn("side", F.lit(0))

    def _meetings(self, pairs: DataFrame, heads: DataFrame, tiles: DataFrame, steps: list[int], n: int, probe: bool = False, bounds: bool = False) -> DataFrame:
        if self.group == 1:
            return self._run(self._sent(pairs, heads, tiles, steps), n, probe)
        return self._run_groups(pairs, heads, tiles, n, _grouped(_met_all(self.kind, self.p, self.n_cb, self.k, steps, probe, bounds)), "i long, j long" if probe else _FOUND)

    def _run_groups(self, pairs: DataFrame, heads: DataFrame, tiles: DataFrame, n: int, kernel, schema: str) -> DataFrame:
        sides = math.ceil(self.n_rb / self.group)
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), min(n, sides * (sides + 1) // 2) // 2)
        dealt = self._sent_groups(pairs, heads, tiles).repartition(parts, "gi", "gj").sortWithinPartitions("gi", "gj", "step", "rb", "cb")
        return cut_lineage(dealt.mapInPandas(kernel, schema))

    def _run(self, sent: DataFrame, meetings: int, probe: bool = False) -> DataFrame:
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), min(meetings // 4, 20_000))
        dealt = sent.repartition(parts, "i", "j").sortWithinPartitions("i", "j", "step", "cb", "side")
        return cut_lineage(dealt.mapInPandas(_meet(self.kind, self.p, self.n_cb, self.k, probe), "i long, j long" if probe else _FOUND))

    def found(self) -> DataFrame:
        steps = [1, 2] if self.kind == "euclid" else [1]
        if self.kind == "hamming" and self.n_cb == 1:
            groups = math.ceil(self.n_rb / self.group)          # a group is named by its first row block
            pairs = self.spark.range(groups).select((F.col("id") * self.group).alias("i"), F.explode(F.sequence("id", F.lit(groups - 1).cast("long"))).alias("_h"))
            return self._run_groups(pairs.select("i", (F.col("_h") * self.group).alias("j")), self._heads(None), self.tiles, groups * groups, _nearest_groups(self.p, self.group), _FOUND)
        blocks = self.spark.range(self.n_rb).select(F.col("id").alias("i"), F.expr(f"least((id div {self.group} + 1) * {self.group}, {self.n_rb}) - 1").alias("_last"))
        blocks = blocks.select("i", F.explode(F.sequence("i", "_last")).alias("j"))             # every group meets itself
        first = self._meetings(blocks, self._heads(None), self.tiles, steps, self.n_rb, bounds=True)
        if self.n_rb <= self.group:
            return first
        heads = cut_lineage(self._heads(first.where(F.col("idx") == BOUND)))
        pairs = self.spark.range(self.n_rb - 1).select(F.col("id").alias("i")).withColumn(
            "j", F.explode(F.sequence(F.col("i") + 1, F.lit(self.n_rb - 1).cast("long"))))
        pairs = pairs.where(F.expr(f"i div {self.group} < j div {self.group}"))
        meetings = self.n_rb * (self.n_rb - 1) // 2
        if self.n_cb > 1:
            tried = self.tiles.where(F.col("cb") < math.ceil(self.n_cb / PROBE))
            pairs = self._meetings(pairs, heads, tried, [1], meetings, probe=True)
            meetings = pairs.count()
        return first.unionByName(self._meetings(pairs, heads, self.tiles, steps, meetings))


def knn_search(cells: DataFrame, p: int, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(sample_id, idx, donor, distance, value), the k nearest donors of every missing cell, and (pairs, completed), the work.

    ``cells(sample_id, idx, val)``: the known cells of a table with ``p`` columns, at most one each.  The distance is Euclidean
    over columns present on both sides, scaled by p / present; ties go by the donor's name.  ``completed`` counts the pairs of
    samples (ordered ones inside a row block) whose distance was summed to the end.
    """
    known = cells.select(F.col("sample_id").alias("row"), "idx", "val")
    found = _Laid(known, p, "euclid", k, F.col("present") < p, F.lit(True)).found()
    w = W.partitionBy("row", "idx").orderBy("distance", "donor")         # k rows per row block that could matter
    donors = found.where(F.col("idx") >= 0).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    work = found.where(F.col("idx") == WORK).agg(F.sum("distance").alias("pairs"), F.sum("value").alias("completed"))
    return donors.select(F.col("row").alias("sample_id"), "idx", "donor", "distance", "value"), work


def nearest_mismatch(queries: DataFrame, base: DataFrame, p: int) -> DataFrame:
    """(sample_id, distance): for each query row the least share of the ``p`` columns in which a base row differs.

    Both are known cells (sample_id, idx, val); a cell missing on one side differs, on both sides it agrees.  Queries and base
    rows that are alike lie in the same row blocks, so that the first pass bounds most queries.
    """
    def named(df, mark):
        return df.select(F.concat(F.lit(mark), "sample_id").alias("row"), "idx", "val")

    both = named(queries, "q").unionByName(named(base, "b"))
    found = _Laid(both, p, "hamming", 1, F.startswith("row", F.lit("q")), F.startswith("row", F.lit("b"))).found()
    near = found.where(F.col("idx") == BOUND).groupBy("row").agg(F.min("distance").alias("distance"))
    return near.select(F.expr("substring(row, 2)").alias("sample_id"), "distance")
