"""N-gram Jaccard join (operator 3): rare-first prefix filtering, exact.

Two documents link when the Jaccard similarity of their sets of 5-word shingles reaches 75 %.

1. Each document is read once.  Its shingles go to hash buckets whose number grows with the corpus; there the
   document frequency of every shingle is counted over distinct sets (equal sets are one *class*).
2. Shingles that occur in one class only cannot be shared, so only the others travel on, with their frequency.  Ordered
   rarest first, a set of n shingles must share one of its first ``n - ceil(0.75 n) + 1`` with any partner: a class
   with that many shingles of its own has no partner and is done.  The rest of the classes keep the shared part of
   their prefix, with positions.
3. Classes are put in blocks of bounded size, so that near copies share few blocks: by one MinHash over the shingles whose
   frequency is about the median of the class, split when large.  A posting list of a prefix shingle tells which blocks
   its classes must meet; no pair is ever written out.
4. For each pair of blocks that meet, one task joins their classes on prefix shingles under the length, positional and
   suffix filters, and verifies a pair at most once - not at all when the two are connected already.  It returns the
   links of a spanning forest.
5. Components of the links, then every document gets its class's component.

The suffix filter splits the shingles of two sets by fixed pivots of their hash and adds up the smaller sizes: no
overlap can be larger.  Shingles are 64-bit hashes (``common.shingle_hashes``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortframe.llm.common import begin, byte_parts, cut_lineage, give_back, shingle_hashes, sized, stored, texts_by_id, with_long_id, words
from cohortframe.llm.graph import components

PER_BUCKET = 6 << 20        # bytes of text whose shingles one bucket holds, about a million
FLUSH = 1_000_000           # shingles a task holds before it hands them on
BLOCK = 1 << 18             # shingles of a block of classes
LISTS = 200_000             # postings a task reads at once
PIVOTS = 16                 # parts of the suffix filter
NUM, DEN = 75, 100          # the threshold

_SETS = "bucket int, doc_id string, mark long, class long, n long, classes binary, sizes binary, counts binary, shingles binary"
_SHARED = "doc_id string, mark long, class long, n long, part int, classes binary, sizes binary, counts binary, shingles binary, df binary"


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges start .. start + size - 1, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _cut(order_by: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(order_by, kind="stable")
    at = np.searchsorted(order_by[order], np.arange(parts + 1, dtype=order_by.dtype))
    for p in np.flatnonzero(np.diff(at)).tolist():
        yield p, order[at[p]:at[p + 1]]


def _sets(docs: DataFrame, buckets: int) -> DataFrame:
    """A row per document (class and set size) and, per bucket, the shingles of the classes a task met first."""
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin("jaccard")
        met: set[int] = set()
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> pd.DataFrame:
            of = np.repeat(np.arange(len(held)), [len(s) for _, s in held])
            names, sizes = np.array([c for c, _ in held], np.int64), np.array([len(s) for _, s in held], "<u4")
            shingles = np.concatenate([s for _, s in held])
            out = []
            for b, at in _cut((shingles >> np.uint64(24)) % np.uint64(buckets), buckets):
                own, counts = np.unique(of[at], return_counts=True)
                out.append((b, names[own].tobytes(), sizes[own].tobytes(), counts.astype("<u4").tobytes(), shingles[at].tobytes()))
            return pd.DataFrame(out, columns=["bucket", "classes", "sizes", "counts", "shingles"]).assign(
                doc_id=None, mark=0, **{"class": 0}, n=0)[_names(_SETS)]

        for frame in frames:
            names: list[int] = []
            sizes: list[int] = []
            for text in frame["text"]:
                found = shingle_hashes(words(text))
                name = 0
                if len(found):
                    name = xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)
                    if name not in met:
                        met.add(name)
                        held.append((name, found))
                        size += len(found)
                names.append(name)
                sizes.append(len(found))
                if size >= FLUSH:
                    yield flush()
                    held.clear()
                    size = 0
            yield pd.DataFrame({"bucket": -1 - frame["mark"] % buckets, "doc_id": frame["doc_id"], "mark": frame["mark"],
                                "class": names, "n": sizes}).assign(classes=None, sizes=None, counts=None, shingles=None)
        if held:
            yield flush()
        held.clear()
        give_back()

    return texts_by_id(docs, _mark().alias("mark")).mapInPandas(read, _SETS)


def _mark() -> Column:
    """With the doc_id it tells a row from others that may bear the same id."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _load(frame: pd.DataFrame, column: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, kind) for b in frame[column]])


def _classes(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, set sizes and numbers of shingles sent, of all classes of a bucket or part."""
    return _load(frame, "classes", np.int64), _load(frame, "sizes", "<u4").astype(np.int64), _load(frame, "counts", "<u4").astype(np.int64)


def _shared(frame: pd.DataFrame, parts: int) -> pd.DataFrame:
    """Of a bucket: its shingles that occur in two classes or more, with their document frequency, by part of classes."""
    give_back()
    empty = pd.DataFrame(columns=_names(_SHARED))
    if frame["bucket"].iloc[0] < 0:
        return frame[["doc_id", "mark", "class", "n"]].assign(part=None, classes=None, sizes=None, counts=None, shingles=None, df=None)[_names(_SHARED)]
    names, sizes, counts = _classes(frame)
    shingles = _load(frame, "shingles", np.uint64)
    first = np.unique(names, return_index=True)[1]           # a class that several tasks met counts once
    starts = (np.cumsum(counts) - counts)[first]
    names, sizes, counts = names[first], sizes[first], counts[first]
    shingles = shingles[_ranges(starts, counts)]
    order = np.argsort(shingles)
    ranked = shingles[order]
    new = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    size = np.diff(np.append(new, len(ranked)))
    several = size > 1
    at = np.sort(order[_ranges(new[several], size[several])])              # the shingles met twice or more, class by class
    if not len(at):
        return empty
    df = np.empty(len(shingles), np.int64)
    df[order] = np.repeat(size, size)
    of, shingles, df = np.searchsorted(np.cumsum(counts), at, "right"), shingles[at], df[at]
    out = []
    for p, at in _cut((names[of].view(np.uint64) >> np.uint64(8)) % np.uint64(parts), parts):
        own, n = np.unique(of[at], return_counts=True)
        out.append((p, names[own].tobytes(), sizes[own].astype("<u4").tobytes(), n.astype("<u4").tobytes(), shingles[at].tobytes(), df[at].astype("<u4").tobytes()))
    got = pd.DataFrame(out, columns=["part", "classes", "sizes", "counts", "shingles", "df"])
    return got.assign(doc_id=None, mark=0, **{"class": 0}, n=0)[_names(_SHARED)]


def prefix_size(n: np.ndarray) -> np.ndarray:
    """How many of the rarest shingles of a set of n one of a partner's must be among."""
    return n - -(-NUM * n // DEN) + 1


def _prefixes(frame: pd.DataFrame) -> pd.DataFrame:
    """The classes of a part that may have a partner, with the shared part of their prefix, rarest first."""
    give_back()
    names, sizes, counts = _classes(frame)
    shingles, df = _load(frame, "shingles", np.uint64), _load(frame, "df", "<u4")
    name, of = np.unique(names, return_inverse=True)
    of = np.repeat(of, counts)
    n = np.zeros(len(name), np.int64)
    n[np.searchsorted(name, names)] = sizes
    shared = np.bincount(of, minlength=len(name))
    alive = n - shared < prefix_size(n)
    keep = alive[of]
    of, shingles, df = of[keep], shingles[keep], df[keep]
    order = np.lexsort((shingles, df, of))
    of, shingles, df = of[order], shingles[order], df[order].astype(np.int64)
    stops = np.searchsorted(of, np.arange(len(name)), "right")
    rows = []
    for c in np.flatnonzero(alive).tolist():
        own, often = shingles[stops[c] - shared[c]:stops[c]], df[stops[c] - shared[c]:stops[c]]
        usual = often[len(often) // 2]                     # of the shingles its near copies have: neither chance finds nor boilerplate
        kin = own[(2 * often >= usual) & (often <= 2 * usual)]
        single = n[c] - shared[c]
        rare = own[:int(prefix_size(n[c:c + 1])[0] - single)]
        rows.append((int(name[c]), int(n[c]), int(single), int(kin.min().view(np.int64)), rare.view(np.int64), np.sort(own).tobytes()))
    return pd.DataFrame(rows, columns=["class", "n", "single", "key", "prefix", "shared"])


def _meetings(posted: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
    """Per class of some posting lists: the blocks it shares a prefix shingle with, set sizes permitting.

    ``cells`` has a row per list and block: how many classes, their smallest and largest set.
    """
    token, name, block, n = (posted[c].to_numpy(np.int64) for c in ("token", "class", "block", "n"))
    cells = cells.sort_values("cell")
    cell, other, low, high, size = (cells[c].to_numpy(np.int64) for c in ("cell", "other", "low", "high", "size"))
    start = np.searchsorted(cell, token, "left")
    width = np.searchsorted(cell, token, "right") - start
    found = []
    for lo in range(0, len(token), 50_000):                  # rows are widened by the blocks of their list
        s = slice(lo, lo + 50_000)
        row = np.repeat(np.arange(lo, lo + len(token[s])), width[s])
        c = _ranges(start[s], width[s])
        fits = (high[c] * DEN >= n[row] * NUM) & (low[c] * NUM <= n[row] * DEN) & ((other[c] != block[row]) | (size[c] > 1))
        found.append(np.unique(np.stack([name[row[fits]], other[c[fits]]], 1), axis=0))
    pair = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    names, first = np.unique(pair[:, 0], return_index=True)
    return pd.DataFrame({"class": names, "others": pd.Series(np.split(pair[:, 1], first[1:]) if len(names) else [], dtype=object)})


def join_blocks(n: np.ndarray, single: np.ndarray, side: np.ndarray, cross: bool, prefixes: list[np.ndarray], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links of a spanning forest among classes of one block, or between two blocks (``cross``: of different ``side``)."""
    order = np.argsort(n, kind="stable")
    n, single, side = n[order], single[order], side[order]
    prefixes, sets = [prefixes[i] for i in order], [sets[i] for i in order]
    sizes = np.array([len(p) for p in prefixes])
    owner = np.repeat(np.arange(len(n)), sizes)
    token = np.concatenate(prefixes)
    position = np.concatenate([np.arange(k) for k in sizes]) + single[owner]     # rank in the whole set, rarest first
    by = np.lexsort((owner, token))
    token, of, at = token[by], owner[by], position[by]
    flat = np.concatenate(sets)
    length = np.array([len(s) for s in sets])
    begin = np.cumsum(length) - length
    pivot = np.zeros((len(n), PIVOTS), np.int32)
    np.add.at(pivot, (np.repeat(np.arange(len(n)), length), (flat >> np.uint64(60)).astype(np.int64)), 1)
    parent = np.arange(len(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for a in range(len(n)):
        lo, hi = np.searchsorted(token, prefixes[a], "left"), np.searchsorted(token, prefixes[a], "right")
        near = _ranges(lo, hi - lo)
        mine = np.repeat(np.arange(sizes[a]) + single[a], hi - lo)
        ok = (of[near] < a) & (n[of[near]] * DEN >= n[a] * NUM)                  # length filter; smaller sets come first
        if cross:
            ok &= side[of[near]] != side[a]
        near, mine = near[ok], mine[ok]
        if not len(near):
            continue
        b, at_first = np.unique(of[near], return_index=True)                     # the rarest common shingle comes first
        need = -(-NUM * (n[a] + n[b]) // (NUM + DEN))
        most = np.minimum(n[a] - mine[at_first], n[b] - at[near[at_first]])       # positional filter
        b, need = b[most >= need], need[most >= need]
        fits = np.minimum(pivot[b], pivot[a]).sum(1) >= need                     # suffix filter
        b, need = b[fits], need[fits]
        roots = np.array([root(i) for i in b.tolist()], np.int64)
        # one of each component first: when it links, the others need no look
        lead = np.unique(roots, return_index=True)[1]
        for pick in (lead, np.setdiff1d(np.arange(len(b)), lead)):
            pick = pick[[root(i) != root(a) for i in b[pick].tolist()]] if len(pick) else pick
            if not len(pick):
                continue
            c = b[pick]
            other = flat[_ranges(begin[c], length[c])]
            spot = np.minimum(np.searchsorted(sets[a], other), len(sets[a]) - 1)
            overlap = np.add.reduceat((sets[a][spot] == other).astype(np.int64), np.cumsum(length[c]) - length[c])
            for i in c[overlap >= need[pick]].tolist():
                x, y = root(i), root(a)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    links.append((int(order[i]), int(order[a])))
    return links


def _joined(frame: pd.DataFrame) -> pd.DataFrame:
    """All block pairs that share this slot."""
    give_back()
    out = []
    for (low, high), rows in frame.groupby(["low", "high"], sort=False):
        names = rows["class"].to_numpy(np.int64)
        if len(names) > 1:
            links = join_blocks(rows["n"].to_numpy(np.int64), rows["single"].to_numpy(np.int64), rows["block"].to_numpy(np.int64), low != high,
                                [np.asarray(p, np.int64).view(np.uint64) for p in rows["prefix"]], [np.frombuffer(s, np.uint64) for s in rows["shared"]])
            out += [(names[i], names[j]) for i, j in links]
    return pd.DataFrame(out, columns=["u", "v"], dtype=np.int64)


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, mark, class, n`` per input row; links ``u, v`` between classes, enough to connect each component)."""
    buckets = byte_parts(docs, PER_BUCKET)
    shared = stored(_sets(docs, buckets).groupBy("bucket").applyInPandas(lambda f: _shared(f, buckets), _SHARED), "shingles")
    members = with_long_id(shared.where("part IS NULL")).select("doc_id", "mark", F.when(F.col("n") > 0, F.col("class")).alias("class"), "n")
    classes = stored(shared.where("part IS NOT NULL").groupBy("part").applyInPandas(
        _prefixes, "class long, n long, single long, key long, prefix array<long>, shared binary"), "classes")
    # blocks: classes of one MinHash, split by hash so that a block has some BLOCK shingles
    load = classes.groupBy("key").agg(F.ceil(F.sum("n") / BLOCK).alias("splits"))
    blocks = cut_lineage(classes.select("class", "n", "key").join(load, "key").select(
        "class", F.xxhash64("key", F.pmod(F.xxhash64("class"), "splits")).alias("block")))
    size = classes.agg(F.sum(F.size("prefix")).alias("postings"), F.sum("n").alias("shingles"), F.count(F.lit(1)).alias("classes")).first()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = max(1, -(-(size["postings"] or 0) // LISTS))         # few: a class is told a block once by each
    posted = classes.join(blocks, "class").select("class", "n", "block", F.explode("prefix").alias("token"))
    # a long posting list is dealt to several tasks; each gets the list's cells, which are counted before the shuffle
    cells = cut_lineage(posted.groupBy("token", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("size")))
    long = sized(cells.groupBy("token").agg(F.ceil(F.sum("size") / LISTS).cast("int").alias("deals")).where("deals > 1"))
    spot = F.pmod(F.xxhash64("token"), F.lit(lists)).alias("list")
    posted = posted.join(long, "token", "left").select(spot, F.when(F.col("deals") > 1, F.pmod(F.xxhash64("class"), "deals")).otherwise(0).cast("int").alias("deal"),
                                                       "token", "class", "block", "n")
    cells = cells.join(long, "token", "left").select(
        spot.alias("in_list"), F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1)).alias("in_deal"),
        F.col("token").alias("cell"), F.col("block").alias("other"), "low", "high", "size")
    met = posted.groupBy("list", "deal").cogroup(cells.groupBy("in_list", "in_deal")).applyInPandas(_meetings, "class long, others array<long>")
    pairs = cut_lineage(met.select("class", F.explode("others").alias("other")).join(blocks, "class")
                        .select("class", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).distinct())
    moved = (size["shingles"] or 0) * pairs.count() // max(1, size["classes"])
    slots = max(parts, -(-moved // (4 * BLOCK)))
    both = pairs.join(classes.select("class", "n", "single", "prefix", "shared"), "class").withColumn("slot", F.pmod(F.xxhash64("low", "high"), F.lit(slots)))
    return members, both.groupBy("slot").applyInPandas(_joined, "u long, v long")


def _labelled(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, n, label`` per input row; the label of rows without words is null."""
    members, links = linked(docs)
    label = components(links)
    return members.join(label.select(F.col("node").alias("class"), "label"), "class", "left").select(
        "doc_id", "mark", "n", F.coalesce("label", "class").alias("label"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    A text without words (or null) has no shingle and is its own component; a shorter text than five words is one
    shingle.  ``component_id`` is the smallest non-null doc_id of the component (null if there is none).  Rows that
    repeat are members like any other; extra columns are ignored.
    """
    rows = _labelled(docs)
    whole = rows.where("label IS NOT NULL")
    least = whole.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found = whole.join(least, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return found.unionByName(rows.where("label IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each component the one with the smallest doc_id.

    Rows without words stay.  Rows that repeat both the id and the text of the one that stays are the same document and
    stay with it; a component without any doc_id keeps one text.
    """
    rows = stored(_labelled(docs).where("label IS NOT NULL"), "labels")
    first = F.min_by(F.struct("doc_id", "mark"), F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("first")
    drop = rows.join(rows.groupBy("label").agg(first), "label").where(~F.struct("doc_id", "mark").eqNullSafe(F.col("first"))).select(
        F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    drop = sized(cut_lineage(drop))
    same_text = F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == drop["_mark"]
    return docs.join(drop, docs["doc_id"].eqNullSafe(drop["_id"]) & same_text, "left_anti")


ORACLE = r"""
WITH RECURSIVE dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'),
  lambda x: x <> '') AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s
  FROM dw WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM ds GROUP BY 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM ds a JOIN ds b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 75 * (x.n + y.n - i)),
b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach AS (SELECT DISTINCT u AS node, u AS label FROM b UNION SELECT b.v, reach.label FROM reach JOIN b ON b.u = reach.node),
c AS (SELECT node, min(label) AS label FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(c.label, d.doc_id), d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""
