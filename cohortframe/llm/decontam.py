"""Benchmark decontamination (operator 4): size-partitioned MinHash containment search, DataFrame functions only.

An item leaks into a document when at least ``threshold`` of the item's distinct 5-word shingles occur in it.  Jaccard
sketches of whole documents are useless for that, because the document may be a thousand times longer.  So:

* items are partitioned by the power of two of their shingle count; each partition has a MinHash depth, one more than
  the number of shingles its largest item may miss, so an item that is contained shares a MinHash value for certain;
* documents are partitioned by size as well; a document looks only for items it is large enough to contain, and
  sketches itself by the hashes below the largest MinHash value of those items (a coordinated sample: the smaller the
  bound, the smaller the sketch);
* equal values make candidates, and every candidate (document, item) is verified once on the shingles themselves.

Words are lower-cased ``[^\\x20\\x09-\\x0D]+``.  An item of one to four words has its whole sequence of words as its one
shingle; it is looked up among the documents' runs of as many words.  Items and documents without words match nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortframe.llm.common import WS, cut_lineage, sized

SHINGLE = 5
THRESHOLD = 0.75


def _words(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WS), "")


def _shingles(words: str, make, length: int = SHINGLE) -> Column:
    """``make`` of every run of so many words; no run, no array."""
    starts = F.sequence(F.lit(0), F.size(words) - length)
    runs = F.transform(starts, lambda i: make([F.get(F.col(words), i + k) for k in range(length)]))
    return F.when(F.size(words) >= length, runs)


def _hash(parts: list[Column]) -> Column:
    return F.xxhash64(*parts)


def _text(parts: list[Column]) -> Column:
    return F.concat_ws(" ", *parts)


def _size_class(n: Column) -> Column:
    return F.floor(F.log2(n)).cast("int")


def _short_leaks(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """The same for items of fewer than five words; None without such items.  Only runs of lengths that items have are made."""
    short = cut_lineage(items.select("item_id", _words("text").alias("w")).where((F.size("w") >= 1) & (F.size("w") < SHINGLE)).select(
        "item_id", F.size("w").alias("length"), F.array_join("w", " ").alias("said")))
    lengths = sorted(r["length"] for r in short.select("length").distinct().collect())        # 1 to 4
    if not lengths:
        return None
    worded = docs.select("doc_id", _words("text").alias("w"))
    met = None
    for n in lengths:
        runs = worded.select("doc_id", F.explode(F.array_distinct(_shingles("w", _text, n))).alias("said"))
        own = runs.join(sized(short.where(F.col("length") == n).select("item_id", "said")), "said").select("doc_id", "item_id")
        met = own if met is None else met.unionByName(own)
    one = F.lit(1).cast("long")
    return met.distinct().select("doc_id", "item_id", one.alias("item_shingles"), one.alias("shared_shingles"))


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, item_id, item_shingles, shared_shingles``: every document that contains an item.

    Rows that repeat a doc_id (or item_id) are searched one by one and reported once, with the fullest match; a null id
    is an id like any other.  Null and empty texts match nothing, extra columns are ignored.
    """
    long, short = _long_leaks(docs, items, threshold), _short_leaks(docs, items)
    return long if short is None else _best(long.unionByName(short))


def _best(found: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("item_shingles", "shared_shingles"), F.col("shared_shingles") / F.col("item_shingles"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def _long_leaks(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    grams = (items.select("item_id", _words("text").alias("w")).where(F.size("w") >= SHINGLE)
             .select("item_id", F.array_distinct(_shingles("w", _text)).alias("s"), F.array_sort(F.array_distinct(_shingles("w", _hash))).alias("h"))
             .withColumn("part", _size_class(F.size("h"))))
    depth = grams.groupBy("part").agg((F.floor(F.max(F.size("h")) * F.lit(1 - threshold) + 1e-9) + 1).cast("int").alias("depth"))
    sketch = cut_lineage(grams.join(depth, "part").select("item_id", "part", "s", F.slice("h", F.lit(1), F.col("depth")).alias("h")))
    # a row per size class of items: at most 31
    bounds = sketch.groupBy("part").agg(F.max(F.element_at("h", -1)).alias("top")).collect()
    if not bounds:
        return docs.select("doc_id").join(items.select("item_id"), F.lit(False)).select(
            "doc_id", "item_id", F.lit(0).cast("long").alias("item_shingles"), F.lit(0).cast("long").alias("shared_shingles"))
    values = sized(sketch.select("item_id", "part", F.explode("h").alias("hash")))

    worded = docs.select("doc_id", _words("text").alias("w"))
    top = None
    for b in sorted(bounds, key=lambda r: r["top"], reverse=True):      # the largest bound a document of this size needs
        enough = math.ceil(threshold * 2 ** b["part"] - 1e-9)
        case = F.size("w") - (SHINGLE - 1) >= enough
        top = F.when(case, F.lit(b["top"])) if top is None else top.when(case, F.lit(b["top"]))
    hashes = (worded.withColumn("top", top).where("top IS NOT NULL")
              .select("doc_id", "top", F.explode(_shingles("w", _hash)).alias("hash")).where("hash <= top"))
    pairs = cut_lineage(hashes.join(values, "hash").select("doc_id", "item_id").distinct())

    ids = sized(pairs.select(F.col("doc_id").alias("_id")).distinct())
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    found = texts.select("doc_id", _words("text").alias("w")).where(F.size("w") >= SHINGLE).select("doc_id", _shingles("w", _text).alias("d"))
    wanted = pairs.alias("p").join(sketch.select("item_id", "s").alias("i"), F.col("p.item_id").eqNullSafe(F.col("i.item_id"))).select(
        F.col("p.doc_id").alias("_id"), "p.item_id", "s")
    checked = (found.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")))
               .select("doc_id", "item_id", F.size("s").cast("long").alias("item_shingles"),
                       F.size(F.array_intersect("s", "d")).cast("long").alias("shared_shingles"))
               .where(F.col("shared_shingles") >= F.lit(threshold) * F.col("item_shingles")))
    return _best(checked)


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id holds no item."""
    ids = sized(cut_lineage(leaks(docs, items, threshold).select(F.col("doc_id").alias("_leaky")).distinct()))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_leaky"]), "left_anti")


ORACLE = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM dw WHERE len(w) >= 5),
its AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM iw WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS item_shingles FROM its GROUP BY item_id)
SELECT doc_id, item_id, any_value(item_shingles) AS item_shingles, count(*) AS shared_shingles
FROM ds JOIN its USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.75 * any_value(item_shingles)
UNION ALL
SELECT DISTINCT doc_id, item_id, CAST(1 AS BIGINT), CAST(1 AS BIGINT)
FROM dw JOIN iw ON len(iw.w) BETWEEN 1 AND 4 AND len(list_filter(range(1, len(dw.w) - len(iw.w) + 2), lambda i: dw.w[i:i + len(iw.w) - 1] = iw.w)) > 0
"""
