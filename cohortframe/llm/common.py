"""Reading, scratch tables and the word rule that the operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortframe.session import cut_lineage, shared_dir

WS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared folder of the cluster."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write to a fresh table in the shared folder and read it again, so that a lost executor loses nothing of it."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def normal_text(text: str | Column = "text") -> Column:
    """Null as empty, each run of ASCII white space as one space."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS, " ")


def texts_by_id(docs: DataFrame, *more: Column) -> DataFrame:
    """``doc_id`` as a string, ``more``, and ``text`` with null as empty, for tasks in Python.

    pandas has no nullable long of its own and would turn ids beside a null into floats; ``with_long_id`` turns the
    strings back.
    """
    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), *more, F.coalesce("text", F.lit("")).alias("text"))


def with_long_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def crc_fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def byte_parts(docs: DataFrame, per_part: int, column: str = "text") -> int:
    """How many parts of about ``per_part`` bytes of text the table has; at least the shuffle partitions."""
    size = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // per_part))


MAX_BROADCAST_ROWS = 500_000      # of a few numbers each: some 10 MB


def sized(df: DataFrame) -> DataFrame:
    """A narrow table with a broadcast hint if it is small when counted; beyond that the join shuffles both sides."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


HOT_KEYS, HOT_LEAST = 100_000, 10_000    # keys to broadcast, at most; rows that make a key hot, at least


def join_hot(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join with a table of unique ``keys`` where a key may hold any share of the left rows.

    Keys with more than a ``HOT_KEYS``-th of the left rows (so there are fewer of them than that) meet by broadcast, the
    others by a shuffle in which no key is large.  ``left`` is read three times and should be stored; null keys meet nothing.
    """
    keys = list(keys)
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    least = left.agg((F.greatest(F.lit(HOT_LEAST), F.count(F.lit(1)) / HOT_KEYS)).alias("_least")).first()["_least"]
    hot = cut_lineage(counts.where(F.col("_n") > F.lit(float(least))).select(*keys))
    if hot.isEmpty():
        return left.join(right, keys, "left")
    named = F.broadcast(hot.select(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_{k}") for k in keys]))
    met = F.lit(True)
    for k in keys:
        met &= F.coalesce(F.col(k).cast("string"), F.lit("")) == F.col(f"_{k}")
    many = left.join(named, met, "left_semi").join(F.broadcast(right.join(F.broadcast(hot), keys, "left_semi")), keys, "left")
    return many.unionByName(left.join(named, met, "left_anti").join(right, keys, "left"))


# what tasks of one operator keep in a worker for the next task, by name: how to drop it
REMEMBERED: dict[str, Callable[[], None]] = {}


def begin(owner: str) -> None:
    """At the start of an operator's task: drop what other operators' tasks have left in this reused worker."""
    for name in [n for n in REMEMBERED if n != owner]:
        REMEMBERED.pop(name)()
    give_back()


def give_back() -> None:
    """Return what earlier tasks of this reused worker have freed to the machine, which Python and Arrow do not do by themselves."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):           # another C library
        pass


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the whole text with A-Z in lower case; bytes.split() cuts at just that white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(found: list[bytes]) -> np.ndarray:
    """64-bit hash of each word; hashing anew is cheaper than looking most words up."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(found: list[bytes], size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; a shorter text is one run; no words, none."""
    h = word_hashes(found)
    if not len(h):
        return h
    if len(h) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=1)], np.uint64)
    out = h[:len(h) - size + 1].copy()
    for k in range(1, size):
        out *= _ODD
        out ^= out >> np.uint64(29)
        out += h[k:len(h) - size + 1 + k]
    out ^= out >> np.uint64(32)
    out *= _ODD
    out ^= out >> np.uint64(29)
    return np.unique(out)


__all__ = ["REMEMBERED", "WS", "begin", "byte_parts", "crc_fold", "cut_lineage", "give_back", "join_hot", "normal_text", "scratch", "shared_dir", "shingle_hashes", "sized", "stored", "table", "texts_by_id", "with_long_id", "word_hashes", "words"]
