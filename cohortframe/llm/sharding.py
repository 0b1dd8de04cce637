"""Sharding by balanced label propagation (operator 12).

Documents that share a hub (for ``documents``: an equal text) are linked.  Shards should cut few links and still be of even
size.

* Every linked row begins in the shard its hash names.  In each round, a join tells every row how many of its neighbours
  each shard holds, and the row proposes to move to the fullest one that has room.
* Quotas: proposals for a shard are admitted, the best first, while they fit into what is free there.  The order is a class
  of gain and a hash, so a table of ``shards * 64 * BUCKETS`` sums decides, and rows need no global order.  Of the
  class that fits only in part a hashed share is admitted.
* Neighbours are counted per hub and shard before anything is joined; a hub that links a third of all rows is a row of
  ``shards`` numbers and is broadcast (``join_hot``).
* Rows without links are poured into the room that is left, in an order of hashes, by distributed running sums: first the
  large ones, then the middling, then the small ones, each time into what the last pouring left.  So the shards end within
  a small row of each other where there are enough of those.

Law ``bytes``: the sum of sizes is near equal over the shards.  Nothing is collected but sums per shard and per size class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortframe.llm.common import cut_lineage, join_hot, stored
from cohortframe.operators.ranking import ranked

SHARDS = 8
ROUNDS = 12             # at most; it ends when nothing more moves
FILL = 0.98             # of a shard's share that linked rows may take; the rest is for rows without links
BUCKETS = 64            # of a hash, per class of gain
UNIT = float(1 << 52)


def _u01(*keys: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 12) / F.lit(UNIT)


def _loads(rows: DataFrame, shards: int) -> list[int]:
    """Bytes per shard; ``shards`` numbers."""
    found = {r["shard"]: r["size"] for r in rows.groupBy("shard").agg(F.sum("size").alias("size")).collect()}
    return [int(found.get(s, 0) or 0) for s in range(shards)]


def _fullest(near: Column, own: Column, free: list[int], size: Column, upwards: bool) -> Column:
    """(neighbours there, shard) of the shard with most neighbours among the row's own and those that way with room for it."""
    open_ = F.array(*[F.lit(max(0, f)).cast("long") for f in free])
    held = F.transform(near, lambda n, s: F.when((s == own) | ((F.get(open_, s) >= size) & (s > own if upwards else s < own)), F.struct(n.alias("n"), (s == own).cast("int").alias("stay"), (-s).alias("s"))))
    return F.array_max(held)


def propagate(rows: DataFrame, links: DataFrame, capacity: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``row, size, shard`` for ``rows`` (row, size) that are tied by ``links`` (row, hub); ``capacity`` bytes a shard.

    A row may have several hubs.  Shards stay within the capacity, but for what the hashes of the beginning and the share
    of a class that is admitted in part miss by.
    """
    links = stored(links, "links")
    labels = stored(rows.select("row", "size", F.pmod(F.xxhash64("row", F.lit("begin")), F.lit(shards)).cast("int").alias("shard")), "labels")
    loads, still = _loads(labels, shards), 0
    for round_ in range(rounds):
        free = [capacity - n for n in loads]
        per = links.join(labels, "row").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
        # hub -> neighbours in shard 0, 1, ..
        known = per.groupBy("hub").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("shard") == s, F.col("n"))), F.lit(0)).cast("long") for s in range(shards)]).alias("held"))
        met = join_hot(links, known, ["hub"])
        near = met.groupBy("row").agg(F.array(*[F.sum(F.col("held")[s]) for s in range(shards)]).alias("near"), F.count(F.lit(1)).alias("hubs"))
        seen = labels.join(near, "row")
        self_out = F.transform("near", lambda n, s: n - F.when(s == F.col("shard"), F.col("hubs")).otherwise(F.lit(0)))      # a row is no neighbour of itself
        best = seen.withColumn("near", self_out).withColumn("best", _fullest(F.col("near"), F.col("shard"), free, F.col("size"), round_ % 2 == 0))
        gain = F.col("best.n") - F.element_at("near", F.col("shard") + 1)
        rank = (F.lit(63) - F.least(F.lit(62), F.floor(F.log2(F.greatest(gain, F.lit(1)).cast("double"))))).cast("int") * BUCKETS
        asked = best.where(gain > 0).select("row", "size", "shard", (-F.col("best.s")).alias("to"),
                                            (rank + F.pmod(F.xxhash64(F.col("best.n"), F.lit(round_)), F.lit(BUCKETS)).cast("int")).alias("bucket"))
        asked = cut_lineage(asked)
        summed = asked.groupBy("to", "bucket").agg(F.sum("size").alias("bytes"))        # shards * 64 * BUCKETS rows at most
        upto = W.partitionBy("to").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        room = F.greatest(F.get(F.array(*[F.lit(f).cast("long") for f in free]), F.col("to")), F.lit(0))
        share = summed.select(F.col("to").alias("_to"), F.col("bucket").alias("_bucket"),
                              F.least(F.lit(1.0), F.greatest(F.lit(0.0), (room - F.coalesce(F.sum("bytes").over(upto), F.lit(0))) / F.col("bytes"))).alias("share"))
        moves = asked.join(F.broadcast(share), (F.col("to") == F.col("_to")) & (F.col("bucket") == F.col("_bucket"))).where(
            (F.col("share") >= 1.0) | (_u01(F.col("row"), F.lit(round_)) < F.col("share"))).select("row", "to")
        moved = stored(labels.join(moves, "row", "left").select("row", "size", F.coalesce("to", "shard").cast("int").alias("shard"), F.col("to").isNotNull().alias("moved")), "labels")
        labels, changed = moved.drop("moved"), not moved.where("moved").isEmpty()
        loads = _loads(labels, shards)
        still = 0 if changed else still + 1
        if still == 2:
            break
    return labels


def _summed(rows: DataFrame) -> DataFrame:
    """Adds ``before``: the bytes of all rows that come first in the order of their hashes."""
    laid = cut_lineage(rows.withColumn("order", F.xxhash64("row")).orderBy("order", "row").withColumn("_at", F.monotonically_increasing_id()))
    laid = laid.withColumn("_part", F.shiftright("_at", 33))
    sums = laid.groupBy("_part").agg(F.sum("size").alias("_bytes"))         # a row per sort task
    earlier = F.broadcast(sums.select("_part", (F.sum("_bytes").over(W.orderBy("_part")) - F.col("_bytes")).alias("_earlier")))
    inside = F.sum("size").over(W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    return laid.withColumn("_inside", inside).join(earlier, "_part").select(*rows.columns, (F.col("_inside") + F.col("_earlier")).alias("before"))


def pour(rows: DataFrame, loads: list[int], even: float) -> DataFrame:
    """``row, size, shard`` for rows that go anywhere: they fill what each of the ``loads`` lacks to ``even`` by one share.

    The row whose middle lies in the n-th shard's part of the running sum goes there.
    """
    room = [max(0.0, even - n) for n in loads]
    scale = (rows.agg(F.sum("size")).first()[0] or 0) / sum(room) if sum(room) else 0.0
    edge, edges = 0.0, []
    for r in room:
        edge += r * scale
        edges.append(edge)
    middle = F.col("before") + F.col("size") / 2
    shard = F.lit(len(loads) - 1)
    for s in reversed(range(len(loads) - 1)):
        shard = F.when(middle < edges[s], F.lit(s)).otherwise(shard)
    return _summed(rows).select("row", "size", shard.cast("int").alias("shard"))


def _grades(rows: DataFrame, shares: tuple[float, ...] = (0.3, 0.05)) -> list[int]:
    """The sizes at which large, middling and small rows part: powers of two up to which these shares of the bytes lie, at least."""
    classes = rows.groupBy(F.ceil(F.log2(F.col("size").cast("double"))).cast("int").alias("c")).agg(F.sum("size").alias("bytes")).collect()     # 64 rows at most
    total, so_far, out = sum(r["bytes"] for r in classes), 0, [0] * len(shares)
    for r in sorted(classes, key=lambda r: r["c"]):
        so_far += r["bytes"]
        out = [old or (1 << r["c"] if so_far >= share * total else 0) for old, share in zip(out, shares)]
    return out


def balanced(rows: DataFrame, links: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``row, size, shard``: linked rows by ``propagate``, then the coarse and at last the fine rows without links."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    tied = links.select("row").distinct()
    linked = propagate(rows.join(tied, "row", "left_semi"), links, int(total / shards * FILL), shards)
    single = stored(rows.join(tied, "row", "left_anti"), "single")
    upper = [1 << 62, *_grades(single)]
    for most, least in zip(upper, [*upper[1:], 0]):
        grade = single.where((F.col("size") <= most) & (F.col("size") > least))
        linked = linked.unionByName(stored(pour(grade, _loads(linked, shards), total / shards), "poured"))
    return linked


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``; rows with equal texts are linked.

    Size is the text's UTF-8 bytes plus 1; a null text has none and is linked with other null texts, not with empty ones.
    Rows that repeat, and null doc_ids, are rows of their own.  Slots follow the doc_id, nulls first.  An empty table has no
    rows.  Extra columns are ignored.
    """
    text = F.col("text").cast("binary")
    rows = stored(docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"),
                              F.coalesce(F.sha2(text, 256), F.lit("")).alias("hub"), F.monotonically_increasing_id().alias("row")), "sized")
    counts = rows.groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
    links = join_hot(rows.select("row", "hub"), counts.where("n > 1"), ["hub"]).where("n > 1").select("row", "hub")
    placed = stored(balanced(rows.select("row", "size"), stored(links, "linked"), shards).select("row", "shard"), "placed")
    out = rows.drop("hub").join(placed, "row")
    return ranked(out, ["doc_id", "row"], by=["shard"], name="slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, assigned: DataFrame, folder: str) -> None:
    """Write the rows of ``docs`` in a folder per shard.  ``assigned``: ``shard_documents`` of a table with unique doc_ids."""
    docs.join(assigned.select("doc_id", "shard", "slot"), "doc_id").repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions(
        "shard", "slot").write.partitionBy("shard").parquet(folder)
