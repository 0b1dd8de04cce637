"""Regression trees, forests and boosted trees on long cells.

A dosage has three values, so a node's histogram over one marker is three sums, and all histograms of a level, of every
node, tree and marker, are one aggregate over ``cells (sample_id, var_id, dosage)``.  No sample ever becomes a vector, no
marker needs an index, and nothing but the number of open nodes reaches the driver.

Absent cells count as dosage 0, so only cells with an allele are read; the sums at dosage 0 are what the others leave of the
node.  A split sends dosages above ``cut`` (0 or 1) to the right.  Nodes are numbered 1, then 2 n and 2 n + 1.  Gains equal in
six digits are decided by marker name, then cut.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortframe.functions.expr import u01
from cohortframe.session import MAX_BROADCAST_ROWS, cut_lineage, measured

# Distribution function of the Poisson law with mean 1, at 0 to 5.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Trees:
    """``nodes (tree, node, level, n, value, var_id, cut, gain)``; the last three are null in leaves.  A row's prediction is
    ``base`` and ``rate`` times the sum of its leaves' values."""
    nodes: DataFrame
    depth: int
    base: float
    rate: float


def alleles(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("dosage") > 0).select("sample_id", "var_id", F.col("dosage").cast("int").alias("dosage"))


def _read_once(cells: DataFrame) -> DataFrame:
    """The cells with an allele, a sample's together: every level reads them."""
    return cut_lineage(alleles(cells).repartition("sample_id"))


def split_gains(cells: DataFrame, state: DataFrame, share: float = 1.0, seed: int = 42, min_leaf: float = 1.0) -> DataFrame:
    """``tree, node, var_id, cut, gain`` of every split of every node: by how much it lowers the summed squared error.

    ``state``: ``tree, sample_id, y, w, node``.  A node looks at a hashed ``share`` of the markers.
    """
    total = measured(state.groupBy("tree", "node").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("s")))
    met = alleles(cells).join(state, "sample_id")
    if share < 1.0:
        asked = u01(seed, F.lit("feature"), "tree", "node", "var_id") < share
        pairs = total.select("tree", "node").crossJoin(F.broadcast(alleles(cells).select("var_id").distinct()))
        # a hash per node and marker, not per cell, while those pairs are few
        met = met.join(F.broadcast(pairs.where(asked)), ["tree", "node", "var_id"], "left_semi") if pairs.count() <= MAX_BROADCAST_ROWS else met.where(asked)
    two = F.col("dosage") == 2
    sums = met.groupBy("tree", "node", "var_id").agg(
        F.sum("w").alias("n0"), F.sum(F.col("w") * F.col("y")).alias("s0"),
        F.sum(F.when(two, F.col("w")).otherwise(0.0)).alias("n1"), F.sum(F.when(two, F.col("w") * F.col("y")).otherwise(0.0)).alias("s1"))
    right = F.explode(F.array(*[F.struct(F.lit(c).alias("cut"), F.col(f"n{c}").alias("nr"), F.col(f"s{c}").alias("sr")) for c in (0, 1)]))
    each = sums.select("tree", "node", "var_id", right.alias("r")).select("tree", "node", "var_id", "r.*").join(total, ["tree", "node"])
    nl, sl = F.col("n") - F.col("nr"), F.col("s") - F.col("sr")
    return each.where((F.col("nr") >= min_leaf) & (nl >= min_leaf)).select(
        "tree", "node", "var_id", "cut", (sl * sl / nl + F.col("sr") * F.col("sr") / F.col("nr") - F.col("s") * F.col("s") / F.col("n")).alias("gain"))


def _routed(cells: DataFrame, rows: DataFrame, splits: DataFrame) -> DataFrame:
    """``rows`` with their node's split taken; rows of nodes without one stay."""
    splits = measured(splits.select("tree", "node", "var_id", "cut"))
    asked = alleles(cells).join(measured(splits.select("var_id").distinct()), "var_id", "left_semi")
    with_split = rows.join(splits, ["tree", "node"], "left")
    met = with_split.join(asked, ["sample_id", "var_id"], "left")
    right = (F.coalesce("dosage", F.lit(0)) > F.col("cut")).cast("long")
    return met.withColumn("node", F.when(F.col("cut").isNull(), F.col("node")).otherwise(F.col("node") * 2 + right)).select(*rows.columns)


def grow(cells: DataFrame, state: DataFrame, depth: int, share: float = 1.0, seed: int = 42, min_leaf: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The nodes of one tree per ``tree`` in ``state`` (``tree, sample_id, y, w``), level by level, and the leaf of every row."""
    state = cut_lineage(state.select("tree", "sample_id", "y", "w", F.lit(1).cast("long").alias("node")))
    nodes = []
    for level in range(depth + 1):
        open_ = state.where(F.col("node") >= 1 << level)
        total = open_.groupBy("tree", "node").agg(F.sum("w").alias("n"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("value"))
        if level < depth:
            order = F.struct(-F.round("gain", 6), "var_id", "cut")
            best = split_gains(cells, open_, share, seed, min_leaf).where(F.col("gain") > LEAST_GAIN).groupBy("tree", "node").agg(
                F.min_by(F.struct("var_id", "cut", "gain"), order).alias("b")).select("tree", "node", "b.*")
            total = total.join(best, ["tree", "node"], "left")
        else:
            total = total.withColumns({"var_id": F.lit(None).cast("string"), "cut": F.lit(None).cast("int"), "gain": F.lit(None).cast("double")})
        nodes.append(cut_lineage(total.select("tree", "node", F.lit(level).alias("level"), "n", "value", "var_id", "cut", "gain")))
        splits = nodes[-1].where("cut IS NOT NULL")
        if level == depth or splits.isEmpty():
            break
        state = cut_lineage(_routed(cells, open_, splits).unionByName(state.where(F.col("node") < 1 << level)))
    return reduce(DataFrame.unionByName, nodes), state


def _drawn(seed: int) -> Column:
    """How often a tree draws a sample: Poisson with mean 1, by a hash."""
    u = u01(seed, F.lit("draw"), "tree", "sample_id")
    return sum((F.when(u >= p, 1.0).otherwise(0.0) for p in POISSON[1:]), F.when(u >= POISSON[0], 1.0).otherwise(0.0))


def fit_forest(cells: DataFrame, y: DataFrame, trees: int = 75, depth: int = 15, share: float = 1 / 3, min_leaf: float = 1.0, seed: int = 42) -> Trees:
    """A random forest: hashed draws with replacement per tree, a hashed share of the markers per node."""
    state = y.where("y IS NOT NULL").select("sample_id", "y", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).withColumn("w", _drawn(seed))
    nodes, _ = grow(_read_once(cells), state.where("w > 0"), depth, share, seed, min_leaf)
    return Trees(nodes, depth, 0.0, 1.0 / trees)


def fit_boosting(cells: DataFrame, y: DataFrame, rounds: int = 100, depth: int = 4, rate: float = 0.1, share: float = 1.0, min_leaf: float = 1.0, seed: int = 42) -> Trees:
    """Boosting of the squared error: every round a tree learns what the rounds before have left."""
    cells, known = _read_once(cells), y.where("y IS NOT NULL").select("sample_id", "y")
    base = known.agg(F.avg("y").alias("m")).first()["m"] or 0.0
    left = known.select("sample_id", (F.col("y") - base).alias("y"))
    nodes = []
    for number in range(rounds):
        grown, at = grow(cells, left.select(F.lit(number).alias("tree"), "sample_id", "y", F.lit(1.0).alias("w")), depth, share, seed, min_leaf)
        nodes.append(grown)
        left = cut_lineage(at.join(measured(grown.select("tree", "node", "value")), ["tree", "node"]).select("sample_id", (F.col("y") - F.col("value") * rate).alias("y")))
    return Trees(reduce(DataFrame.unionByName, nodes), depth, base, rate)


def predict_trees(model: Trees, cells: DataFrame, samples: DataFrame) -> DataFrame:
    """``sample_id, prediction`` for the distinct ids of ``samples``: all trees walked at once, a join a level."""
    roots = model.nodes.where("node = 1").agg(F.sort_array(F.collect_list("tree")).alias("t"))        # a number per tree
    rows = samples.select("sample_id").distinct().withColumn("t", roots.scalar()).select("sample_id", F.explode("t").alias("tree"), F.lit(1).cast("long").alias("node"))
    cells = _read_once(cells.join(measured(model.nodes.select("var_id").dropna().distinct()), "var_id", "left_semi"))
    for level in range(model.depth):
        rows = cut_lineage(_routed(cells, rows, model.nodes.where((F.col("level") == level) & F.col("cut").isNotNull())))
    told = rows.join(measured(model.nodes.select("tree", "node", "value")), ["tree", "node"])
    return told.groupBy("sample_id").agg((F.sum("value") * model.rate + model.base).alias("prediction"))


def tree_importance(model: Trees) -> DataFrame:
    """``var_id, importance``: a marker's share of all gains; markers without a split are not in it."""
    split = model.nodes.where("cut IS NOT NULL")
    total = split.agg(F.sum("gain").alias("g"))
    return split.groupBy("var_id").agg((F.sum("gain") / F.first(total.scalar())).alias("importance"))
