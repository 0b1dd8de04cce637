"""Ranks and exact quantiles that no single task has to hold.

Quantiles need no ranks: ``select_ranks`` narrows down to them by counting.

A plain ``row_number() over (order by ..)`` moves the whole table to one task.
Here the rows are range-partitioned on (group, order), so a group or a value
that holds a third of all rows is spread over as many tasks as it needs; each
task numbers its own rows and a small table of per-task counts adds the offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortframe.session import cut_lineage, measured


def ranked(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (),
           name: str = "rank", total: str | None = None) -> DataFrame:
    """Add the 1-based position of each row inside its group.

    ``order`` must be a total order for the ranks to be reproducible; ties fall
    to the engine otherwise.  ``total`` adds the group's row count.  The
    sorted rows are checkpointed once, so that a lost task cannot re-cut the
    ranges between the counting and the numbering pass.
    """
    by = list(by)
    keys = [*by, "_part"]
    laid = (df.orderBy(*by, *order)
              .withColumn("_at", F.monotonically_increasing_id()))
    laid = cut_lineage(laid).withColumn("_part", F.shiftright("_at", 33))
    counts = laid.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"),
                                     F.min("_at").alias("_first"))
    # one row per (group, task) here: bounded by the number of sort tasks
    upto = W.partitionBy(*by).orderBy("_part") if by else W.orderBy("_part")
    whole = W.partitionBy(*by) if by else W.partitionBy()
    counts = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first",
        (F.sum("_n").over(upto) - F.col("_n")).alias("_before"),
        F.sum("_n").over(whole).alias("_total"))
    same = None
    for i, k in enumerate(keys):
        cond = laid[k].eqNullSafe(counts[f"_k{i}"])
        same = cond if same is None else same & cond
    if not by:                     # one row per sort task
        counts = F.broadcast(counts)
    out = laid.join(counts, same).withColumn(
        name, (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("long"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.select(*df.columns, name, *([total] if total else []))


BUCKETS = 256           # parts an interval is cut into
REST = 4096             # values of an interval that are gathered in one row


def _on(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on group keys that may be null; without keys on a constant.  The keys of ``left`` stay."""
    other = right.select(*[F.col(c).alias(f"_g_{c}") for c in by], *[c for c in right.columns if c not in by])
    on = F.lit(True)
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    if not by:
        left, other, on = left.withColumn("_one", F.lit(1)), other.withColumn("_g_one", F.lit(1)), F.col("_one") == F.col("_g_one")
    return left.join(other, on, how).drop(*[f"_g_{c}" for c in by], *([] if by else ["_one", "_g_one"]))


def _order(v: Column) -> Column:
    """A number that never falls as ``v`` grows, even over signs and exponents; infinite values have an end each."""
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.least(F.log2(F.abs(v)), F.lit(1030.0)) + 1100.0))


def _bucket(v: str, lo: str, hi: str) -> Column:
    """Which of ``BUCKETS`` parts of lo .. hi a value lies in, lo in the first and hi in the last.

    The parts are even in the exponents while the ends are several powers of two apart, so that outliers cost one round; then
    both ends are of one sign and the parts are even in the values.
    """
    v, lo, hi = F.col(v), F.col(lo), F.col(hi)
    ends = F.when(hi == float("inf"), F.when(v == hi, 1.0).otherwise(0.0)).when(lo == float("-inf"), F.when(v == lo, 0.0).otherwise(1.0)).otherwise(
        (v - lo) / (hi - lo))
    far = _order(hi) - _order(lo) > 8.0
    share = F.when(far, (_order(v) - _order(lo)) / (_order(hi) - _order(lo))).otherwise(ends)
    return F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS)).cast("int")


def select_ranks(rows: DataFrame, ranks: DataFrame, by: Sequence[str] = (), buckets: int | None = None, rest: int | None = None) -> DataFrame:
    """``by, rank, value``: the values at 0-based ranks of each group, by bucket refinement and without a sort.

    ``rows``: ``by`` and a double ``_v``, neither null nor NaN; read several times.  ``ranks``: ``by, rank, lo, hi, n``, the
    group's least and largest value and its size.  A round counts the values of each interval that still holds a rank in
    ``BUCKETS`` buckets - one partial aggregate - and goes on in the bucket that has it, from its least to its largest
    value.  An interval of one value is done, so ties of any weight are; one of ``REST`` values is gathered.
    """
    by, rest = list(by), rest or REST
    key = [*by, "lo", "hi"]
    state = cut_lineage(ranks.select(*by, "rank", "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("m")))
    done = None
    while True:
        ready = state.where("lo = hi").select(*by, "rank", F.col("lo").alias("value"))
        done = ready if done is None else done.unionByName(ready)
        state = state.where("lo < hi")
        wide = state.where(F.col("m") > rest)
        if wide.isEmpty():
            break
        at = measured(wide.select(*key, "before").distinct())
        inside = _on(rows, at, by).where("_v >= lo AND _v <= hi")
        counts = inside.groupBy(*key, "before", _bucket("_v", "lo", "hi").alias("bucket")).agg(
            F.count(F.lit(1)).alias("c"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        # BUCKETS rows of an interval at most
        sums = counts.withColumn("upto", F.col("before") + F.sum("c").over(W.partitionBy(*key).orderBy("bucket")))
        hit = _on(wide.select(*by, "rank", "lo", "hi"), sums.drop("before").withColumnsRenamed({"lo": "_lo", "hi": "_hi"}), by).where(
            (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi")) & (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
        narrow = hit.select(*by, "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("upto") - F.col("c")).alias("before"), F.col("c").alias("m"))
        state = cut_lineage(state.where(F.col("m") <= rest).unionByName(narrow))
    few = measured(state.select(*key).distinct())
    held = _on(rows, few, by).where("_v >= lo AND _v <= hi").groupBy(*key).agg(F.sort_array(F.collect_list("_v")).alias("held"))
    last = _on(state, held.withColumnsRenamed({"lo": "_lo", "hi": "_hi"}), by).where((F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi")))
    return done.unionByName(last.select(*by, "rank", F.get("held", (F.col("rank") - F.col("before")).cast("int")).alias("value")))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    Columns: the group keys, ``n`` and ``q`` (array, one entry per probability).  No rows are sorted: the few ranks that
    the probabilities need are found by ``select_ranks``.  NaN counts as larger than any number.
    For values with a small domain (dosages) ``F.percentile`` is as exact, because its buffer is keyed by distinct value.
    """
    by = list(by)
    rows = cut_lineage(df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")))
    number = F.when(~F.isnan("_v"), F.col("_v"))
    stats = cut_lineage(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(number).alias("_numbers"), F.min(number).alias("lo"), F.max(number).alias("hi")))
    at = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    pair = [F.floor(a) for a in at] + [F.least(F.floor(a) + 1, F.col("n") - 1) for a in at]
    ranks = stats.where("n > 0").select(*by, "lo", "hi", F.col("_numbers").alias("n"), F.explode(F.array_distinct(F.array(*pair))).alias("rank")).where("rank < n")
    found = select_ranks(rows.where(~F.isnan("_v")), ranks, by)
    told = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"))       # two entries a probability at most
    nan = F.lit(float("nan"))

    def value_at(rank: Column) -> Column:
        return F.when(F.col("n") > rank, F.coalesce(F.try_element_at("_at", rank), nan))

    parts = [F.when(a == F.floor(a), value_at(lo)).otherwise(value_at(lo) + (value_at(hi) - value_at(lo)) * (a - F.floor(a)))
             for lo, hi, a in zip(pair, pair[len(probs):], at)]
    return _on(stats, told, by, "left").select(*by, F.nullif("n", F.lit(0)).alias("n"), F.array(*[F.when(F.col("n") > 0, x) for x in parts]).alias("q"))
