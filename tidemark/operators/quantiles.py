"""Exact quantiles of everything before a period, from cumulative histograms."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

BUCKETS = 1024


def earlier_quantiles(df: DataFrame, period: str, value: str, fractions: list[float], periods: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(period, n, quantiles): for each period the number of known values of all strictly earlier periods and their quantiles,
    linear between neighbours. Periods without earlier values are left out.

    Values are counted by (period, bucket); running sums over periods and buckets of that small table tell which bucket holds
    the sought ranks. Only these buckets' distinct values are looked at again, counted by value, so no row meets the
    later periods and no group holds more than a bucket's distinct values. ``periods`` lists the periods asked for
    (those of ``df``).
    """
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(period).alias("_p"), F.col(value).cast("double").alias("_v"))
    asked = (periods if periods is not None else df).select(F.col(period).alias("_p")).where("_p IS NOT NULL").distinct()
    inner = [i / buckets for i in range(1, buckets)]
    cuts = known.agg(F.percentile_approx("_v", inner, 10 * buckets)).first()[0] or [0.0]  # bounded by ``buckets``
    splits = [float("-inf"), *sorted({c for c in cuts if abs(c) != float("inf")}), float("inf")]
    split = Bucketizer(splits=splits, inputCol="_v", outputCol="_b").transform(known)
    counts = written(split.groupBy("_p", F.col("_b").cast("int").alias("_b"), "_v").agg(F.count("*").alias("_n")))
    cells = counts.groupBy("_p", "_b").agg(F.sum("_n").alias("_n"))
    every = asked.union(counts.select("_p")).distinct()
    grid = every.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(len(splits) - 2))))  # periods x buckets
    before = Window.partitionBy("_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("_p").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("_p")
    c = grid.join(cells, ["_p", "_b"], "left").withColumn("_c", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    c = c.withColumn("_s", F.sum("_c").over(upto)).withColumn("n", F.sum("_c").over(whole)).where("_c > 0").join(asked, "_p", "left_semi")
    ranks = []
    for i, f in enumerate(fractions):
        at = F.lit(f) * (F.col("n") - 1)
        ranks += [F.struct(F.lit(i).alias("i"), F.floor(at).alias("r"), (1 - (at - F.floor(at))).alias("w")), F.struct(F.lit(i).alias("i"), F.ceil(at).alias("r"), (at - F.floor(at)).alias("w"))]
    sought = c.withColumn("_t", F.explode(F.array(*ranks))).where("_t.r < _s AND _t.r >= _s - _c")
    sought = written(sought.select("_p", "_b", "n", "_t.i", "_t.w", (F.col("_t.r") - F.col("_s") + F.col("_c")).alias("_k")))
    wanted = sought.select(F.col("_p").alias("_for"), "_b").distinct()
    held = counts.join(wanted, "_b").where("_p < _for").groupBy("_for", "_b", "_v").agg(F.sum("_n").alias("_n"))
    order = Window.partitionBy("_for", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("_e", F.sum("_n").over(order)).withColumnsRenamed({"_for": "_p"})
    found = sought.join(held, ["_p", "_b"]).where("_k < _e AND _k >= _e - _n")
    one = found.groupBy("_p", "n", "i").agg(F.sum(F.col("w") * F.col("_v")).alias("q"))
    rows = one.groupBy("_p", "n").agg(F.sort_array(F.collect_list(F.struct("i", "q"))).alias("_q"))
    return rows.select(F.col("_p").alias(period), "n", F.transform("_q", lambda x: x["q"]).alias("quantiles"))


def overall_quantiles(df: DataFrame, value: str, fractions: list[float]) -> DataFrame:
    """(q, value): exact quantiles of a column, by the same means; no rows for an empty column."""
    one = df.select(F.lit(0).alias("_period"), F.col(value).alias("_value"))
    at = earlier_quantiles(one, "_period", "_value", fractions, df.sparkSession.range(1, 2).select(F.col("id").cast("int").alias("_period")))
    named = F.arrays_zip(F.array(*[F.lit(f) for f in fractions]).alias("q"), F.col("quantiles").alias("value"))
    return at.select(F.explode(named).alias("x")).select("x.q", "x.value")
