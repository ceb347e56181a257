"""Ordered operators: trailing windows, spacing, indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def return_index(df: DataFrame, key: str, order: str, r: str, out: str = "log_level") -> DataFrame:
    """Running log-level of valid returns (> -1); null where the return is invalid. A window return is exp(difference) - 1."""
    ok = F.col(r).isNotNull() & (F.col(r) > -1)
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.when(ok, F.sum(F.when(ok, F.ln(1 + F.col(r)))).over(w)))


def trailing_mean(df: DataFrame, key: str, order: str, value: Column, rows: int, out: str) -> DataFrame:
    """Mean of ``value`` over the ``rows`` rows before, null unless all of them are known."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-rows, -1)
    return df.withColumn("_v", value).withColumn(out, F.when(F.count("_v").over(w) == rows, F.avg("_v").over(w))).drop("_v")


def trailing_distinct(df: DataFrame, key: str, day: str, actor: str, days: int, out: str) -> DataFrame:
    """Number of distinct ``actor`` in the ``days`` calendar days up to and including each row's day.

    Rows are first reduced to distinct (key, day, actor); an actor counts from each of its days for
    ``days`` days, so gaps-and-islands of covered days and a running sum of +1 and -1 give the count
    without holding a window's actors."""
    base = df.select(key, day, actor).distinct()
    w = Window.partitionBy(key, actor).orderBy(day)
    nxt = F.lead(day).over(w)
    until = F.date_add(day, days)  # first day that no longer counts
    marks = base.select(key, F.col(day).alias("_d"), F.when(nxt.isNotNull() & (nxt < until), nxt).otherwise(until).alias("_u"))
    steps = marks.select(key, F.explode(F.array(F.struct(F.col("_d").alias("_t"), F.lit(1).alias("_x")), F.struct(F.col("_u").alias("_t"), F.lit(-1).alias("_x")))).alias("_e"))
    steps = steps.groupBy(key, F.col("_e._t").alias(day)).agg(F.sum("_e._x").alias("_x"))
    total = steps.withColumn(out, F.sum("_x").over(Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, 0))).drop("_x")
    return df.join(total, [key, day])


def greedy_spacing(df: DataFrame, keys: list[str], pos: str, gap: int | Column) -> DataFrame:
    """(keys, pos): the first position of each key and then each that is at least ``gap`` (a number, or one of the keys) after
    the last one kept.

    Order-dependent, so a key's distinct positions are folded in one array; they are bounded by the
    number of sessions."""
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_set(pos)).alias("_p"))
    empty = F.array().cast("array<int>")
    kept = F.aggregate(
        "_p", F.struct(empty.alias("kept"), F.lit(None).cast("int").alias("last")),
        lambda a, x: F.when(a["last"].isNull() | (x >= a["last"] + gap), F.struct(F.concat(a["kept"], F.array(x.cast("int"))).alias("kept"), x.cast("int").alias("last"))).otherwise(a),
    )["kept"]
    return rows.select(*keys, F.explode(kept).alias(pos))


def change_points(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before (null equals null)."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_p", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("_p"))).drop("_p", "_n")


def drawdown(df: DataFrame, key: list[str], order: str, cum: str, out: str = "drawdown") -> DataFrame:
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.col(cum) / F.max(cum).over(w) - 1)


def session_spine_mean(df: DataFrame, key: str, no: str, value: str, sessions: int, least: int, out: str) -> DataFrame:
    """Mean of ``value`` over the last ``sessions`` session numbers up to the row's own, null with fewer than ``least`` rows."""
    w = Window.partitionBy(key).orderBy(no).rangeBetween(-(sessions - 1), 0)
    return df.withColumn(out, F.when(F.count(value).over(w) >= least, F.avg(value).over(w)))
