"""Signals from strictly earlier data, and portfolios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import earlier_quantiles


def prior_years_terciles(events: DataFrame, date: str, value: str, out: str = "tercile") -> DataFrame:
    """Tercile of each event by the 1/3 and 2/3 quantiles of all strictly earlier years; ties go low; null in the first year.

    Breakpoints are one row per year, so they are joined back by broadcast."""
    yearly = events.withColumn("_year", F.year(date))
    cuts = earlier_quantiles(yearly, "_year", value, [1 / 3, 2 / 3]).select("_year", F.col("quantiles").alias("_c"))
    j = yearly.join(F.broadcast(cuts), "_year", "left")
    t = F.when(F.col("_c").isNull() | F.col(value).isNull(), None).when(F.col(value) <= F.col("_c")[0], 1).when(F.col(value) <= F.col("_c")[1], 2).otherwise(3)
    return j.withColumn(out, t).drop("_year", "_c")


def silent_owners(sales: DataFrame, owner: str, issuer: str, sold: str, filed: str, available: DataFrame) -> DataFrame:
    """Owners who sold in one calendar month in each of the two years before: SSS if they sell (publicly, by the month's
    availability date) this year, SSN if not; ``late`` if this year's sale became public later.

    ``available`` has (year, month, available_on). Three equality joins on (owner, issuer, month, year)."""
    first = sales.groupBy(F.col(owner).alias("owner"), F.col(issuer).alias("issuer"), F.year(sold).alias("year"), F.month(sold).alias("month")).agg(F.min(filed).alias("filed"))
    at = available.select("year", "month", "available_on")
    back = lambda n: first.select("owner", "issuer", "month", (F.col("year") + n).alias("year"), F.col("filed").alias(f"filed{n}"))
    c = back(1).join(back(2), ["owner", "issuer", "month", "year"]).join(F.broadcast(at), ["year", "month"])
    c = c.where("filed1 <= available_on AND filed2 <= available_on").join(back(0), ["owner", "issuer", "month", "year"], "left")
    sells = F.coalesce(F.col("filed0") <= F.col("available_on"), F.lit(False))
    return c.select("owner", "issuer", "year", "month", "available_on", F.when(sells, "SSS").otherwise("SSN").alias("state"), (F.col("filed0").isNotNull() & ~sells).alias("late"))


def seller_class(sales: DataFrame, owner: str, issuer: str, sold: str, filed: str, last_year: int) -> DataFrame:
    """As of 1 January: sold in each of three prior years by filings known then; a common month is routine, none opportunistic.

    A sale counts for the three years after it, up to ``last_year``, so rows meet years without a join."""
    j = sales.withColumn("year", F.explode(F.sequence(F.year(sold) + 1, F.year(sold) + 3))).where((F.col("year") <= last_year) & (F.col(filed) < F.make_date("year", F.lit(1), F.lit(1))))
    m = lambda n: F.collect_set(F.when(F.year(sold) == F.col("year") - n, F.month(sold)))
    g = j.groupBy(F.col(owner).alias("owner"), F.col(issuer).alias("issuer"), "year").agg(m(1).alias("m1"), m(2).alias("m2"), m(3).alias("m3"))
    full = (F.size("m1") > 0) & (F.size("m2") > 0) & (F.size("m3") > 0)
    common = F.size(F.array_intersect(F.array_intersect("m1", "m2"), "m3")) > 0
    return g.select("owner", "issuer", "year", F.when(~full, "unclassified").when(common, "routine").otherwise("opportunistic").alias("seller_class"))


def calendar_time_portfolio(daily: DataFrame, entries: DataFrame, key: str, no: str, r: str, hold: int) -> DataFrame:
    """Day return of positions opened by ``entries`` (key, no, weight): a position earns the key's next ``hold`` own rows.

    The open weight of a key is a sliding sum of its entry weights, so no event is exploded into days."""
    w = Window.partitionBy(key).orderBy(no).rowsBetween(-hold, -1)
    e = entries.groupBy(key, no).agg(F.sum("weight").alias("_w"), F.sum(F.abs("weight")).alias("_a"))
    x = daily.join(e, [key, no], "left").withColumn("_open", F.sum(F.coalesce("_w", F.lit(0.0))).over(w)).withColumn("_gross", F.sum(F.coalesce("_a", F.lit(0.0))).over(w))
    ok = F.col(r).isNotNull() & (F.col("_gross") > 0)
    g = x.where(ok).groupBy(no).agg(F.sum(F.col("_open") * F.col(r)).alias("_x"), F.sum("_gross").alias("gross"))
    return g.select(no, "gross", (F.col("_x") / F.col("gross")).alias("day_return"))


def issuer_excluded_mean(df: DataFrame, day: str, value: str, coverage: float = 0.0) -> DataFrame:
    """``df`` plus the mean of the other rows of its day; null for a day with one known value, or of which less than ``coverage`` are known."""
    g = df.groupBy(day).agg(F.sum(value).alias("_s"), F.when(F.count(value) >= coverage * F.count("*"), F.count(value)).alias("_n"))
    own = F.coalesce(F.col(value), F.lit(0.0))
    n = F.col("_n") - F.col(value).isNotNull().cast("int")
    return df.join(g, day).withColumn("others_mean", F.when(n > 0, (F.col("_s") - own) / n)).drop("_s", "_n")


def conviction_score(small: Column, big: Column, broad: Column, senior: Column) -> Column:
    return sum((F.coalesce(c.cast("int"), F.lit(0)) for c in (small, big, broad, senior)), F.lit(0))
