"""Trading calendar: dense session numbers and next-session lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def next_session(rows: DataFrame, calendar: DataFrame, date: str, out: str = "entry_no", day: str = "session_date", no: str = "session_no") -> DataFrame:
    """``rows`` plus the number of the first session strictly after ``date`` (null after the last one).

    The calendar becomes a lookup with one row per calendar day between its sessions (some ten thousand
    for decades), which is broadcast; days before the first session map to that.
    """
    spans = calendar.select(F.col(day).alias("_d"), F.col(no).alias("_n"))
    starts = spans.select(F.col("_d").alias("_s"), F.col("_n"))
    # each session serves the days from the previous session on
    served = starts.selectExpr("lag(_s, 1, date_sub(_s, 1)) OVER (ORDER BY _s) AS a", "_s AS b", "_n")
    lookup = served.select(F.explode(F.sequence("a", F.date_sub("b", 1))).alias("_day"), F.col("_n").alias(out))
    first = starts.orderBy("_s").limit(1).select(F.col("_s").alias("_first"), F.col("_n").alias("_first_no"))
    joined = rows.join(F.broadcast(lookup), rows[date] == F.col("_day"), "left").join(F.broadcast(first))
    early = F.col(out).isNull() & (rows[date] < F.col("_first"))
    return joined.withColumn(out, F.when(early, F.col("_first_no")).otherwise(F.col(out))).drop("_day", "_first", "_first_no")


def business_days(first: str, last: str, spark) -> DataFrame:
    """Every US-federal business day from ``first`` to ``last`` with a running number: weekends and the federal holidays
    (rules since 1986; Juneteenth since 2021), moved to Friday or Monday when they fall on a weekend."""
    d = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS day")
    y, m, dom, dow = F.year("day"), F.month("day"), F.dayofmonth("day"), F.weekday("day")

    def fixed(month: int, date: int, since: int = 1900):
        hit = F.lit(False)
        for shift, on in ((0, None), (-1, 4), (1, 0)):  # the day itself, the Friday before, the Monday after
            moved = F.date_sub("day", shift)
            ok = (F.month(moved) == month) & (F.dayofmonth(moved) == date) & (F.year(moved) >= since)
            hit = hit | (ok & (dow == on) if on is not None else ok)
        return hit

    monday = lambda month, n: (m == month) & (dow == 0) & (F.ceil(dom / 7) == n)
    off = fixed(1, 1) | monday(1, 3) | monday(2, 3) | fixed(6, 19, 2021) | fixed(7, 4) | monday(9, 1) | monday(10, 2) | fixed(11, 11) | fixed(12, 25)
    off = off | ((m == 5) & (dow == 0) & (dom > 24)) | ((m == 11) & (dow == 3) & (F.ceil(dom / 7) == 4))
    return d.where((dow < 5) & ~off).selectExpr("day", "cast(row_number() OVER (ORDER BY day) AS int) AS business_no").where(y.isNotNull())
