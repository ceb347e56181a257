"""Event-study outcomes: path-complete window returns against a benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .calendar import next_session


def valid_levels(prices: DataFrame, key: str | None, level: str, no: str = "session_no") -> DataFrame:
    """``prices`` plus ``ok`` (finite and above 0) and ``ok_upto``, the running number of valid sessions (per ``key``)."""
    ok = F.col(level).isNotNull() & ~F.isnan(level) & (F.col(level) > 0) & (F.col(level) < float("inf"))
    over = (Window.partitionBy(key) if key else Window.partitionBy()).orderBy(no).rowsBetween(Window.unboundedPreceding, 0)
    return prices.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("ok_upto", F.sum(F.col("ok").cast("int")).over(over))


def event_returns(
    events: DataFrame, prices: DataFrame, benchmark: DataFrame, calendar: DataFrame, horizons: list[int],
    event: str = "event_id", security: str = "security_id", filed: str = "filing_date",
) -> DataFrame:
    """One row per event and horizon: entry and end session, stock, benchmark and excess return, path flags.

    Entry is the first session strictly after ``filed``; the end is ``horizon`` sessions later. A
    return is null unless the security and the benchmark are valid at every session of the path and
    no terminal row (``delisted``) lies in it: complete means that the valid sessions between entry
    and end number ``horizon`` (difference of running counts), so no path is exploded. ``delisted``
    is false for paths beyond the calendar. Events and (date, security) must be unique.
    """
    last = calendar.agg(F.max("session_no").alias("last_no"))
    at = next_session(events, calendar, filed).withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    at = at.withColumn("end_no", F.col("entry_no") + F.col("horizon"))
    p = valid_levels(prices, security, "close").select(F.col(security).alias("_s"), "session_no", "close", "ok", "ok_upto")
    b = valid_levels(benchmark, None, "level").select("session_no", "level", "ok", "ok_upto")

    def side(df: DataFrame, prefix: str, no: str) -> DataFrame:
        return df.select(*[F.col(c).alias(no if c == "session_no" else f"{prefix}_{c}") for c in df.columns])

    for prefix, no in (("p0", "entry_no"), ("p1", "end_no")):
        s = side(p, prefix, no)
        at = at.join(s, (at[security] == s[f"{prefix}__s"]) & (at[no] == s[no]), "left").drop(s[no], f"{prefix}__s")
    for prefix, no in (("b0", "entry_no"), ("b1", "end_no")):
        at = at.join(F.broadcast(side(b, prefix, no)), no, "left")  # one row a session
    terminal = prices.where("delisted").groupBy(security).agg(F.sort_array(F.collect_set("session_no")).alias("_terminal"))
    at = at.join(terminal, security, "left").join(F.broadcast(last))
    inside = F.coalesce(F.exists("_terminal", lambda t: (t >= F.col("entry_no")) & (t <= F.col("end_no"))), F.lit(False))
    fits = F.col("end_no") <= F.col("last_no")
    whole = lambda x: F.coalesce(
        F.col(f"{x}0_ok") & F.col(f"{x}1_ok") & (F.col(f"{x}1_ok_upto") - F.col(f"{x}0_ok_upto") == F.col("horizon")), F.lit(False)
    )
    at = at.withColumn("delisted", fits & inside).withColumn("complete", fits & whole("p") & whole("b") & ~inside)
    gain = lambda x, c: F.when(F.col("complete"), F.col(f"{x}1_{c}") / F.col(f"{x}0_{c}") - 1)
    out = at.withColumn("stock_return", gain("p", "close")).withColumn("benchmark_return", gain("b", "level"))
    return out.select(
        *events.columns, "horizon", "entry_no", "end_no", "stock_return", "benchmark_return",
        (F.col("stock_return") - F.col("benchmark_return")).alias("excess_return"), F.coalesce("delisted", F.lit(False)).alias("delisted"),
        F.coalesce(fits & ~F.col("complete") & F.col("entry_no").isNotNull(), F.lit(False)).alias("partial_path"),
    )
