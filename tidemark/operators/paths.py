"""Returns along a security's own rows, which may lack sessions, and along the benchmark's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .calendar import next_session
from .joins import asof

RUNNING = ["row_no", "valid", "wiped", "log_sum"]


def numbered(panel: DataFrame, key: str | None, day: str, r: str, *more: Column) -> DataFrame:
    """Rows of ``panel`` with their place among the key's own rows (from 0), the key's last place, and running counts of known
    returns and of total losses and the running sum of logarithms, from which any stretch's compound return follows."""
    w = (Window.partitionBy(key) if key else Window.partitionBy()).orderBy(day)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x, known = F.col(r), F.col(r).isNotNull() & ~F.isnan(r)
    return panel.select(
        *([key] if key else []), day, (F.row_number().over(w) - 1).alias("row_no"), *more,
        F.sum(known.cast("int")).over(upto).alias("valid"), F.sum(F.coalesce((known & (x <= -1)).cast("int"), F.lit(0))).over(upto).alias("wiped"),
        F.sum(F.when(known & (x > -1), F.log1p(r)).otherwise(0.0)).over(upto).alias("log_sum"),
    )


def compound(a: str, b: str) -> Column:
    """Return from the row whose running columns begin with ``a`` (not included) to that of ``b``; null without any known return."""
    d = lambda c: F.col(f"{b}{c}") - F.col(f"{a}{c}")
    return F.when(d("valid") > 0, F.when(d("wiped") > 0, -1.0).otherwise(F.exp(d("log_sum")) - 1))


def entries(events: DataFrame, panel: DataFrame, bench: DataFrame, key: str, filed: str, day: str, *more: str) -> DataFrame:
    """``events`` with the first own row (e_...) and the first benchmark row (b_...) strictly after ``filed``."""
    last = panel.groupBy(key).agg(F.max("row_no").alias("last_no"))
    at = asof(events, panel, key, filed, day, [*RUNNING, *more], strict=True, forward=True)
    at = at.withColumnsRenamed({f"asof_{c}": f"e_{c}" for c in (day, *RUNNING, *more)}).join(last, key, "left")
    at = next_session(at, bench, filed, out="b_row_no", day=day, no="row_no")
    start = bench.select(F.col("row_no").alias("b_row_no"), *[F.col(c).alias(f"b_{c}") for c in RUNNING[1:]])
    return at.join(F.broadcast(start), "b_row_no", "left").join(F.broadcast(bench.agg(F.max("row_no").alias("b_last_no"))))  # one row a session


def ends(at: DataFrame, panel: DataFrame, bench: DataFrame, key: str, own_end: Column, bench_end: Column) -> DataFrame:
    """``at`` with the running columns of the own row (f_...) and the benchmark row (g_...) at which a path ends."""
    at = at.withColumns({"f_row_no": own_end, "g_row_no": bench_end})
    own = panel.select(F.col(key).alias(key), *[F.col(c).alias(f"f_{c}") for c in RUNNING])
    other = bench.select(*[F.col(c).alias(f"g_{c}") for c in RUNNING])
    return at.join(own, [key, "f_row_no"], "left").join(F.broadcast(other), "g_row_no", "left")  # one row a session


def held_excess(events: DataFrame, panel: DataFrame, bench: DataFrame, key: str, filed: str, day: str, hold: int) -> DataFrame:
    """``events`` with entry_date, lag_cap (of the own row before entry), excess and status of the ``hold`` rows after entry.

    The stock's path runs over its own rows, the benchmark's over its own. missing_entry_close: no own row after the filing;
    calendar_right_censored: the path runs past the data, or either side has no known return in it; else ok.
    """
    at = ends(entries(events, panel, bench, key, filed, day, "lag_cap"), panel, bench, key, F.col("e_row_no") + hold, F.least(F.col("b_row_no") + hold, F.col("b_last_no")))
    excess = compound("e_", "f_") - compound("b_", "g_")
    status = F.when(F.col("e_row_no").isNull(), "missing_entry_close").when(excess.isNotNull(), "ok").otherwise("calendar_right_censored")
    return at.select(*events.columns, F.col(f"e_{day}").alias("entry_date"), F.col("e_lag_cap").alias("lag_cap"), excess.alias("excess"), status.alias("status"))


def betas(panel: DataFrame, bench: DataFrame, key: str, day: str, r: str, m: str, window: int = 252, least: int = 60) -> DataFrame:
    """(key, day, beta, beta_n): slope on the benchmark over the last ``window`` known returns before each row, over the sessions that
    both have; null below ``least`` of them or where the benchmark doesn't move."""
    x = panel.select(key, day, r).join(F.broadcast(bench.select(day, m)), day, "left")  # one row a session
    w = Window.partitionBy(key).orderBy(day)
    own = w.rowsBetween(-(window - 1), 0)
    both = F.when(F.col(m).isNotNull(), F.col(r))
    known = x.where(F.col(r).isNotNull()).select(key, day, F.struct(F.count(both).over(own).alias("n"), F.covar_samp(both, F.col(m)).over(own).alias("c"), F.var_samp(m).over(own).alias("v")).alias("_s"))
    at = panel.select(key, day).join(known, [key, day], "left").withColumn("_b", F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    beta = F.when((F.col("_b.n") >= least) & (F.col("_b.v") > 0), F.col("_b.c") / F.col("_b.v"))
    return at.select(key, day, beta.alias("beta"), F.coalesce("_b.n", F.lit(0)).alias("beta_n"))


def reprice(events: DataFrame, panel: DataFrame, bench: DataFrame, beta: DataFrame, key: str, filed: str, day: str, horizons: list[int]) -> DataFrame:
    """One row per event and horizon: forward return, the benchmark's, their difference, and the part beta doesn't explain.

    Entry is the first own row strictly after the filing; a path that ends early still counts, one without any known return
    doesn't; beta uses returns before entry only.
    """
    at = entries(events, panel, bench, key, filed, day).join(beta.withColumnRenamed(day, f"e_{day}"), [key, f"e_{day}"], "left")
    at = at.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    at = ends(at, panel, bench, key, F.least(F.col("e_row_no") + F.col("horizon"), F.col("last_no")), F.least(F.col("b_row_no") + F.col("horizon"), F.col("b_last_no")))
    own = F.when(F.col("e_row_no").isNotNull(), compound("e_", "f_"))
    other = F.when(F.col("e_row_no").isNotNull(), compound("b_", "g_"))
    return at.select(
        *events.columns, "horizon", F.col(f"e_{day}").alias("entry_date"), own.alias("forward"), other.alias("bench_forward"), (own - other).alias("abnormal"),
        (own - F.col("beta") * other).alias("residual"), "beta", F.coalesce("beta_n", F.lit(0)).alias("beta_n"),
    )


def missing_firm_events(have: DataFrame, universe: DataFrame, submissions: DataFrame, transactions: DataFrame, owners: DataFrame) -> DataFrame:
    """Purchases and sales, from filings, of firms that no event in ``have`` (security_id) belongs to.

    ``universe`` has issuer_id, security_id, start, end and eligible. A firm is an issuer without any covered security; it is
    represented by its smallest one, and only events filed within an eligible interval of that stay. So an issuer comes
    from one source only.
    """
    known = have.select("security_id").distinct()
    covered = universe.join(known, "security_id", "left_semi").select("issuer_id").distinct()
    target = universe.join(covered, "issuer_id", "left_anti").groupBy("issuer_id").agg(F.min("security_id").alias("security_id"))
    filed = submissions.where("form = '4'").join(target, "issuer_id").select("accession", "issuer_id", "security_id", "filing_date")
    done = transactions.where("trans_code IN ('P', 'S')").select("accession", "row_id", "trans_date", "trans_code", F.col("trans_shares").alias("shares"))
    rows = done.join(filed, "accession").join(owners.select("accession", F.col("owner_cik").alias("owner_id")), "accession", "left")
    inside = universe.where("eligible").select("security_id", "start", "end")
    days = rows.select("security_id", "filing_date").distinct().join(inside, "security_id").where("filing_date BETWEEN start AND end").select("security_id", "filing_date").distinct()
    side = F.when(F.col("trans_code") == "P", 1).otherwise(-1)
    return rows.join(days, ["security_id", "filing_date"], "left_semi").select("issuer_id", "security_id", "owner_id", "accession", "row_id", "trans_date", "filing_date", side.alias("side"), "shares")
