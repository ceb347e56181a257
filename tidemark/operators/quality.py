"""Data-quality operators: flags are attached, rows are never dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import asof


def large_trade(value: Column, cap_lag: Column, adv_lag: Column, share: float = 0.01) -> Column:
    return F.coalesce(value > share * cap_lag, F.lit(False)) | F.coalesce(value > adv_lag, F.lit(False))


def price_status(price: Column, low: Column, high: Column, tolerance: float = 0.01) -> Column:
    """Where a price lies against a day's range; bad bounds are no market."""
    usable = (low > 0) & (high >= low)
    return (
        F.when(price.isNull(), "no_price").when(price <= 0, "non_positive").when(~F.coalesce(usable, F.lit(False)), "no_data")
        .when(price < low * (1 - tolerance), "below").when(price > high * (1 + tolerance), "above").otherwise("pass")
    )


def transaction_flags(rows: DataFrame) -> DataFrame:
    """``rows`` plus the transaction checks, each true or false, and ``status`` of the price against the day's range.

    Needs transaction_code, acquired_disposed, filing_date, transaction_date, price, shares, low, high, cap_lag and adv.
    A purchase must acquire and a sale dispose; an unknown filing lag counts as after filing; prices are compared
    where price and bounds are positive only.
    """
    code, side, price, low, high = (F.col(c) for c in ("transaction_code", "acquired_disposed", "price", "low", "high"))
    lag = F.datediff("filing_date", "transaction_date")
    comparable = (price > 0) & (low > 0) & (high > 0)
    known = lambda c, default=False: F.coalesce(c, F.lit(default))
    checks = {
        "direction": ~known(((code == "P") & (side == "A")) | ((code == "S") & (side == "D"))),
        "after_filing": known(lag < 0, True),
        "late": known(lag > 30),
        "outside_range": known(comparable & ((price < 0.99 * low) | (price > 1.01 * high))),
        "scale_error": known(comparable & ((price >= 10 * high) | (price <= low / 10))),
        "large_trade": large_trade(F.abs("shares") * F.abs(price), F.col("cap_lag"), F.col("adv")),
        "status": price_status(price, low, high),
    }
    return rows.withColumns(checks)


def price_ranges(rows: DataFrame, price: str, low: str, high: str, wide_low: str, wide_high: str, tolerance: float = 0.01) -> DataFrame:
    """``rows`` plus within_day, within_week, below_week, above_week and, below the wide range, the ratio to its low."""
    p, down, up = F.col(price), 1 - tolerance, 1 + tolerance
    below = p < down * F.col(wide_low)
    return rows.withColumns({
        "within_day": p.between(down * F.col(low), up * F.col(high)), "within_week": p.between(down * F.col(wide_low), up * F.col(wide_high)),
        "below_week": below, "above_week": p > up * F.col(wide_high), "ratio_to_week_low": F.when(below, p / F.col(wide_low)),
    })


def split_factor_between(rows: DataFrame, splits: DataFrame, key: str, prev: str, now: str, row_key: list[str]) -> DataFrame:
    """Product of the factors with prev < effective_date <= now."""
    j = rows.join(splits, key, "left")
    hit = (F.col("effective_date") > F.col(prev)) & (F.col("effective_date") <= F.col(now))
    return j.groupBy(*row_key).agg(F.product(F.when(hit, F.col("split_factor")).otherwise(F.lit(1.0))).alias("factor"))


def price_ladder(rows: DataFrame, market: DataFrame, key: str, date: str, price: str, comparable: Column, parsed: Column | None = None, days: int = 7) -> DataFrame:
    """``rows`` plus status, matched window and signed distance of the price from the window's nearest bound.

    Windows, narrowest first: the day itself; the observations next to it on either side, each at most ``days`` days away, with the day;
    the week from Monday to Sunday. A price passes in the first window that holds it, bounds included, else it is flagged against the widest
    one that has any. Only bounds that are finite, above 0 and in order count; an observation without such bounds still is the
    nearest one. ``market`` has (key, day, low, high), one row a day. Rows that can't be compared say why, in the order in which they
    are checked; ``parsed`` is false where the document wasn't read whole.
    """
    good = (F.col("low") > 0) & (F.col("high") >= F.col("low")) & (F.col("high") < float("inf")) & ~F.isnan("high")
    m = market.select(F.col(key).alias("_k"), F.col("day").alias("_day"), *[F.when(good, F.col(c)).alias(f"_{c}") for c in ("low", "high")])
    asked = rows.select(F.col(key).alias("_k"), F.col(date).alias("_t")).where("_k IS NOT NULL AND _t IS NOT NULL").distinct()
    near = asof(asked, m, "_k", "_t", "_day", ["_low", "_high"], strict=True, tolerance=days).withColumnsRenamed({"asof__low": "b_low", "asof__high": "b_high"}).drop("asof__day")
    near = asof(near, m, "_k", "_t", "_day", ["_low", "_high"], strict=True, tolerance=days, forward=True).withColumnsRenamed({"asof__low": "f_low", "asof__high": "f_high"}).drop("asof__day")
    near = near.join(m.select("_k", F.col("_day").alias("_t"), F.col("_low").alias("x_low"), F.col("_high").alias("x_high")), ["_k", "_t"], "left")
    monday = lambda c: F.date_trunc("week", c).cast("date")
    weeks = m.groupBy("_k", monday("_day").alias("_week")).agg(F.min("_low").alias("w_low"), F.max("_high").alias("w_high"))
    near = near.withColumn("_week", monday("_t")).join(weeks, ["_k", "_week"], "left").drop("_week")
    near = near.withColumns({"a_low": F.least("b_low", "x_low", "f_low"), "a_high": F.greatest("b_high", "x_high", "f_high")})
    j = rows.join(near, (rows[key] == near["_k"]) & (rows[date] == near["_t"]), "left")
    p, windows = F.col(price), (("exact_day", "x", "EXACT"), ("adjacent_trading_days", "a", "ADJACENT"), ("calendar_week", "w", "WEEKLY"))
    inside = lambda w: F.coalesce(p.between(F.col(f"{w}_low"), F.col(f"{w}_high")), F.lit(False))
    found, passed = F.lit(None).cast("string"), {"x": "PASS_EXACT_DAY_RANGE", "a": "PASS_ADJACENT_DAY_RANGE", "w": "PASS_WEEKLY_RANGE"}
    for name, w, _ in windows:  # the widest with bounds
        found = F.when(F.col(f"{w}_low").isNotNull(), name).otherwise(found)
    for name, w, _ in reversed(windows):
        found = F.when(inside(w), name).otherwise(found)
    status = (
        F.when(~parsed, "NOT_TESTABLE_PARSE_STATUS") if parsed is not None else F.when(F.lit(False), "")
    ).when(~F.coalesce(comparable, F.lit(False)), "NOT_MARKET_COMPARABLE").when(p.isNull(), "NO_REPORTED_PRICE").when(p <= 0, "NONPOSITIVE_REPORTED_PRICE")
    status = status.when(F.col(date).isNull(), "NO_TRANSACTION_DATE").when(F.col(key).isNull(), "NO_SECURITY_IDENTIFIER").when(found.isNull(), "NO_MARKET_DATA")
    for _, w, _ in windows:
        status = status.when(inside(w), passed[w])
    for name, _, label in windows:
        status = status.when(F.col("_found") == name, f"FLAG_OUTSIDE_{label}_RANGE")
    j = j.withColumn("_found", found).withColumn("status", status)
    compared = F.col("status").startswith("PASS") | F.col("status").startswith("FLAG")
    bound = lambda side: F.coalesce(*[F.when(F.col("_found") == name, F.col(f"{w}_{side}")) for name, w, _ in windows])
    distance = F.when(p < bound("low"), p - bound("low")).when(p > bound("high"), p - bound("high")).otherwise(0.0)
    return j.withColumn("matched", F.when(compared, F.col("_found"))).withColumn("distance", F.when(compared, distance)).select(*[rows[c] for c in rows.columns], "status", "matched", "distance")
