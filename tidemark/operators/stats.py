"""Clustered inference: sums by cluster on Spark, one row per group at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import student


def _cells(known: DataFrame, by: list[str], value: str, first: str, second: str, *more: str) -> DataFrame:
    """One row a pair of clusters (and values of ``more``): rows, their mean and the sum of squares about it. All that
    follows reads these cells, so the rows themselves are aggregated once."""
    own = known.groupBy(*by, first, second, *more)
    return own.agg(F.count("*").alias("_n"), F.avg(value).alias("_m"), (F.var_pop(value) * F.count("*")).alias("_w"))


def _against(cells: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """Cells beside their group's totals, one row a group; without groups the totals are a single row."""
    return cells.join(totals, by) if by else cells.crossJoin(F.broadcast(totals))


def _cluster_vars(scored: DataFrame, by: list[str], first: str, second: str) -> DataFrame:
    """Per group: numbers of clusters g_a and g_b and the three variances v_a, v_b, v_ab of the sums of ``_s``, each
    G / (G - 1) times the sum of squared cluster sums, null below two clusters. One pass, by grouping sets."""
    sets = [[*by, first], [*by, second], [*by, first, second]]
    sums = scored.groupingSets(sets, *by, first, second).agg(F.sum("_s").alias("_s"), F.grouping(first).alias("_no_a"), F.grouping(second).alias("_no_b"))
    out = []
    for name, which in (("a", F.col("_no_b") == 1), ("b", F.col("_no_a") == 1), ("ab", F.col("_no_a") + F.col("_no_b") == 0)):
        g = F.count_if(which)
        out += [g.alias(f"g_{name}"), F.when(g > 1, F.sum(F.when(which, F.col("_s") * F.col("_s"))) * g / (g - 1)).alias(f"v_{name}")]
    return sums.groupBy(*by).agg(*out)


def _joined(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    return left.join(right, by) if by else left.crossJoin(right)  # without groups each side is one row


def inference(df: DataFrame, effect: str, se: str = "se", t: str = "t", degrees: str = "df") -> DataFrame:
    """``df`` plus the two-sided p of ``t`` and a 95 % interval of ``effect``; null where there is no t or no degrees of
    freedom. For result rows."""
    half = student.critical(F.col(degrees)) * F.col(se)
    with_p = df.withColumn("p", student.p_value(F.col(t), F.col(degrees))).withColumn("_half", half)
    return with_p.withColumn("ci_low", F.col(effect) - F.col("_half")).withColumn("ci_high", F.col(effect) + F.col("_half")).drop("_half")


def clustered_mean(df: DataFrame, by: list[str], value: str, first: str, second: str) -> DataFrame:
    """Mean of ``value`` with two-way clustered standard error, t, degrees of freedom, p and interval, per group of ``by``.

    V = V_first + V_second - V_both, each G / (G - 1) times the sum of squared cluster scores, not below 0; no standard
    error below two clusters of either kind. Rows with null values take no part; df is the smaller number of clusters less one.
    """
    cells = _cells(df.where(F.col(value).isNotNull()), by, value, first, second)
    n = F.sum("_n")
    means = cells.groupBy(*by).agg(n.alias("n"), (F.sum(F.col("_n") * F.col("_m")) / n).alias("mean"))
    scored = _against(cells, means, by).withColumn("_s", F.col("_n") * (F.col("_m") - F.col("mean")) / F.col("n"))
    out = _joined(means, _cluster_vars(scored, by, first, second), by)
    v = F.col("v_a") + F.col("v_b") - F.col("v_ab")
    out = out.withColumn("se", F.sqrt(F.when(v < 0, 0.0).otherwise(v))).withColumn("df", F.least("g_a", "g_b") - 1)
    out = out.withColumn("t", F.when(F.col("se") > 0, F.col("mean") / F.col("se")))
    return inference(out, "mean").select(*by, "n", "mean", "se", "t", "df", "p", "ci_low", "ci_high")


def clustered_contrast(df: DataFrame, by: list[str], value: str, arm: str, first: str, second: str) -> DataFrame:
    """Mean of arm 1 less mean of arm 0 with two-way clustered standard error (each part G/(G-1) (N-1)/(N-2)), t, p, interval."""
    cells = _cells(df.where(F.col(value).isNotNull() & F.col(arm).isin(0, 1)), by, value, first, second, arm)
    m = _arms(cells, by, arm)
    scored = _against(cells, m, by).withColumn("_s", _arm_score(arm))
    out = _joined(m, _cluster_vars(scored, by, first, second), by)
    n = F.col("n1") + F.col("n0")
    v = (F.col("v_a") + F.col("v_b") - F.col("v_ab")) * (n - 1) / (n - 2)
    out = out.withColumn("estimate", F.col("m1") - F.col("m0")).withColumn("se", F.sqrt(F.when(v < 0, 0.0).otherwise(v))).withColumn("df", F.least("g_a", "g_b") - 1)
    out = out.withColumn("t", F.when(F.col("se") > 0, F.col("estimate") / F.col("se")))
    return inference(out, "estimate").select(*by, "n1", "n0", "estimate", "se", "t", "df", "p", "ci_low", "ci_high")


def _arms(cells: DataFrame, by: list[str], arm: str, *more: Column) -> DataFrame:
    """Rows and means of the two arms, one row a group."""
    n = lambda a: F.sum(F.when(F.col(arm) == a, F.col("_n")).otherwise(0))
    m = lambda a: F.sum(F.when(F.col(arm) == a, F.col("_n") * F.col("_m"))) / F.sum(F.when(F.col(arm) == a, F.col("_n")))
    return cells.groupBy(*by).agg(n(1).alias("n1"), n(0).alias("n0"), m(1).alias("m1"), m(0).alias("m0"), *more)


def _arm_score(arm: str) -> Column:
    one = F.col("_n") * (F.col("_m") - F.col("m1")) / F.col("n1")
    return F.when(F.col(arm) == 1, one).otherwise(-F.col("_n") * (F.col("_m") - F.col("m0")) / F.col("n0"))


def holm(df: DataFrame, p: str, key: str, by: list[str]) -> DataFrame:
    """Step-down adjusted p within each group of ``by`` (small families of tests)."""
    from pyspark.sql import Window

    fam, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(p, key)
    step = F.col(p) * (F.count("*").over(fam) - F.row_number().over(order) + 1)
    return df.withColumn("_x", step).withColumn(
        "p_holm", F.least(F.lit(1.0), F.max("_x").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ).drop("_x")


def newey_west(series: DataFrame, by: list[str], value: str, order: str, lags: int = 6) -> DataFrame:
    """Mean and t of a time series per group: Bartlett weights, autocovariances divided by n. Fewer than three values give no t."""
    from pyspark.sql import Window

    mean = series.join(series.groupBy(*by).agg(F.avg(value).alias("_m"), F.count(value).alias("_n")), by)
    d = mean.withColumn("_d", F.col(value) - F.col("_m"))
    w = Window.partitionBy(*by).orderBy(order)
    total = F.sum(F.col("_d") * F.col("_d"))
    cols = [F.col("_d") * F.lag("_d", k).over(w) for k in range(1, lags + 1)]
    d = d.select("*", *[c.alias(f"_c{k + 1}") for k, c in enumerate(cols)])
    for k in range(1, lags + 1):
        total = total + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"_c{k}"), F.lit(0.0))
    out = d.groupBy(*by, "_m", "_n").agg((total / F.first("_n")).alias("_v"))
    return out.select(*by, F.col("_n").alias("n"), F.col("_m").alias("mean"), F.when((F.col("_v") > 0) & (F.col("_n") >= 3), F.col("_m") / F.sqrt(F.col("_v") / F.col("_n"))).alias("t"))


def perf_stats(series: DataFrame, by: list[str], date: str, r: str, bench: str, freq: int, least: int = 20) -> DataFrame:
    """Performance of return series, one row per group of at least ``least`` known returns (above -1) with benchmark returns beside them.

    Growth is annualised over ``freq`` periods; volatility, Sharpe ratio, Newey-West t, hit rate and the fit on the benchmark use
    compounded months, of which those without returns count as 0, as does a missing benchmark return. The fit needs more than 12 months;
    alpha's t takes the residuals' standard deviation over the root of their number. The drawdown is along the single returns.
    """
    from pyspark.sql import Window

    x = series.where(F.col(r).isNotNull()).select(*by, date, F.log1p(r).alias("_l"), F.log1p(F.coalesce(bench, F.lit(0.0))).alias("_b"))
    run = Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_cum", F.sum("_l").over(run)).withColumn("_top", F.max("_cum").over(run))
    whole = x.groupBy(*by).agg(F.count("*").alias("n"), F.sum("_l").alias("_all"), F.min(F.exp(F.col("_cum") - F.col("_top")) - 1).alias("max_drawdown"), F.min(date).alias("first_day"), F.max(date).alias("last_day"))
    whole = whole.where(F.col("n") >= least)
    months = whole.select(*by, F.explode(F.sequence(F.trunc("first_day", "MM"), F.trunc("last_day", "MM"), F.expr("INTERVAL 1 MONTH"))).alias("_month"))
    sums = x.groupBy(*by, F.trunc(date, "MM").alias("_month")).agg(F.sum("_l").alias("_l"), F.sum("_b").alias("_b"))
    m = months.join(sums, [*by, "_month"], "left").select(*by, "_month", F.expm1(F.coalesce("_l", F.lit(0.0))).alias("_s"), F.expm1(F.coalesce("_b", F.lit(0.0))).alias("_m"))
    fit = F.count("*") > 12
    of_months = m.groupBy(*by).agg(
        F.count("*").alias("months"), (F.stddev_samp("_s") * 12**0.5).alias("ann_vol"), (F.avg("_s") * 12).alias("_mean"), F.avg((F.col("_s") > 0).cast("int")).alias("hit_month"),
        F.when(fit, F.regr_slope("_s", "_m")).alias("beta"), F.when(fit, F.regr_intercept("_s", "_m")).alias("_a"), (F.stddev_samp("_s") * F.sqrt(1 - F.regr_r2("_s", "_m")) / F.sqrt(F.count("*"))).alias("_e"),
    )
    nw = newey_west(m.select(*by, "_month", "_s"), by, "_s", "_month").select(*by, F.col("t").alias("t_nw"))
    out = whole.join(of_months, by).join(nw, by, "left")
    return out.select(
        *by, "n", "months", (F.exp(F.col("_all") * freq / F.col("n")) - 1).alias("cagr"), "ann_vol", F.when(F.col("ann_vol") > 0, F.col("_mean") / F.col("ann_vol")).alias("sharpe"), "t_nw", "max_drawdown", "hit_month",
        "beta", (F.pow(1 + F.col("_a"), 12) - 1).alias("alpha_ann"), F.when(F.col("_e") > 0, F.col("_a") / F.col("_e")).alias("alpha_t"), "first_day", "last_day",
    )


COMPONENTS = ("two_way", "issuer", "quarter", "hc1")
NEAR = 1e-9
"""Variances that differ by less than this share are equal: sums depend on the order of rows."""


def floored(scored: DataFrame, by: list[str], first: str, second: str, k: int) -> DataFrame:
    """Per group: n, clusters g1 and g2, and the largest of four variances of an estimate with ``k`` parameters.

    ``scored`` holds ``_n`` rows, their score ``_s`` and the sum of their squared scores ``_q``. The four are the two-way and the
    two one-way clustered variances, each with G / (G - 1) * (n - 1) / (n - k), and the robust one with n / (n - k). ``source``
    names the largest (the first of equals), ``status`` is ok, or says why there is no variance.
    """
    base = scored.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum("_q").alias("_ss"))
    out = _joined(base, _cluster_vars(scored, by, first, second), by)
    n = F.col("n")
    many = F.when(n > k, (n - 1) / (n - k))
    parts = {"two_way": (F.col("v_a") + F.col("v_b") - F.col("v_ab")) * many, "issuer": F.col("v_a") * many, "quarter": F.col("v_b") * many, "hc1": F.col("_ss") * F.when(n > k, n / (n - k))}
    out = out.withColumns({f"_{c}": v for c, v in parts.items()}).withColumn("_v", F.greatest(*[f"_{c}" for c in COMPONENTS]))
    source = F.lit(None).cast("string")
    for c in reversed(COMPONENTS):
        source = F.when(F.col(f"_{c}") >= F.col("_v") * (1 - NEAR), c).otherwise(source)
    few = (F.col("g_a") < 2) | (F.col("g_b") < 2)
    status = F.when(n < 2, "too_few").when(few, "insufficient_clusters").when(~F.coalesce(F.col("_v") > 0, F.lit(False)), "degenerate_variance").otherwise("ok")
    return out.select(*by, "n", F.col("g_a").alias("issuers"), F.col("g_b").alias("quarters"), F.when(status == "ok", F.sqrt("_v")).alias("se"), F.when(status == "ok", source).alias("source"), status.alias("status"))


def floored_mean(df: DataFrame, by: list[str], value: str, first: str, second: str) -> DataFrame:
    """Mean with the floored standard error, t, degrees of freedom, p and interval. Null values take no part."""
    cells = _cells(df.where(F.col(value).isNotNull()), by, value, first, second)
    means = cells.groupBy(*by).agg((F.sum(F.col("_n") * F.col("_m")) / F.sum("_n")).alias("mean"), F.sum("_n").alias("_all"))
    d = F.col("_m") - F.col("mean")
    scored = _against(cells, means, by).withColumn("_s", F.col("_n") * d / F.col("_all")).withColumn("_q", (F.col("_w") + F.col("_n") * d * d) / (F.col("_all") * F.col("_all")))
    out = _joined(means.drop("_all"), floored(scored, by, first, second, 1), by)
    ok = F.col("status") == "ok"
    out = out.withColumn("t", F.when(ok, F.col("mean") / F.col("se"))).withColumn("df", F.when(ok, F.least("issuers", "quarters") - 1))
    return inference(out, "mean").select(*by, "n", "issuers", "quarters", "mean", "se", "source", "t", "df", "p", "ci_low", "ci_high", "status")


def floored_contrast(df: DataFrame, by: list[str], value: str, arm: str, first: str, second: str) -> DataFrame:
    """Mean of arm 1 less that of arm 0 with the floored standard error, t, p and interval; df from the arm with the fewest clusters."""
    cells = _cells(df.where(F.col(value).isNotNull() & F.col(arm).isin(0, 1)), by, value, first, second, arm)
    one, none = F.col(arm) == 1, F.col(arm) == 0
    count = lambda c, a, n: F.countDistinct(F.when(a, F.col(c))).alias(n)
    m = _arms(cells, by, arm, count(first, one, "_f1"), count(first, none, "_f0"), count(second, one, "_s1"), count(second, none, "_s0"))
    own = F.when(one, F.col("m1")).otherwise(F.col("m0"))
    size = F.when(one, F.col("n1")).otherwise(F.col("n0"))
    d = F.col("_m") - own
    scored = _against(cells, m, by).withColumn("_s", _arm_score(arm)).withColumn("_q", (F.col("_w") + F.col("_n") * d * d) / (size * size))
    out = _joined(m, floored(scored, by, first, second, 2), by)
    df_ = F.least("_f1", "_f0", "_s1", "_s0") - 1
    status = F.when((F.col("n1") < 2) | (F.col("n0") < 2) | (df_ < 1), "insufficient_support").otherwise(F.col("status"))
    ok, estimate = status == "ok", F.col("m1") - F.col("m0")
    out = out.select(*by, "n1", "n0", estimate.alias("estimate"), F.when(ok, F.col("se")).alias("se"), F.when(ok, F.col("source")).alias("source"), F.when(ok, estimate / F.col("se")).alias("t"), F.when(ok, df_).alias("df"), status.alias("status"))
    return inference(out, "estimate").select(*by, "n1", "n0", "estimate", "se", "source", "t", "df", "p", "ci_low", "ci_high", "status")


def controlled_mean(df: DataFrame, by: list[str], value: str, arm: str, controls: tuple[str, str], first: str, second: str, least: int = 10) -> DataFrame:
    """Intercept of arm 1's values on two controls centred at arm 0's means, complete cases, floored standard error.

    The normal equations of two regressors are solved from their moment sums; a row's share in the intercept's error is
    its residual times 1 / n - zbar' S^-1 (z - zbar). Fewer than ``least`` rows in an arm, or collinear controls, give no estimate.
    """
    a, b = controls
    known = df.where(F.col(value).isNotNull() & F.col(arm).isin(0, 1) & F.col(a).isNotNull() & F.col(b).isNotNull())
    centre = known.groupBy(*by).agg(*[F.avg(F.when(F.col(arm) == 0, F.col(c))).alias(f"_c_{c}") for c in controls], F.count_if(F.col(arm) == 0).alias("n0"))
    x = known.where(F.col(arm) == 1).join(centre, by).withColumns({"_x": F.col(a) - F.col(f"_c_{a}"), "_z": F.col(b) - F.col(f"_c_{b}"), "_y": F.col(value)})
    m = x.groupBy(*by).agg(
        F.count("*").alias("_n"), F.avg("_x").alias("_mx"), F.avg("_z").alias("_mz"), F.avg("_y").alias("_my"),
        *[F.covar_pop(p, q).alias(f"_s{p[1]}{q[1]}") for p, q in (("_x", "_x"), ("_x", "_z"), ("_z", "_z"), ("_x", "_y"), ("_z", "_y"))],
    )
    det = F.col("_sxx") * F.col("_szz") - F.col("_sxz") * F.col("_sxz")
    m = m.withColumn("_det", F.when(det > 0, det))
    m = m.withColumn("_bx", (F.col("_sxy") * F.col("_szz") - F.col("_szy") * F.col("_sxz")) / F.col("_det")).withColumn("_bz", (F.col("_szy") * F.col("_sxx") - F.col("_sxy") * F.col("_sxz")) / F.col("_det"))
    m = m.withColumn("_b0", F.col("_my") - F.col("_bx") * F.col("_mx") - F.col("_bz") * F.col("_mz"))
    rows = x.join(m, by)
    dx, dz = F.col("_x") - F.col("_mx"), F.col("_z") - F.col("_mz")
    pull = (F.col("_mx") * (F.col("_szz") * dx - F.col("_sxz") * dz) + F.col("_mz") * (F.col("_sxx") * dz - F.col("_sxz") * dx)) / F.col("_det")
    residual = F.col("_y") - F.col("_b0") - F.col("_bx") * F.col("_x") - F.col("_bz") * F.col("_z")
    score = residual * (1 - pull) / F.col("_n")
    scored = rows.withColumn("_s", score).groupBy(*by, first, second).agg(F.count("*").alias("_n"), F.sum("_s").alias("_s"), F.sum(F.col("_s") * F.col("_s")).alias("_q"))
    out = floored(scored, by, first, second, 3).join(m, by).join(centre, by)
    few = (F.col("n") < least) | (F.col("n0") < least)
    status = F.when(few, "insufficient_complete_cases").otherwise(F.col("status"))
    ok = status == "ok"
    shown = lambda c: F.when(ok, c)
    return out.select(*by, "n", "n0", shown(F.col("_b0")).alias("intercept"), shown(F.col("se")).alias("se"), shown(F.col("source")).alias("source"), shown(F.col("_b0") / F.col("se")).alias("t"), shown(F.col("_bx")).alias("slope_1"), shown(F.col("_bz")).alias("slope_2"), status.alias("status"))


def drawn(draw: Column, slot: Column, n: Column, seed: int) -> Column:
    """A number from 0 to n - 1, the same in every engine: a linear congruence of draw and slot."""
    z = (draw * 7919 + slot * 104729 + seed) * 1103515245 + 12345
    return F.floor(F.pmod(z, F.lit(2147483648)) / 65536).cast("long") % n


def multiplicities(names: DataFrame, name: str, draws: int, seed: int) -> DataFrame:
    """(draw, name, w): how often each of the G rows of ``names`` is taken in G picks with replacement, for every draw.

    The table is as large as draws x G, dealt by draw; rows not taken are left out.
    """
    from pyspark.sql import Window

    numbered = names.select(name, (F.row_number().over(Window.orderBy(name)) - 1).cast("long").alias("k"))  # one row a cluster
    size = numbered.agg(F.count("*").alias("_g"))
    picks = names.sparkSession.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(size)).where("_g > 0")  # one row
    picks = picks.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_g") - 1)))
    taken = picks.select("draw", drawn(F.col("draw"), F.col("slot"), F.col("_g"), seed).alias("k")).groupBy("draw", "k").agg(F.count("*").alias("w"))
    return taken.join(numbered, "k").select("draw", name, "w")


def block_multiplicities(blocks: int, draws: int, seed: int):
    """Column expression builder for circular blocks of two: (draw, slot) -> the block number taken, slot 0 to blocks - 1."""
    return lambda draw, slot: F.pmod(drawn(draw, F.floor(slot / 2), F.lit(blocks), seed) + slot % 2, F.lit(blocks))
