"""Queries of signals, portfolios and further statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import returns, signals, stats
from .fixtures import fx, with_views
from .study import E1_SQL, at_horizons, events, outcomes
from .windows import R, with_r

r6 = lambda c, n: F.round(c, 6).alias(n)
tx = lambda s, d: fx(s, d, "fx_transactions")


def e8(s, d):
    e = tx(s, d).where("transaction_code = 'P' AND NOT is_amendment").groupBy("issuer_id", "filing_date").agg(F.sum(F.col("shares") * F.col("price")).alias("dollars"))
    return signals.prior_years_terciles(e, "filing_date", "dollars").select("issuer_id", "filing_date", F.col("tercile").cast("long").alias("tercile"))


E8_SQL = """e AS (SELECT issuer_id, filing_date, sum(shares * price) AS v FROM fx_transactions WHERE transaction_code = 'P' AND NOT is_amendment GROUP BY 1, 2),
c AS (SELECT y.y, quantile_cont(v, 1.0 / 3) AS a, quantile_cont(v, 2.0 / 3) AS b FROM (SELECT DISTINCT year(filing_date) AS y FROM e) y JOIN e ON year(filing_date) < y.y GROUP BY 1),
e8 AS (SELECT issuer_id, filing_date, CASE WHEN a IS NULL THEN NULL WHEN v <= a THEN 1 WHEN v <= b THEN 2 ELSE 3 END AS tercile FROM e LEFT JOIN c ON c.y = year(filing_date))"""


def e10(s, d):
    p = e8(s, d).withColumn("signal", F.when(F.col("tercile") == 1, "S1"))
    buys = p.where("signal IS NOT NULL").select("signal", "filing_date").unionByName(p.select(F.lit("S2").alias("signal"), "filing_date"))
    sells = tx(s, d).where("transaction_code = 'S' AND NOT is_amendment").select("issuer_id", "filing_date").distinct().select(F.lit("S3").alias("signal"), "filing_date")
    return buys.unionByName(sells).groupBy("signal", F.year("filing_date").cast("long").alias("year")).agg(F.count("*").alias("n"))


def e17(s, d):
    g = tx(s, d).where("transaction_code = 'P'").groupBy("issuer_id", "filing_date").agg(F.avg("price").alias("p"), F.sum("shares").alias("v"), F.countDistinct("owner_id").alias("k"), F.min(F.col("owner_id") % 5).alias("o"))
    return g.select("issuer_id", "filing_date", signals.conviction_score(F.col("p") < 1800, F.col("v") > 40, F.col("k") >= 2, F.col("o") == 0).cast("long").alias("score"))


def e19(s, d):
    e = tx(s, d).where("transaction_code IN ('P', 'S') AND shares > 48").groupBy(F.col("issuer_id").alias("security_id"), F.date_trunc("week", "filing_date").cast("date").alias("session_date")).agg(F.sum(F.when(F.col("transaction_code") == "P", 1.0).otherwise(-1.0)).alias("weight"))
    e = e.join(F.broadcast(fx(s, d, "fx_calendar")), "session_date").select("security_id", "session_no", "weight")
    return signals.calendar_time_portfolio(with_r(s, d), e, "security_id", "session_no", "r", 6).select("session_no", r6(F.col("gross"), "gross"), r6(F.col("day_return"), "day_return"))


def e20(s, d):
    return signals.issuer_excluded_mean(with_r(s, d), "session_no", "r", 0.99).select("security_id", "session_no", r6(F.col("others_mean"), "others_mean"))


def e2(s, d):
    """Returns of available rows after entry up to h, a short path still counts."""
    w = Window.partitionBy("security_id").orderBy("session_no").rowsBetween(1, 21)
    return with_r(s, d).select("security_id", "session_no", r6(F.exp(F.sum(F.ln(1 + F.col("r"))).over(w)) - 1, "forward_21"))


PATH = range(1, 64)


def e5(s, d):
    """Average excess path over 63 sessions: a running mean of complete paths at each horizon, from 0 at entry."""
    o = returns.event_returns(events(s, d), fx(s, d, "fx_daily"), fx(s, d, "fx_benchmark"), fx(s, d, "fx_calendar"), [*PATH])
    path = o.groupBy("horizon").agg(F.count("excess_return").alias("n"), r6(F.avg("excess_return"), "mean_excess"))
    return path.unionByName(events(s, d).agg(F.lit(0).alias("horizon"), F.count("*").alias("n"), F.lit(0.0).alias("mean_excess")))


def e6(s, d):
    periods = s.createDataFrame([("early", 1995, 1998), ("late", 1999, 2005)], "period string, a int, b int")
    o = outcomes(s, d).join(F.broadcast(periods), F.year("filing_date").between(F.col("a"), F.col("b"))).withColumn("month", F.trunc("filing_date", "MM"))
    return stats.clustered_mean(o, ["period", "horizon"], "excess_return", "security_id", "month").select("period", "horizon", "n", *[r6(F.col(c), c) for c in ("mean", "se")])


def e18(s, d):
    sc = e17(s, d).groupBy("issuer_id", F.trunc("filing_date", "MM").alias("month")).agg(F.sum("score").alias("score"))
    c = sc.groupBy("month").agg(F.expr("percentile(score, array(1/3D, 2/3D))").alias("c"), F.count("*").alias("firms"), F.countDistinct("score").alias("k"))
    m = with_r(s, d).groupBy(F.col("security_id").alias("issuer_id"), F.trunc("session_date", "MM").alias("m2")).agg((F.exp(F.sum(F.ln(1 + F.col("r")))) - 1).alias("r"))
    x = sc.join(F.broadcast(c), "month").where("firms >= 6 AND k >= 3").withColumn("m2", F.add_months("month", 1)).join(m, ["issuer_id", "m2"])
    hi, lo = F.col("score") >= F.col("c")[1], F.col("score") <= F.col("c")[0]
    g = x.groupBy("month").agg(F.count_if(hi).alias("n_long"), F.count_if(lo).alias("n_short"), F.avg(F.when(hi, F.col("r"))).alias("a"), F.avg(F.when(lo, F.col("r"))).alias("b"))
    w = Window.orderBy("session_no")  # one row a session
    bench = fx(s, d, "fx_benchmark").withColumn("l", F.ln(F.col("level") / F.lag("level").over(w))).groupBy(F.trunc("session_date", "MM").alias("m2")).agg((F.exp(F.sum("l")) - 1).alias("bench"))
    legs = g.where("n_long >= 2 AND n_short >= 2").withColumn("m2", F.add_months("month", 1)).join(F.broadcast(bench), "m2", "left")
    return legs.select("month", "n_long", "n_short", r6(F.col("a") - F.col("b"), "long_short"), r6(F.col("a") - F.col("bench"), "long_excess"))


def monthly(s, d):
    return with_r(s, d).groupBy("security_id", F.trunc("session_date", "MM").alias("month")).agg(F.avg("r").alias("r"))


def s10(s, d):
    return stats.newey_west(monthly(s, d).where("r IS NOT NULL"), ["security_id"], "r", "month").select("security_id", "n", r6(F.col("mean"), "mean"), r6(F.col("t"), "t"))


def s11(s, d):
    """Weekly series against the benchmark."""
    b = fx(s, d, "fx_benchmark").withColumn("m", F.col("level") / F.lag("level").over(Window.orderBy("session_no")) - 1).select("session_no", "m")  # one row a session
    x = with_r(s, d).join(F.broadcast(b), "session_no", "left")
    p = stats.perf_stats(x, ["security_id"], "session_date", "r", "m", 52)
    return p.select("security_id", "n", "months", *[r6(F.col(c), c) for c in ("cagr", "ann_vol", "sharpe", "t_nw", "max_drawdown", "hit_month", "beta", "alpha_ann", "alpha_t")], "first_day", "last_day")


HALVES = "1998-07-01"


def s13(s, d):
    """How far a mean hangs on few issuers or on one half of the time: leave-one-issuer-out range, the largest issuer's share of events,
    the means before and from a declared day, the issuer bootstrap's interval, and a flag for each."""
    o = outcomes(s, d).where("horizon = 1 AND excess_return IS NOT NULL").withColumn("late", F.col("filing_date") >= F.lit(HALVES).cast("date"))
    c = o.groupBy("security_id").agg(F.sum("excess_return").alias("x"), F.count("*").alias("n"))
    half = lambda late: F.avg(F.when(F.col("late") == late, F.col("excess_return")))
    t = o.agg(F.sum("excess_return").alias("total_x"), F.count("*").alias("total_n"), half(False).alias("h1"), half(True).alias("h2"))
    one = c.join(F.broadcast(t)).where("total_n > n").withColumn("m", (F.col("total_x") - F.col("x")) / (F.col("total_n") - F.col("n")))  # t is one row
    g = one.agg(F.min("m").alias("lowest"), F.max("m").alias("highest"), F.max(F.col("n") / F.col("total_n")).alias("largest_share"), F.first("h1").alias("h1"), F.first("h2").alias("h2"), (F.first("total_x") / F.first("total_n")).alias("mean"))
    g = g.join(F.broadcast(s7(s, d)))  # one row each
    sign = lambda a, b: F.signum(a) != F.signum(b)
    return g.select(
        *[r6(F.col(x), x) for x in ("mean", "lowest", "highest", "largest_share")], r6(F.col("h1"), "mean_before"), r6(F.col("h2"), "mean_from"), "low", "high",
        (~((F.col("low") > 0) | (F.col("high") < 0))).alias("interval_includes_zero"), (sign("lowest", "mean") | sign("highest", "mean")).alias("one_issuer_changes_sign"),
        (F.col("largest_share") > 0.1).alias("one_issuer_above_10_pct"), F.when(F.col("h1").isNotNull() & F.col("h2").isNotNull(), sign("h1", "h2")).alias("halves_differ"),
    )


def s7(s, d):
    """Cluster bootstrap of a ratio of sums: cluster sums once, draws by an arithmetic generator."""
    o = outcomes(s, d).where("horizon = 1 AND excess_return IS NOT NULL")
    c = o.groupBy("security_id").agg(F.sum("excess_return").alias("x"), F.count("*").alias("n"))
    c = c.withColumn("k", F.row_number().over(Window.orderBy("security_id")) - 1)  # one row per cluster
    g = c.agg(F.count("*").alias("G"))
    draws = s.range(199).withColumnRenamed("id", "draw").crossJoin(F.broadcast(g)).withColumn("slot", F.explode(F.sequence(F.lit(0), (F.col("G") - 1).cast("int"))))
    z = (F.col("draw") * 7919 + F.col("slot") * 104729 + 12345) * 1103515245 + 12345
    draws = draws.withColumn("k", (F.floor(F.pmod(z, F.lit(2147483648)) / 65536) % F.col("G")).cast("int"))
    m = draws.join(c, "k").groupBy("draw").agg((F.sum("x") / F.sum("n")).alias("m"))
    return m.agg(r6(F.expr("percentile(m, 0.025)"), "low"), r6(F.expr("percentile(m, 0.975)"), "high"), F.count("*").alias("draws"))


def s14(s, d):
    o = outcomes(s, d).withColumn("month", F.trunc("filing_date", "MM"))
    both = o.select(F.lit("official").alias("run"), "*").unionByName(o.where("abs(excess_return) < 0.5").select(F.lit("robust").alias("run"), "*"))
    return stats.clustered_mean(both, ["run", "horizon"], "excess_return", "security_id", "month").select("run", "horizon", "n", r6(F.col("mean"), "mean"), r6(F.col("se"), "se"))


def _mean_sql(groups, source):
    g = ", ".join(groups)
    part = lambda n, keys: f"{n} AS (SELECT {g}, count(*) AS g, sum(q * q) * count(*) / (count(*) - 1) AS v FROM (SELECT {g}, {keys}, sum(u) AS q FROM u GROUP BY {g}, {keys}) GROUP BY {g})"
    return f"""m AS (SELECT {g}, count(*) AS n, avg(y) AS mean FROM {source} GROUP BY {g}), u AS (SELECT x.*, (y - mean) / n AS u FROM {source} x JOIN m USING ({g})),
{part('ca', 'security_id')}, {part('cb', 'month')}, {part('cc', 'security_id, month')},
res AS (SELECT {g}, n, round(mean, 6) AS mean, round(sqrt(greatest(0, ca.v + cb.v - cc.v)), 6) AS se FROM m JOIN ca USING ({g}) JOIN cb USING ({g}) JOIN cc USING ({g}))"""


X1 = f"{E1_SQL}, x1 AS (SELECT *, date_trunc('month', filing_date) AS month, excess_return AS y FROM e1 WHERE excess_return IS NOT NULL)"
E17_SQL = "g17 AS (SELECT issuer_id, filing_date, avg(price) AS p, sum(shares) AS v, count(DISTINCT owner_id) AS k, min(owner_id % 5) AS o FROM fx_transactions WHERE transaction_code = 'P' GROUP BY 1, 2), e17 AS (SELECT issuer_id, filing_date, (p < 1800)::INT + (v > 40)::INT + (k >= 2)::INT + (o = 0)::INT AS score FROM g17)"
S7_SQL = f"WITH {X1}, c AS (SELECT security_id, sum(y) AS x, count(*) AS n, row_number() OVER (ORDER BY security_id) - 1 AS k FROM x1 WHERE horizon = 1 GROUP BY 1), g AS (SELECT count(*) AS g FROM c), d AS (SELECT draw, CAST(floor((((draw * 7919 + slot * 104729 + 12345)::HUGEINT * 1103515245 + 12345) % 2147483648) / 65536) AS BIGINT) % g AS k FROM g, range(199) a(draw), range((SELECT g FROM g)) b(slot)), m AS (SELECT draw, sum(x) / sum(n) AS m FROM d JOIN c USING (k) GROUP BY 1) SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, count(*) AS draws FROM m"
Q = {
    "e2_forward_return": (e2, f"WITH {R} SELECT security_id, session_no, round(exp(sum(ln(1 + r)) OVER (PARTITION BY security_id ORDER BY session_no ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING)) - 1, 6) AS forward_21 FROM r"),
    "e5_cumulative_average_path": (e5, f"WITH {at_horizons(PATH)} SELECT horizon, count(excess_return) AS n, round(avg(excess_return), 6) AS mean_excess FROM e1 GROUP BY 1 UNION ALL SELECT 0, count(*), 0.0 FROM ev"),
    "e6_evaluate_periods": (e6, f"WITH {X1}, x AS (SELECT *, CASE WHEN year(filing_date) <= 1998 THEN 'early' ELSE 'late' END AS period FROM x1 WHERE year(filing_date) BETWEEN 1995 AND 2005), {_mean_sql(['period', 'horizon'], 'x')} SELECT * FROM res"),
    "e8_prior_years_terciles": (e8, f"WITH {E8_SQL} SELECT * FROM e8"),
    "e10_signals": (e10, f"WITH {E8_SQL}, a AS (SELECT 'S1' AS signal, filing_date FROM e8 WHERE tercile = 1 UNION ALL SELECT 'S2', filing_date FROM e8 UNION ALL SELECT 'S3', filing_date FROM (SELECT DISTINCT issuer_id, filing_date FROM fx_transactions WHERE transaction_code = 'S' AND NOT is_amendment)) SELECT signal, year(filing_date) AS year, count(*) AS n FROM a GROUP BY 1, 2"),
    "e17_conviction_score": (e17, f"WITH {E17_SQL} SELECT * FROM e17"),
    "e18_cross_sectional_long_short": (e18, f"""WITH {R}, {E17_SQL}, sc AS (SELECT issuer_id, date_trunc('month', filing_date) AS month, sum(score) AS score FROM e17 GROUP BY 1, 2), c AS (SELECT month, quantile_cont(score, 1.0 / 3) AS c0, quantile_cont(score, 2.0 / 3) AS c1, count(*) AS firms, count(DISTINCT score) AS k FROM sc GROUP BY 1),
        mr AS (SELECT security_id AS issuer_id, date_trunc('month', session_date) AS m2, exp(sum(ln(1 + r))) - 1 AS r FROM r GROUP BY 1, 2), x AS (SELECT sc.*, c0, c1, mr.r FROM sc JOIN c USING (month) JOIN mr ON mr.issuer_id = sc.issuer_id AND mr.m2 = sc.month + INTERVAL 1 MONTH WHERE firms >= 6 AND k >= 3)
, bm AS (SELECT date_trunc('month', session_date) AS m2, exp(sum(ln(level / pv))) - 1 AS bench FROM (SELECT session_date, level, lag(level) OVER (ORDER BY session_no) AS pv FROM fx_benchmark) GROUP BY 1),
        lg AS (SELECT CAST(month AS DATE) AS month, count(*) FILTER (WHERE score >= c1) AS n_long, count(*) FILTER (WHERE score <= c0) AS n_short, avg(r) FILTER (WHERE score >= c1) AS a, avg(r) FILTER (WHERE score <= c0) AS b FROM x GROUP BY month HAVING count(*) FILTER (WHERE score >= c1) >= 2 AND count(*) FILTER (WHERE score <= c0) >= 2)
        SELECT month, n_long, n_short, round(a - b, 6) AS long_short, round(a - bench, 6) AS long_excess FROM lg LEFT JOIN bm ON bm.m2 = month + INTERVAL 1 MONTH"""),
    "e19_calendar_time_portfolio": (e19, f"""WITH {R}, e AS (SELECT issuer_id AS security_id, session_no, sum(CASE transaction_code WHEN 'P' THEN 1.0 ELSE -1.0 END) AS w FROM fx_transactions JOIN fx_calendar ON session_date = CAST(date_trunc('week', filing_date) AS DATE) WHERE transaction_code IN ('P', 'S') AND shares > 48 GROUP BY 1, 2),
        x AS (SELECT r.session_no, r, sum(coalesce(w, 0)) OVER k AS o, sum(coalesce(abs(w), 0)) OVER k AS g FROM r LEFT JOIN e ON e.security_id = r.security_id AND e.session_no = r.session_no WINDOW k AS (PARTITION BY r.security_id ORDER BY r.session_no ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
        SELECT session_no, round(sum(g), 6) AS gross, round(sum(o * r) / sum(g), 6) AS day_return FROM x WHERE r IS NOT NULL AND g > 0 GROUP BY 1"""),
    "e20_issuer_excluded_benchmark": (e20, f"WITH {R}, g AS (SELECT session_no, sum(r) AS s, count(r) AS n, count(*) AS k FROM r GROUP BY 1) SELECT security_id, r.session_no, round(CASE WHEN n - (r IS NOT NULL)::INT > 0 AND n >= 0.99 * k THEN (s - coalesce(r, 0)) / (n - (r IS NOT NULL)::INT) END, 6) AS others_mean FROM r JOIN g USING (session_no)"),
    "s7_cluster_bootstrap": (s7, S7_SQL),
    "s10_newey_west": (s10, f"WITH {R}, m AS (SELECT security_id, date_trunc('month', session_date) AS month, avg(r) AS r FROM r GROUP BY 1, 2 HAVING avg(r) IS NOT NULL), a AS (SELECT security_id, count(*) AS n, avg(r) AS mu FROM m GROUP BY 1), d AS (SELECT m.security_id, month, r - mu AS d, n, mu FROM m JOIN a USING (security_id)), v AS (SELECT security_id, n, mu, (sum(d * d) + sum(2 * (" + " + ".join(f"{(7 - k) / 7!r} * coalesce(l{k}, 0)" for k in range(1, 7)) + "))) / n AS v FROM (SELECT *, " + ", ".join(f"d * lag(d, {k}) OVER (PARTITION BY security_id ORDER BY month) AS l{k}" for k in range(1, 7)) + " FROM d) GROUP BY 1, 2, 3) SELECT security_id, n, round(mu, 6) AS mean, round(CASE WHEN v > 0 AND n >= 3 THEN mu / sqrt(v / n) END, 6) AS t FROM v"),
    "s11_perf_stats": (s11, f"""WITH {R}, b AS (SELECT session_no, level / lag(level) OVER (ORDER BY session_no) - 1 AS m FROM fx_benchmark),
        x AS (SELECT security_id, session_date AS dt, ln(1 + r) AS l, ln(1 + coalesce(m, 0)) AS bl, sum(ln(1 + r)) OVER w AS cum FROM r LEFT JOIN b ON b.session_no = r.session_no WHERE r IS NOT NULL WINDOW w AS (PARTITION BY security_id ORDER BY session_date)),
        y AS (SELECT *, exp(cum - max(cum) OVER (PARTITION BY security_id ORDER BY dt)) - 1 AS dd FROM x),
        w AS (SELECT security_id, count(*) AS n, exp(sum(l) * 52 / count(*)) - 1 AS cagr, min(dd) AS dd, min(dt) AS first_day, max(dt) AS last_day FROM y GROUP BY 1 HAVING count(*) >= 20),
        mo AS (SELECT security_id, CAST(unnest(generate_series(date_trunc('month', first_day)::TIMESTAMP, date_trunc('month', last_day)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS month FROM w),
        ms AS (SELECT mo.security_id, mo.month, exp(coalesce(l, 0)) - 1 AS s, exp(coalesce(bl, 0)) - 1 AS m FROM mo LEFT JOIN (SELECT security_id, date_trunc('month', dt) AS month, sum(l) AS l, sum(bl) AS bl FROM x GROUP BY 1, 2) q ON q.security_id = mo.security_id AND q.month = mo.month),
        g AS (SELECT security_id, count(*) AS months, stddev_samp(s) * sqrt(12) AS vol, avg(s) AS mu, avg((s > 0)::INT) AS hit, CASE WHEN count(*) > 12 THEN regr_slope(s, m) END AS beta, CASE WHEN count(*) > 12 THEN regr_intercept(s, m) END AS a, stddev_samp(s) * sqrt(1 - regr_r2(s, m)) / sqrt(count(*)) AS e FROM ms GROUP BY 1),
        dv AS (SELECT ms.security_id, month, s - mu AS d FROM ms JOIN g USING (security_id)),
        nw AS (SELECT security_id, (sum(d * d) + sum(2 * ({" + ".join(f"{(7 - k) / 7!r} * coalesce(l{k}, 0)" for k in range(1, 7))}))) / count(*) AS v FROM (SELECT *, {", ".join(f"d * lag(d, {k}) OVER (PARTITION BY security_id ORDER BY month) AS l{k}" for k in range(1, 7))} FROM dv) GROUP BY 1)
        SELECT w.security_id, n, months, round(cagr, 6) AS cagr, round(vol, 6) AS ann_vol, round(CASE WHEN vol > 0 THEN mu * 12 / vol END, 6) AS sharpe, round(CASE WHEN v > 0 AND months >= 3 THEN mu / sqrt(v / months) END, 6) AS t_nw, round(dd, 6) AS max_drawdown, round(hit, 6) AS hit_month,
          round(beta, 6) AS beta, round(pow(1 + a, 12) - 1, 6) AS alpha_ann, round(CASE WHEN e > 0 THEN a / e END, 6) AS alpha_t, first_day, last_day FROM w JOIN g USING (security_id) JOIN nw USING (security_id)"""),
    "s13_fragility": (s13, S7_SQL.replace(" SELECT round(quantile_cont(m, 0.025), 6) AS low", f""", t AS (SELECT sum(y) AS tx, count(*) AS tn, avg(y) FILTER (filing_date < DATE '{HALVES}') AS h1, avg(y) FILTER (filing_date >= DATE '{HALVES}') AS h2 FROM x1 WHERE horizon = 1),
        l AS (SELECT min((tx - x) / (tn - n)) AS lowest, max((tx - x) / (tn - n)) AS highest, max(n / tn) AS largest_share FROM c, t WHERE tn > n), b AS (SELECT round(quantile_cont(m, 0.025), 6) AS low""") + """)
        SELECT round(tx / tn, 6) AS mean, round(lowest, 6) AS lowest, round(highest, 6) AS highest, round(largest_share, 6) AS largest_share, round(h1, 6) AS mean_before, round(h2, 6) AS mean_from, low, high, NOT (low > 0 OR high < 0) AS interval_includes_zero,
        sign(lowest) <> sign(tx / tn) OR sign(highest) <> sign(tx / tn) AS one_issuer_changes_sign, largest_share > 0.1 AS one_issuer_above_10_pct, CASE WHEN h1 IS NOT NULL AND h2 IS NOT NULL THEN sign(h1) <> sign(h2) END AS halves_differ FROM t, l, b"""),
    "s14_robustness": (s14, f"WITH {X1}, x AS (SELECT 'official' AS run, * FROM x1 UNION ALL SELECT 'robust', * FROM x1 WHERE abs(y) < 0.5), {_mean_sql(['run', 'horizon'], 'x')} SELECT * FROM res"),
}
QUERIES = {k: (f, with_views(q) if q else None) for k, (f, q) in Q.items()}
