"""Queries of ordered operators and aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windows as W
from ..operators.quantiles import earlier_quantiles, overall_quantiles
from .fixtures import fx, with_views

r6 = lambda c, n: F.round(c, 6).alias(n)
daily = lambda s, d: fx(s, d, "fx_daily")
tx = lambda s, d: fx(s, d, "fx_transactions")
by = lambda *k: Window.partitionBy(*k)


def with_r(s, d):
    w = by("security_id").orderBy("session_no")
    return daily(s, d).withColumn("r", F.col("close") / F.lag("close").over(w) - 1)


R = "r AS (SELECT *, close / lag(close) OVER (PARTITION BY security_id ORDER BY session_no) - 1 AS r FROM fx_daily)"


def w1(s, d):
    return W.return_index(with_r(s, d), "security_id", "session_no", "r").select("security_id", "session_no", r6(F.col("log_level"), "log_level"))


def w2(s, d):
    return daily(s, d).select("security_id", "session_no", r6(F.abs(F.lag("cap").over(by("security_id").orderBy("session_no")) * 1000), "lag_cap"))


def w3(s, d):
    return W.trailing_mean(daily(s, d), "security_id", "session_no", F.col("close") * F.col("volume"), 20, "adv").select("security_id", "session_no", r6(F.col("adv"), "adv"))


def w4(s, d):
    w = by("security_id").orderBy("session_no").rowsBetween(-2, 2)
    return daily(s, d).select("security_id", "session_no", r6(F.min("low").over(w), "low5"), r6(F.max("high").over(w), "high5"))


def w5(s, d):
    x = W.session_spine_mean(daily(s, d).withColumn("t", F.col("volume") / F.col("cap")), "security_id", "session_no", "t", 60, 40, "turnover")
    return x.select("security_id", (F.col("session_no") + 1).alias("entry_no"), r6(F.col("turnover"), "turnover"))


def w6(s, d):
    t = tx(s, d).groupBy("issuer_id", F.trunc("transaction_date", "YEAR").alias("year")).agg(F.round(F.avg("shares")).alias("f"))
    p = F.lag("f").over(by("issuer_id").orderBy("year"))
    x = t.withColumn("p", p).where(F.abs(F.col("f") - F.col("p")) > 1e-8 + 1e-5 * F.abs("p"))
    return x.select("issuer_id", "year", r6(F.col("p") / F.col("f"), "factor"))


def w7(s, d):
    x = daily(s, d).withColumn("code", F.floor(F.col("close") / 100))
    return W.change_points(x, "security_id", "session_no", "code").select("security_id", "session_no", "code")


def w9(s, d):
    w = by("accession", "line_no").orderBy(F.desc("transaction_date"), F.desc("shares"), F.desc("price"), "issuer_id", "transaction_code")
    return tx(s, d).withColumn("k", F.row_number().over(w)).where("k = 1").select("accession", "line_no", "transaction_date", r6(F.col("shares"), "shares"))


def w10(s, d):
    """Expanding median by month: the cut-off of a month uses strictly earlier months only, and at least 500 prices."""
    days = tx(s, d).where("transaction_code = 'P'").select(F.trunc("filing_date", "MM").alias("month"), "price")
    x = earlier_quantiles(days, "month", "price", [0.5])
    return x.select("month", "n", r6(F.when(F.col("n") >= 500, F.get("quantiles", F.lit(0))), "cutoff"))


def w11(s, d, days=14, code="P"):
    t = tx(s, d).where((F.col("transaction_code") == code) & ~F.col("is_amendment"))
    x = W.trailing_distinct(t, "issuer_id", "filing_date", "owner_id", days, "buyers").select("issuer_id", "filing_date", "buyers").distinct()
    return x.withColumn("arm", F.when(F.col("buyers") >= 2, "clustered").otherwise("solo"))


def _w11_sql(days):
    return f"""WITH b AS (SELECT DISTINCT issuer_id, filing_date, owner_id FROM fx_transactions WHERE transaction_code = 'P' AND NOT is_amendment), k AS (SELECT DISTINCT issuer_id, filing_date FROM b)
        SELECT k.issuer_id, k.filing_date, count(DISTINCT owner_id) AS buyers, CASE WHEN count(DISTINCT owner_id) >= 2 THEN 'clustered' ELSE 'solo' END AS arm FROM k JOIN b ON b.issuer_id = k.issuer_id AND b.filing_date BETWEEN k.filing_date - {days - 1} AND k.filing_date GROUP BY 1, 2"""


def w14(s, d):
    x = with_r(s, d).where("r IS NOT NULL").withColumn("cum", F.exp(F.sum(F.ln(1 + F.col("r"))).over(by("security_id").orderBy("session_no"))))
    return W.drawdown(x, ["security_id"], "session_no", "cum").groupBy("security_id").agg(r6(F.min("drawdown"), "max_drawdown"))


def w15(s, d):
    t = tx(s, d).withColumn("owner_grp", F.col("owner_id") % 20).withColumn("price", F.floor(F.col("price") / 100))
    g = t.groupBy("owner_grp", "issuer_id", "transaction_date", "shares", "price").agg(F.countDistinct("accession").alias("accessions"), F.count("*").alias("n"))
    return g.where("accessions > 1").select("owner_grp", "issuer_id", "transaction_date", r6(F.col("shares"), "shares"), "price", "accessions", "n")


def w16(s, d):
    b = tx(s, d).groupBy("owner_id", "issuer_id", "acquired_disposed").agg(F.min("transaction_date").alias("first"))
    return b.select("owner_id", "issuer_id", "acquired_disposed", (F.row_number().over(by("owner_id", "issuer_id").orderBy("first", "acquired_disposed")) > 1).alias("changed"))


def w17(s, d):
    x = daily(s, d).withColumn("bad", F.sum(F.when(F.col("close") < 1900, 1).otherwise(0)).over(by("security_id").orderBy("session_no")))
    y = x.select("security_id", (F.col("session_no") - 5).alias("session_no"), F.col("bad").alias("bad_end"))
    return x.join(y, ["security_id", "session_no"]).select("security_id", "session_no", (F.col("bad_end") - F.col("bad")).alias("invalid_on_path"))


def w18(s, d):
    """Slope on the benchmark over the last 252 returns before each session, from 60 returns on."""
    w = by("security_id").orderBy("session_no")
    b = fx(s, d, "fx_benchmark").withColumn("m", F.col("level") / F.lag("level").over(Window.orderBy("session_no")) - 1).select("session_no", "m")
    x = with_r(s, d).join(F.broadcast(b), "session_no").where("r IS NOT NULL AND m IS NOT NULL")
    f = w.rowsBetween(-252, -1)
    x = x.withColumn("n", F.count("*").over(f)).withColumn("beta", F.covar_samp("r", "m").over(f) / F.var_samp("m").over(f))
    return x.select("security_id", "session_no", r6(F.when(F.col("n") >= 60, F.col("beta")), "beta"))


def w20(s, d):
    g = tx(s, d).groupBy("issuer_id", F.month("transaction_date").cast("long").alias("month")).agg(F.count("*").alias("n"))
    return g.withColumn("k", F.row_number().over(by("issuer_id").orderBy(F.desc("n"), "month"))).where("k = 1").select("issuer_id", "month", "n")


def a2(s, d):
    return tx(s, d).where("transaction_code IN ('P', 'S')").groupBy("issuer_id", "filing_date", "transaction_code").agg(F.countDistinct("accession").alias("filings"), F.array_join(F.sort_array(F.collect_set("line_no")), ",").alias("lines"))


def a4(s, d):
    rank = F.col("owner_id") % 4
    t = tx(s, d).groupBy("issuer_id", "filing_date").agg(*[F.bool_or(rank == i).alias(f"r{i}") for i in range(3)])
    b = F.when(F.col("r0"), "senior_executive").when(F.col("r1") & ~F.col("r2"), "director").when(F.col("r2") & ~F.col("r1"), "owner")
    return t.select("issuer_id", "filing_date", b.alias("bucket"))


def a7(s, d):
    p, q = F.col("transaction_code") == "P", F.col("transaction_code") == "S"
    g = tx(s, d).groupBy("issuer_id", F.trunc("filing_date", "MM").alias("month")).agg(
        F.countDistinct(F.when(p, F.col("owner_id"))).alias("buyers"), F.countDistinct(F.when(q, F.col("owner_id"))).alias("sellers"),
        r6(F.coalesce(F.sum(F.when(p, F.col("shares"))), F.lit(0.0)) - F.coalesce(F.sum(F.when(q, F.col("shares"))), F.lit(0.0)), "conv_net"),
    )
    return g.withColumn("breadth", F.round((F.col("buyers") - F.col("sellers")) / F.greatest(F.lit(1), F.col("buyers") + F.col("sellers")), 6))


def a8(s, d):
    """Compounded monthly returns on a spine of every month of a security's life; empty months are 0."""
    x = with_r(s, d).groupBy("security_id", F.trunc("session_date", "MM").alias("month")).agg(F.sum(F.ln(1 + F.col("r"))).alias("l"))
    life = x.groupBy("security_id").agg(F.min("month").alias("a"), F.max("month").alias("b"))
    spine = life.select("security_id", F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    return spine.join(x, ["security_id", "month"], "left").select("security_id", "month", r6(F.exp(F.coalesce("l", F.lit(0.0))) - 1, "r"))


def a9(s, d):
    return with_r(s, d).groupBy("security_id").agg(F.count("r").alias("n"), r6(F.avg("r"), "mean"), r6(F.expr("percentile(r, 0.5)"), "median"), r6(F.avg((F.col("r") > 0).cast("int")), "hit_rate"))


def a12(s, d):
    q = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    return overall_quantiles(with_r(s, d), "r", q).select("q", r6(F.col("value"), "value"))


def a13(s, d):
    x = tx(s, d).where("transaction_code = 'P'").select("issuer_id", (F.col("shares") * F.col("price")).alias("v"))
    tot = x.groupBy("issuer_id").agg(F.sum("v").alias("v"), F.count("*").alias("n"))  # a row per issuer
    k = F.row_number().over(Window.orderBy(F.desc("v"), "issuer_id"))
    t = tot.withColumn("k", k)
    return t.agg(r6(F.sum(F.when(F.col("k") > 5, F.col("v"))) / F.sum(F.when(F.col("k") > 5, F.col("n"))), "mean_without_top5"), r6(F.sum(F.when(F.col("k") <= 10, F.col("v"))) / F.sum("v"), "top10_share"))


def a17(s, d):
    lag = F.datediff("filing_date", "transaction_date")
    return tx(s, d).groupBy("transaction_code").agg(F.count("*").alias("n"), r6(F.avg(lag), "mean"), r6(F.stddev_samp(lag), "std"), *[r6(F.expr(f"percentile(datediff(filing_date, transaction_date), {q / 100})"), f"p{q}") for q in (50, 90, 95, 99)])


def a18(s, d):
    m = tx(s, d).where("transaction_code = 'P'").groupBy("issuer_id", "filing_date").agg(F.expr("percentile(price, 0.5)").alias("m"))
    return m.groupBy("issuer_id").agg(F.count("*").alias("n"), r6(F.avg("m"), "median_price"), r6(F.avg((F.col("m") >= 1500).cast("int")), "tradeable"))


def a1(s, d):
    g = tx(s, d).groupBy("accession").agg(F.countDistinct("owner_id").alias("owner_count"))
    return tx(s, d).select("accession", "line_no", "issuer_id").distinct().join(g, "accession")


def a3(s, d):
    v = F.when(F.col("line_no") % 4 != 0, F.col("shares") * F.col("price"))
    return tx(s, d).groupBy("accession").agg(r6(F.sum(v), "value"), r6(F.coalesce(F.sum(v), F.sum("shares")), "value_or_shares"))


def a19(s, d):
    return tx(s, d).groupBy("issuer_id", "filing_date").agg(F.array_join(F.sort_array(F.collect_set(F.trim("transaction_code"))), "; ").alias("labels"))


def o2(s, d):
    g = tx(s, d).groupBy("issuer_id").agg(F.avg("price").alias("p"), F.count("*").alias("n"))
    w = by(F.round("p", -1)).orderBy(F.desc("n"), "issuer_id")
    x = g.withColumn("k", F.row_number().over(w)).where("k = 1")
    return x.orderBy(F.desc("n"), "issuer_id").limit(3).select("issuer_id", "n", r6(F.col("p"), "p"))


def o3(s, d):
    g = tx(s, d).groupBy("issuer_id", "owner_id").agg(F.sum("shares").alias("v"))
    return g.withColumn("k", F.row_number().over(by("issuer_id").orderBy(F.desc("v"), "owner_id"))).where("k <= 3").select("issuer_id", "owner_id", "k", r6(F.col("v"), "v"))


Q = {
    "w1_total_return_index": (w1, f"WITH {R} SELECT security_id, session_no, round(CASE WHEN r > -1 THEN sum(CASE WHEN r > -1 THEN ln(1 + r) END) OVER (PARTITION BY security_id ORDER BY session_no) END, 6) AS log_level FROM r"),
    "w2_lagged_cap": (w2, "SELECT security_id, session_no, round(abs(lag(cap) OVER (PARTITION BY security_id ORDER BY session_no) * 1000), 6) AS lag_cap FROM fx_daily"),
    "w3_trailing_adv": (w3, "SELECT security_id, session_no, round(CASE WHEN count(*) OVER w = 20 THEN avg(close * volume) OVER w END, 6) AS adv FROM fx_daily WINDOW w AS (PARTITION BY security_id ORDER BY session_no ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"),
    "w4_centred_range": (w4, "SELECT security_id, session_no, round(min(low) OVER w, 6) AS low5, round(max(high) OVER w, 6) AS high5 FROM fx_daily WINDOW w AS (PARTITION BY security_id ORDER BY session_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"),
    "w5_turnover": (w5, "SELECT security_id, session_no + 1 AS entry_no, round(CASE WHEN count(*) OVER w >= 40 THEN avg(volume / cap) OVER w END, 6) AS turnover FROM fx_daily WINDOW w AS (PARTITION BY security_id ORDER BY session_no RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)"),
    "w6_split_events": (w6, "WITH t AS (SELECT issuer_id, CAST(date_trunc('year', transaction_date) AS DATE) AS year, round(avg(shares)) AS f FROM fx_transactions GROUP BY 1, 2), p AS (SELECT *, lag(f) OVER (PARTITION BY issuer_id ORDER BY year) AS p FROM t) SELECT issuer_id, year, round(p / f, 6) AS factor FROM p WHERE abs(f - p) > 1e-8 + 1e-5 * abs(p)"),
    "w7_change_points": (w7, "WITH c AS (SELECT security_id, session_no, CAST(floor(close / 100) AS BIGINT) AS code FROM fx_daily), p AS (SELECT *, lag(code) OVER w AS p, row_number() OVER w AS n FROM c WINDOW w AS (PARTITION BY security_id ORDER BY session_no)) SELECT security_id, session_no, code FROM p WHERE n = 1 OR code IS DISTINCT FROM p"),
    "w9_dedupe_keep_last": (w9, "SELECT accession, line_no, transaction_date, round(shares, 6) AS shares FROM fx_transactions QUALIFY row_number() OVER (PARTITION BY accession, line_no ORDER BY transaction_date DESC, shares DESC, price DESC, issuer_id, transaction_code) = 1"),
    "w10_expanding_median": (w10, "WITH d AS (SELECT filing_date, price FROM fx_transactions WHERE transaction_code = 'P' AND price IS NOT NULL), m AS (SELECT DISTINCT CAST(date_trunc('month', filing_date) AS DATE) AS month FROM d) SELECT month, count(*) AS n, round(CASE WHEN count(*) >= 500 THEN quantile_cont(price, 0.5) END, 6) AS cutoff FROM m JOIN d ON date_trunc('month', filing_date) < month GROUP BY month"),
    "w11_trailing_distinct_actors": (w11, _w11_sql(14)),
    "w12_trailing_90_day_cluster": (lambda s, d: w11(s, d, 90), _w11_sql(90)),
    "w14_drawdown": (w14, f"WITH {R}, c AS (SELECT security_id, session_no, exp(sum(ln(1 + r)) OVER (PARTITION BY security_id ORDER BY session_no)) AS cum FROM r WHERE r IS NOT NULL), m AS (SELECT *, max(cum) OVER (PARTITION BY security_id ORDER BY session_no) AS m FROM c) SELECT security_id, round(min(cum / m - 1), 6) AS max_drawdown FROM m GROUP BY 1"),
    "w15_duplicate_across_filings": (w15, "SELECT owner_id % 20 AS owner_grp, issuer_id, transaction_date, round(shares, 6) AS shares, CAST(floor(price / 100) AS BIGINT) AS price, count(DISTINCT accession) AS accessions, count(*) AS n FROM fx_transactions GROUP BY 1, 2, 3, shares, 5 HAVING count(DISTINCT accession) > 1"),
    "w16_security_change": (w16, "SELECT owner_id, issuer_id, acquired_disposed, row_number() OVER (PARTITION BY owner_id, issuer_id ORDER BY min(transaction_date), acquired_disposed) > 1 AS changed FROM fx_transactions GROUP BY 1, 2, 3"),
    "w17_prefix_count_completeness": (w17, "WITH x AS (SELECT security_id, session_no, sum(CASE WHEN close < 1900 THEN 1 ELSE 0 END) OVER (PARTITION BY security_id ORDER BY session_no) AS bad FROM fx_daily) SELECT a.security_id, a.session_no, b.bad - a.bad AS invalid_on_path FROM x a JOIN x b ON a.security_id = b.security_id AND b.session_no = a.session_no + 5"),
    "w18_trailing_beta": (w18, f"WITH {R}, b AS (SELECT session_no, level / lag(level) OVER (ORDER BY session_no) - 1 AS m FROM fx_benchmark), x AS (SELECT security_id, r.session_no, r, m FROM r JOIN b ON r.session_no = b.session_no WHERE r IS NOT NULL AND m IS NOT NULL), y AS (SELECT *, count(*) OVER w AS n, covar_samp(r, m) OVER w / var_samp(m) OVER w AS beta FROM x WINDOW w AS (PARTITION BY security_id ORDER BY session_no ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)) SELECT security_id, session_no, round(CASE WHEN n >= 60 THEN beta END, 6) AS beta FROM y"),
    "w20_mode_month": (w20, "SELECT issuer_id, month(transaction_date) AS month, count(*) AS n FROM fx_transactions GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY issuer_id ORDER BY count(*) DESC, month(transaction_date)) = 1"),
    "a1_owner_count": (a1, "SELECT DISTINCT t.accession, line_no, issuer_id, owner_count FROM fx_transactions t JOIN (SELECT accession, count(DISTINCT owner_id) AS owner_count FROM fx_transactions GROUP BY 1) g ON g.accession = t.accession"),
    "a2_issuer_day_events": (a2, "SELECT issuer_id, filing_date, transaction_code, count(DISTINCT accession) AS filings, array_to_string(list_sort(list(DISTINCT line_no)), ',') AS lines FROM fx_transactions WHERE transaction_code IN ('P', 'S') GROUP BY 1, 2, 3"),
    "a3_sum_min_count": (a3, "SELECT accession, round(sum(CASE WHEN line_no % 4 <> 0 THEN shares * price END), 6) AS value, round(coalesce(sum(CASE WHEN line_no % 4 <> 0 THEN shares * price END), sum(shares)), 6) AS value_or_shares FROM fx_transactions GROUP BY 1"),
    "a4_role_bucket": (a4, "WITH g AS (SELECT issuer_id, filing_date, bool_or(owner_id % 4 = 0) AS a, bool_or(owner_id % 4 = 1) AS b, bool_or(owner_id % 4 = 2) AS c FROM fx_transactions GROUP BY 1, 2) SELECT issuer_id, filing_date, CASE WHEN a THEN 'senior_executive' WHEN b AND NOT c THEN 'director' WHEN c AND NOT b THEN 'owner' END AS bucket FROM g"),
    "a7_firm_month_demand": (a7, "WITH g AS (SELECT issuer_id, CAST(date_trunc('month', filing_date) AS DATE) AS month, count(DISTINCT owner_id) FILTER (WHERE transaction_code = 'P') AS buyers, count(DISTINCT owner_id) FILTER (WHERE transaction_code = 'S') AS sellers, round(coalesce(sum(shares) FILTER (WHERE transaction_code = 'P'), 0) - coalesce(sum(shares) FILTER (WHERE transaction_code = 'S'), 0), 6) AS conv_net FROM fx_transactions GROUP BY 1, 2) SELECT *, round((buyers - sellers) / greatest(1, buyers + sellers), 6) AS breadth FROM g"),
    "a8_period_returns": (a8, f"WITH {R}, x AS (SELECT security_id, date_trunc('month', session_date) AS month, sum(ln(1 + r)) AS l FROM r GROUP BY 1, 2), p AS (SELECT security_id, unnest(generate_series(min(month)::TIMESTAMP, max(month)::TIMESTAMP, INTERVAL 1 MONTH)) AS month FROM x GROUP BY 1) SELECT p.security_id, CAST(p.month AS DATE) AS month, round(exp(coalesce(l, 0)) - 1, 6) AS r FROM p LEFT JOIN x ON x.security_id = p.security_id AND x.month = p.month"),
    "a9_summary_stats": (a9, f"WITH {R} SELECT security_id, count(r) AS n, round(avg(r), 6) AS mean, round(quantile_cont(r, 0.5), 6) AS median, round(avg(CASE WHEN r > 0 THEN 1 WHEN r IS NOT NULL THEN 0 END), 6) AS hit_rate FROM r GROUP BY 1"),
    "a12_quantile_distribution": (a12, f"WITH {R} SELECT q, round(v, 6) AS value FROM (SELECT unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]::DOUBLE[]) AS q, unnest(quantile_cont(r, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])) AS v FROM r)"),
    "a13_concentration": (a13, "WITH t AS (SELECT issuer_id, sum(shares * price) AS v, count(*) AS n FROM fx_transactions WHERE transaction_code = 'P' GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY v DESC, issuer_id) AS k FROM t) SELECT round(sum(v) FILTER (WHERE k > 5) / sum(n) FILTER (WHERE k > 5), 6) AS mean_without_top5, round(sum(v) FILTER (WHERE k <= 10) / sum(v), 6) AS top10_share FROM k"),
    "a17_quantile_describe": (a17, "SELECT transaction_code, count(*) AS n, round(avg(l), 6) AS mean, round(stddev_samp(l), 6) AS std, round(quantile_cont(l, 0.5), 6) AS p50, round(quantile_cont(l, 0.9), 6) AS p90, round(quantile_cont(l, 0.95), 6) AS p95, round(quantile_cont(l, 0.99), 6) AS p99 FROM (SELECT *, CAST(filing_date - transaction_date AS DOUBLE) AS l FROM fx_transactions) GROUP BY 1"),
    "a18_median_price": (a18, "WITH m AS (SELECT issuer_id, filing_date, quantile_cont(price, 0.5) AS m FROM fx_transactions WHERE transaction_code = 'P' GROUP BY 1, 2) SELECT issuer_id, count(*) AS n, round(avg(m), 6) AS median_price, round(avg(CASE WHEN m >= 1500 THEN 1 ELSE 0 END), 6) AS tradeable FROM m GROUP BY 1"),
    "a19_example_roll_up": (a19, "SELECT issuer_id, filing_date, array_to_string(list_sort(list(DISTINCT transaction_code)), '; ') AS labels FROM fx_transactions GROUP BY 1, 2"),
    "o2_top_k_after_dedupe": (o2, "WITH g AS (SELECT issuer_id, avg(price) AS p, count(*) AS n FROM fx_transactions GROUP BY 1), k AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY round(p, -1) ORDER BY n DESC, issuer_id) = 1) SELECT issuer_id, n, round(p, 6) AS p FROM k ORDER BY n DESC, issuer_id LIMIT 3"),
    "o3_head_per_group": (o3, "SELECT issuer_id, owner_id, row_number() OVER (PARTITION BY issuer_id ORDER BY sum(shares) DESC, owner_id) AS k, round(sum(shares), 6) AS v FROM fx_transactions GROUP BY 1, 2 QUALIFY k <= 3"),
}
QUERIES = {k: (f, with_views(q) if q else None) for k, (f, q) in Q.items()}
