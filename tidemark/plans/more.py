"""Queries that compose the operators further: classification, audits, tables by group."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import joins as J
from ..operators import quality, returns, signals, stats
from .fixtures import fx, with_views
from .signals import X1, _mean_sql
from .study import E1_SQL, outcomes
from .windows import R, with_r

r6 = lambda c, n: F.round(c, 6).alias(n)
T = lambda s, d, n: s.read.parquet(f"{d}/{n}.parquet")
tx = lambda s, d: fx(s, d, "fx_transactions")
by = lambda *k: Window.partitionBy(*k)


def j11(s, d):
    p = returns.valid_levels(fx(s, d, "fx_daily"), "security_id", "close").select("security_id", "session_no", "close", "ok_upto")
    e = p.select("security_id", (F.col("session_no") - 3).alias("session_no"), F.col("close").alias("c3"), F.col("ok_upto").alias("u3"))
    return p.join(e, ["security_id", "session_no"]).select("security_id", "session_no", r6(F.col("c3") / F.col("close") - 1, "r3"), (F.col("u3") - F.col("ok_upto") == 3).alias("complete"))


def j15(s, d):
    i = fx(s, d, "fx_intervals").select("issuer_id", "security_id", F.col("effective_start").alias("start"), F.col("effective_end").alias("end"))
    h = tx(s, d).where("line_no = 1 AND shares > 45").select("issuer_id", F.trunc("filing_date", "YEAR").alias("start")).distinct()
    h = I.close_history(h, ["issuer_id"]).withColumn("end", F.coalesce("end", F.lit("2100-01-01").cast("date")))
    return J.overlap_join(i, h, "issuer_id")


def a14(s, d):
    o = outcomes(s, d).withColumn("month", F.trunc("filing_date", "MM")).withColumn("year", F.year("filing_date").cast("long"))
    return stats.clustered_mean(o, ["year", "horizon"], "excess_return", "security_id", "month").select("year", "horizon", "n", r6(F.col("mean"), "mean"), r6(F.col("se"), "se"))


def a15(s, d):
    o = outcomes(s, d)
    return o.groupBy("horizon").agg(F.count("*").alias("events"), F.count_if("delisted").alias("delisted"), F.count_if("partial_path").alias("partial"), F.count("excess_return").alias("used"))


def a16(s, d):
    o = outcomes(s, d).groupBy("horizon").agg(r6(F.avg(F.col("stock_return").isNotNull().cast("int")), "complete_share"))
    return o


def a21(s, d):
    return tx(s, d).groupBy("transaction_code", "is_amendment").agg(F.count("*").alias("n"), F.countDistinct("accession").alias("filings"), F.countDistinct("owner_id").alias("owners"))


def w8(s, d):
    w = by("issuer_id").orderBy(F.desc("is_point_in_time"), F.desc("effective_start"), F.desc("security_id"))
    return fx(s, d, "fx_intervals").withColumn("k", F.row_number().over(w)).where("k = 1").select("issuer_id", "security_id", "is_point_in_time")


def w19(s, d):
    """Level 100 at each 50th session, for the ten sessions before and after."""
    p = fx(s, d, "fx_daily").select("security_id", "session_no", "close")
    at = p.where("session_no % 50 = 0").select("security_id", F.col("session_no").alias("at_no"), F.col("close").alias("base")).withColumn("session_no", F.explode(F.expr("sequence(at_no - 10, at_no + 10)")))
    return at.join(p, ["security_id", "session_no"]).select("security_id", "at_no", (F.col("session_no") - F.col("at_no")).alias("k"), r6(100 * F.col("close") / F.col("base"), "level"))


def t2(s, d):
    i = fx(s, d, "fx_intervals").select("issuer_id", "security_id", "effective_start")
    h = tx(s, d).groupBy("issuer_id", "filing_date").agg(F.max("owner_id").alias("value"))
    a = J.asof(i, h, "issuer_id", "effective_start", "filing_date", ["value"], tolerance=400)
    return a.select("issuer_id", "security_id", "effective_start", F.col("asof_filing_date").alias("since"), F.col("asof_value").alias("value"))


def t9(s, d):
    m = tx(s, d).select("issuer_id", F.trunc("filing_date", "MM").alias("since"), "transaction_code").distinct()
    a = m.where("transaction_code = 'P'").select("issuer_id", "since", F.lit("LINE").alias("rule"))
    return a.unionByName(m.where("transaction_code = 'S'").select("issuer_id", "since", F.lit("SIZE").alias("rule"))).groupBy("issuer_id", "rule").agg(F.count("*").alias("n"), F.min("since").alias("first"))


def t11(s, d):
    x = fx(s, d, "fx_daily").where("delisted").select("security_id", "session_date")
    return J.assert_unique(x, ["security_id"], "delistings")


def o1(s, d):
    w = Window.orderBy(F.desc("n"), "issuer_id")  # one row per issuer
    g = tx(s, d).groupBy("issuer_id").agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(w))


def o4(s, d):
    t = tx(s, d)
    a = t.where("transaction_code = 'P'").select("issuer_id", F.col("shares").alias("bought"))
    b = t.where("transaction_code = 'S'").select("issuer_id", F.col("shares").alias("sold"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("issuer_id").agg(r6(F.sum("bought"), "bought"), r6(F.sum("sold"), "sold"))


def o5(s, d):
    t = tx(s, d).where("transaction_code = 'P'").select("accession").distinct()
    u = tx(s, d).where("transaction_code = 'S'").select("accession").distinct()
    return t.exceptAll(u).agg(F.count("*").alias("n")).select(F.lit("P not S").alias("side"), "n").unionByName(u.exceptAll(t).agg(F.count("*").alias("n")).select(F.lit("S not P").alias("side"), "n"))


def o7(s, d):
    return tx(s, d).select("issuer_id", "owner_id", "transaction_code").dropDuplicates()


def e7(s, d):
    c, b = fx(s, d, "fx_calendar"), fx(s, d, "fx_benchmark").where("session_no % 13 <> 0").select("session_no", "level")
    return c.join(b, "session_no", "left").select("session_no", "session_date", r6(F.col("level"), "level"))


def e9(s, d):
    e = tx(s, d).where("transaction_code = 'S'").groupBy("issuer_id", "filing_date").agg(F.sum(F.col("shares") * F.col("price")).alias("v"))
    x = signals.prior_years_terciles(e, "filing_date", "v")
    return x.groupBy(F.year("filing_date").cast("long").alias("year"), F.col("tercile").cast("long").alias("tercile")).agg(F.count("*").alias("n"))


def e15(s, d):
    g = tx(s, d).where("transaction_code = 'P' AND NOT is_amendment").groupBy("issuer_id", "filing_date")
    return g.agg(r6(F.sum(F.col("shares") * F.col("price")), "dollars"), F.bool_or(F.col("owner_id") % 4 == 0).alias("senior"))


def e16(s, d):
    o = outcomes(s, d).withColumn("month", F.trunc("filing_date", "MM"))
    dims = F.array(F.struct(F.lit("half").alias("dim"), F.when(F.month("filing_date") <= 6, "H1").otherwise("H2").alias("grp")), F.struct(F.lit("parity").alias("dim"), (F.year("filing_date") % 2).cast("string").alias("grp")))
    x = o.withColumn("e", F.explode(dims)).select("horizon", "security_id", "month", "excess_return", "e.dim", "e.grp")
    return stats.clustered_mean(x, ["dim", "grp", "horizon"], "excess_return", "security_id", "month").select("dim", "grp", "horizon", "n", r6(F.col("mean"), "mean"), r6(F.col("se"), "se"))


def e24(s, d):
    o = outcomes(s, d).where("horizon = 5 AND stock_return IS NOT NULL")
    return o.select("event_id", "entry_no", "end_no", F.round(100 * (1 + F.col("stock_return")), 4).alias("value_of_100"))


def s12(s, d):
    q = with_r(s, d).groupBy("security_id", F.trunc("session_date", "QUARTER").alias("q")).agg((F.exp(F.sum(F.ln(1 + F.col("r")))) - 1).alias("r"))
    g = q.groupBy("security_id").agg(F.count("r").alias("n"), r6(F.avg("r"), "mean"), r6(F.stddev_samp("r"), "vol"))
    return g.where("n >= 12")


def io4(s, d):
    """Typed signal tables of one archive: rows per quarter and table."""
    t = tx(s, d).withColumn("quarter", F.concat(F.year("filing_date"), F.lit("Q"), F.quarter("filing_date")))
    part = lambda n, *k: t.select("quarter", *k).distinct().groupBy("quarter").agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "quarter", "n")
    return part("submissions", "accession").unionByName(part("owners", "accession", "owner_id")).unionByName(part("transactions", "accession", "line_no"))


def io5(s, d):
    o = T(s, d, "orders").select("o_orderkey", F.concat(F.substring("o_orderpriority", 1, 1), F.when(F.col("o_orderstatus") == "P", "/A").otherwise("")).alias("form"))
    keep = o.where(F.col("form").rlike("^[345](/A)?$"))
    return T(s, d, "lineitem").join(keep.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("lines"))


def io15(s, d):
    return fx(s, d, "fx_intervals").where("is_point_in_time AND effective_start <= DATE'1999-12-31' AND coalesce(effective_end, DATE'1997-06-01') >= DATE'1997-06-01'").select("issuer_id", "security_id", "effective_start", "effective_end")


def io16(s, d):
    p = fx(s, d, "fx_daily").where("security_id LIKE 'Brand#1%'")
    return p.groupBy(F.year("session_date").cast("long").alias("year")).agg(F.count("*").alias("n"), F.countDistinct("security_id").alias("securities"))


def io14(s, d):
    e = tx(s, d).where("transaction_code = 'P' AND NOT is_amendment").select("issuer_id", "filing_date").distinct()
    x = J.latest_interval(e, fx(s, d, "fx_intervals"), "issuer_id", "filing_date", ["issuer_id", "filing_date"], "effective_start", "effective_end", [F.desc("security_id")])
    return x.select(F.lit("S2").alias("signal"), "issuer_id", "filing_date", "security_id")


def q5(s, d):
    """Prices against the ranges of the other lines' days; some lack price, date or issuer, some weren't read whole."""
    a = F.col("accession")
    t = tx(s, d).select(
        "accession", "transaction_code", F.when(a % 41 != 0, F.col("issuer_id")).alias("issuer_id"), F.when(a % 37 != 0, F.col("transaction_date")).alias("transaction_date"),
        F.when(a % 31 == 0, -F.col("price")).when(a % 29 != 0, F.col("price")).alias("price"),
    )
    x = quality.price_ladder(t, fx(s, d, "fx_days"), "issuer_id", "transaction_date", "price", F.col("transaction_code").isin("P", "S"), a % 43 != 0)
    return x.groupBy("transaction_code", "status", "matched").agg(F.count("*").alias("n"), r6(F.sum("distance"), "distance"))


Q5_SQL = """WITH t AS (SELECT accession, transaction_code, CASE WHEN accession % 41 <> 0 THEN issuer_id END AS k, CASE WHEN accession % 37 <> 0 THEN transaction_date END AS t, CASE WHEN accession % 31 = 0 THEN -price WHEN accession % 29 <> 0 THEN price END AS p FROM fx_transactions),
m AS MATERIALIZED (SELECT issuer_id AS k, day, CASE WHEN low > 0 AND high >= low THEN low END AS lo, CASE WHEN low > 0 AND high >= low THEN high END AS hi FROM fx_days),
w AS (SELECT k, date_trunc('week', day) AS week, min(lo) AS wl, max(hi) AS wh FROM m GROUP BY 1, 2),
q AS (SELECT DISTINCT k, t FROM t WHERE k IS NOT NULL AND t IS NOT NULL),
n AS (SELECT q.k, q.t, x.lo AS xl, x.hi AS xh, wl, wh, least(x.lo, CASE WHEN q.t - b.day <= 7 THEN b.lo END, CASE WHEN f.day - q.t <= 7 THEN f.lo END) AS al, greatest(x.hi, CASE WHEN q.t - b.day <= 7 THEN b.hi END, CASE WHEN f.day - q.t <= 7 THEN f.hi END) AS ah
  FROM q LEFT JOIN m x ON x.k = q.k AND x.day = q.t LEFT JOIN w ON w.k = q.k AND w.week = date_trunc('week', q.t) ASOF LEFT JOIN m b ON b.k = q.k AND b.day < q.t ASOF LEFT JOIN m f ON f.k = q.k AND f.day > q.t),
j AS (SELECT t.*, xl, xh, al, ah, wl, wh, coalesce(p BETWEEN xl AND xh, FALSE) AS ix, coalesce(p BETWEEN al AND ah, FALSE) AS ia, coalesce(p BETWEEN wl AND wh, FALSE) AS iw FROM t LEFT JOIN n ON n.k = t.k AND n.t = t.t),
z AS (SELECT *, CASE WHEN ix THEN 'exact_day' WHEN ia THEN 'adjacent_trading_days' WHEN iw THEN 'calendar_week' WHEN wl IS NOT NULL THEN 'calendar_week' WHEN al IS NOT NULL THEN 'adjacent_trading_days' WHEN xl IS NOT NULL THEN 'exact_day' END AS f FROM j),
s AS (SELECT *, CASE WHEN accession % 43 = 0 THEN 'NOT_TESTABLE_PARSE_STATUS' WHEN transaction_code NOT IN ('P', 'S') THEN 'NOT_MARKET_COMPARABLE' WHEN p IS NULL THEN 'NO_REPORTED_PRICE' WHEN p <= 0 THEN 'NONPOSITIVE_REPORTED_PRICE'
    WHEN t IS NULL THEN 'NO_TRANSACTION_DATE' WHEN k IS NULL THEN 'NO_SECURITY_IDENTIFIER' WHEN f IS NULL THEN 'NO_MARKET_DATA' WHEN ix THEN 'PASS_EXACT_DAY_RANGE' WHEN ia THEN 'PASS_ADJACENT_DAY_RANGE' WHEN iw THEN 'PASS_WEEKLY_RANGE'
    WHEN f = 'exact_day' THEN 'FLAG_OUTSIDE_EXACT_RANGE' WHEN f = 'adjacent_trading_days' THEN 'FLAG_OUTSIDE_ADJACENT_RANGE' ELSE 'FLAG_OUTSIDE_WEEKLY_RANGE' END AS status,
    CASE f WHEN 'exact_day' THEN xl WHEN 'adjacent_trading_days' THEN al ELSE wl END AS lo, CASE f WHEN 'exact_day' THEN xh WHEN 'adjacent_trading_days' THEN ah ELSE wh END AS hi FROM z),
d AS (SELECT transaction_code, status, CASE WHEN status LIKE 'PASS%' OR status LIKE 'FLAG%' THEN f END AS matched, CASE WHEN status LIKE 'PASS%' OR status LIKE 'FLAG%' THEN CASE WHEN p < lo THEN p - lo WHEN p > hi THEN p - hi ELSE 0.0 END END AS x FROM s)
SELECT transaction_code, status, matched, count(*) AS n, round(sum(x), 6) AS distance FROM d GROUP BY 1, 2, 3"""


Q = {
    "j11_path_join": (j11, "WITH p AS (SELECT *, count(*) OVER (PARTITION BY security_id ORDER BY session_no) AS u FROM fx_daily) SELECT a.security_id, a.session_no, round(b.close / a.close - 1, 6) AS r3, b.u - a.u = 3 AS complete FROM p a JOIN p b ON a.security_id = b.security_id AND b.session_no = a.session_no + 3"),
    "j15_classification_history": (j15, """WITH h AS (SELECT DISTINCT issuer_id, CAST(date_trunc('year', filing_date) AS DATE) AS a FROM fx_transactions WHERE line_no = 1 AND shares > 45), e AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY issuer_id ORDER BY a) - 1, DATE '2100-01-01') AS b FROM h)
        SELECT i.issuer_id, security_id, CAST(greatest(effective_start, a) AS DATE) AS start, CAST(least(effective_end, b) AS DATE) AS "end" FROM fx_intervals i JOIN e ON e.issuer_id = i.issuer_id WHERE a <= effective_end AND effective_start <= b"""),
    "a14_per_year_tables": (a14, f"WITH {X1}, x AS (SELECT *, year(filing_date) AS year FROM x1), {_mean_sql(['year', 'horizon'], 'x')} SELECT * FROM res"),
    "a15_attrition_counts": (a15, f"WITH {E1_SQL} SELECT horizon, count(*) AS events, count(*) FILTER (WHERE delisted) AS delisted, count(*) FILTER (WHERE partial_path) AS partial, count(excess_return) AS used FROM e1 GROUP BY 1"),
    "a16_coverage": (a16, f"WITH {E1_SQL} SELECT horizon, round(avg(CASE WHEN stock_return IS NOT NULL THEN 1 ELSE 0 END), 6) AS complete_share FROM e1 GROUP BY 1"),
    "a21_parse_status_summary": (a21, "SELECT transaction_code, is_amendment, count(*) AS n, count(DISTINCT accession) AS filings, count(DISTINCT owner_id) AS owners FROM fx_transactions GROUP BY 1, 2"),
    "w8_pick_one_per_key": (w8, "SELECT issuer_id, security_id, is_point_in_time FROM fx_intervals QUALIFY row_number() OVER (PARTITION BY issuer_id ORDER BY is_point_in_time DESC, effective_start DESC, security_id DESC) = 1"),
    "w19_rebased_event_path": (w19, "SELECT a.security_id, a.session_no AS at_no, b.session_no - a.session_no AS k, round(100 * b.close / a.close, 6) AS level FROM fx_daily a JOIN fx_daily b ON a.security_id = b.security_id AND b.session_no BETWEEN a.session_no - 10 AND a.session_no + 10 WHERE a.session_no % 50 = 0"),
    "t2_value_as_of": (t2, "WITH h AS (SELECT issuer_id, filing_date, max(owner_id) AS value FROM fx_transactions GROUP BY 1, 2) SELECT i.issuer_id, security_id, effective_start, CASE WHEN effective_start - filing_date <= 400 THEN filing_date END AS since, CASE WHEN effective_start - filing_date <= 400 THEN value END AS value FROM fx_intervals i ASOF LEFT JOIN h ON h.issuer_id = i.issuer_id AND i.effective_start >= h.filing_date"),
    "t9_classification_history_union": (t9, "SELECT issuer_id, CASE transaction_code WHEN 'P' THEN 'LINE' ELSE 'SIZE' END AS rule, count(DISTINCT date_trunc('month', filing_date)) AS n, CAST(min(date_trunc('month', filing_date)) AS DATE) AS first FROM fx_transactions WHERE transaction_code IN ('P', 'S') GROUP BY 1, 2"),
    "t11_outcome_side_tables": (t11, "SELECT security_id, session_date FROM fx_daily WHERE delisted"),
    "o1_stable_sort": (o1, "SELECT issuer_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, issuer_id) AS place FROM fx_transactions GROUP BY 1"),
    "o4_union_by_name": (o4, "SELECT issuer_id, round(sum(shares) FILTER (WHERE transaction_code = 'P'), 6) AS bought, round(sum(shares) FILTER (WHERE transaction_code = 'S'), 6) AS sold FROM fx_transactions WHERE transaction_code IN ('P', 'S') GROUP BY 1"),
    "o5_set_difference": (o5, "WITH a AS (SELECT DISTINCT accession FROM fx_transactions WHERE transaction_code = 'P'), b AS (SELECT DISTINCT accession FROM fx_transactions WHERE transaction_code = 'S') SELECT 'P not S' AS side, count(*) AS n FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'S not P', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"),
    "o7_distinct_rows": (o7, "SELECT DISTINCT issuer_id, owner_id, transaction_code FROM fx_transactions"),
    "e7_load_benchmark": (e7, "SELECT c.session_no, c.session_date, round(level, 6) AS level FROM fx_calendar c LEFT JOIN (SELECT session_no, level FROM fx_benchmark WHERE session_no % 13 <> 0) b ON b.session_no = c.session_no"),
    "e9_dollar_terciles": (e9, "WITH e AS (SELECT issuer_id, filing_date, sum(shares * price) AS v FROM fx_transactions WHERE transaction_code = 'S' GROUP BY 1, 2), c AS (SELECT y.y, quantile_cont(v, 1.0 / 3) AS a, quantile_cont(v, 2.0 / 3) AS b FROM (SELECT DISTINCT year(filing_date) AS y FROM e) y JOIN e ON year(filing_date) < y.y GROUP BY 1) SELECT year(filing_date) AS year, CASE WHEN a IS NULL THEN NULL WHEN v <= a THEN 1 WHEN v <= b THEN 2 ELSE 3 END AS tercile, count(*) AS n FROM e LEFT JOIN c ON c.y = year(filing_date) GROUP BY 1, 2"),
    "e15_purchase_day_attributes": (e15, "SELECT issuer_id, filing_date, round(sum(shares * price), 6) AS dollars, bool_or(owner_id % 4 = 0) AS senior FROM fx_transactions WHERE transaction_code = 'P' AND NOT is_amendment GROUP BY 1, 2"),
    "e16_conditioning_table": (e16, f"WITH {X1}, x AS (SELECT *, 'half' AS dim, CASE WHEN month(filing_date) <= 6 THEN 'H1' ELSE 'H2' END AS grp FROM x1 UNION ALL SELECT *, 'parity', CAST(year(filing_date) % 2 AS VARCHAR) FROM x1), {_mean_sql(['dim', 'grp', 'horizon'], 'x')} SELECT * FROM res"),
    "e24_example_trade_table": (e24, f"WITH {E1_SQL} SELECT event_id, entry_no, end_no, round(100 * (1 + stock_return), 4) AS value_of_100 FROM e1 WHERE horizon = 5 AND stock_return IS NOT NULL"),
    "s12_periodic_stats": (s12, f"WITH {R}, q AS (SELECT security_id, date_trunc('quarter', session_date) AS q, exp(sum(ln(1 + r))) - 1 AS r FROM r GROUP BY 1, 2) SELECT security_id, count(r) AS n, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS vol FROM q GROUP BY 1 HAVING count(r) >= 12"),
    "io4_normalize_archive": (io4, "WITH t AS (SELECT *, CAST(year(filing_date) AS VARCHAR) || 'Q' || quarter(filing_date) AS quarter FROM fx_transactions) SELECT 'submissions' AS table_name, quarter, count(DISTINCT accession) AS n FROM t GROUP BY 2 UNION ALL SELECT 'owners', quarter, count(DISTINCT accession || '|' || owner_id) FROM t GROUP BY 2 UNION ALL SELECT 'transactions', quarter, count(DISTINCT accession || '|' || line_no) FROM t GROUP BY 2"),
    "io5_normalize_all_archive": (io5, "SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE substr(o_orderpriority, 1, 1) IN ('3', '4', '5')) GROUP BY 1"),
    "io14_export_events": (io14, "WITH d AS (SELECT DISTINCT issuer_id, filing_date FROM fx_transactions WHERE transaction_code = 'P' AND NOT is_amendment) SELECT 'S2' AS signal, d.issuer_id, filing_date, security_id FROM d JOIN fx_intervals i ON i.issuer_id = d.issuer_id AND filing_date BETWEEN effective_start AND effective_end QUALIFY row_number() OVER (PARTITION BY d.issuer_id, filing_date ORDER BY effective_start DESC, security_id DESC) = 1"),
    "io15_extract_security_history": (io15, "SELECT issuer_id, security_id, effective_start, effective_end FROM fx_intervals WHERE is_point_in_time AND effective_start <= '1999-12-31' AND effective_end >= '1997-06-01'"),
    "io16_pull_daily": (io16, "SELECT year(session_date) AS year, count(*) AS n, count(DISTINCT security_id) AS securities FROM fx_daily WHERE security_id LIKE 'Brand#1%' GROUP BY 1"),
    "q5_price_status_ladder": (q5, Q5_SQL),
}
QUERIES = {k: (f, with_views(q) if q else None) for k, (f, q) in Q.items()}
