"""Queries of interval algebra and data quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import joins as J
from ..operators import quality as Q_
from .fixtures import fx, with_views

r6 = lambda c, n: F.round(c, 6).alias(n)
tx = lambda s, d: fx(s, d, "fx_transactions")


def iv(s, d):
    return fx(s, d, "fx_intervals").select("issuer_id", "security_id", F.col("effective_start").alias("start"), F.col("effective_end").alias("end"), "is_point_in_time")


IV = "iv AS (SELECT issuer_id, security_id, effective_start AS a, effective_end AS b, is_point_in_time AS pit FROM fx_intervals)"


def bounds(s, d):
    return tx(s, d).where("transaction_code = 'P' AND shares > 49").select("issuer_id", F.trunc("filing_date", "MM").alias("boundary")).distinct()


T1_SQL = f"""{IV}, bd AS (SELECT DISTINCT issuer_id, CAST(date_trunc('month', filing_date) AS DATE) AS x FROM fx_transactions WHERE transaction_code = 'P' AND shares > 49),
c AS (SELECT iv.*, a AS s FROM iv UNION SELECT iv.*, x FROM iv JOIN bd ON bd.issuer_id = iv.issuer_id AND x > a AND x <= b),
t1 AS (SELECT issuer_id, security_id, s AS start, coalesce(lead(s) OVER (PARTITION BY issuer_id, security_id, a, b, pit ORDER BY s) - 1, b) AS "end", pit AS is_point_in_time FROM c)"""


def t1(s, d):
    return I.split_at(iv(s, d), bounds(s, d), "issuer_id")


def t4(s, d):
    pieces = t1(s, d).withColumn("grade", F.year("start") % 2)
    return I.coalesce_adjacent(pieces, ["issuer_id", "security_id"], ["grade", "is_point_in_time"])


def t5(s, d):
    h = tx(s, d).where("line_no = 1").select("issuer_id", F.trunc("filing_date", "MM").alias("start")).distinct()
    return I.close_history(h, ["issuer_id"])


def t6(s, d):
    x = iv(s, d).select("issuer_id", "security_id", F.when(F.col("security_id") % 4 != 0, F.col("start")).alias("start"), F.when(F.col("security_id") % 3 != 0, F.col("end")).alias("end"))
    return I.prepare_links(x)


def t7(s, d):
    return I.overlaps(iv(s, d), ["issuer_id"]).select("issuer_id", "security_id", "start", "end")


def t3(s, d):
    days = tx(s, d).select("issuer_id", "filing_date").distinct()
    links = iv(s, d).withColumn("company", F.col("security_id") % 7)
    return I.active_link(days, links, "issuer_id", "filing_date", ["issuer_id", "filing_date"], [F.desc("is_point_in_time")], "company")


def t10(s, d):
    return tx(s, d).select("transaction_date", F.add_months(F.trunc("transaction_date", "MM"), 1).alias("effective_from")).distinct()


def t12(s, d):
    return I.tiles(t1(s, d), iv(s, d), ["issuer_id", "security_id"])


def q15(s, d):
    i = iv(s, d)
    return I.violations({
        "unique_id": i.groupBy("security_id", "start").count().where("count > 1"), "no_overlap": I.overlaps(i, ["issuer_id"]),
        "ordered": i.where("start > end"), "tiled": t12(s, d).where("NOT ok"),
    })


def q2(s, d):
    p = fx(s, d, "fx_daily")
    w = Window.partitionBy("security_id").orderBy("session_no")
    x = p.withColumn("cap_lag", F.lag("cap").over(w)).withColumn("adv_lag", F.avg(F.col("close") * F.col("volume")).over(w.rowsBetween(-20, -1)))
    v = F.col("close") * F.col("volume")
    return x.select("security_id", "session_no", Q_.large_trade(v, F.col("cap_lag") * 10, F.col("adv_lag")).alias("large"))


FLAG_NAMES = ("direction", "after_filing", "late", "outside_range", "scale_error", "is_duplicate", "large_trade")


def market(s, d):
    """Weekly sessions with lagged cap, trailing 20-session dollar volume and the range over five centred sessions."""
    w = Window.partitionBy("security_id").orderBy("session_no")
    past, middle = w.rowsBetween(-20, -1), w.rowsBetween(-2, 2)
    value = F.col("close") * F.col("volume")
    return fx(s, d, "fx_daily").select(
        F.col("security_id").alias("issuer_id"), F.col("session_date").alias("session"), "low", "high", F.abs(F.lag("cap").over(w)).alias("cap_lag"),
        F.when(F.count(value).over(past) == 20, F.avg(value).over(past)).alias("adv"), F.min("low").over(middle).alias("week_low"), F.max("high").over(middle).alias("week_high"),
    )


def flagged(s, d):
    day = market(s, d).withColumnRenamed("session", "week")
    t = tx(s, d).withColumn("week", F.date_trunc("week", "transaction_date").cast("date")).join(day, ["issuer_id", "week"], "left")
    dup = t.groupBy("owner_id", "issuer_id", "transaction_date", "shares", "price").agg((F.countDistinct("accession") > 1).alias("is_duplicate"))
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"dup.{c}")) for c in ("owner_id", "issuer_id", "transaction_date", "shares", "price")]  # a missing price is a price like others
    t = t.alias("t").join(dup.alias("dup"), same).select("t.*", "is_duplicate")
    return Q_.transaction_flags(t).select("accession", "line_no", "transaction_code", "price", "shares", "status", *FLAG_NAMES)


FLAGS = """m AS (SELECT security_id, session_date, low, high, abs(lag(cap) OVER w) AS cap_lag,
  CASE WHEN count(close * volume) OVER p = 20 THEN avg(close * volume) OVER p END AS adv FROM fx_daily
  WINDOW w AS (PARTITION BY security_id ORDER BY session_no), p AS (PARTITION BY security_id ORDER BY session_no ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
f AS (SELECT accession, line_no, transaction_code, price, shares, NOT coalesce((transaction_code = 'P' AND acquired_disposed = 'A') OR (transaction_code = 'S' AND acquired_disposed = 'D'), FALSE) AS direction,
  coalesce(filing_date < transaction_date, TRUE) AS after_filing, coalesce(filing_date - transaction_date > 30, FALSE) AS late,
  coalesce(price > 0 AND low > 0 AND high > 0 AND (price < 0.99 * low OR price > 1.01 * high), FALSE) AS outside_range,
  coalesce(price > 0 AND low > 0 AND high > 0 AND (price >= 10 * high OR price <= low / 10), FALSE) AS scale_error,
  coalesce(abs(shares) * abs(price) > 0.01 * cap_lag, FALSE) OR coalesce(abs(shares) * abs(price) > adv, FALSE) AS large_trade,
  CASE WHEN low IS NULL THEN 'no_data' WHEN price < low * 0.99 THEN 'below' WHEN price > high * 1.01 THEN 'above' ELSE 'pass' END AS status, k > 1 AS is_duplicate
  FROM fx_transactions t LEFT JOIN m p ON p.security_id = t.issuer_id AND p.session_date = date_trunc('week', t.transaction_date)
  JOIN (SELECT owner_id AS o, issuer_id AS i, transaction_date AS td, shares AS sh, price AS pr, count(DISTINCT accession) AS k FROM fx_transactions GROUP BY 1, 2, 3, 4, 5) g
    ON g.o IS NOT DISTINCT FROM t.owner_id AND g.i IS NOT DISTINCT FROM t.issuer_id AND g.td IS NOT DISTINCT FROM t.transaction_date AND g.sh IS NOT DISTINCT FROM t.shares AND g.pr IS NOT DISTINCT FROM t.price)"""


def q1(s, d):
    hit = F.lit(False)
    for c in FLAG_NAMES:
        hit = hit | F.col(c)
    return flagged(s, d).groupBy("transaction_code").agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"n_{c}") for c in FLAG_NAMES], F.count_if(hit).alias("n_any"))


def q4(s, d):
    """Each comparable price against the range of the last session, at most four days back, and of five sessions around it."""
    rows = J.asof(tx(s, d).where("price > 0"), market(s, d), "issuer_id", "transaction_date", "session", ["low", "high", "week_low", "week_high"], tolerance=4)
    x = Q_.price_ranges(rows.where("asof_low > 0 AND asof_high > 0"), "price", "asof_low", "asof_high", "asof_week_low", "asof_week_high")
    return x.groupBy("transaction_code").agg(
        F.count("*").alias("n"), *[F.count_if(c).alias(f"n_{c}") for c in ("within_day", "within_week", "below_week", "above_week")], r6(F.avg("ratio_to_week_low"), "ratio_to_week_low")
    )


def a10(s, d):
    x = flagged(s, d)
    return x.groupBy("transaction_code").agg(r6(F.avg((F.col("status") == "pass").cast("int")), "pass_share"), r6(F.expr("percentile(CASE WHEN status IN ('below', 'above') THEN price END, 0.5)"), "median_failing"))


def a20(s, d):
    x = flagged(s, d).select(F.explode(F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(c).alias("hit")) for c in FLAG_NAMES])).alias("e"))
    return x.groupBy("e.check_name").agg(F.count("*").alias("n"), F.count_if("e.hit").alias("flagged"), r6(100.0 * F.count_if("e.hit") / F.count("*"), "pct"))


def q3(s, d):
    w = Window.partitionBy("security_id").orderBy("session_no")
    x = fx(s, d, "fx_daily").withColumn("r", F.col("close") / F.lag("close").over(w) - 1)
    x = x.withColumn("ext", F.sum(F.coalesce((F.abs("r") > 0.05).cast("int"), F.lit(0))).over(w))
    end = x.select("security_id", (F.col("session_no") - 5).alias("session_no"), F.col("ext").alias("e5"))
    return x.join(end, ["security_id", "session_no"]).select("security_id", "session_no", ((F.col("e5") - F.col("ext")) > 0).alias("extreme"))


def q7(s, d):
    t = tx(s, d)
    total = F.col("shares") * F.col("price") + F.when(F.col("accession") % 9 == 0, 1.0).otherwise(0.0)
    return t.select("accession", "line_no", (F.abs(total - F.col("shares") * F.col("price")) <= 0.01).alias("ok")).groupBy("ok").agg(F.count("*").alias("n"))


def q10(s, d):
    rows = fx(s, d, "fx_intervals").select("issuer_id", "security_id", "effective_start", "effective_end")
    splits = tx(s, d).where("shares = 50 AND line_no = 1").groupBy("issuer_id", F.col("filing_date").alias("effective_date")).agg((1.0 + F.count("*")).alias("split_factor"))
    return Q_.split_factor_between(rows, splits, "issuer_id", "effective_start", "effective_end", ["issuer_id", "security_id"]).select("issuer_id", "security_id", r6(F.ln("factor"), "log_factor"))


def q12(s, d):
    return tx(s, d).select("accession", "line_no", F.concat_ws("|", F.lower("issuer_id"), "owner_id", F.lit("nonderiv"), F.lit("common_stock"), "acquired_disposed").alias("position_key")).distinct()


Q = {
    "t1_split_at_boundaries": (t1, f"WITH {T1_SQL} SELECT * FROM t1"),
    "t3_active_link": (t3, f"""WITH {IV}, d AS (SELECT DISTINCT issuer_id, filing_date FROM fx_transactions), c AS (SELECT d.*, security_id % 7 AS company, rank() OVER (PARTITION BY d.issuer_id, filing_date ORDER BY pit DESC) AS r FROM d JOIN iv ON iv.issuer_id = d.issuer_id AND filing_date BETWEEN a AND b)
        SELECT issuer_id, filing_date, CASE WHEN count(DISTINCT company) = 1 THEN min(company) END AS company, CASE WHEN count(DISTINCT company) = 1 THEN 'linked' ELSE 'AMBIGUOUS' END AS status FROM c WHERE r = 1 GROUP BY 1, 2"""),
    "t4_coalesce_adjacent": (t4, f"""WITH {T1_SQL}, g AS (SELECT *, year(start) % 2 AS grade FROM t1), n AS (SELECT *, CASE WHEN lag("end") OVER w + 1 = start AND lag(grade) OVER w IS NOT DISTINCT FROM grade AND lag(is_point_in_time) OVER w IS NOT DISTINCT FROM is_point_in_time THEN 0 ELSE 1 END AS nw FROM g WINDOW w AS (PARTITION BY issuer_id, security_id ORDER BY start, "end", grade, is_point_in_time)),
        r AS (SELECT *, sum(nw) OVER (PARTITION BY issuer_id, security_id ORDER BY start, "end", grade, is_point_in_time ROWS UNBOUNDED PRECEDING) AS run FROM n) SELECT issuer_id, security_id, grade, is_point_in_time, min(start) AS start, max("end") AS "end" FROM r GROUP BY issuer_id, security_id, run, grade, is_point_in_time"""),
    "t5_prepare_history": (t5, """WITH h AS (SELECT DISTINCT issuer_id, CAST(date_trunc('month', filing_date) AS DATE) AS start FROM fx_transactions WHERE line_no = 1) SELECT issuer_id, start, lead(start) OVER (PARTITION BY issuer_id ORDER BY start) - 1 AS "end" FROM h"""),
    "t6_prepare_links": (t6, f"""WITH {IV}, l AS (SELECT DISTINCT issuer_id, security_id, CASE WHEN security_id % 4 <> 0 THEN a ELSE DATE '1900-01-01' END AS start, CASE WHEN security_id % 3 <> 0 THEN b ELSE DATE '2100-01-01' END AS "end" FROM iv) SELECT * FROM l WHERE start <= "end" """),
    "t7_overlap_check": (t7, f"""WITH {IV}, m AS (SELECT *, max(b) OVER (PARTITION BY issuer_id ORDER BY a, b, security_id, pit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM iv) SELECT issuer_id, security_id, a AS start, b AS "end" FROM m WHERE a <= m"""),
    "t10_effective_month": (t10, "SELECT DISTINCT transaction_date, CAST(date_trunc('month', transaction_date) + INTERVAL 1 MONTH AS DATE) AS effective_from FROM fx_transactions"),
    "q1_transaction_flags": (q1, f"WITH {FLAGS} SELECT transaction_code, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS n_{c}" for c in FLAG_NAMES) + f", count(*) FILTER (WHERE {' OR '.join(FLAG_NAMES)}) AS n_any FROM f GROUP BY 1"),
    "q2_large_trade": (q2, "WITH x AS (SELECT *, lag(cap) OVER w AS cl, avg(close * volume) OVER (PARTITION BY security_id ORDER BY session_no ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS al FROM fx_daily WINDOW w AS (PARTITION BY security_id ORDER BY session_no)) SELECT security_id, session_no, coalesce(close * volume > 0.01 * (cl * 10), FALSE) OR coalesce(close * volume > al, FALSE) AS large FROM x"),
    "q3_event_market_flags": (q3, "WITH r AS (SELECT *, close / lag(close) OVER (PARTITION BY security_id ORDER BY session_no) - 1 AS r FROM fx_daily), x AS (SELECT *, sum(CASE WHEN abs(r) > 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY security_id ORDER BY session_no) AS e FROM r) SELECT a.security_id, a.session_no, b.e - a.e > 0 AS extreme FROM x a JOIN x b ON a.security_id = b.security_id AND b.session_no = a.session_no + 5"),
    "q4_price_in_range": (q4, """WITH m AS (SELECT security_id, session_date, low, high, min(low) OVER w AS wl, max(high) OVER w AS wh FROM fx_daily WINDOW w AS (PARTITION BY security_id ORDER BY session_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
        x AS (SELECT t.*, low, high, wl, wh FROM fx_transactions t ASOF JOIN m ON m.security_id = t.issuer_id AND m.session_date <= t.transaction_date WHERE t.transaction_date - m.session_date <= 4 AND price > 0 AND low > 0 AND high > 0)
        SELECT transaction_code, count(*) AS n, count(*) FILTER (WHERE price BETWEEN 0.99 * low AND 1.01 * high) AS n_within_day, count(*) FILTER (WHERE price BETWEEN 0.99 * wl AND 1.01 * wh) AS n_within_week,
        count(*) FILTER (WHERE price < 0.99 * wl) AS n_below_week, count(*) FILTER (WHERE price > 1.01 * wh) AS n_above_week, round(avg(CASE WHEN price < 0.99 * wl THEN price / wl END), 6) AS ratio_to_week_low FROM x GROUP BY 1"""),
    "q7_value_check": (q7, "SELECT accession % 9 <> 0 AS ok, count(*) AS n FROM fx_transactions GROUP BY 1"),
    "q10_split_factor_between": (q10, """WITH s AS (SELECT issuer_id, filing_date AS e, 1.0::DOUBLE + count(*) AS f FROM fx_transactions WHERE shares = 50 AND line_no = 1 GROUP BY 1, 2) SELECT i.issuer_id, i.security_id, round(coalesce(sum(ln(f)), 0), 6) AS log_factor FROM fx_intervals i LEFT JOIN s ON s.issuer_id = i.issuer_id AND e > effective_start AND e <= effective_end GROUP BY 1, 2"""),
    "q12_position_key": (q12, "SELECT DISTINCT accession, line_no, lower(issuer_id) || '|' || owner_id || '|nonderiv|common_stock|' || acquired_disposed AS position_key FROM fx_transactions"),
    "q15_universe_invariants": (q15, f"WITH {IV}, m AS (SELECT *, max(b) OVER (PARTITION BY issuer_id ORDER BY a, b, security_id, pit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM iv) SELECT 'unique_id' AS check_name, count(*) AS violations FROM (SELECT 1 FROM iv GROUP BY security_id, a HAVING count(*) > 1) UNION ALL SELECT 'no_overlap', count(*) FROM m WHERE a <= m UNION ALL SELECT 'ordered', count(*) FROM iv WHERE a > b UNION ALL SELECT 'tiled', 0"),
    "a10_summarize_price_checks": (a10, f"WITH {FLAGS} SELECT transaction_code, round(avg(CASE WHEN status = 'pass' THEN 1 ELSE 0 END), 6) AS pass_share, round(quantile_cont(CASE WHEN status IN ('below', 'above') THEN price END, 0.5), 6) AS median_failing FROM f GROUP BY 1"),
    "a20_flag_summary": (a20, f"WITH {FLAGS}, u AS (SELECT unnest({[*FLAG_NAMES]}) AS check_name, unnest([{', '.join(FLAG_NAMES)}]) AS hit FROM f) SELECT check_name, count(*) AS n, count(*) FILTER (WHERE hit) AS flagged, round(100.0 * count(*) FILTER (WHERE hit) / count(*), 6) AS pct FROM u GROUP BY 1"),
}
QUERIES = {k: (f, with_views(q) if q else None) for k, (f, q) in Q.items()}
