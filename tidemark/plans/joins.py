"""Queries of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from .fixtures import fx, with_views

r6 = lambda c, n: F.round(c, 6).alias(n)
T = lambda s, d, n: s.read.parquet(f"{d}/{n}.parquet")


def issuer_days(s, d):
    return fx(s, d, "fx_transactions").where("transaction_code IN ('P', 'S') AND NOT is_amendment").select("issuer_id", "filing_date").distinct()


DAYS = "d AS (SELECT DISTINCT issuer_id, filing_date FROM fx_transactions WHERE transaction_code IN ('P', 'S') AND NOT is_amendment)"


def j1(s, d):
    return J.equi_join(T(s, d, "orders"), T(s, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"], "many_to_one").groupBy("c_mktsegment").agg(F.count("*").alias("n"), r6(F.sum("o_totalprice"), "total"))


def j2(s, d):
    t = fx(s, d, "fx_transactions")
    bought, sold = t.where("transaction_code = 'P'").select("accession").distinct(), t.where("transaction_code = 'S'").select("accession")
    return bought.join(sold, "accession", "left_anti").join(t.where("is_amendment").select("accession"), "accession", "left_semi")


def j3(s, d):
    return J.latest_interval(issuer_days(s, d), fx(s, d, "fx_intervals"), "issuer_id", "filing_date", ["issuer_id", "filing_date"], "effective_start", "effective_end", [F.desc("security_id")]).select("issuer_id", "filing_date", "security_id", "effective_start")


def j4(s, d):
    return J.pit_map(issuer_days(s, d), fx(s, d, "fx_intervals"), "issuer_id", "filing_date", ["issuer_id", "filing_date"], "security_id", "effective_start", "effective_end", "is_point_in_time")


J4_SQL = f"""WITH {DAYS}, c AS (SELECT d.*, security_id, is_point_in_time, bool_or(is_point_in_time) OVER (PARTITION BY d.issuer_id, filing_date) AS any_pit FROM d JOIN fx_intervals i ON i.issuer_id = d.issuer_id AND filing_date BETWEEN effective_start AND effective_end),
u AS (SELECT issuer_id, filing_date, min(security_id) AS s, count(DISTINCT security_id) AS k FROM c WHERE NOT any_pit OR is_point_in_time GROUP BY 1, 2)
SELECT d.issuer_id, d.filing_date, CASE WHEN k = 1 THEN s END AS security_id, CASE WHEN k IS NULL THEN 'no_match' WHEN k > 1 THEN 'ambiguous' ELSE 'mapped' END AS status FROM d LEFT JOIN u ON u.issuer_id = d.issuer_id AND u.filing_date = d.filing_date"""


def j5(s, d):
    """Audit of the mapping with a tie-break on the ticker."""
    days, iv = issuer_days(s, d), fx(s, d, "fx_intervals")
    key = ["issuer_id", "filing_date"]
    c = J.interval_candidates(days, iv, "issuer_id", "filing_date", "effective_start", "effective_end", months=12).withColumn("mine", F.col("security_id") % 10 == 9)
    g = c.groupBy(*key).agg(F.countDistinct("security_id").alias("k"), F.count_if("mine").alias("m"))
    out = days.join(g, key, "left")
    st = F.when(F.col("k").isNull(), "no_match").when(F.col("k") == 1, "unique").when(F.col("m") == 1, "ticker").otherwise("ambiguous_share_class")
    return out.groupBy(st.alias("status")).agg(F.count("*").alias("n"))


def j6(s, d):
    days = issuer_days(s, d)
    pit = fx(s, d, "fx_intervals").where("is_point_in_time").select("issuer_id", "effective_start", "effective_end")
    inside = J.interval_candidates(days, pit, "issuer_id", "filing_date", "effective_start", "effective_end", months=12).select("issuer_id", "filing_date").distinct().withColumn("in_universe", F.lit(True))
    return days.join(inside, ["issuer_id", "filing_date"], "left").select("issuer_id", "filing_date", F.coalesce("in_universe", F.lit(False)).alias("in_universe"))


def j7(s, d):
    return J.link_prefer_primary(issuer_days(s, d), fx(s, d, "fx_intervals"), "issuer_id", "filing_date", ["issuer_id", "filing_date"], "effective_start", "effective_end", "is_point_in_time", [F.desc("effective_start"), F.desc("security_id")]).select("issuer_id", "filing_date", "security_id", "is_valid")


def j8(s, d):
    days = issuer_days(s, d).select(F.col("issuer_id").alias("security_id"), "filing_date")
    a = J.asof(days, fx(s, d, "fx_daily").select("security_id", "session_date", "close"), "security_id", "filing_date", "session_date", ["close"], tolerance=4)
    return a.select("security_id", "filing_date", "asof_session_date", r6(F.col("asof_close"), "close"))


def j10(s, d):
    days = issuer_days(s, d).select(F.col("issuer_id").alias("security_id"), "filing_date")
    px = fx(s, d, "fx_daily").select("security_id", "session_date", "low")
    a = J.asof(days, px, "security_id", "filing_date", "session_date", ["low"], strict=True, tolerance=7).withColumnsRenamed({"asof_session_date": "before", "asof_low": "low_before"})
    b = J.asof(a, px, "security_id", "filing_date", "session_date", ["low"], strict=True, tolerance=7, forward=True)
    return b.select("security_id", "filing_date", "before", r6(F.col("low_before"), "low_before"), F.col("asof_session_date").alias("after"), r6(F.col("asof_low"), "low_after"))


def j12(s, d):
    t = fx(s, d, "fx_transactions")
    rows, owners = t.select("accession", "line_no").distinct(), t.select("accession", "owner_id").distinct()
    return rows.join(owners, "accession").groupBy("accession").agg(F.count("*").alias("n"), F.countDistinct("owner_id").alias("owners"))


def j13(s, d):
    t = fx(s, d, "fx_transactions").where("NOT is_amendment")
    leg = lambda code, name: t.where(F.col("transaction_code") == code).where(F.col("price") > 1900).groupBy("filing_date").agg(F.avg("price").alias(name))
    o = leg("P", "a").join(leg("S", "b"), "filing_date", "full")
    return o.select("filing_date", r6(0.5 * F.coalesce("a", F.lit(0.0)) - 0.5 * F.coalesce("b", F.lit(0.0)), "long_short"))


def j14(s, d):
    i = fx(s, d, "fx_intervals")
    hist = i.where("is_point_in_time").select("issuer_id", "security_id", F.col("effective_start").alias("start"), F.col("effective_end").alias("end"))
    cur = i.where("NOT is_point_in_time").select("issuer_id", F.col("security_id").alias("link_id"), F.date_sub("effective_start", 200).alias("start"), F.date_add("effective_end", 200).alias("end"))
    return J.overlap_join(hist, cur, "issuer_id").withColumn("origin", F.lit("history")).unionByName(cur.withColumn("security_id", F.lit(None).cast("int")).withColumn("origin", F.lit("current")), allowMissingColumns=True)


def j16(s, d):
    """Members with their crosswalk; ids and dates must agree."""
    m = fx(s, d, "fx_intervals").select(F.concat_ws(":", "security_id", "effective_start").alias("id"), "issuer_id", "effective_start", "effective_end")
    x = m.select("id", F.col("issuer_id").alias("x_issuer"), F.col("effective_end").alias("x_end"))
    out = J.equi_join(m, x, ["id"], "one_to_one")
    return out.select("id", "issuer_id", "effective_start", (~(F.col("issuer_id").eqNullSafe(F.col("x_issuer")) & F.col("effective_end").eqNullSafe(F.col("x_end")))).alias("disagrees"))


def o_sets(s, d):
    t = fx(s, d, "fx_transactions")
    m = lambda code: F.sort_array(F.collect_set(F.when(F.col("transaction_code") == code, F.month("transaction_date"))))
    g = t.groupBy("issuer_id", "owner_id").agg(m("P").alias("p"), m("S").alias("s"))
    return g.select("issuer_id", "owner_id", F.size(F.array_intersect("p", "s")).cast("long").alias("common"), F.size(F.array_except("p", "s")).cast("long").alias("only_bought"))


def o8(s, d):
    """One job for all cells of a configuration grid (2 x 2 x 7 x 2 = 56)."""
    grid = s.sql("SELECT w, k, h, side FROM (SELECT explode(array(7, 14)) AS w) LATERAL VIEW explode(array(2, 3)) AS k LATERAL VIEW explode(array(1, 2, 3, 5, 10, 21, 63)) AS h LATERAL VIEW explode(array('P', 'S')) AS side")
    t = fx(s, d, "fx_transactions").groupBy("issuer_id", "filing_date", F.col("transaction_code").alias("side")).agg(F.countDistinct("owner_id").alias("owners"))
    n = t.groupBy("side", "owners").agg(F.count("*").alias("days"))
    return grid.join(F.broadcast(n), "side").where("owners >= k").groupBy("w", "k", "h", "side").agg(F.sum("days").alias("days"))


Q = {
    "j1_equi_join_contract": (j1, "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 6) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "j2_membership": (j2, "SELECT DISTINCT accession FROM fx_transactions t WHERE transaction_code = 'P' AND accession NOT IN (SELECT accession FROM fx_transactions WHERE transaction_code = 'S') AND accession IN (SELECT accession FROM fx_transactions WHERE is_amendment)"),
    "j3_interval_join": (j3, f"WITH {DAYS} SELECT d.issuer_id, filing_date, security_id, effective_start FROM d JOIN fx_intervals i ON i.issuer_id = d.issuer_id AND filing_date BETWEEN effective_start AND effective_end QUALIFY row_number() OVER (PARTITION BY d.issuer_id, filing_date ORDER BY effective_start DESC, security_id DESC) = 1"),
    "j4_pit_map": (j4, J4_SQL),
    "j5_pit_map_with_ticker": (j5, f"""WITH {DAYS}, c AS (SELECT d.issuer_id, filing_date, count(DISTINCT security_id) AS k, count(*) FILTER (WHERE security_id % 10 = 9) AS m FROM d JOIN fx_intervals i ON i.issuer_id = d.issuer_id AND filing_date BETWEEN effective_start AND effective_end GROUP BY 1, 2)
        SELECT CASE WHEN k IS NULL THEN 'no_match' WHEN k = 1 THEN 'unique' WHEN m = 1 THEN 'ticker' ELSE 'ambiguous_share_class' END AS status, count(*) AS n FROM d LEFT JOIN c USING (issuer_id, filing_date) GROUP BY 1"""),
    "j6_in_universe": (j6, f"WITH {DAYS} SELECT *, EXISTS (SELECT 1 FROM fx_intervals i WHERE is_point_in_time AND i.issuer_id = d.issuer_id AND filing_date BETWEEN effective_start AND effective_end) AS in_universe FROM d"),
    "j7_link_map_prefer_primary": (j7, f"""WITH {DAYS} SELECT d.issuer_id, filing_date, security_id, coalesce(filing_date BETWEEN effective_start AND effective_end, FALSE) AS is_valid FROM d LEFT JOIN fx_intervals i ON i.issuer_id = d.issuer_id
        QUALIFY row_number() OVER (PARTITION BY d.issuer_id, filing_date ORDER BY coalesce(filing_date BETWEEN effective_start AND effective_end, FALSE) DESC, is_point_in_time DESC, effective_start DESC, security_id DESC) = 1"""),
    "j8_asof_backward": (j8, f"""WITH {DAYS} SELECT d.issuer_id AS security_id, filing_date, CASE WHEN filing_date - session_date <= 4 THEN session_date END AS asof_session_date, CASE WHEN filing_date - session_date <= 4 THEN round(close, 6) END AS close
        FROM d ASOF LEFT JOIN fx_daily p ON p.security_id = d.issuer_id AND d.filing_date >= p.session_date"""),
    "j10_adjacent_observations": (j10, f"""WITH {DAYS}, a AS (SELECT d.issuer_id AS security_id, filing_date, CASE WHEN filing_date - session_date <= 7 THEN session_date END AS before, CASE WHEN filing_date - session_date <= 7 THEN round(low, 6) END AS low_before FROM d ASOF LEFT JOIN fx_daily p ON p.security_id = d.issuer_id AND d.filing_date > p.session_date)
        SELECT a.*, CASE WHEN session_date - filing_date <= 7 THEN session_date END AS after, CASE WHEN session_date - filing_date <= 7 THEN round(low, 6) END AS low_after FROM a ASOF LEFT JOIN fx_daily p ON p.security_id = a.security_id AND a.filing_date < p.session_date"""),
    "j12_joint_owner_expansion": (j12, "SELECT accession, count(DISTINCT line_no) * count(DISTINCT owner_id) AS n, count(DISTINCT owner_id) AS owners FROM fx_transactions GROUP BY 1"),
    "j13_long_short": (j13, """WITH a AS (SELECT filing_date, avg(price) AS a FROM fx_transactions WHERE NOT is_amendment AND price > 1900 AND transaction_code = 'P' GROUP BY 1), b AS (SELECT filing_date, avg(price) AS b FROM fx_transactions WHERE NOT is_amendment AND price > 1900 AND transaction_code = 'S' GROUP BY 1)
        SELECT filing_date, round(0.5 * coalesce(a, 0) - 0.5 * coalesce(b, 0), 6) AS long_short FROM a FULL JOIN b USING (filing_date)"""),
    "j14_history_and_fallback_links": (j14, """WITH h AS (SELECT issuer_id, security_id, effective_start AS a0, effective_end AS a1 FROM fx_intervals WHERE is_point_in_time), c AS (SELECT issuer_id, security_id AS link_id, effective_start - 200 AS b0, effective_end + 200 AS b1 FROM fx_intervals WHERE NOT is_point_in_time)
        SELECT issuer_id, security_id, link_id, CAST(greatest(a0, b0) AS DATE) AS start, CAST(least(a1, b1) AS DATE) AS "end", 'history' AS origin FROM h JOIN c USING (issuer_id) WHERE a0 <= b1 AND b0 <= a1 UNION ALL SELECT issuer_id, NULL, link_id, CAST(b0 AS DATE), CAST(b1 AS DATE), 'current' FROM c"""),
    "j16_load_universe": (j16, "SELECT security_id || ':' || effective_start AS id, issuer_id, effective_start, FALSE AS disagrees FROM fx_intervals"),
    "o6_set_operations": (o_sets, """WITH g AS (SELECT issuer_id, owner_id, coalesce(list(DISTINCT month(transaction_date)) FILTER (WHERE transaction_code = 'P'), []) AS p, coalesce(list(DISTINCT month(transaction_date)) FILTER (WHERE transaction_code = 'S'), []) AS s FROM fx_transactions GROUP BY 1, 2)
        SELECT issuer_id, owner_id, len(list_intersect(p, s)) AS common, len(p) - len(list_intersect(p, s)) AS only_bought FROM g"""),
    "o8_config_grid": (o8, """WITH t AS (SELECT issuer_id, filing_date, transaction_code AS side, count(DISTINCT owner_id) AS owners FROM fx_transactions GROUP BY 1, 2, 3)
        SELECT w, k, h, t.side, count(*) AS days FROM t, (VALUES (7), (14)) a(w), (VALUES (2), (3)) b(k), (VALUES (1), (2), (3), (5), (10), (21), (63)) c(h) WHERE t.side IN ('P', 'S') AND owners >= k GROUP BY 1, 2, 3, 4"""),
}
QUERIES = {k: (f, with_views(q) if q else None) for k, (f, q) in Q.items()}
