"""Queries of scans, projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .fixtures import fx, with_views

T = lambda s, d, n: s.read.parquet(f"{d}/{n}.parquet")
r6 = lambda c, n: F.round(c, 6).alias(n)
tx = lambda s, d: fx(s, d, "fx_transactions")
side = lambda: F.when(F.col("transaction_code") == "P", 1).when(F.col("transaction_code") == "S", -1)


def p1(s, d):
    c = T(s, d, "customer")
    raw = F.when(F.col("c_custkey") % 5 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    day = F.when(F.col("c_custkey") % 3 == 0, "2021-02-30").otherwise(F.concat(F.lit("2021-02-"), F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0")))
    return c.select("c_custkey", r6(S.coerce_number(raw), "balance"), S.coerce_date(day).alias("day"))


def p2(s, d):
    o = T(s, d, "orders")
    text = F.when(F.col("o_orderkey") % 7 == 0, "$n/a").otherwise(F.concat(F.lit(" $"), F.format_number("o_totalprice", 2)))
    return o.select("o_orderkey", S.money_to_decimal(text).cast("double").alias("amount"))


def p3(s, d):
    p = T(s, d, "part")
    return p.select("p_partkey", S.normalize_ticker(F.col("p_brand")).alias("ticker"), S.normalize_security(F.concat("p_name", F.lit(" - Class A "))).alias("security"),
                    S.normalize_text(F.concat(F.lit("  "), "p_name", F.lit(" \t "), "p_type")).alias("clean"))


def roles(s, d):
    c = T(s, d, "customer")
    rel = F.when(F.col("c_custkey") % 4 == 0, "Officer, Director").when(F.col("c_custkey") % 4 == 1, "Ten-Percent-Owner").when(F.col("c_custkey") % 4 == 2, "Director, Other")
    title = F.when(F.col("c_custkey") % 6 == 0, "Chief Executive Officer").when(F.col("c_custkey") % 6 == 2, "Vice President").when(F.col("c_custkey") % 6 == 3, "Chairwoman of the Board").when(F.col("c_custkey") % 6 == 4, "President & COO").when(F.col("c_custkey") % 6 == 5, "Chief Financial Officer")
    flags = S.role_flags(rel, title)
    return c.select("c_custkey", *[v.alias(k) for k, v in flags.items()], S.role_precedence(flags).alias("role"))


ROLES_SQL = """r AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Officer, Director' WHEN 1 THEN 'Ten-Percent-Owner' WHEN 2 THEN 'Director, Other' END AS rel,
  lower(coalesce(CASE c_custkey % 6 WHEN 0 THEN 'Chief Executive Officer' WHEN 2 THEN 'Vice President' WHEN 3 THEN 'Chairwoman of the Board' WHEN 4 THEN 'President & COO' WHEN 5 THEN 'Chief Financial Officer' END, '')) AS t FROM customer),
f AS (SELECT c_custkey, coalesce(lower(rel) LIKE '%officer%', FALSE) AS is_officer, coalesce(lower(rel) LIKE '%director%', FALSE) AS is_director,
  coalesce(regexp_replace(lower(rel), '[^a-z]', '', 'g') LIKE '%tenpercentowner%', FALSE) AS is_ten_percent, coalesce(lower(rel) LIKE '%other%', FALSE) AS is_other,
  regexp_matches(t, '\\bceo\\b|chief executive') AS is_ceo, regexp_matches(t, '\\bcfo\\b|chief financial') AS is_cfo, regexp_matches(t, '\\bcoo\\b|chief operating') AS is_coo,
  regexp_matches(t, '\\bchair(man|woman|person)?\\b') AS is_chair, regexp_matches(t, '\\bpresident\\b') AND NOT regexp_matches(t, 'vice|\\bvp\\b') AS is_president FROM r),
g AS (SELECT *, CASE WHEN is_ceo OR is_cfo OR is_coo OR is_chair OR is_president THEN 'top_executive' WHEN is_officer THEN 'other_officer' WHEN is_director THEN 'director'
  WHEN is_ten_percent THEN 'ten_percent_owner' ELSE 'other' END AS role FROM f)"""


def p7(s, d):
    return tx(s, d).select("accession", "line_no", r6(F.col("shares") * F.col("price"), "trade_value"), side().alias("side"), F.concat_ws(":", "accession", "line_no").alias("row_key"), "is_amendment").distinct()


def p8(s, d):
    t = tx(s, d).select("accession", "line_no", "owner_id").distinct()
    econ = S.row_id(F.col("accession"), F.lit("nonderiv"), F.col("line_no"))
    return t.select("accession", "line_no", econ.alias("economic_id"), S.row_id(econ, F.col("owner_id")).alias("owner_row_id"))


def p9(s, d):
    t = tx(s, d).select("accession", "line_no", "transaction_date", "filing_date").distinct()
    known = F.when(F.col("line_no") % 3 != 0, F.col("transaction_date"))
    return t.select("accession", "line_no", "transaction_date", F.coalesce(known, F.col("filing_date")).alias("event_date"))


def p10(s, d):
    o = T(s, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return o.select("o_orderkey", F.unix_micros(S.available_at(F.lit(None).cast("timestamp"), F.col("day")).cast("timestamp")).alias("available_us"))


def p11(s, d):
    t = tx(s, d).where(~F.col("is_amendment") & F.col("transaction_code").isin("P", "S") & F.col("filing_date").between(F.lit("1996-01-01").cast("date"), F.lit("1999-12-31").cast("date")))
    w = Window.partitionBy("accession", "line_no").orderBy(F.desc("transaction_date"), F.desc("shares"), F.desc("price"), "issuer_id", "owner_id", "transaction_code")
    return t.withColumn("k", F.row_number().over(w)).where("k = 1").select("accession", "line_no", "issuer_id", "owner_id", "filing_date", "transaction_date", "transaction_code", r6(F.col("shares"), "shares"))


def p12(s, d):
    t = tx(s, d).where(F.col("transaction_code").isin("P", "S") & ~F.coalesce("is_amendment", F.lit(False)))
    return t.groupBy("issuer_id", F.coalesce("filing_date", "transaction_date").alias("signal_date"), "transaction_code").agg(F.count("*").alias("n"), r6(F.sum("shares"), "shares"))


def p13(s, d):
    i = fx(s, d, "fx_intervals").where("is_point_in_time AND effective_end >= DATE'1996-06-01' AND effective_start <= DATE'2000-06-30'")
    a, b = F.greatest("effective_start", F.lit("1996-06-01").cast("date")), F.least("effective_end", F.lit("2000-06-30").cast("date"))
    return i.select("issuer_id", a.alias("a"), b.alias("b"), F.concat_ws(":", "security_id", a, b).alias("lineage_id"))


def p15(s, d):
    p = fx(s, d, "fx_positions")
    sd = F.when(F.col("acquired_disposed") == "A", 1).otherwise(-1)
    return p.select("issuer_id", "owner_grp", "seq", r6(S.holding_fraction(F.col("shares"), F.col("reported_after"), sd), "holding_fraction"))


def p16(s, d):
    w = Window.partitionBy("security_id").orderBy("session_no")
    r = F.col("close") / F.lag("close").over(w) - 1
    return fx(s, d, "fx_daily").withColumn("r", r).select("security_id", "session_no", r6(S.winsorize(F.col("r"), -0.9, 2.0), "daily"), r6(S.winsorize(F.col("r") * 10, -1.0, 1.0), "outcome"))


def p17(s, d):
    o = T(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return o.select("day", F.date_sub("day", 6).alias("week_start"), F.trunc("day", "MM").alias("month_start"), F.last_day("day").alias("month_end"), F.quarter("day").cast("long").alias("quarter"))


def p18(s, d):
    t = T(s, d, "documents")
    return t.groupBy("source").agg(*[F.bool_or(v).alias(k) for k, v in S.text_mention_flags(F.col("text")).items()], F.count_if(F.col("text").rlike("(?i)secret")).alias("n_secret"))


def p19(s, d):
    """A form 4 needs a transaction, a form 3 (here: an amended filing) must have none."""
    t = tx(s, d).groupBy("accession").agg(F.bool_or(F.col("transaction_code").isin("P", "S")).alias("traded"), F.bool_or("is_amendment").alias("form3"))
    return t.select("accession", (~F.col("form3") & ~F.col("traded")).alias("form4_without_transaction"), (F.col("form3") & F.col("traded")).alias("form3_with_transaction"))


def io10(s, d):
    """Pages as they are, and wrapped as other kinds of documents."""
    i, h = F.col("page_id") % 8, F.coalesce("html", F.lit(""))
    wrap = lambda a, b="": F.concat(F.lit(a), h, F.lit(b))
    doc = (
        F.when(i == 1, wrap("%PDF-1.4 ")).when(i == 2, wrap("<DOCUMENT>\n<TYPE>4\n")).when(i == 3, wrap("<x:ownershipDocument a='1'>")).when(i == 4, wrap("<edgarSubmission><issuerInfo>"))
        .when(i == 5, F.translate(h, "<", "")).when(i == 6, F.concat(F.translate(h, "<", ""), F.lit(" Statement of Changes in Beneficial Ownership"))).otherwise(F.col("html"))
    )
    name = F.when(F.col("page_id") % 3 == 0, "a.HTM").otherwise("a.txt")
    return T(s, d, "pages").select("page_id", S.detect_format(doc, name).alias("format"))


def io12(s, d):
    p = T(s, d, "pages").select("page_id", "url", F.sha2("html", 256).alias("sha"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))
    w = Window.partitionBy("host").orderBy(F.desc("page_id"))
    return p.select("page_id", "sha", "host", (F.row_number().over(w) == 1).alias("is_latest"))


def io7(s, d):
    o = T(s, d, "orders")
    line = F.when(F.col("o_orderkey") % 11 == 0, "broken line").otherwise(F.concat_ws("|", "o_custkey", F.lit("NAME INC"), F.lit("4"), F.col("o_orderdate").cast("date"), F.concat(F.lit("edgar/data/"), "o_custkey", F.lit("/"), "o_orderkey", F.lit(".txt"))))
    parts = F.split(line, r"\|")
    ok = o.select(parts.alias("p")).where(F.size("p") == 5)
    out = ok.select(F.col("p")[0].try_cast("long").alias("cik"), F.col("p")[2].alias("form"), F.try_to_date(F.col("p")[3], "yyyy-MM-dd").alias("filed"), F.regexp_extract(F.col("p")[4], r"([0-9]+)\.txt$", 1).alias("accession"))
    w = Window.partitionBy("accession").orderBy("cik", "filed")
    return out.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def io2(s, d):
    """The last row of each security and day; the panel's years are pruned by the date filter."""
    w = Window.partitionBy("p_brand", "day").orderBy(F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("l_extendedprice"), F.desc("l_partkey"), F.desc("l_quantity"))
    lines = T(s, d, "lineitem").where("l_shipdate < TIMESTAMP'2000-01-01'")
    x = lines.join(T(s, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).withColumn("day", F.col("l_shipdate").cast("date"))
    return x.withColumn("k", F.row_number().over(w)).where("k = 1").select(F.col("p_brand").alias("security"), "day", r6(F.col("l_extendedprice"), "price"))


Q = {
    "io2_scan_yearly_panel": (io2, """SELECT p_brand AS security, CAST(l_shipdate AS DATE) AS day, round(l_extendedprice, 6) AS price FROM lineitem JOIN part ON l_partkey = p_partkey
        WHERE l_shipdate < '2000-01-01' QUALIFY row_number() OVER (PARTITION BY p_brand, CAST(l_shipdate AS DATE) ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_partkey DESC, l_quantity DESC) = 1"""),
    "io7_parse_master_index": (io7, """SELECT o_custkey AS cik, '4' AS form, CAST(o_orderdate AS DATE) AS filed, CAST(o_orderkey AS VARCHAR) AS accession FROM orders WHERE o_orderkey % 11 <> 0
        QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY o_custkey, o_orderdate) = 1"""),
    "io10_detect_format": (io10, """WITH d AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN TRUE ELSE FALSE END AS named, CASE page_id % 8 WHEN 1 THEN '%PDF-1.4 ' || coalesce(html, '') WHEN 2 THEN '<DOCUMENT>' || chr(10) || '<TYPE>4' || chr(10) || coalesce(html, '')
        WHEN 3 THEN '<x:ownershipDocument a=''1''>' || coalesce(html, '') WHEN 4 THEN '<edgarSubmission><issuerInfo>' || coalesce(html, '') WHEN 5 THEN replace(coalesce(html, ''), '<', '') WHEN 6 THEN replace(coalesce(html, ''), '<', '') || ' Statement of Changes in Beneficial Ownership' ELSE coalesce(html, '') END AS t FROM pages),
        h AS (SELECT *, lower(substr(t, 1, 8000)) AS h FROM d)
        SELECT page_id, CASE WHEN trim(t) = '' THEN 'empty' WHEN t LIKE '\\%PDF-%' ESCAPE '\\' THEN 'pdf' WHEN contains(h, '<sec-document') OR (contains(h, '<document>') AND contains(h, '<type>')) THEN 'submission' WHEN regexp_matches(h, '<(?:\\w+:)?ownershipdocument\\b') THEN 'ownership_xml'
          WHEN contains(h, 'securitiesinformation') OR contains(h, 'noofunitssold') OR contains(h, '<submissiontype>144') OR contains(h, 'issuerinfo') THEN 'proposed_sale_xml' WHEN contains(h, '<!doctype html') OR contains(h, '<html') OR named THEN 'rendered_html'
          WHEN contains(upper(t), 'STATEMENT OF CHANGES IN BENEFICIAL OWNERSHIP') THEN 'legacy_text' ELSE 'unknown' END AS format FROM h"""),
    "io12_content_versions": (io12, """SELECT page_id, sha256(html) AS sha, host, row_number() OVER (PARTITION BY host ORDER BY page_id DESC) = 1 AS is_latest FROM (SELECT *, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages)"""),
    "p1_coerce": (p1, """SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN round(c_acctbal, 6) END AS balance, CASE WHEN c_custkey % 3 <> 0 THEN make_date(2021, 2, CAST(c_custkey % 28 + 1 AS INT)) END AS day FROM customer"""),
    "p2_money_to_decimal": (p2, "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice, 2) END AS amount FROM orders"),
    "p3_normalize": (p3, """SELECT p_partkey, upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS ticker, regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') || '_class_a' AS security, p_name || ' ' || p_type AS clean FROM part"""),
    "p4_role_flags": (lambda s, d: roles(s, d).drop("role"), f"WITH {ROLES_SQL} SELECT c_custkey, is_officer, is_director, is_ten_percent, is_other, is_ceo, is_cfo, is_coo, is_chair, is_president FROM g"),
    "p5_role_precedence": (lambda s, d: roles(s, d).select("c_custkey", "role"), f"WITH {ROLES_SQL} SELECT c_custkey, role FROM g"),
    "p6_seniority": (lambda s, d: roles(s, d).select("c_custkey", S.seniority(F.col("role")).alias("seniority")), f"WITH {ROLES_SQL} SELECT c_custkey, CASE WHEN role = 'top_executive' THEN 3 WHEN role IN ('other_officer', 'director') THEN 2 ELSE 1 END AS seniority FROM g"),
    "p7_trade_value": (p7, "SELECT DISTINCT accession, line_no, round(shares * price, 6) AS trade_value, CASE transaction_code WHEN 'P' THEN 1 WHEN 'S' THEN -1 END AS side, accession || ':' || line_no AS row_key, is_amendment FROM fx_transactions"),
    "p8_assign_row_ids": (p8, """SELECT accession, line_no, e AS economic_id, sha256(e || '|' || owner_id) AS owner_row_id FROM (SELECT DISTINCT accession, line_no, owner_id, sha256(accession || '|nonderiv|' || line_no) AS e FROM fx_transactions)"""),
    "p9_event_date_fallback": (p9, "SELECT accession, line_no, transaction_date, CASE WHEN line_no % 3 <> 0 THEN transaction_date ELSE filing_date END AS event_date FROM (SELECT DISTINCT accession, line_no, transaction_date, filing_date FROM fx_transactions)"),
    "p10_available_at": (p10, "SELECT o_orderkey, epoch_us((CAST(o_orderdate AS DATE) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND) AT TIME ZONE 'America/New_York') AS available_us FROM orders"),
    "p11_eligible_filings": (p11, """SELECT accession, line_no, issuer_id, owner_id, filing_date, transaction_date, transaction_code, round(shares, 6) AS shares FROM fx_transactions
        WHERE NOT is_amendment AND transaction_code IN ('P', 'S') AND filing_date BETWEEN '1996-01-01' AND '1999-12-31'
        QUALIFY row_number() OVER (PARTITION BY accession, line_no ORDER BY transaction_date DESC, shares DESC, price DESC, issuer_id, owner_id, transaction_code) = 1"""),
    "p12_open_market_events": (p12, "SELECT issuer_id, coalesce(filing_date, transaction_date) AS signal_date, transaction_code, count(*) AS n, round(sum(shares), 6) AS shares FROM fx_transactions WHERE transaction_code IN ('P', 'S') AND NOT coalesce(is_amendment, FALSE) GROUP BY 1, 2, 3"),
    "p13_eligible_security": (p13, """SELECT issuer_id, a, b, security_id || ':' || a || ':' || b AS lineage_id FROM (SELECT issuer_id, security_id, CAST(greatest(effective_start, DATE '1996-06-01') AS DATE) AS a, CAST(least(effective_end, DATE '2000-06-30') AS DATE) AS b
        FROM fx_intervals WHERE is_point_in_time AND effective_end >= '1996-06-01' AND effective_start <= '2000-06-30')"""),
    "p15_holding_fraction": (p15, """SELECT issuer_id, owner_grp, seq, round(CASE WHEN b > 0 THEN least(10, shares / b) END, 6) AS holding_fraction FROM (SELECT *, reported_after - CASE acquired_disposed WHEN 'A' THEN shares ELSE -shares END AS b FROM fx_positions)"""),
    "p16_winsorize": (p16, """SELECT security_id, session_no, round(CASE WHEN r IS NOT NULL THEN greatest(-0.9, least(2.0, r)) END, 6) AS daily, round(CASE WHEN r IS NOT NULL THEN greatest(-1, least(1, 10 * r)) END, 6) AS outcome
        FROM (SELECT *, close / lag(close) OVER (PARTITION BY security_id ORDER BY session_no) - 1 AS r FROM fx_daily)"""),
    "p17_resolve_period": (p17, "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) - 6 AS week_start, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, last_day(o_orderdate) AS month_end, quarter(o_orderdate) AS quarter FROM orders"),
    "p18_text_mention_flags": (p18, r"SELECT source, bool_or(coalesce(regexp_matches(text, '(?i)10b5[\s\-–]*1'), FALSE)) AS mentions_plan, bool_or(coalesce(regexp_matches(text, '(?i)\bprivate(ly)?\b'), FALSE)) AS mentions_private, count(*) FILTER (WHERE regexp_matches(text, '(?i)secret')) AS n_secret FROM documents GROUP BY source"),
    "p19_form_flags": (p19, "SELECT accession, NOT bool_or(is_amendment) AND NOT bool_or(transaction_code IN ('P', 'S')) AS form4_without_transaction, bool_or(is_amendment) AND bool_or(transaction_code IN ('P', 'S')) AS form3_with_transaction FROM fx_transactions GROUP BY accession"),
}
QUERIES = {k: (f, with_views(q) if q else None) for k, (f, q) in Q.items()}
