"""Event-study shaped views of the driver's star-schema tables: one SQL text for Spark and for the oracle.

A session is a week, an issuer a part brand, an owner a customer.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import PARTS, discard, part_of, stored, written

VIEWS: dict[str, str] = {
    "fx_transactions": """
SELECT l.l_orderkey AS accession, l.l_linenumber AS line_no, p.p_brand AS issuer_id,
       o.o_custkey AS owner_id, CAST(o.o_orderdate AS DATE) AS filing_date,
       CAST(l.l_shipdate AS DATE) AS transaction_date,
       CASE l.l_returnflag WHEN 'A' THEN 'P' WHEN 'R' THEN 'S' ELSE 'M' END AS transaction_code,
       CASE l.l_linestatus WHEN 'F' THEN 'A' ELSE 'D' END AS acquired_disposed,
       l.l_quantity AS shares, l.l_extendedprice / l.l_quantity AS price,
       o.o_orderpriority = '1-URGENT' AS is_amendment
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey""",
    "fx_calendar": """
SELECT session_date, CAST(row_number() OVER (ORDER BY session_date) AS INT) AS session_no
FROM (SELECT DISTINCT CAST(date_trunc('week', l_shipdate) AS DATE) AS session_date FROM lineitem) d""",
    "fx_daily": """
SELECT b.security_id, c.session_date, c.session_no, b.close, b.low, b.high, b.volume,
       1000.0 * b.close AS cap, (b.security_no % 5 = 0 AND c.session_no = 340) AS delisted
FROM (SELECT p.p_brand AS security_id, CAST(substr(p.p_brand, 7) AS INT) AS security_no,
             CAST(date_trunc('week', l.l_shipdate) AS DATE) AS session_date,
             avg(l.l_extendedprice / l.l_quantity) AS close, min(l.l_extendedprice / l.l_quantity) AS low,
             max(l.l_extendedprice / l.l_quantity) AS high, sum(l.l_quantity) AS volume
      FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
      GROUP BY 1, 2, 3) b JOIN fx_calendar c ON b.session_date = c.session_date
WHERE (c.session_no * 7 + b.security_no) % 97 <> 0""",
    "fx_benchmark": "SELECT session_date, session_no, avg(close) AS level FROM fx_daily GROUP BY session_date, session_no",
    "fx_intervals": """
SELECT b.issuer_id, 10 * b.n + k.k AS security_id, make_date(1995 + 2 * k.k, 1, 1) AS effective_start,
       make_date(1996 + 2 * k.k, 12, 31) AS effective_end, (b.n + k.k) % 3 <> 0 AS is_point_in_time
FROM (SELECT DISTINCT p_brand AS issuer_id, CAST(substr(p_brand, 7) AS INT) AS n FROM part) b
CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) k
UNION ALL
SELECT DISTINCT p_brand, 10 * CAST(substr(p_brand, 7) AS INT) + 9, make_date(1997, 1, 1), make_date(1998, 12, 31), TRUE
FROM part WHERE CAST(substr(p_brand, 7) AS INT) % 6 = 0""",
    "fx_positions": """
SELECT issuer_id, owner_grp, accession, line_no, event_date, filing_date, acquired_disposed, shares, seq,
       sum(CASE acquired_disposed WHEN 'A' THEN shares ELSE -shares END)
         OVER (PARTITION BY issuer_id, owner_grp ORDER BY seq ROWS UNBOUNDED PRECEDING)
         + CASE WHEN accession % 7 = 0 THEN 1 ELSE 0 END AS reported_after
FROM (SELECT issuer_id, owner_id % 20 AS owner_grp, accession, line_no, transaction_date AS event_date, filing_date,
             acquired_disposed, shares,
             CAST(row_number() OVER (PARTITION BY issuer_id, owner_id % 20
               ORDER BY filing_date, accession, line_no, transaction_date, shares, price, acquired_disposed) AS INT) AS seq
      FROM fx_transactions) t""",
    "fx_submissions": """
SELECT o_orderkey AS accession, CAST(o_orderdate AS DATE) AS filing_date,
       CASE WHEN o_orderkey % 4 <> 0 THEN CAST(date_trunc('month', o_orderdate) AS DATE) END AS period_of_report,
       CASE WHEN o_orderpriority = '1-URGENT' THEN '4/A' ELSE '4' END AS form,
       'Brand#' || CAST(1 + o_custkey % 5 AS VARCHAR(10)) || CAST(1 + CAST(floor(o_custkey / 5) AS BIGINT) % 5 AS VARCHAR(10)) AS issuer_id,
       o_custkey AS owner_id
FROM orders""",
    "fx_owners": """
SELECT accession, owner_id AS owner_cik FROM fx_submissions
UNION ALL SELECT accession, owner_id + 1 FROM fx_submissions WHERE accession % 9 = 0""",
    "fx_lines": """
SELECT accession, line_no, l_linenumber, shares, trans_code, side, row_kind, tab, filing_date, form,
       accession * 1000 + line_no AS row_id, CASE WHEN line_no % 10 <> 9 THEN filing_date - (40 - line_no) + CASE WHEN accession % 11 = 0 THEN -400 ELSE 0 END END AS trans_date,
       sum(CASE WHEN row_kind = 'holding' THEN 0 WHEN side = 'A' THEN shares ELSE -shares END)
         OVER (PARTITION BY owner_id, issuer_id, tab ORDER BY filing_date, accession, line_no ROWS UNBOUNDED PRECEDING)
         + CASE WHEN accession % 7 = 0 THEN 1 ELSE 0 END AS balance,
       CASE WHEN form = '4/A' AND accession % 3 <> 0 THEN lag(accession * 1000 + line_no) OVER (PARTITION BY owner_id, issuer_id, tab, line_no ORDER BY filing_date, accession) END AS amends_row_id
FROM (SELECT l.l_orderkey AS accession, CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_shipdate, l.l_quantity, l.l_extendedprice, l.l_partkey, l.l_suppkey) AS INT) AS line_no,
             l.l_linenumber, l.l_quantity AS shares, CASE l.l_returnflag WHEN 'A' THEN 'P' WHEN 'R' THEN 'S' ELSE 'M' END AS trans_code, CASE l.l_linestatus WHEN 'F' THEN 'A' ELSE 'D' END AS side,
             CASE WHEN l.l_returnflag = 'N' AND l.l_linenumber % 2 = 0 THEN 'holding' ELSE 'transaction' END AS row_kind, CASE WHEN l.l_linenumber % 3 = 0 THEN 'derivative' ELSE 'non_derivative' END AS tab,
             s.filing_date, s.form, s.owner_id, s.issuer_id
      FROM lineitem l JOIN fx_submissions s ON l.l_orderkey = s.accession) x""",
    "fx_nonderiv_transactions": """
SELECT accession, line_no, row_id, amends_row_id, 'Common Stock' AS security_title, CASE WHEN accession % 13 <> 0 THEN balance END AS shrs_ownd_folwng_trans, 'D' AS direct_indirect_ownership,
       trans_date, trans_code, CASE WHEN accession % 23 <> 0 THEN shares END AS trans_shares, side AS trans_acquired_disp_cd
FROM fx_lines WHERE row_kind = 'transaction' AND tab = 'non_derivative'""",
    "fx_nonderiv_holdings": """
SELECT accession, line_no, row_id, amends_row_id, 'Common Stock' AS security_title, balance AS shrs_ownd_folwng_trans, 'D' AS direct_indirect_ownership
FROM fx_lines WHERE row_kind = 'holding' AND tab = 'non_derivative'""",
    "fx_deriv_transactions": """
SELECT accession, line_no, row_id, amends_row_id, 'Stock Option' AS security_title, balance AS shrs_ownd_folwng_trans, 'D' AS direct_indirect_ownership,
       trans_date, trans_code, shares AS trans_shares, side AS trans_acquired_disp_cd, shares / 10 AS conv_exercise_price
FROM fx_lines WHERE row_kind = 'transaction' AND tab = 'derivative'""",
    "fx_deriv_holdings": """
SELECT accession, line_no, row_id, amends_row_id, 'Stock Option' AS security_title, balance AS shrs_ownd_folwng_trans, 'D' AS direct_indirect_ownership, shares / 10 AS conv_exercise_price
FROM fx_lines WHERE row_kind = 'holding' AND tab = 'derivative'""",
    "fx_days": """
SELECT p.p_brand AS issuer_id, CAST(l.l_shipdate AS DATE) AS day, CASE WHEN count(*) % 7 <> 3 THEN min(l.l_extendedprice / l.l_quantity) END AS low, max(l.l_extendedprice / l.l_quantity) AS high
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_linenumber % 2 = 0 GROUP BY 1, 2""",
    "fx_filing_years": """
SELECT issuer_id, CAST(date_trunc('year', filing_date) AS DATE) AS year, min(filing_date) AS first_filing, count(*) AS filings FROM fx_submissions GROUP BY 1, 2""",
    "fx_members": """
SELECT security_id, effective_start AS start_date, effective_end AS end_date, CASE security_id % 4 WHEN 0 THEN 2836 WHEN 1 THEN 0 WHEN 2 THEN 7372 END AS crsp_sic
FROM fx_intervals""",
    "fx_gics": """
SELECT i.security_id, CASE WHEN i.security_id % 3 <> 0 THEN 'G' || CAST(i.security_id AS VARCHAR(12)) END AS gvkey,
       CASE filings % 3 WHEN 0 THEN '35201010' WHEN 1 THEN '35202010' ELSE '40101010' END AS gics_code, first_filing AS start_date,
       CASE WHEN filings % 5 = 0 THEN first_filing + 200 END AS end_date
FROM fx_intervals i JOIN fx_filing_years y ON y.issuer_id = i.issuer_id WHERE i.security_id % 7 <> 0""",
    "fx_sic": """
SELECT i.security_id, CASE WHEN i.security_id % 2 <> 0 THEN 'G' || CAST(i.security_id AS VARCHAR(12)) END AS gvkey,
       CASE filings % 4 WHEN 0 THEN 2836 WHEN 1 THEN 2834 ELSE 3841 END AS compustat_sic, first_filing + 31 AS start_date,
       CASE WHEN filings % 6 = 0 THEN first_filing + 300 END AS end_date
FROM fx_intervals i JOIN fx_filing_years y ON y.issuer_id = i.issuer_id""",
    "fx_links": """
SELECT i.security_id, 'G' || CAST(i.security_id + CASE WHEN y.filings % 11 = 0 THEN 1 ELSE 0 END AS VARCHAR(12)) AS gvkey, CASE WHEN i.security_id % 6 <> 0 THEN 1000 + i.security_id END AS cik,
       CASE WHEN y.filings % 2 = 0 THEN 'crsp.comphist_hcik' WHEN y.filings % 3 <> 0 THEN 'comp.company_current' END AS cik_source,
       CASE y.filings % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'C' ELSE 'J' END AS linkprim, CASE y.filings % 4 WHEN 0 THEN 'LC' WHEN 1 THEN 'LU' ELSE 'LS' END AS linktype,
       first_filing - 60 AS start_date, first_filing + CAST(y.filings % 500 AS INT) AS end_date
FROM fx_intervals i JOIN fx_filing_years y ON y.issuer_id = i.issuer_id""",
    "fx_splits": """
SELECT issuer_id, filing_date AS effective_date, 2.0 AS split_factor
FROM (SELECT issuer_id, filing_date, row_number() OVER (PARTITION BY issuer_id, date_trunc('year', filing_date) ORDER BY filing_date, accession) AS k FROM fx_submissions) x
WHERE k = 20""",
}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")
_USE = re.compile(r"\b(FROM|JOIN)\s+(fx_\w+)", re.I)


def needed(sql: str) -> list[str]:
    """Views that a text uses, those they use first."""
    out: list[str] = []
    for name in dict.fromkeys(m[1] for m in _USE.findall(sql)):
        out += [n for n in (*needed(VIEWS[name]), name) if n not in out]
    return out


def with_views(sql: str) -> str:
    """The text with the views it uses as leading common table expressions (for the oracle)."""
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed(sql))
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    if not views:
        return sql
    if head:
        return f"WITH {head[1] or ''}{views},\n{sql[head.end():]}"
    return f"WITH {views}\n{sql}"


STORED = ("fx_calendar", "fx_daily", "fx_benchmark", "fx_splits")
"""Aggregates that most queries read, much smaller than their input: written once a session."""


def lines_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of fx_lines as a table for the caller to discard. Its inner select is written first, then the windows over
    it part by part, as owner and issuer partition both: shuffle files of one step are gone before the next."""
    outer, _, inner = VIEWS["fx_lines"].partition("FROM (")
    numbered = written(_view(spark, sf_dir, inner.rpartition(")")[0], {}))
    lines = written(spark.sql(f"{outer} FROM {{x}}", x=numbered.where(part_of(k, "owner_id", "issuer_id"))) for k in range(PARTS))
    discard(numbered)
    return lines


def fx(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A view over the Parquet tables of ``sf_dir``; views that are ``given`` are taken as they are."""
    if name in STORED and not given:
        return stored(spark, sf_dir, name, lambda: _view(spark, sf_dir, VIEWS[name], {}))
    return _view(spark, sf_dir, VIEWS[name], given)


def _view(spark: SparkSession, sf_dir: str, sql: str, given: dict[str, DataFrame]) -> DataFrame:
    frames = dict(given)

    def use(m: re.Match) -> str:
        if m[2] not in frames:
            frames[m[2]] = fx(spark, sf_dir, m[2]) if m[2] in VIEWS else spark.read.parquet(f"{sf_dir}/{m[2]}.parquet")
        return f"{m[1]} {{{m[2]}}}"

    text = re.sub(rf"\b(FROM|JOIN)\s+({'|'.join([*VIEWS, *BASE])})\b", use, sql)
    return spark.sql(text, **{n: f for n, f in frames.items() if f"{{{n}}}" in text})
