"""Queries of owners' sales, routine sellers and the days on which they became public."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sellers as S
from ..operators import signals
from ..operators.calendar import business_days
from ..sources.tables import stored
from .fixtures import fx, with_views

START, END = "1995-03-01", "2001-06-30"
_AUDITS: dict[int, dict] = {}


def sales(s, d):
    """Original sales by line and owner, written once a session together with the audit counts of that one pass."""

    def make():
        df, audit = S.owner_sales(fx(s, d, "fx_submissions"), fx(s, d, "fx_nonderiv_transactions"), fx(s, d, "fx_owners"), fx(s, d, "fx_intervals"), START, END)
        _AUDITS["last"] = audit
        return df

    out = stored(s, d, "owner_sales", make)
    if "last" in _AUDITS:
        _AUDITS[out.inputFiles()[0].rpartition("/")[0] if out.inputFiles() else ""] = _AUDITS.pop("last").get
    return out


def e13(s, d):
    return sales(s, d).select("transaction_key", "owner_id", "issuer_id", "transaction_date", "filing_date")


def e13_audit(s, d):
    files = sales(s, d).inputFiles()
    counts = _AUDITS[files[0].rpartition("/")[0] if files else ""]
    return s.createDataFrame([(k, int(v)) for k, v in counts.items()], "audit string, n long")


E13_SQL = f"""sa AS MATERIALIZED (SELECT DISTINCT t.row_id AS transaction_key, o.owner_cik AS owner_id, u.issuer_id, t.trans_date AS transaction_date, u.filing_date
  FROM fx_nonderiv_transactions t JOIN fx_submissions u ON u.accession = t.accession JOIN fx_owners o ON o.accession = t.accession
  WHERE t.trans_code = 'S' AND u.form = '4' AND t.trans_date BETWEEN DATE '{START}' AND DATE '{END}' AND u.filing_date BETWEEN DATE '{START}' AND DATE '{END}' AND o.owner_cik IS NOT NULL
    AND u.issuer_id IN (SELECT issuer_id FROM fx_intervals))"""


def span(s, d):
    """First and last day that matter: of sales and filings. One row."""
    r = sales(s, d).agg(F.min("transaction_date").alias("a"), F.max("filing_date").alias("b")).first()
    return (str(r["a"] or START)[:10], str(r["b"] or END)[:10])


def available(s, d):
    """Months between the first sale and the last filing, if public by then."""
    a, b = span(s, d)
    return S.month_availability(business_days(a, b, s)).where(F.make_date("year", "month", F.lit(1)) >= F.trunc(F.lit(a).cast("date"), "MM"))


def e11(s, d):
    return available(s, d).select(F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"), "available_on")


HOLIDAYS = " OR ".join(
    f"(month({x}) = {m} AND day({x}) = {day}{w})"
    for m, day in ((1, 1), (7, 4), (11, 11), (12, 25)) for x, w in (("d", ""), ("d + 1", " AND isodow(d) = 5"), ("d - 1", " AND isodow(d) = 1"))
)
HOLIDAYS += " OR " + " OR ".join(f"(month(d) = {m} AND isodow(d) = 1 AND ceil(day(d) / 7) = {n})" for m, n in ((1, 3), (2, 3), (9, 1), (10, 2)))
HOLIDAYS += " OR (month(d) = 5 AND isodow(d) = 1 AND day(d) > 24) OR (month(d) = 11 AND isodow(d) = 4 AND ceil(day(d) / 7) = 4)"
AVAILABLE_SQL = f"""{E13_SQL},
sp AS (SELECT min(transaction_date) AS a, max(filing_date) AS b FROM sa),
dy AS (SELECT CAST(unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS d FROM sp),
bz AS (SELECT d, row_number() OVER (PARTITION BY date_trunc('month', d) ORDER BY d) AS k FROM dy WHERE isodow(d) <= 5 AND NOT ({HOLIDAYS})),
av AS MATERIALIZED (SELECT year(date_trunc('month', d) - INTERVAL 1 MONTH) AS year, month(date_trunc('month', d) - INTERVAL 1 MONTH) AS month, d AS available_on FROM bz, sp WHERE k = 2 AND date_trunc('month', d) - INTERVAL 1 MONTH >= date_trunc('month', a))"""


def owner_months(s, d):
    return stored(s, d, "owner_months", lambda: signals.silent_owners(sales(s, d), "owner_id", "issuer_id", "transaction_date", "filing_date", available(s, d)))


def e12(s, d):
    return owner_months(s, d).select("owner", "issuer", F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"), "available_on", "state", "late")


E12_SQL = f"""{AVAILABLE_SQL},
fm AS MATERIALIZED (SELECT owner_id, issuer_id, year(transaction_date) AS y, month(transaction_date) AS m, min(filing_date) AS f FROM sa GROUP BY 1, 2, 3, 4),
om AS MATERIALIZED (SELECT a.owner_id AS owner, a.issuer_id AS issuer, av.year, av.month, available_on, CASE WHEN c.f <= available_on THEN 'SSS' ELSE 'SSN' END AS state, coalesce(c.f > available_on, FALSE) AS late
  FROM fm a JOIN fm b ON b.owner_id = a.owner_id AND b.issuer_id = a.issuer_id AND b.m = a.m AND b.y = a.y - 1 JOIN av ON av.year = a.y + 1 AND av.month = a.m
  LEFT JOIN fm c ON c.owner_id = a.owner_id AND c.issuer_id = a.issuer_id AND c.m = a.m AND c.y = a.y + 1 WHERE a.f <= available_on AND b.f <= available_on)"""


def a6(s, d):
    g = S.firm_months(owner_months(s, d))
    return g.select("issuer", F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"), "available_on", "owners", "ssn", "sss", "late", "signal_type")


A6_SQL = f"""WITH {E12_SQL} SELECT issuer, year, month, available_on, count(DISTINCT owner) AS owners, count(*) FILTER (state = 'SSN') AS ssn, count(*) FILTER (state = 'SSS') AS sss, count(*) FILTER (late) AS late,
  CASE WHEN count(*) FILTER (state = 'SSN') > 0 THEN 'SSN' ELSE 'SSS_only' END AS signal_type FROM om GROUP BY 1, 2, 3, 4"""


def classes(s, d):
    last = int(span(s, d)[1][:4])
    return stored(s, d, "seller_classes", lambda: signals.seller_class(sales(s, d), "owner_id", "issuer_id", "transaction_date", "filing_date", last))


def e14(s, d):
    return classes(s, d).select("owner", "issuer", F.col("year").cast("long").alias("year"), "seller_class")


E14_SQL = f"""{E13_SQL}, ly AS (SELECT year(max(filing_date)) AS y FROM sa),
sy AS (SELECT *, year(transaction_date) + n AS year, n FROM sa, (VALUES (1), (2), (3)) v(n), ly WHERE year(transaction_date) + n <= ly.y AND filing_date < make_date(year(transaction_date) + n, 1, 1)),
gm AS (SELECT owner_id, issuer_id, year, coalesce(list(DISTINCT month(transaction_date)) FILTER (n = 1), []) AS m1, coalesce(list(DISTINCT month(transaction_date)) FILTER (n = 2), []) AS m2, coalesce(list(DISTINCT month(transaction_date)) FILTER (n = 3), []) AS m3 FROM sy GROUP BY 1, 2, 3),
cs AS (SELECT owner_id AS owner, issuer_id AS issuer, year, CASE WHEN len(m1) = 0 OR len(m2) = 0 OR len(m3) = 0 THEN 'unclassified' WHEN len(list_intersect(list_intersect(m1, m2), m3)) > 0 THEN 'routine' ELSE 'opportunistic' END AS seller_class FROM gm)"""


def a5(s, d):
    return S.issuer_day_class(sales(s, d), classes(s, d))


A5_SQL = f"""WITH {E14_SQL}, x AS (SELECT sa.issuer_id, filing_date, owner_id, coalesce(seller_class, 'unclassified') AS c FROM sa LEFT JOIN cs ON cs.owner = owner_id AND cs.issuer = sa.issuer_id AND cs.year = year(filing_date)),
g AS (SELECT issuer_id, filing_date, count(DISTINCT owner_id) FILTER (c = 'opportunistic') AS opportunistic, count(DISTINCT owner_id) FILTER (c = 'routine') AS routine, count(DISTINCT owner_id) FILTER (c = 'unclassified') AS unclassified FROM x GROUP BY 1, 2)
SELECT *, CASE WHEN opportunistic > 0 THEN 'opportunistic' WHEN routine > 0 THEN 'routine' ELSE 'unclassified' END AS day_class FROM g"""

Q = {
    "e11_availability_date": (e11, f"WITH {AVAILABLE_SQL} SELECT * FROM av"),
    "e12_owner_months": (e12, f"WITH {E12_SQL} SELECT * FROM om"),
    "e13_owner_sales": (e13, f"WITH {E13_SQL} SELECT * FROM sa"),
    "e13_owner_sales_audit": (e13_audit, f"""WITH {E13_SQL} SELECT 'owner_sale_rows' AS audit, count(*) AS n FROM sa UNION ALL SELECT 'owners', count(DISTINCT owner_id) FROM sa
        UNION ALL SELECT 'owner_issuer_pairs', count(DISTINCT (owner_id, issuer_id)) FROM sa UNION ALL SELECT 'sale_month_rows', count(DISTINCT (owner_id, issuer_id, date_trunc('month', transaction_date))) FROM sa"""),
    "e14_seller_decisions": (e14, f"WITH {E14_SQL} SELECT * FROM cs"),
    "a5_seller_class_issuer_day": (a5, A5_SQL),
    "a6_firm_month_states": (a6, A6_SQL),
}
QUERIES = {k: (f, with_views(q)) for k, (f, q) in Q.items()}
