"""Queries of the classified universe and of events by firm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import classification
from ..operators import intervals as I
from ..sources.tables import stored
from .fixtures import fx, with_views

DATES = {"start_date": "start", "end_date": "end"}
SHOWN = ["security_id", "start", "end", "interval_id", "gvkey", "cik", "cik_source", "linkprim", "linktype", "identifier_match_status", "cik_is_point_in_time", "cik_match_status",
         "gics_code", "crsp_sic", "compustat_sic", "classification_source", "classification_code", "classification_rule", "is_biotech", "is_pharma"]


def _dated(s, d, name: str) -> DataFrame:
    return fx(s, d, name).withColumnsRenamed(DATES)


def universe(s, d) -> DataFrame:
    make = lambda: I.classified_intervals(*[_dated(s, d, f"fx_{n}") for n in ("members", "gics", "sic", "links")])
    return stored(s, d, "classified_intervals", make)


def t8(s, d):
    return universe(s, d).select(*SHOWN)


def _value_sql(name: str, table: str, column: str) -> str:
    return f"""{name} AS (SELECT l.security_id, l.start, CASE WHEN h.end_date IS NULL OR l.start <= h.end_date THEN h.{column} END AS {column}
  FROM (SELECT *, security_id || '|' || CASE WHEN EXISTS (SELECT 1 FROM {table} x WHERE x.security_id = ln.security_id AND x.gvkey = ln.gvkey) THEN gvkey ELSE '' END AS key FROM ln) l
  ASOF JOIN (SELECT *, security_id || '|' || coalesce(gvkey, '') AS key FROM {table}) h ON h.key = l.key AND h.start_date <= l.start)"""


T8_SQL = f"""bd AS (SELECT DISTINCT security_id, unnest([start_date, end_date + 1]) AS x FROM (SELECT security_id, start_date, end_date FROM fx_gics UNION ALL SELECT security_id, start_date, end_date FROM fx_sic UNION ALL SELECT security_id, start_date, end_date FROM fx_links)),
ct AS (SELECT m.*, start_date AS s FROM fx_members m UNION SELECT m.*, x FROM fx_members m JOIN bd ON bd.security_id = m.security_id AND x > start_date AND x <= end_date),
sg AS (SELECT security_id, crsp_sic, s AS start, coalesce(lead(s) OVER (PARTITION BY security_id, start_date, end_date ORDER BY s) - 1, end_date) AS "end" FROM ct),
ac AS (SELECT sg.security_id, sg.start, l.gvkey, cik, cik_source, linkprim, linktype, rank() OVER (PARTITION BY sg.security_id, sg.start ORDER BY CASE cik_source WHEN 'crsp.comphist_hcik' THEN 0 ELSE 9 END, CASE linkprim WHEN 'P' THEN 0 WHEN 'C' THEN 1 ELSE 9 END, CASE linktype WHEN 'LC' THEN 0 WHEN 'LU' THEN 1 WHEN 'LS' THEN 2 ELSE 9 END) AS r
  FROM sg JOIN fx_links l ON l.security_id = sg.security_id AND sg.start BETWEEN l.start_date AND l.end_date),
be AS (SELECT security_id, start, count(DISTINCT gvkey || '|' || coalesce(CAST(cik AS VARCHAR), '')) AS k, min(gvkey) AS gvkey, min(cik) AS cik, min(cik_source) AS cik_source, min(linkprim) AS linkprim, min(linktype) AS linktype FROM ac WHERE r = 1 GROUP BY 1, 2),
ln AS MATERIALIZED (SELECT sg.*, CASE WHEN k IS NULL THEN 'UNMATCHED' WHEN k > 1 THEN 'AMBIGUOUS' ELSE 'MATCHED' END AS identifier_match_status, CASE WHEN k = 1 THEN gvkey END AS gvkey, CASE WHEN k = 1 THEN cik END AS cik,
    CASE WHEN k = 1 THEN cik_source END AS cik_source, CASE WHEN k = 1 THEN linkprim END AS linkprim, CASE WHEN k = 1 THEN linktype END AS linktype FROM sg LEFT JOIN be ON be.security_id = sg.security_id AND be.start = sg.start),
{_value_sql('vg', 'fx_gics', 'gics_code')}, {_value_sql('vs', 'fx_sic', 'compustat_sic')},
cl AS (SELECT ln.*, CASE WHEN identifier_match_status = 'MATCHED' THEN gics_code END AS gics_code, CASE WHEN identifier_match_status = 'MATCHED' THEN compustat_sic END AS compustat_sic
  FROM ln LEFT JOIN vg ON vg.security_id = ln.security_id AND vg.start = ln.start LEFT JOIN vs ON vs.security_id = ln.security_id AND vs.start = ln.start),
cr AS (SELECT *, coalesce(nullif(crsp_sic, 0), compustat_sic) AS sic FROM cl),
cs AS (SELECT *, CASE WHEN gics_code = '35201010' THEN 'GICS_STRICT_BIOTECH_EXACT' WHEN gics_code = '35202010' THEN 'GICS_PHARMA_EXACT' WHEN gics_code IS NOT NULL THEN 'GICS_OTHER'
    WHEN sic = 2836 THEN 'SIC_2836_FALLBACK' WHEN sic = 2834 THEN 'SIC_2834_FALLBACK' WHEN sic IS NOT NULL THEN 'SIC_OTHER_FALLBACK' ELSE 'NO_CLASSIFICATION' END AS rule,
    CASE WHEN gics_code IS NOT NULL THEN 'GICS' WHEN nullif(crsp_sic, 0) IS NOT NULL THEN 'CRSP_SIC' WHEN compustat_sic <> 0 THEN 'COMPUSTAT_SIC' ELSE 'UNCLASSIFIED' END AS src FROM cr),
al AS (SELECT *, md5(concat_ws('|', coalesce(CAST(crsp_sic AS VARCHAR), '-'), identifier_match_status, coalesce(gvkey, '-'), coalesce(CAST(cik AS VARCHAR), '-'), coalesce(cik_source, '-'), coalesce(linkprim, '-'), coalesce(linktype, '-'), coalesce(gics_code, '-'), coalesce(CAST(compustat_sic AS VARCHAR), '-'))) AS same FROM cs),
nw AS (SELECT *, CASE WHEN lag("end") OVER w + 1 = start AND lag(same) OVER w = same THEN 0 ELSE 1 END AS nw FROM al WINDOW w AS (PARTITION BY security_id ORDER BY start, "end")),
rn AS (SELECT *, sum(nw) OVER (PARTITION BY security_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run FROM nw),
t8 AS MATERIALIZED (SELECT security_id, min(start) AS start, max("end") AS "end", any_value(gvkey) AS gvkey, any_value(cik) AS cik, any_value(cik_source) AS cik_source, any_value(linkprim) AS linkprim, any_value(linktype) AS linktype,
    any_value(identifier_match_status) AS identifier_match_status, any_value(gics_code) AS gics_code, any_value(crsp_sic) AS crsp_sic, any_value(compustat_sic) AS compustat_sic, any_value(src) AS classification_source,
    coalesce(any_value(gics_code), CAST(any_value(sic) AS VARCHAR)) AS classification_code, any_value(rule) AS classification_rule FROM rn GROUP BY security_id, run)"""
T8_OUT = """SELECT security_id, start, "end", security_id || ':' || strftime(start, '%Y%m%d') || ':' || strftime("end", '%Y%m%d') AS interval_id, gvkey, cik, cik_source, linkprim, linktype, identifier_match_status,
  cik IS NOT NULL AND coalesce(cik_source = 'crsp.comphist_hcik', FALSE) AS cik_is_point_in_time,
  CASE WHEN cik IS NULL THEN 'MISSING' WHEN cik_source = 'crsp.comphist_hcik' THEN 'POINT_IN_TIME' WHEN cik_source = 'comp.company_current' THEN 'CURRENT_FALLBACK' ELSE 'UNVERIFIED_SOURCE' END AS cik_match_status,
  gics_code, crsp_sic, compustat_sic, classification_source, classification_code, classification_rule, classification_rule IN ('GICS_STRICT_BIOTECH_EXACT', 'SIC_2836_FALLBACK') AS is_biotech, classification_rule IN ('GICS_PHARMA_EXACT', 'SIC_2834_FALLBACK') AS is_pharma FROM t8"""


def p14(s, d):
    """Every classification history row by its own codes and the security's SIC."""
    m = fx(s, d, "fx_members").select("security_id", "crsp_sic").distinct()
    h = fx(s, d, "fx_gics").select("security_id", F.col("start_date").alias("since"), "gics_code", F.lit(None).cast("int").alias("compustat_sic"))
    h = h.unionByName(fx(s, d, "fx_sic").select("security_id", F.col("start_date").alias("since"), F.lit(None).cast("string").alias("gics_code"), "compustat_sic"))
    x = h.join(m, "security_id").withColumns(classification(F.col("gics_code"), F.col("crsp_sic"), F.col("compustat_sic")))
    return x.select("security_id", "since", "gics_code", "classification_source", "classification_code", "classification_rule", "is_biotech", "is_pharma")


P14_SQL = """WITH h AS (SELECT g.security_id, start_date AS since, gics_code, NULL::INT AS comp FROM fx_gics g UNION ALL SELECT security_id, start_date, NULL, compustat_sic FROM fx_sic),
x AS (SELECT h.*, nullif(crsp_sic, 0) AS own, coalesce(nullif(crsp_sic, 0), comp) AS sic FROM h JOIN (SELECT DISTINCT security_id, crsp_sic FROM fx_members) m USING (security_id)),
r AS (SELECT *, CASE WHEN gics_code = '35201010' THEN 'GICS_STRICT_BIOTECH_EXACT' WHEN gics_code = '35202010' THEN 'GICS_PHARMA_EXACT' WHEN gics_code IS NOT NULL THEN 'GICS_OTHER'
  WHEN sic = 2836 THEN 'SIC_2836_FALLBACK' WHEN sic = 2834 THEN 'SIC_2834_FALLBACK' WHEN sic IS NOT NULL THEN 'SIC_OTHER_FALLBACK' ELSE 'NO_CLASSIFICATION' END AS classification_rule FROM x)
SELECT security_id, since, gics_code, CASE WHEN gics_code IS NOT NULL THEN 'GICS' WHEN own IS NOT NULL THEN 'CRSP_SIC' WHEN comp <> 0 THEN 'COMPUSTAT_SIC' ELSE 'UNCLASSIFIED' END AS classification_source,
  coalesce(gics_code, CAST(sic AS VARCHAR)) AS classification_code, classification_rule, classification_rule IN ('GICS_STRICT_BIOTECH_EXACT', 'SIC_2836_FALLBACK') AS is_biotech, classification_rule IN ('GICS_PHARMA_EXACT', 'SIC_2834_FALLBACK') AS is_pharma FROM r"""


def t12(s, d):
    """The classified intervals of each membership interval tile it."""
    members = _dated(s, d, "fx_members").select("security_id", "start", "end")
    return I.tiles(universe(s, d).select("security_id", "start", "end"), members, ["security_id"])


Q = {
    "t8_classified_intervals": (t8, f"WITH {T8_SQL} {T8_OUT}"),
    "p14_classify_security": (p14, P14_SQL),
    "t12_interval_coverage": (t12, f"""WITH {T8_SQL}, g AS (SELECT *, coalesce(lag("end") OVER (PARTITION BY security_id ORDER BY start) + 1 <> start, FALSE) AS gap FROM t8)
        SELECT m.security_id, min(g.start) = any_value(start_date) AND max(g."end") = any_value(end_date) AND NOT bool_or(gap) AS ok FROM fx_members m JOIN g ON g.security_id = m.security_id GROUP BY m.security_id"""),
}
QUERIES = {k: (f, with_views(q)) for k, (f, q) in Q.items()}
