"""Queries of returns along own rows, and of events of firms that a first source lacks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import paths as P
from ..sources.tables import stored
from .fixtures import fx, with_views
from .study import EVENTS, events
from .universe import T8_SQL, universe

HOLD, HORIZONS = 63, [21, 63, 126, 252]
r6 = lambda c, n: F.round(c, 6).alias(n)


def sides(s, d):
    """The panel and the benchmark with their own returns."""
    w = Window.partitionBy("security_id").orderBy("session_date")
    panel = fx(s, d, "fx_daily").select("security_id", "session_date", (F.col("close") / F.lag("close").over(w) - 1).alias("r"), F.lag("cap").over(w).alias("lag_cap"))
    bench = fx(s, d, "fx_benchmark").select("session_date", (F.col("level") / F.lag("level").over(Window.orderBy("session_date")) - 1).alias("r"))  # one row a session
    return panel, bench


def running(s, d):
    panel, bench = sides(s, d)
    return (
        stored(s, d, "own_rows", lambda: P.numbered(panel, "security_id", "session_date", "r", F.col("lag_cap"))),
        stored(s, d, "bench_rows", lambda: P.numbered(bench, None, "session_date", "r")),
    )


def e4(s, d):
    x = P.held_excess(events(s, d), *running(s, d), "security_id", "filing_date", "session_date", HOLD)
    return x.select("event_id", "entry_date", r6("lag_cap", "lag_cap"), r6("excess", "excess"), "status")


ROWS_SQL = f"""ev AS ({EVENTS}),
pr AS (SELECT security_id, session_date, row_number() OVER w - 1 AS i, close / lag(close) OVER w - 1 AS r, lag(cap) OVER w AS lag_cap FROM fx_daily WINDOW w AS (PARTITION BY security_id ORDER BY session_date)),
br AS (SELECT session_date, row_number() OVER w - 1 AS i, level / lag(level) OVER w - 1 AS m FROM fx_benchmark WINDOW w AS (ORDER BY session_date)),
pl AS MATERIALIZED (SELECT *, sum((r IS NOT NULL)::INT) OVER w AS v, sum(coalesce(ln(1 + r), 0)) OVER w AS l, max(i) OVER (PARTITION BY security_id) AS last FROM pr WINDOW w AS (PARTITION BY security_id ORDER BY i)),
bl AS MATERIALIZED (SELECT *, sum((m IS NOT NULL)::INT) OVER w AS v, sum(coalesce(ln(1 + m), 0)) OVER w AS l, max(i) OVER () AS last FROM br WINDOW w AS (ORDER BY i)),
en AS MATERIALIZED (SELECT ev.*, p.session_date AS entry_date, p.i, p.v, p.l, p.last, p.lag_cap, b.i AS bi, b.v AS bv, b.l AS bl, b.last AS blast
  FROM ev ASOF LEFT JOIN pl p ON p.security_id = ev.security_id AND p.session_date > ev.filing_date ASOF LEFT JOIN bl b ON b.session_date > ev.filing_date)"""


def e3(s, d):
    panel, bench = sides(s, d)
    beta = P.betas(panel, bench.withColumnRenamed("r", "m"), "security_id", "session_date", "r", "m")
    x = P.reprice(events(s, d), *running(s, d), beta, "security_id", "filing_date", "session_date", HORIZONS)
    return x.select("event_id", "horizon", "entry_date", *[r6(c, c) for c in ("forward", "bench_forward", "abnormal", "residual", "beta")], "beta_n")


E3_SQL = f"""WITH {ROWS_SQL},
vr AS (SELECT security_id, p.session_date, count(m) OVER w AS n, covar_samp(r, m) OVER w AS c, var_samp(m) OVER w AS v FROM pr p LEFT JOIN br b ON b.session_date = p.session_date WHERE r IS NOT NULL
  WINDOW w AS (PARTITION BY security_id ORDER BY p.session_date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
be AS (SELECT en.*, coalesce(n, 0) AS beta_n, CASE WHEN n >= 60 AND vr.v > 0 THEN c / vr.v END AS beta FROM en ASOF LEFT JOIN vr ON vr.security_id = en.security_id AND vr.session_date < en.entry_date),
x AS (SELECT be.event_id, h AS horizon, entry_date, beta, beta_n, CASE WHEN q.v - be.v > 0 THEN exp(q.l - be.l) - 1 END AS f, CASE WHEN be.i IS NOT NULL AND g.v - bv > 0 THEN exp(g.l - bl) - 1 END AS g
  FROM be CROSS JOIN (VALUES {', '.join(f'({h})' for h in HORIZONS)}) z(h) LEFT JOIN pl q ON q.security_id = be.security_id AND q.i = least(be.i + h, be.last) LEFT JOIN bl g ON g.i = least(bi + h, blast))
SELECT event_id, horizon, entry_date, round(f, 6) AS forward, round(g, 6) AS bench_forward, round(f - g, 6) AS abnormal, round(f - beta * g, 6) AS residual, round(beta, 6) AS beta, beta_n FROM x"""


def first_source(s, d):
    """Securities of issuers that the first event table covers: those whose purchases on some day were by two owners or more."""
    t = fx(s, d, "fx_transactions").where("transaction_code = 'P'")
    days = t.groupBy("issuer_id", "filing_date").agg(F.count_distinct("owner_id").alias("k")).groupBy("issuer_id").agg(F.max("k").alias("k"), F.count("*").alias("n"))
    return days.where("n % 3 <> 0").join(fx(s, d, "fx_intervals"), "issuer_id").select("issuer_id", "security_id")


def e23(s, d):
    owner = fx(s, d, "fx_intervals").select("issuer_id", "security_id").distinct()
    members = universe(s, d).join(owner, "security_id").select("issuer_id", "security_id", "start", "end", F.col("is_biotech").alias("eligible"))
    return P.missing_firm_events(first_source(s, d), members, fx(s, d, "fx_submissions"), fx(s, d, "fx_nonderiv_transactions"), fx(s, d, "fx_owners"))


E23_SQL = f"""WITH {T8_SQL}, cov AS (SELECT issuer_id FROM (SELECT issuer_id, filing_date FROM fx_transactions WHERE transaction_code = 'P' GROUP BY 1, 2) GROUP BY 1 HAVING count(*) % 3 <> 0),
tg AS (SELECT issuer_id, min(security_id) AS security_id FROM fx_intervals WHERE issuer_id NOT IN (SELECT issuer_id FROM cov) GROUP BY 1)
SELECT u.issuer_id, tg.security_id, o.owner_cik AS owner_id, t.accession, row_id, trans_date, filing_date, CASE trans_code WHEN 'P' THEN 1 ELSE -1 END AS side, trans_shares AS shares
FROM fx_nonderiv_transactions t JOIN fx_submissions u ON u.accession = t.accession JOIN tg ON tg.issuer_id = u.issuer_id LEFT JOIN fx_owners o ON o.accession = t.accession
WHERE u.form = '4' AND trans_code IN ('P', 'S') AND EXISTS (SELECT 1 FROM t8 WHERE t8.security_id = tg.security_id AND filing_date BETWEEN start AND "end" AND classification_rule IN ('GICS_STRICT_BIOTECH_EXACT', 'SIC_2836_FALLBACK'))"""

Q = {
    "e4_held_excess_status": (e4, f"""WITH {ROWS_SQL}, x AS (SELECT en.*, CASE WHEN q.v - en.v > 0 THEN exp(q.l - en.l) - 1 END - CASE WHEN g.v - bv > 0 THEN exp(g.l - en.bl) - 1 END AS ex
        FROM en LEFT JOIN pl q ON q.security_id = en.security_id AND q.i = en.i + {HOLD} LEFT JOIN bl g ON g.i = least(bi + {HOLD}, blast))
        SELECT event_id, entry_date, round(lag_cap, 6) AS lag_cap, round(ex, 6) AS excess, CASE WHEN i IS NULL THEN 'missing_entry_close' WHEN ex IS NOT NULL THEN 'ok' ELSE 'calendar_right_censored' END AS status FROM x"""),
    "e3_reprice": (e3, E3_SQL),
    "e23_missing_firm_events": (e23, E23_SQL),
}
QUERIES = {k: (f, with_views(q)) for k, (f, q) in Q.items()}
