"""The query of the train, validation and test selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import returns, selection, windows
from ..sources.tables import stored
from .fixtures import fx, with_views
from .student_sql import p_sql
from .study import at_horizons, events

GRID_HORIZONS = [1, 2, 3, 5, 8, 13, 21]
WINDOWS, LEAST = (7, 14), (2, 3)
STAGES = {"train": ("1995-01-01", "1997-12-31"), "validation": ("1998-01-01", "1999-06-30"), "test": ("1999-07-01", "2001-12-31")}


def grid_rows(s, d):
    def make():
        o = returns.event_returns(events(s, d), fx(s, d, "fx_daily"), fx(s, d, "fx_benchmark"), fx(s, d, "fx_calendar"), GRID_HORIZONS)
        buys = fx(s, d, "fx_transactions").where("transaction_code = 'P' AND NOT is_amendment").withColumnRenamed("issuer_id", "security_id")
        for w in WINDOWS:
            n = windows.trailing_distinct(buys.select("security_id", "filing_date", "owner_id"), "security_id", "filing_date", "owner_id", w, f"buyers_{w}")
            o = o.join(n.select("security_id", "filing_date", f"buyers_{w}").distinct(), ["security_id", "filing_date"])
        exits = fx(s, d, "fx_calendar").select(F.col("session_no").alias("end_no"), F.col("session_date").alias("exit_date"))
        return o.join(F.broadcast(exits), "end_no", "left").withColumn("quarter", F.trunc("filing_date", "QUARTER"))  # one row a session

    return stored(s, d, "grid_rows", make)


def e21(s, d):
    """56 cells: two windows, two thresholds, seven horizons, raw and winsorised."""
    x = selection.select_once(selection.arms(grid_rows(s, d), WINDOWS, LEAST), STAGES)
    r6 = [F.round(c, 6).alias(c) for c in ("mean", "se", "t", "p", "p_one", "p_holm")]
    return x.select("stage", *selection.CELL, "n", "issuers", "quarters", "source", "df", *r6, "place", "duplicate", "chosen", "status")


def _stage_sql(stage: str, cells: str) -> str:
    """CTEs to fit_stage(w, k, horizon, est, ...): floored means of the cells listed in ``cells``."""
    start, end = STAGES[stage]
    by = "w, k, horizon, est"
    part = lambda n, keys: f"{stage}_{n} AS (SELECT {by}, count(*) AS g, sum(q * q) * CASE WHEN count(*) > 1 THEN count(*) / (count(*) - 1) END AS v FROM (SELECT {by}, {keys}, sum(u) AS q FROM {stage}_u GROUP BY {by}, {keys}) GROUP BY {by})"
    return f"""{stage}_r AS MATERIALIZED (SELECT a.* FROM arm a SEMI JOIN {cells} c ON c.w = a.w AND c.k = a.k AND c.horizon = a.horizon WHERE filing_date BETWEEN DATE '{start}' AND DATE '{end}' AND entry_no IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY a.w, a.k, a.horizon, security_id, entry_no ORDER BY filing_date) = 1),
{stage}_s(w, k, horizon, security_id, entry_no) AS (SELECT w, k, horizon, security_id, min(entry_no) FROM {stage}_r GROUP BY 1, 2, 3, 4
  UNION ALL SELECT s.w, s.k, s.horizon, s.security_id, min(r.entry_no) FROM {stage}_s s JOIN {stage}_r r ON r.w = s.w AND r.k = s.k AND r.horizon = s.horizon AND r.security_id = s.security_id AND r.entry_no >= s.entry_no + s.horizon
    GROUP BY s.w, s.k, s.horizon, s.security_id, s.entry_no),
{stage}_x AS (SELECT r.w, r.k, r.horizon, r.security_id, date_trunc('quarter', filing_date) AS quarter, unnest(['raw', 'wins100']) AS est, unnest([excess_return, greatest(-1.0, least(1.0, excess_return))]) AS y
  FROM {stage}_r r JOIN {stage}_s s ON s.w = r.w AND s.k = r.k AND s.horizon = r.horizon AND s.security_id = r.security_id AND s.entry_no = r.entry_no WHERE exit_date <= DATE '{end}' AND excess_return IS NOT NULL),
{stage}_m AS (SELECT {by}, count(*) AS n, avg(y) AS mean FROM {stage}_x GROUP BY {by}),
{stage}_u AS MATERIALIZED (SELECT x.*, (y - mean) / n AS u FROM {stage}_x x JOIN {stage}_m USING (w, k, horizon, est)),
{part('a', 'security_id')}, {part('b', 'quarter')}, {part('c', 'security_id, quarter')}, {stage}_h AS (SELECT {by}, sum(u * u) AS h FROM {stage}_u GROUP BY {by}),
{stage}_v AS (SELECT m.*, a.g AS issuers, b.g AS quarters, (a.v + b.v - c.v) AS v1, a.v AS v2, b.v AS v3, h * CASE WHEN n > 1 THEN n / (n - 1) END AS v4
  FROM {stage}_m m JOIN {stage}_a a USING (w, k, horizon, est) JOIN {stage}_b b USING (w, k, horizon, est) JOIN {stage}_c c USING (w, k, horizon, est) JOIN {stage}_h USING (w, k, horizon, est)),
{stage}_z AS (SELECT *, greatest(v1, v2, v3, v4) AS v, CASE WHEN n < 2 THEN 'too_few' WHEN issuers < 2 OR quarters < 2 THEN 'insufficient_clusters' WHEN NOT coalesce(greatest(v1, v2, v3, v4) > 0, FALSE) THEN 'degenerate_variance' ELSE 'ok' END AS status FROM {stage}_v),
{stage}_t AS (SELECT *, CASE WHEN status = 'ok' THEN sqrt(v) END AS se, CASE WHEN status = 'ok' THEN CASE WHEN v1 >= v * (1 - 1e-9) THEN 'two_way' WHEN v2 >= v * (1 - 1e-9) THEN 'issuer' WHEN v3 >= v * (1 - 1e-9) THEN 'quarter' ELSE 'hc1' END END AS source,
  CASE WHEN status = 'ok' THEN mean / sqrt(v) END AS t, CASE WHEN status = 'ok' THEN least(issuers, quarters) - 1 END AS df FROM {stage}_z),
fit_{stage} AS MATERIALIZED (SELECT *, CASE WHEN t > 0 THEN p / 2 ELSE 1 - p / 2 END AS p_one FROM (SELECT *, {p_sql('t', 'df')} AS p FROM {stage}_t))"""


_SHOWN = "w, k, horizon, est, n, issuers, quarters, source, df, round(mean, 6) AS mean, round(se, 6) AS se, round(t, 6) AS t, round(p, 6) AS p, round(p_one, 6) AS p_one"
E21_SQL = f"""WITH RECURSIVE {at_horizons(GRID_HORIZONS)},
bu AS (SELECT DISTINCT issuer_id, filing_date, owner_id FROM fx_transactions WHERE transaction_code = 'P' AND NOT is_amendment),
bw AS (SELECT a.issuer_id, a.filing_date, count(DISTINCT b.owner_id) FILTER (WHERE b.filing_date >= a.filing_date - 6) AS b7, count(DISTINCT b.owner_id) AS b14
  FROM (SELECT DISTINCT issuer_id, filing_date FROM bu) a JOIN bu b ON b.issuer_id = a.issuer_id AND b.filing_date BETWEEN a.filing_date - 13 AND a.filing_date GROUP BY 1, 2),
arm AS MATERIALIZED (SELECT e1.*, session_date AS exit_date, g.w, g.k FROM e1 JOIN bw ON bw.issuer_id = security_id AND bw.filing_date = e1.filing_date LEFT JOIN fx_calendar ON session_no = end_no
  JOIN (VALUES (7, 2), (7, 3), (14, 2), (14, 3)) g(w, k) ON CASE g.w WHEN 7 THEN b7 ELSE b14 END >= g.k),
allc AS (SELECT DISTINCT w, k, horizon FROM arm), {_stage_sql('train', 'allc')},
pl AS (SELECT *, row_number() OVER (ORDER BY round(t, 9) DESC NULLS LAST, est, w, k, horizon) AS place FROM fit_train),
du AS (SELECT *, row_number() OVER (PARTITION BY w, k, horizon, n, round(mean, 12), round(se, 12) ORDER BY place) > 1 AS duplicate,
  coalesce(p, 1.0) * (count(*) OVER () - row_number() OVER (ORDER BY coalesce(p, 1.0), w, k, horizon, est) + 1) AS hx FROM pl),
tr AS MATERIALIZED (SELECT *, least(1.0, max(hx) OVER (ORDER BY coalesce(p, 1.0), w, k, horizon, est ROWS UNBOUNDED PRECEDING)) AS p_holm,
  NOT duplicate AND status = 'ok' AND sum((NOT duplicate AND status = 'ok')::INT) OVER (ORDER BY place) <= 3 AS chosen FROM du),
c1 AS MATERIALIZED (SELECT w, k, horizon, est, place FROM tr WHERE chosen), {_stage_sql('validation', 'c1')},
va AS MATERIALIZED (SELECT *, good AND row_number() OVER (ORDER BY good DESC, round(t, 9) DESC NULLS LAST, place) = 1 AS chosen
  FROM (SELECT f.*, place, coalesce(status = 'ok' AND t > 0 AND p_one < 0.10, FALSE) AS good FROM fit_validation f JOIN c1 USING (w, k, horizon, est))),
c2 AS MATERIALIZED (SELECT w, k, horizon, est, place FROM va WHERE chosen), {_stage_sql('test', 'c2')},
te AS (SELECT f.*, place, coalesce(status = 'ok' AND p < 0.05 AND mean > 0, FALSE) AS chosen FROM fit_test f JOIN c2 USING (w, k, horizon, est))
SELECT 'train' AS stage, {_SHOWN}, round(p_holm, 6) AS p_holm, place, duplicate, chosen, status FROM tr
UNION ALL SELECT 'validation', {_SHOWN}, NULL, place, NULL, chosen, status FROM va UNION ALL SELECT 'test', {_SHOWN}, NULL, place, NULL, chosen, status FROM te"""

def w13(s, d):
    """The spaced sample of the train stage, of every cell: exits inside the stage, known returns."""
    x = selection.stage_sample(selection.arms(grid_rows(s, d), WINDOWS, LEAST), *STAGES["train"])
    return x.select("w", "k", "horizon", "security_id", "filing_date", "entry_no", "exit_date", F.round("excess_return", 6).alias("excess_return"))


W13_SQL = f"""{E21_SQL[:E21_SQL.index(",\ntrain_x AS")]}
SELECT r.w, r.k, r.horizon, r.security_id, r.filing_date, r.entry_no, r.exit_date, round(r.excess_return, 6) AS excess_return FROM train_r r
JOIN train_s s ON s.w = r.w AND s.k = r.k AND s.horizon = r.horizon AND s.security_id = r.security_id AND s.entry_no = r.entry_no WHERE r.exit_date <= DATE '{STAGES["train"][1]}' AND r.excess_return IS NOT NULL"""

QUERIES = {"e21_selection": (e21, with_views(E21_SQL)), "w13_greedy_spacing": (w13, with_views(W13_SQL))}
