"""Student's t in SQL, by the finite sums that hold for whole degrees of freedom; for the oracle."""

from __future__ import annotations


def p_sql(t: str, df: str) -> str:
    """Two-sided p of ``t``: theta = atan(|t| / sqrt(df)) and a sum of powers of its cosine, even and odd df apart."""
    c2, sine = f"({df} / ({df} + {t} * {t}))", f"(abs({t}) / sqrt({df} + {t} * {t}))"
    total = lambda upto, term: f"coalesce(list_sum(list_transform(range(0, CAST({upto} AS BIGINT)), lambda j: exp({term} + j * ln({c2})))), 0)"
    even = f"{sine} * {total(f'{df} // 2', 'lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)')}"
    odd = f"2 / pi() * (atan(abs({t}) / sqrt({df})) + {sine} * sqrt({c2}) * {total(f'({df} - 1) // 2', 'lgamma(j + 1) - lgamma(j + 1.5) + lgamma(1.5)')})"
    return f"CASE WHEN {t} IS NOT NULL AND {df} > 0 THEN 1 - CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END END"


def critical_sql(source: str, df: str = "df") -> str:
    """CTEs (the query must be recursive) to crit(df, c): the 97.5 % quantile for each df of ``source``, by halving."""
    middle = "((lo + hi) / 2)"
    return f"""crits(df, lo, hi, k) AS (SELECT DISTINCT CAST({df} AS BIGINT), 0.0::DOUBLE, 100.0::DOUBLE, 0 FROM {source} WHERE {df} > 0
  UNION ALL SELECT df, CASE WHEN above THEN m ELSE lo END, CASE WHEN above THEN hi ELSE m END, k + 1
  FROM (SELECT *, {p_sql("m", "df")} > 0.05 AS above FROM (SELECT *, {middle} AS m FROM crits WHERE k < 60))),
crit AS (SELECT df, {middle} AS c FROM crits WHERE k = 60)"""
