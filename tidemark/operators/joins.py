"""Joins of effective-dated data. Every helper needs an equality key; none is a theta join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assert_unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """``df``, or an error if ``keys`` repeat in it."""
    if not df.groupBy(*keys).count().where("count > 1").limit(1).isEmpty():
        raise ValueError(f"{what}: {', '.join(keys)} must be unique")
    return df


def equi_join(left: DataFrame, right: DataFrame, keys: list[str], validate: str, how: str = "inner") -> DataFrame:
    """Join with a cardinality contract: one_to_one, one_to_many, many_to_one or many_to_many."""
    a, _, b = validate.partition("_to_")
    if a == "one":
        assert_unique(left, keys, "left side")
    if b == "one":
        assert_unique(right, keys, "right side")
    return left.join(right, keys, how)


def interval_candidates(rows: DataFrame, intervals: DataFrame, key: str, date: str, start: str, end: str, months: int = 0) -> DataFrame:
    """Rows with every interval of their ``key`` that contains ``date`` (null end: open). With ``months``, intervals are cut
    into spans of so many months and joined on (key, span), for keys with very many intervals."""
    inside = (F.col(date) >= F.col(start)) & (F.col(end).isNull() | (F.col(date) <= F.col(end)))
    if not months:
        return rows.join(intervals, key).where(inside)
    number = lambda c: F.floor((F.year(c) * 12 + F.month(c)) / months)
    spans = intervals.withColumn("_m", F.explode(F.sequence(number(F.col(start)), number(F.coalesce(F.col(end), F.lit("2100-01-01").cast("date"))))))
    return rows.withColumn("_m", number(F.col(date))).join(spans, [key, "_m"]).where(inside).drop("_m")


def latest_interval(rows: DataFrame, intervals: DataFrame, key: str, date: str, row_key: list[str], start: str, end: str, ties: list[Column], months: int = 12) -> DataFrame:
    """The latest-starting containing interval of each row."""
    w = Window.partitionBy(*row_key).orderBy(F.desc(start), *ties)
    found = interval_candidates(rows, intervals, key, date, start, end, months)
    return found.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def pit_map(rows: DataFrame, intervals: DataFrame, key: str, date: str, row_key: list[str], security: str, start: str, end: str, pit: str, months: int = 12) -> DataFrame:
    """One row per ``row_key``: its security, or null with the reason (no_match, ambiguous).

    If any containing interval is point-in-time only those count; exactly one security must remain."""
    found = interval_candidates(rows, intervals, key, date, start, end, months)
    any_pit = F.bool_or(pit).over(Window.partitionBy(*row_key))
    used = found.withColumn("_pit", any_pit).where(~F.col("_pit") | F.col(pit)).groupBy(*row_key).agg(F.collect_set(security).alias("_s"))
    out = rows.select(*row_key).distinct().join(used, row_key, "left")
    status = F.when(F.col("_s").isNull(), "no_match").when(F.size("_s") > 1, "ambiguous").otherwise("mapped")
    return out.select(*row_key, F.when(F.size("_s") == 1, F.get("_s", F.lit(0))).alias(security), status.alias("status"))


def asof(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, values: list[str], strict: bool = False, tolerance: int | None = None, forward: bool = False) -> DataFrame:
    """``left`` plus the last ``right`` row of its key at or before ``at`` (strictly before; at or after with ``forward``),
    at most ``tolerance`` days away. Both sides are sorted once by key and time, no range is exploded."""
    cols = [right_at, *values]
    l_side = left.select(F.struct(*[F.col(c) for c in left.columns]).alias("_l"), F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(0 if strict else 1).alias("_o"), F.lit(None).cast(right.select(F.struct(*cols)).schema[0].dataType).alias("_r"))
    r_side = right.select(F.lit(None).cast(l_side.schema["_l"].dataType).alias("_l"), F.col(key).alias("_k"), F.col(right_at).alias("_t"), F.lit(1 if strict else 0).alias("_o"), F.struct(*cols).alias("_r"))
    if forward:
        order = [F.desc("_t"), F.col("_o")]
    else:
        order = [F.asc("_t"), F.col("_o")]
    w = Window.partitionBy("_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = l_side.unionByName(r_side).withColumn("_hit", F.last("_r", ignorenulls=True).over(w)).where(F.col("_l").isNotNull())
    hit = F.col("_hit")
    if tolerance is not None:
        hit = F.when(F.abs(F.datediff("_t", F.col(f"_hit.{right_at}"))) <= tolerance, F.col("_hit"))
    both = both.withColumn("_hit", hit)
    return both.select("_l.*", *[F.col(f"_hit.{c}").alias(f"asof_{c}") for c in cols])


def link_prefer_primary(rows: DataFrame, links: DataFrame, key: str, date: str, row_key: list[str], start: str, end: str, primary: str, ties: list[Column]) -> DataFrame:
    """A link valid on the date if there is one, else any link of the key; primary links first. Rows without a link stay."""
    valid = F.coalesce((F.col(date) >= F.col(start)) & (F.col(end).isNull() | (F.col(date) <= F.col(end))), F.lit(False))
    joined = rows.join(links, key, "left").withColumn("is_valid", valid)
    w = Window.partitionBy(*row_key).orderBy(F.desc("is_valid"), F.desc(primary), *ties)
    return joined.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def overlap_join(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Intersections of the intervals (start, end) of both sides with one key."""
    x, y = a.withColumnsRenamed({"start": "_a0", "end": "_a1"}), b.withColumnsRenamed({"start": "_b0", "end": "_b1"})
    out = x.join(y, key).where("_a0 <= _b1 AND _b0 <= _a1")
    return out.withColumn("start", F.greatest("_a0", "_b0")).withColumn("end", F.least("_a1", "_b1")).drop("_a0", "_a1", "_b0", "_b1")
