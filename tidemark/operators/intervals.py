"""Algebra of effective-dated rows: closed date intervals (start, end) per key, null end open."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import classification, ranked
from .joins import asof

OPEN = "2100-01-01"


def split_at(intervals: DataFrame, boundaries: DataFrame, key: str) -> DataFrame:
    """Cut every interval at the ``boundary`` dates of its key that lie inside it."""
    own = intervals.withColumn("_id", F.struct(*[F.col(c) for c in intervals.columns]))
    cuts = own.join(boundaries.select(key, F.col("boundary").alias("_b")).distinct(), key).where("_b > start AND _b <= end").select("_id", "_b")
    starts = own.select("_id", F.col("start").alias("_b")).union(cuts).distinct()
    nxt = F.lead("_b").over(Window.partitionBy("_id").orderBy("_b"))
    out = starts.withColumn("_e", F.coalesce(F.date_sub(nxt, 1), F.col("_id.end")))
    return out.select(*[F.col("_b").alias(c) if c == "start" else F.col("_e").alias(c) if c == "end" else F.col(f"_id.{c}") for c in intervals.columns])


def coalesce_adjacent(intervals: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """Merge rows of a key that follow each other without a gap and agree in ``attributes`` (null equals null).

    Rows of one interval come in the order of their attributes."""
    w = Window.partitionBy(*keys).orderBy("start", "end", *attributes)
    same = F.coalesce(F.date_add(F.lag("end").over(w), 1) == F.col("start"), F.lit(False))
    for a in attributes:
        same = same & F.col(a).eqNullSafe(F.lag(a).over(w))
    marked = intervals.withColumn("_new", (~same).cast("int"))
    runs = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run", *attributes).agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def close_history(history: DataFrame, keys: list[str], start: str = "start") -> DataFrame:
    """``end`` of each row as the day before the next start of its key; the last stays open."""
    nxt = F.lead(start).over(Window.partitionBy(*keys).orderBy(start))
    return history.withColumn("end", F.date_sub(nxt, 1))


def overlaps(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that start on or before the latest end of the rows before them; ties go by the remaining columns."""
    rest = [c for c in intervals.columns if c not in (*keys, "start", "end")]
    w = Window.partitionBy(*keys).orderBy("start", "end", *rest).rowsBetween(Window.unboundedPreceding, -1)
    return intervals.withColumn("_m", F.max("end").over(w)).where("start <= _m").drop("_m")


def prepare_links(links: DataFrame) -> DataFrame:
    """Null bounds become defaults, reversed intervals go, rows are distinct."""
    out = links.withColumn("start", F.coalesce("start", F.lit("1900-01-01").cast("date"))).withColumn("end", F.coalesce("end", F.lit(OPEN).cast("date")))
    return out.where("start <= end").dropDuplicates()


def active_link(rows: DataFrame, links: DataFrame, key: str, date: str, row_key: list[str], rank: list, company: str) -> DataFrame:
    """The best-ranked link active on the date; a tie between different companies is ambiguous."""
    c = rows.join(links, key).where((F.col(date) >= F.col("start")) & (F.col(date) <= F.col("end")))
    best = c.withColumn("_r", F.rank().over(Window.partitionBy(*row_key).orderBy(*rank))).where("_r = 1")
    g = best.groupBy(*row_key).agg(F.countDistinct(company).alias("_k"), F.min(company).alias(company))
    return g.select(*row_key, F.when(F.col("_k") == 1, F.col(company)).alias(company), F.when(F.col("_k") == 1, "linked").otherwise("AMBIGUOUS").alias("status"))


def tiles(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Parents whose children do not tile them exactly: (keys, ok)."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    c = children.withColumn("_gap", F.coalesce(F.date_add(F.lag("end").over(w), 1) != F.col("start"), F.lit(False)))
    g = c.groupBy(*keys).agg(F.min("start").alias("_a"), F.max("end").alias("_b"), F.bool_or("_gap").alias("_g"))
    j = parents.join(g, keys, "left")
    return j.select(*keys, F.coalesce((F.col("_a") == F.col("start")) & (F.col("_b") == F.col("end")) & ~F.col("_g"), F.lit(False)).alias("ok"))


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """One row per check: its name and number of violating rows."""
    out = None
    for name, bad in checks.items():
        row = bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations")
        out = row if out is None else out.union(row)
    return out


def history_value(segments: DataFrame, history: DataFrame, value: str) -> DataFrame:
    """``segments`` plus ``value`` of ``history`` (security_id, gvkey, value, start, end) on the segment's first day.

    History of the segment's own (security_id, gvkey) counts if there is any, else that without gvkey; the latest start on or
    before the day decides, and nothing holds after its end.
    """
    key = lambda g: F.concat_ws("|", F.col("security_id").cast("string"), F.coalesce(g, F.lit("")))
    known = history.select(key(F.col("gvkey")).alias("_key"), F.col("start").alias("_since"), F.col("end").alias("_until"), F.col(value).alias("_value"))
    own = segments.withColumn("_own", key(F.col("gvkey")))
    own = own.join(known.select(F.col("_key").alias("_own")).distinct().withColumn("_has", F.lit(True)), "_own", "left")
    own = own.withColumn("_key", F.when(F.col("_has"), F.col("_own")).otherwise(key(F.lit(None).cast("string")))).drop("_own", "_has")
    found = asof(own, known, "_key", "start", "_since", ["_until", "_value"])
    holds = F.col("asof__until").isNull() | (F.col("start") <= F.col("asof__until"))
    return found.withColumn(value, F.when(holds, F.col("asof__value"))).select(*segments.columns, value)


def classified_intervals(membership: DataFrame, gics: DataFrame, sic: DataFrame, links: DataFrame) -> DataFrame:
    """Membership (security_id, start, end, crsp_sic) cut wherever a code or a link changes, classified, and merged again.

    Codes are (security_id, gvkey, gics_code or compustat_sic, start, end or null); links (security_id, gvkey, cik, cik_source,
    linkprim, linktype, start, end). A segment's link is the best-ranked one on its first day (historical identifiers, then primary
    links, then link types); equally ranked links of different companies are ambiguous and give none, and without a link no
    code by gvkey counts. What each segment was told by stays beside it, so only segments that agree in all of it are merged.
    """
    days = None
    for h in (gics, sic, links):
        own = h.select("security_id", F.explode(F.array("start", F.date_add("end", 1))).alias("boundary")).where("boundary IS NOT NULL")
        days = own if days is None else days.unionByName(own)
    cut = split_at(membership, days, "security_id")
    order = [ranked("cik_source", ["crsp.comphist_hcik"]), ranked("linkprim", ["P", "C"]), ranked("linktype", ["LC", "LU", "LS"])]
    named = links.withColumnsRenamed({"start": "_from", "end": "_upto"}).withColumn("_rank", F.struct(*[o.alias(f"r{i}") for i, o in enumerate(order)]))
    active = cut.select("security_id", "start").join(named, "security_id").where("start >= _from AND start <= _upto")
    best = active.withColumn("_r", F.rank().over(Window.partitionBy("security_id", "start").orderBy("_rank"))).where("_r = 1")
    company = F.struct("gvkey", "cik", "cik_source", "linkprim", "linktype")
    one = best.groupBy("security_id", "start").agg(F.count_distinct(F.struct("gvkey", "cik")).alias("_k"), F.min(company).alias("_link"))
    seg = cut.join(one, ["security_id", "start"], "left")
    link = F.when(F.col("_k") == 1, F.col("_link"))
    seg = seg.withColumn("identifier_match_status", F.when(F.col("_k").isNull(), "UNMATCHED").when(F.col("_k") > 1, "AMBIGUOUS").otherwise("MATCHED"))
    seg = seg.withColumns({c: link[c] for c in ("gvkey", "cik", "cik_source", "linkprim", "linktype")}).drop("_k", "_link")
    historical = F.coalesce(F.col("cik").isNotNull() & (F.col("cik_source") == "crsp.comphist_hcik"), F.lit(False))
    source = F.when(F.col("cik").isNull(), "MISSING").when(historical, "POINT_IN_TIME").when(F.col("cik_source") == "comp.company_current", "CURRENT_FALLBACK").otherwise("UNVERIFIED_SOURCE")
    seg = seg.withColumns({"cik_is_point_in_time": historical, "cik_match_status": source})
    linked = F.col("identifier_match_status") == "MATCHED"
    for h, c in ((gics, "gics_code"), (sic, "compustat_sic")):
        seg = history_value(seg, h, c).withColumn(c, F.when(linked, F.col(c)))
    seg = seg.withColumns(classification(F.col("gics_code"), F.col("crsp_sic"), F.col("compustat_sic")))
    rest = [c for c in seg.columns if c not in ("security_id", "start", "end")]
    merged = coalesce_adjacent(seg, ["security_id"], rest)
    day = lambda c: F.date_format(c, "yyyyMMdd")
    return merged.withColumn("interval_id", F.concat_ws(":", F.col("security_id").cast("string"), day("start"), day("end")))
