"""Choosing one of many configurations on early data, once, and trying it on later data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from . import stats, windows

CELL = ["w", "k", "horizon", "est"]
TOP, ONE_SIDED, TWO_SIDED = 3, 0.10, 0.05


def arms(rows: DataFrame, windows_: tuple[int, ...], least: tuple[int, ...]) -> DataFrame:
    """``rows`` once for each window w and threshold k at which ``buyers_w`` reaches k."""
    cells = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(k).alias("k"), (F.col(f"buyers_{w}") >= k).alias("_in")) for w in windows_ for k in least])
    return rows.withColumn("_c", F.explode(cells)).where("_c._in").select("*", "_c.w", "_c.k").drop("_c")


def stage_sample(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of a stage: signals between its days; per window, threshold, horizon and issuer the first and then each that enters at
    least ``horizon`` sessions after the one kept before; of these, those whose exit lies in the stage and whose return is known.
    Spacing never looks at returns."""
    own = rows.where(F.col("filing_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col("entry_no").isNotNull())
    keys = ["w", "k", "horizon", "security_id"]
    first = own.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "entry_no").orderBy("filing_date"))).where("_n = 1").drop("_n")
    kept = windows.greedy_spacing(first, keys, "entry_no", F.col("horizon"))
    inside = F.col("exit_date").isNotNull() & (F.col("exit_date") <= F.lit(end).cast("date")) & F.col("excess_return").isNotNull() & ~F.isnan("excess_return")
    return first.join(kept, [*keys, "entry_no"]).where(inside)


def fitted(sample: DataFrame) -> DataFrame:
    """Mean of every cell, raw and winsorised at +-1, with its floored inference and one-sided p."""
    y = F.col("excess_return")
    each = F.array(F.struct(F.lit("raw").alias("est"), y.alias("y")), F.struct(F.lit("wins100").alias("est"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y)).alias("y")))
    both = sample.withColumn("_e", F.explode(each)).select("w", "k", "horizon", "security_id", "quarter", "_e.est", "_e.y")
    fit = stats.floored_mean(both, CELL, "y", "security_id", "quarter")
    return fit.withColumn("p_one", F.when(F.col("t") > 0, F.col("p") / 2).otherwise(1 - F.col("p") / 2))


def select_once(rows: DataFrame, stages: dict[str, tuple[str, str]]) -> DataFrame:
    """The ledger of all stages: every cell on train with Holm's p and its place by t, the best ones on validation, the chosen one on test.

    Cells that repeat an earlier one (same sample, mean and error) are marked and never chosen. Of the best TOP on validation only
    those with t above 0 and one-sided p below ONE_SIDED stay, and the largest t is tried on test; if none stays nothing is
    tried. ``chosen`` means: goes on to the next stage, on test: significant and above 0.
    """
    by_t = F.round("t", 9).desc_nulls_last()  # equal samples tie, whatever order their rows were summed in
    place = Window.orderBy(by_t, "est", "w", "k", "horizon")  # one row a cell
    same = Window.partitionBy("w", "k", "horizon", "n", F.round("mean", 12), F.round("se", 12)).orderBy("place")
    fit = fitted(stage_sample(rows, *stages["train"])).withColumn("place", F.row_number().over(place)).withColumn("duplicate", F.row_number().over(same) > 1)
    fit = fit.withColumn("_p", F.coalesce("p", F.lit(1.0))).withColumn("_all", F.lit(1)).withColumn("_key", F.format_string("%05d|%05d|%05d|%s", "w", "k", "horizon", "est"))
    fit = stats.holm(fit, "_p", "_key", ["_all"]).drop("_p", "_key")
    fair = ~F.col("duplicate") & (F.col("status") == "ok")
    train = written(fit.withColumn("chosen", fair & (F.sum(fair.cast("int")).over(Window.partitionBy("_all").orderBy("place")) <= TOP)).drop("_all"))
    out = train.withColumn("stage", F.lit("train"))
    chosen = train.where("chosen").select(*CELL, "place")
    for stage in ("validation", "test"):
        wanted = F.broadcast(chosen)  # at most TOP rows
        cells = rows.join(F.broadcast(chosen.select("w", "k", "horizon").distinct()), ["w", "k", "horizon"])
        fit = fitted(stage_sample(cells, *stages[stage])).join(wanted, CELL)
        if stage == "validation":
            good = F.coalesce((F.col("status") == "ok") & (F.col("t") > 0) & (F.col("p_one") < ONE_SIDED), F.lit(False))
            best = F.row_number().over(Window.orderBy(good.desc(), by_t, "place")) == 1
            fit = fit.withColumn("chosen", good & best)
        else:
            fit = fit.withColumn("chosen", F.coalesce((F.col("status") == "ok") & (F.col("p") < TWO_SIDED) & (F.col("mean") > 0), F.lit(False)))
        fit = written(fit)
        out = out.unionByName(fit.withColumn("stage", F.lit(stage)), allowMissingColumns=True)
        chosen = fit.where("chosen").select(*CELL, "place")
    return out.select("stage", *CELL, "n", "issuers", "quarters", "mean", "se", "source", "t", "df", "p", "p_one", "p_holm", "place", "duplicate", "chosen", "status")
