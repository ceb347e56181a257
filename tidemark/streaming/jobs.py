"""Structured Streaming jobs: incremental upsert, the balance check of positions, trailing distinct actors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.continuity import CHECKED, POSITION, pass_rows, step_rows
from ..plans.fixtures import fx
from ..sources.tables import PARTS, part_of, save, scratch


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A file stream over one of the driver's tables (a Parquet file or a folder of them)."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def finish(query) -> None:
    try:
        query.awaitTermination()
    finally:
        query.stop()


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Published versions of a table, oldest first: folders v000000, v000001, ... that were written whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = sorted(f"{folder}/{s.getPath().getName()}" for s in fs.listStatus(path) if s.getPath().getName().startswith("v"))
    return [v for v in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{v}/_SUCCESS"))]


def incremental_upsert(stream: DataFrame, key: str, version: str, failed: str, folder: str) -> DataFrame:
    """Fold a stream into one row per key: the latest successful version, attempts, and whether a failure stands.

    Each batch is merged with the newest version published by an earlier batch and published as its own, so a
    batch that runs again, in this run or after a restart on the same ``folder``, replaces its own output only and
    counts no row twice. Versions older than the two newest are deleted.
    """
    spark = stream.sparkSession
    table = f"{folder}/table"

    def merge(batch: DataFrame, batch_id: int) -> None:
        own = batch.groupBy(key).agg(F.count("*").alias("attempts"), F.max(F.when(~F.col(failed), F.col(version))).alias("done_version"), F.max(version).alias("last_version"))
        path = f"{table}/v{batch_id:06d}"
        before = [v for v in versions(spark, table) if v.rpartition("/")[2] < f"v{batch_id:06d}"]
        if before:
            own = own.unionByName(spark.read.parquet(before[-1]))
        out = own.groupBy(key).agg(F.sum("attempts").alias("attempts"), F.max("done_version").alias("done_version"), F.max("last_version").alias("last_version"))
        out.write.mode("overwrite").parquet(path)
        for old in before[:-1]:
            gone = spark._jvm.org.apache.hadoop.fs.Path(old)
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    finish(stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start())
    out = spark.read.parquet(versions(spark, table)[-1])
    return out.select(key, "attempts", "done_version", F.when(F.col("done_version").isNull(), "failed").otherwise("done").alias("status"))


def streaming_continuity(rows: DataFrame, splits: DataFrame, folder: str, keys: list[str] = POSITION, tolerance: float = 1e-6) -> DataFrame:
    """The balance check of ``operators.continuity`` over a stream of resolved rows: the same pass, a position a key kept as state.

    Rows of one batch are taken in the order of the batch check; batches must come in the order of availability. A batch meets
    the positions that the newest earlier batch published and publishes its own results and positions as one partition of the
    table, so a batch that runs again, in this run or after a restart on the same ``folder``, replaces its own output
    only. Positions older than the two newest are deleted. Returns all results published so far.
    """
    spark, table = rows.sparkSession, f"{folder}/out"

    def check(batch: DataFrame, batch_id: int) -> None:
        path = lambda k: f"{table}/batch={k}"
        before = [k for k in batches(spark, table) if k < batch_id]
        ready = step_rows(batch, splits, keys)
        if before:
            held = spark.read.schema(pass_rows(ready, keys, tolerance).schema).parquet(path(before[-1])).where("is_state")
            ready = ready.unionByName(held.drop("factor", "expected", "difference", "status"), allowMissingColumns=True)
        for k in range(PARTS):
            save(pass_rows(ready.where(part_of(k, *keys)), keys, tolerance), path(batch_id), "append" if k else "overwrite", ["is_state"])
        save(spark.range(1), f"{path(batch_id)}/_published")
        for old in before[:-1]:
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path(old)}/is_state=true")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    finish(rows.writeStream.foreachBatch(check).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start())
    if not batches(spark, table):
        return spark.createDataFrame([], CHECKED)
    return spark.read.schema(f"{CHECKED}, batch int, is_state boolean").parquet(table).where("NOT is_state").drop("batch", "is_state")


def batches(spark: SparkSession, table: str) -> list[int]:
    """Batches of a table that were published whole, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n.rpartition("=")[2]) for n in found if n.startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/{n}/_published")))


def trailing_actor_alerts(stream: DataFrame, group: str, at: str, actor: str, days: int, least: int, folder: str) -> DataFrame:
    """Windows of ``days`` days, one a day, in which ``least`` or more distinct actors appear; a window is final once the
    watermark (a day) has passed it, so a later row never changes an earlier alert."""
    seen = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, "1 day").groupBy(F.window(at, f"{days} days", "1 day").alias("w"), group).agg(F.size(F.collect_set(actor)).alias("actors"))
    out = seen.where(F.col("actors") >= least).select(group, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "actors")
    query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True)
    finish(query.start())
    return stream.sparkSession.read.schema(out.schema).parquet(f"{folder}/out")


def st1(spark, d):
    e = table_stream(spark, d, "events").withColumn("failed", F.col("event_type") == "error")
    return incremental_upsert(e, "user_id", "event_id", "failed", scratch(spark, "st1"))


def st2(spark, d):
    """Two runs on one folder, as if restarted: filings up to a day, then the others."""
    from ..plans.continuity import resolved

    rows, splits, folder = resolved(spark, d), fx(spark, d, "fx_splits"), scratch(spark, "st2")
    day = F.lit("1998-06-30").cast("date")
    for part in (F.col("available_at") <= day, ~F.coalesce(F.col("available_at") <= day, F.lit(False))):
        save(rows.where(part), f"{folder}/in", "append")
        out = streaming_continuity(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), splits, folder)
    return out.select("owner_row_id", *[F.round(c, 6).alias(c) for c in ("factor", "expected", "difference")], "status")


def st4(spark, d):
    return trailing_actor_alerts(table_stream(spark, d, "events"), "event_type", "ts", "user_id", 7, 2, scratch(spark, "st4"))


def st3(spark, d):
    """State as of an observation time: the latest row per key that was available by then."""
    e = spark.read.parquet(f"{d}/events.parquet").where("ts <= TIMESTAMP'2024-01-15 00:00:00'")
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return e.withColumn("k", F.row_number().over(w)).where("k = 1").select("user_id", "event_id", "event_type")
