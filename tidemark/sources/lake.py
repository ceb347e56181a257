"""A lake of filings by year and quarter, and a manifest that reads a quarter again only when it has changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYOUT = ["year", "quarter"]


def write_quarters(df: DataFrame, date: str, root: str, mode: str = "append") -> None:
    """``df`` under year=/quarter= folders of its ``date``. Rows without a date go to year 0. A large quarter becomes several files."""
    known = F.col(date).isNotNull()
    out = df.withColumns({"year": F.when(known, F.year(date)).otherwise(0), "quarter": F.when(known, F.quarter(date)).otherwise(0)})
    out.hint("rebalance", *LAYOUT).write.partitionBy(*LAYOUT).mode(mode).parquet(root)


def scan_partitioned(spark: SparkSession, root: str, first: int, last: int, columns: list[str]) -> DataFrame:
    """Some columns of the years from ``first`` to ``last``; other years' folders aren't opened."""
    return spark.read.parquet(root).where(F.col("year").between(first, last)).select(*columns)


def quarter_stamps(spark: SparkSession, root: str) -> dict[tuple[int, int], str]:
    """(year, quarter) -> what changes when a file of the folder does. A lake of decades has a few hundred folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/year=*/quarter=*")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = {}
    for status in fs.globStatus(path) or []:
        folder = status.getPath()
        parts = sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in fs.listStatus(folder))
        key = (int(folder.getParent().getName().partition("=")[2]), int(folder.getName().partition("=")[2]))
        out[key] = ";".join(parts)
    return out


def update_manifest(spark: SparkSession, root: str, folder: str, kind: str) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(manifest, quarters read): per file of the lake and value of ``kind`` the rows and a digest of them that no order changes.

    ``folder`` keeps one part per quarter with the stamp it was made from. Quarters whose stamp is unchanged aren't read;
    their part stays. A quarter is published whole, so a run that fails leaves older parts as they were.
    """
    stamps = quarter_stamps(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    known = {}
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        known = {(r.year, r.quarter): r.stamp for r in spark.read.parquet(folder).select(*LAYOUT, "stamp").distinct().collect()}  # one row a quarter
    todo = sorted(k for k, v in stamps.items() if known.get(k) != v)
    if todo:
        wanted = F.lit(False)
        for y, q in todo:
            wanted = wanted | ((F.col("year") == y) & (F.col("quarter") == q))
        lake = spark.read.parquet(root).where(wanted)
        rows = [c for c in lake.columns if c not in LAYOUT]
        digest = F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in rows]).cast("decimal(38,0)"))
        files = lake.groupBy(*LAYOUT, F.col("_metadata.file_name").alias("file"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"), digest.alias("digest"))
        listed = spark.createDataFrame([(y, q, stamps[y, q]) for y, q in todo], "year int, quarter int, stamp string")
        out = files.join(F.broadcast(listed), LAYOUT).hint("rebalance", *LAYOUT)  # one row a quarter
        out.write.partitionBy(*LAYOUT).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)
    return spark.read.parquet(folder), todo


def quarter_counts(manifest: DataFrame) -> DataFrame:
    """Rows by quarter and kind, and of each kind in all."""
    g = manifest.groupingSets([["year", "quarter", "kind"], ["kind"]], "year", "quarter", "kind").agg(F.sum("n").alias("n"))
    name = F.when(F.col("year").isNotNull(), F.concat(F.col("year"), F.lit("Q"), F.col("quarter"))).otherwise("total")
    return g.select(name.alias("quarter"), "kind", "n")
