"""What the operators of this subpackage share: reading tables, cutting lineage, linking rows."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000
"""Sides of narrow integer columns up to this many rows (counted first) are broadcast; larger ones are shuffled."""
BATCH_ROWS = 500
BATCH_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile  # one process holds driver and executors, as in tests

        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as Parquet in the shared folder and read them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        under = f"{shared_dir(spark)}/tables/".split(":", 1)[-1].lstrip("/")
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if under in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches of at most BATCH_ROWS rows and about BATCH_BYTES of text (one text at least)."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH_BYTES, "right"))
            n = max(1, min(BATCH_ROWS, upto - at))
            yield batch.slice(at, n)
            at += n


def give_back() -> None:
    """Return freed memory to the machine at the end of a task: Python workers live on and wait for the next one."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark a narrow side for broadcast if it is proven to be small, else leave the choice to Spark."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= MAX_BROADCAST_ROWS else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``edges``: one row (node, comp) per node, comp the smallest node reachable.

    Alternates large-star and small-star steps (each a groupBy with a map-side minimum and a join)
    until the edge set is a star around each minimum. No step holds a component in one task: a node
    with many neighbours only passes its minimum on to them. Nulls and self-loops take no part.
    """
    links = written(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    before = None
    while True:
        # large star: every neighbour larger than a node is linked to the node's smallest neighbour
        both = links.union(links.select("v", "u")).toDF("n", "x")
        lowest = both.groupBy("n").agg(F.min("x").alias("lo")).withColumn("lo", F.least("n", "lo"))
        large = both.join(lowest, "n").where("x > n").select(F.col("x").alias("u"), F.col("lo").alias("v")).distinct()
        # small star: every smaller neighbour of a node, and the node, are linked to the smallest
        lowest = large.groupBy("u").agg(F.min("v").alias("lo"))
        joined = large.join(lowest, "u")
        small_star = (
            joined.where("v <> lo").select(F.col("v").alias("u"), F.col("lo").alias("v"))
            .union(lowest.select("u", F.col("lo").alias("v")))
            .distinct()
        )
        done, links = links, written(small_star)
        discard(done)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    )
