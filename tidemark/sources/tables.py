"""Tables that are made once and read again: lineage ends at them, and plans over them stay small."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: dict[tuple, tuple[str, object]] = {}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
MAX_BROADCAST_ROWS = 200_000
"""Narrow tables up to this many rows (counted first) are broadcast; larger ones are shuffled."""
PARTS = 4
"""Jobs that a table of as many rows as the input is made by: the shuffle files of one are gone before the next begins."""


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir. Where that is unset, a temporary one
    will do for a local session, as in tests; on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_dir(spark)}/{name}/{uuid.uuid4().hex}"


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it is done; else they stay until the driver collects garbage."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def save(df: DataFrame, path: str, mode: str = "errorifexists", by: list[str] | None = None) -> None:
    """Write ``df`` as Parquet, leaving no shuffle files."""
    with cleaning(df.sparkSession):
        df.write.mode(mode).parquet(path, partitionBy=by)


def save_all(made: DataFrame | Iterable[DataFrame], path: str):
    """Write a table, or its parts one after another; returns the schema."""
    for df in [made] if isinstance(made, DataFrame) else made:
        save(df, path, "append")
    return df.schema


def written(made: DataFrame | Iterable[DataFrame]) -> DataFrame:
    """The rows of a table, or of its parts one after another, written as Parquet in the shared folder and read again."""
    parts = iter([made] if isinstance(made, DataFrame) else made)
    first = next(parts)
    path = scratch(first.sparkSession, "tables")
    schema = save_all(itertools.chain([first], parts), path)
    return first.sparkSession.read.schema(schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        under = f"{shared_dir(spark)}/tables/".split(":", 1)[-1].lstrip("/")
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if under in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def part_of(k: int, *keys: str) -> Column:
    """Whether a row is in part ``k`` of PARTS by its keys, of which equal ones meet in one part."""
    return F.pmod(F.xxhash64(*keys), F.lit(PARTS)) == k


def few(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if a count finds it small enough."""
    with cleaning(df.sparkSession):
        return F.broadcast(df) if df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else df


def _stamp(spark: SparkSession, folder: str) -> tuple:
    """What changes when a table under ``folder`` does: names, times and the total length."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = sorted((s.getPath().toString(), s.getModificationTime()) for s in fs.listStatus(path))
    return tuple(listed), fs.getContentSummary(path).getLength()


def stored(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame | Iterable[DataFrame]]) -> DataFrame:
    """The table ``name`` made from the tables of ``folder``, whole or in parts: written once a session, made again when these change."""
    key = (spark.sparkContext.applicationId, shared_dir(spark), folder, name, _stamp(spark, folder))
    if key in _MADE:
        path, schema = _MADE[key]
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return spark.read.schema(schema).parquet(path)
    path = scratch(spark, f"tables/{name}")
    schema = save_all(make(), path)
    _MADE[key] = (path, schema)
    return spark.read.schema(schema).parquet(path)
