"""Shared-folder tables and size-checked joins, used by every operator here.

Intermediate results are written as Parquet below ``spark.checkpoint.dir``, which the driver and all
executors share, so a lost executor costs a re-read and never a recomputation of lost blocks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a build side that may be broadcast: with two or three numbers a row it takes some 100 bytes a row, so about 100 MB.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is named (tests, one machine)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that is no longer needed."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def stored(df: DataFrame, name: str, replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives executor loss.

    ``replaces``: a frame that came from here, whose files are deleted now that ``df`` is written.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if replaces is not None:
        drop_path(df.sparkSession, replaces._stored_at)
    return out


def join_checked(big: DataFrame, small: DataFrame, on: str | list[str] | Column, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with ``small`` broadcast if it has at most ``rows`` rows, else leave the strategy (and skew) to Spark."""
    return big.join(F.broadcast(small) if small.limit(rows + 1).count() <= rows else small, on, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Just the named columns, so that extra columns of any name can't clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
