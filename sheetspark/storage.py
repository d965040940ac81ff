"""Intermediate tables in the shared folder that the session names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task makes of those it is dealt by :func:`spread`.
ROWS = 250_000

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset and everything
    runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="sheetspark-shared-")
    return _own["dir"]


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: later stages neither recompute it nor
    depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def spread(df: DataFrame, becomes: Column, per: int = ROWS) -> DataFrame:
    """Deals rows that are about to be exploded, each into ``becomes`` rows, to as many tasks as those rows need. A small
    file is read by one task, which would make all of them."""
    total = df.agg(F.sum(becomes)).first()[0] or 0
    n = int(-(-total // per))
    return df.repartition(n) if n > 1 else df


def discard(df: DataFrame | None) -> None:
    """Deletes what :func:`keep` wrote, once nothing reads it any more."""
    path = getattr(df, "_kept_path", None)
    if path is None:
        return
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
