"""Session settings of the corpus operators, beside the shared folder for intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, keep, shared_dir

__all__ = ["discard", "folded", "fresh", "keep", "partitions", "quoted", "shared_dir", "small_batches", "unfolded"]

#: Bytes of rows handed to Python at a time; keeps a worker's memory flat whatever the length of the texts.
ARROW_BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores behind it as it takes to differ from all names taken, in any case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def quoted(columns: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in columns]


def folded(docs: DataFrame, *own: str) -> DataFrame:
    """(_row, ``own`` columns): all others as one column, so that none of their names can clash."""
    rest = [c for c in docs.columns if c not in own]
    return docs.select(F.struct(*(quoted(rest) or [F.lit(0).alias("none")])).alias("_row"), *own)


def unfolded(columns: list[str], **own: Column) -> list[Column]:
    """``columns`` of a folded table; ``own`` says where those that were not folded come from."""
    return [(own[c] if c in own else F.col("_row").getField(c)).alias(c) for c in columns]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
