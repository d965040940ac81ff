"""Incremental job: an index of the names in text deliveries, kept up to date as files arrive.

Netlists, name tables, port lists and notes come as rows of (id, text, group). The job lists, for each group, every name
(a token of a line that is no comment) with how often it occurs, in how many texts, and in which text and line first, so
that a net or an instance of the layout can be found in what was delivered.

The input folder is a file stream with a checkpoint: a run takes the files that no run before has taken, in batches of a
bounded number of files, and ends when there are none left. A batch is written to its own partitions, ``batch=N/bucket=M``,
which replace themselves: a batch that is run again after a failure leaves the same result. ``read`` sums up the batches.

Defined cases: a null or empty text has no names; a null group stays null; a row without an id counts, but names a first
text only where no other row does; repeated rows are deliveries of their own; an empty folder gives an empty index; other
columns are ignored.

    python -m jobs.text_names INPUT OUTPUT CHECKPOINT [--config FILE]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetspark import log
from sheetspark.sources.text import names_of

from .common import config

SCHEMA = "`group` string, name string, n long, n_texts long, first struct<lacks_id:int,id:long,line:long>, batch long, bucket int"


def index(texts: DataFrame) -> DataFrame:
    """Counts of the names in ``texts(id, text, group)``."""
    told = texts.select("group", "id", names_of(F.col("text")).alias("names"))
    # a text is one row, so what is once a text is told apart there: a row for each occurrence and one for each name of the text
    once = F.transform(F.array_distinct("names.name"), lambda x: F.struct(x.alias("name"), F.lit(None).cast("long").alias("line")))
    names = told.select("group", "id", F.explode(F.concat("names", once)).alias("x")).select("group", "id", "x.name", "x.line")
    # where a name is first, as one number: a fixed-length minimum is kept in the hash table of the counts, a struct's would sort all rows
    lines, last = F.expr("10000000000BD"), F.expr("100000000000000000000000000000BD")  # more than a text has lines; beyond all ids by lines
    place = F.coalesce(F.col("id").cast("decimal(20,0)") * lines, last) + F.col("line").cast("decimal(11,0)")
    found = names.groupBy("group", "name").agg(F.count("line").alias("n"), F.count(F.when(F.col("line").isNull(), 1)).alias("n_texts"), F.min(place).alias("place"))
    text, lacks = F.floor(F.col("place") / lines), F.col("place") >= last
    first = F.struct(lacks.cast("int").alias("lacks_id"), F.when(~lacks, text.cast("long")).alias("id"), (F.col("place") - text * lines).cast("long").alias("line"))
    return found.select("group", "name", "n", "n_texts", first.alias("first"))


def run(spark: SparkSession, source: str, output: str, checkpoint: str, settings: dict) -> int:
    """Takes what is new in ``source`` into ``output``; the number of batches."""
    kinds = {settings["id"]: "long", settings["text"]: "string", settings["group"]: "string"}
    schema = ", ".join(f"`{c}` {kind}" for c, kind in kinds.items())
    # a stream takes a single file only by a pattern; one that matches a folder takes what is in it
    pattern = source if set(source) & set("*?[{") else f"{source.rstrip('/')[:-1]}[{source.rstrip('/')[-1]}]"
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", int(settings["files_per_batch"])).parquet(pattern)
    texts = new.select(*[F.col(f"`{settings[c]}`").alias(c) for c in ("id", "text", "group")])
    done = []
    # the folder is there even before the first batch
    spark.createDataFrame([], SCHEMA).write.mode("append").partitionBy("batch", "bucket").parquet(output)

    def take(batch: DataFrame, number: int) -> None:
        out = index(batch).withColumns({"batch": F.lit(number).cast("long"), "bucket": F.pmod(F.xxhash64("name"), F.lit(int(settings["buckets"]))).cast("int")})
        # folders get whole files, large ones several, as the rebalance splits them by size
        out.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(output)
        done.append(number)
        with log.section("text names"):  # the stream calls from a thread of its own
            log.LOG.info("batch %d: wrote %d names to %s", number, _parts(spark, output).where(F.col("batch") == number).count(), output)

    with log.section("text names"):
        query = texts.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        for p in query.recentProgress:  # the last hundred batches
            if p["batchId"] in done:
                log.LOG.info("batch %d: read %d texts from %s", p["batchId"], p["numInputRows"], source)
        log.LOG.info("%d new batches", len(done))
    return len(done)


def _parts(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(output)


def read(spark: SparkSession, output: str) -> DataFrame:
    """(group, name, n, n_texts, first_id, first_line) over all batches."""
    whole = _parts(spark, output).groupBy("group", "name").agg(F.sum("n").alias("n"), F.sum("n_texts").alias("n_texts"), F.min("first").alias("first"))
    return whole.select("group", "name", "n", "n_texts", F.col("first.id").alias("first_id"), F.col("first.line").alias("first_line"))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="jobs.text_names", description="Index of the names in text deliveries.")
    p.add_argument("input", help="folder of Parquet files with texts, a pattern or a file")
    p.add_argument("output", help="folder of the index")
    p.add_argument("checkpoint", help="folder of the stream's checkpoint")
    p.add_argument("--config", help="settings that differ from jobs/text_names.yaml")
    p.add_argument("--log", default="info", choices=["off", "error", "warning", "info", "debug"])
    given = p.parse_args(argv)
    log.configure(given.log)
    settings = config(given.config, __file__)
    spark = SparkSession.builder.appName("text names").getOrCreate()
    try:
        run(spark, given.input, given.output, given.checkpoint, settings)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
