"""Resumable translation as a stream of files: data is written before state, and a batch that is repeated changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from diglot.operators import jobs


def latest_state(spark: SparkSession, folder: str) -> DataFrame:
    """book, dest, attempts, done: the state after the last batch, from a log of batches."""
    log = spark.read.schema("book string, dest string, attempts int, done boolean, batch long").option("recursiveFileLookup", "true").parquet(folder)
    last = log.groupBy("book", "dest").agg(F.max_by(F.struct("attempts", "done"), "batch").alias("s"))
    return last.select("book", "dest", "s.attempts", "s.done")


def resume(spark: SparkSession, arrivals: str, schema: str, work: Callable[[DataFrame], DataFrame], data: str, state: str, checkpoint: str) -> StreamingQuery:
    """Works on the files that arrive as Parquet rows (book, dest, ...), batch by batch, once for each file that isn't done.

    work: rows -> rows with `landed` (whether Chinese came) and what it made. A batch writes its data under
    its number, then its state; a batch repeated after a crash overwrites both. Files end after three futile tries.
    """
    spark.createDataFrame([], "book string, dest string, attempts int, done boolean, batch long").write.mode("append").parquet(state)

    def one(batch: DataFrame, number: int) -> None:
        before = spark.read.schema("book string, dest string, attempts int, done boolean, batch long").option("recursiveFileLookup", "true").parquet(state).where(F.col("batch") < number)
        known = before.groupBy("book", "dest").agg(F.max_by(F.struct("attempts", "done"), "batch").alias("s")).select("book", "dest", "s.attempts", "s.done")
        todo = batch.join(known.where("done"), ["book", "dest"], "left_anti")
        work(todo).write.mode("overwrite").parquet(f"{data}/part={number}")
        made = spark.read.parquet(f"{data}/part={number}")
        results = made.groupBy("book", "dest").agg(F.max("landed").alias("landed"))
        touched = results.join(known, ["book", "dest"], "left").select("book", "dest", "attempts", "done")
        jobs.attempts(touched, results).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{state}/batch-{number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(arrivals)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
