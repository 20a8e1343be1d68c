"""Structured Streaming: replies that arrive as files, running score counts, windowed events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankfold.functions.parsing import response_text, single_score

FACT = "query_idx long, doc_id string, llm_score double, dist_to_gt double, is_gt int, rag_failed int"


def score_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The dashboard's histogram over a folder of fact files; run it in complete mode."""
    rows = spark.readStream.schema(FACT).parquet(folder)
    return rows.filter("llm_score is not null").groupBy("llm_score").agg(F.count("*").alias("n"))


def replies(spark: SparkSession, folder: str) -> DataFrame:
    """(custom_id, score) of reply lines as they arrive, repeated ones too."""
    lines = spark.readStream.schema("value string").text(folder)
    parsed = lines.select(F.get_json_object("value", "$.custom_id").alias("custom_id"), single_score(response_text(F.col("value"))).alias("score"))
    return parsed.filter("custom_id is not null")


def merge_replies(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append each arrival's replies under its batch number, each custom_id once; of several in one arrival the largest score.

    What earlier batches stored is the only memory, so the query holds no state that grows; a batch that is run
    again overwrites itself.
    """

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path
        files = path(out).getFileSystem(session._jsc.hadoopConfiguration())
        new = batch.groupBy("custom_id").agg(F.max("score").alias("score"))
        if files.exists(path(out)):
            stored = session.read.schema("custom_id string, score double, batch long").parquet(out).filter(F.col("batch") < number)
            new = new.join(stored, "custom_id", "left_anti")
        new.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return replies(spark, folder).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_events(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event type in tumbling windows, late rows up to ``late``."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
