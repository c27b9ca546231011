"""The scanner on streams: row-local, so any streaming frame goes through Engine.scan() as it is; dashboards add a
watermark and a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.moderation import Engine
from ..sources import shared


def hits_by_window(stream: DataFrame, engine: Engine, text: Column, at: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Rows, flagged rows and detections by window and event type; rows later than `late` are left out."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withColumn("_text", text)
    scanned = engine.scan(timed, "_text", "_found").withWatermark(at, late)
    counts = scanned.groupBy(F.window(at, width), "event_type").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("_found") > 0).alias("flagged"), F.sum(F.size("_found")).alias("hits"))
    return counts.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "rows", "flagged", "hits")


def batch_as_stream(spark: SparkSession, path: str, engine: Engine | None = None) -> DataFrame:
    """hits_by_window over a table read as a stream until all that is there has been seen; a row's text is its
    event type, with one type made a term so that there is something to find. Each batch writes the whole result to the
    shared folder, where the stream keeps its state as well."""
    out = shared(spark, "stream-hits")
    schema = spark.read.parquet(path).schema
    folder, _, file = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)
    found = hits_by_window(stream, engine or Engine(), F.replace("event_type", F.lit("click"), F.lit("you idiot")), late="3650 days")
    spark.createDataFrame([], found.schema).write.parquet(f"{out}/0")  # if no batch comes
    last = [0]

    def keep(batch: DataFrame, number: int) -> None:
        last[0] = number + 1
        batch.write.mode("overwrite").parquet(f"{out}/{last[0]}")

    query = found.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}-state").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/{last[0]}")
