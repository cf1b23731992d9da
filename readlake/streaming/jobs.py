"""Structured Streaming jobs over the request log and the AI usage events.

Counters are written as one folder per micro-batch, overwritten when a batch is run again, so a restart after a
lost executor or driver never counts twice; readers add the folders up, `compact` folds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from readlake.operators import telemetry as T
from readlake.schemas import LAKE
from readlake.session import shared_path

FLUSH = "60 seconds"


def request_log(spark: SparkSession, path: str) -> DataFrame:
    """The access log: one JSON object per line, schema declared, bad lines dropped."""
    return spark.readStream.schema(LAKE["request_log"]).option("mode", "DROPMALFORMED").json(path)


def table_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def start(writer, every: str | None = None) -> StreamingQuery:
    """Run on a clock (the product's flush), or over what is there and stop."""
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def count_traffic(log: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """(day, area) counters of the access log, added up per micro-batch."""
    counted = T.request_counts(log)

    def write(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy("day", "area").agg(*(F.sum(c).alias(c) for c in ("requests", "errors", "ai_calls")))
        sums.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return start(counted.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), every)


def read_counters(spark: SparkSession, path: str, since: Column | None = None) -> DataFrame:
    """The counters so far, old days left out when asked."""
    rows = spark.read.schema(LAKE["traffic_daily"] + ", batch BIGINT").option("basePath", path).parquet(f"{path}/batch=*")
    rows = rows.filter(F.col("day") >= since) if since is not None else rows
    return rows.groupBy("day", "area").agg(*(F.sum(c).alias(c) for c in ("requests", "errors", "ai_calls")))


def compact(spark: SparkSession, path: str, target: str, since: Column | None = None) -> None:
    """The counters folded into a snapshot; days past retention stay behind."""
    from readlake.sources.export import write_snapshot

    write_snapshot(read_counters(spark, path, since), target)


def active_people(log: DataFrame, path: str, checkpoint: str, every: str | None = None, late: str = "1 day") -> StreamingQuery:
    """Each person once per day. The state holds only pairs within the watermark."""
    pairs = (
        log.filter("user_id IS NOT NULL")
        .withWatermark("ts", late)
        .withColumn("day", F.to_date(F.col("ts") + F.expr("INTERVAL 7 HOURS")))
        .dropDuplicatesWithinWatermark(["day", "user_id"])
        .select("day", F.col("user_id").cast("string").alias("user_id"))
    )
    return start(pairs.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint), every)


def priced(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Each call with the price in force when it was made (prices: model, valid_from, valid_to, input, cached,
    output), so a later price leaves the past alone. The price list is the small, static side."""
    p = prices.withColumnRenamed("model", "_model")
    match = (
        (F.col("model") == F.col("_model"))
        & (F.col("created_at") >= F.col("valid_from"))
        & (F.col("valid_to").isNull() | (F.col("created_at") < F.col("valid_to")))
    )
    hit = F.least("cached_tokens", "prompt_tokens")
    cost = ((F.col("prompt_tokens") - hit) * F.col("input") + hit * F.col("cached") + F.col("completion_tokens") * F.col("output")) / 1_000_000
    return events.join(p, match, "left").withColumn("cost_usd", cost).drop("_model", "valid_from", "valid_to", "input", "cached", "output")


def request_sessions(calls: DataFrame, gap: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """The calls of one request together: a request ends when it has been quiet for `gap`."""
    return (
        calls.withWatermark("created_at", late)
        .groupBy(F.session_window("created_at", gap).alias("w"), "request_id")
        .agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"))
        .select("request_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "calls", "prompt_tokens")
    )


def windows(events: DataFrame, width: str, slide: str | None = None, key: str = "event_type", late: str = "1 day") -> DataFrame:
    """Tumbling or sliding counts per key."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        events.withWatermark("ts", late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
    )


def visits(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Reading visits: a person's events with no longer pause than `gap`."""
    return (
        events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"))
        .select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
    )


def counted_late(events: DataFrame, path: str, checkpoint: str, late: str = "1 day", every: str | None = None) -> StreamingQuery:
    """Each micro-batch's rows in time and rows too late: older by more than `late` than the newest event of all batches before.

    A batch leaves its counts and the newest event so far in a folder of its own, and its late rows in another. It looks only at
    folders of earlier batches, so one that is run again writes what it wrote before."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = None
        if batch_id > 0:
            held = spark.read.schema(LATE).option("basePath", f"{path}/counts").parquet(f"{path}/counts/batch=*").filter(F.col("batch") < batch_id)
            before = held.agg(F.max("newest")).first()[0]
        mark = F.lit(before).cast("timestamp") if before is not None else F.lit(None).cast("timestamp")
        is_late = F.coalesce(F.col("ts") < mark - F.expr(f"INTERVAL {late}"), F.lit(False))
        counts = batch.agg(F.count_if(~is_late).alias("kept"), F.count_if(is_late).alias("late"), F.greatest(F.max("ts"), mark).alias("newest"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/counts/batch={batch_id}")
        batch.filter(is_late).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")

    return start(events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), every)


LATE = "kept BIGINT, late BIGINT, newest TIMESTAMP, batch BIGINT"


def late_counts(spark: SparkSession, path: str) -> DataFrame:
    """(batch, kept, late, newest) so far."""
    return spark.read.schema(LATE).option("basePath", f"{path}/counts").parquet(f"{path}/counts/batch=*").select("batch", "kept", "late", "newest")


def table_of(result: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """A streaming result run over what is there, as a table in the shared folder."""
    spark = result.sparkSession
    path, checkpoint = shared_path(spark, name), shared_path(spark, f"{name}-checkpoint")
    writer = result.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    start(writer).awaitTermination()
    return spark.read.schema(result.schema).parquet(path)


def table_of_updates(result: DataFrame, keys: list[str], grows: str) -> DataFrame:
    """A windowed result in update mode, each micro-batch a folder of its own; the newest state of a window is
    the one that has counted most. Windows are complete without waiting for the watermark to pass them."""
    spark = result.sparkSession
    path, checkpoint = shared_path(spark, "updates"), shared_path(spark, "updates-checkpoint")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    start(result.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)).awaitTermination()
    rows = spark.read.schema(result.schema).parquet(f"{path}/batch=*")
    rest = [c for c in result.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), grows).alias("r")).select(*keys, "r.*")
