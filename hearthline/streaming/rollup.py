"""Daily rollups of the task log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def _measures(new_items: Column, ok: Column, seconds: Column) -> list[Column]:
    return [
        F.count("*").alias("n_tasks"),
        F.sum(F.coalesce(new_items, F.lit(0))).alias("total_new"),
        F.min(F.coalesce(ok, F.lit(False)).cast("int")).alias("all_ok"),
        F.sum(seconds).alias("total_seconds"),
    ]


def _merged() -> list[Column]:
    return [F.sum("n_tasks").alias("n_tasks"), F.sum("total_new").alias("total_new"),
            F.min("all_ok").alias("all_ok"), F.sum("total_seconds").alias("total_seconds")]


def daily_rollup(log: DataFrame, ts: Column, new_items: Column, ok: Column, seconds: Column) -> DataFrame:
    """Per day: tasks, new items, whether all succeeded, total duration."""
    return log.groupBy(ts.cast("date").alias("day")).agg(*_measures(new_items, ok, seconds))


def rollup_stream(stream: DataFrame, ts: Column, new_items: Column, ok: Column, seconds: Column,
                  target: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's partial rollup; read_rollup merges them.

    Partials keep no state between batches, count late rows in full, and a replayed batch
    overwrites its own partition.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        (daily_rollup(batch, ts, new_items, ok, seconds).withColumn("batch_id", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(target))

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_rollup(spark: SparkSession, target: str) -> DataFrame:
    """Current daily totals over all partial rollups."""
    return spark.read.parquet(target).groupBy("day").agg(*_merged())


def windowed_rollup(stream: DataFrame, ts: str, new_items: Column, ok: Column, seconds: Column, delay: str = "1 day") -> DataFrame:
    """Stateful form: one row per UTC day, whose state goes once the watermark has passed it; later rows are dropped."""
    days = stream.withWatermark(ts, delay).groupBy(F.window(ts, "1 day")).agg(*_measures(new_items, ok, seconds))
    day = F.date_from_unix_date(F.floor(F.unix_seconds("window.start") / 86_400).cast("int"))
    return days.select(day.alias("day"), "n_tasks", "total_new", "all_ok", "total_seconds")


def windowed_rollup_stream(stream: DataFrame, ts: str, new_items: Column, ok: Column, seconds: Column, target: str, checkpoint: str,
                           delay: str = "1 day") -> StreamingQuery:
    """Keep ``target`` at the current total of every day, open days included: each micro-batch overwrites the days that it changed.

    A replayed batch writes the same totals again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(target)

    days = windowed_rollup(stream, ts, new_items, ok, seconds, delay)
    return days.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pages_before_gap(df: DataFrame, group: str, page: str, found: str) -> DataFrame:
    """Pages of each group before its first empty page after page 1."""
    stop = F.min(F.when((F.col(found) == 0) & (F.col(page) > 1), F.col(page))).alias("__stop")
    stops = df.groupBy(group).agg(stop)
    return df.join(stops, group).where(F.col("__stop").isNull() | (F.col(page) < F.col("__stop"))).drop("__stop")


def crawl_counters(df: DataFrame, group: str, found: Column, new: Column) -> DataFrame:
    """Pages, found and new items per group."""
    return df.groupBy(group).agg(F.count("*").alias("n_pages"), F.sum(found).alias("n_found"), F.sum(new).alias("n_new"))


def growth(before: Column, after: Column) -> Column:
    """Items gained since the previous run, never negative."""
    return F.greatest(F.lit(0), after - before)
