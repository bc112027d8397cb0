"""Incremental ingest of listings that were not seen before."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from hearthline.functions.urls import normalize_strict

# Worker classes travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = "url_key"
FOREVER = 2**63 - 1
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstSeen(StatefulProcessor):
    """Lets the first row of a key through and remembers the key, for good or until it hasn't been shown for ``keep_ms``.

    One value per key: the time until which it counts as known, by the time of the batch, which a replay repeats; so rows that arrive
    late are never left out. No timers: a query that runs until all input is read would never end with them. A key that ran out
    keeps its value until it is shown again.
    """

    def __init__(self, fields: list[str], keep_ms: int | None):
        self.fields, self.keep_ms = fields, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.until = handle.getValueState("until", T.StructType([T.StructField("until", T.LongType())]))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.until.update((initialState["until"],))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known, now, first, first_at = None, 0, None, None
        for row in rows:
            if known is None:
                now = row["__now"]
                known = self.until.exists() and now < self.until.get()[0]
            at = row["__none"], row["__by"], row["__content"]
            if not known and (first is None or at < first_at):
                first, first_at = row, at
        if self.keep_ms is not None:
            self.until.update((now + self.keep_ms,))
        elif not known:
            self.until.update((FOREVER,))
        if first is not None:
            yield Row(**{f: first[f] for f in self.fields})

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession, provider: str = ROCKSDB):
    """Queries that start inside keep their state in this store; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def new_rows(stream: DataFrame, url: str, order: str, normalize=normalize_strict, keep: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """The rows of a stream whose normalised URL (``url_key``) is new, and those without a URL (``url_key`` null).

    Of several rows of a key in one batch the first by ``order`` stays (rows without order last, equal ones by their content). ``keep``, a
    time such as '180 days', forgets keys that no batch has shown for so long; ``known`` (url_key) are keys saved before the
    first batch.
    """
    keep_ms = None if keep is None else int(pd.Timedelta(keep).total_seconds() * 1000)
    cols = stream.columns
    named = F.col(url).isNotNull() & (F.trim(F.col(url)) != "")
    keyed = stream.withColumn(KEY, F.when(named, normalize(F.col(url))))
    # The time of the batch, which is kept with it for a replay.
    now = F.unix_millis(F.current_timestamp())
    place = {"__now": now, "__none": F.col(order).isNull(), "__by": F.col(order), "__content": F.xxhash64(*cols)}
    schema = T.StructType([*keyed.schema])
    until = F.lit(FOREVER) if keep_ms is None else now + keep_ms
    start = known.select(KEY).distinct().withColumn("until", until).groupBy(KEY) if known is not None else None
    fresh = keyed.where(F.col(KEY).isNotNull()).withColumns(place).groupBy(KEY).transformWithState(
        FirstSeen([*cols, KEY], keep_ms), schema, "Append", "None", start)
    return fresh.unionByName(keyed.where(F.col(KEY).isNull()))


def ingest_new(stream: DataFrame, url: str, order: str, target: str, checkpoint: str, normalize=normalize_strict, keep: str | None = None,
               known: DataFrame | None = None, quarantine: str | None = None) -> StreamingQuery:
    """Append rows with an unseen normalised URL to ``target``; see new_rows.

    What has been seen is keyed state of the query, so no batch reads what is saved. Rows without a URL can't be told apart: they
    go to ``quarantine`` (by default beside the target), where count_quarantined counts them. Each micro-batch overwrites only its own
    ``batch_id`` partition of both, so a replay after a failure gives the same tables.
    """
    quarantine = quarantine or quarantine_of(target)

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.withColumn("batch_id", F.lit(batch_id).cast("long")).persist()
        for rows, path in ((held.where(F.col(KEY).isNotNull()), target), (held.where(F.col(KEY).isNull()).drop(KEY), quarantine)):
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
        held.unpersist()

    with state_store(stream.sparkSession):
        return (new_rows(stream, url, order, normalize, keep, known).writeStream.outputMode("append").foreachBatch(write)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def quarantine_of(target: str) -> str:
    return f"{target.rstrip('/')}-without-url"


def count_quarantined(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """(batch_id, n_rows) of the rows without a URL; ``schema`` is that of the stream."""
    rows = spark.read.schema(f"{schema}, batch_id long").parquet(quarantine_of(target))
    return rows.groupBy("batch_id").agg(F.count("*").alias("n_rows"))


def dedupe_bounded(stream: DataFrame, ts: str, key: Column, delay: str = "1 day") -> DataFrame:
    """Stream with repeats of a key inside the delay dropped; state older than the watermark goes away."""
    return stream.withColumn(KEY, key).withWatermark(ts, delay).dropDuplicatesWithinWatermark([KEY])
