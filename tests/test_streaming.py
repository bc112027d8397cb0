"""Streams must agree with their batch forms and survive a replay."""

import json
import os

from pyspark.sql import functions as F
import pytest

from hearthline.functions.urls import normalize_strict
from hearthline.streaming import ingest, rollup

SCHEMA = "url string, n int"


def _land(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_ingest_only_new_urls_over_runs(spark, tmp_path):
    land, out = tmp_path / "land", str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(SCHEMA).json(str(land))
        ingest.ingest_new(stream, "url", "n", out, str(tmp_path / "cp")).awaitTermination()
        return sorted((r.url, r.n) for r in spark.read.parquet(out).collect())

    _land(land, "1.json", [{"url": "http://A.tn/x/", "n": 2}, {"url": "https://a.tn/x#f", "n": 1}, {"url": "https://a.tn/y", "n": 3}])
    assert run() == [("https://a.tn/x#f", 1), ("https://a.tn/y", 3)]
    _land(land, "2.json", [{"url": "https://a.tn/x?q=1", "n": 4}, {"url": "https://a.tn/z", "n": 5}])
    assert run() == [("https://a.tn/x#f", 1), ("https://a.tn/y", 3), ("https://a.tn/z", 5)]
    assert run() == [("https://a.tn/x#f", 1), ("https://a.tn/y", 3), ("https://a.tn/z", 5)]


def test_ingest_over_micro_batches_replay_and_late_rows(spark, tmp_path):
    """One file a batch; a batch whose commit is lost runs again; the last file is older than all others."""
    land, out, cp = tmp_path / "land", str(tmp_path / "out"), tmp_path / "cp"
    schema = "url string, n int, day date"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(land))
        q = ingest.ingest_new(stream, "url", "n", out, str(cp))
        q.awaitTermination()
        return sorted((r.url, r.n) for r in spark.read.parquet(out).collect())

    for i in range(3):
        _land(land, f"{i}.json", [{"url": f"https://a.tn/{k}", "n": 10 * i + k, "day": f"2024-01-0{i + 1}"} for k in (i, i + 1)] + [{"url": u, "n": i} for u in (None, " ")])
        os.utime(land / f"{i}.json", (1_700_000_000 + i,) * 2)
    want = [("https://a.tn/0", 0), ("https://a.tn/1", 1), ("https://a.tn/2", 12), ("https://a.tn/3", 23)]
    assert run() == want
    batches = {r.batch_id: r.n_rows for r in ingest.count_quarantined(spark, out, schema).collect()}
    assert batches == {0: 2, 1: 2, 2: 2}
    for name in ("2", ".2.crc"):
        (cp / "commits" / name).unlink()
    assert run() == want and ingest.count_quarantined(spark, out, schema).count() == 3
    _land(land, "late.json", [{"url": "https://a.tn/0", "n": 90, "day": "2020-01-01"}, {"url": "https://a.tn/9", "n": 99, "day": "2020-01-01"}])
    assert run() == [*want, ("https://a.tn/9", 99)]


def test_ingest_keeps_the_first_by_order_and_rows_without_order_last(spark, tmp_path):
    _land(tmp_path / "l", "1.json", [{"url": "https://a.tn/x"}, {"url": "http://a.tn/x/", "n": 7}, {"url": "https://a.tn/y"}])
    stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "l"))
    ingest.ingest_new(stream, "url", "n", str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    assert sorted((r.url, r.n) for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [("http://a.tn/x/", 7), ("https://a.tn/y", None)]


@pytest.mark.parametrize("keep,want", [("1 hour", ["x", "y"]), ("1 millisecond", ["x", "x", "y"])])
def test_ingest_forgets_keys_that_are_not_shown(spark, tmp_path, keep, want):
    land, out = tmp_path / "l", str(tmp_path / "o")
    for name, keys in (("1.json", "xy"), ("2.json", "x")):
        _land(land, name, [{"url": f"https://a.tn/{k}", "n": 1} for k in keys])
        stream = spark.readStream.schema(SCHEMA).json(str(land))
        ingest.ingest_new(stream, "url", "n", out, str(tmp_path / "c"), keep=keep).awaitTermination()
    assert sorted(r.url[-1] for r in spark.read.parquet(out).collect()) == want


def test_ingest_starts_from_saved_keys(spark, tmp_path):
    saved = spark.createDataFrame([("https://a.tn/x",), ("https://a.tn/x",)], "url_key string")
    _land(tmp_path / "l", "1.json", [{"url": "http://A.tn/x/", "n": 1}, {"url": "https://a.tn/y", "n": 2}])
    stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "l"))
    ingest.ingest_new(stream, "url", "n", str(tmp_path / "o"), str(tmp_path / "c"), known=saved).awaitTermination()
    assert [r.n for r in spark.read.parquet(str(tmp_path / "o")).collect()] == [2]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != ingest.ROCKSDB


def test_windowed_rollup_holds_open_days(spark, tmp_path):
    """Every day is there after every batch; the sums of a day grow over batches until the watermark has passed it."""
    schema, land = "ts timestamp, new int, ok boolean, sec double", tmp_path / "l"
    for i, rows in enumerate((LOG[:1], LOG[1:3], LOG[3:], [("2024-01-01T12:00:00Z", 50, True, 1.0)])):
        _land(land, f"{i}.json", [dict(zip(("ts", "new", "ok", "sec"), r)) for r in rows])
        stream = spark.readStream.schema(schema).json(str(land))
        rollup.windowed_rollup_stream(stream, "ts", *_args()[1:], str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
        got = {str(r.day): (r.n_tasks, r.total_new) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
        assert got["2024-01-01"] == ((1, 3) if i == 0 else (2, 3))
    assert got == {"2024-01-01": (2, 3), "2024-01-02": (1, 4), "2024-01-20": (1, 1)}


def test_bounded_dedupe_drops_repeats(spark, tmp_path):
    _land(tmp_path / "l", "1.json", [{"ts": "2024-01-01T00:00:00Z", "url": "http://a.tn/x"}, {"ts": "2024-01-01T01:00:00Z", "url": "https://a.tn/x/"}, {"ts": "2024-01-01T02:00:00Z", "url": "https://a.tn/y"}])
    stream = spark.readStream.schema("ts timestamp, url string").json(str(tmp_path / "l"))
    deduped = ingest.dedupe_bounded(stream, "ts", normalize_strict(F.col("url")))
    q = deduped.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2


LOG = [("2024-01-01T10:00:00Z", 3, True, 1.5), ("2024-01-01T11:00:00Z", None, False, 2.0), ("2024-01-02T10:00:00Z", 4, True, 1.0), ("2024-01-20T10:00:00Z", 1, True, 1.0)]


def _args():
    return F.col("ts"), F.col("new"), F.col("ok"), F.col("sec")


def test_rollup_stream_equals_batch_with_late_rows(spark, tmp_path):
    schema = "ts timestamp, new int, ok boolean, sec double"
    rows = [dict(zip(("ts", "new", "ok", "sec"), r)) for r in LOG]
    land, out, cp = tmp_path / "l", str(tmp_path / "o"), str(tmp_path / "c")
    for name, part in (("1.json", rows[1:]), ("2.json", rows[:1])):  # the second file is late
        _land(land, name, part)
        stream = spark.readStream.schema(schema).json(str(land))
        rollup.rollup_stream(stream, *_args(), out, cp).awaitTermination()
    batch = rollup.daily_rollup(spark.read.schema(schema).json(str(land)), *_args())
    cols = batch.columns
    got = sorted(map(tuple, rollup.read_rollup(spark, out).select(*cols).collect()), key=str)
    assert got == sorted(map(tuple, batch.collect()), key=str)
    stream = spark.readStream.schema(schema).json(str(land))
    q = (rollup.windowed_rollup(stream, "ts", *_args()[1:]).writeStream.format("parquet").option("path", str(tmp_path / "w"))
         .option("checkpointLocation", str(tmp_path / "wc")).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    closed = {str(r.day): (r.n_tasks, r.total_new, r.all_ok) for r in spark.read.parquet(str(tmp_path / "w")).collect()}
    assert closed == {"2024-01-01": (2, 3, 0), "2024-01-02": (1, 4, 1)}


def test_pages_before_gap(spark):
    df = spark.createDataFrame([("g", 1, 0), ("g", 2, 3), ("g", 3, 0), ("g", 4, 5), ("h", 1, 2)], "g string, page int, found int")
    got = sorted((r.g, r.page) for r in rollup.pages_before_gap(df, "g", "page", "found").collect())
    assert got == [("g", 1), ("g", 2), ("h", 1)]
