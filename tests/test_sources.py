"""Readers, writers and the model store."""

import json

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from hearthline.plans.prepare import combine
from hearthline.sources import listings, models, sinks


def _write(path, text):
    path.write_text(text, encoding="utf-8")


def test_every_layout_is_read_whole(spark, tmp_path):
    _write(tmp_path / "array.json", json.dumps([{"url": "a1", "price": 5, "description": ["x", "y"]}, {"url": "a2", "price": "nan"}], indent=2))
    _write(tmp_path / "lines.json", '{"url": "l1", "price": "7"}\n\n{"url": "l2", "furnished": true}\n')
    _write(tmp_path / "single.json", json.dumps({"url": "s1", "description": "plain"}, indent=2))
    _write(tmp_path / "wrapped.json", json.dumps({"items": [{"url": "w1"}, {"url": "w2"}]}))
    _write(tmp_path / "combined_data.json", '{"url": "no"}\n')
    raw = listings.read_listings(spark, str(tmp_path))
    good, bad = listings.split_corrupt(raw)
    assert sorted(r.url for r in good.collect()) == ["a1", "a2", "l1", "l2", "s1", "w1", "w2"] and bad.count() == 0
    rows = {r.url: r for r in good.collect()}
    assert rows["a1"].price == "5" and rows["a1"].data_source == "array" and rows["l2"].furnished == "true"
    combined = {r.url: r.description for r in combine(good).collect()}
    assert combined["a1"] == "x y" and combined["s1"] == "plain" and len(combined) == 7


def test_corrupt_lines_are_set_aside(spark, tmp_path):
    _write(tmp_path / "l.json", '{"url": "ok"}\n{"url": broken\n{"url": "ok2"}\n')
    good, bad = listings.split_corrupt(listings.read_listings(spark, str(tmp_path)))
    assert good.count() == 2 and [r["_corrupt_record"] for r in bad.collect()] == ['{"url": broken']


def test_combine_keeps_the_first_copy(spark, tmp_path):
    _write(tmp_path / "a.json", '{"url": "1", "description": "Same  Text"}\n{"url": "2"}\n{"url": "3"}\n')
    _write(tmp_path / "b.json", '{"url": "4", "description": "same text"}\n{"url": "5", "description": ""}\n')
    good, _ = listings.split_corrupt(listings.read_listings(spark, str(tmp_path)))
    assert sorted(r.url for r in combine(good).collect()) == ["1", "2", "3", "5"]


def test_publish_snapshot_and_twins(spark, tmp_path):
    df = spark.createDataFrame([("u1", 1), ("u2", 2)], "url string, n int")
    sinks.publish(df, f"{tmp_path}/p", "20240101")
    sinks.publish(df.where("n = 1"), f"{tmp_path}/p", "20240102")
    assert sinks.read_published(spark, f"{tmp_path}/p").count() == 1
    for _ in range(2):
        sinks.snapshot(df, f"{tmp_path}/s", "20240101")
    sinks.snapshot(df, f"{tmp_path}/s", "20240102")
    assert spark.read.parquet(f"{tmp_path}/s").groupBy("snapshot_ts").count().orderBy("snapshot_ts").collect()[0]["count"] == 2
    sinks.write_twins(df, "url", f"{tmp_path}/t")
    assert spark.read.text(f"{tmp_path}/t/urls").count() == 2 and spark.read.json(f"{tmp_path}/t/records").count() == 2
    sinks.append_records(df, f"{tmp_path}/log")
    sinks.append_records(df, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 4
    sinks.before_image(df, ["n", "none"], "url", 1, f"{tmp_path}/b")
    assert spark.read.json(f"{tmp_path}/b").collect()[0].n == 1
    sinks.save_model_table(df, ["n"], "n", f"{tmp_path}/m")
    table, meta = listings.read_model_table(spark, f"{tmp_path}/m")
    assert table.count() == 2 and meta.first().features == ["n"]


def test_model_store(spark, tmp_path):
    df = spark.range(50).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression(labelCol="y")]).fit(df)
    root = f"{tmp_path}/store"
    for version, r2 in (("20240101", 0.5), ("20240102", 0.9)):
        models.save_models(spark, {"linear": model}, root, version, ["x"], {"linear": (r2, 1.0)}, 40, 10)
    loaded, meta = models.load_latest(spark, root)
    assert meta["version"] == "20240102" and abs(loaded["linear"].transform(df).where("x = 3").first().prediction - 6) < 1e-6
    assert models.metrics_table(models.model_metadata(spark, root)).count() == 2
