"""Model training and the prediction contract."""

import threading

from pyspark.sql import functions as F
import pytest

from hearthline import constants as K
from hearthline.operators.features import model_columns, serving_features
from hearthline.plans import scoring, training


@pytest.fixture(scope="module")
def linear_rows(spark):
    """log1p(price) is linear in the room count and constant otherwise."""
    df = spark.range(2000).select(
        "id", (F.col("id") % 5 + 1).cast("double").alias("room_count"), (F.col("id") % 7 * 50).cast("double").alias("land_area"))
    return df.withColumn("price", F.expm1(9 + 0.5 * F.col("room_count"))).cache()


def test_split_is_stable_disjoint_and_complete(linear_rows):
    train, test = training.split_rows(linear_rows, "id")
    again, _ = training.split_rows(linear_rows.repartition(13), "id")
    assert train.count() + test.count() == 2000 and train.join(test, "id").count() == 0
    assert 0.15 < test.count() / 2000 < 0.25 and train.select("id").exceptAll(again.select("id")).count() == 0


def test_models_recover_a_linear_target(linear_rows):
    names = ["linear_regression", "decision_tree", "random_forest"]
    models, prep, table = training.train_compare(linear_rows, "id", ["room_count", "land_area"], names)
    r2 = {r.model: r.r2 for r in table.collect()}
    assert set(r2) == set(names) and all(v > 0.97 for v in r2.values()) and r2["linear_regression"] > 0.99
    assert prep.bounds.keys() == {"price", "land_area"} and "room_area" in prep.features


def test_preparation_is_fitted_on_training_rows_only(spark, linear_rows):
    prep = training.Preparation.fit(linear_rows, ["room_count", "land_area"])
    other = spark.createDataFrame([(1, None, 1e9, 5e7), (2, 2.0, 1.0, 500.0)], "id long, room_count double, land_area double, price double")
    row = prep.apply(other).collect()
    assert len(row) == 1 and row[0].room_count == 3.0 and row[0].land_area == prep.bounds["land_area"][1]


def test_grid_and_importance(spark, linear_rows):
    prep = training.Preparation.fit(linear_rows, ["room_count", "land_area"])
    rows = prep.apply(linear_rows).cache()
    fitted = training.grid_search(rows, "random_forest", prep.features, "id", folds=2, values={"numTrees": [3, 5], "maxDepth": [2, 4]})
    grid = training.grid_results(spark, fitted, "random_forest").collect()
    assert len(grid) == 4 and all(r.std_metric >= 0 for r in grid)
    model = training.pipeline(training.estimators()["decision_tree"], prep.features).fit(rows)
    top = training.importances(spark, model, prep.features).orderBy(F.desc("importance")).first()
    assert top.feature in ("room_count", "room_area") and training.eliminate_features(rows, prep.features, 1, "decision_tree")


def test_comparison_with_folds_and_all_members(spark, linear_rows):
    names = ["linear_regression", "lasso", "random_forest", "xgboost"]
    models, prep, table = training.train_compare(linear_rows, "id", ["room_count", "land_area"], names, folds=2)
    rows = {r.model: r for r in table.collect()}
    assert set(rows) == {*names, "ensemble"} and rows["ensemble"].cv_rmse_mean is None and not any(r.overfit for r in rows.values())
    assert all(rows[n].cv_rmse_mean < 0.3 and rows[n].cv_rmse_std >= 0 and rows[n].train_r2 > 0.9 for n in names)
    top = training.importances(spark, models["xgboost"], prep.features).orderBy(F.desc("importance")).first()
    assert top.feature == "room_count" and training.importances(spark, models["lasso"], prep.features).count() == len(prep.features)


def test_text_vectors_have_unit_length(spark):
    docs = spark.createDataFrame([(1, "pool garden pool"), (2, "garden villa"), (3, "villa")], "id int, t string")
    rows = training.fit_text(docs, "t", 10).transform(docs).collect()
    assert all(abs(r.text_vector.norm(2) - 1) < 1e-9 for r in rows)


CASES = [
    {"price": "250000", "property_type": "Maison", "living_area": "150", "room_count": "4", "governorate": "Tunis", "description": ["Belle maison luxe"], "has_pool": "true"},
    {}, {"price": None, "description": None}, {"price": "abc", "living_area": "x", "room_count": "?"}, {"price": "-5", "living_area": "0"},
    {"price": "999999999", "living_area": "10000", "room_count": "50"}, {"price": "nan", "description": []},
]


def test_every_prediction_case_gives_one_valid_record(spark):
    schema = ("id int, price string, property_type string, living_area string, land_area string, room_count string, bathroom_count string, governorate string, "
              "delegation string, description array<string>, has_pool string, currency string")
    names = [f.split()[0] for f in schema.split(", ")]
    rows = [tuple({"id": i, **c}.get(n) for n in names) for i, c in enumerate(CASES)]
    cases = spark.createDataFrame(rows, schema)
    features = serving_features(cases, keep=["id"])
    assert features.columns == ["id", *K.SERVING_FEATURES]
    train = spark.range(200).select(
        F.col("id"), (50 + F.col("id") % 100).cast("string").alias("living_area"), (F.col("id") % 5).cast("string").alias("room_count"), (100000 + F.col("id") * 1000).cast("string").alias("price"))
    model = scoring.fit_serving_model(train, "id", numTrees=5, maxDepth=4)
    for m in (model, None):
        records = {r.id: r.result for r in scoring.predict(cases, m, "id").collect()}
        assert len(records) == len(CASES)
        for r in records.values():
            assert r.predicted_price > 0 and 0 <= r.confidence <= 1 and r.price_range.min <= r.predicted_price <= r.price_range.max and r.factors
    first = {r.id: r.result for r in scoring.predict(cases, model, "id").collect()}
    assert first == {r.id: r.result for r in scoring.predict(cases, model, "id").collect()}
    assert "Major city location" in first[0].factors and "Swimming pool" in first[0].factors and "Luxury features" in first[0].factors


def test_leaky_columns_stay_out(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1, 1)], "living_area double, price_per_sqm double, market_segment_Budget int, has_pool int")
    assert model_columns(df) == ["living_area", "has_pool"] and "price_per_sqm" in model_columns(df, include_leaky=True)


def test_found_keywords(spark):
    from hearthline.functions.text import found_keywords

    df = spark.createDataFrame([(1, "villa rénovée, vue mer"), (2, ""), (3, None)], "id int, t string")
    found = {r["id"]: r["f"] for r in df.select("id", found_keywords(F.col("t"), ["vue mer", "rénov", "é", "jardin", "é"]).alias("f")).collect()}
    assert found == {1: ["vue mer", "rénov", "é"], 2: [], 3: None}


def test_texts_are_kept_as_vectors_only(spark, monkeypatch):
    rows = spark.createDataFrame([(i, 20_000.0 + i * 100, float(i % 9), "garden pool" if i % 2 else "pool sea") for i in range(300)], "id long, price double, land_area double, t string")
    rows = rows.withColumn("room_count", F.lit(2.0))
    seen, plain = [], training.pipeline
    monkeypatch.setattr(training, "pipeline", lambda estimator, features, text=None: (seen.append((features, text)), plain(estimator, features, text))[1])
    models, prep, table = training.train_compare(rows, "id", ["land_area", "room_count"], ["decision_tree"], text="t", folds=2)
    assert seen and all(text is None and features[-1] == "text_vector" for features, text in seen)
    assert "prediction" in models["decision_tree"].transform(prep.apply(rows)).columns and table.count() == 1


def test_forest_keeps_node_ids_and_grows_the_same_trees(spark, linear_rows):
    rows = training.Preparation.fit(linear_rows, ["room_count", "land_area"]).apply(linear_rows).cache()
    forest = training.estimators()["random_forest"].setParams(numTrees=4, maxDepth=5)
    assert forest.getCacheNodeIds() and forest.getCheckpointInterval() > 10
    grown = [training.pipeline(f, ["room_count", "land_area"]).fit(rows).stages[-1].toDebugString.split("\n", 1)[1] for f in (forest, forest.copy().setCacheNodeIds(False))]
    assert grown[0] == grown[1]


def test_fits_run_side_by_side_and_keep_their_order(spark):
    meet = threading.Barrier(2, timeout=60)  # one after the other, the first would wait in vain
    jobs = [lambda n=n: (meet.wait(), spark.range(n).count())[1] for n in (3, 5)]
    assert [found for found, _ in training._side_by_side(spark, jobs)] == [3, 5] and training._side_by_side(spark, []) == []


def test_serving_features_are_computed_once(spark):
    df = spark.range(60).select("id", (100000 + F.col("id") * 1000).cast("double").alias("price"), F.array(F.lit("villa luxe")).alias("description"))
    rows = scoring.serving_rows(df, "id").persist()
    model = scoring.fit_serving_rows(rows, "id", numTrees=2, maxDepth=2)
    plain = scoring.predict(df, scoring.fit_serving_model(df, "id", numTrees=2, maxDepth=2), "id")
    assert not any("description" in c and c != "description_length" and c != "description_word_count" for c in rows.columns)
    assert scoring.predict_rows(rows, model, "id").exceptAll(plain).isEmpty() and plain.count() == 60
