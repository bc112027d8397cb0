"""Operators: exactness, skewed keys, and set properties."""

import random

from pyspark.sql import functions as F
import pytest

from hearthline.operators import columns, dedupe, evaluate, filters, merge, profile, ranking, similar, stats


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value; some are null."""
    rnd = random.Random(3)
    rows = [(i, "ab"[i % 2] if i % 5 else None, 7.0 if i % 3 == 0 else None if i % 11 == 0 else rnd.gauss(0, 100)) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, g string, v double").cache()


def test_quantiles_match_the_built_in(skewed):
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    for by in ([], ["g"]):
        want = {(r.g if by else 0, p): v for r in skewed.groupBy(*by).agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q")).collect() for p, v in zip(probs, r.q)}
        for ranges in (4, 256):
            got = {(r.g if by else 0, r.prob): r.value for r in ranking.quantiles(skewed, ["v"], probs, by, ranges=ranges).collect()}
            assert got == pytest.approx(want, rel=1e-12)


def test_quantiles_of_nan_ties_and_null_groups(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", float("nan")), ("b", None), ("b", None), (None, 5.0), (None, 5.0), ("c", float("inf")), ("c", -float("inf"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.prob): r.value for r in ranking.quantiles(df, ["v"], [0.25, 0.5, 1.0], ["g"], ranges=4).collect()}
    assert got[("a", 0.5)] == 2.5 and got[("a", 1.0)] != got[("a", 1.0)] and got[("a", 0.25)] == 1.75
    assert got[("b", 0.5)] is None and got[(None, 0.5)] == 5.0 and got[("c", 1.0)] == float("inf") and len(got) == 12


def test_ranges_grow_with_the_data(skewed, monkeypatch):
    want = ranking.quantile_values(skewed, ["v"], [0.1, 0.5])
    monkeypatch.setattr(ranking, "RANGE_ROWS", 50)
    assert ranking.quantile_values(skewed, ["v"], [0.1, 0.5], ranges=4)["v"] == pytest.approx(want["v"], rel=1e-12)
    near = ranking.quantiles(skewed, ["v"], [0.5], ["g"], accuracy=1000)
    assert near.count() == 3 and near.columns == ["g", "column_name", "prob", "value"]


def test_ranked_values_cover_every_row(skewed):
    rows = ranking.ranked_values(skewed, "v", ranges=16).orderBy("rows_before").collect()
    n = skewed.where("v is not null").count()
    assert rows[0].rows_before == 0 and all(a.rows_before + a.n_rows == b.rows_before for a, b in zip(rows, rows[1:]))
    assert rows[-1].rows_before + rows[-1].n_rows == n == rows[0].n_total
    assert [r.v for r in rows] == sorted(r.v for r in rows)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([(None,)], "v double")
    assert ranking.quantile_values(empty, ["v"], [0.5]) == {"v": [None]}
    assert [r.value for r in ranking.quantiles(empty, ["v"], [0.5]).collect()] == [None]
    assert [r.value for r in ranking.quantiles(empty.limit(0), ["v"], [0.5]).collect()] == [None]
    assert ranking.quantiles(empty.limit(0).withColumn("g", F.lit(1)), ["v"], [0.5], ["g"]).count() == 0


def test_keep_first_is_idempotent_and_handles_hot_and_null_keys(spark):
    rows = [(i, None if i % 4 == 0 else "hot" if i % 3 else f"k{i % 5}") for i in range(100)]
    df = spark.createDataFrame(rows, "id int, k string").repartition(7)
    once = dedupe.keep_first(df, ["k"], ["id"])
    assert once.count() == len({k for _, k in rows})
    firsts = {}
    for i, k in rows:
        firsts.setdefault(k, i)
    assert {r.k: r.id for r in once.collect()} == firsts
    assert sorted(map(tuple, dedupe.keep_first(once, ["k"], ["id"]).collect()), key=str) == sorted(map(tuple, once.collect()), key=str)
    kept = dedupe.keep_first(df, ["k"], ["id"], F.col("k").isNull())
    assert kept.where("k is null").count() == 25


def test_merge_never_changes_filled_cells(spark):
    base = spark.createDataFrame([(1, "a", 0.0, None), (2, "nan", 5.0, 1), (3, None, None, None), (4, " ", 0.0, 2)], "id int, t string, z double, n int")
    patch = spark.createDataFrame([(1, "x", 9.0, 4), (2, "y", 9.0, 5), (3, None, 8.0, None)], "id int, t string, z double, n int")
    kinds = {"t": "text", "z": "zero_is_gap", "n": "number"}
    got = {r.id: (r.t, r.z, r.n) for r in merge.merge_fill(base, patch, "id", kinds).collect()}
    assert got == {1: ("a", 9.0, 4), 2: ("y", 5.0, 1), 3: (None, 8.0, None), 4: (" ", 0.0, 2)}
    preview = {(r.id, r.column_name): r.status for r in merge.merge_preview(base, patch, "id", kinds).collect()}
    assert preview[(1, "z")] == "replace" and preview[(1, "t")] == "keep" and preview[(3, "z")] == "new" and (3, "n") not in preview
    counts = {r.column_name: r.n_updated for r in merge.merge_counts(base, patch, "id", kinds).collect()}
    assert counts == {"t": 1, "z": 2, "n": 1}


def test_cap_keeps_bounds_and_nulls(skewed):
    lo, hi = ranking.quantile_values(skewed, ["v"], [0.01, 0.99])["v"]
    capped = stats.cap(skewed, ["v"])
    assert capped.where((F.col("v") < lo) | (F.col("v") > hi)).count() == 0
    assert capped.where("v is null").count() == skewed.where("v is null").count()


def test_modes_and_labels(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None), (None, None)], "x string, y string")
    assert stats.modes(df, ["x", "y"]) == {"x": "a", "y": None}
    filled = stats.impute_mode(df, ["x", "y"]).collect()
    assert {r.y for r in filled} == {"unknown"} and all(r.x for r in filled)
    assert sorted((r.x or "", r.c) for r in stats.label_encode(df, "x", "c").collect()) == [("", -1), ("a", 0), ("a", 0), ("b", 1), ("b", 1)]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 10, 10)], "v double")
    assert [r.n for r in profile.histogram(df, "v", 5).orderBy("bin").collect()] == [2, 1, 0, 0, 2]
    flat = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert profile.histogram(flat, "v", 2).agg(F.sum("n")).first()[0] == 2


def test_column_shaping(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    with pytest.raises(ValueError, match="c"):
        columns.require_columns(df, ["a", "c"])
    assert columns.column_sets(df, df.select("b", F.lit(1).alias("z"))) == {"only_first": ["a"], "only_second": ["z"], "common": ["b"]}
    assert columns.align_features(df, ["z", "a"]).first() == (0.0, 1.0)
    assert profile.group_features(["has_a", "gov_b", "c"], {"amenity": "has_", "place": "gov_"}) == {"amenity": ["has_a"], "place": ["gov_b"], "other": ["c"]}
    assert columns.features_by_prefix(df.withColumn("has_q", F.lit(1)), ("has_",), ["a", "none"]) == ["a", "has_q"]


def test_filters_keep_null_where_asked(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "t")], "id int, d string")
    assert [r.id for r in filters.drop_empty_text(df, "d").collect()] == [2, 3]
    assert [r.id for r in filters.drop_empty_text(df, "d", keep_null=False).collect()] == [3]


def test_importance_and_ranks(spark):
    imp = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2)], "feature string, importance double")
    assert tuple(evaluate.features_needed(imp).first()) == (3, 3)
    results = spark.createDataFrame([("m", 0.9, 5.0), ("n", 0.8, 4.0)], "model string, r2 double, mae double")
    ranked = {r.model: (r.r2_rank, r.mae_rank, r.is_best) for r in evaluate.rank_models(results).collect()}
    assert ranked == {"m": (1, 2, True), "n": (2, 1, False)}


def test_qq_points_follow_the_normal(spark):
    df = spark.range(1, 1000).select(F.col("id").cast("double").alias("v"))
    points = evaluate.qq_points(df, "v").orderBy("rank").collect()
    assert len(points) == 999 and abs(points[499].theoretical) < 1e-9 and points[0].theoretical < -3


def _brute(texts, t=0.8):
    import re

    sets = {k: set(re.findall(r"\w{2,}", v.lower())) for k, v in texts}
    dup = set()
    for k, s in sets.items():
        for o, q in sets.items():
            if o < k and s and q and len(s & q) > t * len(s | q):
                dup.add(k)
    return dup


def test_near_duplicates_match_brute_force_with_crowds(spark):
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(4000)]
    base = rnd.sample(vocab, 120)
    footer = [f"footer{i}" for i in range(30)]
    texts = []
    for i in range(150):  # a crowd of near copies around the threshold
        words = [w for w in base if rnd.random() > 0.03 * rnd.random() * 6] + rnd.sample(vocab, rnd.randrange(0, 14))
        texts.append(" ".join(rnd.sample(words, len(words))))
    texts += [" ".join(base)] * 60  # exact copies
    texts += [" ".join(rnd.sample(vocab, 60) + footer) for _ in range(120)]  # shared boilerplate
    for n in (1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 40):  # short texts, one or two words changed
        for _ in range(6):
            words = rnd.sample(vocab[:60], n)
            texts.append(" ".join(words))
            changed = list(words)
            changed[rnd.randrange(n)] = rnd.choice(vocab)
            texts += [" ".join(changed), " ".join([*words, rnd.choice(vocab)])]
    texts += ["", "?", ""]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "id long, t string")
    for t in (0.8, 0.5, 0.95):
        got = {r.id for r in similar.near_duplicates(df, "id", "t", t).where("is_duplicate").collect()}
        assert got == _brute(rows, t)


def test_near_duplicates_of_templated_texts_and_an_odd_leader(spark):
    rnd = random.Random(5)
    fixed, base = [f"f{i}" for i in range(5)], [f"b{i}" for i in range(60)]
    texts = [" ".join([*base[:52], *(f"odd{i}" for i in range(8))])]  # the smallest key is no copy of those that follow
    for i in range(60):
        words = list(base)
        words[i % 60] = f"c{i}"
        texts.append(" ".join(words))
    texts += [" ".join([*fixed, f"u{i}"]) for i in range(300)]
    texts += [" ".join([*fixed, f"u{i}", "x"]) for i in range(5)]
    rnd.shuffle(texts[1:])
    rows = list(enumerate(texts))
    got = {r.id for r in similar.near_duplicates(spark.createDataFrame(rows, "id long, t string"), "id", "t").where("is_duplicate").collect()}
    assert got == _brute(rows)


def test_near_duplicates_leave_no_shuffle_files_of_ended_jobs(spark):
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false")
    files = lambda: sum(f.getName().startswith("shuffle_") for f in
                        spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    before, rng = files(), random.Random(3)
    rows = [(i, " ".join(rng.sample([f"w{j}" for j in range(300)], 40))) for i in range(200)]
    assert similar.near_duplicates(spark.createDataFrame(rows + [(999, rows[0][1])], "id long, t string"), "id", "t").where("is_duplicate").count() == 1
    assert files() <= before + 16  # a join in flight; each of some ten jobs wrote as many


def test_label_encode_of_many_labels(spark):
    df = spark.range(12_000).select(F.format_string("k%05d", F.col("id") % 11_000).alias("x"))
    codes = stats.label_encode(df, "x", "c")
    assert codes.where(F.col("c") != F.substring("x", 2, 5).cast("int")).count() == 0 and codes.count() == 12_000


def test_near_duplicates_of_form_letters_compare_about_as_many_pairs_as_texts(spark, monkeypatch):
    """Most words are fixed, the others have a few options each: every word is frequent, and all pairs would be two million."""
    compared, similar_pairs = [], similar._similar
    monkeypatch.setattr(similar, "_similar", lambda pairs, sets, t: compared.append(pairs.count()) or similar_pairs(pairs, sets, t))
    rng, counts = random.Random(1), []
    for n in (500, 2_000):
        rows = [(i, " ".join([f"fix{j}" for j in range(54)] + [f"slot{j}opt{rng.randrange(12)}" for j in range(9)])) for i in range(n)]
        compared.clear()
        got = {r.id for r in similar.near_duplicates(spark.createDataFrame(rows, "id long, t string"), "id", "t").where("is_duplicate").collect()}
        sets = [set(t.split()) for _, t in rows]
        want = {i for i in range(n) if any((o := len(sets[i] & sets[j])) > 0.8 * (len(sets[i]) + len(sets[j]) - o) + 1e-9 for j in range(i))}
        assert got == want
        counts.append(sum(compared))
    assert counts[1] < 6 * counts[0]  # all pairs would be 16 times as many


@pytest.mark.parametrize("range_rows,accuracy", [(10, 20), (1_000_000, 2_000)])
def test_whole_quantiles_with_bounds_drawn_closer(spark, monkeypatch, range_rows, accuracy):
    """Sketches as coarse as they come, columns of few values, NaN, infinite and no values at all."""
    monkeypatch.setattr(ranking, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(ranking, "ACCURACY", accuracy)
    rnd = random.Random(2)
    rows = [(rnd.gauss(0, 1e6), float(rnd.randrange(3)), rnd.choice([None, 1.5, float("inf"), float("-inf"), rnd.random()]), rnd.choice([float("nan"), 2.0, rnd.random()]), None) for _ in range(900)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(3)
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    got = ranking.quantile_values(df, list("abcde"), probs)
    for i, c in enumerate("abcde"):
        values = sorted((r[i] for r in rows if r[i] is not None), key=lambda v: (v != v, v))
        for p, q in zip(probs, got[c]):
            if not values:
                assert q is None
                continue
            at = (len(values) - 1) * p
            lo, hi = values[int(at)], values[min(len(values) - 1, int(at) + (at > int(at)))]
            want = lo if at == int(at) else lo + (hi - lo) * (at - int(at))
            assert q == want or q != q and want != want or abs(q - want) < 1e-9 * abs(want)
