"""Properties of the sampled and fitted operators."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from checks.bindings import COLS, modeling_view
from regiometra.domain import STATUS_ORDER
from regiometra.operators import clustering as km
from regiometra.operators import evaluation as ev
from regiometra.operators import exact_tree
from regiometra.operators import kmeans
from regiometra.operators.splitting import stratified_split
from regiometra.plans import classify as pc
from regiometra.plans.classify import classify, model_inputs
from regiometra.plans.cluster import segment
from regiometra.plans.whatif import what_if
from regiometra.sources.models import load_model, save_model

SMALL = "/root/testdata/sf0.001"


def blobs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(c + rng.normal(0, 0.1)), float(-c + rng.normal(0, 0.1)), 1.0)
            for i, c in enumerate([0.0, 5.0, 10.0] * 40)]
    return spark.createDataFrame(rows, "unit int, x double, y double, weight double")


def brute_silhouette(points, labels):
    dist = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    scores = []
    for i, own in enumerate(labels):
        same = labels == own
        if same.sum() == 1:
            scores.append(0.0)
            continue
        a = dist[i, same].sum() / (same.sum() - 1)
        b = min(dist[i, labels == o].mean() for o in set(labels) - {own})
        scores.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(scores))


def test_standardize_uses_population_deviation_and_zero_for_constants(spark):
    df = spark.createDataFrame([(1.0, 3.0), (3.0, 3.0)], "a double, k double")
    got = sorted(tuple(r) for r in km.standardize(df, ["a", "k"]).collect())
    assert got == [(-1.0, 0.0), (1.0, 0.0)]


def test_silhouette_matches_brute_force_with_a_singleton(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(300, 3)).round(1)
    labels = rng.integers(0, 4, 300)
    labels[0] = 9
    rows = [(*map(float, p), int(c), 0) for p, c in zip(points, labels)]
    df = spark.createDataFrame(rows, "a double, b double, c double, label int, one int")
    got = {r[0]: r[1] for r in km.silhouette_exact(df, ["a", "b", "c"], ["label", "one"]).collect()}
    assert got["label"] == pytest.approx(brute_silhouette(points, labels), abs=1e-12)
    assert got["one"] is None


def test_silhouette_is_the_same_in_blocks(spark, monkeypatch):
    df = blobs(spark).withColumn("c", F.when(F.col("x") > 0, "far").otherwise("near"))
    whole = km.silhouette_exact(df, ["x", "y"], ["c"]).first()[1]
    monkeypatch.setattr(km, "_POINTS_PER_BLOCK", 10)
    assert km.silhouette_exact(df, ["x", "y"], ["c"]).first()[1] == pytest.approx(whole, abs=1e-12)


def test_silhouette_takes_more_points_than_a_task_should(spark):
    many = spark.range(20_500).select((F.col("id") % 5 * 9 + F.rand(1)).alias("x"), F.rand(2).alias("y"), (F.col("id") % 5).alias("c"))
    assert km.silhouette_exact(many, ["x", "y"], ["c"]).first()[1] > 0.8


def test_fits_do_not_depend_on_the_layout(spark):
    points = km.distinct_points(blobs(spark), ["x", "y"])
    found = []
    for parts in (1, 5):
        with kmeans.point_blocks(points.repartition(parts), ["x", "y"]) as blocks:
            found.append(kmeans.fit_all(blocks, [2, 3], restarts=2))
    assert found[0] == found[1]


def test_fits_are_the_same_by_a_shuffle(spark, monkeypatch):
    points = km.distinct_points(blobs(spark), ["x", "y"])
    with kmeans.point_blocks(points, ["x", "y"]) as blocks:
        direct = kmeans.fit_all(blocks, [3], restarts=2)[3]
        monkeypatch.setattr(kmeans, "_DIRECT_BLOCKS", 0)
        shuffled = kmeans.fit_all(blocks, [3], restarts=2)[3]
    assert np.array(direct.points) == pytest.approx(np.array(shuffled.points)) and direct.cost == pytest.approx(shuffled.cost)


def test_fits_cost_no_more_than_parallel_seeding(spark):
    rng = np.random.default_rng(8)
    rows = [(*p, float(w)) for p, w in zip((rng.normal(size=(900, 3)) + rng.integers(-2, 3, (900, 3))).tolist(), rng.integers(1, 5, 900))]
    points = spark.createDataFrame(rows, "a double, b double, c double, weight double").cache()
    with kmeans.point_blocks(points, ["a", "b", "c"]) as blocks:
        found = kmeans.fit_all(blocks, [2, 5, 7], restarts=20)
    vectors = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(points).cache()
    for k, model in found.items():
        other = min(KMeans(k=k, seed=42 + i, maxIter=500, tol=1e-6, weightCol="weight").fit(vectors).summary.trainingCost for i in range(5))
        assert model.cost <= other * (1 + 1e-3)
        x, w = np.array([r[:3] for r in rows]), np.array([r[3] for r in rows])
        gaps = np.square(x[:, None] - np.array(model.points)).sum(axis=2)
        nearest = gaps.argmin(axis=1)
        assert model.cost == pytest.approx((w * gaps.min(axis=1)).sum())
        for i, center in enumerate(model.points):
            assert np.average(x[nearest == i], axis=0, weights=w[nearest == i]) == pytest.approx(np.array(center), abs=1e-12)


def test_fewer_points_than_centres_and_none(spark):
    few = spark.createDataFrame([(0.0, 2.0), (1.0, 1.0), (None, 1.0), (float("nan"), 1.0)], "x double, weight double")
    with kmeans.point_blocks(few, ["x"]) as blocks:
        model = kmeans.fit_all(blocks, [3], restarts=2)[3]
    assert model.cost == 0 and {p[0] for p in model.points} == {0.0, 1.0}
    with kmeans.point_blocks(few.limit(0), ["x"]) as blocks:
        assert kmeans.fit_all(blocks, [2])[2].points == ((0.0,), (0.0,))


def test_scaler_of_no_rows(spark):
    scaler = km.Scaler.fit(spark.createDataFrame([], "x double"), ["x"])
    assert scaler.means == (0.0,) and scaler.stds == (1.0,)


def test_sweep_finds_the_blobs(spark):
    scaled = km.standardize(blobs(spark), ["x", "y"])
    sweep = km.k_sweep(scaled, ["x", "y"], "unit", range(2, 5), sample=100, restarts=4)
    rows = {r["k"]: r for r in sweep.collect()}
    assert km.choose_k(sweep) == 3 and rows[3]["silhouette"] > 0.9
    assert rows[2]["wcss"] > rows[3]["wcss"] > rows[4]["wcss"]


def test_split_is_exact_disjoint_and_independent_of_partitioning(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "MAJU").when(F.col("id") < 993, "MANDIRI")
                                  .otherwise("BERKEMBANG").alias("s"))
    split = stratified_split(df, "s", "id", STATUS_ORDER)
    counts = {r["s"]: r["n"] for r in split.filter("is_test").groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert counts == {"MAJU": 180, "MANDIRI": 19, "BERKEMBANG": 1} and split.count() == 1000
    again = stratified_split(df.repartition(7), "s", "id", STATUS_ORDER)
    assert sorted(split.filter("is_test").collect()) == sorted(again.filter("is_test").collect())


def test_apportioned_split_has_the_whole_share(spark):
    for sizes in ([7, 7, 7, 7], [1, 2, 994, 6], [3, 0, 0, 0], [0, 0, 0, 0]):
        labels = STATUS_ORDER[:4]
        rows = [(i, label) for label, n in zip(labels, sizes) for i in range(n)]
        df = spark.createDataFrame(rows, "id int, s string")
        split = stratified_split(df, "s", "id", STATUS_ORDER, apportion=True)
        taken = {r["s"]: r["n"] for r in split.filter("is_test").groupBy("s").agg(F.count("*").alias("n")).collect()}
        total = -(-sum(sizes) // 5)
        assert sum(taken.values()) == total
        for label, n in zip(labels, sizes):
            assert abs(taken.get(label, 0) - (n / max(sum(sizes), 1) * total)) < 1


def test_split_keeps_every_row_of_unknown_labels_in_training(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, s string")
    assert stratified_split(df, "s", "id", STATUS_ORDER).filter("is_test").count() == 0


def test_report_of_a_class_never_predicted(spark):
    df = spark.createDataFrame([("MAJU", "MAJU"), ("MANDIRI", "MAJU")], "a string, p string")
    got = {r["label"]: r for r in ev.classification_report(df, "a", "p", STATUS_ORDER).collect()}
    assert got["MANDIRI"]["precision"] == 0.0 and got["MANDIRI"]["support"] == 1
    assert got["MAJU"]["precision"] == 0.5 and got["MAJU"]["recall"] == 1.0
    assert got["accuracy"]["f1"] == 0.5 and got["weighted avg"]["precision"] == 0.25
    assert set(got) == {*STATUS_ORDER, "accuracy", "macro avg", "weighted avg"}


def test_segmentation_flow(spark, tmp_path):
    units = modeling_view(spark, SMALL)
    result = segment(units, COLS, ks=range(2, 4), restarts=2, sample=500, silhouette_sample=300)
    assert result.k in (2, 3) and -1 <= result.silhouette <= 1
    centers = [r for r in result.tables["centroids"].collect()]
    assert [c["cluster_id"] for c in centers] == list(range(1, result.k + 1))
    assert [c["iks"] for c in centers] == sorted(c["iks"] for c in centers)
    sizes = result.tables["sizes"].collect()
    assert sum(r["JUMLAH"] for r in sizes) == units.count()
    assert [r["cluster_label"] for r in sizes] == [f"Klaster {i + 1}" for i in range(result.k)]
    mix = result.tables["status_mix"].collect()
    assert all(sum(r[s] for s in STATUS_ORDER) == pytest.approx(100) for r in mix)
    # A stored model places units as the fitted one does, and leaves no helper columns behind.
    save_model(result.model, str(tmp_path / "km"))
    again = load_model(spark, str(tmp_path / "km")).transform(units)
    assert set(again.columns) == {*units.columns, "cluster_id", "cluster_label"}
    assert again.exceptAll(result.clustered).isEmpty()
    means = {r["cluster_label"]: r for r in result.tables["profile"].collect()}
    for c in centers:
        assert means[f"Klaster {c['cluster_id']}"]["iks"] == pytest.approx(c["iks"], abs=0.05)


def test_classification_and_scoring_flow(spark, tmp_path):
    units = modeling_view(spark, SMALL)
    result = classify(units, COLS, trees=10, forest_depth=6)
    accuracy = {r["model"]: r["accuracy"] for r in result.tables["accuracy"].collect()}
    majority = units.groupBy("status").count().agg(F.max("count") / F.sum("count")).first()[0]
    assert min(accuracy.values()) > majority
    importance = result.tables["importance"].collect()
    assert [r["FITUR"] for r in importance] != [] and sum(r["IMPORTANCE"] for r in importance) == pytest.approx(1)
    assert {r["FITUR"] for r in importance} == set(model_inputs(COLS))
    confusion = result.tables["confusion_forest"].collect()
    tested = result.predictions.filter("model = 'random_forest'").count()
    assert sum(sum(r[s] for s in STATUS_ORDER) for r in confusion) == tested

    save_model(result.forest, str(tmp_path / "rf"))
    scenarios = spark.createDataFrame([(1, 0.9, 0.95, 0.97), (2, 0.1, 0.2, 0.0)],
                                      "scenario int, iks double, ike double, ikl double")
    tables = what_if(scenarios, units, load_model(spark, str(tmp_path / "rf")), "scenario", COLS)
    scored = {r["scenario"]: r for r in tables["scored"].collect()}
    assert scored[2]["predicted_status"] == "SANGAT TERTINGGAL"
    chances = tables["probabilities"].collect()
    assert len(chances) == 10
    for s, r in scored.items():
        mine = [c for c in chances if c["scenario"] == s]
        assert sum(c["probability"] for c in mine) == pytest.approx(1)
        assert mine[0]["probability"] == r["confidence"] and mine[0]["status"] == r["predicted_status"]
    advice = tables["advice"].collect()
    assert {(r["scenario"], r["weakest"], r["balanced"]) for r in advice} == {
        (1, "Sosial", True), (2, "Lingkungan", False)} and len(advice) == 4
    bench = {r["scenario"]: r["ikl_pct"] for r in tables["benchmark"].collect()}
    assert bench[2] == 0.0 and bench[1] > 50
    assert "scored" not in what_if(scenarios, units, None, "scenario", COLS)


def test_exact_tree_takes_the_best_of_all_splits(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=400), rng.integers(0, 4, 400), rng.normal(size=400).round(1)])
    y = ((x[:, 0] > 0.123) + (x[:, 1] > 1) * (x[:, 2] > -0.35)).astype(int)
    rows = [(*map(float, a), int(b)) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "a double, b double, c double, label int").cache()
    tree = exact_tree.fit(df, ["a", "b", "c"], ["u", "v", "w"], 4)

    def grow(members, node, depth):
        """Splits by trying every threshold of every feature."""
        if depth == 4 or len(set(y[members])) < 2:
            return {}
        tried = []
        for f in range(3):
            values = np.unique(x[members, f])
            for low, high in zip(values, values[1:]):
                left = members[x[members, f] <= low]
                right = members[x[members, f] > low]
                kept = sum((np.bincount(y[side], minlength=3).astype(float) ** 2).sum() / len(side) for side in (left, right))
                tried.append((-kept, f, low, high, left, right))
        if not tried:
            return {}
        _, f, low, high, left, right = min(tried, key=lambda t: t[:3])
        return {node: (f, (low + high) / 2, len(left), len(right)), **grow(left, 2 * node, depth + 1), **grow(right, 2 * node + 1, depth + 1)}

    want = grow(np.arange(400), 1, 0)
    assert {n: (s.feature, s.threshold, sum(s.left), sum(s.right)) for n, s in tree.splits.items()} == want
    assert sum(tree.importance().values()) == pytest.approx(1)
    save_model(tree.model(), str(tmp_path / "tree"))
    placed = load_model(spark, str(tmp_path / "tree")).transform(df)
    assert placed.where("prediction = label").count() > 380 and {r[0] for r in placed.select("predicted_status").distinct().collect()} <= {"u", "v", "w"}
    with pytest.raises(ValueError):
        exact_tree.fit(df.withColumn("a", F.lit(None).cast("double")), ["a"], ["u", "v", "w"])
    assert exact_tree.fit(df.withColumn("a", F.lit(1.0)), ["a"], ["u", "v", "w"]).splits == {}
    assert exact_tree.fit(df.limit(0), ["a", "b"], ["u", "v", "w"]).splits == {}


def test_units_are_read_once_by_the_fits(spark):
    seen = spark.sparkContext.accumulator(0)

    def tag(status):
        seen.add(1)
        return status

    units = modeling_view(spark, SMALL).localCheckpoint()
    tagged = units.withColumn("status", F.udf(tag, "string").asNondeterministic()("status"))
    classify(tagged, COLS, trees=2, forest_depth=2)
    assert seen.value == units.count()


def test_rows_alike_stand_together_in_a_large_training_table(spark, monkeypatch):
    monkeypatch.setattr(pc, "_ROWS_BY_KEY", 100)
    monkeypatch.setattr(pc, "_ROWS_PER_PARTITION", 30)
    inputs = ["a", "b", "f0", "f1", "f2"]
    rows = [(i, float(i * 7 % 5), float(i % 3), *[float(i % 3 == k) for k in range(3)], float(i % 2)) for i in range(300)]
    for n, parts in ((300, 10), (100, 8)):
        train = spark.createDataFrame(rows[:n], ["unit", *inputs, "label"])
        laid = pc.training_layout(train, "unit", inputs)
        assert sorted(map(tuple, laid.collect())) == sorted(r[1:] for r in rows[:n])
        held = [[(r["label"], r["f0"], r["f1"], r["f2"], r["a"], r["b"]) for r in part] for part in laid.rdd.glom().collect()]
        assert len(held) == parts
        assert all(part == sorted(part) for part in held) == (n > 100)
