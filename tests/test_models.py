"""Models and attributions that Spark ML lacks, against brute force."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from quillstat.functions import ranks
from quillstat.operators import attribute, features, models, regress, training
from quillstat.operators.attribute import Tree, batch_attributions, covers, mean_attributions, node_tables, tree_attributions
from quillstat.operators.models import Network, lbfgs


def table(spark, n, columns, label, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, columns)).round(3)
    names = [f"x{k}" for k in range(columns)]
    return spark.createDataFrame([(*map(float, r), float(label(r))) for r in x], ", ".join(f"{c} double" for c in [*names, "label"])), names, x


def brute_shapley(tree: Tree, cover, x):
    """Every subset of features: a known one follows the row, an unknown one is averaged by the rows of either side."""

    def value(node, known):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        sides = int(tree.left[node]), int(tree.right[node])
        if f in known:
            return value(sides[0] if x[f] <= tree.threshold[node] else sides[1], known)
        return sum(cover[s] / cover[node] * value(s, known) for s in sides)

    p = len(x)
    out = np.zeros(p)
    for i in range(p):
        others = [j for j in range(p) if j != i]
        for size in range(p):
            for s in itertools.combinations(others, size):
                weight = math.factorial(size) * math.factorial(p - size - 1) / math.factorial(p)
                out[i] += weight * (value(0, {*s, i}) - value(0, set(s)))
    return out


@pytest.mark.parametrize("maker", [lambda: RandomForestRegressor(numTrees=4, maxDepth=4, seed=2), lambda: DecisionTreeRegressor(maxDepth=4), lambda: GBTRegressor(maxIter=4, maxDepth=3, seed=2)])
def test_attributions_against_all_subsets(spark, maker):
    df, names, x = table(spark, 300, 5, lambda r: r[0] * r[1] + 3 * (r[2] > 0.3) + math.sin(2 * r[0]))
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    fitted = maker().fit(ready)
    trees = node_tables(fitted)
    cover = covers(df.withColumn("x", F.array(*names)), trees)
    assert all(c[0] == 300 for c in cover)
    got = batch_attributions(x[:12], trees, cover)
    for k in range(12):
        want = sum(t.weight * brute_shapley(t, c, x[k]) for t, c in zip(trees, cover, strict=True))
        assert got[k] == pytest.approx(want, abs=1e-9)
    made, base = tree_attributions(ready, names, fitted)
    rows = fitted.transform(made).select("prediction", "explained", "attributions").collect()
    assert base == pytest.approx(np.mean([r["prediction"] for r in rows]))
    for r in rows:  # they add up to the prediction less the mean
        assert sum(r["attributions"]) == pytest.approx(r["prediction"] - base, abs=1e-9) and r["explained"] == pytest.approx(r["prediction"], abs=1e-9)


@pytest.mark.parametrize("maker", [lambda: RandomForestClassifier(numTrees=5, maxDepth=4, seed=2), lambda: DecisionTreeClassifier(maxDepth=4), lambda: GBTClassifier(maxIter=4, maxDepth=3, seed=2)])
def test_attributions_of_classifiers(spark, maker):
    df, names, _ = table(spark, 300, 3, lambda r: r[0] + r[1] ** 2 > 0.5)
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    fitted = maker().fit(ready)
    made, _ = tree_attributions(ready, names, fitted, classify=True)
    for r in fitted.transform(made).select("probability", "explained").collect():
        share = 1 / (1 + math.exp(-2 * r["explained"])) if isinstance(maker(), GBTClassifier) else r["explained"]
        assert share == pytest.approx(float(r["probability"][1]), abs=1e-9)


def test_attribution_edges(spark):
    df, names, _ = table(spark, 100, 2, lambda r: r[0])
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    fitted = DecisionTreeRegressor(maxDepth=3).fit(ready)
    odd = spark.createDataFrame([(None, 1.0, "a"), (float("nan"), 1.0, "a"), (0.5, -1.0, "a"), (0.5, -1.0, "a")], "x0 double, x1 double, attributions string")
    made, base = tree_attributions(odd, names, fitted)
    rows = made.collect()
    assert [r["explained"] is None for r in rows] == [True, True, False, False] and base == rows[2]["explained"]
    assert tree_attributions(odd.limit(0), names, fitted)[0].collect() == []
    constant = DecisionTreeRegressor(maxDepth=3).fit(ready.withColumn("label", F.lit(2.0)))
    assert {tuple(r["attributions"]) for r in tree_attributions(df, names, constant)[0].collect()} == {(0.0, 0.0)}
    ranked = mean_attributions(tree_attributions(df, names, fitted)[0], names).orderBy("rank").collect()
    assert [r["feature"] for r in ranked] == names and sum(r["percentage"] for r in ranked) == pytest.approx(100)


@pytest.mark.parametrize("few", [4096, 0])
def test_a_tree_is_worked_out_for_cells_not_rows(spark, monkeypatch, few):
    df, names, x = table(spark, 400, 2, lambda r: r[0] * r[1] + 2 * (r[0] > 0.3))
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    fitted = RandomForestRegressor(numTrees=4, maxDepth=3, seed=2).fit(ready)
    trees = node_tables(fitted)
    plain = [np.zeros(len(t.feature), int) for t in trees]
    for t, n in zip(trees, plain, strict=True):
        for node, rows in t.visited(x):
            n[node] += len(rows)
    monkeypatch.setattr(attribute, "CELLS", few)
    cover = covers(df.withColumn("x", F.array(*names)), trees)
    assert all((a == b).all() for a, b in zip(cover, plain, strict=True))
    asked = []
    of_rows = attribute.tree_values
    monkeypatch.setattr(attribute, "tree_values", lambda x, *a: asked.append(len(x)) or of_rows(x, *a))
    many = np.tile(x, (50, 1))
    got = batch_attributions(many, trees, cover)
    assert sum(asked) <= 4 * 20 < len(many)  # seven thresholds cut two features in 5 * 4 cells at most
    assert got == pytest.approx(sum(of_rows(many, t, c) for t, c in zip(trees, cover, strict=True)), abs=1e-12)


def test_attributions_of_one_task_are_dealt_out(spark, monkeypatch):
    df, names, _ = table(spark, 300, 2, lambda r: r[0] + r[1])
    one = df.coalesce(1)
    fitted = DecisionTreeRegressor(maxDepth=3).fit(VectorAssembler(inputCols=names, outputCol="features").transform(one))
    want = sorted(tuple(r["attributions"]) for r in tree_attributions(one, names, fitted)[0].collect())
    monkeypatch.setattr(ranks, "TASK_ROWS", 50)
    made = tree_attributions(one, names, fitted)[0]
    sizes = made.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 6 and max(r["count"] for r in sizes) <= 51
    assert sorted(tuple(r["attributions"]) for r in made.collect()) == want


@pytest.mark.parametrize("fit", [lambda df, names: regress.random_forest(df, "label", names, 3, 3), lambda df, names: features.forest_importance(df, names, "label", 3, 3)])
def test_a_forest_grows_on_many_tasks(spark, monkeypatch, fit):
    df, names, _ = table(spark, 300, 2, lambda r: r[0] + r[1])
    seen = []
    grown = RandomForestRegressor._fit
    monkeypatch.setattr(RandomForestRegressor, "_fit", lambda self, rows: seen.append(rows.rdd.getNumPartitions()) or grown(self, rows))
    monkeypatch.setattr(ranks, "TASK_ROWS", 60)
    fit(df.coalesce(1), names)
    assert seen == [5]
    dealt = ranks.spread(df.coalesce(1), order=names).collect()
    assert sorted(map(tuple, dealt)) == sorted(map(tuple, df.collect()))


def test_network_gradient_against_finite_differences():
    rng = np.random.default_rng(0)
    net = Network([3, 4, 2, 1])
    w, x, y = net.start(1), rng.normal(size=(20, 3)), rng.normal(size=20)
    grad = net.loss_and_gradient(w, x, y)[1:]
    for k in range(len(w)):
        step = np.zeros(len(w))
        step[k] = 1e-6
        slope = (net.loss_and_gradient(w + step, x, y)[0] - net.loss_and_gradient(w - step, x, y)[0]) / 2e-6
        assert grad[k] == pytest.approx(slope, abs=1e-6)


def test_equal_rows_are_one_in_a_block(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(b), float(y)) for a, b, y in zip(rng.integers(0, 4, 3000), rng.integers(0, 3, 3000), rng.normal(size=3000), strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, y double").coalesce(1).select(F.array("a", "b").alias("x"), "y")
    entries = lambda b: (models._rows(b), np.column_stack((np.ones(b.num_rows), b.column(1).to_numpy())))
    (made,) = models.packed(df, entries).collect()
    (x, sums), = models._blocks(pa.table({c: [bytes(made[c])] for c in "ks"}).to_batches()[0], (float, 2), (float, 2))
    want = {}
    for a, b, y in rows:
        n, s = want.get((a, b), (0, 0.0))
        want[a, b] = n + 1, s + y
    assert {tuple(k): tuple(v) for k, v in zip(x, sums, strict=True)} == {k: (n, pytest.approx(s)) for k, (n, s) in want.items()}
    monkeypatch.setattr(models, "BLOCK_NUMBERS", 200)  # rows that all differ go on in many blocks
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    many = models.packed(df.select(F.array(F.monotonically_increasing_id().cast("double"), F.lit(1.0)).alias("x"), "y"), entries).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(many) == 30 and sum(len(r["k"]) for r in many) == 3000 * 16


def test_network_reads_its_rows_once(spark, monkeypatch):
    """Evaluations meet the few distinct inputs, and the loss is that of all rows."""
    rng = np.random.default_rng(0)
    x, noise = rng.integers(0, 6, 2000), rng.normal(size=2000)
    df = spark.createDataFrame([(float(a), float(a * a + e)) for a, e in zip(x, noise, strict=True)], "x double, label double")
    asked, losses = [], []
    summed, own = models.summed, models.lbfgs
    monkeypatch.setattr(models, "summed", lambda points, make: asked.append(points) or summed(points, make))

    def one(value, w, *a):
        losses.append((w, *value(w)))
        assert sum(len(r["k"]) for r in asked[0].collect()) <= 6 * 8 * 8  # of eight tasks, in bytes
        return own(value, w, *a)

    monkeypatch.setattr(models, "lbfgs", one)
    training.build("neural_network", False, ["x"], {"layers": [3], "maxIter": 2, "regParam": 0.0}).fit(df)
    net, (w, loss, grad) = Network([1, 3, 1]), losses[0]
    y = np.array([r["label"] for r in df.select("label").collect()])
    a = x.astype(float)
    want = net.loss_and_gradient(w, ((a - a.mean()) / a.std(ddof=1))[:, None], (y - y.mean()) / y.std()) / 2000
    assert np.concatenate(([loss], grad)) == pytest.approx(want, abs=1e-9)


def test_quasi_newton_finds_a_valley():
    rosen = lambda w: (100 * (w[1] - w[0] ** 2) ** 2 + (1 - w[0]) ** 2, np.array([-400 * w[0] * (w[1] - w[0] ** 2) - 2 * (1 - w[0]), 200 * (w[1] - w[0] ** 2)]))
    assert lbfgs(rosen, np.array([-1.2, 1.0]), 500, 1e-12) == pytest.approx([1, 1], abs=1e-4)


def test_network_beats_a_line(spark):
    df, names, _ = table(spark, 400, 1, lambda r: math.sin(3 * r[0]))
    scores = {n: training.evaluate(training.build(n, False, names, p).fit(df).transform(df), False)["r2"] for n, p in (("linear", {}), ("neural_network", {"layers": [16], "maxIter": 150}))}
    assert scores["neural_network"] > 0.95 > 0.7 > scores["linear"]


def test_boosting_of_three_classes_against_one_against_rest(spark):
    kind = lambda r: 0 if r[0] ** 2 + r[1] ** 2 < 0.8 else 1 if r[0] > 0 else 2
    df, names, x = table(spark, 900, 3, kind)
    test, _, _ = table(spark, 600, 3, kind, seed=9)
    model = training.build("gradient_boosting", True, names, {"maxIter": 15, "maxDepth": 3, "stepSize": 0.3}, classes=3).fit(df)
    scored = model.transform(test)
    own = scored.filter("prediction = label").count() / 600
    rest = []
    for k in range(3):
        one = training.build("gradient_boosting", True, names, {"maxIter": 15, "maxDepth": 3, "stepSize": 0.3}).fit(df.withColumn("label", (F.col("label") == k).cast("double")))
        rest.append([float(r["probability"][1]) for r in one.transform(test).select("probability").collect()])
    truth = [r["label"] for r in test.collect()]
    assert own >= np.mean(np.argmax(rest, 0) == truth) - 0.02 and own > 0.9
    shares = [r["probability"] for r in scored.select("probability").collect()]
    assert all(sum(s) == pytest.approx(1) for s in shares)
    again = training.build("gradient_boosting", True, names, {"maxIter": 4, "maxDepth": 2, "keep": 1}, classes=3).fit(df.repartition(3)).stages[-1]
    once = training.build("gradient_boosting", True, names, {"maxIter": 4, "maxDepth": 2, "keep": 10}, classes=3).fit(df).stages[-1]
    for a, b in zip(again.trees, once.trees, strict=True):  # neither partitions nor written scores matter
        for s, t in zip(a, b, strict=True):
            assert (s.feature == t.feature).all() and (s.cut == t.cut).all() and s.value == pytest.approx(t.value)


def test_boosting_keeps_equal_bins_as_one(spark, monkeypatch):
    df, names, _ = table(spark, 3000, 2, lambda r: 0 if r[0] > 0.5 else 1 if r[1] > 0 else 2)
    seen = []
    summed = models.summed
    monkeypatch.setattr(models, "summed", lambda points, make: seen.append(points) or summed(points, make))
    fit = lambda d: training.build("gradient_boosting", True, names, {"maxIter": 3, "maxDepth": 2, "bins": 4, "keep": 2}, classes=3).fit(d)
    one, many = fit(df.coalesce(1)), fit(df.repartition(5))
    for points, tasks in ((seen[0], 1), (seen[-1], 5)):
        held = points.collect()
        assert len(held) == tasks and all(len(r["k"]) <= 2 * 2 * 16 for r in held)  # four bins of each feature
        assert sum(np.frombuffer(r["s"]).reshape(-1, 4)[:, 0].sum() for r in held) == 3000
    for s, t in zip(one.stages[-1].trees, many.stages[-1].trees, strict=True):
        assert all((a.feature == b.feature).all() and (a.cut == b.cut).all() for a, b in zip(s, t, strict=True))


@pytest.mark.parametrize(("n", "want"), [(20, (4, 3, 13)), (130, (26, 20, 84)), (1, (0, 0, 1)), (3, (1, 0, 2))])
def test_exact_split_of_a_class(spark, n, want):
    df = spark.range(n).select("id", F.lit("small").alias("y")).unionByName(spark.range(1000, 1500).select("id", F.lit("large").alias("y")))
    got = training.stratified_split(df, "y", F.col("id")).filter("y = 'small'").groupBy("split").count().collect()
    found = {r["split"]: r["count"] for r in got}
    assert tuple(found.get(s, 0) for s in ("test", "val", "train")) == want


def test_split_takes_null_classes_repeats_and_seeds(spark):
    df = spark.createDataFrame([(k % 3, None if k % 2 else "a") for k in range(200)], "id int, y string")
    rows = training.stratified_split(df, "y", F.col("id")).groupBy("y", "split").count().collect()
    assert {(r["y"], r["split"]): r["count"] for r in rows} == {(y, s): n for y in (None, "a") for s, n in (("test", 20), ("val", 15), ("train", 65))}
    many = spark.range(500)
    test = lambda seed: {r["id"] for r in training.stratified_split(many, None, F.col("id"), seed=seed).filter("split = 'test'").collect()}
    assert len(test(1)) == 100 and test(1) == test(1) != test(2)
    folds = training.stratified_folds(df, "y", F.col("id"), 7).groupBy("y", "fold").count().collect()
    assert len(folds) == 14 and {r["count"] for r in folds} == {14, 15}


def test_tuning_is_the_exhaustive_loop(spark):
    df, names, _ = table(spark, 200, 2, lambda r: r[0] > 0.2 * r[1])
    rows = training.stratified_folds(df, "label", F.xxhash64(*names), 3).persist()
    got = training.tune(rows, "logistic", True, names, "grid", folds=3)
    best = None
    for params in training.candidates("logistic", "grid", 99):
        scores = []
        for k in range(3):
            fitted = training.build("logistic", True, names, params).fit(rows.filter(F.col("fold") != k))
            scores.append(training.headline(training.evaluate(fitted.transform(rows.filter(F.col("fold") == k)), True), True))
        if best is None or sum(scores) / 3 > best[0]:
            best = (sum(scores) / 3, params)
    assert (got["best_score"], got["params"]) == (pytest.approx(best[0]), best[1]) and got["tried"] == 8
    rows.unpersist()


def test_experiment_of_twenty_classes(spark):
    rng = np.random.default_rng(3)
    rows = [(float(k) + float(rng.normal() * 0.1), float(k * k % 7), float(k)) for k in range(20) for _ in range(20)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    report = training.experiment(df, "y", ["a", "b"], ["random_forest"], "none", folds=2, classify=True, validate=False)
    assert report["problem"] == "classification" and report["split"] == {"test": 80, "val": 60, "train": 260}
    assert "error" not in report["models"]["random_forest"] and report["models"]["random_forest"]["test_metrics"]["accuracy"] > 0.8
