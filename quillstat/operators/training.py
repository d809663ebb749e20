"""Splits, baselines, tuning, cross-validation and comparison of models on Spark ML."""

from __future__ import annotations

import itertools
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.functions.ranks import lookup_side, numbered
from quillstat.operators.features import one_hot
from quillstat.operators.profile import is_numeric
from quillstat.operators.regress import auc, classification_metrics, macro_metrics, model_rows, regression_metrics

TEST_SIZE, VAL_SIZE, FOLDS, ITERATIONS, SEED, CLASSES = 0.2, 0.15, 5, 15, 42, 10
#: Fits that run at the same time while a model is tuned.
PARALLEL = 4
#: Search spaces, under Spark ML's parameter names.
GRIDS = {
    "random_forest": {"numTrees": [50, 100, 200], "maxDepth": [5, 10, 20], "minInstancesPerNode": [1, 2, 5], "featureSubsetStrategy": ["sqrt", "log2"]},
    "logistic": {"regParam": [0.01, 0.1, 1.0, 10.0], "maxIter": [100, 200]},
    "ridge": {"regParam": [0.01, 0.1, 1.0, 10.0]},
    "neural_network": {"layers": [[32], [64], [32, 16]]},
    "gradient_boosting": {"maxIter": [50, 100], "maxDepth": [3, 5, 7], "stepSize": [0.05, 0.1]},
}
#: Boosted trees under other names are Spark's own here.
ALIASES = {"xgboost": "gradient_boosting", "lightgbm": "gradient_boosting"}


def is_classification(df: DataFrame, dependent: str) -> bool:
    """At most ten distinct values, all whole. Values that span over ten are counted too, once a sketch says they are few."""
    y = F.col(f"`{dependent}`").cast("double")
    got = df.agg(F.approx_count_distinct(y, 0.02).alias("u"), F.bool_and(y == F.floor(y)).alias("w")).first()
    return bool(got["w"]) and got["u"] <= 2 * CLASSES and df.agg(F.size(F.collect_set(y)).alias("u")).first()["u"] <= CLASSES


def split_column(key: Column, test: float = TEST_SIZE, val: float = VAL_SIZE) -> Column:
    """train, val or test by a hash of the row's key."""
    at = F.pmod(key.cast("bigint") * F.lit(2654435761), F.lit(10_000)) / 10_000.0
    return F.when(at < test, "test").when(at < test + val, "val").otherwise("train")


def shuffled_places(df: DataFrame, label: str | None, key: Column, seed: int = SEED) -> DataFrame:
    """df with `_nth`, the place of each row in a seeded order within its class (in the whole table without a label), and
    `_size`, the class's rows. A null label is a class. Places are counted over range partitions of class and hash, so that
    a class of any size is exact and none passes through one task."""
    by = [F.col(f"`{label}`")] if label else []
    placed = numbered(df, [F.xxhash64(key, F.lit(seed)), key], "_nth", by)
    if not label:
        return placed.withColumn("_size", F.lit(placed.count()))
    sizes = placed.groupBy(by[0].alias("_class")).agg(F.count("*").alias("_size"))  # a row a class
    return placed.join(lookup_side(sizes), by[0].eqNullSafe(F.col("_class"))).drop("_class")


def stratified_split(df: DataFrame, label: str | None, key: Column, test: float = TEST_SIZE, val: float = VAL_SIZE, seed: int = SEED) -> DataFrame:
    """`split` with the same shares in every class, exact to a row: of n rows, n * test and n * val rounded (halves up)
    are test and val, as far as there are rows."""
    n_test, n_val = (F.floor(F.col("_size") * share + 0.5) for share in (test, val))
    split = F.when(F.col("_nth") < n_test, "test").when(F.col("_nth") < n_test + n_val, "val").otherwise("train")
    return shuffled_places(df, label, key, seed).withColumn("split", split).drop("_nth", "_size")


def stratified_folds(df: DataFrame, label: str | None, key: Column, folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """`fold` from 0: every fold has the same number of rows of each class, to one row."""
    return shuffled_places(df, label, key, seed + 1).withColumn("fold", F.pmod("_nth", F.lit(folds)).cast("int")).drop("_nth", "_size")


def prepare(df: DataFrame, dependent: str, predictors: list[str]) -> tuple[DataFrame, list[str]]:
    """(complete rows with label, feature columns): text is one-hot encoded; at least ten rows."""
    kinds = dict(df.dtypes)
    texts = [p for p in predictors if not is_numeric(kinds[p])]
    made, report = one_hot(df.select(*dict.fromkeys([*predictors, dependent])), texts)
    columns = [p for p in predictors if p not in texts] + [c for t in texts for c in report[t]["encoded"]]
    rows = model_rows(made, dependent, columns).withColumnRenamed(dependent, "label")
    if rows.limit(10).count() < 10:
        raise ValueError("under ten complete rows")
    return rows, columns


def models_for(classify: bool) -> list[str]:
    return ["random_forest", "logistic", "gradient_boosting", "neural_network"] if classify else ["random_forest", "ridge", "gradient_boosting", "neural_network"]


def build(name: str, classify: bool, columns: list[str], params: dict, classes: int = 2, seed: int = SEED):
    """An unfitted pipeline; the seed is always set."""
    from pyspark.ml import Pipeline
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    from quillstat.operators.models import NeuralRegressor, SoftmaxBoosting

    name, params = ALIASES.get(name, name), dict(params)
    steps = [VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    if name == "neural_network":
        if classify:
            layers = [len(columns), *params.pop("layers", [32]), classes]
            est = C.MultilayerPerceptronClassifier(layers=layers, seed=seed, **params)
        else:
            est = NeuralRegressor(seed=seed, **params)
    elif name == "random_forest":
        est = (C.RandomForestClassifier if classify else R.RandomForestRegressor)(seed=seed, **params)
    elif name == "gradient_boosting":
        if classify and classes > 2:  # Spark's own boosts two classes only
            est = SoftmaxBoosting(classes, **params)
        else:
            est = (C.GBTClassifier if classify else R.GBTRegressor)(seed=seed, **params)
    elif name == "logistic":
        est = C.LogisticRegression(**params)
    elif name in ("ridge", "linear"):
        est = R.LinearRegression(elasticNetParam=0.0, **params)
    else:
        raise ValueError(f"unknown model {name}")
    return Pipeline(stages=[*steps, est])


def evaluate(scored: DataFrame, classify: bool, classes: int = 2) -> dict[str, float | None]:
    """Metrics of rows with label and prediction (and probability), rounded to 4 places."""
    rows = scored.withColumnRenamed("label", "actual")
    if not classify:
        got = regression_metrics(rows).first().asDict()
    elif classes > 2:
        got = macro_metrics(rows).first().asDict()
    else:
        got = classification_metrics(rows).first().asDict()
        if "probability" in rows.columns:
            from pyspark.ml.functions import vector_to_array

            p = rows.select("actual", vector_to_array("probability")[1].alias("probability"))
            got["auc"] = auc(p).first()["auc"]
    return {k: round(v, 4) if isinstance(v, float) else v for k, v in got.items()}


def headline(metrics: dict, classify: bool) -> float:
    value = metrics.get("f1", metrics.get("accuracy")) if classify else metrics.get("r2")
    return float("-inf") if value is None else value


def candidates(name: str, method: str, iterations: int, seed: int = SEED) -> list[dict]:
    """Parameter settings to try: all for grid, a seeded sample for random (and bayesian, which is random here)."""
    grid = GRIDS.get(ALIASES.get(name, name), {})
    if method == "none" or not grid:
        return [{}]
    every = [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]
    return every if method == "grid" or len(every) <= iterations else random.Random(seed).sample(every, iterations)


def fold_scores(rows: DataFrame, name: str, classify: bool, columns: list[str], settings: list[dict], folds: int = FOLDS, classes: int = 2, seed: int = SEED, parallel: int = PARALLEL) -> list[list[float]]:
    """The score of each setting on each fold of `rows` (which have a `fold` column and should be cached). Every fit is a
    job of its own, `parallel` of them at the same time, as Spark's scheduler shares out their tasks."""

    def one(task: tuple[int, int]) -> float:
        at, k = task
        fitted = build(name, classify, columns, settings[at], classes, seed).fit(rows.filter(F.col("fold") != k))
        return headline(evaluate(fitted.transform(rows.filter(F.col("fold") == k)), classify, classes), classify)

    tasks = list(itertools.product(range(len(settings)), range(folds)))
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        got = list(pool.map(inheritable_thread_target(rows.sparkSession)(one), tasks))
    return [got[k * folds : (k + 1) * folds] for k in range(len(settings))]


def cross_validate(rows: DataFrame, name: str, classify: bool, columns: list[str], params: dict, folds: int = FOLDS, classes: int = 2, seed: int = SEED) -> dict[str, float]:
    scores = fold_scores(rows, name, classify, columns, [params], folds, classes, seed)[0]
    mean = sum(scores) / len(scores)
    return {"mean": mean, "std": (sum((s - mean) ** 2 for s in scores) / len(scores)) ** 0.5, "folds": folds}


def tune(rows: DataFrame, name: str, classify: bool, columns: list[str], method: str = "random", iterations: int = ITERATIONS, folds: int = FOLDS, classes: int = 2, seed: int = SEED, parallel: int = PARALLEL) -> dict:
    """{params, best_score, tried}: the setting with the best mean score over the folds of `rows`, the first of equals. A
    single setting is not tried, and has no score."""
    settings = candidates(name, method, iterations, seed)
    if len(settings) < 2:
        return {"params": settings[0], "best_score": None, "tried": 0}
    means = [sum(s) / len(s) for s in fold_scores(rows, name, classify, columns, settings, folds, classes, seed, parallel)]
    best = max(range(len(means)), key=means.__getitem__)
    return {"params": settings[best], "best_score": means[best], "tried": len(settings)}


def baselines(train: DataFrame, test: DataFrame, classify: bool, columns: list[str], classes: int = 2) -> dict[str, dict]:
    """The commonest class or the mean, and a linear model."""
    if classify:
        common = train.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").first()["label"]
    else:
        common = train.agg(F.avg("label").alias("m")).first()["m"]
    out = {"dummy": evaluate(test.withColumn("prediction", F.lit(float(common))), classify, classes)}
    simple = "logistic" if classify else "linear"
    out[simple] = evaluate(build(simple, classify, columns, {}, classes).fit(train).transform(test), classify, classes)
    return out


def experiment(df: DataFrame, dependent: str, predictors: list[str], models: list[str] | None = None, tuning: str = "random", iterations: int = ITERATIONS, folds: int = FOLDS, classify: bool | None = None, select_on: str = "test", validate: bool = True, test_size: float = TEST_SIZE, val_size: float = VAL_SIZE, seed: int = SEED) -> dict:
    """Split, baselines, a tuned and evaluated model of each kind, and the best by F1 or R2 on `select_on`.

    Splits and folds are stratified by class in a classification of any number of classes, and exact to a row; `seed`
    changes them. Models are tuned and cross-validated on the folds of the training rows only. One model's failure is
    reported beside the others' results.
    """
    rows, columns = prepare(df, dependent, predictors)
    classify = is_classification(rows, "label") if classify is None else classify
    classes = 2
    if classify:
        codes = numbered(rows.select(F.col("label").alias("_value")).distinct(), ["_value"], "_code")  # classes in their order, however many
        classes = max(2, codes.count())
        rows = rows.join(lookup_side(codes), F.col("label") == F.col("_value")).withColumn("label", F.col("_code").cast("double")).drop("_value", "_code")
    key, label = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), "label" if classify else None
    rows = stratified_split(rows, label, key, test_size, val_size, seed).persist()
    folded = stratified_folds(rows.filter("split = 'train'"), label, key, folds, seed).persist()
    try:
        train, val, test = (rows.filter(F.col("split") == s) for s in ("train", "val", "test"))
        report: dict = {"problem": "classification" if classify else "regression", "columns": columns, "split": {r["split"]: r["n"] for r in rows.groupBy("split").agg(F.count("*").alias("n")).collect()}}
        report["baselines"] = baselines(train, test, classify, columns, classes)
        report["models"], fitted = {}, {}
        for name in models or models_for(classify):
            try:
                result = tune(folded, name, classify, columns, tuning, iterations, folds, classes, seed)
                params = result["params"]
                model = build(name, classify, columns, params, classes, seed).fit(train)
                result |= {f"{s}_metrics": evaluate(model.transform(part), classify, classes) for s, part in (("train", train), ("val", val), ("test", test))}
                if validate:
                    result["cross_validation"] = cross_validate(folded, name, classify, columns, params, folds, classes, seed)
                report["models"][name], fitted[name] = result, model
            except Exception as e:  # reported, not hidden
                report["models"][name] = {"error": f"{type(e).__name__}: {e}"[:300]}
        report["best"] = best_model(report["models"], classify, select_on)
        report["fitted"] = fitted.get(report["best"])
        return report
    finally:
        folded.unpersist()
        rows.unpersist()


def best_model(models: dict[str, dict], classify: bool, select_on: str = "test") -> str | None:
    good = {n: headline(m[f"{select_on}_metrics"], classify) for n, m in models.items() if "error" not in m}
    return max(good, key=good.get) if good else None
