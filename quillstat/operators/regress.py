"""Predictive models: selection, least squares, logistic, polynomial, time series, forest."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.functions.linalg import Fit, complete, moments, ols, vif
from quillstat.functions.ranks import numbered, spread
from quillstat.operators.infer import binary_number

MIN_ROWS, TEST_ROWS, TEST_PERCENT, SEED = 10, 30, 20, 42
FOREST_TREES, FOREST_DEPTH, FOREST_ROWS, SERIES_ROWS, FORECAST_STEPS = 50, 10, 30, 5, 5


def model_rows(df: DataFrame, dependent: str, predictors: list[str]) -> DataFrame:
    """Complete rows as doubles, boolean words included."""
    kinds = dict(df.dtypes)
    return complete(df.select(*[binary_number(c, kinds[c]).alias(c) for c in dict.fromkeys([*predictors, dependent])]), list(dict.fromkeys([*predictors, dependent])))


def in_test(key: Column, percent: int = TEST_PERCENT) -> Column:
    """A portable split: the same rows in any engine, at any partitioning."""
    return F.pmod(key.cast("bigint") * F.lit(2654435761), F.lit(100)) < percent


def row_key(columns: list[str]) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), F.lit(1_000_000))


def select_model(df: DataFrame, dependent: str, predictors: list[str], types: dict[str, str]) -> str:
    """logistic for a binary dependent, multiple for several predictors, timeseries for a datetime one; for one
    predictor polynomial where a line explains under 0.6 and a parabola over 0.1 more, else linear."""
    if types.get(dependent) == "binary":
        return "logistic"
    if len(predictors) > 1:
        return "multiple"
    if types.get(predictors[0]) == "datetime":
        return "timeseries"
    rows = model_rows(df, dependent, predictors).withColumn("_square", F.col(f"`{predictors[0]}`") ** 2)
    m = moments(rows, [predictors[0], "_square", dependent])
    if m.n < MIN_ROWS:
        return "linear"
    line, curve = ols(m, dependent, [predictors[0]]).r_squared or 0.0, ols(m, dependent, [predictors[0], "_square"]).r_squared or 0.0
    return "polynomial" if line < 0.6 and curve > line + 0.1 else "linear"


@dataclass
class Model:
    """A fitted model: what it is, its numbers, and how it predicts in Spark."""

    kind: str
    dependent: str
    predictors: list[str]
    coefficients: list[float]
    intercept: float
    metrics: dict[str, float | None]
    test_metrics: dict[str, float | None] = field(default_factory=dict)
    vif: dict[str, float] = field(default_factory=dict)
    importance: dict[str, float] = field(default_factory=dict)
    note: str | None = None
    transform: object = None

    def predicted(self, rows: DataFrame) -> DataFrame:
        """rows with `prediction` (and `probability` for a classifier)."""
        return self.transform(rows)


def regression_metrics(rows: DataFrame, actual: str = "actual", predicted: str = "prediction") -> DataFrame:
    """One row: n, r2, mse, rmse, mae, mape."""
    y, p = F.col(actual), F.col(predicted)
    got = rows.agg(F.count("*").alias("n"), F.avg((y - p) ** 2).alias("mse"), F.var_pop(y).alias("v"), F.avg(F.abs(y - p)).alias("mae"), F.avg(F.when(y != 0, F.abs((y - p) / y)) * 100).alias("mape"))
    return got.select("n", F.when(F.col("v") > 0, 1 - F.col("mse") / F.col("v")).alias("r2"), "mse", F.sqrt("mse").alias("rmse"), "mae", "mape")


def classification_metrics(rows: DataFrame, actual: str = "actual", predicted: str = "prediction") -> DataFrame:
    """One row: n, accuracy, precision, recall, f1, mcc of a binary classifier, from its confusion counts."""
    y, p = F.col(actual) == 1, F.col(predicted) == 1
    c = rows.agg(F.count_if(y & p).cast("double").alias("tp"), F.count_if(~y & p).cast("double").alias("fp"), F.count_if(y & ~p).cast("double").alias("fn"), F.count_if(~y & ~p).cast("double").alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    return c.select(
        (tp + fp + fn + tn).cast("bigint").alias("n"),
        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        F.coalesce(F.try_divide(tp, tp + fp), zero).alias("precision"),
        F.coalesce(F.try_divide(tp, tp + fn), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero).alias("f1"),
        F.coalesce(F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), zero).alias("mcc"),
    )


def macro_metrics(rows: DataFrame, actual: str = "actual", predicted: str = "prediction") -> DataFrame:
    """One row: accuracy and the unweighted means of precision, recall and f1 over the classes."""
    cells = rows.groupBy(F.col(actual).alias("y"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    by = cells.select(F.inline(F.array(F.struct(F.col("y").alias("class"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("real"), F.lit(0).cast("bigint").alias("said")), F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("hit"), F.lit(0).cast("bigint").alias("real"), F.col("n").alias("said")))))
    per = by.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("hit", "real", "said")])
    precision, recall = F.coalesce(F.try_divide("hit", "said"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "real"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("hit"), F.col("real") + F.col("said")), F.lit(0.0))
    return per.agg((F.sum("hit") / F.sum("real")).alias("accuracy"), F.avg(precision).alias("precision"), F.avg(recall).alias("recall"), F.avg(f1).alias("f1"))


def auc(rows: DataFrame, actual: str = "actual", score: str = "probability") -> DataFrame:
    """One row (auc): the rank-sum statistic with average ranks, on the histogram of scores."""
    from quillstat.functions.ranks import average_ranks

    counts = rows.groupBy(F.col(score).cast("double").alias("value")).agg(F.count_if(F.col(actual) == 1).alias("pos"), F.count_if(F.col(actual) != 1).alias("neg"))
    ranks = average_ranks(rows, score)
    got = counts.join(ranks, "value").agg(F.sum(F.col("pos") * F.col("rank")).alias("s"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    return got.select(F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, (F.col("p") * F.col("q")).cast("double")).alias("auc"))


def _linear_model(kind: str, fit: Fit, rows: DataFrame, expand) -> Model:
    m = Model(kind, fit.dependent, fit.predictors, fit.coefficients, fit.intercept, {"r2": fit.r_squared, "adjusted_r2": fit.adjusted_r_squared, "mse": fit.mse, "rmse": fit.rmse, "n": fit.n}, vif=fit.vif, note=fit.note)
    m.transform = lambda data: expand(data).withColumn("prediction", fit.predict())
    return m


def linear(df: DataFrame, dependent: str, predictors: list[str], kind: str | None = None, expand=lambda d: d) -> Model:
    """Least squares on all rows; test metrics come from a fit on 80 % of at least 30 rows."""
    source = model_rows(df, dependent, predictors)
    rows = expand(source)
    columns = [c for c in rows.columns if c != dependent]
    m = moments(rows, [*columns, dependent])
    if m.n < MIN_ROWS:
        raise ValueError(f"{m.n} complete rows; a regression needs {MIN_ROWS}")
    fit = ols(m, dependent, columns)
    fit.vif = vif(m, columns) if len(columns) > 1 and kind != "polynomial" else {}
    out = _linear_model(kind or ("linear" if len(columns) == 1 else "multiple"), fit, rows, expand)
    if m.n >= TEST_ROWS:
        marked = rows.withColumn("_test", in_test(row_key(rows.columns)))
        part = ols(moments(marked.filter("not _test"), [*columns, dependent]), dependent, columns)
        scored = marked.filter("_test").select(F.col(f"`{dependent}`").alias("actual"), part.predict().alias("prediction"))
        out.test_metrics = regression_metrics(scored).first().asDict()
    return out


def polynomial(df: DataFrame, dependent: str, predictor: str, degree: int = 2) -> Model:
    """Powers 1..degree of one predictor; the leading 0 among the coefficients is that of the constant column."""
    def expand(data: DataFrame) -> DataFrame:
        return data.withColumns({f"{predictor}_{k}": F.col(f"`{predictor}`") ** k for k in range(2, degree + 1)})

    out = linear(df, dependent, [predictor], "polynomial", expand)
    out.coefficients = [0.0, *out.coefficients]
    return out


def logistic(df: DataFrame, dependent: str, predictors: list[str], c: float = 100.0, rounds: int = 50) -> Model:
    """L2-penalised logistic regression by Newton steps; each step aggregates a gradient and a Hessian of size
    p + 1. More than two classes are reduced to the two commonest, the commonest being 0."""
    rows = model_rows(df, dependent, predictors)
    found = rows.groupBy(F.col(f"`{dependent}`").alias("y")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y").limit(3).collect()
    if len(found) < 2:
        raise ValueError("one class only")
    zero, one = (found[0]["y"], found[1]["y"]) if len(found) > 2 else sorted(r["y"] for r in found)
    rows = rows.filter(F.col(f"`{dependent}`").isin(zero, one)).withColumn("_y", (F.col(f"`{dependent}`") == one).cast("double"))
    center = moments(rows, predictors)
    spread = np.sqrt(np.maximum(np.diag(center.cross) / max(center.n, 1), 1e-300))
    z = [(F.col(f"`{p}`") - float(m)) / float(s) for p, m, s in zip(predictors, center.mean, spread, strict=True)] + [F.lit(1.0)]
    d = len(z)
    points = rows.select(F.array(*z).alias("z"), "_y").persist()
    w = np.zeros(d)
    penalty = np.append(1 / (c * spread**2), 0.0)  # the penalty is on the coefficients of unscaled columns
    try:
        for _ in range(rounds):
            odds = F.lit(0.0)
            for k in range(d):
                odds = odds + F.col("z")[k] * float(w[k])
            p = 1 / (1 + F.exp(-odds))
            staged = points.select("z", (F.col("_y") - p).alias("e"), (p * (1 - p)).alias("v"))
            pairs = [(i, j) for i in range(d) for j in range(i, d)]
            got = staged.agg(*[F.sum(F.col("e") * F.col("z")[k]).alias(f"g{k}") for k in range(d)], *[F.sum(F.col("v") * F.col("z")[i] * F.col("z")[j]).alias(f"h{i}_{j}") for i, j in pairs]).first()
            grad = np.array([got[f"g{k}"] for k in range(d)]) - penalty * w
            hess = np.diag(penalty + 1e-9)
            for i, j in pairs:
                hess[i, j] += got[f"h{i}_{j}"]
                if i != j:
                    hess[j, i] += got[f"h{i}_{j}"]
            step = np.linalg.solve(hess, grad)
            w += np.clip(step, -10, 10)
            if np.abs(step).max() < 1e-8:
                break
    finally:
        points.unpersist()
    coefficients = w[:-1] / spread
    intercept = float(w[-1] - coefficients @ center.mean)
    odds = sum((F.col(f"`{p}`") * float(b) for p, b in zip(predictors, coefficients, strict=True)), F.lit(intercept))
    out = Model("logistic", dependent, predictors, coefficients.tolist(), intercept, {})
    out.transform = lambda data: data.withColumn("probability", 1 / (1 + F.exp(-odds))).withColumn("prediction", F.when(F.col("probability") > 0.5, float(one)).otherwise(float(zero)))
    scored = out.transform(rows).select(F.col("_y").alias("actual"), (F.col("probability") > 0.5).cast("double").alias("prediction"), "probability", F.col(f"`{dependent}`"), *[F.col(f"`{p}`") for p in predictors if p != dependent])
    log = F.log(F.greatest(F.when(F.col("actual") == 1, F.col("probability")).otherwise(1 - F.col("probability")), F.lit(1e-300)))
    got = scored.agg(F.sum(log).alias("ll"), F.avg("actual").alias("share"), F.count("*").alias("n")).first()
    base = got["n"] * (got["share"] * np.log(got["share"]) + (1 - got["share"]) * np.log(1 - got["share"]))
    out.metrics = classification_metrics(scored).first().asDict() | {"mcfadden_r2": 1 - got["ll"] / base}
    test = scored.filter(in_test(row_key([dependent, *predictors])))
    out.test_metrics = classification_metrics(test).first().asDict() | {"auc": auc(test).first()["auc"]}
    return out


def timeseries(df: DataFrame, dependent: str, order: list, steps: int = FORECAST_STEPS) -> tuple[Model, DataFrame]:
    """A line over the row number in time order, and a forecast with 95 % bounds: (model, label, predicted, lower,
    upper). Rows without a value go before the rest is numbered, in range partitions."""
    value = F.nanvl(F.expr(f"try_cast(`{dependent}` as double)"), F.lit(None).cast("double"))
    rows = complete(numbered(df.filter(value.isNotNull()), order, "_t"), ["_t", dependent])
    m = moments(rows, ["_t", dependent])
    if m.n < SERIES_ROWS:
        raise ValueError(f"{m.n} rows; a series needs {SERIES_ROWS}")
    fit = ols(m, dependent, ["_t"])
    out = _linear_model("timeseries", fit, rows, lambda d: d)
    spread = float(np.sqrt((fit.mse or 0.0) * m.n / (m.n - 1)))
    future = df.sparkSession.range(1, steps + 1).select(F.concat(F.lit("Period "), (F.col("id") + m.n).cast("string")).alias("label"), (fit.intercept + fit.coefficients[0] * (F.col("id") + m.n - 1)).alias("predicted"))
    return out, future.withColumns({"lower": F.col("predicted") - 1.96 * spread, "upper": F.col("predicted") + 1.96 * spread})


def random_forest(df: DataFrame, dependent: str, predictors: list[str], trees: int = FOREST_TREES, depth: int = FOREST_DEPTH, seed: int = SEED) -> Model:
    """A classifier for up to two classes, else a regressor; needs at least 30 rows. Rows are dealt out before the trees
    grow, as each task holds its rows with their counts in every tree."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import RandomForestRegressor

    rows = model_rows(df, dependent, predictors).withColumn("_test", in_test(row_key([*predictors, dependent])))
    facts = rows.agg(F.count("*").alias("n"), F.count_distinct(F.col(f"`{dependent}`")).alias("u"), F.min(f"`{dependent}`").alias("low")).first()
    if facts["n"] < FOREST_ROWS:
        raise ValueError(f"{facts['n']} complete rows; a forest needs {FOREST_ROWS}")
    classify = facts["u"] <= 2
    target = (F.col(f"`{dependent}`") != facts["low"]).cast("double") if classify else F.col(f"`{dependent}`")
    rows = spread(rows.withColumn("label", target), facts["n"], [*predictors, dependent])
    made = VectorAssembler(inputCols=predictors, outputCol="_features").transform(rows)
    maker = RandomForestClassifier if classify else RandomForestRegressor
    fitted = maker(featuresCol="_features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(made.filter("not _test"))
    out = Model("randomforest", dependent, predictors, [], 0.0, {"n": facts["n"]})
    out.importance = {p: round(float(v), 4) for p, v in zip(predictors, fitted.featureImportances.toArray(), strict=True)}

    def transform(data: DataFrame) -> DataFrame:
        got = fitted.transform(VectorAssembler(inputCols=predictors, outputCol="_features").transform(data))
        return got.withColumn("probability", vector_to_array("probability")[1]).drop("rawPrediction", "_features") if classify else got.drop("_features")

    out.transform = transform
    metrics = classification_metrics if classify else regression_metrics
    for name, part in (("metrics", made.filter("not _test")), ("test_metrics", made.filter("_test"))):
        setattr(out, name, metrics(transform(part.drop("_features")).select(F.col("label").alias("actual"), "prediction")).first().asDict())
    return out


def fit_model(df: DataFrame, dependent: str, predictors: list[str], kind: str, order: list | None = None) -> tuple[Model, DataFrame | None]:
    """The named model; a line or parabola over several predictors becomes a multiple regression, and is named so."""
    if kind == "timeseries":
        return timeseries(df, dependent, order or predictors)
    if kind == "logistic":
        return logistic(df, dependent, predictors), None
    if kind == "randomforest":
        return random_forest(df, dependent, predictors), None
    if kind == "polynomial" and len(predictors) == 1:
        return polynomial(df, dependent, predictors[0]), None
    return linear(df, dependent, predictors), None
