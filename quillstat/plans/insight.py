"""One report of all explanations of a fitted model, and one set of all its charts."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.operators import attribute, charts, explain, training
from quillstat.plans import translate

SHOWN = 5


def _ranked(rows: DataFrame, value: str, method: str) -> DataFrame:
    return rows.select(F.lit(method).alias("method"), "feature", F.col("rank").cast("int").alias("rank"), F.col(value).cast("double").alias("value"))


def explanation_report(fitted, train: DataFrame, test: DataFrame, columns: list[str], classify: bool, classes: int = 2, name: str = "model", repeats: int = explain.REPEATS, grid: int = explain.PDP_GRID) -> dict:
    """{methods, ranking, consensus, top, summary} of a pipeline that `training.build` made and fitted.

    Built-in importance of trees, permutation importance on the test rows, additive attributions of trees and lines
    over all training rows, coefficients of lines, a local fit around the first test row, and partial dependence of the
    features that rank highest. A method that the model has no meaning for is left out. Frames stay in Spark; each has
    a row a feature, or a point of a curve.
    """
    spark, last = train.sparkSession, fitted.stages[-1]
    methods: dict = {}
    if hasattr(last, "featureImportances"):
        rows = explain.importance_rows(dict(zip(columns, last.featureImportances.toArray().tolist(), strict=True)))
        methods["builtin"] = spark.createDataFrame([(x["feature"], x["importance"], x["rank"]) for x in rows], "feature string, importance double, rank int")

    def score(rows: DataFrame) -> float:
        return training.headline(training.evaluate(fitted.transform(rows), classify, classes), classify)

    methods["permutation"] = explain.permutation_importance(test.select(*columns, "label"), columns, score, repeats)
    ready = train.select(*columns, "label")
    for stage in fitted.stages[:-1]:
        ready = stage.transform(ready)
    if hasattr(last, "featureImportances"):
        made, base = attribute.tree_attributions(ready, columns, last, classify, vector_to_array("features"))
        methods["attributions"], methods["attribution_base"] = attribute.mean_attributions(made, columns), base
    slopes = getattr(last, "coefficients", None) if not (classify and classes > 2) else None
    if slopes is not None and fitted.stages[1].__class__.__name__ == "StandardScalerModel":
        width = fitted.stages[1].std.toArray()
        own = [float(s / w) if w else 0.0 for s, w in zip(slopes.toArray(), width, strict=True)]
        methods["coefficients"] = explain.coefficient_rows(columns, own, classify)
        means = explain.linear_attributions(ready, columns, own).collect()  # a row a feature
        total = sum(r["mean_abs"] for r in means) or 1.0
        methods["attributions"] = spark.createDataFrame([(r["feature"], r["mean_abs"], 100 * r["mean_abs"] / total, k + 1) for k, r in enumerate(means)], "feature string, mean_abs double, percentage double, rank int")
    one = test.select(*columns).orderBy(*columns).first()
    if one is not None and not classify:
        methods["local"] = explain.local_surrogate(ready.select(*columns), one.asDict(), columns, fitted.transform)
    ranking = _ranked(methods["permutation"], "mean", "permutation")
    for method, value in (("builtin", "importance"), ("attributions", "mean_abs")):
        if method in methods:
            ranking = ranking.unionByName(_ranked(methods[method], value, method))
    if "coefficients" in methods:
        ranking = ranking.unionByName(spark.createDataFrame([("coefficients", x["feature"], x["rank"], abs(x["coefficient"])) for x in methods["coefficients"]], ranking.schema))
    consensus = explain.consensus(ranking)
    top = [r["feature"] for r in consensus.orderBy("position").limit(SHOWN).collect()]
    if not classify:
        methods["partial_dependence"] = explain.partial_dependence(train.select(*columns), top[: explain.PDP_FEATURES], fitted.transform, grid)
    return {"methods": methods, "ranking": ranking, "consensus": consensus, "top": top, "summary": explain.summary(name, top, classify)}


def all_charts(explained: dict, report: dict, scored: DataFrame | None = None, forecast: DataFrame | None = None, classify: bool = False) -> dict:
    """Every chart of a model: importance, attributions, dependence, comparison, figures, and of scored rows (actual,
    prediction) residuals and predictions; of a forecast its bounds. Data are frames or short lists."""
    methods = explained["methods"]
    best = report["models"].get(report.get("best") or "", {})
    out = {
        "featureImportance": {"chart": "bar", "title": "Importance, by all methods", "data": charts.importance_chart(explained["consensus"])},
        "shapSummary": {"chart": "bar", "title": "Mean attribution of each feature", "data": charts.attribution_chart(methods["attributions"]) if "attributions" in methods else None},
        "partialDependence": {"chart": "line", "title": "Mean prediction by feature", "data": methods.get("partial_dependence")},
        "modelComparison": {"chart": "bar", "title": "Models compared", "data": charts.model_comparison(report)},
        "businessDashboard": {"chart": "cards", "title": "Key figures", "data": charts.kpi_cards(best.get("test_metrics", {}), classify)},
    }
    if scored is not None:
        residuals = scored.select((F.col("actual") - F.col("prediction")).alias("residual"))
        out["residuals"] = {"chart": "histogram", "title": "Residuals", "data": charts.histogram(residuals, "residual", charts.residual_bins(scored.count()))}
        out["predictedVsActual"] = charts.predicted_vs_actual(scored)
    if forecast is not None:
        out["forecast"] = {"chart": "area_line", "title": "Forecast with 95 % bounds", "series": ["upper", "predicted", "lower"], "data": forecast}
    return out


def words(report: dict, dependent: str, mean: float | None = None, deviation: float | None = None) -> dict:
    """The best model's metrics in plain words."""
    metrics = report["models"].get(report.get("best") or "", {}).get("test_metrics", {})
    if report.get("problem") == "classification":
        return translate.classification_words(metrics, dependent)
    return translate.regression_words(metrics, dependent, mean, deviation)
