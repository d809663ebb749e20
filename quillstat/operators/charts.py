"""Chart-ready rows: counted, binned and thinned in Spark, so what is drawn is small whatever the table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.functions.ranks import numbered, quantiles

BINS, PIE_SLICES, POINTS = 10, 6, 500


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """bin, low, high, count: equal widths from least to greatest, the last bin closed, empty bins included."""
    x = F.col(f"`{column}`").cast("double")
    rows = df.select(x.alias("x")).filter("x is not null and not isnan(x)")
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).filter("lo is not null")
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(F.lit(1.0))
    ends = ends.withColumn("w", width)
    at = F.least(F.floor((F.col("x") - F.col("lo")) / F.col("w")), F.lit(bins - 1)).cast("int")
    counts = rows.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("count"))  # one row of ends
    frame = ends.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "w")
    return frame.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), F.coalesce("count", F.lit(0)).alias("count"))


def estimated_histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """bin, low, high, expected: what a normal curve with the column's mean and deviation would put in each bin."""
    x = F.col(f"`{column}`").cast("double")
    f = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.count(x).alias("n")).filter("s > 0")
    w = (F.col("hi") - F.col("lo")) / bins
    rows = f.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "*").withColumn("low", F.col("lo") + F.col("bin") * w).withColumn("high", F.col("low") + w)
    z = ((F.col("low") + F.col("high")) / 2 - F.col("m")) / F.col("s")
    density = F.exp(-z * z / 2) / (F.col("s") * F.sqrt(2 * F.pi()))
    return rows.select("bin", "low", "high", F.round(density * w * F.col("n")).cast("bigint").alias("expected"))


def residual_bins(n: int, variant: str = "default") -> int:
    """Bins for n residuals: the square root, from 5 to 20; the variant "ui" rounds it up and has no least number."""
    return min(math.ceil(n**0.5), 20) if variant == "ui" else min(max(int(n**0.5), 5), 20)


def box_plot(df: DataFrame, column: str) -> DataFrame:
    """low, q1, median, q3, high from true quartiles."""
    x = F.col(f"`{column}`").cast("double")
    return df.sparkSession.createDataFrame([tuple(quantiles(df, {column: x}, [0.0, 0.25, 0.5, 0.75, 1.0])[column])], "low double, q1 double, median double, q3 double, high double")


def slices(df: DataFrame, column: str, n: int = PIE_SLICES) -> DataFrame:
    """value, count of the commonest values."""
    return df.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count("*").alias("count")).filter("value is not null").orderBy(F.desc("count"), "value").limit(n)


def scatter(df: DataFrame, x: str, y: str, row_id: str, points: int = POINTS) -> DataFrame:
    """x, y of every k-th row, k making about `points` of them: rows whose id divides by the step. Where no row has a
    number in both columns, x is the row's place in the order of ids and only y must be a number."""
    number = {c: F.nanvl(F.expr(f"try_cast(`{c}` as double)"), F.lit(None).cast("double")) for c in (x, y)}
    got = df.agg(F.count("*").alias("n"), F.count_if(number[x].isNotNull() & number[y].isNotNull()).alias("both")).first()
    step = max(1, got["n"] // points)
    if got["both"]:
        return df.filter(F.pmod(F.col(row_id), F.lit(step)) == 0).select(number[x].alias("x"), number[y].alias("y")).dropna()
    placed = numbered(df.select(number[y].alias("y"), F.col(row_id).alias("_id")), ["_id"], "x")
    return placed.filter(F.pmod("x", F.lit(step)) == 0).select(F.col("x").cast("double").alias("x"), "y").dropna()


def typical_row(df: DataFrame, columns: list[str]) -> DataFrame:
    """The complete row whose sum of absolute values is the median one (of two middles the greater), as an example to
    predict; of equal ones the least."""
    size = sum((F.abs(F.col(f"`{c}`").cast("double")) for c in columns), F.lit(0.0))
    sized = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(c) for c in columns], size.alias("_size")).dropna()
    at = quantiles(sized, {"_size": F.col("_size")}, [0.5])["_size"][0]
    middle = sized.filter(F.col("_size") >= F.lit(at)).agg(F.min("_size").alias("_mid"))  # one row
    return sized.join(F.broadcast(middle), F.col("_size") == F.col("_mid")).orderBy(*columns).limit(1).select(*columns)


def example_prediction(df: DataFrame, predictors: list[str], coefficients: list[float], intercept: float, kind: str = "linear") -> dict | None:
    """{conditions: [{predictor, value, coef}], prediction, probability}: what a model of these coefficients says of the
    typical row. Without a complete row each predictor stands at its own median, or 0 without any value; a logistic
    model gives a probability."""
    if not coefficients or not predictors:
        return None
    found = typical_row(df, predictors).first()
    if found is None:
        medians = quantiles(df, {p: F.expr(f"try_cast(`{p}` as double)") for p in predictors}, [0.5])
        values = [medians[p][0] or 0.0 for p in predictors]
    else:
        values = [found[p] for p in predictors]
    slopes = [*coefficients, *[0.0] * len(predictors)][: len(predictors)]
    score = intercept + sum(c * v for c, v in zip(slopes, values, strict=True))
    if kind == "logistic":
        score = 1 / (1 + math.exp(-score)) if score >= 0 else math.exp(score) / (1 + math.exp(score))
    conditions = [{"predictor": p, "value": v, "coef": c} for p, v, c in zip(predictors, values, slopes, strict=True)]
    return {"conditions": conditions, "prediction": score, "probability": kind == "logistic"}


def importance_chart(ranking: DataFrame, top: int = 10) -> DataFrame:
    """feature, share: the inverse mean rank relative to the best, for the top features."""
    inverse = ranking.withColumn("inverse", 1 / F.col("mean_rank"))
    best = inverse.agg(F.max("inverse").alias("best"))
    return inverse.crossJoin(F.broadcast(best)).select("feature", (F.col("inverse") / F.col("best")).alias("share")).orderBy(F.desc("share"), "feature").limit(top)


def correlation_grid(pairs: DataFrame, names: list[str]) -> DataFrame:
    """name and one column a name: r of each pair, 1 on the diagonal, 0 where missing."""
    both = pairs.select("column_a", "column_b", "r").unionByName(pairs.select(F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "r"))
    wide = both.groupBy(F.col("column_a").alias("name")).pivot("column_b", names).agg(F.first("r"))
    frame = pairs.sparkSession.createDataFrame([(n,) for n in names], "name string").join(wide, "name", "left").na.fill(0.0, names)
    return frame.select("name", *[F.when(F.col("name") == n, 1.0).otherwise(F.col(f"`{n}`")).alias(n) for n in names])


def predicted_vs_actual(rows: DataFrame, points: int = POINTS) -> dict:
    """Points (actual, predicted), every k-th by a hash where there are more than `points`, and the diagonal over the
    range of both."""
    clean = rows.select(F.col("actual").cast("double").alias("actual"), F.col("prediction").cast("double").alias("predicted")).dropna()
    got = clean.agg(F.count("*").alias("n"), F.least(F.min("actual"), F.min("predicted")).alias("low"), F.greatest(F.max("actual"), F.max("predicted")).alias("high")).first()
    step = max(1, got["n"] // points)
    data = clean.filter(F.pmod(F.xxhash64("actual", "predicted"), F.lit(step)) == 0)
    return {"chart": "scatter", "title": "Predicted and actual values", "diagonal": None if got["low"] is None else {"x1": got["low"], "y1": got["low"], "x2": got["high"], "y2": got["high"]}, "data": data}


def attribution_chart(attributed: DataFrame, top: int = 15) -> DataFrame:
    """feature, mean_abs, percentage, rank of the features with the greatest mean attributions."""
    return attributed.filter(F.col("rank") <= top).orderBy("rank")


def model_comparison(report: dict) -> list[dict]:
    """One row a model, with its tuning score and test metrics."""
    return [{"model": n, "tuning_score": m.get("best_score"), **{k: v for k, v in m.get("test_metrics", {}).items()}} for n, m in report["models"].items() if "error" not in m]


def band(value: Column | float, good: float, fair: float):
    if isinstance(value, (int, float)):
        return "green" if value >= good else "amber" if value >= fair else "red"
    return F.when(value >= good, "green").when(value >= fair, "amber").otherwise("red")


def kpi_cards(metrics: dict, classify: bool) -> list[dict]:
    """Cards with a colour by how good each metric is."""
    limits = {"accuracy": (0.8, 0.6), "precision": (0.7, 0.5), "recall": (0.7, 0.5), "f1": (0.7, 0.5), "auc": (0.8, 0.6)} if classify else {"r2": (0.6, 0.4)}
    cards = [{"metric": k, "value": round(metrics[k], 4), "band": band(metrics[k], *v)} for k, v in limits.items() if metrics.get(k) is not None]
    return cards + [{"metric": k, "value": round(metrics[k], 4), "band": None} for k in ("rmse", "mae") if metrics.get(k) is not None]


def suggestions(request: dict, types: dict[str, str]) -> list[dict]:
    """Charts for a manual request."""
    out = []
    if request.get("mode", "manual") != "manual":
        return out
    for c in (request.get("descriptive") or {}).get("columns", []):
        if types.get(c) == "continuous":
            out.append({"chart": "histogram", "column": c, "title": f"How {c} is distributed"})
    inferential = request.get("inferential") or {}
    for a, b in inferential.get("correlationPairs") or []:
        out.append({"chart": "scatter", "x": a, "y": b, "title": f"{a} against {b}"})
    regression = inferential.get("regression") or {}
    for p in regression.get("predictors", []):
        out.append({"chart": "scatter", "x": p, "y": regression["dependent"], "title": f"{regression['dependent']} by {p}, with a trend line"})
    predictive = request.get("predictive") or {}
    kind = predictive.get("modelType") or ("logistic" if types.get(predictive.get("dependent")) == "binary" else None)
    if kind == "logistic":
        out.append({"chart": "confusion_matrix", "title": "Predicted and actual classes"})
    if kind == "timeseries":
        out.append({"chart": "line", "y": predictive["dependent"], "title": f"{predictive['dependent']} with its forecast"})
    return out
