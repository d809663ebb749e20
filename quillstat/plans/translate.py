"""Results in plain words: quality bands of metrics, and sentences made from them."""

from __future__ import annotations

#: Lower bounds of each band, best first.
R2_BANDS = ((0.8, "excellent"), (0.6, "good"), (0.4, "moderate"), (0.2, "weak"))
RMSE_PERCENT_BANDS = ((5, "very precise"), (15, "precise"), (30, "rough"))
ACCURACY_BANDS = ((0.9, "excellent"), (0.8, "good"), (0.7, "fair"), (0.6, "weak"))
RATE_BANDS = ((0.85, "high"), (0.7, "acceptable"), (0.5, "low"))
AUC_BANDS = ((0.9, "excellent"), (0.8, "good"), (0.7, "fair"), (0.6, "weak"))
IMPORTANCE_BANDS = ((30, "dominant"), (15, "major"), (5, "moderate"))


def band(value: float, bands, otherwise: str) -> str:
    return next((name for low, name in bands if value >= low), otherwise)


def error_band(percent: float) -> str:
    return next((name for high, name in RMSE_PERCENT_BANDS if percent <= high), "very rough")


def confidence(score: float) -> str:
    return "high" if score >= 0.7 else "medium" if score >= 0.4 else "low"


def regression_words(metrics: dict, dependent: str, mean: float | None = None, deviation: float | None = None) -> dict:
    """quality, confidence and insights for r2 and rmse."""
    insights, r2 = [], metrics.get("r2")
    quality = band(r2, R2_BANDS, "poor") if r2 is not None else "unknown"
    if r2 is not None:
        insights.append(f"The model explains {100 * r2:.1f} % of the variation of {dependent}: {quality}.")
    rmse = metrics.get("rmse")
    if rmse is not None and mean:
        percent = 100 * rmse / abs(mean)
        insights.append(f"A typical error is {rmse:.4g}, {percent:.1f} % of the mean: {error_band(percent)}.")
    if rmse is not None and deviation:
        ratio = rmse / deviation
        insights.append(f"The error is {ratio:.2f} standard deviations, " + ("well under the natural spread." if ratio < 0.5 else "under the natural spread." if ratio < 1 else "no better than guessing the mean."))
    return {"quality": quality, "confidence": confidence(r2) if r2 is not None else "low", "insights": insights, "summary": " ".join(insights[:4])}


def classification_words(metrics: dict, dependent: str, prevalence: float | None = None) -> dict:
    insights = []
    accuracy = metrics.get("accuracy")
    quality = band(accuracy, ACCURACY_BANDS, "poor") if accuracy is not None else "unknown"
    if accuracy is not None:
        insights.append(f"{100 * accuracy:.1f} % of the cases of {dependent} are classified rightly: {quality}.")
    for name, what in (("precision", "of those called positive are"), ("recall", "of the positive are found"), ("f1", "is the balance of both")):
        if metrics.get(name) is not None:
            insights.append(f"{100 * metrics[name]:.1f} % {what}: {band(metrics[name], RATE_BANDS, 'poor')}.")
    if metrics.get("auc") is not None:
        insights.append(f"Ranking quality (AUC) is {metrics['auc']:.3f}: {band(metrics['auc'], AUC_BANDS, 'poor')}.")
    if prevalence is not None:
        insights.append(f"{100 * prevalence:.1f} % are positive: {'balanced' if 30 < 100 * prevalence < 70 else 'imbalanced'} classes.")
    scores = [metrics[k] for k in ("f1", "auc") if metrics.get(k) is not None]
    return {"quality": quality, "confidence": confidence(sum(scores) / len(scores)) if scores else "low", "insights": insights, "summary": " ".join(insights[:4])}


def importance_words(importance: dict[str, float], dependent: str, top: int = 5) -> list[dict]:
    total = sum(importance.values()) or 1.0
    ranked = sorted(importance.items(), key=lambda kv: -kv[1])[:top]
    rows = [(f, 100 * v / total) for f, v in ranked]
    return [{"feature": f, "percentage": round(p, 2), "impact": (b := band(p, IMPORTANCE_BANDS, "minor")), "text": f"{f} has a {b} influence on {dependent}."} for f, p in rows]


def recommendations(words: dict, metrics: dict, features: list[dict]) -> list[str]:
    """Advice by rules on quality, leading and idle features, precision and recall."""
    out = []
    if words["quality"] in ("poor", "weak"):
        out.append("Collect more rows or more telling columns before relying on the predictions.")
    elif words["quality"] in ("excellent", "good"):
        out.append("The model can support decisions; keep checking it on new data.")
    if features:
        out.append(f"Watch {features[0]['feature']} first: it moves the prediction most.")
        idle = [f["feature"] for f in features if f["percentage"] < 1]
        if idle:
            out.append(f"Consider leaving out {', '.join(idle)}: hardly any influence.")
    if metrics.get("precision") is not None and metrics["precision"] < 0.7:
        out.append("Raise the decision threshold to call fewer cases positive by mistake.")
    if metrics.get("recall") is not None and metrics["recall"] < 0.7:
        out.append("Lower the decision threshold to find more of the positive cases.")
    return out


def result_summary(rows: int, columns: int, described: list[dict], correlations: list[dict], tests: list[dict], model: dict | None) -> str:
    """A summary of an analysis from its results alone."""
    parts = [f"The table has {rows} rows and {columns} columns."]
    skewed = [d["column"] for d in described if abs(d.get("skewness") or 0) >= 1]
    if skewed:
        parts.append(f"Highly skewed: {', '.join(skewed)}.")
    strong = [f"{c['column_a']} and {c['column_b']} (r = {c['r']:.2f})" for c in correlations if abs(c["r"]) >= 0.7]
    if strong:
        parts.append(f"Strongly related: {'; '.join(strong)}.")
    found = [f"{t['test']} on {' and '.join(t['columns'])} (p = {t['p_value']:.3g})" for t in tests if t["significant"]]
    if found:
        parts.append(f"Significant: {'; '.join(found)}.")
    if model:
        parts.append(f"A {model['kind']} model was fitted to {model['dependent']}.")
    return " ".join(parts)


def model_words(kind: str, dependent: str, predictors: list[str], coefficients: list[float], intercept: float) -> str:
    """One sentence on what a fitted model says."""
    terms = " ".join(f"{'+' if c >= 0 else '-'} {abs(c):.4g} x {p}" for p, c in zip(predictors, coefficients, strict=False))
    if kind == "logistic":
        return f"The log-odds of {dependent} are {intercept:.4g} {terms}."
    if kind == "timeseries":
        return f"{dependent} moves by {coefficients[0]:+.4g} a period."
    if kind == "randomforest":
        return f"{dependent} is predicted by many trees over {', '.join(predictors)}."
    return f"{dependent} = {intercept:.4g} {terms}."
