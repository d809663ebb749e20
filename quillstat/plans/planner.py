"""Which analyses a table calls for, by rules on types and names; a callback may replace them."""

from __future__ import annotations

#: Words of a column name that make it a likely dependent.
TARGET_WORDS = ("price", "salary", "outcome", "result", "survived", "target", "label", "score", "revenue", "growth", "mortality", "diagnosis")
FOREST_ROWS, MANY_COLUMNS, MOST_PREDICTORS, MOST_PAIRS, SLICES = 500, 8, 5, 10, 6


def target_of(types: dict[str, str]) -> str | None:
    """The likely dependent: a column named like one, else the last continuous column, else the last binary one."""
    named = [c for c in types if any(w in c.lower() for w in TARGET_WORDS) and types[c] in ("continuous", "binary", "ordinal")]
    rest = [c for kind in ("continuous", "binary") for c in reversed(types) if types[c] == kind]
    return (named or rest or [None])[0]


def model_of(dependent: str, predictors: list[str], types: dict[str, str], rows: int) -> str:
    if types[dependent] == "binary":
        return "logistic"
    if rows > FOREST_ROWS and len(predictors) >= MANY_COLUMNS:
        return "randomforest"
    if len(predictors) > 1:
        return "multiple"
    if predictors and types[predictors[0]] == "datetime":
        return "timeseries"
    return "linear"


def charts_of(types: dict[str, str], distinct: dict[str, int], dependent: str | None, model: str | None) -> list[dict]:
    numbers = [c for c, k in types.items() if k == "continuous"]
    times = [c for c, k in types.items() if k == "datetime"]
    groups = [c for c, k in types.items() if k in ("categorical", "binary", "ordinal")]
    out = [{"chart": "histogram", "column": c} for c in numbers]
    out += [{"chart": "line", "x": t, "y": c} for t in times[:1] for c in numbers[:2]]
    out += [{"chart": "pie" if distinct.get(c, 0) < SLICES else "bar", "column": c} for c in groups]
    out += [{"chart": "scatter", "x": a, "y": b} for a, b in zip(numbers, numbers[1:], strict=False)]
    out += [{"chart": "boxplot", "x": g, "y": numbers[0]} for g in groups[:1] if numbers]
    if len(numbers) > 3:
        out.append({"chart": "heatmap", "series": numbers})
    if model == "logistic":
        out.append({"chart": "confusion_matrix", "column": dependent})
    return out


def plan(types: dict[str, str], distinct: dict[str, int], rows: int, profiler=None) -> dict:
    """A request for every sensible analysis. A profiler callback that fails or returns nothing leaves the rules."""
    if profiler:
        try:
            if made := profiler(types, distinct, rows):
                return made
        except Exception as e:  # the rules stand in, and say so
            return plan(types, distinct, rows) | {"note": f"the profiler failed: {e}"}
    numbers = [c for c, k in types.items() if k in ("continuous", "ordinal")]
    groups = [c for c, k in types.items() if k in ("categorical", "binary") and 2 <= distinct.get(c, 0) <= 15]
    continuous = [c for c, k in types.items() if k == "continuous"]
    pairs = [(a, b) for k, a in enumerate(numbers) for b in numbers[k + 1 :]][:MOST_PAIRS]
    tests = [{"type": "t-test" if distinct[g] == 2 else "anova", "columns": [c, g]} for g in groups[:2] for c in continuous[:2]]
    tests += [{"type": "chi-square", "columns": [a, b]} for a, b in zip(groups, groups[1:], strict=False)]
    dependent = target_of(types)
    predictors = [c for c in types if c != dependent and types[c] in ("continuous", "ordinal", "binary")][:MOST_PREDICTORS]
    predictive = None
    if dependent and predictors:
        predictive = {"dependent": dependent, "predictors": predictors, "modelType": model_of(dependent, predictors, types, rows)}
    return {
        "mode": "smart",
        "descriptive": {"columns": list(types)},
        "inferential": {"correlationPairs": pairs, "hypothesisTests": tests},
        "predictive": predictive,
        "charts": charts_of(types, distinct, dependent, predictive and predictive["modelType"]),
    }


def fallback(types: dict[str, str], only_continuous: bool = False) -> dict:
    """The least plan: describe all columns, with histograms."""
    drawn = [c for c, k in types.items() if not only_continuous or k == "continuous"]
    return {"mode": "smart", "descriptive": {"columns": list(types)}, "charts": [{"chart": "histogram", "column": c} for c in drawn]}


def request_of(found: dict, charts: list[dict] | None = None, relations: list[dict] | None = None) -> dict:
    """A request from an analysis map {descriptiveColumns, correlationPairs, hypothesisTests, dependentVariable, predictors,
    modelType}: what is described are the map's columns and then those that a chart shows; the first suggested relation
    is modelled, or else the map's own."""
    dependent = found.get("dependentVariable")
    own = [{"dependent": dependent, "predictors": found.get("predictors") or [], "modelType": found.get("modelType")}] if dependent else []
    first = next(iter(relations or own), None)
    drawn = [c[k] for c in charts or [] for k in ("column", "x", "y") if c.get(k)]
    return {
        "mode": "smart",
        "descriptive": {"columns": list(dict.fromkeys([*found.get("descriptiveColumns", []), *drawn]))},
        "inferential": {
            "correlationPairs": found.get("correlationPairs") or [],
            "hypothesisTests": found.get("hypothesisTests") or [],
            "regression": first and {"dependent": first["dependent"], "predictors": first["predictors"]},
        },
        "predictive": first and {"dependent": first["dependent"], "predictors": first["predictors"], "modelType": first.get("modelType")},
        "charts": charts or [],
    }
