"""The JSON-style request and its three configurations, checked when made."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

MODES = ("smart", "manual")
MODEL_TYPES = ("linear", "polynomial", "logistic", "multiple", "timeseries", "randomforest")


def _checked(value, allowed, what: str) -> None:
    if value is not None and value not in allowed:
        raise ValueError(f"{what} is {value!r}; it must be one of {', '.join(allowed)}")


class _FromJson:
    @classmethod
    def of(cls, given: dict | None):
        """From a dict; unknown keys are refused."""
        given = dict(given or {})
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**given)


@dataclass
class AnalysisRequest(_FromJson):
    mode: str = "manual"
    descriptive: dict | None = None
    inferential: dict | None = None
    predictive: dict | None = None
    charts: list | None = None
    note: str | None = None

    def __post_init__(self):
        _checked(self.mode, MODES, "mode")
        if self.descriptive is not None and not self.descriptive.get("columns"):
            raise ValueError("descriptive needs columns")
        if self.predictive is not None:
            _checked(self.predictive.get("modelType"), MODEL_TYPES, "modelType")
            if not self.predictive.get("dependent") or not self.predictive.get("predictors"):
                raise ValueError("predictive needs a dependent and predictors")


@dataclass
class PreprocessingConfig(_FromJson):
    missingStrategy: dict | None = None
    advancedImputation: str | None = None
    outlierColumns: list | None = None
    outlierMethod: str = "iqr"
    outlierAction: str | None = None
    outlierFactor: float | None = None
    standardizeCase: str | None = None
    standardizeColumns: list | None = None
    stateColumns: list | None = None
    stateFormat: str = "full"
    dateColumns: list | None = None
    parseDates: bool = False
    typoCorrections: dict | None = None
    typoColumns: list | None = None
    removeExactDupes: bool = False
    removeFuzzyDupes: bool = False
    fuzzyColumns: list | None = None
    fuzzyThreshold: float = 0.9

    def __post_init__(self):
        _checked(self.advancedImputation, ("knn", "iterative"), "advancedImputation")
        _checked(self.outlierMethod, ("iqr", "zscore"), "outlierMethod")
        _checked(self.outlierAction, ("clip", "remove", "log", "sqrt", "none"), "outlierAction")
        _checked(self.standardizeCase, ("lower", "upper", "title", "capitalize", "none"), "standardizeCase")
        _checked(self.stateFormat, ("full", "abbrev"), "stateFormat")


@dataclass
class FeatureConfig(_FromJson):
    encodingStrategy: str | None = None
    encodingColumns: list | None = None
    ordinalMaps: dict | None = None
    scalingMethod: str | None = None
    scalingColumns: list | None = None
    scalingExclude: list | None = None
    datetimeColumns: list | None = None
    datetimeFeatures: list | None = None
    ratioPairs: list | None = None
    interactionPairs: list | None = None
    aggregationColumns: list | None = None
    aggregationGroupBy: str | None = None
    removeCorrelated: bool = False
    correlationThreshold: float = 0.95
    targetCorrelationFilter: bool = False
    targetCorrelationThreshold: float = 0.05
    applyVifFilter: bool = False
    vifThreshold: float = 10.0
    applyLassoSelection: bool = False
    lassoAlpha: float = 0.01
    applyPca: bool = False
    pcaVarianceThreshold: float = 0.95
    applyFeatureImportance: bool = False
    featureImportanceTopK: int | None = None

    def __post_init__(self):
        _checked(self.encodingStrategy, ("auto", "onehot", "target", "ordinal"), "encodingStrategy")
        _checked(self.scalingMethod, ("standard", "minmax"), "scalingMethod")


@dataclass
class TrainingConfig(_FromJson):
    enabled: bool = False
    problemType: str | None = None
    models: list | None = None
    tuningMethod: str = "random"
    tuningIterations: int = 15
    cvFolds: int = 5
    testSize: float = 0.2
    valSize: float = 0.15
    randomSeed: int = 42

    def __post_init__(self):
        _checked(self.problemType, ("classification", "regression"), "problemType")
        _checked(self.tuningMethod, ("grid", "random", "bayesian", "none"), "tuningMethod")


@dataclass
class Analysis:
    """What an analysis gives: small tables as DataFrames, reports as dicts."""

    rows: int
    types: dict[str, str]
    missing: object = None
    cleaning: dict = field(default_factory=dict)
    described: object = None
    text: list = field(default_factory=list)
    correlations: object = None
    tests: object = None
    regression: object = None
    model: object = None
    forecast: object = None
    features: dict = field(default_factory=dict)
    training: dict | None = None
    charts: list = field(default_factory=list)
    skipped: list = field(default_factory=list)
    summary: str = ""
    table: object = None
