"""One declarative request, executed as Spark jobs: clean, profile, describe, test, model, explain, chart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.operators import charts, clean, describe, features, infer, missing, profile, regress, training
from quillstat.plans import planner, translate
from quillstat.plans.request import Analysis, AnalysisRequest, FeatureConfig, PreprocessingConfig, TrainingConfig
from quillstat.sources.ingest import ROW_ID, with_row_id


def clean_table(df: DataFrame, config: PreprocessingConfig, strategies: dict | None = None) -> tuple[DataFrame, dict]:
    """Cleaning steps in their fixed order: exact and fuzzy duplicates, case, states, dates, typos, outliers, missing
    values, advanced imputation. Without strategies, each column's suggested one is used."""
    report: dict = {}
    suggested = {r["column"]: r["suggested_strategy"] for r in profile.missing_report(df.drop(ROW_ID)).collect()} if strategies is None else strategies
    own = [c for c in df.columns if c != ROW_ID]
    if config.removeExactDupes:
        df = clean.exact_duplicates(df, own, "first", [ROW_ID])
        report["exact_duplicates"] = "first kept"
    if config.removeFuzzyDupes:
        columns = config.fuzzyColumns or [c for c, k in df.dtypes if k == "string"]
        df = clean.fuzzy_duplicates(df, columns, ROW_ID, config.fuzzyThreshold)
        report["fuzzy_duplicates"] = columns
    texts = [c for c, k in df.dtypes if k == "string"]
    if config.standardizeCase:
        df = clean.standardise_text(df, config.standardizeColumns or texts, config.standardizeCase)
        report["case"] = config.standardizeCase
    if config.stateColumns:
        df = clean.standardise_states(df, config.stateColumns, config.stateFormat)
        report["states"] = config.stateColumns
    if config.parseDates or config.dateColumns:
        df, report["dates"] = clean.parse_dates(df, config.dateColumns or texts)
    for c, fixes in (config.typoCorrections or {}).items():
        df = clean.fix_typos(df, c, fixes)
    for c in config.typoColumns or []:
        if c not in (config.typoCorrections or {}):
            df = clean.auto_fix_typos(df, c)
    if config.outlierAction and config.outlierAction != "none":
        columns = config.outlierColumns or [c for c in clean.numeric_columns(df) if c != ROW_ID]
        df = clean.handle_outliers(df, columns, config.outlierMethod, config.outlierAction, config.outlierFactor)
        report["outliers"] = {c: config.outlierAction for c in columns}
    chosen = suggested | (config.missingStrategy or {})
    df = missing.apply_strategies(df, chosen, [ROW_ID])
    report["missing"] = chosen
    if config.advancedImputation:
        columns = [c for c in clean.numeric_columns(df) if c != ROW_ID]
        df = (missing.knn_impute if config.advancedImputation == "knn" else missing.iterative_impute)(df, columns)
        report["imputation"] = config.advancedImputation
    return df, report


def engineer(df: DataFrame, dependent: str, predictors: list[str], config: FeatureConfig, types: dict[str, str]) -> tuple[DataFrame, list[str], dict]:
    """Feature steps in their fixed order; (df, predictors as they now are, report)."""
    report: dict = {}
    before = set(df.columns)
    if config.datetimeColumns:
        df = features.datetime_features(df, config.datetimeColumns, tuple(config.datetimeFeatures or features.DATE_FEATURES))
    if config.ratioPairs:
        df = features.ratios(df, [tuple(p) for p in config.ratioPairs])
    if config.interactionPairs:
        df = features.interactions(df, [tuple(p) for p in config.interactionPairs])
    if config.aggregationColumns:
        df = features.row_aggregates(df, config.aggregationColumns)
        if config.aggregationGroupBy:
            df = features.group_mean(df, config.aggregationColumns, config.aggregationGroupBy)
    made = [c for c in df.columns if c not in before]
    report["created"] = made
    kinds = dict(df.dtypes)
    encode = config.encodingColumns or [p for p in predictors if kinds[p] == "string" and types.get(p) != "binary"]
    predictors = [p for p in predictors if p not in encode and types.get(p) != "datetime"] + made
    if encode:
        before = set(df.columns)
        how = config.encodingStrategy or "onehot"
        if how == "auto":
            df, report["encoding"] = features.auto_encode(df, encode, dependent)
        elif how == "target":
            df, report["encoding"] = features.target_encode(df, encode, dependent), dict.fromkeys(encode, "target")
        elif how == "ordinal":
            df, report["encoding"] = features.ordinal_encode(df, encode, config.ordinalMaps), dict.fromkeys(encode, "ordinal")
        else:
            df, report["encoding"] = features.one_hot(df, encode)
        predictors += [c for c in df.columns if c not in before] + [c for c in encode if how in ("ordinal", "auto") and c in df.columns and dict(df.dtypes)[c] != "string"]
    numbers = [p for p in predictors if profile.is_numeric(dict(df.dtypes)[p])]
    if config.removeCorrelated:
        numbers, report["correlated"] = features.drop_correlated(df, numbers, config.correlationThreshold)
    if config.targetCorrelationFilter:
        numbers = [r["column"] for r in features.select_by_target(df, numbers, dependent, config.targetCorrelationThreshold).collect()]
    if config.applyVifFilter:
        numbers, report["vif"] = features.select_by_vif(df, numbers, config.vifThreshold)
    if config.applyLassoSelection:
        numbers = features.select_by_lasso(df, numbers, dependent, config.lassoAlpha)
    if config.applyPca:
        df, report["explained"] = features.pca(df, numbers, config.pcaVarianceThreshold)
        numbers = [c for c in df.columns if c.startswith("PC") and c[2:].isdigit()]
    if config.applyFeatureImportance:
        numbers = features.select_by_importance(df, numbers, dependent, config.featureImportanceTopK)
    rest = [p for p in predictors if p in df.columns and not profile.is_numeric(dict(df.dtypes)[p])]
    if config.scalingMethod:
        df, params = features.scale(df, config.scalingColumns or numbers, config.scalingMethod, [dependent, *(config.scalingExclude or [])])
        report["scaling"] = params
    return df, numbers + rest, report


def analyse(df: DataFrame, request: dict | AnalysisRequest | None = None, preprocessing: dict | None = None, feature_engineering: dict | None = None, model_training: dict | None = None, strategies: dict | None = None, codebook: dict | None = None, profiler=None) -> Analysis:
    """Run a request over a table; without one, plan it from the table's types. Columns that cleaning dropped are
    skipped and listed. The cleaned table is kept for the many jobs over it, and released at the end."""
    df = with_row_id(df)
    before = profile.missing_report(df.drop(ROW_ID))
    table, cleaned = clean_table(df, PreprocessingConfig.of(preprocessing), strategies)
    table = table.persist()
    try:
        facts = profile.column_facts(table.drop(ROW_ID))
        types = {f.name: profile.analysis_type(f) for f in facts}
        for c, labels in (codebook or {}).items():
            if c in types:
                types[c] = profile.labelled_type(types[c], labels)
        rows = facts[0].rows if facts else 0
        if request is None:
            request = planner.plan(types, {f.name: f.distinct for f in facts}, rows, profiler)
        if isinstance(request, dict):
            request = AnalysisRequest.of(request)
        out = Analysis(rows, types, before, cleaned, table=profile.labelled(table, codebook or {}))
        have = lambda cs: [c for c in cs if c in types or out.skipped.append(c)]
        if request.descriptive:
            columns = have(request.descriptive["columns"])
            out.described = describe.describe(table, columns)
            out.text = [describe.describe_text(table, c) for c in columns if dict(table.dtypes)[c] == "string"]
        inferential = request.inferential or {}
        if inferential.get("correlationPairs"):
            out.correlations = infer.correlations(table, [tuple(p) for p in inferential["correlationPairs"]], types)
        if inferential.get("hypothesisTests"):
            out.tests = infer.hypothesis_tests(table, inferential["hypothesisTests"])
        if inferential.get("regression"):
            wanted = inferential["regression"]
            if wanted["dependent"] in types:
                out.regression = infer.regression(table, wanted["dependent"], have(wanted["predictors"]))
        if request.predictive and request.predictive["dependent"] in types:
            dependent = request.predictive["dependent"]
            predictors = have(request.predictive["predictors"])
            kind = request.predictive.get("modelType") or regress.select_model(table, dependent, predictors, types)
            ready = missing.model_fill(table, dependent, [p for p in predictors if types[p] != "datetime"])
            if kind == "timeseries":
                order = [c for c in predictors if types[c] == "datetime"] or [ROW_ID]
                out.model, out.forecast = regress.timeseries(ready, dependent, order)
            else:
                ready, predictors, out.features = engineer(ready, dependent, predictors, FeatureConfig.of(feature_engineering), types)
                try:
                    out.model, _ = regress.fit_model(ready, dependent, predictors, kind)
                except ValueError as e:
                    out.skipped.append(f"{kind}: {e}")
        config = TrainingConfig.of(model_training)
        if config.enabled and request.predictive:
            classify = None if config.problemType is None else config.problemType == "classification"
            out.training = training.experiment(table, request.predictive["dependent"], have(request.predictive["predictors"]), config.models, config.tuningMethod, config.tuningIterations, config.cvFolds, classify, test_size=config.testSize, val_size=config.valSize, seed=config.randomSeed)
        out.charts = request.charts or charts.suggestions({"mode": request.mode, "descriptive": request.descriptive, "inferential": request.inferential, "predictive": request.predictive}, types)
        collected = lambda frame: [r.asDict() for r in frame.collect()] if frame is not None else []
        model = {"kind": out.model.kind, "dependent": out.model.dependent} if out.model else None
        described, correlations, tests = collected(out.described), collected(out.correlations), collected(out.tests)
        out.described = df.sparkSession.createDataFrame(described, out.described.schema) if out.described is not None else None
        out.summary = translate.result_summary(rows, len(types), described, correlations, tests, model)
        return out
    finally:
        table.unpersist()
