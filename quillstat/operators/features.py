"""Encoding, scaling, feature creation and feature selection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstat.functions.linalg import WIDE, complete, moments, pairwise_correlations, vif
from quillstat.functions.ranks import ensure_checkpoints, lookup_side, numbered, spread
from quillstat.operators.profile import number

ONE_HOT_MOST, SMOOTHING, FOREST_CLASSES = 15, 10.0, 10
DATE_FEATURES = ("year", "month", "day", "day_of_week", "hour", "is_weekend", "quarter")


def plain(column: str) -> Column:
    """A column as a double; NaN is a missing value."""
    return F.nanvl(F.col(f"`{column}`").cast("double"), F.lit(None).cast("double"))


def levels(df: DataFrame, column: str, most: int = 1000) -> list[str]:
    """Distinct values as text, sorted; refused beyond `most`, where one column a level makes no sense."""
    got = [r[0] for r in df.select(F.col(f"`{column}`").cast("string")).dropna().distinct().limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"{column} has over {most} levels: too many to one-hot encode")
    return sorted(got)


def one_hot(df: DataFrame, columns: list[str], keep_source: bool = False) -> tuple[DataFrame, dict[str, dict]]:
    """0/1 columns `col_level` for all sorted levels but the first; a null is 0 everywhere."""
    report = {}
    for c in columns:
        found = levels(df, c)
        df = df.withColumns({f"{c}_{v}": F.when(F.col(f"`{c}`").cast("string") == v, 1).otherwise(0) for v in found[1:]})
        report[c] = {"encoded": [f"{c}_{v}" for v in found[1:]], "reference": found[0] if found else None}
        if not keep_source:
            df = df.drop(c)
    return df, report


def target_encode(df: DataFrame, columns: list[str], target: str, smoothing: float = SMOOTHING, fit_on: DataFrame | None = None) -> DataFrame:
    """`col_target_encoded`: the group's mean drawn to the global mean by `smoothing` rows; unseen and null get the
    global mean. Groups are aggregated before they meet the rows."""
    train = fit_on if fit_on is not None else df
    y = plain(target)
    whole = train.agg(F.avg(y).alias("m")).first()["m"]
    for k, c in enumerate(columns):
        means = train.groupBy(F.col(f"`{c}`").alias(f"_k{k}")).agg(((F.sum(y) + smoothing * F.lit(whole)) / (F.count(y) + smoothing)).alias(f"_t{k}")).filter(F.col(f"_k{k}").isNotNull())
        df = df.join(lookup_side(means), F.col(f"`{c}`") == F.col(f"_k{k}"), "left").withColumn(f"{c}_target_encoded", F.coalesce(f"_t{k}", F.lit(whole))).drop(f"_k{k}", f"_t{k}")
    return df


class TargetCodes:
    """Target codes that are fitted on some rows and applied to others, or to the same rows without their own fold.

    One aggregation sums the target by column, level and fold. A level's code for new rows is its mean, drawn to the
    whole mean by `smoothing` rows; for a row that was fitted on, the level's sums and the whole are less those of the row's
    own fold, so that no row's code knows its target. Unseen and null levels get the whole mean. Extra rows change no code.
    """

    def __init__(self, train: DataFrame, columns: list[str], target: str, fold: Column | None = None, smoothing: float = SMOOTHING):
        ensure_checkpoints(train.sparkSession)
        self.columns, self.smoothing = list(columns), smoothing
        self.fold = fold if fold is not None else F.lit(0)
        cells = [F.struct(F.lit(k).alias("k"), F.col(f"`{c}`").cast("string").alias("level")) for k, c in enumerate(columns)]
        cells.append(F.struct(F.lit(-1).alias("k"), F.lit("").alias("level")))  # all rows
        rows = train.select(self.fold.cast("int").alias("fold"), plain(target).alias("y"), F.inline(F.array(*cells))).filter("y is not null and level is not null")
        self.sums = rows.groupBy("k", "level", "fold").agg(F.sum("y").alias("s"), F.count("*").alias("n")).checkpoint()
        whole = self.sums.filter("k = -1").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
        self.sum, self.count = whole["s"] or 0.0, whole["n"] or 0

    @property
    def mean(self) -> float | None:
        return self.sum / self.count if self.count else None

    def _joined(self, df: DataFrame, k: int, column: str, codes: DataFrame, by_fold: bool, otherwise: Column) -> DataFrame:
        match = F.col(f"`{column}`").cast("string") == F.col("_level")
        match = match & (self.fold.cast("int") == F.col("_fold")) if by_fold else match
        return df.join(lookup_side(codes), match, "left").withColumn(f"{column}_target_encoded", F.coalesce("_code", otherwise)).drop("_level", "_fold", "_code")

    def apply(self, df: DataFrame) -> DataFrame:
        """`col_target_encoded` of rows that were not fitted on."""
        for k, c in enumerate(self.columns):
            totals = self.sums.filter(F.col("k") == k).groupBy(F.col("level").alias("_level")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
            code = (F.col("s") + self.smoothing * F.lit(self.mean)) / (F.col("n") + self.smoothing)
            df = self._joined(df, k, c, totals.select("_level", code.alias("_code")), False, F.lit(self.mean))
        return df

    def apply_out_of_fold(self, train: DataFrame) -> DataFrame:
        """`col_target_encoded` of the rows that were fitted on, each by the other folds."""
        own = self.sums.filter("k = -1").select(F.col("fold").alias("_fold"), F.try_divide(F.lit(self.sum) - F.col("s"), (F.lit(self.count) - F.col("n")).cast("double")).alias("_rest"))  # a row a fold
        for k, c in enumerate(self.columns):
            cells = self.sums.filter(F.col("k") == k)
            totals = cells.groupBy("level").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
            met = cells.join(totals, "level").join(F.broadcast(own), F.col("fold") == F.col("_fold"))
            code = (F.col("all_s") - F.col("s") + self.smoothing * F.col("_rest")) / (F.col("all_n") - F.col("n") + self.smoothing)
            train = train.join(F.broadcast(own.withColumnRenamed("_fold", "_of")), self.fold.cast("int") == F.col("_of"), "left")
            train = self._joined(train, k, c, met.select(F.col("level").alias("_level"), "_fold", code.alias("_code")), True, F.coalesce("_rest", F.lit(self.mean))).drop("_of", "_rest")
        return train


def ordinal_encode(df: DataFrame, columns: list[str], orders: dict[str, list[str]] | None = None) -> DataFrame:
    """Levels become 0..k-1 in the given order, or sorted as text; anything else is null. Sorted levels are numbered
    in range partitions and joined back, at any number of them."""
    for c in columns:
        text = F.col(f"`{c}`").cast("string")
        order = (orders or {}).get(c)
        if order:
            codes = df.sparkSession.createDataFrame(list({str(v): k for k, v in reversed(list(enumerate(order)))}.items()), "_level string, _code int")
        else:
            codes = numbered(df.select(text.alias("_level")).dropna().distinct(), ["_level"], "_code").withColumn("_code", F.col("_code").cast("int"))
        others = [F.col("_code").alias(x) if x == c else F.col(f"`{x}`") for x in df.columns]
        df = df.join(lookup_side(codes), text == F.col("_level"), "left").select(*others)
    return df


def auto_encode(df: DataFrame, columns: list[str], target: str | None = None, most: int = ONE_HOT_MOST) -> tuple[DataFrame, dict[str, str]]:
    """One-hot up to `most` levels, beyond that target encoding if there is a target, else ordinal; constants stay."""
    sizes = df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(c) for c in columns]).first().asDict() if columns else {}
    report = {}
    for c in columns:
        if sizes[c] <= 1:
            continue
        report[c] = "one_hot" if sizes[c] <= most else "target" if target else "ordinal"
        if report[c] == "one_hot":
            df, _ = one_hot(df, [c])
        elif report[c] == "target":
            df = target_encode(df, [c], target).drop(c)
        else:
            df = ordinal_encode(df, [c])
    return df, report


def scale(df: DataFrame, columns: list[str], method: str = "standard", exclude: list[str] | None = None) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """(df, {column: (shift, width)}): standard uses the population deviation, minmax the range. A column without
    spread, or under two values, stays as it is."""
    columns = [c for c in columns if c not in (exclude or [])]
    exprs = []
    for i, c in enumerate(columns):
        x = plain(c)
        exprs += [F.count(x).alias(f"n{i}"), *((F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"b{i}")) if method == "standard" else (F.min(x).alias(f"a{i}"), (F.max(x) - F.min(x)).alias(f"b{i}")))]
    got = df.agg(*exprs).first() if exprs else None
    params = {c: (got[f"a{i}"], got[f"b{i}"]) for i, c in enumerate(columns) if got[f"n{i}"] >= 2 and got[f"b{i}"]}
    return apply_scale(df, params), params


def apply_scale(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    """Scale by the (shift, width) that `scale` found on other rows; columns that df lacks are passed over."""
    made = {c: (plain(c) - a) / b for c, (a, b) in params.items() if c in df.columns}
    return df.withColumns(made) if made else df


def unscale(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: F.col(f"`{c}`") * b + a for c, (a, b) in params.items() if c in df.columns})


def datetime_features(df: DataFrame, columns: list[str], features: tuple[str, ...] = DATE_FEATURES) -> DataFrame:
    """`col_feature` numbers; Monday is day 0 and days 5 and 6 are the weekend; week is the ISO week."""
    made: dict[str, Column] = {}
    for c in columns:
        t = F.col(f"`{c}`")
        parts = {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "day_of_week": F.weekday(t), "hour": F.hour(t), "is_weekend": (F.weekday(t) >= 5).cast("int"), "quarter": F.quarter(t), "week": F.weekofyear(t)}
        made |= {f"{c}_{f}": parts[f] for f in features if f in parts}
    return df.withColumns(made)


def has_hours(df: DataFrame, column: str) -> bool:
    """Whether the hour of a time column tells anything."""
    got = df.agg(F.max(F.hour(f"`{column}`")).alias("high"), F.count_distinct(F.hour(f"`{column}`")).alias("n")).first()
    return bool((got["high"] or 0) > 0 or (got["n"] or 0) > 1)


def ratios(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return df.withColumns({f"{a}_div_{b}": F.try_divide(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")) for a, b in pairs})


def interactions(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    made = {}
    for a, b in pairs:
        x, y = F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")
        made |= {f"{a}_x_{b}": x * y, f"{a}_minus_{b}": x - y}
    return df.withColumns(made)


def row_aggregates(df: DataFrame, columns: list[str]) -> DataFrame:
    """row_mean, row_std (sample), row_max, row_min, row_range over the non-null values of a row."""
    if len(columns) < 2:
        return df
    values = F.filter(F.array(*[F.col(f"`{c}`").cast("double") for c in columns]), lambda v: v.isNotNull())
    n = F.size(values)
    mean = F.when(n > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n)
    square = F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    return df.withColumns({"row_mean": mean, "row_std": F.when(n > 1, F.sqrt(square / (n - 1))), "row_max": F.array_max(values), "row_min": F.array_min(values), "row_range": F.array_max(values) - F.array_min(values)})


def group_mean(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """`col_group_mean`; means are aggregated first and joined, so a huge group never sits in one window."""
    means = df.groupBy(F.col(f"`{group}`").alias("_g")).agg(*[F.avg(plain(c)).alias(f"{c}_group_mean") for c in columns]).filter("_g is not null")
    return df.join(lookup_side(means), F.col(f"`{group}`") == F.col("_g"), "left").drop("_g")


def pairwise(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Pairwise-complete correlations of all columns, from one aggregation; of very many columns, from blocked sums."""
    if len(columns) > WIDE:
        return pairwise_correlations(df, columns)[0]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    got = df.select(*[number(c, k).alias(c) for c, k in df.dtypes if c in columns]).agg(*[F.corr(f"`{columns[i]}`", f"`{columns[j]}`").alias(f"r{i}_{j}") for i, j in pairs]).first() if pairs else None
    out = np.eye(len(columns))
    for i, j in pairs:
        r = got[f"r{i}_{j}"]
        out[i, j] = out[j, i] = np.nan if r is None else r
    return out


def drop_correlated(df: DataFrame, columns: list[str], threshold: float = 0.95, drop_first: bool = False) -> tuple[list[str], list[str]]:
    """(kept, dropped): of each pair correlated beyond the threshold the later column goes, or the earlier on request."""
    r = np.abs(pairwise(df, columns))
    gone: list[str] = []
    for j in range(len(columns)):
        for i in range(j):
            if r[i, j] > threshold and columns[i] not in gone and columns[j] not in gone:
                gone.append(columns[i if drop_first else j])
    return [c for c in columns if c not in gone], gone


def target_correlations(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """column, r: with the target, rounded to 4 places."""
    y = F.col(f"`{target}`").cast("double")
    cells = [F.struct(F.lit(c).alias("column"), F.round(F.corr(F.col(f"`{c}`").cast("double"), y), 4).alias("r")) for c in columns]
    return df.agg(F.array(*cells).alias("rows")).select(F.inline("rows"))


def select_by_target(df: DataFrame, columns: list[str], target: str, threshold: float = 0.05) -> DataFrame:
    return target_correlations(df, columns, target).filter(F.col("r").isNotNull() & ~F.isnan("r") & (F.abs("r") >= threshold))


def pca(df: DataFrame, columns: list[str], share: float = 0.95, components: int | None = None) -> tuple[DataFrame, list[float]]:
    """Replace columns by PC1..k of their standardised values, as many as explain `share`; rows with a null have
    null components. Only the p x p correlation matrix reaches the driver."""
    m = moments(df, columns)
    used = [c for k, c in enumerate(columns) if m.cross[k, k] > 0]
    own = m.take(used)
    values, vectors = np.linalg.eigh(own.corr())
    order = np.argsort(-values)
    explained = values[order] / values.sum()
    k = components or int(np.searchsorted(np.cumsum(explained), share - 1e-12) + 1)
    deviation = np.sqrt(np.diag(own.cross) / own.n)
    made = {}
    for i in range(min(k, len(used))):
        v = vectors[:, order[i]]
        v = v * np.sign(v[np.abs(v).argmax()])  # the sign is arbitrary: the largest loading is positive
        made[f"PC{i + 1}"] = sum(((F.col(f"`{c}`").cast("double") - float(own.mean[j])) * float(v[j] / deviation[j]) for j, c in enumerate(used)), F.lit(0.0))
    return df.withColumns(made).drop(*columns), explained[:k].tolist()


def lasso(df: DataFrame, columns: list[str], target: str, alpha: float = 0.01, rounds: int = 1000) -> dict[str, float]:
    """Coefficients on standardised columns, by coordinate descent on the correlation matrix; {} for under two
    columns or ten rows."""
    m = moments(df, [*columns, target])
    if len(columns) < 2 or m.n < 10:
        return {}
    used = [c for k, c in enumerate(columns) if m.cross[k, k] > 0]
    own = m.take([*used, target])
    s = np.sqrt(np.diag(own.cross)[:-1] / own.n)
    a, b = own.cross[:-1, :-1] / np.outer(s, s) / own.n, own.cross[:-1, -1] / s / own.n
    w = np.zeros(len(used))
    for _ in range(rounds):
        old = w.copy()
        for j in range(len(used)):
            rho = b[j] - a[j] @ w + a[j, j] * w[j]
            w[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / a[j, j]
        if np.abs(w - old).max() < 1e-10:
            break
    return dict(zip(used, w.tolist(), strict=True))


def select_by_lasso(df: DataFrame, columns: list[str], target: str, alpha: float = 0.01) -> list[str]:
    w = lasso(df, columns, target, alpha)
    return [c for c in columns if abs(w.get(c, 0.0)) > 1e-6] if w else list(columns)


def select_by_vif(df: DataFrame, columns: list[str], threshold: float = 10.0) -> tuple[list[str], list[tuple[str, float]]]:
    """(kept, [(dropped, vif)]): the worst goes until all are within the threshold; moments are aggregated once."""
    m, left, gone = moments(df, columns), list(columns), []
    while len(left) > 1:
        own = vif(m, left)
        worst = max(left, key=lambda c: own[c])
        if own[worst] <= threshold:
            break
        left.remove(worst)
        gone.append((worst, own[worst]))
    return left, gone


def forest_importance(df: DataFrame, columns: list[str], target: str, trees: int = 100, depth: int = 10, seed: int = 42) -> dict[str, float]:
    """Importances of a forest: a classifier where the target has at most ten values, all whole, else a regressor."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rows = complete(df, [*columns, target]).withColumnRenamed(target, "label")
    got = rows.agg(F.count("*").alias("n"), F.approx_count_distinct("label", 0.02).alias("u"), F.bool_and(F.col("label") == F.floor("label")).alias("w")).first()
    maker = RandomForestRegressor
    if got["w"] and got["u"] <= 2 * FOREST_CLASSES:
        found = sorted(r[0] for r in rows.select("label").distinct().collect())  # few, as the sketch says
        if len(found) <= FOREST_CLASSES:
            maker = RandomForestClassifier
            rows = rows.withColumn("label", F.array_position(F.array(*[F.lit(x) for x in found]), F.col("label")).cast("double") - 1)
    made = VectorAssembler(inputCols=columns, outputCol="features").transform(spread(rows, got["n"], [*columns, "label"]))
    return dict(zip(columns, maker(numTrees=trees, maxDepth=depth, seed=seed).fit(made).featureImportances.toArray().tolist(), strict=True))


def select_by_importance(df: DataFrame, columns: list[str], target: str, top: int | None = None, threshold: float = 0.01, **kw) -> list[str]:
    ranked = sorted(forest_importance(df, columns, target, **kw).items(), key=lambda kv: -kv[1])
    return [c for c, _ in ranked[:top]] if top else [c for c, v in ranked if v >= threshold]


def with_order(column: str, by: list[str] | None = None) -> Column:
    return F.row_number().over(Window.partitionBy(*(by or [])).orderBy(column))
