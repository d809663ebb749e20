"""Descriptive statistics: quantiles of all columns from one histogram in range partitions, the rest in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.functions.ranks import quantiles
from quillstat.operators.missing import mode_of
from quillstat.operators.profile import is_numeric, number

MEASURES = ("count", "null_count", "mean", "median", "std_dev", "variance", "min", "max", "range", "q1", "q3", "iqr", "skewness", "kurtosis", "outlier_count")


def describe(df: DataFrame, columns: list[str], approx: bool = False, variant: str = "default") -> DataFrame:
    """One row a numeric column: `column` and MEASURES.

    Sample deviation and variance (0 for one value), population skewness and excess kurtosis (0 under three values),
    linearly interpolated quartiles, outliers beyond 1.5 IQR. approx replaces exact quantiles by a sketch, for
    columns of too many distinct values to hold. The variant "ts" has population deviation and variance and
    sample-corrected skewness and kurtosis.
    """
    kinds = dict(df.dtypes)
    columns = [c for c in columns if c in kinds and is_numeric(kinds[c])]
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, " + ", ".join(f"{m} double" for m in MEASURES))
    values = {c: number(c, kinds[c]) for c in columns}
    if approx:
        sketch = df.agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 100_000).alias(f"q{i}") for i, x in enumerate(values.values())]).first()
        cuts = {c: sketch[f"q{i}"] or [None] * 3 for i, c in enumerate(columns)}
    else:
        cuts = quantiles(df, values, [0.25, 0.5, 0.75])
    facts = []
    for i, c in enumerate(columns):
        x = F.nanvl(values[c], F.lit(None).cast("double"))
        low, _, high = cuts[c]
        beyond = F.lit(False) if low is None else (x < low - 1.5 * (high - low)) | (x > high + 1.5 * (high - low))
        facts += [F.count(x).alias(f"n{i}"), F.count_if(x.isNull()).alias(f"z{i}"), F.avg(x).alias(f"a{i}"), F.var_samp(x).alias(f"v{i}"), F.var_pop(x).alias(f"p{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.skewness(x).alias(f"s{i}"), F.kurtosis(x).alias(f"k{i}"), F.count_if(beyond).alias(f"o{i}")]
    rows = []
    for i, c in enumerate(columns):
        g = {k: F.col(f"{k}{i}") for k in ("n", "z", "a", "v", "p", "lo", "hi", "s", "k", "o")}
        q = [F.lit(x).cast("double") for x in cuts[c]]
        variance = g["p"] if variant == "ts" else F.when(g["n"] == 1, 0.0).otherwise(g["v"])
        n = g["n"].cast("double")
        skew, kurt = F.when(n < 3, 0.0).otherwise(F.coalesce(g["s"], F.lit(0.0))), F.when(n < 3, 0.0).otherwise(F.coalesce(g["k"], F.lit(0.0)))
        if variant == "ts":
            skew = F.when(n >= 3, skew * F.sqrt(n * (n - 1)) / (n - 2))
            kurt = F.when(n >= 4, ((n + 1) * kurt + 6) * (n - 1) / ((n - 2) * (n - 3)))
        rows.append(F.struct(F.lit(c).alias("column"), g["n"].alias("count"), g["z"].alias("null_count"), g["a"].alias("mean"), q[1].alias("median"), F.sqrt(variance).alias("std_dev"), variance.alias("variance"), g["lo"].alias("min"), g["hi"].alias("max"), (g["hi"] - g["lo"]).alias("range"), q[0].alias("q1"), q[2].alias("q3"), (q[2] - q[0]).alias("iqr"), skew.alias("skewness"), kurt.alias("kurtosis"), g["o"].alias("outlier_count")))
    return df.agg(*facts).select(F.inline(F.array(*rows)))


def describe_text(df: DataFrame, column: str) -> DataFrame:
    """column, count, null_count, distinct, mode of a non-numeric column."""
    facts = df.agg(F.count(f"`{column}`").alias("count"), F.count_if(F.col(f"`{column}`").isNull()).alias("null_count"), F.count_distinct(f"`{column}`").alias("distinct"))
    return facts.crossJoin(F.broadcast(mode_of(df, column))).select(F.lit(column).alias("column"), "count", "null_count", "distinct", "mode")


def describe_time(df: DataFrame, column: str) -> DataFrame:
    c = F.col(f"`{column}`")
    return df.agg(F.lit(column).alias("column"), F.count(c).alias("count"), F.count_if(c.isNull()).alias("null_count"), F.min(c).alias("min"), F.max(c).alias("max"))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """value, count: the commonest first, then by value."""
    return df.select(F.col(f"`{column}`").alias("value")).dropna().groupBy("value").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value")


def percentiles(df: DataFrame, column: str, points: list[float], approx: bool = False) -> DataFrame:
    """percentile, value for points from 0 to 100."""
    x = F.col(f"`{column}`").cast("double")
    shares = [p / 100 for p in points]
    if approx:
        found = df.agg(F.percentile_approx(x, shares, 100_000).alias("q")).first()["q"] or [None] * len(points)
    else:
        found = quantiles(df, {column: x}, shares)[column]
    return df.sparkSession.createDataFrame([(float(p), v) for p, v in zip(points, found, strict=True)], "percentile double, value double")


def skew_label(skewness) -> F.Column:
    size = F.abs(skewness)
    return F.when(size < 0.5, "symmetric").when(size < 1, "moderately skewed").otherwise("highly skewed")
