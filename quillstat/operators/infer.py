"""Correlations and hypothesis tests. Data is aggregated in Spark; p-values are computed on the resulting row."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.functions.linalg import WIDE, Fit, complete, moments, ols, pairwise_correlations, vif
from quillstat.functions.ranks import average_ranks, lookup_side, numbered
from quillstat.functions.special import chi2_upper, f_upper, normal_cdf, t_two_sided

#: Words that stand for 1 and 0 in a binary column.
TRUE_WORDS, FALSE_WORDS = ("true", "yes", "1"), ("false", "no", "0")
SPEARMAN_UNIQUE, ALPHA, LEVELS = 15, 0.05, 15


def binary_number(column: str, kind: str) -> Column:
    """A column as a number, boolean words as 1 and 0."""
    c = F.col(f"`{column}`")
    if kind != "string":
        return c.cast("int").cast("double") if kind == "boolean" else c.cast("double")
    word = F.lower(F.trim(c))
    return F.when(word.isin(*TRUE_WORDS), 1.0).when(word.isin(*FALSE_WORDS), 0.0).otherwise(F.expr(f"try_cast(`{column}` as double)"))


def correlation(df: DataFrame, a: str, b: str, method: str = "pearson") -> DataFrame:
    """One row (n, r): pairwise complete rows; null for under three or a constant column."""
    clean = df.select(*[F.nanvl(F.expr(f"try_cast(`{c}` as double)"), F.lit(None).cast("double")).alias(k) for c, k in ((a, "x"), (b, "y"))]).dropna()
    if method == "spearman":
        counts = clean.groupBy("x", "y").agg(F.count("*").alias("n"))
        for k in ("x", "y"):
            ranks = average_ranks(clean, k).select(F.col("value").alias(k), F.col("rank").alias(f"r{k}"))
            counts = counts.join(lookup_side(ranks), k)
        n = F.sum("n")
        # ranks are around (n + 1) / 2 on both sides, from where products lose nothing
        whole = counts.agg(n.alias("all")).first()["all"] or 0
        u, v = F.col("rx") - (whole + 1) / 2, F.col("ry") - (whole + 1) / 2
        got = counts.agg(F.coalesce(n, F.lit(0)).alias("n"), F.sum(F.col("n") * u * v).alias("uv"), F.sum(F.col("n") * u * u).alias("uu"), F.sum(F.col("n") * v * v).alias("vv"))
        return got.select("n", F.when(F.col("n") >= 3, F.try_divide(F.col("uv"), F.sqrt(F.col("uu") * F.col("vv")))).alias("r"))
    got = clean.agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))
    return got.select("n", F.when((F.col("n") >= 3) & ~F.isnan("r"), F.col("r")).alias("r"))


def method_for(kind_a: str, kind_b: str, unique_a: int, unique_b: int) -> str:
    ordered = {"ordinal", "binary"}
    return "spearman" if kind_a in ordered or kind_b in ordered or min(unique_a, unique_b) <= SPEARMAN_UNIQUE else "pearson"


def strength(r: Column) -> Column:
    size = F.abs(r)
    side = F.when(r >= 0, "positive").otherwise("negative")
    return F.when(size >= 0.7, F.concat(F.lit("strong "), side)).when(size >= 0.4, F.concat(F.lit("moderate "), side)).otherwise("weak")


def fisher_interval(r: Column, n: Column) -> tuple[Column, Column]:
    ok = (F.abs(r) < 1) & (n > 3)
    half = 1.96 / F.sqrt(n - 3)
    return F.when(ok, F.tanh(F.atanh(r) - half)), F.when(ok, F.tanh(F.atanh(r) + half))


CORRELATION = "column_a string, column_b string, method string, n bigint, r double, p_value double, lower double, upper double, interpretation string"


def correlations(df: DataFrame, pairs: list[tuple[str, str]], types: dict[str, str] | None = None) -> DataFrame:
    """A row for each pair that has at least three complete, varying rows; values rounded to 4 places.

    All Pearson coefficients come from one aggregation; columns of few values are counted exactly in another, and
    only Spearman pairs are ranked one by one.
    """
    pairs = [(a, b) for a, b in pairs if a in df.columns and b in df.columns]
    if not pairs:
        return df.sparkSession.createDataFrame([], CORRELATION)
    used = list(dict.fromkeys(c for p in pairs for c in p))
    clean = df.select(*[F.nanvl(F.expr(f"try_cast(`{c}` as double)"), F.lit(None).cast("double")).alias(f"x{used.index(c)}") for c in used])
    both = [tuple(F.when(F.col(f"x{used.index(a)}").isNotNull() & F.col(f"x{used.index(b)}").isNotNull(), F.col(f"x{used.index(c)}")) for c in (a, b)) for a, b in pairs]
    got = clean.agg(*[e for k, (x, y) in enumerate(both) for e in (F.count(x).alias(f"n{k}"), F.corr(x, y).alias(f"r{k}"), F.approx_count_distinct(x, 0.02).alias(f"u{k}_0"), F.approx_count_distinct(y, 0.02).alias(f"u{k}_1"))]).first().asDict()
    few = [(k, s) for k in range(len(pairs)) for s in (0, 1) if got[f"u{k}_{s}"] <= 2 * SPEARMAN_UNIQUE]  # a sketch of so few values isn't off by half
    if few:
        got |= clean.agg(*[F.size(F.collect_set(both[k][s])).alias(f"u{k}_{s}") for k, s in few]).first().asDict()
    rows = []
    for k, (a, b) in enumerate(pairs):
        n, r = got[f"n{k}"], got[f"r{k}"]
        method = method_for((types or {}).get(a, ""), (types or {}).get(b, ""), got[f"u{k}_0"], got[f"u{k}_1"])
        if method == "spearman" and n >= 3:
            r = correlation(df, a, b, method).first()["r"]
        if n < 3 or r is None or r != r:
            continue
        p = 0.0 if abs(r) >= 1 else t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)
        rows.append((a, b, method, n, float(r), p))
    made = df.sparkSession.createDataFrame(rows, "column_a string, column_b string, method string, n bigint, r double, p_value double")
    low, high = fisher_interval(F.col("r"), F.col("n"))
    return made.select("column_a", "column_b", "method", "n", F.round("r", 4).alias("r"), F.round("p_value", 4).alias("p_value"), F.round(low, 4).alias("lower"), F.round(high, 4).alias("upper"), strength(F.col("r")).alias("interpretation"))


def untied_spearman(df: DataFrame, a: str, b: str, order: list) -> tuple[int, float | None]:
    """(n, r) of rank numbers, of which no two are equal: equal values are numbered in row order."""
    number_ = lambda c: F.nanvl(F.expr(f"try_cast(`{c}` as double)"), F.lit(None).cast("double"))
    rows = df.select(number_(a).alias("x"), number_(b).alias("y"), *[(F.col(o) if isinstance(o, str) else o).alias(f"o{k}") for k, o in enumerate(order)]).filter("x is not null and y is not null")
    where = [f"o{k}" for k in range(len(order))]
    ranked = numbered(numbered(rows, ["x", *where], "rx"), ["y", *where], "ry")
    got = ranked.agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("r")).first()
    return got["n"], got["r"]


def variant_correlations(df: DataFrame, types: dict[str, str], pairs: list[tuple[str, str]] | None = None, order: list | None = None) -> DataFrame:
    """column_a, column_b, method, r, interpretation by the client's rules: continuous pairs are Pearson's, a binary and a
    continuous column point-biserial (words for 1 and 0 count as such), pairs with an ordinal column Spearman's on untied
    ranks; anything else, or under three rows, is 0. Without pairs all of continuous, ordinal and binary columns are
    taken, in their order. Columns missing in over 80 % of the rows are left out."""
    names = [c for c in df.columns if types.get(c) in ("continuous", "ordinal", "binary")]
    wanted = [(a, b) for a, b in pairs if a in types and b in types] if pairs else [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    kinds = dict(df.dtypes)
    used = list(dict.fromkeys(c for p in wanted for c in p))
    missing_ = lambda c: F.col(f"`{c}`").isNull() | (F.trim(F.col(f"`{c}`").cast("string")).isin("", "NA", "NaN", "null"))
    shares = df.agg(F.count("*").alias("rows"), *[F.count_if(missing_(c)).alias(f"m{k}") for k, c in enumerate(used)]).first() if used else None
    kept = {c for k, c in enumerate(used) if shares["rows"] and shares[f"m{k}"] / shares["rows"] <= 0.8}
    rows = []
    for a, b in wanted:
        if a not in kept or b not in kept:
            continue
        sides, method, n, r = {types[a], types[b]}, "pearson", 0, None
        if "ordinal" in sides:
            method = "spearman"
            n, r = untied_spearman(df, a, b, order or [F.monotonically_increasing_id()])
        elif sides <= {"continuous", "binary"} and "continuous" in sides:
            x, y = ((F.when((v := binary_number(c, kinds[c])).isin(0.0, 1.0), v) if types[c] == "binary" else F.nanvl(F.expr(f"try_cast(`{c}` as double)"), F.lit(None).cast("double"))) for c in (a, b))
            got = df.select(x.alias("x"), y.alias("y")).dropna().agg(F.count("*").alias("n"), F.corr("x", "y").alias("r")).first()
            n, r = got["n"], got["r"]
        rows.append((a, b, method, float(r) if n >= 3 and r is not None and r == r else 0.0))
    made = df.sparkSession.createDataFrame(rows, "column_a string, column_b string, method string, r double")
    return made.withColumn("interpretation", strength(F.col("r")))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_a, column_b, r for all pairs both ways, 1 on the diagonal, 0 where there are under three rows."""
    if len(columns) > WIDE:
        r, n = pairwise_correlations(df, columns)
        r = np.where((n < 3) | np.isnan(r), 0.0, r)
        np.fill_diagonal(r, 1.0)
        names = np.array(columns, object)
        return df.sparkSession.createDataFrame(pd.DataFrame({"column_a": np.repeat(names, len(names)), "column_b": np.tile(names, len(names)), "r": r.ravel()}))
    clean = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    exprs = [e for k, (a, b) in enumerate(pairs) for e in (F.corr(f"`{a}`", f"`{b}`").alias(f"r{k}"), F.count_if(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()).alias(f"n{k}"))]
    cells = [F.struct(F.lit(c).alias("column_a"), F.lit(c).alias("column_b"), F.lit(1.0).alias("r")) for c in columns]
    for k, (a, b) in enumerate(pairs):
        r = F.when(F.col(f"n{k}") < 3, 0.0).otherwise(F.coalesce(F.nanvl(F.col(f"r{k}"), F.lit(0.0)), F.lit(0.0)))
        cells += [F.struct(F.lit(x).alias("column_a"), F.lit(y).alias("column_b"), r.alias("r")) for x, y in ((a, b), (b, a))]
    return clean.agg(*(exprs or [F.count("*").alias("n")])).select(F.inline(F.array(*cells)))


def group_stats(df: DataFrame, value: str, group: str, least: int) -> DataFrame:
    """grp, n, mean, variance of each group with at least `least` values."""
    rows = df.select(F.col(f"`{group}`").alias("grp"), F.nanvl(F.expr(f"try_cast(`{value}` as double)"), F.lit(None).cast("double")).alias("x")).dropna()
    return rows.groupBy("grp").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("variance")).filter(F.col("n") >= least)


def welch_statistic(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row (n1, n2, statistic, df) for exactly two groups of at least two, in order of the group key."""
    two = group_stats(df, value, group, 2).agg(F.sort_array(F.collect_list(F.struct("grp", "n", "mean", "variance"))).alias("g")).filter(F.size("g") == 2)
    a, b = F.col("g")[0], F.col("g")[1]
    va, vb = a["variance"] / a["n"], b["variance"] / b["n"]
    freedom = F.try_divide((va + vb) ** 2, va**2 / (a["n"] - 1) + vb**2 / (b["n"] - 1))
    return two.select(a["n"].alias("n1"), b["n"].alias("n2"), F.try_divide(a["mean"] - b["mean"], F.sqrt(va + vb)).alias("statistic"), freedom.alias("df"))


def pooled_statistic(df: DataFrame, value: str, group: str) -> DataFrame:
    """The variant with a pooled variance and groups of at least three."""
    two = group_stats(df, value, group, 3).agg(F.sort_array(F.collect_list(F.struct("grp", "n", "mean", "variance"))).alias("g")).filter(F.size("g") == 2)
    a, b = F.col("g")[0], F.col("g")[1]
    pooled = ((a["n"] - 1) * a["variance"] + (b["n"] - 1) * b["variance"]) / (a["n"] + b["n"] - 2)
    return two.select(a["n"].alias("n1"), b["n"].alias("n2"), F.try_divide(a["mean"] - b["mean"], F.sqrt(pooled * (1 / a["n"] + 1 / b["n"]))).alias("statistic"), (a["n"] + b["n"] - 2).cast("double").alias("df"))


def one_sample_statistic(df: DataFrame, value: str, mean: float = 0.0) -> DataFrame:
    got = complete(df, [value]).agg(F.count("*").alias("n"), F.avg(f"`{value}`").alias("m"), F.stddev_samp(f"`{value}`").alias("s"))
    return got.select("n", F.when(F.col("n") >= 2, F.try_divide(F.col("m") - mean, F.col("s") / F.sqrt("n"))).alias("statistic"), (F.col("n") - 1).cast("double").alias("df"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n of complete rows, as text."""
    return df.select(F.col(f"`{a}`").cast("string").alias("a"), F.col(f"`{b}`").cast("string").alias("b")).dropna().groupBy("a", "b").agg(F.count("*").alias("n"))


def crosstab_wide(df: DataFrame, a: str, b: str, levels: list) -> DataFrame:
    """Counts of `a` by the given levels of `b`, one column a level."""
    return df.groupBy(F.col(f"`{a}`")).pivot(b, levels).agg(F.count(F.lit(1))).na.fill(0)


def chi_square_statistic(df: DataFrame, a: str, b: str, yates: bool = True) -> DataFrame:
    """One row (n, statistic, df); two by two tables are continuity-corrected unless yates is off.

    Empty cells need no rows: the statistic is N (sum n^2 / (r c) - 1) over the others. In a two by two table all four
    cells are off by the same amount, and their reciprocal expectations add up to N (sum 1/r) (sum 1/c).
    """
    cells = crosstab(df, a, b).withColumn("n", F.col("n").cast("double"))
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("ra")), cells.groupBy("b").agg(F.sum("n").alias("cb"))
    total = rows.agg(F.sum("ra").alias("n_all"), F.count("*").alias("ka"), F.sum(1 / F.col("ra")).alias("ia")).crossJoin(F.broadcast(cols.agg(F.count("*").alias("kb"), F.sum(1 / F.col("cb")).alias("ib"))))  # one row each
    met = cells.join(rows, "a").join(cols, "b").crossJoin(F.broadcast(total))
    off = F.max(F.abs(F.col("n") - F.col("ra") * F.col("cb") / F.col("n_all")))
    got = met.agg(F.sum(F.col("n") ** 2 / (F.col("ra") * F.col("cb"))).alias("q"), off.alias("off"), *[F.first(c).alias(c) for c in ("n_all", "ka", "kb", "ia", "ib")])
    statistic = F.greatest(F.col("n_all") * (F.col("q") - 1), F.lit(0.0))
    if yates:
        corrected = (F.col("off") - F.least(F.lit(0.5), F.col("off"))) ** 2 * F.col("n_all") * F.col("ia") * F.col("ib")
        statistic = F.when((F.col("ka") == 2) & (F.col("kb") == 2), corrected).otherwise(statistic)
    return got.select(F.col("n_all").cast("bigint").alias("n"), statistic.alias("statistic"), ((F.col("ka") - 1) * (F.col("kb") - 1)).cast("double").alias("df")).filter("df > 0")


def anova_statistic(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row (k, n, statistic, df1, df2) over groups of at least two. Means are taken from the grand mean, so that
    values far from zero lose nothing."""
    g = group_stats(df, value, group, 2)
    whole = g.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))  # one row
    got = g.crossJoin(F.broadcast(whole)).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("mean") - F.col("grand")) ** 2).alias("between"), F.sum((F.col("n") - 1) * F.col("variance")).alias("within"))
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    return got.filter("k >= 2").select("k", "n", F.try_divide(F.col("between") / d1, F.col("within") / d2).alias("statistic"), d1.cast("double").alias("df1"), d2.cast("double").alias("df2"))


TEST = "test string, columns array<string>, statistic double, p_value double, significant boolean, confidence double, df1 double, df2 double"


def hypothesis_tests(df: DataFrame, tests: list[dict], variant: str = "default") -> DataFrame:
    """Rows of TEST for t-test, chi-square and anova requests {type, columns[, mean]}; what can't be tested is left out.

    The variant "ts" uses the pooled t statistic with a normal tail, no continuity correction, and the
    Wilson-Hilferty and cube-root approximations of the tails.
    """
    rows, ts = [], variant == "ts"
    for t in tests:
        kind, columns = t["type"], list(t["columns"])
        if any(c not in df.columns for c in columns):
            continue
        d1 = d2 = None
        if kind == "t-test" and len(columns) == 1:
            got = one_sample_statistic(df, columns[0], t.get("mean", 0.0)).first()
            p = got and t_two_sided(got["statistic"], got["df"])
        elif kind == "t-test":
            got = (pooled_statistic if ts else welch_statistic)(df, *columns[:2]).first()
            p = got and got["statistic"] is not None and (2 * normal_cdf(-abs(got["statistic"])) if ts else t_two_sided(got["statistic"], got["df"]))
        elif kind == "chi-square":
            got = chi_square_statistic(df, *columns[:2], yates=not ts).first()
            if got:
                k = got["df"]
                p = normal_cdf(-(((got["statistic"] / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))) if ts else chi2_upper(got["statistic"], k)
        elif kind == "anova":
            got = anova_statistic(df, *columns[:2]).first()
            if got and got["statistic"] is not None:
                d1, d2, f = got["df1"], got["df2"], got["statistic"]
                if ts:
                    z = ((1 - 2 / (9 * d2)) * f ** (1 / 3) - (1 - 2 / (9 * d1))) / math.sqrt(2 / (9 * d2) * f ** (2 / 3) + 2 / (9 * d1))
                    p = normal_cdf(-z)
                else:
                    p = f_upper(f, d1, d2)
        else:
            continue
        if not got or got["statistic"] is None or p is None:
            continue
        d1 = d1 if d1 is not None else got["df"]
        rows.append((kind, columns, round(got["statistic"], 4), round(p, 4), p < ALPHA, 0.95, d1, d2))
    return df.sparkSession.createDataFrame(rows, TEST)


def regression(df: DataFrame, dependent: str, predictors: list[str]) -> Fit:
    """Least squares on complete rows; constant predictors are left out."""
    m = moments(df, [*predictors, dependent])
    varying = [p for k, p in enumerate(predictors) if m.cross[k, k] > 0]
    fit = ols(m, dependent, varying)
    fit.vif = vif(m, varying)
    return fit


def fitted_rows(df: DataFrame, fit: Fit) -> DataFrame:
    """actual, predicted, residual for every complete row, left in Spark."""
    rows = complete(df, [*fit.predictors, fit.dependent])
    return rows.select(F.col(f"`{fit.dependent}`").alias("actual"), fit.predict().alias("predicted")).withColumn("residual", F.col("actual") - F.col("predicted"))
