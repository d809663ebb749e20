"""Why a model predicts what it does: permutation importance, partial dependence, coefficients, consensus."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

PDP_FEATURES, PDP_GRID, REPEATS = 4, 50, 10
#: Rows among which a feature's values are exchanged, and about how many bytes these may have: blocks of wide rows are of fewer.
BLOCK_ROWS, BLOCK_BYTES = 100_000, 32 << 20


def _blocks(rows: DataFrame, features: list[str], seed: int) -> tuple[DataFrame, int]:
    """(a row a block, all rows): _block, _rows, which are its rows in random order, and for each feature _v0, _v1 and so
    on, its values there in their own order.

    Equal rows are counted, and go to blocks one after the other from one that a hash of what they hold names, so that no
    block has more of them than its share, and blocks are the same however the table is cut.
    """
    kinds = {c: k for c, k in rows.dtypes}
    wide = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, k in kinds.items() if k in ("string", "binary")]
    seen = rows.agg(F.count("*").alias("n"), F.sum(sum(wide, F.lit(16 * len(kinds))).cast("bigint")).alias("bytes")).first()
    n, of_bytes = seen["n"], seen["bytes"] or 0
    blocks = max(1, -(-n // BLOCK_ROWS), -(-of_bytes // BLOCK_BYTES))
    names = [f"c{k}" for k in range(len(kinds))]
    alike = rows.toDF(*names).groupBy(*names).agg(F.count("*").alias("_n")).withColumn("_hash", F.xxhash64(F.lit(seed), *names))
    nth, least = F.col("_nth"), F.expr(f"_n div {blocks}")
    dealt = alike.withColumn("_nth", F.explode(F.sequence(F.lit(0), F.least("_n", F.lit(blocks)).cast("int") - 1)))
    dealt = dealt.withColumn("_block", F.pmod(F.pmod("_hash", F.lit(blocks)) + nth, F.lit(blocks)).cast("int"))
    dealt = dealt.withColumn("_n", least + F.when(nth < F.col("_n") - least * blocks, 1).otherwise(0))
    placed = dealt.repartitionById(blocks, "_block").withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    placed = placed.withColumn("_hash", F.xxhash64("_hash", "_nth")).sortWithinPartitions("_hash")
    whole = placed.groupBy("_block").agg(F.collect_list(F.struct(*names)).alias("_rows"))
    at = {c: k for k, c in enumerate(kinds)}
    values = {f"_v{k}": F.col("_rows")[f"c{at[f]}"] for k, f in enumerate(features)}
    ordered = [isinstance(rows.schema[f].dataType, AtomicType) for f in features]
    return whole.withColumns({v: F.sort_array(c) if o else c for (v, c), o in zip(values.items(), ordered, strict=True)}), n


def permutation_importance(rows: DataFrame, features: list[str], score, repeats: int = REPEATS, seed: int = 42) -> DataFrame:
    """feature, mean, std, rank: by how much score(rows) falls when a feature's values are exchanged between rows.

    Rows are put in random order once, in blocks of about BLOCK_ROWS, each of which is kept as one row of arrays. A repeat
    reads them once for each feature and lays the block's values beside the rows, moved round by so many places: no repeat
    sorts, joins, shuffles or keeps anything, and no row is left out. The values lie in their own order; repeats
    go by twos, of which the second takes them backwards, and each two moves them by an even step more. So each repeat is a
    random exchange, while all together give every row values from all parts of the feature's range, which leaves the
    mean less to chance than as many exchanges drawn apart.
    """
    base, n = _blocks(rows, features, seed)
    base = base.persist()
    own = [F.col(f"_row.c{k}").alias(c) for k, c in enumerate(rows.columns)]
    size = F.size("_rows")

    def exchanged(k: int, nth: int) -> DataFrame:
        by = F.pmod(F.pmod(F.xxhash64(F.lit(seed), "_block"), size) + F.floor(size * F.lit(nth // 2 / -(-repeats // 2))), size).cast("int")
        values = F.reverse(f"_v{k}") if nth % 2 else F.col(f"_v{k}")
        other = F.concat(F.slice(values, by + 1, size), F.slice(values, F.lit(1), by))
        both = base.select(F.inline(F.arrays_zip(F.col("_rows").alias("_row"), other.alias("_other"))))
        return both.toDF("_row", "_other").select(*[F.col("_other").alias(c) if c == features[k] else o for c, o in zip(rows.columns, own, strict=True)])

    try:
        full = score(base.select(F.explode("_rows").alias("_row")).select(*own))
        falls = {f: [full - score(exchanged(k, nth)) for nth in range(repeats if n > 1 else 0)] for k, f in enumerate(features)}
    finally:
        base.unpersist()
    out = [(f, float(np.mean(v or [0.0])), float(np.std(v or [0.0]))) for f, v in falls.items()]
    ranked = sorted(out, key=lambda t: -t[1])
    return rows.sparkSession.createDataFrame([(f, round(m, 6), round(s, 6), k + 1) for k, (f, m, s) in enumerate(ranked)], "feature string, mean double, std double, rank int")


def partial_dependence(rows: DataFrame, features: list[str], predict, grid: int = PDP_GRID) -> DataFrame:
    """feature, x, y: the mean prediction over all rows with one feature set to each of `grid` values."""
    out = None
    for f in features[:PDP_FEATURES]:
        ends = rows.agg(F.min(f"`{f}`").alias("low"), F.max(f"`{f}`").alias("high")).first()
        if ends["low"] is None:
            continue
        points = sorted({float(ends["low"]) + k * (float(ends["high"]) - float(ends["low"])) / max(grid - 1, 1) for k in range(grid)})
        every = rows.drop(f).withColumn(f, F.explode(F.array(*[F.lit(x) for x in points])))
        part = predict(every).groupBy(F.lit(f).alias("feature"), F.col(f).alias("x")).agg(F.avg("prediction").alias("y"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.sparkSession.createDataFrame([], "feature string, x double, y double")


def coefficient_rows(names: list[str], coefficients: list[float], classify: bool) -> list[dict]:
    total = sum(abs(c) for c in coefficients)
    rows = []
    for name, c in sorted(zip(names, coefficients, strict=True), key=lambda t: -abs(t[1])):
        row = {"feature": name, "coefficient": round(c, 4), "percentage": round(100 * abs(c) / total, 2) if total else 0.0, "direction": "positive" if c > 0 else "negative", "rank": len(rows) + 1}
        if classify:
            odds = math.exp(min(c, 700.0))
            row |= {"odds_ratio": round(odds, 4), "interpretation": f"one more unit multiplies the odds by {odds:.3g}"}
        else:
            row["interpretation"] = f"one more unit moves the prediction by {c:+.3g}"
        rows.append(row)
    return rows


def importance_rows(importance: dict[str, float]) -> list[dict]:
    total = sum(importance.values())
    ranked = sorted(importance.items(), key=lambda kv: -kv[1])
    return [{"feature": f, "importance": round(v, 4), "percentage": round(100 * v / total, 2) if total else 0.0, "rank": k + 1} for k, (f, v) in enumerate(ranked)]


def linear_attributions(rows: DataFrame, names: list[str], coefficients: list[float]) -> DataFrame:
    """feature, mean_abs: exact additive attributions of a linear model, coefficient times distance from the mean.
    Trees have no such closed form here and are reported as unavailable."""
    means = rows.agg(*[F.avg(f"`{n}`").alias(n) for n in names]).first()
    cells = [F.struct(F.lit(n).alias("feature"), F.avg(F.abs((F.col(f"`{n}`") - means[n]) * float(c))).alias("mean_abs")) for n, c in zip(names, coefficients, strict=True)]
    return rows.agg(F.array(*cells).alias("r")).select(F.inline("r")).orderBy(F.desc("mean_abs"), "feature")


def local_surrogate(rows: DataFrame, instance: dict[str, float], names: list[str], predict, top: int = 10, samples: int = 1000, seed: int = 42) -> list[tuple[str, float]]:
    """Weights of a ridge fit on perturbations around one row, nearest first: `samples` rows, predicted in Spark."""
    spread = rows.agg(*[F.stddev_pop(f"`{n}`").alias(n) for n in names]).first()
    noise = np.random.default_rng(seed).standard_normal((samples, len(names)))
    width = np.array([spread[n] or 1.0 for n in names])
    x = np.array([instance[n] for n in names]) + noise * width
    frame = rows.sparkSession.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "_k bigint, " + ", ".join(f"`{n}` double" for n in names))
    y = np.array([r[0] for r in predict(frame).orderBy("_k").select("prediction").collect()])
    weight = np.exp(-(noise**2).sum(1) / (2 * 0.75**2 * len(names)))
    a = np.column_stack((noise, np.ones(samples)))
    w = np.linalg.solve((a * weight[:, None]).T @ a + 1e-3 * np.eye(a.shape[1]), (a * weight[:, None]).T @ y)
    return sorted(zip(names, (w[:-1] / width).tolist(), strict=True), key=lambda t: -abs(t[1]))[:top]


def consensus(rankings: DataFrame) -> DataFrame:
    """feature, mean_rank, methods, position from rows (method, feature, rank)."""
    got = rankings.groupBy("feature").agg(F.avg("rank").alias("mean_rank"), F.count("*").alias("methods"))
    return got.withColumn("position", F.row_number().over(Window.orderBy("mean_rank", "feature")))  # one row a feature


def summary(name: str, ranking: list[str], classify: bool) -> str:
    what = "class" if classify else "value"
    if not ranking:
        return f"No method could rank the inputs of {name}."
    rest = f", then {', '.join(ranking[1:3])}" if len(ranking) > 1 else ""
    return f"The {what} that {name} predicts depends most on {ranking[0]}{rest}."
