"""Filling and dropping missing values. Aggregates are computed once for all columns, then filled as literals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstat.functions.linalg import moments, ols
from quillstat.functions.ranks import ensure_checkpoints, lookup_side, numbered, quantiles
from quillstat.operators.profile import is_numeric

ITERATIONS, NEIGHBOURS, GAPS_AT_ONCE = 10, 5, 5000
#: Donors of one block, and how many blocks there are at most (16 bytes each reach the tasks); beyond, blocks grow.
DONOR_BLOCK, MOST_BLOCKS = 2000, 100_000


def mode_of(df: DataFrame, column: str) -> DataFrame:
    """One row (mode): the commonest non-null value, the least of equals."""
    counts = df.select(F.col(f"`{column}`").alias("value")).dropna().groupBy("value").agg(F.count("*").alias("n"))
    return counts.agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))


def _fill(df: DataFrame, column: str, value) -> DataFrame:
    if value is None:
        return df
    kind = dict(df.dtypes)[column]
    fill = F.lit(value).cast("double" if is_numeric(kind) and isinstance(value, float) and not float(value).is_integer() and kind != "boolean" else kind)
    return df.withColumn(column, F.coalesce(F.col(f"`{column}`"), fill))


def directed_fill(df: DataFrame, column: str, order: list, by: list[str] | None = None, forward: bool = True) -> DataFrame:
    """Carry the last (or next) value over gaps in row order, within groups if given; a null group is a group.

    Rows are filled within range partitions of group and order. What a partition leaves open at its beginning takes the
    last value of the group in the partitions before, of which one row for each partition and group is kept.
    """
    where = [F.col(o) if isinstance(o, str) else o for o in order]
    groups = [F.col(f"`{g}`") if isinstance(g, str) else g for g in by or []]
    ensure_checkpoints(df.sparkSession)
    own, keys = [f"_g{i}" for i in range(len(groups))], [f"_k{i}" for i in range(len(where))]
    held = df.withColumns(dict(zip(own, groups, strict=True)) | dict(zip(keys, where, strict=True)))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = held.repartitionByRange(parts, *own, *keys).withColumn("_part", F.spark_partition_id()).checkpoint()
    c, first, last = F.col(f"`{column}`"), Window.unboundedPreceding, Window.unboundedFollowing
    near = Window.partitionBy("_part", *own).orderBy(*keys)
    filled = F.last(c, ignorenulls=True).over(near.rowsBetween(first, 0)) if forward else F.first(c, ignorenulls=True).over(near.rowsBetween(0, last))
    edge = (F.max_by if forward else F.min_by)(F.when(c.isNotNull(), F.struct(c.alias("v"))), F.when(c.isNotNull(), F.struct(*keys)))
    edges = placed.groupBy("_part", *own).agg(edge.alias("_edge"))
    far = Window.partitionBy(*own).orderBy("_part")
    carry = F.last("_edge", ignorenulls=True).over(far.rowsBetween(first, -1)) if forward else F.first("_edge", ignorenulls=True).over(far.rowsBetween(1, last))
    carried = edges.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"{g}_") for g in own], carry.alias("_carry"))
    same = [F.col("_part") == F.col("_p"), *[F.col(g).eqNullSafe(F.col(f"{g}_")) for g in own]]
    out = placed.withColumn("_filled", filled).join(carried if own else F.broadcast(carried), same)  # without groups one row a partition
    return out.withColumn(column, F.coalesce("_filled", "_carry.v")).select(*[F.col(f"`{x}`") for x in df.columns])


def apply_strategies(df: DataFrame, strategies: dict[str, str], order: list | None = None, numeric_only: bool = False) -> DataFrame:
    """Strategies by column, in their order: drop_rows, drop_column, mean, median, mode, zero, forward_fill,
    backward_fill, knn, iterative. Unknown columns and strategies are passed over. Text has no mean or median, so
    its mode is taken, unless numeric_only, which leaves text alone."""
    later: dict[str, list[str]] = {"knn": [], "iterative": []}
    df = df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None).cast(k)) for c, k in df.dtypes if c in strategies and k in ("float", "double")})  # NaN is missing
    for c, strategy in strategies.items():
        if c not in df.columns:
            continue
        kind = dict(df.dtypes)[c]
        if strategy == "drop_rows":
            df = df.dropna(subset=[c])
        elif strategy == "drop_column":
            df = df.drop(c)
        elif strategy in ("mean", "median", "mode"):
            if numeric_only and not is_numeric(kind):
                continue
            if strategy == "mode" or not is_numeric(kind):
                df = _fill(df, c, mode_of(df, c).first()["mode"])
            else:
                x = F.col(f"`{c}`").cast("double")
                df = _fill(df, c, df.agg(F.avg(x).alias("v")).first()["v"] if strategy == "mean" else quantiles(df, {c: x}, [0.5])[c][0])
        elif strategy == "zero":
            df = _fill(df, c, 0 if is_numeric(kind) else "0")
        elif strategy in ("forward_fill", "backward_fill"):
            df = directed_fill(df, c, order or [F.monotonically_increasing_id()], forward=strategy == "forward_fill")
        elif strategy in later:
            later[strategy].append(c)
    if later["knn"]:
        df = knn_impute(df, later["knn"])
    if later["iterative"]:
        df = iterative_impute(df, later["iterative"])
    return df


def _nearest(asked: np.ndarray, numbers: np.ndarray, given: np.ndarray, weight: np.ndarray, k: int) -> list[tuple]:
    """(gap, column, distance, value, weight, donor) of the k nearest donors of every gap; of equally near ones the least."""
    p, rows = given.shape[1], []
    last = np.where(np.isnan(given), np.inf, given)  # a missing value comes last, here and where blocks meet
    step = max(1, 2_000_000 // max(len(given), 1))
    for first in range(0, len(asked), step):
        part = asked[first : first + step]
        square, shared = np.zeros((len(part), len(given))), np.zeros((len(part), len(given)))
        for c in range(p):
            off = part[:, c, None] - given[None, :, c]
            both = ~np.isnan(off)
            square += np.where(both, off, 0.0) ** 2
            shared += both
        with np.errstate(divide="ignore", invalid="ignore"):
            distance = np.sqrt(square * p / shared)
        for c in range(p):
            can = np.flatnonzero(~np.isnan(given[:, c]))
            for g in np.flatnonzero(np.isnan(part[:, c])):
                own = can[shared[g, can] > 0]
                if len(own) > k:  # ties at the edge stay, to be settled by value
                    own = own[distance[g, own] <= np.partition(distance[g, own], k - 1)[k - 1]]
                    own = own[np.lexsort((*last[own].T[::-1], distance[g, own]))][:k]
                rows += [(numbers[first + g], c, distance[g, d], given[d, c], weight[d], last[d].tolist()) for d in own]
    return rows


NEAR = "_gap bigint, c int, distance double, value double, weight bigint, donor array<double>"


def _compared(asked: DataFrame, donors: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(NEAR) the k nearest donors of every gap in each block it asks for. Gaps of a block go in lots of about GAPS_AT_ONCE,
    each with the block's donors, so that a task holds one lot and one block however many gaps share a block."""
    lots = asked.groupBy("_block").agg(F.ceil(F.count("*") / GAPS_AT_ONCE).cast("int").alias("_lots"))
    lots = lookup_side(lots)
    gaps = asked.join(lots, "_block").withColumn("_lot", F.pmod(F.xxhash64("_gap"), F.col("_lots")).cast("int"))
    givers = donors.join(lots, "_block").withColumn("_lot", F.explode(F.sequence(F.lit(0), F.col("_lots") - 1)))

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = _nearest(left[columns].to_numpy(float), left["_gap"].to_numpy(), right[columns].to_numpy(float), right["weight"].to_numpy(), k) if len(left) and len(right) else []
        return pd.DataFrame(rows, columns=["_gap", "c", "distance", "value", "weight", "donor"])

    keys = ["_block", "_lot"]
    # both sides come from the same rows; under new names Spark can tell them apart
    sides = [df.select(*keys, *[F.col(f"`{c}`") for c in own]).toDF(*keys, *own) for df, own in ((gaps, ["_gap", *columns]), (givers, [*columns, "weight"]))]
    return sides[0].groupBy(*keys).cogroup(sides[1].groupBy(*keys)).applyInPandas(work, NEAR)


def _blocks_around(low: np.ndarray, high: np.ndarray):
    """The block of a pivot's value and its neighbours; a block holds values from low to high."""

    @F.pandas_udf("array<bigint>")
    def around(v: pd.Series) -> pd.Series:
        at = np.clip(np.searchsorted(low, v.to_numpy(float), side="right") - 1, 0, len(low) - 1)
        return pd.Series([list(range(max(0, a - 1), min(len(low), a + 2))) for a in at], dtype=object)

    return around


def _blocks_beyond(low: np.ndarray, high: np.ndarray):
    """The blocks not asked yet that may hold a donor within a distance."""

    @F.pandas_udf("array<bigint>")
    def beyond(v: pd.Series, far: pd.Series, scale: pd.Series, asked: pd.Series) -> pd.Series:
        out = []
        for value, d, s, had in zip(v.to_numpy(float), far.to_numpy(float), scale.to_numpy(float), asked, strict=True):
            reach = d / s * (1 + 1e-12)
            a, b = np.searchsorted(high, value - reach, side="left"), np.searchsorted(low, value + reach, side="right")
            known = set(had)
            out.append([j for j in range(int(a), int(b)) if j not in known])
        return pd.Series(out, dtype=object)

    return beyond


def nearest_donors(gaps: DataFrame, donors: DataFrame, columns: list[str], k: int, block_rows: int = DONOR_BLOCK) -> DataFrame | None:
    """(NEAR) at least the k nearest donors of every gap (`_gap` and its values), none of them missed.

    For each gap one column that it has is its pivot: of those, the one that most donors have, and of these the one of
    most values. Donors are cut in blocks by their order in that column. Distance is the root of the mean square over
    shared columns, times the root of the number of columns, so a donor whose pivot is off by d is at least d times
    sqrt(columns / columns that the gap has) away. A gap first asks its own block and the two beside it; the k-th distance
    found there says which further blocks may hold a nearer or equal donor, and it asks those. Donors without the pivot are
    blocks that every gap asks.
    """
    p = len(columns)
    facts = donors.agg(*[e for i, c in enumerate(columns) for e in (F.count(f"`{c}`").alias(f"n{i}"), F.approx_count_distinct(f"`{c}`").alias(f"u{i}"))]).first()
    order = sorted(range(p), key=lambda i: (-facts[f"n{i}"], -facts[f"u{i}"], i))
    pivot = F.lit(None).cast("int")
    for i in reversed(order):
        pivot = F.when(F.col(f"`{columns[i]}`").isNotNull(), i).otherwise(pivot)
    held = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in columns), F.lit(0))
    placed = gaps.withColumns({"_pivot": pivot, "_scale": F.sqrt(p / held)}).filter("_pivot is not null")
    found = None
    for i in sorted(r[0] for r in placed.select("_pivot").distinct().collect()):  # as many as columns
        x = F.col(f"`{columns[i]}`")
        own = placed.filter(F.col("_pivot") == i)
        n = facts[f"n{i}"]
        size = max(block_rows, -(-n // MOST_BLOCKS))
        sorted_ = numbered(donors.filter(x.isNotNull()), [f"`{columns[i]}`"], "_at").withColumn("_block", F.floor(F.col("_at") / size).cast("bigint")).drop("_at").checkpoint()
        bounds = sorted_.groupBy("_block").agg(F.min(x).alias("low"), F.max(x).alias("high")).orderBy("_block").toPandas()  # MOST_BLOCKS rows at most
        low, high = bounds["low"].to_numpy(float), bounds["high"].to_numpy(float)
        near = None
        if len(low):
            first = own.withColumn("_asked", _blocks_around(low, high)(x)).checkpoint()
            near = _compared(first.withColumn("_block", F.explode("_asked")), sorted_, columns, k).checkpoint()
            least = near.groupBy("_gap", "c").agg(F.sort_array(F.collect_list("distance")).alias("d"))  # 3 k at most
            enough = least.groupBy("_gap").agg(F.max(F.when(F.size("d") >= k, F.get("d", F.lit(k - 1))).otherwise(float("inf"))).alias("_far"), F.count("*").alias("_columns"))
            wanted = sum((F.col(f"`{c}`").isNull().cast("int") for c in columns), F.lit(0))
            open_ = first.join(enough, "_gap", "left").withColumn("_far", F.when(F.coalesce("_columns", F.lit(0)) < wanted, float("inf")).otherwise(F.col("_far")))
            more = open_.withColumn("_block", F.explode(_blocks_beyond(low, high)(x, "_far", "_scale", "_asked")))
            near = near.unionByName(_compared(more.select(*first.columns, "_block"), sorted_, columns, k))
        bare = donors.filter(x.isNull())
        rest = bare.count()
        if rest:
            parts = -(-rest // block_rows)
            lone = bare.withColumn("_block", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), F.lit(parts)).cast("bigint"))
            every = own.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
            got = _compared(every, lone, columns, k)
            near = got if near is None else near.unionByName(got)
        if near is not None:
            found = near if found is None else found.unionByName(near)
    return found


def knn_impute(df: DataFrame, columns: list[str], k: int = NEIGHBOURS, block_rows: int = DONOR_BLOCK) -> DataFrame:
    """Each gap becomes the mean of its k nearest donors by nan-euclidean distance over `columns`; of equally near
    ones the least go first. A gap without donors gets the column's mean.

    Every distinct combination of values is a donor, weighted by its rows. The result is exact; of the pairs of gaps and
    donors only those in blocks that may hold one of the nearest are computed.
    """
    ensure_checkpoints(df.sparkSession)
    p = len(columns)
    x = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(c) for c in columns}
    combos = df.select(*x.values()).groupBy(*columns).agg(F.count("*").alias("weight")).checkpoint()
    donors = combos.filter(" or ".join(f"`{c}` is not null" for c in columns))
    gaps = numbered(combos.drop("weight").filter(" or ".join(f"`{c}` is null" for c in columns)), [f"`{c}`" for c in columns], "_gap").checkpoint()
    mean = df.agg(*[F.avg(x[c]).alias(c) for c in columns]).first()
    near = nearest_donors(gaps, donors, columns, k, block_rows)
    if near is None:
        return df.withColumns({c: F.coalesce(x[c], F.lit(mean[c])) for c in columns})
    w = Window.partitionBy("_gap", "c").orderBy("distance", "donor")  # k donors from each block that was asked
    taken = near.withColumn("before", F.coalesce(F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    use = F.greatest(F.least(F.lit(k) - F.col("before"), F.col("weight")), F.lit(0))
    means = taken.withColumn("use", use).filter("use > 0").groupBy("_gap", "c").agg((F.sum(F.col("use") * F.col("value")) / F.sum("use")).alias("fill"))
    fills = means.groupBy("_gap").agg(*[F.max(F.when(F.col("c") == i, F.col("fill"))).alias(f"fill_{i}") for i in range(p)])
    keys = gaps.join(fills, "_gap").select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(columns)], *[f"fill_{i}" for i in range(p)])
    out = df.join(keys, [x[c].eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(columns)], "left")
    return out.withColumns({c: F.coalesce(x[c], F.col(f"fill_{i}"), F.lit(mean[c])) for i, c in enumerate(columns)}).select(*[F.col(f"`{c}`") for c in df.columns])


def iterative_impute(df: DataFrame, columns: list[str], rounds: int = ITERATIONS, tolerance: float = 1e-3) -> DataFrame:
    """Round-robin regression: gaps begin at their means; in each round every column with gaps, those with the fewest
    first, is fitted on the other columns' current values over the rows that have it, and its gaps are predicted anew.
    Rounds end when no gap moves by `tolerance` of the greatest value."""
    ensure_checkpoints(df.sparkSession)
    x = {c: F.col(f"`{c}`").cast("double") for c in columns}
    facts = df.agg(*[e for i, c in enumerate(columns) for e in (F.avg(x[c]).alias(f"a{i}"), F.count_if(x[c].isNull()).alias(f"z{i}"), F.max(F.abs(x[c])).alias(f"m{i}"))]).first()
    order = sorted((i for i in range(len(columns)) if facts[f"z{i}"]), key=lambda i: facts[f"z{i}"])
    work = df.withColumns({f"_c{i}": F.coalesce(x[c], F.lit(facts[f"a{i}"])) for i, c in enumerate(columns)})
    names = [f"_c{i}" for i in range(len(columns))]
    least = tolerance * max((facts[f"m{i}"] or 0.0 for i in range(len(columns))), default=0.0)
    for _ in range(rounds if len(columns) > 1 and order else 0):
        before = work.withColumns({f"_o{i}": F.col(f"_c{i}") for i in order})
        now = before
        for i in order:
            others = [c for k, c in enumerate(names) if k != i]
            m = moments(now.filter(x[columns[i]].isNotNull()).select(*names), names)
            fit = ols(m, f"_c{i}", others, ridge=1e-6 * max(m.n, 1))
            now = now.withColumn(f"_c{i}", F.when(x[columns[i]].isNull(), fit.predict()).otherwise(x[columns[i]]))
        now = now.checkpoint()
        moved = now.agg(F.max(F.greatest(F.lit(0.0), *[F.abs(F.col(f"_c{i}") - F.col(f"_o{i}")) for i in order])).alias("d")).first()["d"]
        work = now.drop(*[f"_o{i}" for i in order])
        if moved is None or moved < least:
            break
    made = {c: F.col(f"_c{i}") for i, c in enumerate(columns)}
    return work.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in df.columns])


def model_fill(df: DataFrame, dependent: str, predictors: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """Fill predictors for a model and drop rows without the dependent.

    Numbers: the median where at least 8 values are skewed by more than 1, else the mean; with `types`, the mean of
    continuous, the median of ordinal and the mode of other columns. Numbers of no value become 0. Text: its mode, or
    "Unknown".
    """
    kinds = dict(df.dtypes)
    numbers = [p for p in predictors if is_numeric(kinds[p])]
    exprs: list[Column] = []
    for i, c in enumerate(numbers):
        x = F.col(f"`{c}`").cast("double")
        exprs += [F.avg(x).alias(f"a{i}"), F.skewness(x).alias(f"s{i}"), F.count(x).alias(f"n{i}")]
    got = df.agg(*exprs).first() if exprs else None
    medians = quantiles(df, {c: F.col(f"`{c}`").cast("double") for c in numbers}, [0.5])
    for i, c in enumerate(numbers):
        if types and types.get(c) not in ("continuous", "ordinal"):
            df = df.withColumn(c, F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(mode_of(df, c).first()["mode"]).cast("double"), F.lit(0.0)))
            continue
        skewed = types[c] == "ordinal" if types else got[f"n{i}"] >= 8 and abs(got[f"s{i}"] or 0) > 1
        df = df.withColumn(c, F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(medians[c][0] if skewed else got[f"a{i}"]), F.lit(0.0)))
    for c in predictors:
        if c not in numbers:
            df = df.withColumn(c, F.coalesce(F.col(f"`{c}`"), F.lit(mode_of(df, c).first()["mode"] or "Unknown")))
    return df.dropna(subset=[dependent])
