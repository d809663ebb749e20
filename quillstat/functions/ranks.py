"""Positions, ranks and exact quantiles over range partitions and histograms, so that no ordered run passes through one task."""

from __future__ import annotations

import math
import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bins of one histogram, how many columns go through one pass, how many values are picked at last, and the accuracy of
#: the sketch that stands in where a histogram of equal widths can't part the values.
BINS, COLUMNS_AT_ONCE, VALUES_PICKED, SKETCH = 2048, 32, 20_000, 5000


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where nothing is set, a session on one machine takes a local one; on a
    cluster, where executors would not see that, it is an error."""
    ensure_checkpoints(spark)
    return spark.sparkContext.getCheckpointDir()


def ensure_checkpoints(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


#: A lookup table of at most so many bytes is broadcast.
LOOKUP_BYTES = 32 << 20


def lookup_side(df: DataFrame) -> DataFrame:
    """A table that rows look their keys up in, made once: broadcast if its measured size is small, so that a frequent
    key is no task of its own; else it is shuffled, and Spark splits what is skewed on the rows' side."""
    ensure_checkpoints(df.sparkSession)
    held = df.checkpoint()
    sizes = [F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) if k == "string" else F.lit(8) for c, k in held.dtypes]
    total = held.agg(F.sum(sum(sizes, F.lit(16)).cast("bigint")).alias("b")).first()["b"] or 0
    return F.broadcast(held) if total <= LOOKUP_BYTES else held


def _parts(df: DataFrame) -> int:
    ensure_checkpoints(df.sparkSession)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Rows of one task where much is done for each row.
TASK_ROWS = 100_000


def spread(df: DataFrame, rows: int | None = None, order: list[str] | None = None) -> DataFrame:
    """df dealt to one task for every TASK_ROWS of its rows (counted if not given), however the file is cut: tables of
    few narrow columns are megabytes only, and come as one task. What one task may hold stays as it is. With `order`, each
    task's rows are sorted by these columns, so that what depends on their order is the same in every run."""
    parts = -(-(df.count() if rows is None else rows) // TASK_ROWS)
    if parts <= 1:
        return df
    dealt = df.repartition(parts)
    return dealt.sortWithinPartitions(*[F.col(f"`{c}`") for c in order]) if order else dealt


def numbered(df: DataFrame, order: list, name: str = "_at", by: list | None = None) -> DataFrame:
    """df with `name`, the position of each row from 0 in the given order, within groups of equal `by` where given (a
    null is a group like any other): rows are numbered within range partitions of group and order, and shifted by what
    the partitions before hold of the group. Rows that the order does not tell apart are numbered in any way."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    groups = [F.col(o) if isinstance(o, str) else o for o in by or []]
    held = df.withColumns({f"_g{i}": k for i, k in enumerate(groups)} | {f"_k{i}": k for i, k in enumerate(order)})
    own, keys = [f"_g{i}" for i in range(len(groups))], [f"_k{i}" for i in range(len(order))]
    placed = held.repartitionByRange(_parts(df), *own, *keys).withColumn("_part", F.spark_partition_id()).checkpoint()
    sizes = placed.groupBy("_part", *own).agg(F.count("*").alias("_rows"))  # a row for each partition and group within it
    run = Window.partitionBy(*own).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"{g}_") for g in own], F.coalesce(F.sum("_rows").over(run), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_part", *own).orderBy(*keys)) - 1
    same = [F.col("_part") == F.col("_p"), *[F.col(g).eqNullSafe(F.col(f"{g}_")) for g in own]]
    # without groups there is one row a partition; groups may be many, and Spark decides by their size
    out = placed.withColumn(name, nth).join(before if own else F.broadcast(before), same)
    return out.withColumn(name, (F.col(name) + F.col("_before")).cast("bigint")).drop("_part", "_p", "_before", *own, *keys, *[f"{g}_" for g in own])


def running_counts(values: DataFrame, by: list[str]) -> DataFrame:
    """(by..., value, n, upto): how often each value of each group occurs and how many of the group's rows do not
    exceed it, from rows (by..., value)."""
    counts = values.groupBy(*by, "value").agg(F.count("*").alias("n"))
    placed = counts.repartitionByRange(_parts(values), *by, "value").withColumn("_part", F.spark_partition_id()).checkpoint()
    totals = placed.groupBy("_part", *by).agg(F.sum("n").alias("_rows"))  # a row for each partition and group within it
    run = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_part", *by, F.coalesce(F.sum("_rows").over(run), F.lit(0)).alias("_before"))
    upto = F.sum("n").over(Window.partitionBy("_part", *by).orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("upto", upto).join(F.broadcast(before), ["_part", *by]).withColumn("upto", F.col("upto") + F.col("_before")).drop("_part", "_before")


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """value, rank: average ranks of the distinct values, by their histogram."""
    values = df.select(F.lit(0).alias("_g"), F.col(f"`{column}`").cast("double").alias("value")).dropna()
    return running_counts(values, ["_g"]).select("value", (F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))


@dataclass(frozen=True)
class _Span:
    """Values of a column from low to high: how many are less, and how many lie within."""

    column: int
    low: float
    high: float
    before: int
    rows: int

    @property
    def single(self) -> bool:
        return self.low == self.high

    @property
    def even(self) -> bool:
        """Whether the span can be cut in bins of equal width."""
        return math.isfinite(self.high - self.low) and (self.high - self.low) / BINS > 0


def _within(spans: list[_Span]) -> Column:
    """The number of the span that a value (c, x) lies in, or null; spans of one column do not overlap."""
    which = F.lit(None).cast("int")
    for k, s in enumerate(spans):
        which = F.when((F.col("c") == s.column) & (F.col("x") >= s.low) & (F.col("x") <= s.high), k).otherwise(which)
    return which


def _histograms(values: DataFrame, spans: list[_Span]) -> list[_Span]:
    """Each span cut in BINS bins, those with values: one aggregation of at most BINS rows a span and task."""
    cut = F.lit(0)
    for k, s in enumerate(spans):
        cut = F.when(F.col("k") == k, F.floor((F.col("x") - s.low) / ((s.high - s.low) / BINS))).otherwise(cut)
    placed = values.select("x", _within(spans).alias("k")).filter("k is not null")
    rows = placed.groupBy("k", cut.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
    out, upto = [], [s.before for s in spans]
    for r in sorted(rows, key=lambda r: (r["k"], r["low"])):  # the bin grows with the value, so bins don't overlap
        out.append(_Span(spans[r["k"]].column, r["low"], r["high"], upto[r["k"]], r["n"]))
        upto[r["k"]] += r["n"]
    return out


def _brackets(values: DataFrame, wanted: dict[_Span, set[int]]) -> list[_Span]:
    """Spans cut at sketched quantiles around the wanted ranks, whatever the values' scale."""
    spans = list(wanted)
    placed = values.select("x", _within(spans).alias("k")).filter("k is not null")
    shares = {k: sorted({min(1.0, max(0.0, (r - s.before) / s.rows + d / SKETCH)) for r in wanted[s] for d in (-2, 2)}) for k, s in enumerate(spans)}
    cuts = placed.groupBy("k").agg(*[F.percentile_approx(F.when(F.col("k") == k, F.col("x")), p, 2 * SKETCH).alias(f"q{k}") for k, p in shares.items()]).collect()
    edges = {r["k"]: sorted({spans[r["k"]].low, *r[f"q{r['k']}"]}) for r in cuts}
    bin_ = F.lit(0)
    for k, e in edges.items():
        bin_ = F.when(F.col("k") == k, F.size(F.filter(F.array(*[F.lit(v) for v in e]), lambda v: v <= F.col("x")))).otherwise(bin_)
    rows = placed.groupBy("k", bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
    out, upto = [], [s.before for s in spans]
    for r in sorted(rows, key=lambda r: (r["k"], r["low"])):
        out.append(_Span(spans[r["k"]].column, r["low"], r["high"], upto[r["k"]], r["n"]))
        upto[r["k"]] += r["n"]
    return out


def _picked(values: DataFrame, spans: list[_Span]) -> list[_Span]:
    """Every distinct value of the spans, with its place; spans of few rows only."""
    rows = values.select("c", "x", _within(spans).alias("k")).filter("k is not null").groupBy("k", "x").agg(F.count("*").alias("n")).collect()
    out, upto = [], [s.before for s in spans]
    for r in sorted(rows, key=lambda r: (r["k"], r["x"])):
        out.append(_Span(spans[r["k"]].column, r["x"], r["x"], upto[r["k"]], r["n"]))
        upto[r["k"]] += r["n"]
    return out


def _at_ranks(values: DataFrame, spans: list[_Span], ranks: dict[int, set[int]]) -> dict[tuple[int, int], float]:
    """The value at each wanted rank of each column, beginning with one span a column."""
    found: dict[tuple[int, int], float] = {}
    while True:
        wanted: dict[_Span, set[int]] = {}
        for s in spans:
            here = {r for r in ranks.get(s.column, ()) if s.before <= r < s.before + s.rows}
            if here and s.single:
                found |= {(s.column, r): s.low for r in here}
            elif here:
                wanted[s] = here
        if not wanted:
            return found
        few = [s for s in wanted if s.rows <= VALUES_PICKED]
        even = [s for s in wanted if s.rows > VALUES_PICKED and s.even]
        odd = {s: r for s, r in wanted.items() if s.rows > VALUES_PICKED and not s.even}
        spans = (_picked(values, few) if few else []) + (_brackets(values, odd) if odd else [])
        if even:
            cut = _histograms(values, even)
            # where nearly all rows stay in one bin, equal widths don't part them
            dense = {s for s in cut if any(e.column == s.column and e.low <= s.low <= e.high and s.rows > 0.9 * e.rows for e in even) and not s.single and s.rows > VALUES_PICKED}
            stuck = {s: h for s in dense if (h := {r for r in ranks[s.column] if s.before <= r < s.before + s.rows})}
            spans += [s for s in cut if s not in stuck] + (_brackets(values, stuck) if stuck else [])


def quantiles(df: DataFrame, columns: dict[str, Column], shares: list[float]) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles of each named column; None where it has no values (a NaN is none).

    One pass finds each column's ends, the next a histogram of equal bins; then only the bins that hold a wanted rank
    are looked at, until they are one value or few enough to be picked. Nothing but bins is shuffled, and the driver gets
    BINS rows a column or VALUES_PICKED values a wanted rank at most.
    """
    out: dict[str, list[float | None]] = {}
    names = list(columns)
    for first in range(0, len(names), COLUMNS_AT_ONCE):
        part = names[first : first + COLUMNS_AT_ONCE]
        numbers = df.select(*[F.nanvl(columns[c].cast("double"), F.lit(None).cast("double")).alias(f"x{k}") for k, c in enumerate(part)])
        ends = numbers.agg(*[e for k in range(len(part)) for e in (F.count(f"x{k}").alias(f"n{k}"), F.min(f"x{k}").alias(f"l{k}"), F.max(f"x{k}").alias(f"h{k}"))]).first()
        if len(part) == 1:
            values = numbers.select(F.lit(0).alias("c"), F.col("x0").alias("x")).filter("x is not null")
        else:
            values = numbers.select(F.inline(F.array(*[F.struct(F.lit(k).alias("c"), F.col(f"x{k}").alias("x")) for k in range(len(part))]))).filter("x is not null")
        sizes = {k: ends[f"n{k}"] for k in range(len(part)) if ends[f"n{k}"]}
        ranks = {k: {r for s in shares for r in (math.floor(s * (n - 1)), math.ceil(s * (n - 1)))} for k, n in sizes.items()}
        found = _at_ranks(values, [_Span(k, ends[f"l{k}"], ends[f"h{k}"], 0, n) for k, n in sizes.items()], ranks)
        for k, c in enumerate(part):
            out[c] = []
            for s in shares:
                if k not in sizes:
                    out[c].append(None)
                    continue
                at = s * (sizes[k] - 1)
                low, high = found[k, math.floor(at)], found[k, math.ceil(at)]
                out[c].append(low if low == high else low + (high - low) * (at - math.floor(at)))
    return out
