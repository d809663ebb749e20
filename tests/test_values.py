"""Values of operators against brute force or known numbers, beyond the sizes at which they once changed their ways."""

import difflib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstat.functions.ranks import numbered, quantiles
from quillstat.functions.similarity import similar_values, title_case
from quillstat.operators import clean, describe, explain, features, infer, missing, regress, training


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = [None if rng.random() < 0.1 else float(v) for v in rng.normal(size=5000)]
    y = [float(v) for v in rng.integers(0, 7, 5000)]
    df = spark.createDataFrame(list(zip(x, y, [None] * 5000, strict=True)), "x double, y double, z double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = quantiles(df, {c: F.col(c) for c in "xyz"}, shares)
    assert got["x"] == pytest.approx(np.quantile([v for v in x if v is not None], shares).tolist())
    assert got["y"] == pytest.approx(np.quantile(y, shares).tolist())
    assert got["z"] == [None] * len(shares)
    assert quantiles(df.limit(0), {"x": F.col("x")}, [0.5]) == {"x": [None]}
    plan = describe.describe(df, ["x", "y"])._jdf.queryExecution().toString()
    assert "percentile" not in plan


def test_numbering_is_the_order(spark):
    df = spark.range(3000).withColumn("k", F.xxhash64("id"))
    got = numbered(df, ["k"]).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["_at"])] == [r["id"] for r in sorted(got, key=lambda r: r["k"])]
    assert sorted(r["_at"] for r in got) == list(range(3000))


def test_anova_far_from_zero(spark):
    rng = np.random.default_rng(1)
    groups = {g: rng.normal(loc=k * 40, scale=50, size=60) for k, g in enumerate("abc")}

    def statistic(shift):
        df = spark.createDataFrame([(g, float(v) + shift) for g, x in groups.items() for v in x], "g string, v double")
        return infer.anova_statistic(df, "v", "g").first()["statistic"]

    grand = np.mean(np.concatenate(list(groups.values())))
    between = sum(len(x) * (x.mean() - grand) ** 2 for x in groups.values()) / 2
    within = sum(((x - x.mean()) ** 2).sum() for x in groups.values()) / (180 - 3)
    assert statistic(0.0) == pytest.approx(between / within)
    assert statistic(1.7e9) == pytest.approx(between / within, rel=1e-4)


def test_chi_square_against_the_whole_grid(spark):
    draw = random.Random(2)
    for levels in (2, 5):
        rows = [(str(draw.randrange(levels)), str(min(draw.randrange(levels), draw.randrange(levels)))) for _ in range(300)]
        df = spark.createDataFrame(rows, "a string, b string")
        table = np.array([[sum(r == (str(i), str(j)) for r in rows) for j in range(levels)] for i in range(levels)], float)
        expected = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
        off = np.abs(table - expected)
        for yates in (True, False):
            shift = np.minimum(0.5, off) if yates and levels == 2 else 0
            got = infer.chi_square_statistic(df, "a", "b", yates).first()
            assert got["statistic"] == pytest.approx((((off - shift) ** 2) / expected).sum())
            assert got["df"] == (levels - 1) ** 2 and got["n"] == 300


def test_p_values_against_known_tails(spark):
    df = spark.createDataFrame([(float(x), float(x) + (1 if k % 2 else -1) * 3.0) for k, x in enumerate(range(20))], "x double, y double")
    got = infer.correlations(df, [("x", "y")]).first()
    r = np.corrcoef(range(20), [x + (1 if k % 2 else -1) * 3.0 for k, x in enumerate(range(20))])[0, 1]
    assert got["r"] == round(r, 4) and got["method"] == "pearson" and got["n"] == 20
    one = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0, 5.0)], "v double")
    # t = 3 / (sqrt(2.5) / sqrt(5)) = 4.2426 with 4 degrees of freedom
    t = infer.hypothesis_tests(one, [{"type": "t-test", "columns": ["v"]}]).first()
    assert t["statistic"] == 4.2426 and t["p_value"] == pytest.approx(0.0132, abs=1e-4)


def test_series_with_gaps_is_numbered_without_them(spark):
    df = spark.createDataFrame([(t, None if t in (3, 7, 11, 15) else float(t)) for t in range(20)], "t int, y double")
    kept = [t for t in range(20) if t not in (3, 7, 11, 15)]
    slope, start = np.polyfit(range(16), kept, 1)
    model, future = regress.timeseries(df, "y", ["t"])
    first = future.orderBy("label").first()
    assert first["label"] == "Period 17" and first["predicted"] == pytest.approx(start + slope * 16)
    assert first["predicted"] == pytest.approx(20.0, abs=0.75)


@pytest.mark.parametrize(("values", "classes"), [(range(10), True), (range(11), False), ((0, 5, 100), True), ((0.5, 1.0), False)])
def test_what_is_a_classification(spark, values, classes):
    df = spark.createDataFrame([(float(v),) for v in values for _ in range(20)], "y double")
    assert training.is_classification(df, "y") is classes


def similar(a, b, threshold):
    return difflib.SequenceMatcher(None, a, b).ratio() >= threshold


@pytest.mark.parametrize("threshold", [0.9, 0.85])
def test_similar_values_lose_no_pair(spark, threshold):
    draw = random.Random(5)
    words = {"".join(draw.choice("abcdeé ") for _ in range(draw.randint(1, 24))) for _ in range(150)}
    for w in list(words)[:100]:
        v = list(w)
        for _ in range(draw.randint(1, 2)):
            v[draw.randrange(len(v))] = draw.choice("abcde")
        words.add("".join(v))
    words = sorted(w for w in words if w.strip())
    df = spark.createDataFrame([(w,) for w in words], "v string")
    got = {(r["v"], r["w"]) for r in similar_values(df, df, threshold).collect()}
    assert got == {(a, b) for a in words for b in words if similar(a, b, threshold)}


def leaders(rows, threshold, keep):
    """The greedy rule in plain loops."""
    texts = [(i, [(x or "").strip().lower() for x in t]) for i, t in sorted(rows)]
    alike = lambda s, t: all(x == y or not x or not y or similar(x, y, threshold) for x, y in zip(s, t, strict=True))
    groups: list[list] = []
    for i, t in texts:
        for g in groups:
            if alike(g[0][1], t):
                g.append((i, t))
                break
        else:
            groups.append([(i, t)])
    gone = set()
    for g in groups:
        ids = [i for i, _ in g]
        if len(ids) > 1:
            gone |= set(ids) - ({ids[0]} if keep == "first" else {ids[-1]} if keep == "last" else set())
    return sorted(i for i, _ in rows if i not in gone)


@pytest.mark.parametrize("keep", ["first", "last", "none"])
def test_fuzzy_duplicates_with_empty_columns(spark, keep):
    draw = random.Random(8)
    names = ["john smith", "john smyth", "mary jones", "mary jones jr", "lee"]
    places = ["12 long street, springfield", "12 long street springfield", "", None, "9 elm road"]
    rows = [(i, (draw.choice(names), draw.choice(places))) for i in range(60)] + [(60, ("john smith", "12 long street, a very far away town")), (61, ("", ""))][: 1 + (keep == "first")]
    df = spark.createDataFrame([(i, *t) for i, t in rows], "id int, name string, place string")
    got = sorted(r["id"] for r in clean.fuzzy_duplicates(df, ["name", "place"], "id", 0.9, keep).collect())
    assert got == leaders(rows, 0.9, keep)


@pytest.mark.parametrize("keep", ["first", "none"])
def test_fuzzy_duplicates_that_share_no_column(spark, keep):
    draw = random.Random(11)
    names, places, notes = ["john smith", "john smyth", "mary jones", "", None], ["12 long street", "12 long streets", "", "9 elm road"], ["", None, "seen twice", "seen  twice"]
    rows = [(i, (draw.choice(names), draw.choice(places), draw.choice(notes))) for i in draw.sample(range(1000), 70)]
    df = spark.createDataFrame([(i, *t) for i, t in rows], "id int, name string, place string, note string")
    got = sorted(r["id"] for r in clean.fuzzy_duplicates(df, ["name", "place", "note"], "id", 0.9, keep).collect())
    assert got == leaders(rows, 0.9, keep)
    assert clean.fuzzy_duplicates(df.limit(0), ["name"], "id").count() == 0


def test_groups_that_share_no_column_are_not_listed_as_pairs(spark):
    df = spark.range(8000).selectExpr("id", "if(id % 2 = 0, lpad(id, 6, 0), null) as a", "if(id % 2 = 1, lpad(id, 6, 0), null) as b")
    assert clean.fuzzy_pairs(df, ["a", "b"], "id").count() == 0
    # row 0 leads all of the other group; its own group has nobody before it that is alike
    assert clean.fuzzy_duplicates(df, ["a", "b"], "id").count() == 4000


def test_title_case_is_that_of_the_language(spark):
    texts = ["o'neil mc-donald", "ÉCOLE normale", "x1y 2nd_street", "", "tab\tand  two", "ünïcode straße", None]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, v string").select("k", title_case(F.col("v")).alias("v")).orderBy("k").select("v").collect()]
    assert got == [None if t is None else t.title() for t in texts]


def test_typos_beyond_five_thousand_values(spark):
    draw = random.Random(4)
    common = [f"{a}{b}" for a in ("north", "south", "east", "west") for b in ("bridge", "haven", "field")]
    rare = sorted({"".join(draw.choice("bcdfghjklmnpqrstvwxz") for _ in range(10)) for _ in range(5200)}) + ["northbrigde", "southhavn", "eastfeild"]
    df = spark.createDataFrame([(v,) for v in common * 3 + rare], "v string")
    got = sorted(r["v"] for r in clean.auto_fix_typos(df, "v").collect())

    def fixed(v):
        return (difflib.get_close_matches(v, common, 1, 0.85) or [v])[0]

    assert got == sorted(common * 3 + [fixed(v) for v in rare])


def test_nearest_donors_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    table = rng.integers(0, 30, (400, 3)).astype(float)
    table[rng.random(table.shape) < 0.15] = np.nan
    rows = [tuple(None if math.isnan(v) else float(v) for v in r) for r in table]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a double, b double, c double").repartition(5)
    got = {r["id"]: (r["a"], r["b"], r["c"]) for r in missing.knn_impute(df, ["a", "b", "c"]).collect()}
    mean = np.nanmean(table, axis=0)
    for i, row in enumerate(table):
        for c in range(3):
            if not math.isnan(row[c]):
                assert got[i][c] == row[c]
                continue
            near = []
            for other in table:
                both = ~np.isnan(row) & ~np.isnan(other)
                if both.any() and not math.isnan(other[c]):
                    near.append((math.sqrt(((row - other)[both] ** 2).sum() * 3 / both.sum()), other[c]))
            edge = sorted(d for d, _ in near)[4] if len(near) >= 5 else math.inf
            sure, tied = [v for d, v in near if d < edge - 1e-9], [v for d, v in near if abs(d - edge) <= 1e-9]
            left = 5 - len(sure)
            low, high = (sum(sure) + sum(f(tied)[:left]) for f in (sorted, lambda x: sorted(x, reverse=True)))
            if near and len(near) >= 5:
                assert low / 5 - 1e-9 <= got[i][c] <= high / 5 + 1e-9
            elif not near:
                assert got[i][c] == pytest.approx(mean[c])


def test_round_robin_finds_a_plane(spark):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=300), rng.normal(size=300)
    z = 2 * x - y
    rows = [[float(a), float(b), float(c)] for a, b, c in zip(x, y, z, strict=True)]
    for k in range(300):
        if k % 5 < 2:
            rows[k][k % 3] = None
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, x double, y double, z double")
    got = {r["id"]: r for r in missing.iterative_impute(df, ["x", "y", "z"], rounds=15, tolerance=1e-9).collect()}
    for k in range(300):
        assert got[k]["z"] == pytest.approx(2 * got[k]["x"] - got[k]["y"], abs=0.05)
        assert [got[k][c] for c in "xyz"] == pytest.approx([x[k], y[k], z[k]], abs=0.1)


def test_importance_and_dependence_see_every_row(spark):
    df = spark.range(30_000).select((F.col("id") % 100).cast("double").alias("x"), F.lit(1.0).alias("one"), (F.col("id") % 7).cast("double").alias("noise"), (3.0 * (F.col("id") % 100)).alias("y"))
    seen = []

    def score(rows):
        got = rows.agg(F.count("*").alias("n"), F.avg((F.col("y") - 3 * F.col("x")) ** 2).alias("mse"), F.sum("x").alias("s")).first()
        seen.append((got["n"], got["s"]))
        return -got["mse"]

    got = {r["feature"]: r for r in explain.permutation_importance(df, ["x", "noise"], score, repeats=3).collect()}
    assert {n for n, _ in seen} == {30_000} and len({s for _, s in seen}) == 1
    # exchanged at random, the mean square is twice the variance of 3 x
    assert got["x"]["mean"] == pytest.approx(2 * 9 * np.var(np.arange(100)), rel=0.05) and got["x"]["rank"] == 1
    assert got["noise"]["mean"] == 0
    curve = explain.partial_dependence(df, ["x"], lambda d: d.withColumn("prediction", F.col("x") * 3 + F.col("noise")), grid=4).orderBy("x").collect()
    mean = 30_000 and np.mean(np.arange(30_000) % 7)
    assert [(r["x"], round(r["y"], 6)) for r in curve] == [(x, round(3 * x + mean, 6)) for x in (0.0, 33.0, 66.0, 99.0)]


@pytest.mark.parametrize("n,block", [(2, 100), (7, 3), (1001, 100), (5000, 700)])
def test_values_are_exchanged_within_blocks(spark, monkeypatch, n, block):
    monkeypatch.setattr(explain, "BLOCK_ROWS", block)
    df = spark.range(n).selectExpr("if(id % 3 = 0, 0, id) as x", "if(id % 3 = 0, 0, id) as y", "if(id % 5 = 0, null, id) as z")
    kept = []

    def score(rows):
        got = rows.agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("z").alias("sz"), F.count("z").alias("nz"), F.count_if(F.col("x") == F.col("y")).alias("same")).first()
        kept.append(got["same"])
        assert (got["n"], got["sx"]) == (n, sum(i for i in range(n) if i % 3)) and (got["nz"], got["sz"] or 0) == (n - -(-n // 5), sum(i for i in range(n) if i % 5))
        return float(got["same"])

    rows = explain.permutation_importance(df, ["x", "z"], score, repeats=4).collect()
    assert kept[0] == n and {r["feature"] for r in rows} == {"x", "z"} and {r["feature"]: r["mean"] for r in rows}["z"] == 0
    if n > 1000:  # a third of the rows are alike: by chance a ninth meet their own value
        assert np.mean([k for k in kept[1:] if k < n]) == pytest.approx(n / 9, rel=0.25)


def test_repeats_keep_and_sort_nothing_and_come_near_the_mean_of_all_exchanges(spark):
    df = spark.range(3000).selectExpr("id % 50 as x", "id * 7919 % 9 as z", "3.0 * (id % 50) + id * 104729 % 3000 as y")
    kept, plans = [], []

    def score(rows):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0])
        fall = -rows.agg(F.avg((F.col("y") - 3 * F.col("x") - 20 * F.col("z")) ** 2)).first()[0]
        kept.append(spark.sparkContext._jsc.getPersistentRDDs().size())
        return fall

    got = {r["feature"]: r["mean"] for r in explain.permutation_importance(df, ["x", "z"], score).collect()}
    assert len(kept) == 21 and len(set(kept)) == 1 and not any("Window" in p or "Sort" in p or "Repartition" in p for p in plans)
    k = np.arange(3000)
    x, z = k % 50, k * 7919 % 9
    y = 3.0 * x + k * 104729 % 3000
    for feature, v, b, rest in (("x", x, 3, y - 20 * z), ("z", z, 20, y - 3 * x)):
        mean = np.var(rest) + b**2 * np.var(v) + (np.mean(rest) - b * np.mean(v)) ** 2 - np.mean((y - 3 * x - 20 * z) ** 2)
        assert got[feature] == pytest.approx(mean, abs=0.1 * 2 * b * np.std(v) * np.std(y) / 3000**0.5)  # a third of what ten exchanges drawn apart are off by


@pytest.mark.parametrize("rows,size", [(700, 1 << 30), (1 << 30, 700 * 48)])
def test_blocks_share_equal_rows_and_do_not_depend_on_partitions(spark, monkeypatch, rows, size):
    monkeypatch.setattr(explain, "BLOCK_ROWS", rows)
    monkeypatch.setattr(explain, "BLOCK_BYTES", size)
    df = spark.range(6000).selectExpr("if(id % 3 = 0, null, id) as x", "if(id % 3 = 0, 0, id) as `y.y`", "if(id % 3 > 0, -id, id % 2) as z")
    made = []
    for parts in (1, 7):
        blocks, n = explain._blocks(df.repartition(parts), ["x", "z"], 42)
        assert n == 6000
        made.append(sorted(blocks.collect()))
    assert made[0] == made[1] and len(made[0]) == 9
    held = [[tuple(r) for r in b["_rows"]] for b in made[0]]
    assert sorted((r for h in held for r in h), key=str) == sorted(((None, 0, i // 3 % 2) if i % 3 == 0 else (i, i, -i) for i in range(6000)), key=str)
    assert all(h.count((None, 0, k)) in (111, 112) for h in held for k in (0, 1)) and all(h != sorted(h, key=str) for h in held)
    assert all(b["_v0"] == sorted((r[0] for r in h), key=lambda v: (v is not None, v)) for b, h in zip(made[0], held, strict=True))


def test_ordinal_codes_are_ranks(spark):
    df = spark.createDataFrame([("b", "low"), ("a", "high"), (None, "odd"), ("c", None), ("b", "low")], "k string, o string")
    got = features.ordinal_encode(df, ["k", "o"], {"o": ["low", "high"]})
    assert got.columns == ["k", "o"] and sorted(map(tuple, got.collect()), key=str) == sorted([(1, 0), (0, 1), (None, None), (2, None), (1, 0)], key=str)


# ---------------------------------------------------------------- what once went wrong, with the numbers of that time


def test_distinct_counts_are_exact_at_any_number(spark):
    from quillstat.operators.profile import column_facts

    df = spark.range(50_000).selectExpr("cast(id as string) as t", "id % 20011 as k", "if(id % 7 = 0, null, id / 3) as d")
    assert {f.name: f.distinct for f in column_facts(df)} == {"t": 50_000, "k": 20_011, "d": 42_857 + 1}


def test_fences_of_small_numbers_are_not_rounded(spark):
    small = [k * 1e-6 for k in range(1, 21)]
    df = spark.createDataFrame([(v,) for v in [*small, 1e-3]], "v double")
    kept = sorted(r["v"] for r in clean.handle_outliers(df, ["v"], action="remove").collect())
    assert kept == pytest.approx(small)
    low, high = np.quantile([*small, 1e-3], [0.25, 0.75])
    assert max(r["v"] for r in clean.handle_outliers(df, ["v"], action="clip").collect()) == pytest.approx(high + 1.5 * (high - low))
    clipped = [r["v"] for r in clean.handle_outliers(df, ["v"], "zscore", "clip").collect()]
    assert max(clipped) == pytest.approx(np.mean([*small, 1e-3]) + 3 * np.std([*small, 1e-3], ddof=1))


def test_last_of_duplicates_without_an_order(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, _at string").coalesce(1)
    assert sorted((r["k"], r["_at"]) for r in clean.exact_duplicates(df, ["k"], "last").collect()) == [(1, "b"), (2, "c")]
    rows = spark.createDataFrame([(5, "x"), (3, "x"), (9, None), (7, None), (1, "y")], "id int, t string")
    assert sorted(r["id"] for r in clean.duplicate_rows(rows, "id").collect()) == [5, 9]


@pytest.mark.parametrize("names", [("ra", "rb"), ("value", "rank"), ("x", "y"), ("n", "a b")])
def test_spearman_of_any_column_names(spark, names):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 9, 300)
    y = x + rng.integers(0, 6, 300)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], ", ".join(f"`{n}` double" for n in names))
    rank = lambda v: np.array([(v < k).sum() + ((v == k).sum() + 1) / 2 for k in v])
    assert infer.correlation(df, *names, "spearman").first()["r"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])


def test_nan_is_a_missing_value(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", nan), ("b", 5.0), ("b", None)], "g string, v double")
    assert {r["g"]: r["v_target_encoded"] for r in features.target_encode(df.withColumnRenamed("v", "v"), ["g"], "v").withColumnRenamed("g_target_encoded", "v_target_encoded").collect()} == {"a": pytest.approx((4 + 10 * 3) / 12), "b": pytest.approx((5 + 10 * 3) / 11)}
    scaled, params = features.scale(df, ["v"])
    assert params["v"] == pytest.approx((3.0, np.std([1, 3, 5]))) and [r["v"] for r in scaled.filter("g = 'b'").collect()].count(None) == 2
    bounds = clean.outlier_bounds(spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0, nan)], "v double"), ["v"], "zscore").first()
    assert bounds["upper"] == pytest.approx(2.5 + 3 * np.std([1, 2, 3, 4], ddof=1)) and bounds["n"] == 4
    assert sorted(r["v"] for r in missing.apply_strategies(df, {"v": "mean"}).collect()) == [1, 3, 3, 3, 5]


@pytest.mark.parametrize("by", [None, ["g"]])
@pytest.mark.parametrize("forward", [True, False])
def test_fills_are_carried_across_partitions(spark, by, forward):
    draw = random.Random(6)
    rows = [(k, draw.choice(["p", "q", None]), float(k) if draw.random() < 0.05 else None) for k in range(2000)]
    df = spark.createDataFrame(rows, "k int, g string, v double").repartition(5)
    plan = missing.directed_fill(df, "v", ["k"], by, forward)
    got = {r["k"]: r["v"] for r in plan.collect()}
    last = {}
    for k, g, v in rows if forward else rows[::-1]:
        group = g if by else 0
        last[group] = v if v is not None else last.get(group)
        assert got[k] == last[group]
    if not by:
        assert "SinglePartition" not in plan._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_quantiles_of_odd_columns(spark):
    """Scales of all sizes, infinities, heavy values and tiny spreads, more values than are picked at once."""
    from quillstat.functions import ranks

    rng = np.random.default_rng(11)
    columns = {
        "wide": 10.0 ** rng.uniform(-300, 300, 30_000),
        "heavy": np.where(rng.random(30_000) < 0.6, 5.0, rng.normal(size=30_000)),
        "close": 1e9 + rng.random(30_000) * 1e-6,
        "ends": np.where(rng.random(30_000) < 0.01, np.inf, rng.normal(size=30_000)),
    }
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns.values(), strict=True)], ", ".join(f"{c} double" for c in columns)).persist()
    shares = [0.0, 0.25, 0.5, 0.9, 0.999, 1.0]
    for picked in (20_000, 50):
        ranks.VALUES_PICKED = picked
        try:
            got = quantiles(df, {c: F.col(c) for c in columns}, shares)
        finally:
            ranks.VALUES_PICKED = 20_000
        for c, x in columns.items():
            x = np.sort(x)
            want = [x[int(math.floor(s * 29_999))] + (0.0 if x[int(math.floor(s * 29_999))] == x[int(math.ceil(s * 29_999))] else (x[int(math.ceil(s * 29_999))] - x[int(math.floor(s * 29_999))]) * (s * 29_999 - math.floor(s * 29_999))) for s in shares]
            assert got[c] == pytest.approx(want, rel=1e-12), c
    df.unpersist()


def test_codes_do_not_know_their_own_target(spark):
    draw = random.Random(3)
    rows = [(k, draw.choice("abc") if draw.random() < 0.9 else None, draw.random(), k % 4) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, g string, y double, f int")
    codes = features.TargetCodes(df, ["g"], "y", F.col("f"))
    got = {r["k"]: r["g_target_encoded"] for r in codes.apply_out_of_fold(df).collect()}
    for k, g, _, f in rows:
        rest = [y for _, _, y, o in rows if o != f]
        own = [y for _, h, y, o in rows if o != f and h == g]
        mean = sum(rest) / len(rest)
        assert got[k] == pytest.approx(mean if g is None else (sum(own) + 10 * mean) / (len(own) + 10))
    fresh = spark.createDataFrame([("a", 1e9), ("new", 1e9), (None, 1e9)], "g string, y double")
    made = {r["g"]: r["g_target_encoded"] for r in codes.apply(fresh).collect()}
    whole = sum(r[2] for r in rows) / 400
    a = [y for _, g, y, _ in rows if g == "a"]
    assert made == {"a": pytest.approx((sum(a) + 10 * whole) / (len(a) + 10)), "new": pytest.approx(whole), None: pytest.approx(whole)}


def test_wide_matrices_in_one_job(spark):
    from quillstat.functions.linalg import moments

    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 300)) + 1e6
    x[rng.random(x.shape) < 0.05] = np.nan
    names = [f"c{k}" for k in range(300)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names)).repartition(3)
    got = features.pairwise(df, names)
    for i, j in ((0, 1), (5, 200), (299, 17)):
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert got[i, j] == got[j, i] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    whole = np.where(np.isnan(x), 1e6, x)[:, :40]
    m = moments(spark.createDataFrame([tuple(map(float, r)) for r in whole], ", ".join(f"{n} double" for n in names[:40])), names[:40])
    assert m.n == 150 and m.mean == pytest.approx(whole.mean(0)) and m.cross == pytest.approx(np.cov(whole.T) * 149, abs=1e-5)


def test_p_values_of_all_tests_against_known_tails(spark):
    """Statistics chosen so that tables of the distributions give the tails."""
    from quillstat.functions.special import chi2_upper, f_upper, t_two_sided

    for t, df, p in ((2.228, 10, 0.05), (3.169, 10, 0.01), (12.706, 1, 0.05), (1.96, 1e7, 0.05), (2.042, 30, 0.05)):
        assert t_two_sided(t, df) == pytest.approx(p, abs=2e-4)
    for x, df, p in ((3.841, 1, 0.05), (9.210, 2, 0.01), (18.307, 10, 0.05), (124.342, 100, 0.05)):
        assert chi2_upper(x, df) == pytest.approx(p, abs=2e-5)
    for f, a, b, p in ((4.965, 1, 10, 0.05), (3.885, 2, 12, 0.05), (4.431, 4, 20, 0.01), (2.012, 8, 60, 0.06)):
        assert f_upper(f, a, b) == pytest.approx(p, abs=1.5e-3)
    two = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 5)] + [("b", float(v)) for v in (3, 4, 5, 6, 7)], "g string, v double")
    got = {r["test"]: r for r in infer.hypothesis_tests(two, [{"type": "t-test", "columns": ["v", "g"]}, {"type": "anova", "columns": ["v", "g"]}]).collect()}
    # equal variances 2.5 of 5 each: t = -2 with 8 degrees of freedom, of which the tails are 0.0805; F is its square
    assert got["t-test"]["statistic"] == -2.0 and got["t-test"]["p_value"] == pytest.approx(0.0805, abs=1e-4)
    assert got["anova"]["statistic"] == 4.0 and got["anova"]["p_value"] == pytest.approx(0.0805, abs=1e-4)
    cells = [("x", "u")] * 10 + [("x", "v")] * 20 + [("y", "u")] * 20 + [("y", "v")] * 10
    chi = infer.hypothesis_tests(spark.createDataFrame(cells, "a string, b string"), [{"type": "chi-square", "columns": ["a", "b"]}]).first()
    assert chi["statistic"] == 5.4 and chi["p_value"] == pytest.approx(0.0201, abs=1e-4)  # 4 * (5 - 0.5)^2 / 15
    line = spark.createDataFrame([(float(k), float(k * k % 7)) for k in range(12)], "x double, y double")
    r = np.corrcoef(range(12), [k * k % 7 for k in range(12)])[0, 1]
    found = infer.correlations(line, [("x", "y")], {"x": "continuous", "y": "continuous"}).first()
    if found["method"] == "pearson":
        assert found["p_value"] == pytest.approx(t_two_sided(r * math.sqrt(10 / (1 - r * r)), 10), abs=1e-4)


def test_variant_correlations_by_the_clients_rules(spark):
    rows = [(k % 4, "Yes" if k % 3 else "no", float(k), None if k else 1.0) for k in range(60)]
    df = spark.createDataFrame(rows, "o int, b string, c double, gone double")
    types = {"o": "ordinal", "b": "binary", "c": "continuous", "gone": "continuous"}
    got = {(r["column_a"], r["column_b"]): r for r in infer.variant_correlations(df, types, order=["c"]).collect()}
    assert set(got) == {("o", "b"), ("o", "c"), ("b", "c")}  # a column missing in over 80 % is left out
    rank = np.argsort(np.argsort([r[0] for r in rows], kind="stable"), kind="stable")
    assert got["o", "c"]["method"] == "spearman" and got["o", "c"]["r"] == pytest.approx(np.corrcoef(rank, range(60))[0, 1])
    assert got["b", "c"]["method"] == "pearson" and got["b", "c"]["r"] == pytest.approx(np.corrcoef([r[1] == "Yes" for r in rows], range(60))[0, 1])
    assert got["o", "b"]["r"] == 0.0  # words have no ranks


def test_selection_values(spark):
    """Lasso against its optimality conditions, components against numpy, forests on a planted feature."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 3)) * [1, 5, 0.1]
    x[:, 1] += 2 * x[:, 0]
    y = 3 * x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=400) * 0.1
    df = spark.createDataFrame([tuple(map(float, (*r, t))) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y double")
    w = features.lasso(df, ["a", "b", "c"], "y", alpha=0.05)
    z = (x - x.mean(0)) / x.std(0)
    slope = z.T @ (y - y.mean() - z @ np.array([w[k] for k in "abc"])) / 400
    for k, c in enumerate("abc"):
        assert (slope[k] == pytest.approx(0.05 * np.sign(w[c]), abs=1e-6)) if w[c] else abs(slope[k]) <= 0.05 + 1e-9
    made, explained = features.pca(df.select("a", "b", "c"), ["a", "b", "c"], components=3)
    values = np.linalg.eigvalsh(np.corrcoef(x.T))[::-1]
    assert explained == pytest.approx((values / 3).tolist())
    got = np.array([[r["PC1"], r["PC2"], r["PC3"]] for r in made.collect()])
    assert np.cov(got.T, ddof=0) == pytest.approx(np.diag(values), abs=1e-8)
    importance = features.forest_importance(df, ["a", "b", "c"], "y", trees=20, depth=5)
    assert importance["c"] < 0.05 and sum(importance.values()) == pytest.approx(1)
    assert features.select_by_importance(df, ["a", "b", "c"], "y", top=2, trees=20, depth=5) != ["c"]


def test_a_report_of_all_explanations_and_charts(spark):
    from quillstat.plans.insight import all_charts, explanation_report, words

    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 3))
    df = spark.createDataFrame([(*map(float, r), float(4 * r[0] + r[1] ** 2)) for r in x], "a double, b double, c double, y double")
    report = training.experiment(df, "y", ["a", "b", "c"], ["ridge", "random_forest"], "none", folds=2, validate=False)
    rows = df.withColumnRenamed("y", "label")
    for name in ("ridge", "random_forest"):
        fitted = training.build(name, False, ["a", "b", "c"], {}).fit(rows)
        out = explanation_report(fitted, rows, rows.limit(100), ["a", "b", "c"], False, name=name, repeats=2, grid=5)
        assert out["top"][0] == "a" and {"permutation", "attributions", "partial_dependence", "local"} <= set(out["methods"])
        assert ("builtin" in out["methods"]) == (name == "random_forest") and ("coefficients" in out["methods"]) == (name == "ridge")
        assert "a" in out["summary"]
    scored = fitted.transform(rows).withColumnRenamed("label", "actual")
    made = all_charts(out, report, scored)
    assert set(made) == {"featureImportance", "shapSummary", "partialDependence", "modelComparison", "businessDashboard", "residuals", "predictedVsActual"}
    assert [r["feature"] for r in made["shapSummary"]["data"].collect()][0] == "a"
    line = made["predictedVsActual"]["diagonal"]
    assert line["x1"] == line["y1"] < line["x2"] == line["y2"] and made["predictedVsActual"]["data"].count() == 400
    assert sum(r["count"] for r in made["residuals"]["data"].collect()) == 400
    assert {r["model"] for r in made["modelComparison"]["data"]} == {"ridge", "random_forest"}
    assert "explains" in words(report, "y", 1.0, 4.0)["summary"]


@pytest.mark.parametrize("threshold", [0.85, 0.8, 0.6])
def test_similar_digits_lose_no_pair(spark, threshold):
    """Strings of few different characters and mixed lengths, met by deletions or by characters."""
    draw = random.Random(12)
    words = sorted({"".join(draw.choice("0123456789"[: draw.choice([2, 10])]) for _ in range(draw.choice([3, 5, 8, 10, 10, 11, 14, 30]))) for _ in range(140)} | {"0000000001", "0000000010", "000", "00"})
    df = spark.createDataFrame([(w,) for w in words], "v string")
    got = {(r["v"], r["w"]) for r in similar_values(df, df, threshold).collect()}
    assert got == {(a, b) for a in words for b in words if similar(a, b, threshold)}


def test_a_hundred_thousand_numbers_in_a_minute(spark):
    import time

    draw = random.Random(1)
    words = {"".join(draw.choice("0123456789") for _ in range(10)) for _ in range(100_000)}
    df = spark.createDataFrame([(w,) for w in words], "v string").repartition(8)
    begun = time.time()
    got = similar_values(df, df, 0.85).filter("v < w").collect()
    assert time.time() - begun < 60 and len(got) > 100
    assert all(difflib.SequenceMatcher(None, r["v"], r["w"]).ratio() >= 0.85 for r in got)


def knn_by_all_pairs(rows, k):
    """Every gap against every distinct donor, in plain loops; donors count as often as they have rows."""
    from collections import Counter

    donors, p = Counter(rows), len(rows[0])
    means = [np.mean([r[c] for r in rows if r[c] is not None]) for c in range(p)]
    key = lambda r: tuple((v is None, v or 0.0) for v in r)  # a missing value comes last
    out = []
    for row in rows:
        made = list(row)
        for c in (c for c in range(p) if row[c] is None):
            near = []
            for d, n in donors.items():
                both = [j for j in range(p) if row[j] is not None and d[j] is not None]
                if d[c] is not None and both:
                    near.append((math.sqrt(sum((row[j] - d[j]) ** 2 for j in both) * p / len(both)), key(d), d[c], n))
            left, total = k, 0.0
            for _, _, v, n in sorted(near):
                total += min(left, n) * v
                left -= min(left, n)
            made[c] = total / (k - left) if left < k else means[c]
        out.append(tuple(made))
    return out


@pytest.mark.parametrize("block_rows", [5, 40, 2000])
def test_nearest_neighbours_in_blocks_are_those_of_all_pairs(spark, block_rows):
    draw = random.Random(block_rows)
    rows = [tuple(None if draw.random() < 0.25 else float(draw.randrange(40)) if c else round(draw.gauss(0, 30), 1) for c in range(3)) for _ in range(260)]
    rows += [(None, None, None), (5.0, None, None), (5.0, None, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, a double, b double, c double")
    got = {r["id"]: (r["a"], r["b"], r["c"]) for r in missing.knn_impute(df, ["a", "b", "c"], block_rows=block_rows).collect()}
    want = knn_by_all_pairs(rows, 5)
    for k, w in enumerate(want):
        assert got[k] == pytest.approx(w), rows[k]


def test_few_pairs_are_computed_on_a_large_table(spark, monkeypatch):
    df = spark.range(100_000).select("id", F.when(F.col("id") % 5 != 0, F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double")).alias("a"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10_000_000)) / 100).alias("b"))
    pairs, own = [], missing._compared

    def counted(asked, donors, columns, k):
        both = asked.groupBy("_block").agg(F.count("*").alias("x")).join(donors.groupBy("_block").agg(F.count("*").alias("y")), "_block")
        pairs.append(both.agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0)
        return own(asked, donors, columns, k)

    monkeypatch.setattr(missing, "_compared", counted)
    assert missing.knn_impute(df, ["a", "b"]).filter("a is null").isEmpty()
    assert sum(pairs) < 0.1 * 20_000 * 100_000
