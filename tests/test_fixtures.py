"""Small tables with results worked out by hand, from file to answer."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillstat.operators import charts, clean, describe, features, infer, profile, regress, training
from quillstat.plans import planner
from quillstat.plans.intake import lightweight, parse_file, parse_table

#: Ten people, as text with a byte order mark.
PEOPLE = """﻿name,age,score,passed,gender
Alice,25,88,1,F
Bob,30,72,0,M
Charlie,22,95,1,M
Diana,28,64,0,F
Eve,35,91,1,F
Frank,40,55,0,M
Grace,19,78,1,F
Henry,33,82,0,M
Iris,27,96,1,F
Jack,31,70,0,M"""


@pytest.fixture(scope="module")
def people(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("people") / "people.csv"
    path.write_text(PEOPLE, encoding="utf-8")
    return parse_file(spark, str(path), path.stat().st_size)


def numbers(spark, values, name="x"):
    return spark.createDataFrame([(float(v) if v is not None else None,) for v in values], f"{name} double")


def test_people_are_read_and_profiled(people):
    assert people.rows == 10 and [c["name"] for c in people.columns] == ["name", "age", "score", "passed", "gender"]
    assert [c["type"] for c in people.columns] == ["categorical", "ordinal", "ordinal", "binary", "categorical"]
    assert people.missing.count() == 0 and people.sample[0] == {"name": "Alice", "age": 25, "score": 88, "passed": 1, "gender": "F"}
    assert people.columns[4]["uniqueValues"] == ["F", "M"] and len(people.columns[0]["uniqueValues"]) == 10


def test_people_are_described_and_tested(people):
    got = {r["column"]: r for r in describe.describe(people.table, ["age", "score"]).collect()}
    assert got["age"]["mean"] == pytest.approx(29.0) and got["score"]["mean"] == pytest.approx(79.1)
    types = {c["name"]: c["type"] for c in people.columns}
    pair = infer.correlations(people.table, [("age", "score")], types).first()
    assert pair["method"] == "spearman" and pair["n"] == 10
    ages, scores = [25, 30, 22, 28, 35, 40, 19, 33, 27, 31], [88, 72, 95, 64, 91, 55, 78, 82, 96, 70]
    apart = sum((sorted(ages).index(a) - sorted(scores).index(s)) ** 2 for a, s in zip(ages, scores, strict=True))
    assert pair["r"] == pytest.approx(1 - 6 * apart / (10 * 99), abs=1e-4)
    test = infer.hypothesis_tests(people.table, [{"type": "t-test", "columns": ["score", "gender"]}]).first()
    f, m = [88, 64, 91, 78, 96], [72, 95, 55, 82, 70]
    var = lambda x: sum((v - sum(x) / 5) ** 2 for v in x) / 4
    assert test["statistic"] == pytest.approx((sum(f) - sum(m)) / 5 / math.sqrt(var(f) / 5 + var(m) / 5), abs=1e-4)
    with pytest.raises(ValueError):  # ten rows are too few for a forest
        regress.random_forest(people.table, "score", ["age"])


def test_ten_numbers(spark):
    got = describe.describe(numbers(spark, range(1, 11)), ["x"]).first()
    assert (got["count"], got["mean"], got["median"], got["min"], got["max"]) == (10, 5.5, 5.5, 1, 10) and got["skewness"] == pytest.approx(0, abs=1e-9)
    assert describe.describe(numbers(spark, [1, None, 3]), ["x"]).first()["null_count"] == 1


def test_outliers_of_few_and_more_rows(spark):
    (low, high) = clean.fences(numbers(spark, [*range(1, 10), 100]), ["x"])["x"]
    assert low < high < 100
    few = clean.outlier_bounds(numbers(spark, [1, 2, 3]), ["x"]).first()
    assert (few["n"], few["lower"], few["outliers"]) == (3, None, 0)
    assert clean.outlier_bounds(numbers(spark, [*range(1, 10), 100]), ["x"]).first()["outliers"] == 1


@pytest.mark.parametrize("n,share,want", [(10, 0.3, 3), (5, 0.2, 1), (0, 0.2, 0)])
def test_splits_are_exact_and_lose_nothing(spark, n, share, want):
    got = training.stratified_split(spark.range(n), None, F.col("id"), share, 0.0).collect()
    assert sum(r["split"] == "test" for r in got) == want and sorted(r["id"] for r in got) == list(range(n))


def test_scaled_and_encoded(spark):
    scaled, params = features.scale(numbers(spark, [1, 2, 3, 4, 5]), ["x"])
    assert scaled.agg(F.avg("x")).first()[0] == pytest.approx(0, abs=1e-10) and params["x"][0] == 3
    colours, report = features.one_hot(spark.createDataFrame([(c,) for c in ("red", "blue", "green", "red")], "color string"), ["color"])
    assert report["color"] == {"encoded": ["color_green", "color_red"], "reference": "blue"} and set(colours.columns) == {"color_green", "color_red"}


def test_lines_and_inflation(spark):
    exact = spark.range(50).selectExpr("cast(id as double) as x", "3.0 * id + 7 as y")
    line = regress.linear(exact, "y", ["x"])
    assert line.coefficients[0] == pytest.approx(3) and line.intercept == pytest.approx(7) and line.metrics["r2"] > 0.99
    draw = random.Random(1)
    rows = [(float(i), draw.random() * 50) for i in range(1, 101)]
    noisy = spark.createDataFrame([(a, b, 2 * a + 0.3 * b + 1 + draw.random()) for a, b in rows], "x1 double, x2 double, y double")
    both = regress.linear(noisy, "y", ["x1", "x2"])
    assert len(both.coefficients) == 2 and 0.99 < both.metrics["r2"] <= 1 and set(both.vif) == {"x1", "x2"} and min(both.vif.values()) > 0
    assert infer.fitted_rows(noisy, infer.regression(noisy, "y", ["x1", "x2"])).count() == 100


def test_codes_left_open_are_settled_by_detection(spark):
    rows = spark.createDataFrame([(1, 1, 3, 1), (2, 2, 0, 5), (1, 3, 10, 2), (2, 1, 7, 4)], "sex int, marital int, pain_level int, q1 int")
    codes = profile.column_codes(profile.column_facts(rows), {"marital": {"1": "single"}})
    assert {c.name: (c.coded, c.uncertain) for c in codes} == {"sex": (True, False), "marital": (True, False), "pain_level": (True, False), "q1": (False, True)}
    assert profile.uncertain_columns(codes) == ["q1"] and profile.labelled_columns(codes) == ["marital"]
    found = profile.apply_code_detection(codes, {"q1": {"coded": True, "labels": {"1": "never", "5": "always"}}, "marital": {"coded": False}})
    assert profile.uncertain_columns(found) == [] and {c.name: c.coded for c in found}["marital"] and found[1].labels == {"1": "single"}
    assert [r[0] for r in rows.select(profile.labelled_value(found[3], F.col("q1"))).collect()] == ["never", "always", "2", "4"]
    assert profile.apply_code_detection(codes, {}) == codes


def test_profiles_are_made_small(spark):
    df = spark.range(300).selectExpr("id", "cast(id % 40 as string) as few", "cast(null as int) as none", "7 as same")
    whole = parse_table(df, "t")
    by = {c["name"]: c for c in whole.columns}
    assert len(whole.sample) == 200 and len(by["id"]["uniqueValues"]) == 20 and len(by["few"]["uniqueValues"]) == 40
    assert by["none"]["uniqueValues"] == [] and by["none"]["constant"] and by["same"]["constant"] and not by["few"]["constant"]
    small = lightweight(whole)
    assert small.table is None and len(small.sample) == 50 and {c["name"]: len(c["uniqueValues"]) for c in small.columns} == {"id": 20, "few": 20, "none": 0, "same": 1}
    assert parse_table(df.limit(0), "empty").rows == 0


def test_requests_describe_what_charts_show():
    found = {"descriptiveColumns": ["a", "b"], "correlationPairs": [("a", "b")], "dependentVariable": "y", "predictors": ["a"], "modelType": "linear"}
    got = planner.request_of(found, [{"chart": "scatter", "x": "c", "y": "a"}, {"chart": "histogram", "column": "d"}])
    assert got["descriptive"]["columns"] == ["a", "b", "c", "d"] and got["predictive"] == {"dependent": "y", "predictors": ["a"], "modelType": "linear"}
    other = planner.request_of(found, [], [{"dependent": "z", "predictors": ["b"], "modelType": "multiple"}])
    assert other["inferential"]["regression"] == {"dependent": "z", "predictors": ["b"]} and other["predictive"]["modelType"] == "multiple"
    assert planner.request_of({"descriptiveColumns": ["a"]})["predictive"] is None


def test_example_predictions(spark):
    rows = spark.createDataFrame([(1.0, -1.0), (2.0, 2.0), (9.0, 9.0), (3.0, -3.0), (None, 1.0)], "a double, b double")
    got = charts.example_prediction(rows, ["a", "b"], [2.0, 1.0], 0.5)  # sizes 2, 4, 6, 18: of two middles the greater
    assert [c["value"] for c in got["conditions"]] == [3.0, -3.0] and got["prediction"] == 3.5 and not got["probability"]
    assert charts.example_prediction(rows, ["a"], [2.0], -6.0, "logistic")["prediction"] == pytest.approx(0.5)  # 1, 2, 3, 9: 3
    gaps = spark.createDataFrame([(1.0, None), (None, 5.0)], "a double, b double")
    assert charts.example_prediction(gaps, ["a", "b"], [1.0, 1.0], 0.0)["prediction"] == 6.0
    assert charts.example_prediction(rows, ["a"], [], 0.0) is None


@pytest.mark.parametrize("n,default,ui", [(9, 5, 3), (100, 10, 10), (101, 10, 11), (10_000, 20, 20)])
def test_bins_of_residuals(n, default, ui):
    assert (charts.residual_bins(n), charts.residual_bins(n, "ui")) == (default, ui)
