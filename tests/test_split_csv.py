"""Text tables with quoted line breaks: many tasks on one file, the rows of the slow reader."""

import random

import pytest

from quillstat.sources.ingest import read_frame
from quillstat.sources.split_csv import line_maps, read_split_csv, records


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def slow(spark, path, sep=","):
    return spark.read.csv(path, header=True, sep=sep, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=False, mode="PERMISSIVE", multiLine=True, escape='"', maxCharsPerColumn=-1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def field(draw, sep):
    kind = draw.random()
    plain = "".join(draw.choice("abc xyz") for _ in range(draw.randint(1, 8))).strip() or "q"
    if kind < 0.4:
        return plain
    if kind < 0.5:
        return plain + '"' + plain  # a quote inside an unquoted field opens nothing
    inner = "".join(draw.choice(["a", "b", " ", "\n", "\r\n", '""', sep, "é", "\n\n"]) for _ in range(draw.randint(0, 30)))
    return (" " if draw.random() < 0.2 and sep != "\t" else "") + '"' + inner + '"'


@pytest.mark.parametrize("sep", [",", "\t"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_the_slow_readers_rows(spark, tmp_path, small_ranges, sep, end):
    draw = random.Random(len(sep + end))
    path = tmp_path / "t.csv"
    table = [sep.join(["id", "one", "two", "Two"])] + [sep.join([str(k), *[field(draw, sep) for _ in range(3)]]) for k in range(300)]
    path.write_text(end.join(table) + end, newline="")
    got = read_split_csv(spark, str(path), sep)
    want = slow(spark, str(path), sep)
    assert got.columns == want.columns
    assert rows(got) == rows(want)
    assert records(spark, str(path), sep).select("start").distinct().count() > 10  # many ranges


def test_records_longer_than_ranges_and_short_files(spark, tmp_path, small_ranges):
    path = tmp_path / "long.csv"
    long = "line\n" * 1000
    path.write_text(f'a,b\n1,"{long}"\n2,x\n\n3,"y\nz"\n4\n5,"open at the end\nof it', newline="")
    got = {r["a"]: r["b"] for r in read_split_csv(spark, str(path)).collect()}
    assert got["1"] == long and got["2"] == "x" and got["3"] == "y\nz" and got["4"] is None and set(got) == {"1", "2", "3", "4", "5"}
    (tmp_path / "empty.csv").write_text("")
    assert read_split_csv(spark, str(tmp_path / "empty.csv")).count() == 0
    (tmp_path / "head.csv").write_text('"a\nb",c,\n')
    assert read_split_csv(spark, str(tmp_path / "head.csv")).columns == ["a\nb", "c", "_c2"] and read_split_csv(spark, str(tmp_path / "head.csv")).count() == 0


def test_lines_are_put_together_once(spark, tmp_path):
    """Header, numbers of files, types and rows are all read from records made once, so no plan runs Python again."""
    for k in range(2):
        (tmp_path / f"p{k}.csv").write_text("n,t\n" + "".join(f'{10 * k + j},"a\n{j}"\n' for j in range(5)))
    got = read_frame(spark, str(tmp_path / "p*.csv"))
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["n"], r["t"]) for r in got.collect()) == [(10 * k + j, f"a\n{j}") for k in range(2) for j in range(5)]


def test_several_files_and_types(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"p{k}.csv").write_text("n,t\n" + "".join(f'{10 * k + j},"a\n{j}"\n' for j in range(5)))
    got = read_frame(spark, str(tmp_path / "p*.csv"))
    assert sorted(r["n"] for r in got.collect()) == [10 * k + j for k in range(3) for j in range(5)] and dict(got.dtypes)["n"] == "bigint"


def test_what_a_line_does_to_either_state():
    outside, inside = line_maps(",")
    opens = lambda p, v: p.fullmatch(v) is not None
    assert [opens(outside, v) for v in ('a,"b', 'a,b', '"a","b', '"a""', 'a"b', '"a"x,"', ' "a', "", '"', 'a, "b""')] == [True, False, True, True, False, True, True, False, True, True]
    assert [opens(inside, v) for v in ("x", 'x"', 'x",y', 'x","y', 'x""', "", 'x"y"', '","')] == [True, False, False, True, True, True, False, True]
    many = "a," * 20_000
    assert opens(outside, many + '"') and not opens(outside, many)
