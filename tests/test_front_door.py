"""Files in, requests, and results out."""

import math
import zipfile

import pytest

from quillstat.operators import training
from quillstat.plans.analyse import analyse
from quillstat.sources.ingest import read_frame, validate_upload
from quillstat.sources.xlsx import as_date

CSV = '''\ufeffname,age,height,member,note
Ann,31,1.7,true,"two
lines"
Bob,NA,1.8,false,n/a
Cy,45,,TRUE,"says ""hi"" now"
Di,28,1.6,false,x
'''


def test_csv_with_missing_values_and_quoted_lines(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text(CSV, encoding="utf-8")
    df = read_frame(spark, str(path)).drop("_rid")
    assert df.dtypes == [("name", "string"), ("age", "bigint"), ("height", "double"), ("member", "boolean"), ("note", "string")]
    got = [tuple(r) for r in df.orderBy("name").collect()]
    assert got == [("Ann", 31, 1.7, True, "two\nlines"), ("Bob", None, 1.8, False, None), ("Cy", 45, None, True, 'says "hi" now'), ("Di", 28, 1.6, False, "x")]


def test_lines_can_be_split_where_no_field_holds_one(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("a\tb\n1\tx\n2\tnull\n")
    assert [tuple(r) for r in read_frame(spark, str(path), multiline=False).drop("_rid").orderBy("a").collect()] == [(1, "x"), (2, None)]


def test_what_may_be_loaded():
    assert validate_upload("a.CSV", 3) is None and validate_upload("a.parquet", 3) is None
    assert "empty" in validate_upload("a.csv", 0) and "unsupported" in validate_upload("a.exe", 3)


MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def test_workbook_with_dates(spark, tmp_path):
    path = tmp_path / "book.xlsx"
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{LINK}"><sheets><sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {MAIN}><si><t>day</t></si><si><t>n</t></si><si><t>at</t></si></sst>")
        book.writestr("xl/styles.xml", f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="dd\\.mm\\.yy hh:mm"/><numFmt numFmtId="171" formatCode="0.0&quot; days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        cells = '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c></row><row><c r="A2" s="1"><v>45352</v></c><c r="B2" s="3"><v>45352</v></c><c r="C2" s="2"><v>45352.520833333336</v></c></row><row><c r="B3"><v>7</v></c></row>'
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}><sheetData>{cells}</sheetData></worksheet>")
    got = [tuple(r) for r in read_frame(spark, str(path)).drop("_rid").orderBy("n").collect()]
    assert got == [(None, 7, None), ("2024-03-01", 45352, "2024-03-01 12:30:00")]


def test_dates_of_both_calendars():
    assert as_date("61", False) == "1900-03-01" and as_date("60", False) == "60" and as_date("0", True) == "1904-01-01"
    assert as_date("2958466", False) == "2958466"


def test_a_request_over_a_file(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("x,y,g\n" + "".join(f"{k},{3 * k + 7},{'ab'[k % 2]}\n" for k in range(50)))
    request = {"mode": "manual", "descriptive": {"columns": ["x", "y", "gone"]}, "inferential": {"correlationPairs": [["x", "y"]], "hypothesisTests": [{"type": "t-test", "columns": ["y", "g"]}]}, "predictive": {"dependent": "y", "predictors": ["x"], "modelType": "linear"}}
    out = analyse(read_frame(spark, str(path)), request)
    assert out.rows == 50 and out.skipped == ["gone"]
    assert {r["column"]: r["mean"] for r in out.described.collect()} == {"x": 24.5, "y": 80.5}
    assert out.correlations.first()["r"] == 1.0
    test = out.tests.first()
    # the groups' means are 79 and 82, the variance of each is that of 25 numbers 6 apart
    assert test["statistic"] == pytest.approx(-3 / math.sqrt(2 * 36 * (25 * 25 - 1) / 12 * 25 / 24 / 25), abs=1e-4)
    assert out.model.coefficients == pytest.approx([3.0]) and out.model.intercept == pytest.approx(7.0)


def test_shares_of_the_split_and_seed_are_heeded(spark):
    df = spark.range(2000).selectExpr("cast(id as double) as x", "cast(3 * id as double) as y")
    made = {s: training.experiment(df, "y", ["x"], ["ridge"], "none", folds=2, validate=False, test_size=0.4, val_size=0.1, seed=s) for s in (1, 2)}
    for report in made.values():
        assert report["split"] == {"test": 800, "val": 200, "train": 1000}
        assert report["models"]["ridge"]["test_metrics"]["r2"] == pytest.approx(1.0, abs=1e-3)
    assert made[1]["baselines"]["dummy"] != made[2]["baselines"]["dummy"]  # as many rows, but others
