"""Reading tables: CSV, TSV, Excel and Parquet, with one notion of a missing value."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.sources import xls
from quillstat.sources.split_csv import read_split_csv
from quillstat.sources.xlsx import read_xlsx

#: What counts as missing in text files.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null", "na")
TEXT_EXTENSIONS, EXCEL_EXTENSIONS = (".csv", ".tsv", ".txt"), (".xlsx", ".xls")
ROW_ID = "_rid"


def extension(name: str) -> str:
    return os.path.splitext(name.rstrip("/"))[1].lower()


def validate_upload(name: str, size: int) -> str | None:
    """What is wrong with an input, or None: the extension must be known, the file not empty. No size limit."""
    if extension(name) not in (*TEXT_EXTENSIONS, *EXCEL_EXTENSIONS, ".parquet"):
        return f"unsupported file type {extension(name) or '(none)'}"
    return "the file is empty" if size <= 0 else None


def with_row_id(df: DataFrame) -> DataFrame:
    """Number rows in reading order, before any shuffle."""
    return df if ROW_ID in df.columns else df.withColumn(ROW_ID, F.monotonically_increasing_id())


def nulls(df: DataFrame) -> DataFrame:
    """Null tokens in text and NaN in numbers become null."""
    kinds = dict(df.dtypes)
    own = {c: F.when(F.trim(F.col(f"`{c}`")).isin(*NULL_TOKENS), None).otherwise(F.col(f"`{c}`")) if k == "string" else F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c, k in kinds.items() if k in ("string", "double", "float")}
    return df.withColumns(own) if own else df


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns whose every value is an integer, a number or a boolean get that type. One pass for all."""
    texts = [c for c, k in df.dtypes if k == "string"]
    if not texts:
        return df
    counts = []
    for k, c in enumerate(texts):
        v = f"trim(`{c}`)"
        counts += [F.count(f"`{c}`").alias(f"n{k}"), F.count(F.expr(f"try_cast({v} as bigint)")).alias(f"i{k}"), F.count(F.expr(f"try_cast({v} as double)")).alias(f"d{k}"), F.count(F.expr(f"case when lower({v}) in ('true', 'false') then 1 end")).alias(f"b{k}")]
    got = df.agg(*counts).first()
    casts = {}
    for k, c in enumerate(texts):
        if got[f"n{k}"]:
            kind = "bigint" if got[f"i{k}"] == got[f"n{k}"] else "double" if got[f"d{k}"] == got[f"n{k}"] else "boolean" if got[f"b{k}"] == got[f"n{k}"] else None
            if kind:
                casts[c] = F.expr(f"try_cast(trim(`{c}`) as {kind})")
    return df.withColumns(casts) if casts else df


def read_frame(spark: SparkSession, path: str, infer: bool = True, multiline: bool = True) -> DataFrame:
    """A table by its extension; an unknown one is read as comma-separated text. Quoted fields may hold line breaks
    and are read by many tasks all the same; with multiline off every line is a row, which takes one pass instead of two."""
    kind = extension(path)
    if kind == ".parquet":
        return nulls(spark.read.parquet(path))
    if kind in EXCEL_EXTENSIONS:
        df = read_xlsx(spark, path, xls.sheet_rows) if kind == ".xls" else read_xlsx(spark, path)
    else:
        sep = "\t" if kind == ".tsv" else ","
        df = read_split_csv(spark, path, sep, ROW_ID) if multiline else spark.read.csv(path, header=True, sep=sep, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=False, mode="PERMISSIVE", escape='"')
    df = nulls(with_row_id(df))
    return infer_types(df) if infer else df


def read_any_columns(spark: SparkSession, path: str) -> DataFrame:
    """The lenient text reader: every value stays text, blanks are null."""
    return read_frame(spark, path, infer=False)
