"""A file in, its table, the profile of its columns and the report of what is missing out; and the same made small."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.operators import profile
from quillstat.sources.ingest import ROW_ID, read_frame, validate_upload

SHOWN_ROWS, SHOWN_UNIQUE, CLIENT_ROWS, CLIENT_UNIQUE, CLIENT_FEW = 50, 20, 200, 50, 20


@dataclass(frozen=True)
class Parsed:
    """A table that was read: its frame, its columns' facts, types and least values, its first rows and what it misses."""

    name: str
    table: DataFrame | None
    rows: int
    columns: list[dict]
    sample: list[dict]
    missing: DataFrame | None


def _least_values(df: DataFrame, facts: list[profile.Facts], most: int, few: int) -> dict[str, list]:
    """All values of columns of at most `most`, else the `few` least: one aggregation of sets that are bounded by what
    the facts say, and one small job a column beyond that."""
    bounded = [f.name for f in facts if f.distinct <= most + 1]
    got = df.agg(*[F.sort_array(F.collect_set(F.col(f"`{c}`"))).alias(c) for c in bounded]).first().asDict() if bounded else {}
    for f in facts:
        if f.name not in got:
            got[f.name] = [r["value"] for r in profile.unique_values(df, f.name, few).collect()]
        elif len(got[f.name]) > most:
            got[f.name] = got[f.name][:few]
    return got


def parse_table(df: DataFrame, name: str, rows: int = CLIENT_ROWS, most: int = CLIENT_UNIQUE, few: int = CLIENT_FEW) -> Parsed:
    """Profile a table: name, type, nulls, distinct, codes, constant flag and least values of each column, the first rows,
    and the report of missing values. The table itself stays in Spark."""
    bare = df.drop(ROW_ID)
    facts = profile.column_facts(bare)
    least = _least_values(bare, facts, most, few)
    columns = []
    for f in facts:
        coded, uncertain = profile.coding(f)
        columns.append({"name": f.name, "type": profile.analysis_type(f), "nulls": f.nulls, "distinct": f.distinct, "coded": coded, "uncertain": uncertain, "constant": f.distinct - (f.nulls > 0) <= 1, "uniqueValues": least[f.name]})
    ordered = df.orderBy(ROW_ID) if ROW_ID in df.columns else df
    sample = [r.asDict() for r in ordered.drop(ROW_ID).limit(rows).collect()]
    return Parsed(name, df, facts[0].rows if facts else 0, columns, sample, profile.missing_report(bare))


def parse_file(spark: SparkSession, path: str, size: int | None = None) -> Parsed:
    """Read a file, turn its null words into nulls, and profile it; an input that may not be loaded is refused."""
    if size is not None and (wrong := validate_upload(path, size)):
        raise ValueError(wrong)
    return parse_table(read_frame(spark, path), path)


def lightweight(parsed: Parsed, rows: int = SHOWN_ROWS, unique: int = SHOWN_UNIQUE) -> Parsed:
    """The profile as a payload: no table, fewer rows, and at most `unique` values a column."""
    columns = [c | {"uniqueValues": c["uniqueValues"][:unique]} for c in parsed.columns]
    return replace(parsed, table=None, sample=parsed.sample[:rows], columns=columns, missing=None)
