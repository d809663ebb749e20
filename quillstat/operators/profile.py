"""Column facts in one aggregation, and the rules that turn facts into analysis types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a column name that tell its type, text that means a boolean, and limits.
BINARY_NAMES = (
    "sex", "gender", "sexe", "gen", "married", "marital", "alive", "survival", "survived", "pregnant", "smoker", "smoking",
    "obese", "diabetic", "hypertensive", "infected", "positive", "dead", "deceased", "pass", "fail",
)
CATEGORICAL_NAMES = (
    "category", "categor", "cat", "class", "clas", "group", "grp", "grpcd", "type", "typ", "kind", "status", "education", "school",
    "occupation", "job", "profession", "region", "state", "country", "province", "sector", "sect", "company", "species", "breed",
    "race", "ethnic", "religion", "ward", "location", "department", "diagnosis", "symptom", "disease", "condition", "treatment",
    "drug", "outcome", "reason", "mode", "color", "colour", "tier",
)
ORDINAL_NAMES = (
    "level", "stage", "rank", "band", "grade", "order", "quartile", "decile", "percentile", "agecat", "agegrp", "agegroup", "grp", "group", "class", "clas",
)
BOOLEAN_WORDS = ("true", "yes", "1", "false", "no", "0")
CODE_MAX, UNIQUE_SHOWN, ORDINAL_UNIQUE, UNCERTAIN_MAX = 30, 50, 15, 20
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


def is_numeric(kind: str) -> bool:
    return kind in NUMERIC or kind.startswith("decimal")


@dataclass(frozen=True)
class Facts:
    """What the type rules need to know of a column; distinct counts a null as one value."""

    name: str
    kind: str
    rows: int
    nulls: int
    distinct: int
    low: float | None = None
    high: float | None = None
    whole: bool = False
    zero_one: bool = False
    boolean_text: bool = False


def number(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    return (c.cast("int") if kind == "boolean" else c).cast("double")


def column_facts(df: DataFrame, columns: list[str] | None = None, exact_up_to: int = 10_000) -> list[Facts]:
    """One pass over the table for all columns, and one more that counts distinct values exactly: in a set where a sketch
    says few values, else by an expanded hash aggregation, which shuffles values after a partial one."""
    kinds = {c: k for c, k in df.dtypes if columns is None or c in columns}
    first, second = [F.count(F.lit(1)).alias("rows")], []
    for i, (c, k) in enumerate(kinds.items()):
        col = F.col(f"`{c}`")
        first += [F.count(col).alias(f"n{i}"), F.approx_count_distinct(col, 0.02).alias(f"u{i}")]
        if is_numeric(k):
            x = number(c, k)
            first += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.bool_and(x == F.floor(x)).alias(f"w{i}"), F.bool_and(x.isin(0.0, 1.0)).alias(f"z{i}")]
        elif k == "string":
            first.append(F.bool_and(F.lower(F.trim(col)).isin(*BOOLEAN_WORDS, "")).alias(f"b{i}"))
    got = df.agg(*first).first()
    few = [(i, c) for i, c in enumerate(kinds) if got[f"u{i}"] <= exact_up_to]
    exact = {}
    for i, c in few:
        value = F.lower(F.trim(F.col(f"`{c}`"))) if kinds[c] == "string" and got[f"b{i}"] else None
        second.append(F.size(F.collect_set(F.col(f"`{c}`"))).alias(f"u{i}"))  # at most a little over exact_up_to values
        if value is not None:
            second.append(F.size(F.collect_set(F.when(value != "", value))).alias(f"t{i}"))
    if second:
        exact = df.agg(*second).first().asDict()
    if many := [(i, c) for i, c in enumerate(kinds) if got[f"u{i}"] > exact_up_to]:
        exact |= df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(f"u{i}") for i, c in many]).first().asDict()
    out = []
    for i, (c, k) in enumerate(kinds.items()):
        nulls = got["rows"] - got[f"n{i}"]
        own = got.asDict()
        out.append(Facts(c, k, got["rows"], nulls, exact.get(f"u{i}", got[f"u{i}"]) + (nulls > 0), own.get(f"lo{i}"), own.get(f"hi{i}"), bool(own.get(f"w{i}")), bool(own.get(f"z{i}")), 0 < (exact.get(f"t{i}") or 0) <= 2))
    return out


def name_words(name: str) -> set[str]:
    return {w for w in name.lower().replace("_", " ").replace("-", " ").split() if w.isalpha()}


def name_hints(name: str) -> tuple[bool, bool, bool]:
    """(binary, ordinal, categorical) as the name suggests."""
    words = name_words(name)
    return not words.isdisjoint(BINARY_NAMES), not words.isdisjoint(ORDINAL_NAMES), not words.isdisjoint(CATEGORICAL_NAMES)


def analysis_type(f: Facts) -> str:
    """continuous, categorical, ordinal, datetime or binary. A name outweighs values; of names, ordinal wins."""
    if f.kind.startswith(("timestamp", "date")):
        return "datetime"
    if not is_numeric(f.kind):
        return "binary" if f.boolean_text else "categorical"
    binary, ordinal, categorical = name_hints(f.name)
    if binary and f.distinct == 2:
        return "binary"
    if ordinal:
        return "ordinal"
    if categorical:
        return "categorical"
    if f.distinct == 2 and f.zero_one:
        return "binary"
    return "ordinal" if f.distinct <= ORDINAL_UNIQUE else "continuous"


def coding(f: Facts) -> tuple[bool, bool]:
    """(coded, uncertain): whether numbers stand for categories, and whether the name leaves that open."""
    kind = analysis_type(f)
    if kind in ("datetime", "categorical") or not is_numeric(f.kind):
        return False, False
    if f.distinct - (f.nulls > 0) <= 1:
        return True, False  # a constant column, noted as such
    hints = name_hints(f.name)
    low = f.high is not None and f.high <= CODE_MAX
    if (hints[0] and f.distinct == 2) or (any(hints) and low):
        return True, False
    plain = f.zero_one and f.distinct - (f.nulls > 0) == 2
    uncertain = not any(hints) and not plain and f.whole and f.low is not None and f.low >= 0 and f.high <= UNCERTAIN_MAX and 2 <= f.distinct <= ORDINAL_UNIQUE
    return False, uncertain


def suggested_strategy(kind: str, null_percent: float) -> str:
    if null_percent > 50:
        return "drop_column"
    if null_percent > 20 and kind == "continuous":
        return "knn"
    return {"continuous": "mean", "ordinal": "median"}.get(kind, "mode")


PROFILE = "position int, column string, kind string, type string, coded boolean, uncertain boolean, constant boolean, rows bigint, nulls bigint, distinct bigint, low double, high double"


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row a column."""
    rows = []
    for k, f in enumerate(column_facts(df, columns)):
        coded, uncertain = coding(f)
        rows.append((k, f.name, f.kind, analysis_type(f), coded, uncertain, f.distinct - (f.nulls > 0) <= 1, f.rows, f.nulls, f.distinct, f.low, f.high))
    return df.sparkSession.createDataFrame(rows, PROFILE)


def missing_report(df: DataFrame, variant: str = "default") -> DataFrame:
    """column, count, percentage, suggested_strategy, warning: a row for each column with missing values."""
    rows = []
    for f in column_facts(df):
        if f.nulls:
            percent = round(100 * f.nulls / f.rows, 2)
            kind = analysis_type(f)
            strategy = "drop_rows" if variant == "ts" and kind == "datetime" else suggested_strategy(kind, percent)
            rows.append((f.name, f.nulls, percent, strategy, percent > 30 and strategy != "drop_column"))
    return df.sparkSession.createDataFrame(rows, "column string, count bigint, percentage double, suggested_strategy string, warning boolean")


def requires_attention(report: DataFrame, variant: str = "default") -> bool:
    return not (report.filter("percentage > 5") if variant == "ts" else report).isEmpty()


def missing_summary(df: DataFrame, attention: float = 5.0) -> DataFrame:
    """One row: columns with missing values, the missing cells, and whether a column misses over `attention` percent."""
    found = missing_report(df, "ts").agg(F.count("*").alias("columns"), F.coalesce(F.sum("count"), F.lit(0)).alias("cells"), F.max("percentage").alias("most"))
    return found.select("columns", "cells", F.coalesce(F.col("most") > attention, F.lit(False)).alias("requires_attention"))


def duplicate_count(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """rows, distinct_rows, duplicates; equal rows meet after a partial count."""
    by = columns or df.columns
    return df.groupBy(*[F.col(f"`{c}`") for c in by]).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"), F.count("*").alias("distinct_rows")).withColumn("duplicates", F.col("rows") - F.col("distinct_rows"))


def unique_values(df: DataFrame, column: str, limit: int = UNIQUE_SHOWN) -> DataFrame:
    """The least distinct values, at most `limit` of them."""
    return df.select(F.col(f"`{column}`").alias("value")).dropna().distinct().orderBy("value").limit(limit)


def sample_values(df: DataFrame, column: str, order: str, n: int = 5) -> DataFrame:
    return df.orderBy(order).select(F.col(f"`{column}`").alias("value")).limit(n)


def labelled(df: DataFrame, codebook: dict[str, dict[str, str]]) -> DataFrame:
    """Add `<column>_label` from a codebook of code -> label; a code without a label stays itself."""
    made = {}
    for c, labels in codebook.items():
        if c in df.columns and labels:
            key = F.col(f"`{c}`").cast("string")
            pairs = [F.lit(str(x)) for kv in labels.items() for x in kv]
            made[f"{c}_label"] = F.coalesce(F.try_element_at(F.create_map(*pairs), key), key)
    return df.withColumns(made) if made else df


def labelled_type(kind: str, labels: dict[str, str]) -> str:
    """A labelled continuous column is categorical, or binary with two labels at most."""
    if kind != "continuous":
        return kind
    return "categorical" if len(set(labels.values())) > 2 else "binary"


def resolve_codes(facts: list[Facts], resolver=None) -> dict[str, dict[str, str]]:
    """A codebook for uncertain columns from a callback over their names; none by default."""
    open_columns = [f.name for f in facts if coding(f)[1]]
    return dict(resolver(open_columns)) if resolver and open_columns else {}


@dataclass(frozen=True)
class ColumnCodes:
    """What is known of a column's codes: its labels, and whether the rules left it open."""

    name: str
    coded: bool
    uncertain: bool
    labels: dict[str, str] | None = None
    note: str | None = None


def column_codes(facts: list[Facts], codebook: dict[str, dict[str, str]] | None = None) -> list[ColumnCodes]:
    """The codes of all columns by the rules; a codebook's labels settle a column."""
    out = []
    for f in facts:
        coded, uncertain = coding(f)
        labels = (codebook or {}).get(f.name) or None
        out.append(ColumnCodes(f.name, coded or labels is not None, uncertain and labels is None, labels))
    return out


def apply_code_detection(columns: list[ColumnCodes], detection: dict[str, dict]) -> list[ColumnCodes]:
    """Columns with what was detected, {name: {coded, labels}}, written in: a detected column is open no more, new labels
    replace old ones, and a column with old labels stays coded."""
    out = []
    for c in columns:
        found = detection.get(c.name)
        if found is None:
            out.append(c)
            continue
        labels = found.get("labels") or None
        note = "labels come from detection" if found.get("coded") and found.get("labels") is not None else c.note
        out.append(ColumnCodes(c.name, True if c.labels is not None else bool(found.get("coded")), False, labels or c.labels, note))
    return out


def uncertain_columns(columns: list[ColumnCodes]) -> list[str]:
    return [c.name for c in columns if c.uncertain]


def labelled_columns(columns: list[ColumnCodes]) -> list[str]:
    return [c.name for c in columns if c.labels]


def labelled_value(codes: ColumnCodes | None, column: Column) -> Column:
    """A column's values as text, those with a label by their label."""
    key = column.cast("string")
    if codes is None or not codes.labels:
        return key
    pairs = [F.lit(str(x)) for kv in codes.labels.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), key)
