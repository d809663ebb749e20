"""Outliers, categories, states, dates, typos and duplicates."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstat.functions.ranks import ensure_checkpoints, lookup_side, quantiles
from quillstat.functions.similarity import close_match, match_ratio, similar_values, title_case
from quillstat.operators.profile import is_numeric

IQR_FACTOR, Z_THRESHOLD, MIN_ROWS, INDICES_SHOWN = 1.5, 3.0, 4, 100
#: The fifty states, by their postal abbreviations.
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "FL": "Florida", "GA": "Georgia",
    "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland",
    "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey",
    "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina",
    "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}
#: What looks like a date, and the formats tried in turn.
DATE_SHAPE = r"\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}"
DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "M-d-yyyy", "d/M/yyyy", "d-M-yyyy", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "M/d/yy")
DATE_SAMPLE, DATE_SHARE = 20, 0.3


def _x(column: str) -> Column:
    """A column as a double; NaN is a missing value."""
    return F.nanvl(F.col(f"`{column}`").cast("double"), F.lit(None).cast("double"))


def fences(df: DataFrame, columns: list[str], method: str = "iqr", factor: float | None = None, approx: bool = False) -> dict[str, tuple[float | None, float | None]]:
    """(lower, upper) of each column at full precision; None without values, or without spread for z-scores."""
    if method == "iqr":
        f = IQR_FACTOR if factor is None else factor
        if approx:
            got = df.agg(*[F.percentile_approx(_x(c), [0.25, 0.75], 100_000).alias(f"q{i}") for i, c in enumerate(columns)]).first()
            cuts = {c: got[f"q{i}"] or [None, None] for i, c in enumerate(columns)}
        else:
            cuts = quantiles(df, {c: _x(c) for c in columns}, [0.25, 0.75])
        return {c: (None, None) if low is None else (low - f * (high - low), high + f * (high - low)) for c, (low, high) in cuts.items()}
    f = Z_THRESHOLD if factor is None else factor
    got = df.agg(*[e for i, c in enumerate(columns) for e in (F.avg(_x(c)).alias(f"m{i}"), F.stddev_samp(_x(c)).alias(f"s{i}"))]).first()
    return {c: (got[f"m{i}"] - f * got[f"s{i}"], got[f"m{i}"] + f * got[f"s{i}"]) if got[f"s{i}"] else (None, None) for i, c in enumerate(columns)}


def outlier_bounds(df: DataFrame, columns: list[str], method: str = "iqr", factor: float | None = None, approx: bool = False) -> DataFrame:
    """column, n, lower, upper, outliers: quartile fences (1.5) or mean and deviations (3), both strict.

    Columns of fewer than four values, or without spread for z-scores, have no bounds and no outliers. The bounds of
    this report keep their full precision.
    """
    found = fences(df, columns, method, factor, approx)
    facts, rows = [], []
    for i, c in enumerate(columns):
        low, high = found[c]
        facts += [F.count(_x(c)).alias(f"n{i}"), (F.lit(0).cast("bigint") if low is None else F.count_if((_x(c) < low) | (_x(c) > high))).alias(f"o{i}")]
        ok = (F.col(f"n{i}") >= MIN_ROWS) & F.lit(low is not None)
        rows.append(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.when(ok, F.lit(low).cast("double")).alias("lower"), F.when(ok, F.lit(high).cast("double")).alias("upper"), F.when(ok, F.col(f"o{i}")).otherwise(0).alias("outliers")))
    return df.agg(F.count(F.lit(1)).alias("rows"), *facts).select(F.inline(F.array(*rows)))


def outlier_rows(df: DataFrame, column: str, row_id: str, method: str = "iqr", factor: float | None = None) -> DataFrame:
    """Ids of the first outlying rows, as many as a report shows."""
    b = outlier_bounds(df, [column], method, factor).first()
    return df.filter((_x(column) < b["lower"]) | (_x(column) > b["upper"])).select(row_id).orderBy(row_id).limit(INDICES_SHOWN)


def handle_outliers(df: DataFrame, columns: list[str], method: str = "iqr", action: str = "clip", factor: float | None = None) -> DataFrame:
    """clip, remove, log, sqrt or none. Nulls stay. Z-score removal goes column by column, each on what is left."""
    if action in (None, "none", "detect"):
        return df
    if action == "remove" and method == "zscore":
        for c in columns:
            df = _handled(df, [c], method, action, factor)
        return df
    return _handled(df, columns, method, action, factor)


def _handled(df: DataFrame, columns: list[str], method: str, action: str, factor: float | None) -> DataFrame:
    bounds = {r["column"]: r for r in outlier_bounds(df, columns, method, factor).collect()}
    keep, made = F.lit(True), {}
    for c in columns:
        b, x = bounds[c], _x(c)
        if b["lower"] is None:
            continue
        if action == "clip":
            made[c] = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(b["lower"])), F.lit(b["upper"])))
        elif action == "remove":
            keep &= ~F.coalesce((x < b["lower"]) | (x > b["upper"]), F.lit(False))
        elif b["outliers"]:
            if action == "log":
                least = df.agg(F.min(F.when(x > 0, x)).alias("least")).first()["least"]
                made[c] = F.log1p(F.when(x.isNotNull(), F.greatest(x, F.lit(1.0 if least is None else least))))
            elif action == "sqrt":
                made[c] = F.sqrt(F.when(x.isNotNull(), F.greatest(x, F.lit(0.0))))
    return df.withColumns(made) if made else df.filter(keep)


def standardise_text(df: DataFrame, columns: list[str], case: str | None = "title", trim: bool = True, collapse: bool = True) -> DataFrame:
    """Trim, collapse white space and set the case (lower, upper, title, capitalize or none) of text columns."""
    made = {}
    for c in columns:
        v = F.col(f"`{c}`")
        v = F.trim(v) if trim else v
        v = F.regexp_replace(v, r"\s+", " ") if collapse else v
        if case == "title":
            v = title_case(v)
        elif case == "capitalize":
            v = F.concat(F.upper(F.substring(v, 1, 1)), F.lower(F.substring(v, 2, 1 << 30)))
        elif case in ("lower", "upper"):
            v = getattr(F, case)(v)
        made[c] = v
    return df.withColumns(made)


def change_report(before: DataFrame, after: DataFrame, column: str, row_id: str) -> DataFrame:
    """changed, unique_before, unique_after of a column that a step rewrote."""
    both = before.select(row_id, F.col(f"`{column}`").alias("a")).join(after.select(row_id, F.col(f"`{column}`").alias("b")), row_id)
    return both.agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"), F.count_distinct("a").alias("unique_before"), F.count_distinct("b").alias("unique_after"))


def standardise_states(df: DataFrame, columns: list[str], output: str = "full", cutoff: float = 0.8) -> DataFrame:
    """State names: exact abbreviation, exact name, then the closest name; the lookup runs on distinct values."""
    spark = df.sparkSession
    exact = spark.createDataFrame([(k, full if output == "full" else abbrev) for abbrev, full in STATES.items() for k in (abbrev.lower(), full.lower())], "k string, state string")
    target = exact.filter(F.length("k") > 2)
    nearest = close_match([s.lower() for s in STATES.values()], cutoff)
    for c in columns:
        values = df.select(F.col(f"`{c}`").alias("v")).dropna().distinct().withColumn("k", F.lower(F.trim("v")))
        direct = values.join(F.broadcast(exact), "k", "left")
        fuzzy = direct.filter("state is null and length(k) > 2").select("v", nearest("k").alias("k")).dropna().join(F.broadcast(target), "k").select("v", "state")
        found = direct.filter("state is not null").select("v", "state").unionByName(fuzzy).select(F.col("v").alias("_v"), F.col("state").alias("_state"))
        df = df.join(lookup_side(found), F.col(f"`{c}`") == F.col("_v"), "left").withColumn(c, F.coalesce("_state", F.trim(F.col(f"`{c}`")))).drop("_v", "_state")
    return df


def date_expr(column: str, dayfirst: bool = False) -> Column:
    formats = sorted(DATE_FORMATS, key=lambda f: not f.startswith("d")) if dayfirst else DATE_FORMATS
    v = F.trim(F.col(f"`{column}`"))
    return F.coalesce(*[F.try_to_timestamp(v, F.lit(f)) for f in formats])


def parse_dates(df: DataFrame, columns: list[str], dayfirst: bool = False) -> tuple[DataFrame, dict[str, dict]]:
    """Text columns that look like dates and of which more than 30 % parse become timestamps; failures are null."""
    report = {}
    for c in columns:
        if dict(df.dtypes).get(c) != "string":
            continue
        sample = df.select(F.col(f"`{c}`").alias("v")).dropna().limit(DATE_SAMPLE)
        if sample.filter(F.col("v").rlike(DATE_SHAPE)).isEmpty():
            continue
        got = df.agg(F.count(f"`{c}`").alias("n"), F.count(date_expr(c, dayfirst)).alias("ok")).first()
        report[c] = {"parsed": got["ok"], "failed": got["n"] - got["ok"], "converted": got["ok"] > DATE_SHARE * got["n"]}
        if report[c]["converted"]:
            df = df.withColumn(c, date_expr(c, dayfirst))
    return df, report


def fix_typos(df: DataFrame, column: str, corrections: dict[str, str]) -> DataFrame:
    """Replace values that equal a key but for case and surrounding space."""
    if not corrections:
        return df
    key = F.lower(F.trim(F.col(f"`{column}`")))
    pairs = [F.lit(x) for k, v in corrections.items() for x in (k.strip().lower(), v)]
    return df.withColumn(column, F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.col(f"`{column}`")))


def auto_fix_typos(df: DataFrame, column: str, cutoff: float = 0.85) -> DataFrame:
    """A value seen once and close to one seen more often takes its place, the closest or of equally close ones the
    greatest; columns of under three values stay. Values meet by the characters they share, at any number of them."""
    ensure_checkpoints(df.sparkSession)
    counts = df.select(F.col(f"`{column}`").alias("v")).dropna().groupBy("v").agg(F.count("*").alias("n")).checkpoint()
    if counts.limit(3).count() < 3:
        return df
    near = similar_values(counts.filter("n > 1").select("v"), counts.filter("n = 1").select("v"), cutoff)
    fixes = near.groupBy(F.col("w").alias("_rare")).agg(F.max_by("v", F.struct("ratio", "v")).alias("_fix"))
    return df.join(fixes, F.col(f"`{column}`") == F.col("_rare"), "left").withColumn(column, F.coalesce("_fix", F.col(f"`{column}`"))).drop("_rare", "_fix")


def exact_duplicates(df: DataFrame, columns: list[str] | None = None, keep: str | None = "first", order: list | None = None) -> DataFrame:
    """Drop repeats of `columns` (all by default; nulls equal): keep the first, the last or none of each group.

    Where any copy will do (no order and keep first), Spark's own dropDuplicates merges before the shuffle.
    """
    by = columns or df.columns
    if keep == "first" and order is None:
        return df.dropDuplicates(by)
    keys = [F.col(f"`{c}`") for c in by]
    if keep in ("first", "last"):
        where = [F.col(o) if isinstance(o, str) else o for o in order or [F.monotonically_increasing_id()]]
        at = "_at" + "_" * sum(c.startswith("_at") for c in df.columns)  # a row's place can't be made inside an aggregate
        row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        pick = F.min_by if keep == "first" else F.max_by
        return df.withColumn(at, F.struct(*where)).groupBy(*keys).agg(pick(row, F.col(at)).alias("row")).select("row.*")
    only = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("row"))
    return only.filter("_n = 1").select("row.*")


def duplicate_rows(df: DataFrame, row_id: str, columns: list[str] | None = None) -> DataFrame:
    """The ids of repeats: all rows of equal `columns` (all but the id by default; nulls equal) but that with the least
    id. Rows meet the least ids by the id itself, so that a value with very many copies is no hot key."""
    by = columns or [c for c in df.columns if c != row_id]
    firsts = df.groupBy(*[F.col(f"`{c}`") for c in by]).agg(F.min(F.col(f"`{row_id}`")).alias("_first")).select("_first")
    return df.select(F.col(f"`{row_id}`")).join(firsts, F.col(f"`{row_id}`") == F.col("_first"), "left_anti")


def _text(columns: list[str]) -> list[Column]:
    return [F.lower(F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))) for c in columns]


def _text_classes(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """id, last, members, t0.., mask: rows of equal texts under the least of their ids; the mask has a bit for each column
    that isn't empty."""
    ensure_checkpoints(df.sparkSession)
    names = [f"t{k}" for k in range(len(columns))]
    rows = df.select(F.col(f"`{row_id}`").alias("id"), *[t.alias(n) for t, n in zip(_text(columns), names, strict=True)])
    mask = sum((F.when(F.col(t) != "", F.lit(1 << k)).otherwise(0) for k, t in enumerate(names)), F.lit(0).cast("bigint"))
    return rows.groupBy(*names).agg(F.min("id").alias("id"), F.max("id").alias("last"), F.count("*").alias("members")).withColumn("mask", mask)


def _class_pairs(classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b), a < b: classes that both fill some column, and whose every column is equal, empty on either side, or similar
    to the threshold. Pairs are found by the column of most different values that neither leaves empty."""
    names = [f"t{k}" for k in range(n)]
    a = classes.select(F.col("id").alias("a"), *[F.col(t).alias(f"a{t}") for t in names])
    b = classes.select(F.col("id").alias("b"), *[F.col(t).alias(f"b{t}") for t in names])
    sketch = classes.agg(*[F.approx_count_distinct(t).alias(t) for t in names]).first()
    order = sorted(range(n), key=lambda k: -sketch[f"t{k}"])

    def apart(k: int) -> Column:
        return (F.col(f"at{k}") == "") | (F.col(f"bt{k}") == "")

    out = None
    for place, k in enumerate(order):
        values = classes.select(F.col(f"t{k}").alias("v")).filter("v != ''").distinct()
        equal = values.select("v", F.col("v").alias("w"))
        near = similar_values(values, values, threshold).filter("v != w").select("v", "w").unionByName(equal)
        met = a.join(near, F.col(f"at{k}") == F.col("v")).join(b, F.col(f"bt{k}") == F.col("w")).filter("a < b")
        for j in order[:place]:
            met = met.filter(apart(j))
        for j in order[place + 1 :]:
            x, y = F.col(f"at{j}"), F.col(f"bt{j}")
            met = met.filter((x == y) | apart(j)).unionByName(met.filter((x != y) & ~apart(j)).filter(match_ratio(x, y) >= threshold))
        out = met.select("a", "b") if out is None else out.unionByName(met.select("a", "b"))
    return out


def _masks_apart(classes: DataFrame) -> DataFrame:
    """(mask, other): masks that share no column, both ways round; there are 2 ** columns masks at most."""
    masks = classes.select("mask").distinct()
    return masks.join(F.broadcast(masks.select(F.col("mask").alias("other"))), F.col("mask").bitwiseAND(F.col("other")) == 0)


def _first_apart(rows: DataFrame, apart: DataFrame, name: str) -> DataFrame:
    """mask, `name`: the least id among rows whose mask shares no column with it, to be looked up."""
    first = rows.groupBy(F.col("mask").alias("other")).agg(F.min("id").alias(name))
    return lookup_side(apart.join(first, "other").groupBy("mask").agg(F.min(name).alias(name)))


def fuzzy_pairs(df: DataFrame, columns: list[str], row_id: str, threshold: float = 0.9) -> DataFrame:
    """(a, b), a < b: texts whose every column is equal, empty on either side, or similar to the threshold, each under
    the least id of its rows; rows of equal texts are one, and aren't listed in pairs. Nor are texts that fill no column
    in common: these are similar by meaning, whatever they hold, and would be all pairs of two groups."""
    return _class_pairs(_text_classes(df, columns, row_id).checkpoint(), len(columns), threshold)


def fuzzy_duplicates(df: DataFrame, columns: list[str], row_id: str, threshold: float = 0.9, keep: str = "first") -> DataFrame:
    """Greedy leader groups, then the first, the last or every member goes but none of other rows.

    A row leads if no earlier leader is similar to it; a follower belongs to its earliest leader, and so do the copies
    of its text. Leaders settle in rounds over the rows that are still open: one without an open earlier neighbour
    leads, and its neighbours follow. Neighbours that fill no column in common are never listed: of such a group only
    the least id matters, which is known for each mask of filled columns.
    """
    classes = _text_classes(df, columns, row_id).checkpoint()
    pairs = _class_pairs(classes, len(columns), threshold).checkpoint()
    apart = _masks_apart(classes).checkpoint()
    open_, listed, settled = classes.select("id", "mask"), pairs, []
    while not open_.isEmpty():
        later = listed.select(F.col("b").alias("id")).distinct().withColumn("_later", F.lit(True))
        marked = open_.join(later, "id", "left").join(_first_apart(open_, apart, "_open"), "mask", "left")
        marked = marked.select("id", "mask", (F.col("_later").isNull() & (F.col("_open").isNull() | (F.col("_open") >= F.col("id")))).alias("leads")).checkpoint()
        found = marked.filter("leads").select("id", "mask")
        settled.append(found)
        led = listed.join(found.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        rest = marked.filter("not leads").select("id", "mask").join(led, "id", "left_anti")
        open_ = rest.join(_first_apart(found, apart, "_led"), "mask", "left").filter(F.col("_led").isNull() | (F.col("_led") > F.col("id"))).select("id", "mask").checkpoint()
        ids = open_.select("id")
        listed = listed.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b").checkpoint()
    leads = functools.reduce(DataFrame.unionByName, settled) if settled else classes.select("id", "mask").limit(0)
    near = pairs.join(leads.select(F.col("id").alias("a")), "a", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("_near"))
    known = classes.join(leads.select("id", F.lit(True).alias("_leads")), "id", "left").join(near, "id", "left").join(_first_apart(leads, apart, "_far"), "mask", "left")
    groups = known.withColumn("leader", F.when(F.col("_leads"), F.col("id")).otherwise(F.least("_near", F.when(F.col("_far") < F.col("id"), F.col("_far")))))
    sizes = groups.groupBy("leader").agg(F.sum("members").alias("size"), F.min("id").alias("first"), F.max("last").alias("last")).filter("size > 1")
    stays = {"first": F.col("first"), "last": F.col("last")}.get(keep, F.lit(None))
    names = [f"t{k}" for k in range(len(columns))]
    gone = groups.join(lookup_side(sizes.select("leader", stays.alias("_stays"))), "leader").select("_stays", F.lit(True).alias("_grouped"), *[F.col(t).alias(f"_{t}") for t in names])
    same = [t == F.col(f"_{n}") for t, n in zip(_text(columns), names, strict=True)]
    out = df.join(lookup_side(gone), same, "left").filter(F.col("_grouped").isNull() | F.coalesce(F.col(f"`{row_id}`") == F.col("_stays"), F.lit(False)))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, k in df.dtypes if is_numeric(k) and k != "boolean"]
