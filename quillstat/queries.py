"""One registered query for each operator, with the DuckDB SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.functions.linalg import moments, ols, vif
from quillstat.functions.ranks import spread
from quillstat.operators import attribute, charts, clean, describe, explain, features, infer, missing, profile, regress, training
from quillstat.plans import planner, translate
from quillstat.sources.ingest import with_row_id
from quillstat.streaming import live_profile

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def r(column, places: int = 4, name: str | None = None):
    c = F.col(column) if isinstance(column, str) else column
    return (F.round(c, places) + F.lit(0.0)).alias(name or (column if isinstance(column, str) else None))


def gaps(df: DataFrame) -> DataFrame:
    """lineitem with the quantity of every third line missing."""
    return df.withColumn("l_quantity", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")))


GAPS = "(SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS q FROM lineitem)"


def _describe_sql(source: str, column: str) -> str:
    return f"""
SELECT '{column}' AS column_name, count(x)::BIGINT AS n, round(avg(x), 4) AS mean, round(median(x), 4) AS median, round(stddev_samp(x), 4) AS std_dev,
    round(min(x), 4) AS min, round(max(x), 4) AS max, round(quantile_cont(x, 0.25), 4) AS q1, round(quantile_cont(x, 0.75), 4) AS q3,
    round(skewness(x) * (count(x) - 2) / sqrt(count(x) * (count(x) - 1.0)), 4) + 0.0 AS skewness, round(kurtosis_pop(x), 4) + 0.0 AS kurtosis,
    count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))::BIGINT AS outlier_count
FROM (SELECT {column}::DOUBLE AS x FROM {source}), (SELECT quantile_cont({column}::DOUBLE, 0.25) AS q1, quantile_cont({column}::DOUBLE, 0.75) AS q3 FROM {source})"""


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    got = describe.describe(df, columns)
    return got.select(F.col("column").alias("column_name"), F.col("count").alias("n"), *[r(c) for c in ("mean", "median", "std_dev", "min", "max", "q1", "q3", "skewness", "kurtosis")], "outlier_count")


@query("describe_price", _describe_sql("lineitem", "l_extendedprice"))
def describe_price(spark, sf):
    return described(table(spark, sf, "lineitem"), ["l_extendedprice"])


@query("describe_numeric", " UNION ALL ".join(_describe_sql("lineitem", c) for c in ("l_quantity", "l_discount", "l_tax")) + " UNION ALL " + _describe_sql("lineitem", "l_linenumber"))
def describe_numeric(spark, sf):
    return described(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber"])


@query("describe_variant", "SELECT 'value' AS column_name, round(stddev_pop(value), 4) AS std_dev, round(var_pop(value), 3) AS variance, round(skewness(value), 4) AS skewness, round(kurtosis(value), 4) AS kurtosis FROM events")
def describe_variant(spark, sf):
    return describe.describe(table(spark, sf, "events"), ["value"], variant="ts").select(F.col("column").alias("column_name"), r("std_dev"), r("variance", 3), r("skewness"), r("kurtosis"))


@query("describe_text", "SELECT 'c_mktsegment' AS column_name, count(c_mktsegment)::BIGINT AS n, count(DISTINCT c_mktsegment)::BIGINT AS n_distinct, (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode FROM customer")
def describe_text(spark, sf):
    return describe.describe_text(table(spark, sf, "customer"), "c_mktsegment").select(F.col("column").alias("column_name"), F.col("count").alias("n"), F.col("distinct").alias("n_distinct"), "mode")


@query("describe_time", "SELECT count(o_orderdate)::BIGINT AS n, min(o_orderdate)::VARCHAR AS first, max(o_orderdate)::VARCHAR AS last FROM orders")
def describe_time(spark, sf):
    return describe.describe_time(table(spark, sf, "orders"), "o_orderdate").select(F.col("count").alias("n"), F.date_format("min", "yyyy-MM-dd HH:mm:ss").alias("first"), F.date_format("max", "yyyy-MM-dd HH:mm:ss").alias("last"))


@query("frequencies", "SELECT l_returnflag AS value, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def frequencies(spark, sf):
    return describe.frequencies(table(spark, sf, "lineitem"), "l_returnflag").withColumnRenamed("count", "n")


@query("mode_quantity", "SELECT l_quantity AS mode FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
def mode_quantity(spark, sf):
    return missing.mode_of(table(spark, sf, "lineitem"), "l_quantity")


@query("percentiles", "SELECT unnest([5.0, 50.0, 95.0])::DOUBLE AS percentile, round(unnest(quantile_cont(o_totalprice, [0.05, 0.5, 0.95])), 2) AS value FROM orders")
def percentiles(spark, sf):
    return describe.percentiles(table(spark, sf, "orders"), "o_totalprice", [5, 50, 95]).select("percentile", r("value", 2))


@query("skew_label", "SELECT CASE WHEN abs(s) < 0.5 THEN 'symmetric' WHEN abs(s) < 1 THEN 'moderately skewed' ELSE 'highly skewed' END AS label FROM (SELECT skewness(value) AS s FROM events)")
def skew_label(spark, sf):
    return describe.describe(table(spark, sf, "events"), ["value"]).select(describe.skew_label(F.col("skewness")).alias("label"))


@query("missing_report", f"SELECT 'l_quantity' AS column_name, count(*) FILTER (q IS NULL)::BIGINT AS n, round(100.0 * count(*) FILTER (q IS NULL) / count(*), 2) AS percentage, CASE WHEN 100.0 * count(*) FILTER (q IS NULL) / count(*) > 20 THEN 'knn' ELSE 'mean' END AS strategy FROM {GAPS}")
def missing_report(spark, sf):
    return profile.missing_report(gaps(table(spark, sf, "lineitem")).select("l_quantity", "l_tax")).select(F.col("column").alias("column_name"), F.col("count").alias("n"), "percentage", F.col("suggested_strategy").alias("strategy"))


#: The type rules on counts: for numbers by distinct values and whether all are 0 or 1, for text by words for booleans.
NUMBER_TYPE = "CASE WHEN count(DISTINCT {c}) + (count(*) > count({c}))::INT = 2 AND bool_and({c} IN (0, 1)) THEN 'binary' WHEN count(DISTINCT {c}) + (count(*) > count({c}))::INT <= 15 THEN 'ordinal' ELSE 'continuous' END"
TEXT_TYPE = "CASE WHEN bool_and(lower(trim({c})) IN ('true', 'yes', '1', 'false', 'no', '0', '')) AND count(DISTINCT nullif(lower(trim({c})), '')) BETWEEN 1 AND 2 THEN 'binary' ELSE 'categorical' END"
PART = {"p_partkey": NUMBER_TYPE, "p_name": TEXT_TYPE, "p_brand": TEXT_TYPE, "p_type": TEXT_TYPE, "p_size": NUMBER_TYPE, "p_retailprice": NUMBER_TYPE}
PART_TYPES = " UNION ALL ".join(f"SELECT {k} AS position, '{c}' AS column_name, {t.format(c=c)} AS type, count(*)::BIGINT AS n_rows, (count(DISTINCT {c}) + (count(*) > count({c}))::INT)::BIGINT AS n_distinct, (count(*) - count({c}))::BIGINT AS n_missing FROM part" for k, (c, t) in enumerate(PART.items()))


@query("column_profile", f"SELECT column_name, type, n_rows, n_distinct, n_missing FROM ({PART_TYPES})")
def column_profile(spark, sf):
    return profile.profile(table(spark, sf, "part")).select(F.col("column").alias("column_name"), "type", F.col("rows").alias("n_rows"), F.col("distinct").alias("n_distinct"), F.col("nulls").alias("n_missing"))


#: A column named like an order is coded while its numbers are small; one without a telling name is open; a wide one is neither.
@query("coded_columns", f"SELECT 'level' AS column_name, 'ordinal' AS type, max(l_linenumber) <= 30 AS coded, false AS uncertain FROM lineitem UNION ALL SELECT 'line', {NUMBER_TYPE.format(c='l_linenumber')}, false, bool_and(l_linenumber = floor(l_linenumber)) AND min(l_linenumber) >= 0 AND max(l_linenumber) <= 20 AND count(DISTINCT l_linenumber) BETWEEN 2 AND 15 FROM lineitem UNION ALL SELECT 'size', {NUMBER_TYPE.format(c='l_quantity')}, false, bool_and(l_quantity = floor(l_quantity)) AND min(l_quantity) >= 0 AND max(l_quantity) <= 20 AND count(DISTINCT l_quantity) BETWEEN 2 AND 15 FROM lineitem UNION ALL SELECT 'sex', CASE WHEN count(DISTINCT l_linenumber % 2) = 2 THEN 'binary' ELSE 'ordinal' END, count(DISTINCT l_linenumber % 2) = 2, false FROM lineitem UNION ALL SELECT 'same', 'ordinal', true, false FROM lineitem GROUP BY 1")
def coded_columns(spark, sf):
    line = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("level"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("size"), (F.col("l_linenumber") % 2).alias("sex"), (F.col("l_linenumber") * 0 + 3).alias("same"))
    return profile.profile(line).select(F.col("column").alias("column_name"), "type", "coded", "uncertain")


@query("duplicate_rows", "SELECT event_id FROM (SELECT event_id, min(event_id) OVER (PARTITION BY user_id, event_type) AS first FROM events) WHERE event_id <> first")
def duplicate_rows(spark, sf):
    return clean.duplicate_rows(table(spark, sf, "events"), "event_id", ["user_id", "event_type"])


@query("duplicate_count", "SELECT count(*)::BIGINT AS n_rows, count(DISTINCT (user_id, event_type))::BIGINT AS distinct_rows, (count(*) - count(DISTINCT (user_id, event_type)))::BIGINT AS duplicates FROM events")
def duplicate_count(spark, sf):
    return profile.duplicate_count(table(spark, sf, "events"), ["user_id", "event_type"]).withColumnRenamed("rows", "n_rows")


@query("unique_values", "SELECT DISTINCT p_brand AS value FROM part ORDER BY 1 LIMIT 50")
def unique_values(spark, sf):
    return profile.unique_values(table(spark, sf, "part"), "p_brand")


@query("sample_values", "SELECT o_totalprice AS value FROM orders ORDER BY o_orderkey LIMIT 5")
def sample_values(spark, sf):
    return profile.sample_values(table(spark, sf, "orders"), "o_totalprice", "o_orderkey")


@query("codebook_labels", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus_label FROM orders")
def codebook_labels(spark, sf):
    return profile.labelled(table(spark, sf, "orders"), {"o_orderstatus": {"F": "finished", "O": "open"}}).select("o_orderkey", "o_orderstatus_label")


def _filled(strategy: str):
    def run(spark, sf):
        return missing.apply_strategies(gaps(table(spark, sf, "lineitem")), {"l_quantity": strategy}).select("l_orderkey", "l_linenumber", r("l_quantity", 4, "q"))

    return run


for _name, _value in {"mean": "(SELECT avg(q) FROM g)", "median": "(SELECT median(q) FROM g)", "mode": "(SELECT q FROM g WHERE q IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)", "zero": "0"}.items():
    query(f"impute_{_name}", f"WITH g AS {GAPS} SELECT l_orderkey, l_linenumber, round(coalesce(q, {_value}), 4) AS q FROM g")(_filled(_name))


@query("drop_rows", f"SELECT l_orderkey, l_linenumber, q FROM {GAPS} WHERE q IS NOT NULL")
def drop_rows(spark, sf):
    return missing.apply_strategies(gaps(table(spark, sf, "lineitem")), {"l_quantity": "drop_rows"}).select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"))


@query("drop_column", "SELECT l_orderkey, l_linenumber FROM lineitem")
def drop_column(spark, sf):
    return missing.apply_strategies(gaps(table(spark, sf, "lineitem")).select("l_orderkey", "l_linenumber", "l_quantity"), {"l_quantity": "drop_column"})


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", F.when(F.pmod("event_id", F.lit(3)) != 0, F.col("value")).alias("v"))


@query("forward_fill", "SELECT event_id, last_value(CASE WHEN event_id % 3 <> 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v FROM events")
def forward_fill(spark, sf):
    return missing.directed_fill(_events(spark, sf), "v", ["event_id"], ["user_id"]).select("event_id", "v")


@query("backward_fill", "SELECT event_id, first_value(CASE WHEN event_id % 3 <> 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM events")
def backward_fill(spark, sf):
    return missing.directed_fill(_events(spark, sf), "v", ["event_id"], ["user_id"], forward=False).select("event_id", "v")


@query("model_fill", f"WITH g AS {GAPS} SELECT l_orderkey, l_linenumber, round(coalesce(q, (SELECT avg(q) FROM g)), 4) AS q FROM g")
def model_fill(spark, sf):
    return missing.model_fill(gaps(table(spark, sf, "lineitem")), "l_extendedprice", ["l_quantity"]).select("l_orderkey", "l_linenumber", r("l_quantity", 4, "q"))


@query("knn_impute")
def knn_impute(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).cast("double").alias("p_size"), "p_retailprice")
    return missing.knn_impute(parts, ["p_size", "p_retailprice"]).select("p_partkey", r("p_size"))


@query("iterative_impute")
def iterative_impute(spark, sf):
    return missing.iterative_impute(gaps(table(spark, sf, "lineitem")), ["l_quantity", "l_extendedprice"]).select("l_orderkey", "l_linenumber", r("l_quantity", 4, "q"))


BOUNDS = "(SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)"
LOW, HIGH = "(a - 1.5 * (b - a))", "(b + 1.5 * (b - a))"


@query("outliers_iqr", f"SELECT 'value' AS column_name, count(*)::BIGINT AS n, round(first({LOW}), 4) AS lower, round(first({HIGH}), 4) AS upper, count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))::BIGINT AS outliers FROM events, {BOUNDS}")
def outliers_iqr(spark, sf):
    return clean.outlier_bounds(table(spark, sf, "events"), ["value"]).select(F.col("column").alias("column_name"), "n", r("lower"), r("upper"), "outliers")


@query("outliers_zscore", "SELECT 'value' AS column_name, count(*)::BIGINT AS n, round(first(m - 3 * s), 4) AS lower, round(first(m + 3 * s), 4) AS upper, count(*) FILTER (abs((value - m) / s) > 3)::BIGINT AS outliers FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)")
def outliers_zscore(spark, sf):
    return clean.outlier_bounds(table(spark, sf, "events"), ["value"], "zscore").select(F.col("column").alias("column_name"), "n", r("lower"), r("upper"), "outliers")


@query("outlier_rows", f"SELECT event_id FROM events, {BOUNDS} WHERE value < {LOW} OR value > {HIGH} ORDER BY event_id LIMIT 100")
def outlier_rows(spark, sf):
    return clean.outlier_rows(table(spark, sf, "events"), "value", "event_id")


def _handled(action: str):
    def run(spark, sf):
        return clean.handle_outliers(table(spark, sf, "events"), ["value"], action=action).select("event_id", r("value", 4, "v"))

    return run


query("outliers_clip", f"SELECT event_id, round(least(greatest(value, {LOW}), {HIGH}), 4) AS v FROM events, {BOUNDS}")(_handled("clip"))
query("outliers_remove", f"SELECT event_id, round(value, 4) AS v FROM events, {BOUNDS} WHERE NOT (value < {LOW} OR value > {HIGH})")(_handled("remove"))
query("outliers_log", "SELECT event_id, round(ln(1 + greatest(value, (SELECT min(value) FROM events WHERE value > 0))), 4) AS v FROM events")(_handled("log"))
query("outliers_sqrt", "SELECT event_id, round(sqrt(greatest(value, 0)), 4) AS v FROM events")(_handled("sqrt"))


@query("outliers_remove_zscore", "SELECT event_id, round(value, 4) AS v FROM events, (SELECT avg(value) - 3 * stddev_samp(value) AS a, avg(value) + 3 * stddev_samp(value) AS b FROM events) WHERE NOT (value < a OR value > b)")
def outliers_remove_zscore(spark, sf):
    return clean.handle_outliers(table(spark, sf, "events"), ["value"], "zscore", "remove").select("event_id", r("value", 4, "v"))


@query("standardise_case", "SELECT c_custkey, lower(trim(regexp_replace(c_mktsegment, '\\s+', ' ', 'g'))) AS segment FROM customer")
def standardise_case(spark, sf):
    return clean.standardise_text(table(spark, sf, "customer"), ["c_mktsegment"], "lower").select("c_custkey", F.col("c_mktsegment").alias("segment"))


@query("case_report", "SELECT count(*) FILTER (lower(c_mktsegment) <> c_mktsegment)::BIGINT AS changed, count(DISTINCT c_mktsegment)::BIGINT AS unique_before, count(DISTINCT lower(c_mktsegment))::BIGINT AS unique_after FROM customer")
def case_report(spark, sf):
    before = table(spark, sf, "customer")
    return clean.change_report(before, clean.standardise_text(before, ["c_mktsegment"], "lower"), "c_mktsegment", "c_custkey")


@query("title_case", "SELECT n_nationkey, array_to_string(list_transform(string_split(trim(regexp_replace(n_name, '\\s+', ' ', 'g')), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS n_name FROM nation")
def title_case(spark, sf):
    return clean.standardise_text(table(spark, sf, "nation"), ["n_name"], "title").select("n_nationkey", "n_name")


def _states(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.element_at(F.array(*[F.lit(s) for s in ("CA", "texas", " Ohio", "Nw York", "Ontario")]), (F.col("s_suppkey") % 5 + 1).cast("int")).alias("state"))


@query("standardise_states", "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'California' WHEN 1 THEN 'Texas' WHEN 2 THEN 'Ohio' WHEN 3 THEN 'New York' ELSE 'Ontario' END AS state FROM supplier")
def standardise_states(spark, sf):
    return clean.standardise_states(_states(spark, sf), ["state"]).select("s_suppkey", "state")


@query("parse_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def parse_dates(spark, sf):
    texts = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("d"))
    made, _ = clean.parse_dates(texts, ["d"])
    return made.select("o_orderkey", F.date_format("d", "yyyy-MM-dd").alias("day"))


@query("typo_map", "SELECT r_regionkey, CASE lower(trim(r_name)) WHEN 'asia' THEN 'Asia' WHEN 'europe' THEN 'Europe' ELSE r_name END AS r_name FROM region")
def typo_map(spark, sf):
    return clean.fix_typos(table(spark, sf, "region"), "r_name", {"ASIA": "Asia", " europe ": "Europe"}).select("r_regionkey", "r_name")


@query("typo_auto", "SELECT c_custkey, c_mktsegment AS segment FROM customer")
def typo_auto(spark, sf):
    least = table(spark, sf, "customer").agg(F.min("c_custkey")).first()[0]
    one = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") == least, F.concat("c_mktsegment", F.lit("X"))).otherwise(F.col("c_mktsegment")).alias("segment"))
    return clean.auto_fix_typos(one, "segment").select("c_custkey", "segment")


@query("dedup_keep_first", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k = 1")
def dedup_keep_first(spark, sf):
    return clean.exact_duplicates(table(spark, sf, "events"), ["user_id", "event_type"], "first", ["event_id"]).select("event_id")


@query("dedup_keep_last", "SELECT max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def dedup_keep_last(spark, sf):
    return clean.exact_duplicates(table(spark, sf, "events"), ["user_id", "event_type"], "last", ["event_id"]).select("event_id")


@query("dedup_keep_none", "SELECT min(event_id) AS event_id FROM events GROUP BY user_id, event_type HAVING count(*) = 1")
def dedup_keep_none(spark, sf):
    return clean.exact_duplicates(table(spark, sf, "events"), ["user_id", "event_type"], None).select("event_id")


@query("fuzzy_duplicates")
def fuzzy_duplicates(spark, sf):
    return clean.fuzzy_duplicates(table(spark, sf, "part"), ["p_name"], "p_partkey").select("p_partkey", "p_name")


@query("one_hot", "SELECT l_orderkey, l_linenumber, (l_returnflag = 'N')::INT AS flag_n, (l_returnflag = 'R')::INT AS flag_r FROM lineitem")
def one_hot(spark, sf):
    made, _ = features.one_hot(table(spark, sf, "lineitem"), ["l_returnflag"])
    return made.select("l_orderkey", "l_linenumber", F.col("l_returnflag_N").alias("flag_n"), F.col("l_returnflag_R").alias("flag_r"))


@query("target_encode", "SELECT p_partkey, round((s + 10 * m) / (n + 10), 4) AS encoded FROM part JOIN (SELECT p_brand, sum(p_retailprice) AS s, count(*) AS n FROM part GROUP BY 1) USING (p_brand), (SELECT avg(p_retailprice) AS m FROM part)")
def target_encode(spark, sf):
    return features.target_encode(table(spark, sf, "part"), ["p_brand"], "p_retailprice").select("p_partkey", r("p_brand_target_encoded", 4, "encoded"))


@query("ordinal_encode", "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INT AS priority FROM orders")
def ordinal_encode(spark, sf):
    return features.ordinal_encode(table(spark, sf, "orders"), ["o_orderpriority"]).select("o_orderkey", F.col("o_orderpriority").alias("priority"))


@query("auto_encode", "SELECT p_partkey, round((s + 10 * m) / (n + 10), 4) AS brand FROM part JOIN (SELECT p_brand, sum(p_retailprice) AS s, count(*) AS n FROM part GROUP BY 1) USING (p_brand), (SELECT avg(p_retailprice) AS m FROM part)")
def auto_encode(spark, sf):
    made, _ = features.auto_encode(table(spark, sf, "part"), ["p_brand", "p_type"], "p_retailprice")
    return made.select("p_partkey", r("p_brand_target_encoded", 4, "brand"))


@query("zscore_scale", "SELECT o_orderkey, round((o_totalprice - m) / s, 4) + 0.0 AS z FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders)")
def zscore_scale(spark, sf):
    return features.scale(table(spark, sf, "orders"), ["o_totalprice"])[0].select("o_orderkey", r("o_totalprice", 4, "z"))


@query("minmax_scale", "SELECT o_orderkey, round((o_totalprice - a) / (b - a), 6) AS z FROM orders, (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders)")
def minmax_scale(spark, sf):
    return features.scale(table(spark, sf, "orders"), ["o_totalprice"], "minmax")[0].select("o_orderkey", r("o_totalprice", 6, "z"))


@query("inverse_scale", "SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders")
def inverse_scale(spark, sf):
    made, params = features.scale(table(spark, sf, "orders"), ["o_totalprice"])
    return features.unscale(made, params).select("o_orderkey", r("o_totalprice", 2, "price"))


@query("datetime_features", "SELECT event_id, year(ts)::INT AS y, month(ts)::INT AS m, day(ts)::INT AS d, (isodow(ts) - 1)::INT AS dow, hour(ts)::INT AS h, (isodow(ts) >= 6)::INT AS weekend, quarter(ts)::INT AS q, week(ts)::INT AS w FROM events")
def datetime_features(spark, sf):
    made = features.datetime_features(table(spark, sf, "events"), ["ts"], (*features.DATE_FEATURES, "week"))
    names = dict(zip(("year", "month", "day", "day_of_week", "hour", "is_weekend", "quarter", "week"), ("y", "m", "d", "dow", "h", "weekend", "q", "w"), strict=True))
    return made.select("event_id", *[F.col(f"ts_{k}").alias(v) for k, v in names.items()])


@query("ratio", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_discount, 0), 2) AS ratio FROM lineitem")
def ratio(spark, sf):
    return features.ratios(table(spark, sf, "lineitem"), [("l_extendedprice", "l_discount")]).select("l_orderkey", "l_linenumber", r("l_extendedprice_div_l_discount", 2, "ratio"))


@query("interaction", "SELECT l_orderkey, l_linenumber, round(l_quantity * l_tax, 4) AS times, round(l_quantity - l_tax, 4) AS minus FROM lineitem")
def interaction(spark, sf):
    return features.interactions(table(spark, sf, "lineitem"), [("l_quantity", "l_tax")]).select("l_orderkey", "l_linenumber", r("l_quantity_x_l_tax", 4, "times"), r("l_quantity_minus_l_tax", 4, "minus"))


@query("row_aggregates", "SELECT l_orderkey, l_linenumber, round((l_quantity + l_discount + l_tax) / 3, 4) AS row_mean, round(list_stddev_samp([l_quantity, l_discount, l_tax]), 4) AS row_std, greatest(l_quantity, l_discount, l_tax) AS row_max, least(l_quantity, l_discount, l_tax) AS row_min FROM lineitem")
def row_aggregates(spark, sf):
    return features.row_aggregates(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"]).select("l_orderkey", "l_linenumber", r("row_mean"), r("row_std"), "row_max", "row_min")


@query("group_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type), 4) AS m FROM events")
def group_mean(spark, sf):
    return features.group_mean(table(spark, sf, "events"), ["value"], "event_type").select("event_id", r("value_group_mean", 4, "m"))


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("correlated_filter", "SELECT CASE WHEN abs(corr(l_quantity, 2 * l_quantity + l_tax)) > 0.95 THEN 'doubled' ELSE 'none' END AS dropped FROM lineitem")
def correlated_filter(spark, sf):
    made = table(spark, sf, "lineitem").withColumn("doubled", 2 * F.col("l_quantity") + F.col("l_tax"))
    _, gone = features.drop_correlated(made, ["l_quantity", "l_tax", "doubled"])
    return spark.createDataFrame([(",".join(gone) or "none",)], "dropped string")


@query("target_correlation_filter", " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(corr({c}, l_extendedprice), 4) AS r FROM lineitem HAVING abs(round(corr({c}, l_extendedprice), 4)) >= 0.05" for c in ("l_quantity", "l_discount", "l_tax")))
def target_correlation_filter(spark, sf):
    return features.select_by_target(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice").select(F.col("column").alias("column_name"), r("r"))


#: The variance inflation of each of three columns is in the inverse of their correlations; without the worst, two are left.
@query("vif_filter", """
WITH d AS (SELECT l_quantity AS x, l_tax AS y, l_quantity + l_tax + 0.001 * l_linenumber AS z FROM lineitem), c AS (SELECT corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM d),
e AS (SELECT *, 1 + 2 * xy * xz * yz - xy * xy - xz * xz - yz * yz AS det FROM c),
v AS (SELECT xy, xz, yz, least((1 - yz * yz) / det, 10000) AS vx, least((1 - xz * xz) / det, 10000) AS vy, least((1 - xy * xy) / det, 10000) AS vz FROM e),
k AS (SELECT greatest(vx, vy, vz) AS worst, CASE WHEN vx >= greatest(vy, vz) THEN yz WHEN vy >= vz THEN xz ELSE xy END AS rest FROM v)
SELECT (CASE WHEN worst <= 10 THEN 3 WHEN 1 / (1 - rest * rest) <= 10 THEN 2 ELSE 1 END)::BIGINT AS kept FROM k""")
def vif_filter(spark, sf):
    made = table(spark, sf, "lineitem").withColumn("sum", F.col("l_quantity") + F.col("l_tax") + 0.001 * F.col("l_linenumber"))
    kept, _ = features.select_by_vif(made, ["l_quantity", "l_tax", "sum"])
    return spark.createDataFrame([(len(kept),)], "kept bigint")


@query("pca")
def pca(spark, sf):
    made, _ = features.pca(table(spark, sf, "lineitem"), NUMBERS)
    return made.select("l_orderkey", "l_linenumber", r("PC1"), r("PC2"))


@query("lasso")
def lasso(spark, sf):
    return spark.createDataFrame([(k, round(v, 4)) for k, v in features.lasso(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice").items()], "feature string, coefficient double")


@query("forest_selection")
def forest_selection(spark, sf):
    kept = features.select_by_importance(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", top=2, trees=10, depth=5)
    return spark.createDataFrame([(k,) for k in kept], "feature string")


def _fisher(a: str, b: str) -> str:
    return f"SELECT '{a}' AS column_a, '{b}' AS column_b, count(*)::BIGINT AS n, round(corr({a}, {b}), 4) AS r, round(tanh(atanh(corr({a}, {b})) - 1.96 / sqrt(count(*) - 3)), 4) AS lower, round(tanh(atanh(corr({a}, {b})) + 1.96 / sqrt(count(*) - 3)), 4) AS upper FROM lineitem"


@query("pearson_pairs", _fisher("l_quantity", "l_extendedprice"))
def pearson_pairs(spark, sf):
    return infer.correlations(table(spark, sf, "lineitem"), [("l_quantity", "l_extendedprice")]).select("column_a", "column_b", "n", "r", "lower", "upper")


@query("spearman_pair", "WITH k AS (SELECT rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT count(*)::BIGINT AS n, round(corr(a, b), 4) + 0.0 AS r FROM k")
def spearman_pair(spark, sf):
    return infer.correlation(table(spark, sf, "lineitem"), "l_discount", "l_extendedprice", "spearman").select("n", r("r"))


@query("correlation_matrix", " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, {'1.0::DOUBLE' if a == b else f'round(corr({a}, {b}), 4) + 0.0'} AS r FROM lineitem" + (" LIMIT 1" if a == b else "") if a != b else f"SELECT '{a}', '{b}', 1.0::DOUBLE" for a in NUMBERS for b in NUMBERS).replace("SELECT 'l_quantity', 'l_quantity', 1.0::DOUBLE", "SELECT 'l_quantity' AS column_a, 'l_quantity' AS column_b, 1.0::DOUBLE AS r"))
def correlation_matrix(spark, sf):
    return infer.correlation_matrix(table(spark, sf, "lineitem"), NUMBERS).select("column_a", "column_b", r("r"))


@query("correlation_labels", "SELECT CASE WHEN abs(c) >= 0.7 THEN 'strong ' WHEN abs(c) >= 0.4 THEN 'moderate ' ELSE 'weak' END || CASE WHEN abs(c) < 0.4 THEN '' WHEN c >= 0 THEN 'positive' ELSE 'negative' END AS label FROM (SELECT corr(l_quantity, l_extendedprice) AS c FROM lineitem)")
def correlation_labels(spark, sf):
    return infer.correlation(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select(infer.strength(F.col("r")).alias("label"))


def _grid_row(name: str, cells: dict[str, str]) -> str:
    return f"SELECT '{name}' AS name, " + ", ".join(f"{cells[c]} AS {c}" for c in ("l_quantity", "l_extendedprice", "l_tax")) + " FROM p, s"


#: l_tax has few values, so its pair goes by ranks.
@query("correlation_grid", "WITH k AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_tax) - 1) / 2.0 AS b FROM lineitem), s AS (SELECT round(corr(a, b), 4) + 0.0 AS s FROM k), p AS (SELECT round(corr(l_quantity, l_extendedprice), 4) + 0.0 AS p FROM lineitem) " + " UNION ALL ".join((_grid_row("l_quantity", {"l_quantity": "1.0::DOUBLE", "l_extendedprice": "p", "l_tax": "s"}), _grid_row("l_extendedprice", {"l_quantity": "p", "l_extendedprice": "1.0::DOUBLE", "l_tax": "0.0::DOUBLE"}), _grid_row("l_tax", {"l_quantity": "s", "l_extendedprice": "0.0::DOUBLE", "l_tax": "1.0::DOUBLE"}))))
def correlation_grid(spark, sf):
    return charts.correlation_grid(infer.correlations(table(spark, sf, "lineitem"), [("l_quantity", "l_extendedprice"), ("l_quantity", "l_tax")]), ["l_quantity", "l_extendedprice", "l_tax"])


G2 = "(SELECT avg(x) FILTER (g = lo) AS m1, var_samp(x) FILTER (g = lo) AS v1, count(*) FILTER (g = lo) AS n1, avg(x) FILTER (g <> lo) AS m2, var_samp(x) FILTER (g <> lo) AS v2, count(*) FILTER (g <> lo) AS n2 FROM (SELECT l_extendedprice AS x, l_linestatus AS g FROM lineitem), (SELECT min(l_linestatus) AS lo FROM lineitem))"


@query("welch_ttest", f"SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 4) AS statistic, round((v1 / n1 + v2 / n2) ^ 2 / ((v1 / n1) ^ 2 / (n1 - 1) + (v2 / n2) ^ 2 / (n2 - 1)), 2) AS df FROM {G2}")
def welch_ttest(spark, sf):
    return infer.welch_statistic(table(spark, sf, "lineitem"), "l_extendedprice", "l_linestatus").select("n1", "n2", r("statistic"), r("df", 2))


@query("pooled_ttest", f"SELECT round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 4) AS statistic, (n1 + n2 - 2)::DOUBLE AS df FROM {G2}")
def pooled_ttest(spark, sf):
    return infer.pooled_statistic(table(spark, sf, "lineitem"), "l_extendedprice", "l_linestatus").select(r("statistic"), "df")


@query("ttest_one_sample", "SELECT count(*)::BIGINT AS n, round((avg(l_quantity) - 25) / (stddev_samp(l_quantity) / sqrt(count(*))), 4) AS statistic, (count(*) - 1)::DOUBLE AS df FROM lineitem")
def ttest_one_sample(spark, sf):
    return infer.one_sample_statistic(table(spark, sf, "lineitem"), "l_quantity", 25.0).select("n", r("statistic"), "df")


def _chi(source: str, a: str, b: str, yates: str) -> str:
    return f"""WITH c AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {source} GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS ra FROM c GROUP BY 1), cb AS (SELECT b, sum(n) AS cb FROM c GROUP BY 1), t AS (SELECT sum(n) AS t FROM c)
SELECT first(t)::BIGINT AS n, round(sum((abs(coalesce(n, 0) - ra * cb / t) - {yates}) ^ 2 / (ra * cb / t)), 4) AS statistic, ((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1))::DOUBLE AS df FROM ra CROSS JOIN cb LEFT JOIN c USING (a, b), t"""


@query("chi_square", _chi("orders", "o_orderstatus", "o_orderpriority", "0"))
def chi_square(spark, sf):
    return infer.chi_square_statistic(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority").select("n", r("statistic"), "df")


@query("chi_square_yates", _chi("labels", "quality", "toxic", "0.5"))
def chi_square_yates(spark, sf):
    return infer.chi_square_statistic(table(spark, sf, "labels"), "quality", "toxic").select("n", r("statistic"), "df")


@query("crosstab", "SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2")
def crosstab(spark, sf):
    return infer.crosstab(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@query("crosstab_wide", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS f, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS o, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS p FROM orders GROUP BY 1")
def crosstab_wide(spark, sf):
    return infer.crosstab_wide(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"]).withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


@query("anova_f", "WITH g AS (SELECT count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY o_orderpriority), t AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS gm FROM g) SELECT first(k)::BIGINT AS k, first(t.n)::BIGINT AS n, round((sum(g.n * (m - gm) ^ 2) / first(k - 1)) / (sum((g.n - 1) * v) / first(t.n - k)), 4) AS statistic, first(k - 1)::DOUBLE AS df1, first(t.n - k)::DOUBLE AS df2 FROM g, t")
def anova_f(spark, sf):
    return infer.anova_statistic(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority").select("k", "n", r("statistic"), "df1", "df2")


@query("hypothesis_tests")
def hypothesis_tests(spark, sf):
    return infer.hypothesis_tests(table(spark, sf, "lineitem"), [{"type": "t-test", "columns": ["l_extendedprice", "l_linestatus"]}, {"type": "chi-square", "columns": ["l_returnflag", "l_linestatus"]}, {"type": "anova", "columns": ["l_quantity", "l_returnflag"]}, {"type": "t-test", "columns": ["l_quantity"], "mean": 25.0}])


def fit_row(spark, fit) -> DataFrame:
    return spark.createDataFrame([(k, round(v, 6)) for k, v in [*zip(fit.predictors, fit.coefficients, strict=True), ("intercept", fit.intercept), ("r2", fit.r_squared), ("n", float(fit.n))]], "term string, value double")


@query("linear_regression", "SELECT unnest(['l_quantity', 'intercept', 'r2', 'n']) AS term, round(unnest([regr_slope(l_extendedprice, l_quantity), regr_intercept(l_extendedprice, l_quantity), regr_r2(l_extendedprice, l_quantity), count(*)::DOUBLE]), 4) AS value FROM lineitem")
def linear_regression(spark, sf):
    return fit_row(spark, infer.regression(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"])).select("term", r("value"))


@query("regression_rows", "SELECT l_extendedprice AS actual, round(a + b * l_quantity, 2) AS predicted, round(l_extendedprice - a - b * l_quantity, 2) + 0.0 AS residual FROM lineitem, (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)")
def regression_rows(spark, sf):
    df = table(spark, sf, "lineitem")
    return infer.fitted_rows(df, infer.regression(df, "l_extendedprice", ["l_quantity"])).select("actual", r("predicted", 2), r("residual", 2))


TWO = "(SELECT covar_pop(l_quantity, l_quantity) AS a, covar_pop(l_discount, l_discount) AS b, covar_pop(l_quantity, l_discount) AS c, covar_pop(l_quantity, l_extendedprice) AS p, covar_pop(l_discount, l_extendedprice) AS q, avg(l_quantity) AS mx, avg(l_discount) AS mz, avg(l_extendedprice) AS my FROM lineitem)"


@query("multiple_regression", f"SELECT unnest(['l_quantity', 'l_discount', 'intercept']) AS term, round(unnest([(p * b - q * c) / (a * b - c * c), (q * a - p * c) / (a * b - c * c), my - mx * (p * b - q * c) / (a * b - c * c) - mz * (q * a - p * c) / (a * b - c * c)]), 1) AS value FROM {TWO}")
def multiple_regression(spark, sf):
    return fit_row(spark, infer.regression(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])).filter("term not in ('r2', 'n')").select("term", r("value", 1))


PARABOLA = "(SELECT var_pop(x) AS a, var_pop(x * x) AS b, covar_pop(x, x * x) AS c, covar_pop(x, y) AS p, covar_pop(x * x, y) AS q, avg(x) AS mx, avg(x * x) AS mz, avg(y) AS my, var_pop(y) AS vy FROM {})"


@query("polynomial_fit", f"WITH f AS (SELECT (p * b - q * c) / (a * b - c * c) AS w1, (q * a - p * c) / (a * b - c * c) AS w2, * FROM {PARABOLA.format('(SELECT hour(ts)::DOUBLE AS x, value AS y FROM events)')}) SELECT unnest([0, 1, 2, 3]) AS k, round(unnest([my - w1 * mx - w2 * mz, 0.0, w1, w2]), 4) + 0.0 AS value FROM f")
def polynomial_fit(spark, sf):
    df = features.datetime_features(table(spark, sf, "events"), ["ts"], ("hour",))
    m = regress.polynomial(df, "value", "ts_hour")
    return spark.createDataFrame([(k, round(v, 6)) for k, v in enumerate([m.intercept, *m.coefficients])], "k int, value double").select("k", r("value"))


@query("vif", "SELECT unnest(['l_quantity', 'l_extendedprice']) AS term, round(1 / (1 - corr(l_quantity, l_extendedprice) ^ 2), 4) AS vif FROM lineitem")
def vif_query(spark, sf):
    names = ["l_quantity", "l_extendedprice"]
    return spark.createDataFrame([(k, round(v, 4)) for k, v in vif(moments(table(spark, sf, "lineitem"), names), names).items()], "term string, vif double")


@query("model_selection", f"SELECT 'quality' AS case_name, CASE WHEN count(DISTINCT quality) = 2 THEN 'logistic' END AS model FROM labels UNION ALL SELECT 'price', CASE WHEN p * p / (a * vy) < 0.6 AND (p * p * b + q * q * a - 2 * p * q * c) / ((a * b - c * c) * vy) > p * p / (a * vy) + 0.1 THEN 'polynomial' ELSE 'linear' END FROM {PARABOLA.format('(SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem)')}")
def model_selection(spark, sf):
    labels, lines = table(spark, sf, "labels"), table(spark, sf, "lineitem")
    rows = [("quality", regress.select_model(labels, "quality", ["toxic"], {"quality": "binary"})), ("price", regress.select_model(lines, "l_extendedprice", ["l_quantity"], {"l_extendedprice": "continuous", "l_quantity": "continuous"}))]
    return spark.createDataFrame(rows, "case_name string, model string")


DAILY = "(SELECT ts::DATE AS day, sum(value) AS y, row_number() OVER (ORDER BY ts::DATE) - 1 AS x FROM events GROUP BY 1)"


@query("timeseries_forecast", f"WITH f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n FROM {DAILY}), s AS (SELECT stddev_samp(y - a - b * x) AS s FROM {DAILY}, f) SELECT 'Period ' || (n + i) AS label, round(a + b * (n + i - 1), 2) AS predicted, round(a + b * (n + i - 1) - 1.96 * s, 2) AS lower, round(a + b * (n + i - 1) + 1.96 * s, 2) AS upper FROM f, s, range(1, 6) t(i)")
def timeseries_forecast(spark, sf):
    daily = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("y"))
    return regress.timeseries(daily, "y", ["day"])[1].select("label", r("predicted", 2), r("lower", 2), r("upper", 2))


SPLIT = "(o_orderkey * 2654435761) % 100 < 20"


@query("train_test_split", f"SELECT o_orderkey, {SPLIT} AS test FROM orders")
def train_test_split(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", regress.in_test(F.col("o_orderkey")).alias("test"))


@query("train_test_metrics", f"WITH d AS (SELECT o_totalprice AS y, o_custkey AS x, {SPLIT} AS t FROM orders), f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d WHERE NOT t) SELECT count(*)::BIGINT AS n, round(1 - avg((y - a - b * x) ^ 2) / var_pop(y), 4) + 0.0 AS r2, round(sqrt(avg((y - a - b * x) ^ 2)), 2) AS rmse, round(avg(abs(y - a - b * x)), 2) AS mae, round(avg(abs((y - a - b * x) / y)) * 100, 2) AS mape FROM d, f WHERE t")
def train_test_metrics(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_totalprice").alias("y"), F.col("o_custkey").cast("double").alias("x"), regress.in_test(F.col("o_orderkey")).alias("t"))
    fit = ols(moments(rows.filter("not t"), ["x", "y"]), "y", ["x"])
    got = regress.regression_metrics(rows.filter("t").select(F.col("y").alias("actual"), fit.predict().alias("prediction")))
    return got.select("n", r("r2"), r("rmse", 2), r("mae", 2), r("mape", 2))


CM = "(SELECT count(*) FILTER (y AND p)::DOUBLE AS tp, count(*) FILTER (NOT y AND p)::DOUBLE AS fp, count(*) FILTER (y AND NOT p)::DOUBLE AS fn, count(*) FILTER (NOT y AND NOT p)::DOUBLE AS tn FROM (SELECT quality = 1 AS y, toxic = 0 AS p FROM labels))"


def _judged(spark, sf):
    return table(spark, sf, "labels").select(F.col("quality").alias("actual"), (1 - F.col("toxic")).alias("prediction"))


@query("classification_metrics", f"SELECT (tp + fp + fn + tn)::BIGINT AS n, round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy, round(tp / (tp + fp), 4) AS precision_, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 4) AS mcc FROM {CM}")
def classification_metrics(spark, sf):
    return regress.classification_metrics(_judged(spark, sf)).select("n", r("accuracy"), r("precision", 4, "precision_"), r("recall"), r("f1"), r("mcc"))


@query("macro_metrics", f"SELECT round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy, round((tp / (tp + fp) + tn / (tn + fn)) / 2, 4) AS precision_, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 4) AS recall FROM {CM}")
def macro_metrics(spark, sf):
    return regress.macro_metrics(_judged(spark, sf)).select(r("accuracy"), r("precision", 4, "precision_"), r("recall"))


@query("auc", "WITH k AS (SELECT l_linestatus = 'O' AS y, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS k FROM lineitem) SELECT round((sum(k) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * (count(*) FILTER (NOT y))::DOUBLE), 4) AS auc FROM k")
def auc(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_linestatus") == "O").cast("int").alias("actual"), F.col("l_quantity").alias("probability"))
    return regress.auc(rows).select(r("auc"))


#: Newton's steps on the four counts of a two by two table, with the default penalty of 1 / 100 on the slope.
LOGISTIC = """
WITH RECURSIVE c AS (
    SELECT count(*) FILTER (quality = 0)::DOUBLE AS n0, count(*) FILTER (quality = 1)::DOUBLE AS n1, count(*) FILTER (quality = 0 AND toxic = 1)::DOUBLE AS t0, count(*) FILTER (quality = 1 AND toxic = 1)::DOUBLE AS t1 FROM labels
), it(i, b0, b1) AS (
    SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE
    UNION ALL
    SELECT i + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
        SELECT *, t0 - n0 * p0 + t1 - n1 * p1 AS g0, t1 - n1 * p1 - 0.01 * b1 AS g1, n0 * p0 * (1 - p0) + n1 * p1 * (1 - p1) AS h00, n1 * p1 * (1 - p1) AS h01, n1 * p1 * (1 - p1) + 0.01 AS h11
        FROM (SELECT *, 1 / (1 + exp(-b0)) AS p0, 1 / (1 + exp(-b0 - b1)) AS p1 FROM it, c)
    ) WHERE i < 40
)
SELECT unnest(['quality', 'intercept', 'accuracy']) AS term, round(unnest([b1, b0, (CASE WHEN b0 > 0 THEN t0 ELSE n0 - t0 END + CASE WHEN b0 + b1 > 0 THEN t1 ELSE n1 - t1 END) / (n0 + n1)]), 4) AS value FROM it, c WHERE i = 40"""


@query("logistic", LOGISTIC)
def logistic(spark, sf):
    m = regress.logistic(table(spark, sf, "labels"), "toxic", ["quality"])
    return spark.createDataFrame([("quality", round(m.coefficients[0], 4)), ("intercept", round(m.intercept, 4)), ("accuracy", round(m.metrics["accuracy"], 4))], "term string, value double")


@query("random_forest")
def random_forest(spark, sf):
    m = regress.random_forest(table(spark, sf, "part"), "p_retailprice", ["p_size", "p_partkey"])
    return spark.createDataFrame([(k, v) for k, v in m.importance.items()], "feature string, importance double")


@query("stratified_split", "SELECT o_orderstatus AS status, split, (CASE split WHEN 'test' THEN floor(n * 0.2::DOUBLE + 0.5) WHEN 'val' THEN floor(n * 0.15::DOUBLE + 0.5) ELSE n - floor(n * 0.2::DOUBLE + 0.5) - floor(n * 0.15::DOUBLE + 0.5) END)::BIGINT AS n FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1), (VALUES ('test'), ('val'), ('train')) t(split)")
def stratified_split(spark, sf):
    made = training.stratified_split(table(spark, sf, "orders"), "o_orderstatus", F.col("o_orderkey"))
    return made.groupBy(F.col("o_orderstatus").alias("status"), "split").agg(F.count("*").alias("n"))


@query("stratified_folds", "SELECT o_orderstatus AS status, fold::INT AS fold, (n // 5 + (fold < n % 5)::INT)::BIGINT AS n FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1), range(5) t(fold)")
def stratified_folds(spark, sf):
    made = training.stratified_folds(table(spark, sf, "orders"), "o_orderstatus", F.col("o_orderkey"))
    return made.groupBy(F.col("o_orderstatus").alias("status"), "fold").agg(F.count("*").alias("n"))


@query("three_way_split", "SELECT CASE WHEN h < 0.2 THEN 'test' WHEN h < 0.35 THEN 'val' ELSE 'train' END AS split, count(*)::BIGINT AS n FROM (SELECT ((o_orderkey * 2654435761) % 10000) / 10000.0::DOUBLE AS h FROM orders) GROUP BY 1")
def three_way_split(spark, sf):
    return table(spark, sf, "orders").groupBy(training.split_column(F.col("o_orderkey")).alias("split")).agg(F.count("*").alias("n"))


@query("problem_detection", "SELECT 'labels' AS table_name, count(DISTINCT quality) <= 10 AND bool_and(quality = floor(quality)) AS classification FROM labels UNION ALL SELECT 'orders', count(DISTINCT o_totalprice) <= 10 AND bool_and(o_totalprice = floor(o_totalprice)) FROM orders")
def problem_detection(spark, sf):
    return spark.createDataFrame([("labels", training.is_classification(table(spark, sf, "labels"), "quality")), ("orders", training.is_classification(table(spark, sf, "orders"), "o_totalprice"))], "table_name string, classification boolean")


@query("experiment")
def experiment(spark, sf):
    df = table(spark, sf, "part").select("p_size", "p_partkey", "p_retailprice")
    report = training.experiment(df, "p_retailprice", ["p_size", "p_partkey"], ["ridge"], tuning="none", folds=2)
    return spark.createDataFrame([(m, k, float(v)) for m, x in report["models"].items() for k, v in x["test_metrics"].items() if v is not None], "model string, metric string, value double")


@query("best_model", " UNION ALL ".join(f"SELECT '{c}' AS best, regr_r2(l_extendedprice, {c}) AS r2 FROM lineitem" for c in ("l_discount", "l_quantity", "l_tax")).join(("SELECT arg_max(best, r2) AS best, round(max(r2), 4) AS r2 FROM (", ")")))
def best_model(spark, sf):
    rows = table(spark, sf, "lineitem")
    models = {c: {"test_metrics": {"r2": infer.regression(rows, "l_extendedprice", [c]).r_squared}} for c in ("l_discount", "l_quantity", "l_tax")}
    best = training.best_model(models | {"failed": {"error": "x"}}, False)
    return spark.createDataFrame([(best, round(models[best]["test_metrics"]["r2"], 4))], "best string, r2 double")


PLANE = "(SELECT var_pop(l_quantity) AS a, var_pop(l_tax) AS b, covar_pop(l_quantity, l_tax) AS c, covar_pop(l_quantity, l_extendedprice) AS p, covar_pop(l_tax, l_extendedprice) AS q, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)"


@query("permutation_importance", f"SELECT feature, row_number() OVER (ORDER BY fall DESC)::INT AS rank FROM (SELECT 'l_quantity' AS feature, ((p * b - q * c) / (a * b - c * c)) ^ 2 * a AS fall FROM {PLANE} UNION ALL SELECT 'l_tax', ((q * a - p * c) / (a * b - c * c)) ^ 2 * b FROM {PLANE})")
def permutation_importance(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity"), F.col("l_tax"), F.col("l_extendedprice"))
    m = regress.linear(rows, "l_extendedprice", ["l_quantity", "l_tax"])
    score = lambda d: regress.regression_metrics(m.predicted(d).select(F.col("l_extendedprice").alias("actual"), "prediction")).first()["r2"]
    return explain.permutation_importance(rows, ["l_quantity", "l_tax"], score).select("feature", "rank")


@query("partial_dependence", f"SELECT 'l_quantity' AS feature, round(lo + k * (hi - lo) / 9, 4) AS x, round(my + (p * b - q * c) / (a * b - c * c) * (lo + k * (hi - lo) / 9 - mx), 2) AS y FROM {PLANE}, range(10) t(k)")
def partial_dependence(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_quantity", "l_tax", "l_extendedprice")
    m = regress.linear(rows, "l_extendedprice", ["l_quantity", "l_tax"])
    return explain.partial_dependence(rows, ["l_quantity"], m.predicted, 10).select("feature", r("x"), r("y", 2))


@query("linear_attributions", "SELECT 'l_quantity' AS feature, round(avg(abs((l_quantity - m) * b)), 2) AS mean_abs FROM lineitem, (SELECT avg(l_quantity) AS m, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem)")
def linear_attributions(spark, sf):
    df = table(spark, sf, "lineitem")
    fit = infer.regression(df, "l_extendedprice", ["l_quantity"])
    return explain.linear_attributions(df, fit.predictors, fit.coefficients).select("feature", r("mean_abs", 2))


@query("coefficients", "SELECT 'l_quantity' AS feature, round(regr_slope(l_extendedprice, l_quantity), 4) AS coefficient, CASE WHEN regr_slope(l_extendedprice, l_quantity) > 0 THEN 'positive' ELSE 'negative' END AS direction FROM lineitem")
def coefficients(spark, sf):
    fit = infer.regression(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"])
    rows = explain.coefficient_rows(fit.predictors, fit.coefficients, False)
    return spark.createDataFrame([(x["feature"], x["coefficient"], x["direction"]) for x in rows], "feature string, coefficient double, direction string")


#: Three ways to rank columns: by correlation with the price, by relative spread, by how many values they have.
RANKED = ("l_quantity", "l_discount", "l_tax")
RANKINGS = " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, l_extendedprice)) AS near, stddev_pop({c}) / avg({c}) AS spread, count(DISTINCT {c})::DOUBLE AS many FROM lineitem" for c in RANKED)
CONSENSUS = f"WITH v AS ({RANKINGS}), k AS (SELECT feature, unnest([rank() OVER (ORDER BY near DESC), rank() OVER (ORDER BY spread DESC), rank() OVER (ORDER BY many DESC)]) AS rank FROM v), m AS (SELECT feature, avg(rank)::DOUBLE AS mean_rank, count(*)::BIGINT AS methods FROM k GROUP BY 1)"


@query("consensus_rank", f"{CONSENSUS} SELECT feature, round(mean_rank, 4) AS mean_rank, methods, row_number() OVER (ORDER BY mean_rank, feature)::INT AS position FROM m")
def consensus_rank(spark, sf):
    return _consensus(spark, sf).select("feature", r("mean_rank"), "methods", "position")


def _consensus(spark, sf):
    from pyspark.sql import Window

    rows = table(spark, sf, "lineitem")
    facts = rows.agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.abs(F.corr(c, "l_extendedprice")).alias("near"), (F.stddev_pop(c) / F.avg(c)).alias("spread"), F.count_distinct(F.col(c)).cast("double").alias("many")) for c in RANKED]).alias("f")).select(F.inline("f"))
    ranked = facts.select("feature", F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("value")) for m in ("near", "spread", "many")])))
    return explain.consensus(ranked.select("method", "feature", F.rank().over(Window.partitionBy("method").orderBy(F.desc("value"))).alias("rank")))  # a row a feature


@query("importance_chart", f"{CONSENSUS} SELECT feature, round((SELECT min(mean_rank) FROM m) / mean_rank, 4) AS share FROM m")
def importance_chart(spark, sf):
    return charts.importance_chart(_consensus(spark, sf)).select("feature", r("share"))


@query("tree_attributions")
def tree_attributions(spark, sf):
    """Mean attributions of a forest of default size over all parts, with how far they are from adding up."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    names = ["p_size", "p_partkey"]
    rows = spread(table(spark, sf, "part").select(*names, F.col("p_retailprice").alias("label")), order=[*names, "label"])
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    fitted = RandomForestRegressor(numTrees=regress.FOREST_TREES, maxDepth=5, seed=regress.SEED).fit(rows)
    made, _ = attribute.tree_attributions(rows, names, fitted)
    off = fitted.transform(made).agg(F.max(F.abs(F.col("prediction") - F.col("explained"))).alias("off"))  # one row
    return attribute.mean_attributions(made, names).crossJoin(F.broadcast(off)).select("feature", r("mean_abs", 2), r("percentage", 2), "rank", (F.col("off") < 1e-6).alias("adds_up"))


@query("neural_network")
def neural_network(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_quantity", "l_tax", F.col("l_extendedprice").alias("label"))
    model = training.build("neural_network", False, ["l_quantity", "l_tax"], {"layers": [8], "maxIter": 30}).fit(rows)
    return regress.regression_metrics(model.transform(rows).withColumnRenamed("label", "actual")).select("n", r("r2", 3))


@query("boosting_of_classes")
def boosting_of_classes(spark, sf):
    """Order states from prices and dates: three classes."""
    state = F.array_position(F.array(F.lit("F"), F.lit("O"), F.lit("P")), F.col("o_orderstatus")) - 1
    rows = table(spark, sf, "orders").select(F.datediff("o_orderdate", F.lit("1992-01-01")).cast("double").alias("day"), "o_totalprice", state.cast("double").alias("label")).filter("label >= 0")
    model = training.build("gradient_boosting", True, ["day", "o_totalprice"], {"maxIter": 10, "maxDepth": 3}, classes=3).fit(rows)
    return regress.macro_metrics(model.transform(rows).withColumnRenamed("label", "actual")).select(r("accuracy", 3), r("f1", 3))


FOLDED = "d AS (SELECT p_partkey, p_brand AS g, p_retailprice AS y, p_partkey % 5 AS f FROM part)"


@query("target_encode_out_of_fold", f"WITH {FOLDED}, b AS (SELECT g, sum(y) AS s, count(*) AS n FROM d GROUP BY 1), o AS (SELECT g, f, sum(y) AS s, count(*) AS n FROM d GROUP BY 1, 2), w AS (SELECT sum(y) AS s, count(*) AS n FROM d), v AS (SELECT f, sum(y) AS s, count(*) AS n FROM d GROUP BY 1) SELECT p_partkey, round((b.s - o.s + 10 * (w.s - v.s) / (w.n - v.n)) / (b.n - o.n + 10), 6) AS encoded FROM d JOIN b USING (g) JOIN o ON o.g = d.g AND o.f = d.f JOIN v ON v.f = d.f, w")
def target_encode_out_of_fold(spark, sf):
    rows = table(spark, sf, "part")
    codes = features.TargetCodes(rows, ["p_brand"], "p_retailprice", F.col("p_partkey") % 5)
    return codes.apply_out_of_fold(rows).select("p_partkey", r("p_brand_target_encoded", 6, "encoded"))


@query("target_encode_new_rows", f"WITH {FOLDED}, b AS (SELECT g, sum(y) AS s, count(*) AS n FROM d WHERE f <> 0 GROUP BY 1), w AS (SELECT avg(y) AS m FROM d WHERE f <> 0) SELECT p_partkey, round(coalesce((b.s + 10 * m) / (b.n + 10), m), 6) AS encoded FROM d LEFT JOIN b USING (g), w WHERE f = 0")
def target_encode_new_rows(spark, sf):
    rows = table(spark, sf, "part")
    codes = features.TargetCodes(rows.filter("p_partkey % 5 <> 0"), ["p_brand"], "p_retailprice")
    return codes.apply(rows.filter("p_partkey % 5 = 0")).select("p_partkey", r("p_brand_target_encoded", 6, "encoded"))


@query("scale_new_rows", "SELECT o_orderkey, round((o_totalprice - m) / s, 4) + 0.0 AS z FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders WHERE o_orderkey % 5 <> 0) WHERE o_orderkey % 5 = 0")
def scale_new_rows(spark, sf):
    rows = table(spark, sf, "orders")
    _, params = features.scale(rows.filter("o_orderkey % 5 <> 0"), ["o_totalprice"])
    return features.apply_scale(rows.filter("o_orderkey % 5 = 0"), params).select("o_orderkey", r("o_totalprice", 4, "z"))


@query("variant_correlations", "WITH k AS (SELECT row_number() OVER (ORDER BY l_linenumber, l_orderkey) AS a, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS b FROM lineitem) SELECT 'l_linenumber' AS column_a, 'l_extendedprice' AS column_b, 'spearman' AS method, round(corr(a, b), 4) + 0.0 AS r FROM k UNION ALL SELECT 'open', 'l_extendedprice', 'pearson', round(corr((l_linestatus = 'O')::INT, l_extendedprice), 4) + 0.0 FROM lineitem UNION ALL SELECT 'l_quantity', 'l_extendedprice', 'pearson', round(corr(l_quantity, l_extendedprice), 4) + 0.0 FROM lineitem")
def variant_correlations(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("open", F.when(F.col("l_linestatus") == "O", "Yes").otherwise("no"))
    types = {"l_linenumber": "ordinal", "open": "binary", "l_quantity": "continuous", "l_extendedprice": "continuous"}
    return infer.variant_correlations(rows, types, [(c, "l_extendedprice") for c in ("l_linenumber", "open", "l_quantity")], ["l_orderkey", "l_linenumber"]).select("column_a", "column_b", "method", r("r"))


@query("blocked_correlations", " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, count(*)::BIGINT AS n, round(corr({a}, {b}), 4) + 0.0 AS r FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for k, a in enumerate(NUMBERS) for b in NUMBERS[k + 1 :]))
def blocked_correlations(spark, sf):
    from quillstat.functions.linalg import pairwise_correlations

    got, n = pairwise_correlations(table(spark, sf, "lineitem"), NUMBERS)
    return spark.createDataFrame([(a, NUMBERS[j], int(n[i, j]), round(float(got[i, j]), 4) + 0.0) for i, a in enumerate(NUMBERS) for j in range(i + 1, len(NUMBERS))], "column_a string, column_b string, n bigint, r double")


def _histogram_sql(source: str, x: str, bins: str) -> str:
    return f"WITH d AS (SELECT {x} AS x FROM {source}), e AS (SELECT min(x) AS lo, (max(x) - min(x)) / {bins} AS w FROM d), c AS (SELECT least(floor((x - lo) / w), {bins} - 1)::INT AS bin, count(*) AS n FROM d, e GROUP BY 1) SELECT i::INT AS bin, round(lo + i * w, 2) AS low, coalesce(n, 0)::BIGINT AS n FROM e, range(0, {bins}) t(i) LEFT JOIN c ON bin = i"


@query("histogram", _histogram_sql("orders", "o_totalprice", "10"))
def histogram(spark, sf):
    return charts.histogram(table(spark, sf, "orders"), "o_totalprice").select("bin", r("low", 2), F.col("count").alias("n"))


@query("residual_histogram", _histogram_sql("lineitem, (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)", "l_extendedprice - a - b * l_quantity", "20"))
def residual_histogram(spark, sf):
    df = table(spark, sf, "lineitem")
    rows = infer.fitted_rows(df, infer.regression(df, "l_extendedprice", ["l_quantity"]))
    return charts.histogram(rows, "residual", charts.residual_bins(df.count())).select("bin", r("low", 2), F.col("count").alias("n"))


@query("estimated_histogram", "SELECT i::INT AS bin, round(lo + i * w, 2) AS low, round(lo + (i + 1) * w, 2) AS high, round(exp(-(((lo + (i + 0.5) * w - m) / s) ^ 2) / 2) / (s * sqrt(2 * pi())) * w * n)::BIGINT AS expected FROM (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 10 AS w, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, count(*) AS n FROM orders), range(10) t(i)")
def estimated_histogram(spark, sf):
    return charts.estimated_histogram(table(spark, sf, "orders"), "o_totalprice").select("bin", r("low", 2), r("high", 2), "expected")


@query("box_plot", "SELECT round(min(value), 4) AS low, round(quantile_cont(value, 0.25), 4) AS q1, round(median(value), 4) AS median, round(quantile_cont(value, 0.75), 4) AS q3, round(max(value), 4) AS high FROM events")
def box_plot(spark, sf):
    return charts.box_plot(table(spark, sf, "events"), "value").select(*[r(c) for c in ("low", "q1", "median", "q3", "high")])


@query("pie_slices", "SELECT event_type AS value, count(*)::BIGINT AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 6")
def pie_slices(spark, sf):
    return charts.slices(table(spark, sf, "events"), "event_type").withColumnRenamed("count", "n")


@query("scatter_thin", "SELECT o_custkey::DOUBLE AS x, o_totalprice AS y FROM orders, (SELECT greatest(count(*) // 500, 1) AS step FROM orders) WHERE o_orderkey % step = 0")
def scatter_thin(spark, sf):
    return charts.scatter(table(spark, sf, "orders"), "o_custkey", "o_totalprice", "o_orderkey")


@query("typical_row", "SELECT l_quantity, l_tax FROM (SELECT l_quantity, l_tax, abs(l_quantity) + abs(l_tax) AS size FROM lineitem) WHERE size = (SELECT size FROM (SELECT abs(l_quantity) + abs(l_tax) AS size, row_number() OVER (ORDER BY abs(l_quantity) + abs(l_tax)) AS k, count(*) OVER () AS n FROM lineitem) WHERE k = n // 2 + 1) ORDER BY 1, 2 LIMIT 1")
def typical_row(spark, sf):
    return charts.typical_row(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"])


@query("business_words")
def business_words(spark, sf):
    df = table(spark, sf, "lineitem")
    fit = infer.regression(df, "l_extendedprice", ["l_quantity"])
    got = df.agg(F.avg("l_extendedprice").alias("m"), F.stddev_samp("l_extendedprice").alias("s")).first()
    words = translate.regression_words({"r2": fit.r_squared, "rmse": fit.rmse}, "l_extendedprice", got["m"], got["s"])
    return spark.createDataFrame([(words["quality"], words["confidence"], words["insights"][0])], "quality string, confidence string, text string")


@query("planned_analysis", f"WITH t AS ({PART_TYPES}), d AS (SELECT column_name AS dependent, type, n_rows FROM t WHERE type IN ('continuous', 'binary', 'ordinal') AND contains(column_name, 'price') ORDER BY position LIMIT 1), p AS (SELECT least(count(*), 5) AS n FROM t, d WHERE column_name <> dependent AND t.type IN ('continuous', 'ordinal', 'binary')) SELECT CASE WHEN type = 'binary' THEN 'logistic' WHEN n_rows > 500 AND n >= 8 THEN 'randomforest' WHEN n > 1 THEN 'multiple' ELSE 'linear' END AS model, dependent FROM d, p")
def planned_analysis(spark, sf):
    facts = profile.column_facts(table(spark, sf, "part"))
    made = planner.plan({f.name: profile.analysis_type(f) for f in facts}, {f.name: f.distinct for f in facts}, facts[0].rows)
    return spark.createDataFrame([(made["predictive"]["modelType"], made["predictive"]["dependent"])], "model string, dependent string")


@query("full_analysis", "SELECT 'o_totalprice' AS column_name, count(*)::BIGINT AS n, round(avg(o_totalprice), 2) AS mean, round(corr(o_totalprice, o_custkey), 4) + 0.0 AS r, round(regr_slope(o_totalprice, o_custkey), 4) + 0.0 AS slope, round(regr_intercept(o_totalprice, o_custkey), 2) AS intercept FROM orders")
def full_analysis(spark, sf):
    from quillstat.plans.analyse import analyse

    request = {"mode": "manual", "descriptive": {"columns": ["o_totalprice"]}, "inferential": {"correlationPairs": [["o_totalprice", "o_custkey"]]}, "predictive": {"dependent": "o_totalprice", "predictors": ["o_custkey"], "modelType": "linear"}}
    out = analyse(table(spark, sf, "orders"), request)
    found = out.correlations.first()["r"]
    return out.described.select(F.col("column").alias("column_name"), F.col("count").alias("n"), r("mean", 2), r(F.lit(found), 4, "r"), r(F.lit(out.model.coefficients[0]), 4, "slope"), r(F.lit(out.model.intercept), 2, "intercept"))


@query("windowed_profile", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(value)::BIGINT AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1, 2")
def windowed_profile(spark, sf):
    got = live_profile.windowed_profile(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", "event_type")
    return got.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), F.col("group").alias("event_type"), "n", r("mean"))


@query("rate_limit", "SELECT user_id AS key, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*)::BIGINT AS n, least(count(*), 2)::BIGINT AS allowed, greatest(count(*) - 2, 0)::BIGINT AS refused FROM events GROUP BY 1, 2")
def rate_limit(spark, sf):
    got = live_profile.rate_limit(table(spark, sf, "events"), "ts", "user_id", 2, "1 day")
    return got.select("key", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n", "allowed", "refused")


@query("json_rows", "SELECT o_orderstatus AS status, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS price, sum(o_custkey)::BIGINT AS customers FROM orders GROUP BY 1")
def json_rows(spark, sf):
    from quillstat.sources.sinks import to_json

    return to_json(with_row_id(table(spark, sf, "orders"))).select(F.from_json("json", "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double").alias("j")).filter("j.o_orderkey is not null").groupBy(F.col("j.o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("j.o_totalprice"), 2).alias("price"), F.sum("j.o_custkey").alias("customers"))


# ---------------------------------------------------------------- files, codes, variants, examples


@query("csv_scan", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS o_orderstatus, o_totalprice, o_orderpriority || chr(10) || 'and, \"so\" on' AS note FROM orders")
def csv_scan(spark, sf):
    """orders as text, with a word for nulls, quotes, separators and line breaks in fields, and read again."""
    import uuid

    from quillstat.functions.ranks import shared_folder
    from quillstat.sources.ingest import ROW_ID, read_frame

    path = f"{shared_folder(spark).rstrip('/')}/orders-{uuid.uuid4().hex}.csv"
    note = F.concat("o_orderpriority", F.lit("\nand, \"so\" on")).alias("note")
    status = F.when(F.col("o_orderstatus") == "F", "N/A").otherwise(F.col("o_orderstatus")).alias("o_orderstatus")
    table(spark, sf, "orders").select("o_orderkey", "o_custkey", status, "o_totalprice", note).write.csv(path, header=True, escape='"', quoteAll=True)
    return read_frame(spark, path).drop(ROW_ID)


_SHOWN = {"p_name": "p_name", "p_brand": "p_brand", "p_type": "p_type", "p_size": "p_size"}


@query("intake", " UNION ALL ".join(f"SELECT '{c}' AS column_name, value FROM (SELECT {c}::VARCHAR AS value, row_number() OVER (ORDER BY {c}) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT {c} FROM part)) WHERE k <= 20 OR n <= 50" for c in _SHOWN))
def intake(spark, sf):
    from quillstat.plans.intake import parse_table

    found = parse_table(table(spark, sf, "part").select(*_SHOWN), "part")
    return spark.createDataFrame([(c["name"], str(v)) for c in found.columns for v in c["uniqueValues"]], "column_name string, value string")


@query("detected_codes", "SELECT o_orderkey, l_linenumber AS line, coalesce(CASE l_linenumber WHEN 1 THEN 'first' WHEN 2 THEN 'second' END, l_linenumber::VARCHAR) AS label FROM (SELECT l_orderkey AS o_orderkey, l_linenumber FROM lineitem)")
def detected_codes(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("line"))
    codes = profile.column_codes(profile.column_facts(rows, ["line"]))
    found = profile.apply_code_detection(codes, {c: {"coded": True, "labels": {"1": "first", "2": "second"}} for c in profile.uncertain_columns(codes)})
    return rows.withColumn("label", profile.labelled_value(found[0], F.col("line")))


@query("missing_summary", f"SELECT count_if(n > 0)::BIGINT AS columns, sum(n)::BIGINT AS cells, max(100.0 * n / rows) > 5 AS requires_attention FROM (SELECT count(*) FILTER (q IS NULL) AS n, count(*) AS rows FROM {GAPS})")
def missing_summary(spark, sf):
    return profile.missing_summary(gaps(table(spark, sf, "lineitem")).select("l_quantity", "l_tax"))


@query("missing_variant", "SELECT o_orderkey, coalesce(CASE WHEN o_custkey % 3 > 0 THEN o_totalprice END, (SELECT avg(o_totalprice) FROM orders WHERE o_custkey % 3 > 0))::DECIMAL(18, 4)::DOUBLE AS price, CASE WHEN o_custkey % 4 > 0 THEN o_orderstatus END AS status FROM orders")
def missing_variant(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 > 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_custkey") % 4 > 0, F.col("o_orderstatus")).alias("status"))
    return missing.apply_strategies(rows, {"price": "mean", "status": "mode"}, numeric_only=True).select("o_orderkey", r("price"), "status")


_VARIANT = "(SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS q, CASE WHEN l_linenumber <> 2 THEN l_tax END AS t, CASE WHEN l_linenumber <> 1 THEN (l_linestatus = 'O')::INT END AS o FROM lineitem)"


@query("model_fill_variant", f"WITH g AS {_VARIANT} SELECT l_orderkey, l_linenumber, round(coalesce(q, (SELECT median(q) FROM g)), 4) AS q, round(coalesce(t, (SELECT avg(t) FROM g)), 4) AS t, coalesce(o, (SELECT o FROM g WHERE o IS NOT NULL GROUP BY o ORDER BY count(*) DESC, o LIMIT 1))::DOUBLE AS o FROM g")
def model_fill_variant(spark, sf):
    line = F.col("l_linenumber")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.when(line != 3, F.col("l_quantity")).alias("q"), F.when(line != 2, F.col("l_tax")).alias("t"), F.when(line != 1, (F.col("l_linestatus") == "O").cast("int")).alias("o"))
    filled = missing.model_fill(rows, "l_extendedprice", ["q", "t", "o"], {"q": "ordinal", "t": "continuous", "o": "binary"})
    return filled.select("l_orderkey", "l_linenumber", r("q"), r("t"), r("o"))


@query("variant_tests", f"SELECT 't-test' AS test, statistic, df AS df1, NULL::DOUBLE AS df2 FROM ({ORACLE_SQL['pooled_ttest']}) UNION ALL SELECT 'anova', round((sum(g.n * (m - gm) ^ 2) / first(k - 1)) / (sum((g.n - 1) * v) / first(t.n - k)), 4), first(k - 1)::DOUBLE, first(t.n - k)::DOUBLE FROM (SELECT count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY l_returnflag) g, (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS gm FROM (SELECT count(*) AS n, avg(l_extendedprice) AS m FROM lineitem GROUP BY l_returnflag)) t UNION ALL SELECT 'chi-square', statistic, df, NULL FROM ({_chi('lineitem', 'l_returnflag', 'l_linestatus', '0')})")
def variant_tests(spark, sf):
    """The statistics of all tests by the dispatcher's variant; its tails are tested against known ones."""
    wanted = [{"type": "t-test", "columns": ["l_extendedprice", "l_linestatus"]}, {"type": "anova", "columns": ["l_extendedprice", "l_returnflag"]}, {"type": "chi-square", "columns": ["l_returnflag", "l_linestatus"]}]
    return infer.hypothesis_tests(table(spark, sf, "lineitem"), wanted, "ts").select("test", r("statistic"), "df1", "df2")


@query("all_correlations", " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 4) + 0.0 AS r FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_tax"))))
def all_correlations(spark, sf):
    """Without pairs every two numeric columns are taken, but those that are missing in most rows."""
    rows = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", F.when(F.col("l_linenumber") > 90, 1.0).alias("empty"), "l_tax", "l_returnflag")
    return infer.variant_correlations(rows, {"l_quantity": "continuous", "l_extendedprice": "continuous", "empty": "continuous", "l_tax": "continuous", "l_returnflag": "categorical"}).select("column_a", "column_b", r("r"))


@query("baselines", "WITH t AS (SELECT avg(l_extendedprice) AS m, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem WHERE l_orderkey % 5 > 0), e AS (SELECT l_extendedprice AS y, l_quantity AS x FROM lineitem WHERE l_orderkey % 5 = 0) SELECT 'dummy' AS model, round(1 - avg((y - m) ^ 2) / var_pop(y), 4) + 0.0 AS r2, round(sqrt(avg((y - m) ^ 2)), 2) AS rmse FROM e, t UNION ALL SELECT 'linear', round(1 - avg((y - a - b * x) ^ 2) / var_pop(y), 4) + 0.0, round(sqrt(avg((y - a - b * x) ^ 2)), 2) FROM e, t")
def baselines(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity"), F.col("l_extendedprice").alias("label"), (F.col("l_orderkey") % 5 == 0).alias("held"))
    found = training.baselines(rows.filter("not held"), rows.filter("held"), False, ["l_quantity"])
    return spark.createDataFrame([(k, v["r2"] + 0.0, round(v["rmse"], 2)) for k, v in found.items()], "model string, r2 double, rmse double")


@query("scatter_by_row", "SELECT (k - 1)::DOUBLE AS x, o_totalprice AS y FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS k, greatest(count(*) OVER () // 500, 1) AS step FROM orders) WHERE (k - 1) % step = 0")
def scatter_by_row(spark, sf):
    return charts.scatter(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "o_orderkey")


@query("example_prediction", "WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem), t AS (SELECT x FROM (SELECT l_quantity AS x, row_number() OVER (ORDER BY abs(l_quantity)) AS k, count(*) OVER () AS n FROM lineitem) WHERE k = n // 2 + 1) SELECT 'l_quantity' AS predictor, x AS value, round(b, 4) AS coef, round(a + b * x, 2) AS prediction FROM m, t")
def example_prediction(spark, sf):
    df = table(spark, sf, "lineitem")
    fit = infer.regression(df, "l_extendedprice", ["l_quantity"])
    got = charts.example_prediction(df, ["l_quantity"], fit.coefficients, fit.intercept)
    return spark.createDataFrame([(c["predictor"], c["value"], round(c["coef"], 4), round(got["prediction"], 2)) for c in got["conditions"]], "predictor string, value double, coef double, prediction double")
