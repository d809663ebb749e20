"""Filter interaction audit by direct relational replay.

Every document's failed filters, a small bit mask, meet all orders of the filters, a broadcast table of 120 rows. Each
order's steps are exploded, the first failed step of the document in that order tells where it is removed, and all
figures are conditional sums with a partial aggregation in each task, so that a part of any size leaves a task as one
row for each order and step.

Whether a text repeats a smaller id's is found by the least id of each text digest, which is joined back by id and
digest together: a text with very many copies is no hot key.

A null text counts as empty, a null lang as the empty string. A null id has no smaller one: such a row never fails the
copy filter and has no labels. Of several labels of one id the greatest counts. Repeated rows are counted each; rows that share both
id and text are no copies of a smaller id. Texts are judged whole. An empty table gives an empty result. Extra columns
are not read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.llm.common import read_table, session_defaults

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails A, B, C and D."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < MIN_WORDS, 100 * distinct.cast("bigint") < DISTINCT_PERCENT * n.cast("bigint"), 100 * capitals.cast("bigint") > CAPITAL_PERCENT * F.char_length(text).cast("bigint"), F.regexp_like(text, F.lit(r"[#$%&*|]"))]


def orders(spark: SparkSession) -> DataFrame:
    """(nth, filter_order, masks): the bit of each step's filter in every order of the filters."""
    rows = [(k, "".join(p), [1 << FILTERS.index(c) for c in p]) for k, p in enumerate(itertools.permutations(FILTERS))]
    return spark.createDataFrame(rows, "nth int, filter_order string, masks array<int>")


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, good, toxic) of every row: the mask of its failed filters and its labels."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    mask = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(text_failures(F.col("text")))), F.lit(0))
    # ids that are null are dealt over all tasks instead of meeting in one; they match nothing
    key = F.coalesce("doc_id", F.monotonically_increasing_id())
    own = own.select("part", F.col("doc_id").isNotNull().alias("known"), key.alias("key"), F.sha2("text", 256).alias("digest"), mask.alias("failed"))
    firsts = docs.select(F.col("doc_id").cast("bigint").alias("key"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).dropna().groupBy("digest").agg(F.min("key").alias("key"), F.lit(True).alias("first"))
    marks = labels.select(F.col("doc_id").cast("bigint").alias("key"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).filter("key is not null").groupBy("key").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    met = own.join(firsts, ["key", "digest"], "left").join(marks, "key", "left")
    copy = F.col("known") & F.col("first").isNull()
    is_one = lambda c: F.coalesce(F.col("known") & (F.col(c) == 1), F.lit(False)).cast("bigint")
    return met.select("part", (F.col("failed") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).alias("failed"), is_one("quality").alias("good"), is_one("toxic").alias("toxic"))


def replay(flags: DataFrame) -> DataFrame:
    """(part, filter_order, step, filter, *FIGURES, shapley) from rows (part, failed, good, toxic)."""
    ways = orders(flags.sparkSession)
    met = flags.crossJoin(F.broadcast(ways.select("nth", "masks")))  # 120 rows
    first = F.lit(len(FILTERS) + 1)
    for k in reversed(range(len(FILTERS))):
        first = F.when(F.col("failed").bitwiseAND(F.col("masks")[k]) != 0, k + 1).otherwise(first)
    steps = F.array(*[F.struct(F.lit(k + 1).alias("step"), F.col("masks")[k].alias("bit")) for k in range(len(FILTERS))])
    replayed = met.withColumn("first", first).select("part", "nth", "failed", "good", "toxic", "first", F.inline(steps))
    removed, fails = F.col("first") == F.col("step"), F.col("failed").bitwiseAND(F.col("bit")) != 0
    conditions = {
        "kept": F.col("first") > F.col("step"),
        "removed": removed,
        "redundant": fails & (F.col("first") < F.col("step")),
        "unique_fails": F.col("failed") == F.col("bit"),
        "good_lost": removed & (F.col("good") == 1),
        "toxic_lost": removed & (F.col("toxic") == 1),
    }
    sums = [F.sum(c.cast("bigint")).alias(name) for name, c in conditions.items()]
    totals = replayed.groupBy("part", "nth", "step", "bit").agg(*sums)
    letter = F.element_at(F.array(*map(F.lit, FILTERS)), F.log2("bit").cast("int") + 1)
    totals = totals.join(F.broadcast(ways.select("nth", "filter_order")), "nth").withColumn("filter", letter)
    shares = totals.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))  # five rows a part
    return totals.join(shares, ["part", "filter"]).select("part", "filter_order", "step", "filter", *FIGURES, "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    session_defaults(docs.sparkSession)
    return replay(flagged(docs, labels))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


OP13_SQL = """
WITH cut AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents
), marks AS (
    SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id
), flags AS (
    SELECT c.doc_id, part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic, map {
        'A': len(words) < 200,
        'B': 100 * len(list_distinct(words)) < 50 * len(words),
        'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
        'D': regexp_matches(text, '[#$%&*|]'),
        'E': coalesce(c.doc_id > min(c.doc_id) OVER (PARTITION BY text), false)} AS fails
    FROM cut c LEFT JOIN marks m ON c.doc_id = m.doc_id
), letters(f) AS (
    VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE b.f <> a.f AND c.f NOT IN (a.f, b.f) AND d.f NOT IN (a.f, b.f, c.f) AND e.f NOT IN (a.f, b.f, c.f, d.f)
), patterns AS (
    SELECT part, good, toxic, fails, count(*) AS n FROM flags GROUP BY ALL
), replayed AS (
    SELECT p.*, filter_order, coalesce(list_min(list_filter([1, 2, 3, 4, 5], lambda k: fails[filter_order[k]])), 6) AS first FROM patterns p, orders
), counted AS (
    SELECT part, filter_order, step::INT AS step, filter_order[step] AS filter, coalesce(sum(n) FILTER (first > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (first = step), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (first < step AND fails[filter_order[step]]), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (fails[filter_order[step]] AND len(list_filter(map_values(fails), lambda x: x)) = 1), 0)::BIGINT AS unique_fails,
        coalesce(sum(n) FILTER (first = step AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (first = step AND toxic), 0)::BIGINT AS toxic_lost
    FROM replayed, unnest([1, 2, 3, 4, 5]) AS s(step) GROUP BY ALL
)
SELECT *, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM counted
"""
