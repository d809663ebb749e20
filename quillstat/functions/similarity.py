"""String similarity for distinct values: a vectorised UDF around the standard library's sequence matcher."""

from __future__ import annotations

import bisect
import difflib
import itertools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(DoubleType())
def match_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def close_match(names: list[str], cutoff: float):
    """A UDF that gives the closest of `names` (a fixed short list), or null under the cutoff."""

    @F.pandas_udf(StringType())
    def closest(values: pd.Series) -> pd.Series:
        found = {v: (difflib.get_close_matches(v, names, 1, cutoff) or [None])[0] for v in values.dropna().unique()}
        return values.map(found)

    return closest


def _by_characters(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(v, w): candidates by the characters they share.

    The ratio is 2 M / (|v| + |w|) for M matched characters. So w holds at least threshold / (2 - threshold) of the
    characters of v, counted with repeats, and the other way round; of two such values each has one of the other's
    rarest characters among its own rarest, as many as it may lack and one more. Values meet by those and by
    neighbouring classes of length; what they can match at most is checked before the ratio is taken.
    """
    share = threshold / (2 - threshold)
    step = 1 / share

    def tokens(v: Column) -> Column:
        chars = F.filter(F.split(v, ""), lambda x: x != "")
        return F.transform(chars, lambda x, k: F.concat(x, F.size(F.filter(F.slice(chars, 1, k + 1), lambda y: y == x)).cast("string")))

    one, two = (df.select(F.col(df.columns[0]).alias("v")).filter("v != ''").distinct().withColumn("tokens", tokens(F.col("v"))) for df in (left, right))
    common = one.unionByName(two).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("seen"))

    def keyed(df: DataFrame) -> DataFrame:
        listed = df.select("v", F.explode("tokens").alias("token")).join(common, "token").groupBy("v").agg(F.sort_array(F.collect_list(F.struct("seen", "token"))).alias("t"))
        size = F.size("t")
        rare = F.slice("t", 1, (size - F.ceil(size * share - 1e-9) + 1).cast("int"))
        length = F.floor(F.log(size.cast("double")) / F.log(F.lit(step))).cast("int")
        return listed.select("v", F.transform("t", lambda x: x["token"]).alias("tokens"), F.transform(rare, lambda x: x["token"]).alias("rare"), length.alias("length"))

    a = keyed(one).select("v", "tokens", F.explode("rare").alias("token"), "length")
    b = keyed(two).select(F.col("v").alias("w"), F.col("tokens").alias("others"), F.explode("rare").alias("token"), F.explode(F.array(F.col("length") - 1, F.col("length"), F.col("length") + 1)).alias("length"))
    most = 2 * F.size(F.array_intersect("tokens", "others")) / (F.size("tokens") + F.size("others"))
    return a.join(b, ["token", "length"]).filter(most >= threshold - 1e-9).select("v", "w").distinct()


#: A value is met by what is left after deletions while these leave at most so many different rests.
MOST_RESTS = 400
#: Longer values are never met so.
SHORT = 40


def _needed(a: int, b: int, threshold: float) -> int:
    """How many characters two values of these lengths must share in order to reach the ratio."""
    return math.ceil(threshold * (a + b) / 2 - 1e-9)


def _rests(values: DataFrame, sizes: dict[int, list[int]], column: str) -> DataFrame:
    """(column, key): hashes of every subsequence of the sizes that are asked for values of this length."""

    @F.pandas_udf("array<string>")
    def rests(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({f"{n}:{''.join(c)}" for n in sizes.get(len(t), ()) for c in itertools.combinations(t, n)}) for t in texts])

    asked = values.select(F.col("v").alias(column)).filter(F.char_length(column).isin(*sizes) if sizes else F.lit(False))
    return asked.select(column, F.explode(rests(column)).alias("rest")).select(column, F.xxhash64("rest").alias("key"))


def similar_values(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(v, w, ratio): values v of `left` and w of `right` whose match ratio reaches the threshold, none left out.

    The ratio is 2 M / (|v| + |w|) for M characters matched in the same order, so two values of given lengths reach it
    only if they have a common subsequence of a certain size. Where deleting down to that size leaves few rests (short
    values), values meet by a rest that both have: only values that are nearly the same do. Pairs of longer ones meet by
    the characters they share. The ratio of every pair that meets is taken.
    """
    one, two = (df.select(F.col(df.columns[0]).alias("v")).filter("v != ''").distinct() for df in (left, right))
    lengths = [sorted(r[0] for r in df.select(F.char_length("v")).distinct().collect()) for df in (one, two)]  # as many as lengths in use
    ways: tuple[dict[int, set[int]], dict[int, set[int]]] = ({}, {})
    far: tuple[set[int], set[int]] = (set(), set())
    near = [[n for n in own if n <= SHORT] for own in lengths]
    for a, b in itertools.product(*near):
        n = _needed(a, b, threshold)
        if n > min(a, b):
            continue
        if n and math.comb(max(a, b), n) <= MOST_RESTS:
            ways[0].setdefault(a, set()).add(n)
            ways[1].setdefault(b, set()).add(n)
        else:
            far[0].add(a)
            far[1].add(b)
    for own, others, out in ((lengths[0], lengths[1], far[0]), (lengths[1], lengths[0], far[1])):
        for a in own:  # lengths of which some pair is beyond SHORT
            low, high = math.floor(a * threshold / (2 - threshold)), math.ceil(a * (2 - threshold) / max(threshold, 1e-9))
            k = bisect.bisect_left(others, low if a > SHORT else max(low, SHORT + 1))
            if k < len(others) and others[k] <= high:
                out.add(a)
    short = [{k: sorted(v) for k, v in w.items()} for w in ways]
    met = _rests(one, short[0], "v").join(_rests(two, short[1], "w"), "key").select("v", "w").distinct()
    size = F.char_length("v") + F.char_length("w")
    least = F.ceil(threshold * size / 2 - 1e-9)
    met = met.filter(least <= F.least(F.char_length("v"), F.char_length("w")))
    if far[0] and far[1]:
        long = [df.filter(F.char_length("v").isin(*sorted(f))) for df, f in zip((one, two), far, strict=True)]
        met = met.unionByName(_by_characters(*long, threshold)).distinct()
    return met.withColumn("ratio", match_ratio("v", "w")).filter(F.col("ratio") >= threshold)


def title_case(text: Column) -> Column:
    """Title case that also capitalises after anything that is not a letter with a case."""
    runs = F.regexp_extract_all(text, F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda run: F.concat(F.upper(F.substring(run, 1, 1)), F.lower(run.substr(F.lit(2), F.char_length(run))))), "")
