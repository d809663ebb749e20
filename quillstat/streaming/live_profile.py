"""An addition of this engine: the profile of a stream, by tumbling windows with a watermark.

The state of a window is a handful of sums for each group, and is dropped once the watermark has passed it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_profile(stream: DataFrame, time: str, value: str, group: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """window_start, group, n, nulls, mean, std_dev, min, max; works on batch and streaming tables alike."""
    x = F.col(f"`{value}`").cast("double")
    rows = stream.withColumn("_t", F.col(f"`{time}`").cast("timestamp")).withWatermark("_t", late)
    got = rows.groupBy(F.window("_t", width).alias("w"), F.col(f"`{group}`").alias("group")).agg(F.count(x).alias("n"), F.count_if(x.isNull()).alias("nulls"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std_dev"), F.min(x).alias("min"), F.max(x).alias("max"))
    return got.select(F.col("w.start").alias("window_start"), "group", "n", "nulls", "mean", "std_dev", "min", "max")


def rate_limit(requests: DataFrame, time: str, key: str, limit: int = 20, width: str = "1 minute") -> DataFrame:
    """key, window_start, n, allowed, refused: requests over the limit in a fixed window are refused."""
    got = requests.groupBy(F.col(f"`{key}`").alias("key"), F.window(F.col(f"`{time}`").cast("timestamp"), width).alias("w")).agg(F.count("*").alias("n"))
    return got.select("key", F.col("w.start").alias("window_start"), "n", F.least("n", F.lit(limit)).alias("allowed"), F.greatest(F.col("n") - limit, F.lit(0)).alias("refused"))
