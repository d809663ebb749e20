"""Contiguous shards of near-equal bytes by global prefix sums.

Rows are ordered by id. Range partitions give per-partition totals; the running total of those, one row per
partition, turns each partition's own running sum into a global one. A row goes to the shard in which the
middle of its bytes falls, so every cut lies within half a row of its equal target.

Only ids, sizes and checksums move: no text is shuffled. A null text has no bytes, so its size is OVERHEAD and
its checksum that of the empty text. A null id comes first. Rows equal in id, size and checksum are told apart
by an arbitrary number, so that repeats spread over partitions and every row keeps a slot of its own. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstat.llm.common import materialise, read_table

SHARDS, OVERHEAD = 24, 8


def balanced_shards(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard); slots count from 0 in each shard."""
    text = F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "UTF-8")
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.length(text) + overhead).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("tie"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # range bounds come from a sample of the keys; the checkpoint fixes them for both uses below
    ranged = materialise(slim.repartitionByRange(n, "doc_id", "size", "text_crc32", "tie").withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    whole = totals.agg(F.sum("bytes").alias("all_bytes"))
    within = Window.partitionBy("part").orderBy("doc_id", "size", "text_crc32", "tie")
    placed = (
        ranged.withColumn("ends", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(within))
        .join(F.broadcast(starts), "part")  # spark.sql.shuffle.partitions rows
        .crossJoin(F.broadcast(whole))  # one row
        .withColumn("at", F.col("bytes_before") + F.col("ends") - F.col("size"))
        .withColumn("row", F.col("rows_before") + F.col("nth") - 1)
        .withColumn("shard", F.expr(f"least(({shards} * (2 * at + size)) div (2 * all_bytes), {shards - 1})").cast("int"))
    )
    placed = materialise(placed.select("doc_id", "size", "text_crc32", "shard", "row"))
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Fixed value: the reflected polynomial of CRC-32. The table of 256 and the fold over bytes are plain SQL.
OP4_SQL = """
WITH RECURSIVE crc_table(b, v, k) AS (
    SELECT range, range, 0 FROM range(256)
    UNION ALL
    SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM crc_table WHERE k < 8
), crc AS (SELECT list(v ORDER BY b) AS t FROM crc_table WHERE k = 8),
sized AS (
    SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size,
        xor(4294967295, list_reduce(
            list_transform(range(0, strlen(coalesce(text, ''))), lambda i: ('0x' || substr(hex(encode(coalesce(text, ''))), 2 * i + 1, 2))::BIGINT),
            lambda a, x: xor(a >> 8, crc.t[(xor(a, x) & 255) + 1]), 4294967295::BIGINT)) AS text_crc32
    FROM documents, crc
), placed AS (
    SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS begins, sum(size) OVER () AS total FROM sized
), cut AS (
    SELECT *, least((24 * (2 * begins + size)) // (2 * total), 23)::INT AS shard FROM placed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INT AS grown_shard
FROM cut
"""
