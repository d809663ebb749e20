"""The corpus pipeline: quality rules, near-duplicates, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of documents; the last returns
token counts and digests. Stages are written as Parquet in the cluster's shared folder and read again, so that a
lost executor costs one stage at most; a stage's table is deleted when the next one is written.

Rows without a doc_id are judged by their text like any other and keep their null id. Null and empty texts fail the
quality rules and go; very long texts are taken whole. Of repeated rows and groups of near copies one row stays, that
with the least doc_id. Extra columns are carried as they are up to the last stage, whatever their names. Empty tables
give an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillstat.llm.bpe import tokenise
from quillstat.llm.common import discard, read_table, shared_folder
from quillstat.llm.decontaminate import drop_leaks
from quillstat.llm.near_dedup import keep_one
from quillstat.llm.pii import redact
from quillstat.llm.quality import keep_good

STAGES = [
    ("quality", keep_good),
    ("near_dedup", keep_one),
    ("decontaminate", drop_leaks),
    ("pii", redact),
    ("bpe", tokenise),
]

#: Posterior qualities, set similarity joins, a latent space and BPE merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            discard(spark, before)  # the stage after it is written
        before = f"{folder}/{name}"
    return docs
