import zlib

import pytest

from quillstat.llm.sharding import balanced_shards

SCHEMA = "doc_id bigint, text string, shard string, size int"


def brute(rows, shards):
    rows = sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    total, at, out, slots = sum(r[1] for r in rows), 0, [], {}
    for i, size, crc in rows:
        shard = min(shards * (2 * at + size) // (2 * total), shards - 1)
        out.append((i, size, crc, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
        at += size
    return out


def shards_of(spark, rows, shards):
    df = spark.createDataFrame([(i, t, "own", 1) for i, t in rows], SCHEMA)
    made = balanced_shards(df, shards)
    assert made.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = made.collect()
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in got)
    return sorted((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got)


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert shards_of(spark, rows, 24) == brute(rows, 24)


def test_nulls_empty_long_and_unicode(spark):
    rows = [(1, None), (2, ""), (3, "é" * 50_000), (4, "x"), (5, "日本"), (6, "x"), (-7, "a" * 9)]
    assert shards_of(spark, rows, 3) == brute(rows, 3)


def test_repeated_rows_and_null_ids_keep_a_slot_each(spark):
    rows = [(5, "same")] * 40 + [(None, "no id")] * 3
    got = balanced_shards(spark.createDataFrame([(i, t, "s", 1) for i, t in rows], SCHEMA), 4).collect()
    assert len(got) == 43 and len({(r["shard"], r["slot"]) for r in got}) == 43
    for shard in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))


@pytest.mark.parametrize("hot", [200])
def test_hot_text_is_cut_too(spark, hot):
    got = shards_of(spark, [(k, "hot text" * 20) for k in range(hot)], 10)
    sizes = [sum(r[1] for r in got if r[3] == s) for s in range(10)]
    assert max(sizes) - min(sizes) <= 2 * 168


def test_empty_table(spark):
    assert balanced_shards(spark.createDataFrame([], SCHEMA), 24).collect() == []
