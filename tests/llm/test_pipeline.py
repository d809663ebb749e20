from pathlib import Path

import pytest

import corpus_pipeline
from quillstat.llm import registry
from quillstat.llm.bpe import digests, public_vocabulary, round_trip
from quillstat.llm.near_dedup import near_duplicates
from quillstat.llm.quality import judge


def test_stages_one_by_one(spark, sf_dir, tmp_path):
    docs = first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "quality":
            assert ids(out) == ids(judge(docs).filter("kept"))
        if name == "near_dedup":
            assert ids(out) == ids(near_duplicates(docs).filter("kept"))
        if name == "pii":
            assert ids(out) == ids(docs)
        if name == "bpe":
            assert {tuple(r) for r in out.collect()} == {tuple(r) for r in digests(round_trip(docs.select("doc_id", "text"), *public_vocabulary())).collect()}
        else:
            assert out.columns == columns
        kept.append(out.count())
        docs = out
    assert first.count() >= kept[0] >= kept[1] >= kept[2] == kept[3] == kept[4] > 0.5 * first.count()


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_run_twice_gives_the_same(spark, sf_dir):
    one, two = (sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) for _ in range(2))
    assert one and one == two


ONE_ROW_EACH = {"op1_toxicity": "documents", "op3_token_count": "documents", "op4_sharding": "documents", "op5_warc": "pages", "op6_url_filter": "pages", "op7_near_dedup": "documents", "op8_pii": "documents", "op9_bpe": "documents", "op10_quality": "documents", "op11_language_id": "documents", "op12_align": "documents"}


@pytest.mark.parametrize("name", list(ONE_ROW_EACH))
def test_queries_give_each_row_once(spark, sf_dir, name):
    table = spark.read.parquet(f"{sf_dir}/{ONE_ROW_EACH[name]}.parquet")
    key = table.columns[0]
    got = registry.QUERIES[name](spark, sf_dir).select(key).collect()
    assert sorted(r[key] for r in got) == sorted(r[key] for r in table.select(key).collect())


def test_other_queries(spark, sf_dir):
    assert set(registry.QUERIES) - set(ONE_ROW_EACH) == {"op2_decontaminate", "op13_filter_audit"}
    langs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang").distinct().count()
    assert registry.QUERIES["op13_filter_audit"](spark, sf_dir).count() == langs * 600
    found = registry.QUERIES["op2_decontaminate"](spark, sf_dir)
    assert found.count() == found.select("doc_id", "item_id").distinct().count()


def test_stage_tables_are_deleted(spark, sf_dir):
    folder = Path(corpus_pipeline.shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("pipeline-*"))
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    (made,) = set(folder.glob("pipeline-*")) - before
    assert [p.name for p in made.iterdir()] == [corpus_pipeline.STAGES[-1][0]]


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_ids_repeats_and_extra_columns(spark, sf_dir, tmp_path):
    """Null ids stay null and are judged by their text; copies leave one row; clashing names are carried."""
    from pyspark.sql import functions as F

    good = registry.QUERIES["op10_quality"](spark, sf_dir).filter("kept").orderBy("doc_id").limit(6).select("doc_id")
    some = spark.read.parquet(f"{sf_dir}/documents.parquet").join(good, "doc_id")
    rows = some.withColumns({"_key": F.lit("own"), "kept": F.lit(7), "spans": F.lit(1.5)})
    lone = rows.orderBy("doc_id").limit(1).withColumns({"doc_id": F.lit(None).cast("bigint"), "text": F.concat("text", F.lit(" and a great many other words follow here so that this is no copy at all " * 9))})
    docs = rows.unionByName(rows).unionByName(lone).unionByName(lone).unionByName(rows.limit(1).withColumn("text", F.lit(None).cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert out.columns == docs.columns and out.filter("_key <> 'own' or kept <> 7 or spans <> 1.5").isEmpty()
        docs = out
        if name == "near_dedup":
            found = ids(out.filter("doc_id is not null"))
            assert len(found) == len(set(found)) and out.filter("text is null").isEmpty() and out.filter("doc_id is null").count() <= 1
