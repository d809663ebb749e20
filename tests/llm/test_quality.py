import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillstat.llm.quality import accuracies, fit_votes, judge, keep_good, votes

SCHEMA = "doc_id bigint, text string, kept string, n_words string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times, hit = Counter(windows), set()
    for k, w in enumerate(windows):
        if times[w] > 1:
            hit.update(range(k, k + 5))
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


EDGES = [
    None, "", " \n\t", "one", "a b c d e a b c d e", "a b c d e f a b c d", "x\n\nx\n x\nx", "é日本 ü", "a\x0bb\x0cc\rd", "line\nline\n\nline", "# * $ % & | < > @",
    "word " * 6000, "\n", "x\n", "nbsp\u00a0joined\u2003here", " ".join(f"w{k}" for k in range(40)) + ".", " ".join(f"w{k}" for k in range(40)) + ".",
]


def test_counts_on_edges(spark):
    df = spark.createDataFrame([(k, t, "theirs", "theirs", "s") for k, t in enumerate(EDGES)], SCHEMA)
    got = {r["doc_id"]: r for r in judge(df).collect()}
    for k, t in enumerate(EDGES):
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(t), t
        assert not (r["base_failed"] and r["kept"])
        assert r["source"] == "s"


def test_whole_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in judge(docs, keep=["doc_id"]).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(texts[r["doc_id"]])


def test_verdicts_follow_the_quality_labels(spark):
    d = "/root/testdata/sf0.01"
    kept = {r["doc_id"]: r["kept"] for r in judge(spark.read.parquet(f"{d}/documents.parquet"), keep=["doc_id"]).collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    good = [kept[r["doc_id"]] for r in labels if r["quality"] == 1]
    bad = [kept[r["doc_id"]] for r in labels if r["quality"] == 0]
    assert np.mean(good) >= 0.9 and np.mean(bad) <= 0.05


def test_expectation_maximisation_finds_how_good_rules_are():
    """Votes drawn from known accuracies, one rule no better than a coin: the estimates come near them."""
    rng = np.random.default_rng(4)
    good = rng.random(20_000) < 0.8
    accuracy = np.array([0.95, 0.9, 0.92, 0.85, 0.55])
    right = rng.random((20_000, 5)) < accuracy
    drawn = np.where(right, np.where(good, 1, -1)[:, None], np.where(good, -1, 1)[:, None])
    drawn[rng.random(drawn.shape) < 0.1] = 0
    weights, table = fit_votes(sorted(Counter(map(tuple, drawn.tolist())).items()))
    assert table.shape == (2, 5, 3) and np.allclose(np.exp(table).sum(2), 1) and np.isclose(np.exp(weights).sum(), 1)
    assert np.allclose(accuracies(weights, table), accuracy, atol=0.03) and np.isclose(np.exp(weights[0]), 0.8, atol=0.03)


def test_a_weak_rule_is_outvoted(spark):
    """Short documents are rejected by one rule and carried by the others; junk that two rules see still goes."""
    line = lambda k, n: " ".join(f"word{k}x{j}" for j in range(n)) + "."
    rows = [(k, line(k, 120), "", "", "s") for k in range(300)]
    rows += [(1000 + k, line(k, 30), "", "", "s") for k in range(20)]
    rows += [(2000 + k, " ".join(f"w{k}%%{j}$$" for j in range(120)) + ".", "", "", "s") for k in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = judge(df)
    assert got.filter("kept").count() == 320 and got.filter("kept and doc_id >= 2000").isEmpty()
    assert got.filter((F.col("doc_id") >= 1000) & (F.col("doc_id") < 2000)).select(votes()["length"].alias("v")).distinct().collect() == [(-1,)]


def test_verdicts_change_towards_the_labels(spark):
    """Against the rule that all votes must pass: more than 0.5 % of all verdicts change, and the labels are with them."""
    d = "/root/testdata/sf0.1"
    must_pass = F.lit(True)
    for v in votes().values():
        must_pass = must_pass & (v != -1)
    got = judge(spark.read.parquet(f"{d}/documents.parquet"), keep=["doc_id"]).withColumn("strict", must_pass & ~F.col("base_failed"))
    changed = got.filter("kept <> strict").drop("quality").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "left").select("kept", "quality").collect()
    assert len(changed) >= 0.005 * 10_000
    known = [r["kept"] == (r["quality"] == 1) for r in changed if r["quality"] is not None]
    assert np.mean(known) >= 0.9


def test_stage_keeps_columns_and_empty_table(spark):
    df = spark.createDataFrame([(k, t, "theirs", "theirs", "s") for k, t in enumerate(EDGES)], SCHEMA)
    out = keep_good(spark, df, "")
    assert out.columns == df.columns
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in judge(df).filter("kept").collect()}
    assert keep_good(spark, spark.createDataFrame([], SCHEMA), "").collect() == []
    assert judge(spark.createDataFrame([], SCHEMA)).collect() == []
