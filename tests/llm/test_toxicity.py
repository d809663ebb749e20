import zlib

import numpy as np
import pytest

import zstandard

from quillstat.llm import toxicity
from quillstat.llm.toxicity import calibrated, dictionaries, document_inputs, fit_logistic, likelihoods, op1_toxicity, saving_counts, score, text_windows, window_savings

DOCS, LABELS = "doc_id bigint, text string, score string", "doc_id bigint, toxic int, quality int"


@pytest.fixture(scope="module")
def scored(spark):
    return op1_toxicity(spark, "/root/testdata/sf0.01").collect()


def test_rows_and_ranges(spark, scored):
    ids = sorted(r["doc_id"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect())
    assert sorted(r["doc_id"] for r in scored) == ids
    for r in scored:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_held_out_accuracy(spark, scored):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r["score"], labels[r["doc_id"]]) for r in scored if r["held_out"] and labels.get(r["doc_id"]) is not None]
    s, y = np.array(held).T
    auc = np.mean([(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]])
    assert auc >= 0.85  # 30 toxic texts are learned from
    assert np.mean((s >= 0.7) == (y == 1)) >= 0.9


def test_held_out_accuracy_on_more_labels(spark):
    """A tenth of the toxic labels are on texts without any toxic wording."""
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [(r["score"], labels[r["doc_id"]]) for r in op1_toxicity(spark, "/root/testdata/sf0.1").collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    s, y = np.array(held).T
    assert np.mean(s[y == 1] >= 0.7) >= 0.87 and np.mean(s[y == 0] < 0.7) >= 0.95


def toy_pair():
    rng = np.random.default_rng(5)
    words = [b"".join(rng.choice([b"ka", b"lo", b"mi", b"su", b"ren", b"ta"], 3)) for _ in range(400)]
    toxic = [b"\nvile" + w + b" \nhateful " for w in words]
    calm = [b"\n" + words[k] + b" \n" + words[-k] + b" " for k in range(400)]
    return dictionaries(toxic, calm, calm)


def test_windows_hold_every_word_once():
    text = "One  two\tTHREE\nfour five \u00c9t\u00e9 seven".encode()
    assert text_windows(text) == [b"\none \ntwo \nthree \nfour ", "\nfive \n\u00c9t\u00e9 \nseven ".encode()]
    assert text_windows(b"") == text_windows(b" \n\t") == []


def test_savings_are_differences_of_compressed_lengths():
    pair = toy_pair()
    windows = text_windows(b"a hateful thing vilekalomi and then kalomi sure enough hateful " + b"x" * 5000)
    got = window_savings(windows, *pair)

    def size(content, window):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=toxicity.LEVEL)
        c = zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False)
        return len(c.compress(toxicity.OPENING + window + toxicity.CLOSING))

    assert got.tolist() == [size(pair[1], w) - size(pair[0], w) for w in windows]
    assert got[0] > 0 and saving_counts(b"a hateful thing", *pair).sum() == 1


def test_inputs_against_plain_loops():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 4, (50, toxicity.MOST_SAVED - toxicity.LEAST_SAVED + 1))
    counts[0] = 0
    toxic = rng.integers(0, 2, 50)
    ratio = likelihoods(counts, toxic)
    got = document_inputs(counts, ratio)
    assert (got[0] == 0).all()
    for row, inputs in zip(counts[1:], got[1:], strict=True):
        saved = sorted((k + toxicity.LEAST_SAVED for k, n in enumerate(row) for _ in range(n)), reverse=True)
        ratios = sorted((ratio[s - toxicity.LEAST_SAVED] for s in saved), reverse=True)
        total, n = sum(ratios), len(saved)
        three, five = sum(s >= 3 for s in saved), sum(s >= 5 for s in saved)
        want = [np.sign(total) * np.log1p(abs(total)), total / n**0.5, saved[0] / 8, np.mean(saved[:3]) / 8, np.log1p(three), np.log1p(five), min(3, 10 * three / n), min(5, np.mean(ratios[:5])), np.log(n) / 5]
        assert np.allclose(inputs, want)


def test_threshold_against_every_cut():
    rng = np.random.default_rng(2)
    toxic = rng.integers(0, 2, 300).astype(float)
    odds = np.round(rng.normal(size=300) + toxic, 1)

    def gain(t):
        return (odds[toxic == 1] >= t).mean() - toxicity.ALARM_COST * (odds[toxic == 0] >= t).mean()

    assert gain(calibrated(odds, toxic)) == pytest.approx(max(gain(t) for t in np.unique(odds)))


def test_labels_of_the_held_out_fold_change_nothing(spark):
    rows = [(k, f"{'awful hateword' if k % 2 else 'good kindword'} common text number {k % 7}") for k in range(240)]
    docs = spark.createDataFrame([(i, t, "own") for i, t in rows], DOCS)
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    one = spark.createDataFrame([(i, i % 2, 1) for i, _ in rows], LABELS)
    two = spark.createDataFrame([(i, 1 - i % 2 if held(i) else i % 2, 1) for i, _ in rows], LABELS)
    a, b = ({r["doc_id"]: r["score"] for r in score(docs, x).collect()} for x in (one, two))
    assert a == b
    assert min(a[i] for i, _ in rows if i % 2) > max(a[i] for i, _ in rows if not i % 2)


def test_edges(spark):
    rows = [(k, "awful hateword here" if k % 2 else "good kindword here") for k in range(90)] + [(1000, None), (1001, ""), (1002, "x" * 100_000), (1003, None), (None, "awful")]
    docs = spark.createDataFrame([(i, t, "own") for i, t in rows], DOCS)
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(90)] + [(None, 1, 1), (3, None, 1), (1000, 0, 1)], LABELS)
    got = {r["doc_id"]: r for r in score(docs, labels).collect()}
    assert len(got) == 95 and got[1000]["score"] == got[1001]["score"] == got[1003]["score"]
    assert got[None]["held_out"] is False
    none = score(docs, spark.createDataFrame([], LABELS)).collect()
    assert len(none) == 95 and all(r["score"] == 0 for r in none)
    assert score(spark.createDataFrame([], DOCS), labels).collect() == []


def test_logistic_fit():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))).astype(float)
    w = fit_logistic(x, y, ridge=1e-6)
    assert np.allclose(w, [2, 0, -1], atol=0.2)
