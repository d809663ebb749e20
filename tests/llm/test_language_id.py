import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from quillstat.llm import language_id
from quillstat.llm.language_id import BUCKETS, classify, learn, ngram_counts, op11_language_id, spherical_kmeans, weighed

SCHEMA = "doc_id bigint, text string, lang string, score string"
EN = ["the cat and the dog went there with them", "this is the way that they thought of it", "there was another thing with the others"]
DE = ["der hund und die katze gehen nicht über", "das ist die straße für ältere menschen", "ich möchte gern ein stück kuchen und schön"]


def brute_grams(text):
    """N-grams of one to three bytes over letters and single places beside words."""
    folded = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in (" " + text.lower() + " ").encode())
    out = Counter()
    for n in (1, 2, 3):
        for k in range(len(folded) - n + 1):
            g = folded[k : k + n]
            if g.strip() and b" " not in g[1:-1]:
                out[g] += 1
    return out


def bucket(gram):
    key = 0
    for b in gram:
        key = (key * 257 + b + 1) % 2**32
    return (((key ^ (key >> 15)) * 0x9E3779B1) % 2**32) >> 19


TEXTS = ["", "A", "the cat", None, "  x  y ", "Ünder größe\nÑandú", "12 34 -- ab1cd", "日本語 text", "a" * 40_000, "\t\n", "the cat"]


def test_counts_against_loops(monkeypatch):
    for texts_at_once in (256, 2, 1):
        monkeypatch.setattr(language_id, "CHUNK_TEXTS", texts_at_once)
        seen = []
        for i, j, counts in ngram_counts(pa.array(TEXTS, pa.string())):
            for k in range(i, j):
                want = np.zeros(BUCKETS, np.int64)
                for gram, n in brute_grams(TEXTS[k] or "").items():
                    want[bucket(gram)] += n
                assert (counts[k - i] == want).all(), TEXTS[k]
                seen.append(k)
        assert seen == list(range(len(TEXTS)))


def test_vectors_and_nearest_against_loops(spark):
    rows = [(k, t, lang, "own") for k, (t, lang) in enumerate([(t, "en") for t in EN] + [(t, "de") for t in DE])]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = learn(docs)
    df = Counter()
    for _, t, *_ in rows:
        df.update({bucket(g) for g in brute_grams(t)})
    for b in range(BUCKETS):
        assert model.idf[b] == (pytest.approx(math.log((1 + len(rows)) / (1 + df[b])) + 1, rel=1e-6) if df[b] else 0)

    def vector(text):
        counts = Counter()
        for g, n in brute_grams(text).items():
            counts[bucket(g)] += n
        v = {b: (1 + math.log(n)) * float(model.idf[b]) for b, n in counts.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {b: x / size for b, x in v.items()} if size else v

    asked = ["they went the other way", "die katze ist schön", "über the straße"]
    got = {r["doc_id"]: r for r in classify(spark.createDataFrame([(k, t, None, None) for k, t in enumerate(asked)], SCHEMA), model).collect()}
    for k, t in enumerate(asked):
        cosines = [sum(x * float(c[b]) for b, x in vector(t).items()) for c in model.vectors]
        assert got[k]["lang_pred"] == model.languages[int(np.argmax(cosines))] and got[k]["score"] == pytest.approx(max(cosines), abs=2e-5)
    assert [got[k]["lang_pred"] for k in (0, 1)] == ["en", "de"]


def test_edges(spark):
    learned = [(k, t, lang, None) for k, (t, lang) in enumerate([(t, "en") for t in EN] * 2 + [(t, "de") for t in DE])]
    unlearned = [(None, EN[0], "fr", None), (50, EN[1], None, None), (51, None, "es", None), (52, "12 34", "es", None)]
    model = learn(spark.createDataFrame(learned + unlearned, SCHEMA))
    assert set(model.languages) == {"en", "de"}
    asked = [(1, None, "x", "own"), (2, "", "x", "own"), (3, "12 # 34", "x", "own"), (4, "ъщ", "x", "own"), (5, EN[0], "x", "own"), (5, EN[0], "x", "own"), (None, "und die straße " * 20_000, "x", "own")]
    got = [(r["doc_id"], r["lang_pred"], r["score"], r["rejected"], r["lang"]) for r in classify(spark.createDataFrame(asked, SCHEMA), model).collect()]
    assert len(got) == len(asked)
    for doc, lang, score, rejected, own in got:
        assert own == "x" and 0 <= score <= 1
        if doc in (1, 2, 3):
            assert (lang, score, rejected) == ("und", 0, True)
        if doc == 4:
            assert lang == "de" and rejected
        if doc == 5:
            assert lang == "en" and not rejected
        if doc is None:
            assert lang == "de"
    strict = {r["doc_id"]: r["lang_pred"] for r in classify(spark.createDataFrame(asked, SCHEMA), model, reject=True).collect()}
    assert strict[4] == "und" and strict[5] == "en"


def test_nothing_to_learn_from_and_empty(spark):
    model = learn(spark.createDataFrame([], SCHEMA))
    assert model.languages == []
    assert [tuple(r)[-3:] for r in classify(spark.createDataFrame([(1, EN[0], "en", None)], SCHEMA), model).collect()] == [("und", 0.0, True)]
    assert classify(spark.createDataFrame([], SCHEMA), learn(spark.createDataFrame([(1, EN[0], "en", None)], SCHEMA))).collect() == []


def test_clusters():
    rng = np.random.default_rng(5)
    x = np.concatenate([np.eye(3, 20)[k] + 0.05 * rng.random((30, 20)) for k in range(3)]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    centres, owner = spherical_kmeans(x, 3)
    assert len({tuple(owner[30 * k : 30 * k + 30]) for k in range(3)}) == 3 and all(len(set(owner[30 * k : 30 * k + 30])) == 1 for k in range(3))
    assert np.allclose(np.linalg.norm(centres, axis=1), 1)
    assert len(spherical_kmeans(np.ones((5, 4), np.float32) / 2, 4)[0]) == 1


def test_the_sample_is_bounded_and_hot_rows_count_once(spark):
    rows = [(1, EN[0], "en", None)] * 500 + [(k, f"{EN[k % 3]} {k}", "en", None) for k in range(2, 400)] + [(1000 + k, t, "de", None) for k, t in enumerate(DE)]
    got = language_id.sampled(spark.createDataFrame(rows, SCHEMA), "lang", "text", 8, 4).collect()
    n = Counter(r["lang"] for r in got)
    assert n["en"] == 32 and n["de"] == 3 and len({(r["lang"], r["h"]) for r in got}) == len(got)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = op11_language_id(spark, d).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert len(got) == len(docs)
    right = []
    for r in got:
        assert r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["held_out"] and re.search(r"[^\W\d_]", docs[r["doc_id"]]["text"] or ""):
            right.append(r["lang_pred"] == docs[r["doc_id"]]["lang"])
    assert np.mean(right) >= 0.97
    assert np.mean([r["rejected"] for r in got]) < 0.05
    assert weighed(np.zeros((1, BUCKETS), np.int64), np.ones(BUCKETS, np.float32)).sum() == 0
