import random

import numpy as np

from quillstat.llm import decontaminate as D

DOCS, ITEMS = "doc_id bigint, text string, item_id string", "item_id bigint, text string, extra int"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for k, y in enumerate(b):
            row[k + 1] = before[k] + 1 if x == y else max(row[k], before[k + 1])
    return row[-1]


def test_lcs_against_the_textbook():
    draw = random.Random(6)
    for _ in range(200):
        a, b = (np.array([draw.randrange(6) for _ in range(draw.randint(1, 40))], np.uint64) for _ in range(2))
        hit = D.lcs_hits(a, b)
        assert hit.sum() == lcs(a.tolist(), b.tolist())
        picked, at = a[hit].tolist(), 0
        for x in b.tolist():  # what is marked is a subsequence of both
            at += at < len(picked) and picked[at] == x
        assert at == len(picked)


def corpus(draw, n_docs=300, n_items=30):
    words = [f"w{k}" for k in range(4000)]
    common = [f"the{k}" for k in range(40)]
    say = lambda n: [draw.choice(common) if draw.random() < 0.4 else draw.choice(words) for _ in range(n)]
    items = [say(draw.randint(12, 60)) for _ in range(n_items)]
    docs, truth = [], set()
    for i in range(n_docs):
        text = say(draw.randint(5, 400))
        if i % 5 == 0:
            k = draw.randrange(n_items)
            leak = list(items[k])
            if i % 10 == 0:  # a paraphrase: some words of the first part go, others come in between
                for _ in range(len(leak) // 6):
                    leak.insert(draw.randrange(len(leak)), "and")
                    leak[draw.randrange(len(leak) // 2)] = draw.choice(words)
            at = draw.randrange(len(text) + 1)
            text[at:at] = leak
            truth.add((i, k))
        docs.append((i, " ".join(text)))
    return docs, [(k, " ".join(x)) for k, x in enumerate(items)], truth


def test_planted_leaks_and_clean_documents(spark):
    docs, items, truth = corpus(random.Random(12))
    df = spark.createDataFrame([(i, t, "own") for i, t in docs], DOCS)
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(df, spark.createDataFrame([(*x, 1) for x in items], ITEMS)).collect()}
    assert len(got & truth) >= 0.95 * len(truth)
    assert not got - truth


def test_whole_passages_in_the_small_table(spark):
    d = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in D.op2_decontaminate(spark, d).collect()}
    joined = lambda t: f" {' '.join((t or '').lower().split())} "
    table = [(k, joined(t)) for k, t in items]
    want = {(i, k) for i, text in ((i, joined(t)) for i, t in docs) for k, item in table if item in text}
    assert want and len(got & want) >= 0.9 * len(want)


def test_against_all_pairs(spark):
    """Every passage of every document against every item by the textbook rule, without the latent space."""
    import pyarrow as pa

    d = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = D.item_table([tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()])
    want = set()
    for doc, text in docs:
        raw, offsets = D.utf8_parts(pa.array([text or ""]))
        h = D.Words(raw, offsets, 0, 1, lower=True).hash
        for number, words, _ in items:
            if np.isin(words, h).sum() < D.NEAR * len(words):
                continue
            for first in D.passage_starts(len(h)):
                part = h[max(0, first - len(words)) : first + D.WINDOW + len(words)]
                if np.isin(words, part).sum() < D.NEAR * len(words):
                    continue
                hit = D.lcs_hits(words, part)
                if hit.mean() >= D.MATCH or (hit.mean() >= D.NEAR and hit[-max(3, len(words) // 4) :].mean() >= D.ANSWER):
                    want.add((doc, number))
                    break
    got = {(r["doc_id"], r["item_id"]) for r in D.op2_decontaminate(spark, d).collect()}
    assert want and not got - want and len(got) >= 0.9 * len(want)


def test_short_items_are_found_unbroken(spark):
    docs = spark.createDataFrame([(1, "so What  is the\nanswer here", "o"), (2, "what is then the answer", "o"), (3, "intro\nForty two\nend", "o"), (4, "forty two", "o"), (5, "about forty two things", "o"), (6, "what is the answer", "o")], DOCS)
    items = spark.createDataFrame([(10, "What is the answer", 1), (11, "forty two", 1), (12, "end", 1)], ITEMS)
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(docs, items).collect()}
    assert got == {(1, 10), (6, 10), (3, 11), (4, 11), (3, 12)}


def test_products_against_the_whole_matrix():
    import pyarrow as pa

    draw = random.Random(3)
    texts = ["", "one", *(" ".join(f"w{draw.randrange(50)}" for _ in range(n)) for n in (5, 16, 17, 32, 33, 48, 49, 100))]
    raw, offsets = D.utf8_parts(pa.array(texts))
    w = D.Words(raw, offsets, 0, len(texts), lower=True)
    rng = np.random.default_rng(1)
    idf, q = rng.random(D.FEATURES) + 0.5, rng.standard_normal((D.FEATURES, 4))
    total, want = np.zeros(q.shape), np.zeros(q.shape)
    D._passage_products(w, (idf[:, None] * q).astype(np.float32), idf, total)
    feature = D._features(w)
    for d in range(len(texts)):
        own = feature[w.doc == d]
        for at in D.passage_starts(len(own)) if len(own) else []:
            part = own[at : at + D.WINDOW]
            row = np.bincount(part, minlength=D.FEATURES) * idf
            row /= np.sqrt((idf[part] ** 2).sum())
            want += row[:, None] * (row @ q)
    assert np.allclose(total * idf[:, None], want, atol=1e-4)


def test_edges(spark):
    item = " ".join(f"q{k}" for k in range(20))
    docs = spark.createDataFrame([(1, None, "o"), (2, "", "o"), (3, " ", "o"), (4, f"x {item} y", "o"), (4, f"x {item} y", "o"), (5, "z " * 30_000 + item, "o"), (6, "q0", "o")], DOCS)
    items = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, "", 1), (10, "too short", 1), (None, item, 1)], ITEMS)
    got = sorted((r["doc_id"], r["item_id"], r["first_word"]) for r in D.leaks(docs, items).collect())
    assert [x[:2] for x in got] == [(4, 7), (4, 7), (5, 7)]
    none = spark.createDataFrame([], ITEMS)
    assert D.leaks(docs, none).collect() == [] and D.leaks(docs.limit(0), items).collect() == []
    kept = D.semi_by_id(docs, D.leaks(docs, items).select("doc_id").distinct(), "doc_id", "left_anti")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 6]


def test_passages_cover_every_word_and_sums_are_right():
    import pyarrow as pa

    raw, offsets = D.utf8_parts(pa.array(["a b", "", " ".join(f"w{k}" for k in range(75)), " ".join(["x"] * 33)]))
    w = D.Words(raw, offsets, 0, 4, lower=True)
    table = np.random.default_rng(1).standard_normal((D.FEATURES, 5)).astype(np.float32)
    vectors, doc, first = D._block_sums(w, table)
    assert (first - w.first_word[doc]).tolist() == [0, 0, 16, 32, 48, 0, 16]
    feature = D._features(w)
    for v, d, at in zip(vectors, doc, first, strict=True):
        end = min(at + D.WINDOW, w.first_word[d + 1])
        assert np.allclose(v, table[feature[at:end]].sum(0), atol=1e-4)


def test_directions_come_from_all_documents(spark):
    rows = [(k, " ".join(f"own{k}x{j}" for j in range(3)) if k < 400 else f"common{k % 50} words{k % 70}", "en", 1) for k in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n int")
    seen, n = D.document_frequencies(docs)
    assert n == 9000
    idf = np.log((n + 1) / (seen + 1)) + 0.05
    weight = np.abs(D.fit_directions(docs, idf)).max(1)
    assert (weight[seen > 0] > 0).all() and (weight[seen == 0] < 1e-9).all()
