import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillstat.llm import align
from quillstat.llm.align import align_corpus, aligned, byte_of_char, expand_groups, op12_align, parts_of

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, pairs string, source string"


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), byte_of_char()


def brute(text, both):
    """(a ids, b ids, groups, links) by the libraries on the whole text and plain loops."""
    if not text:
        return [], [], [], []
    a, b, table = both
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    parts_a = [bytes(table[c] for c in a.id_to_token(k)) for k in ids_a]
    parts_b = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k in ids_b for p in [b.id_to_piece(k)]]
    if not b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
        return [], [], [], []

    def spans(parts):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    span_a, span_b = spans(parts_a), spans(parts_b)
    shared = sorted({e for _, e in span_a} & {e for _, e in span_b})
    groups, low = [], 0
    for cut in shared:
        groups.append(([i for i, (_, e) in zip(ids_a, span_a, strict=True) if low < e <= cut], [i for i, (_, e) in zip(ids_b, span_b, strict=True) if low < e <= cut]))
        low = cut
    links = [(x, y) for x, (s, e) in zip(ids_a, span_a, strict=True) for y, (f, g) in zip(ids_b, span_b, strict=True) if s < g and f < e]
    return ids_a, ids_b, groups, links


def expected(rows, both):
    held, found = Counter(), {}
    for k, (_, text, *_) in enumerate(rows):
        found[k] = brute(text, both)
        held.update(set(found[k][3]))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for k, (doc, *_) in enumerate(rows):
        ids_a, ids_b, groups, links = found[k]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc, len(ids_a), len(ids_b), len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "\n a", "a\n b\n\n c", "tab\there", "the quick brown fox", "<|endoftext|> and <s> or </s> <unk> <0x0A>", "▁ mark ▁", "naïve café 日本語 😀👍🏽", "x y z", "a\x1c b", "\x1c\x1d  q", "\u0000 nul", "é é",
    "don't  can't   won't", "   lead and trail   ", "1234567890 12 3", "### --- ***", "word " * 3000, "z" * 5000, "ﬁ ligature Ａ full", "\r\n\r\n  x\r\n", "the quick brown fox", "﻿bom", "soft­hyphen zero​width",
]
ROWS = [(k if k % 7 else None, t, "own", "s") for k, t in enumerate(TEXTS)] + [(3, "the", "own", "s")] * 3


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_edges_against_loops(spark, both, monkeypatch):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    want = expected([r for r in ROWS if r[1] is None or len(r[1]) < 6000], both)
    short = docs.filter("text is null or length(text) < 6000")
    assert got(align_corpus(short, A, B)) == want
    for most in (0, 1, 40):  # counts that are joined by a shuffle
        assert got(align_corpus(short, A, B, most=most)) == want
    assert align_corpus(docs, A, B).columns == ["doc_id", "source", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


def test_long_texts(spark, both):
    long = "word " * 3000
    row = align_corpus(spark.createDataFrame([(1, long, "", "")], SCHEMA), A, B).first()
    a, b, _ = both
    assert (row["n_a"], row["n_b"]) == (len(a.encode(" " + long).ids), len(b.encode(long)))


def test_parts_join_to_the_text():
    for t in TEXTS:
        if t:
            assert "".join(" " + p for p in parts_of(t)) == " " + t


def test_forgetting_changes_nothing(spark, both, monkeypatch):
    pair = align.Pair(A, B)
    texts = [t for t in TEXTS if t and len(t) < 6000]
    one = pair.documents(texts)
    monkeypatch.setattr(align, "CACHE_CHARS", 10)
    for t, figures, groups in zip(texts, one["figures"].tolist(), one["groups"], strict=True):
        again = pair.documents([t])
        assert again["figures"].tolist()[0] == figures and again["groups"][0] == groups


def test_whole_documents(spark, sf_dir, both):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r["text"] or "") < 3000]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(align_corpus(docs, A, B)) == expected(rows, both)
    assert op12_align(spark, sf_dir).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_group_products(spark, both):
    docs = spark.createDataFrame([(1, "unbelievable stories", "", ""), (2, None, "", "")], SCHEMA)
    found = sorted((r["nth_group"], r["a_id"], r["b_id"]) for r in expand_groups(aligned(docs, A, B, groups=True)).collect())
    _, _, groups, _ = brute("unbelievable stories", both)
    assert found == sorted((k, x, y) for k, (xs, ys) in enumerate(groups) for x in xs for y in ys)


def test_empty(spark):
    assert align_corpus(spark.createDataFrame([], SCHEMA), A, B).collect() == []
