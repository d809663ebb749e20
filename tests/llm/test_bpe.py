import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from quillstat.llm.bpe import decode, digests, encode, public_vocabulary, round_trip, tokenizer

SCHEMA = "doc_id bigint, text string, ids string, extra int"
TEXTS = [
    None, "", " ", "   ", "\n\n x\t y ", "hello world", "don't we'll I'm  they've", "a" * 5000, " " * 3000 + "x", "日本語のテキスト", "naïve café ÀÉ", "🙂🙃" * 40,
    "12345 6789.10", "<|endoftext|> text", "\u200b\ufeff\u00a0nb\u2003sp", "x\u0085y\u2028z", "\x00\x1c\x1d\x1e\x1f mid", "zzz" * 300 + "!?" * 400, "mixed日本12ab!!", "'s't're", "hello world",
]


@pytest.fixture(scope="module")
def reference():
    path, pattern = public_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library_on_edges_and_noise(reference):
    own = tokenizer(*public_vocabulary())
    draw = random.Random(5)
    pools = ["ab c", "éß日本 \n\t", " \u00a0\u2003\u0085x\u3000", "0123 .,-'st", "".join(map(chr, range(1, 256)))]
    texts = [t or "" for t in TEXTS] + ["".join(draw.choices(draw.choice(pools), k=draw.randint(0, 400))) for _ in range(300)]
    ids, at = own.encode(texts)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == reference.encode_ordinary(t), t[:80]
    raw, ends = own.decode(ids, at)
    assert [raw[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [t.encode() for t in texts]


def test_whole_documents(spark, sf_dir, reference):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: tuple(r)[1:] for r in digests(round_trip(docs, *public_vocabulary())).collect()}
    for r in docs.collect():
        ids = reference.encode_ordinary(r["text"] or "")
        want = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()
        assert got[r["doc_id"]] == want


def test_columns_nulls_and_round_trip(spark):
    df = spark.createDataFrame([(k, t, "theirs", 1) for k, t in enumerate(TEXTS)], SCHEMA)
    made = encode(df, *public_vocabulary())
    assert made.columns == ["doc_id", "extra", "ids"]
    back = decode(made, *public_vocabulary())
    assert back.columns == ["doc_id", "extra", "decoded"]
    assert {r["doc_id"]: bytes(r["decoded"]) for r in back.collect()} == {k: (t or "").encode() for k, t in enumerate(TEXTS)}
    none = spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")
    assert bytes(decode(none, *public_vocabulary()).first()["decoded"]) == b""
    assert encode(spark.createDataFrame([], SCHEMA), *public_vocabulary()).collect() == []


def test_long_piece_and_matrix_agree():
    own = tokenizer(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    draw = random.Random(1)
    for alphabet in ("ab", "the ", "aaaaaab"):
        piece = "".join(draw.choices(alphabet, k=200)).encode()
        assert own.merge_long(piece).tolist() == own.merge_matrix([piece])[0].tolist()
