import random

import pytest

from quillstat.llm.token_count import MARK, Unigram, count_tokens, model

SCHEMA = "doc_id bigint, text string, score string"


def brute(own, pieces, text, unknown_score):
    """The textbook dynamic programme over all starts, then all pieces that begin there."""
    n = len(text)
    best, count, run = [None] * (n + 1), [0] * (n + 1), [False] * (n + 1)
    best[0] = 0.0
    for s in range(n):
        single = False
        for e in range(s + 1, n + 1):
            gain = pieces.get(text[s:e])
            if gain is None:
                continue
            single |= e == s + 1
            if best[e] is None or best[s] + gain > best[e]:
                best[e], count[e], run[e] = best[s] + gain, count[s] + 1, False
        if not single and (best[s + 1] is None or best[s] + unknown_score > best[s + 1]):
            best[s + 1], run[s + 1] = best[s] + unknown_score, True
            count[s + 1] = count[s] + (len(text[s].encode()) if own.byte_fallback else not run[s])
    return count[n], best[n]


@pytest.mark.parametrize("fallback", [True, False])
def test_against_brute_force_with_ties(fallback):
    draw = random.Random(3)
    for _ in range(60):
        pieces = {"".join(draw.choices("abc", k=draw.randint(1, 4))): -float(draw.randint(1, 4)) for _ in range(12)}
        own = Unigram([("<unk>", 0.0), *pieces.items()], 0, fallback)
        text = "".join(draw.choices("abcdé", k=30))
        assert own.word(text) == pytest.approx(brute(own, pieces, text, own.unknown_score))


def test_against_the_tokenizers_library():
    from tokenizers import Tokenizer, models

    draw = random.Random(9)
    for _ in range(40):
        pieces = [("<unk>", 0.0)] + [(p, -draw.random() * 5) for p in {"".join(draw.choices("abcd", k=draw.randint(1, 4))) for _ in range(25)} | set("abcd")]
        theirs = Tokenizer(models.Unigram(pieces, unk_id=0))
        own = Unigram(pieces, 0, byte_fallback=False)
        text = "".join(draw.choices("abcd", k=60))
        assert own.word(text)[0] == len(theirs.encode(text, add_special_tokens=False).ids)


def test_whole_documents_and_edges(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    own = model(path)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = [*docs, (-1, None), (-2, ""), (-3, "  "), (-4, "日本 🙂"), (-5, "x" * 4000)]
    made = count_tokens(spark.createDataFrame([(i, t, "theirs") for i, t in rows], SCHEMA), path)
    assert made.columns == ["doc_id", "n_tokens", "score"]
    got = {r["doc_id"]: (r["n_tokens"], r["score"]) for r in made.collect()}
    assert got[-1] == got[-2] == (0, 0.0)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(k): sp.get_score(k) for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_byte(k) or k == sp.unk_id())}
    for i, t in rows[-5:] + docs[:25]:
        if t:
            words = (MARK + t.replace(" ", MARK)).split(MARK)[1:]
            want = [_word(own, pieces, MARK + w) for w in words]
            assert got[i] == pytest.approx((sum(w[0] for w in want), sum(w[1] for w in want))), t[:60]
    assert count_tokens(spark.createDataFrame([], SCHEMA), path).collect() == []


_memory = {}


def _word(own, pieces, word):
    if word not in _memory:
        n, longest = len(word), 20
        near = {word[s:e]: pieces[word[s:e]] for s in range(n) for e in range(s + 1, min(n, s + longest) + 1) if word[s:e] in pieces}
        _memory[word] = brute(own, near, word, own.unknown_score) if n < 300 else own.word(word)
    return _memory[word]
