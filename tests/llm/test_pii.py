import itertools
import random
import re

import numpy as np
import pyarrow as pa

from quillstat.llm.common import utf8_parts
from quillstat.llm.pii import KINDS, PATTERNS, TAGS, Crf, base_spans, chunk_spans, find_pii, labelled_lines, luhn, masked, redact, train, word_features, written_line

SCHEMA = "doc_id bigint, text string, spans string, n_chars bigint"


def brute(text):
    out = []
    for kind, m in ((k, m) for k in range(4) for m in PATTERNS[KINDS[k]].finditer(text)):
        digits = re.sub("[^0-9]", "", m[0])
        if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
            continue
        if kind == 2:
            total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(digits[::-1]))
            if not 12 <= len(digits) <= 19 or total % 10:
                continue
        if kind == 3 and not 9 <= len(digits) <= 15:
            continue
        out.append((m.start(), kind, m.end()))
    return sorted(out)


EDGES = [
    "", "a@b.c", "x a.b+c@d-e.fr, y", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.0255", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+44 20 7946 0018 +1 (974) 555-3436 +12", "é 日本 a@b.co 🙂 1.1.1.1",
    "4111111111111111 4111111111111111", "+4111111111111111 1.2.3.4@x.y", "a@b a@.c a@b..c", "٣.1.2.3 +٣12345678901", "0" * 5000,
]


def test_base_spans():
    draw = random.Random(2)
    noise = ["".join(draw.choices("0123456789.+-@ ()ab", k=200)) for _ in range(200)]
    for t in EDGES + noise:
        assert base_spans(t) == brute(t), t
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_viterbi_is_the_best_path():
    model = Crf(*train())
    tags, moves = len(TAGS), model.moves
    lines = [["call", "(212)", "555-0187", "now"], ["kim", "at"], ["x"], ["to", "jane", "(at)", "mail"], ["jane", "at", "mail", "dot"], ["at", "mail.com", "at", "last"], ["bo(at)q(dot)de", "or", "12", "or"], ["kim", "at", "mail.com", "dot"]]
    kind = np.array([model.kind_of(w) for line in lines for w in line])
    length = np.array([len(x) for x in lines])
    start = np.cumsum(length) - length
    line = np.repeat(np.arange(len(lines)), length)
    got, scores = model.decode(kind, start, length), model.emissions(np.arange(len(kind)), kind, line)
    scores[start] += model.no_start
    scores[start + length - 1] += model.no_end
    for s, n in zip(start, length, strict=True):
        best = max(itertools.product(range(tags), repeat=int(n)), key=lambda p: sum(scores[s + k, t] for k, t in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p)))
        assert tuple(got[s : s + n]) == best


def test_written_out_addresses_of_held_out_lines():
    """Lines drawn anew, other wordings than any in the table, and prose: addresses are found, and nothing in the prose."""
    model, draw, found = Crf(*train()), random.Random(99), 0
    lines = [written_line(draw) for _ in range(300)]
    for words, tags in labelled_lines("\n".join(lines)):
        text, own = " ".join(words), [k for k, t in enumerate(tags) if t]
        start = len(" ".join(words[: own[0]])) + (own[0] > 0)
        end = start + len(" ".join(words[own[0] : own[-1] + 1]).rstrip(".,;:!?"))
        found += any((s, k, e) == (start, 0, end) for s, k, e, _ in spans_of(model, [text])[0])
    assert found / 300 >= 0.9
    fresh = ["ping bob [at] corp [dot] io now", "her box: jane at posta point fr", "tim @ acme dot com", "ask lee(at)north(dot)org first", "or zoe.k AT fablab DOT ch, he wrote", "dan arroba correo punto mx"]
    got = [[t[s:e] for s, k, e, _ in spans if k == 0] for t, spans in zip(fresh, spans_of(model, fresh), strict=True)]
    assert got == [["bob [at] corp [dot] io"], ["jane at posta point fr"], ["tim @ acme dot com"], ["lee(at)north(dot)org"], ["zoe.k AT fablab DOT ch"], ["dan arroba correo punto mx"]]
    prose = ["we met at ten at the old house", "she looked at him and at the sea. At noon, at last", "le point est chez nous", "with with with with at at at", "(at) the end (dot)", "um 12 Uhr 30 und 1999"]
    assert spans_of(model, prose) == [[]] * len(prose)


def spans_of(model, texts):
    raw, offsets = utf8_parts(pa.array(texts))
    return chunk_spans(model, raw, offsets, 0, len(texts), texts)


def test_field_learns_its_table():
    model = Crf(*train())
    right = total = 0
    for words, gold in labelled_lines():
        kind = np.array([model.kind_of(w) for w in words])
        right += int((model.decode(kind, np.array([0]), np.array([len(words)])) == gold).sum())
        total += len(gold)
    assert right / total > 0.98
    assert word_features("(at)") != word_features("(on)")


def test_spans_rows_and_added(spark):
    texts = [None, *EDGES, "write to jane at example dot com today\nor call (212) 555-0187 now", "plain words only here"]
    df = spark.createDataFrame([(k, t, "theirs", 3) for k, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r["spans"] for r in find_pii(df).collect()}
    for k, t in enumerate(texts):
        assert [(s["start"], KINDS.index(s["kind"]), s["end"]) for s in got[k] if s["base"]] == brute(t or "")
        ends = 0
        for s in (s for s in got[k] if not s["base"]):
            assert ends <= s["start"] < s["end"] <= len(t)
            ends = s["end"]
    added = [(s["kind"], texts[-2][s["start"] : s["end"]]) for s in got[len(texts) - 2]]
    assert ("email", "jane at example dot com") in added and ("phone", "(212) 555-0187") in added
    assert got[0] == [] and got[len(texts) - 1] == []
    assert find_pii(spark.createDataFrame([], SCHEMA)).collect() == []


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.co now", "s", 15), (2, None, "s", None), (3, "nothing", "s", 7)], SCHEMA)
    out = redact(spark, df, "")
    assert out.columns == df.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()} == {1: ("mail [EMAIL] now", 16), 2: (None, None), 3: ("nothing", 7)}
    assert masked("ab", [(0, 0, 2, True), (1, 1, 2, True)]) == "[EMAIL]"


def test_clean_documents_gain_little(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = find_pii(docs).collect()
    for r in rows:
        assert [(s["start"], KINDS.index(s["kind"]), s["end"]) for s in r["spans"] if s["base"]] == brute(r["text"] or "")
    assert sum(any(not s["base"] for s in r["spans"]) for r in rows) <= 0.005 * len(rows)


def test_scans_are_linear_and_like_the_patterns():
    import random
    import time

    draw = random.Random(17)
    for _ in range(4000):
        text = "".join(draw.choice("ab1290.@-_ +%é") for _ in range(draw.randint(1, 40)))
        want = [(m.start(), 0, m.end()) for m in PATTERNS["email"].finditer(text)]
        want += [(m.start(), 1, m.end()) for m in PATTERNS["ip"].finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
        assert [s for s in base_spans(text) if s[1] < 2] == sorted(want), text
    n = 1_000_000
    begun = time.time()
    for text in ("a" * n + " @ x@y.z", "1" * n + ".", "1." * (n // 2), "@" * n, "a@" * (n // 2), "+1" + "-" * n, "1 " * (n // 2), "a@b" * (n // 3)):
        base_spans(text)
    assert time.time() - begun < 16
