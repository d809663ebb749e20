import itertools
import re
from collections import Counter

from quillstat.llm.filter_audit import FIGURES, audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, failed string"
LABELS = "doc_id bigint, quality int, toxic int, extra string"


def fails(text, doc_id, rows):
    words = WORD.findall(text)
    found = set()
    if len(words) < 200:
        found.add("A")
    if 100 * len(set(words)) < 50 * len(words):
        found.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
        found.add("C")
    if re.search(r"[#$%&*|]", text):
        found.add("D")
    if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, *_ in rows):
        found.add("E")
    return found


def brute(rows, labels):
    marks = {}
    for i, q, t, *_ in labels:
        if i is not None:
            old = marks.get(i, (0, 0))
            marks[i] = (max(old[0], q or 0), max(old[1], t or 0))
    out = Counter()
    keys = set()
    for i, t, lang, *_ in rows:
        part, bad, (good, toxic) = lang or "", fails(t or "", i, rows), marks.get(i, (0, 0))
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = False
            for k, f in enumerate(order):
                keys.add((part, order, k + 1))
                now = not gone and f in bad
                out[part, order, k + 1, "redundant"] += gone and f in bad
                gone |= now
                out[part, order, k + 1, "kept"] += not gone
                out[part, order, k + 1, "removed"] += now
                out[part, order, k + 1, "unique_fails"] += bad == {f}
                out[part, order, k + 1, "good_lost"] += now and good == 1
                out[part, order, k + 1, "toxic_lost"] += now and toxic == 1
                out[part, f, "shapley"] += now
    return {k: (*[out[(*k, f)] for f in FIGURES], out[k[0], k[1][k[2] - 1], "shapley"]) for k in keys}


def result(df):
    rows = df.collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in rows}) == len(rows)
    assert all(r["filter"] == r["filter_order"][r["step"] - 1] for r in rows)
    return {(r["part"], r["filter_order"], r["step"]): (*[r[f] for f in FIGURES], r["shapley"]) for r in rows}


LONG = " ".join(f"word{k}" for k in range(240))
ROWS = [
    (1, LONG, "en", "s", "x"), (2, LONG, "en", "s", "x"), (3, LONG, "de", "s", "x"), (3, LONG, "de", "s", "x"), (4, None, "en", "s", "x"), (5, "", "en", "s", "x"), (6, "", None, "s", "x"),
    (None, LONG, "en", "s", "x"), (None, LONG, "", "s", "x"), (7, "same " * 5000, "en", "s", "x"), (8, LONG.upper(), "de", "s", "x"), (9, LONG + " #", "de", "s", "x"), (9, "A\x0bB\x0cC d", "fr", "s", "x"),
    (10, "a\x85b " * 101, "fr", "s", "x"), (11, LONG + "\n", "en", "s", "x"), (0, LONG + " #", "en", "s", "x"),
]
MARKS = [(1, 1, 0, "e"), (2, 1, 1, "e"), (2, 0, 0, "e"), (3, None, 1, "e"), (7, 0, 1, "e"), (None, 1, 1, "e"), (99, 1, 1, "e"), (9, 1, None, "e")]


def test_against_loops(spark):
    assert result(audit(spark.createDataFrame(ROWS, DOCS), spark.createDataFrame(MARKS, LABELS))) == brute(ROWS, MARKS)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit(docs, spark.createDataFrame(MARKS, LABELS)).collect() == []
    assert result(audit(spark.createDataFrame(ROWS, DOCS), labels)) == brute(ROWS, [])


def test_shares_add_up(spark, sf_dir):
    got = audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    by_order = Counter()
    shapley = {}
    for r in got:
        by_order[r["part"], r["filter_order"]] += r["removed"]
        shapley[r["part"], r["filter"]] = r["shapley"]
    for part in {p for p, _ in shapley}:
        whole = {n for (p, _), n in by_order.items() if p == part}
        assert len(whole) == 1  # every order removes the same documents in the end
        assert sum(s for (p, _), s in shapley.items() if p == part) == 120 * whole.pop()
