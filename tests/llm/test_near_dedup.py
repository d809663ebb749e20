import random
import re

import numpy as np

from quillstat.llm import near_dedup
from quillstat.llm.decontaminate import drop_leaks
from quillstat.llm.near_dedup import keep_one, near_duplicates

SCHEMA = "doc_id bigint, text string, rep string, label int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(rows):
    """doc_id: (set size, least doc_id reachable), by comparing all that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    holders, parent = {}, {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, own in sets.items():
        for s in own:
            holders.setdefault(s, []).append(i)
    for i, own in sets.items():
        shared = {}
        for s in own:
            for j in holders[s]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= 85 * (len(own) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(own), root(i)) for i, own in sets.items()}


def found(spark, rows):
    made = near_duplicates(spark.createDataFrame([(i, t, "own", 1) for i, t in rows], SCHEMA))
    assert made.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = made.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}


def changed(words, n, draw):
    out = list(words)
    for k in draw.sample(range(len(out)), n):
        out[k] = f"new{draw.randrange(10**9)}"
    return " ".join(out)


def test_whole_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert found(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, "a b c d e"), (8, "A B C D E"), (9, "a b c d"),
        (10, "É b c d e f"), (11, "é b c d e f"), (12, "w " * 30_000), (13, "w w w w w"), (14, None),
    ]
    got = found(spark, rows)
    assert got == brute(rows)
    assert got[5] == (1, 4) and got[1] == (0, 1) and got[14] == (0, 14) and got[12] == (1, 12) and got[13][1] == 12


def test_threshold_is_exact(spark):
    base = [f"w{k}" for k in range(104)]  # 100 shingles
    rows = [(1, " ".join(base)), (2, " ".join(base[:-15])), (3, " ".join(base[:-16]) + ""), (4, " ".join(base[16:]))]
    got = found(spark, rows)
    assert got == brute(rows)
    assert got[2][1] == 1  # 85 of 100
    far = found(spark, rows[:1] + rows[3:])
    assert far[4][1] == 4  # 84 of 100


def test_large_families_and_chains(spark):
    draw = random.Random(4)
    rows = []
    for family, size in enumerate((300, 40, 5)):
        base = [f"f{family}w{draw.randrange(5000)}" for _ in range(160)]
        rows += [(len(rows) + k + 1, changed(base, draw.randint(0, 2), draw)) for k in range(size)]
    chain = [f"c{k}" for k in range(220)]
    for _ in range(40):  # each is near the next, the ends are far apart
        rows.append((len(rows) + 1, " ".join(chain)))
        for k in range(3):
            chain[draw.randrange(len(chain))] = f"x{draw.randrange(10**9)}"
    rows += [(len(rows) + k + 1, " ".join(f"u{draw.randrange(10**6)}" for _ in range(50))) for k in range(300)]
    draw.shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_family_beyond_its_parts_goes_by_tree_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PARTS", 1)
    monkeypatch.setattr(near_dedup, "NODE", 32)
    draw = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    rows = [(k + 1, changed(base, draw.randint(0, 2), draw)) for k in range(150)]
    assert found(spark, rows) == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    text = " ".join(f"w{k}" for k in range(20))
    df = spark.createDataFrame([(3, text, "a", 1), (3, text, "a", 1), (4, text, "b", 2), (9, None, "c", 3)], SCHEMA)
    assert sorted((r["doc_id"], r["component_id"]) for r in near_duplicates(df).collect()) == [(3, 3), (3, 3), (4, 3), (9, 9)]
    kept = keep_one(spark, df, "")
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 9]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_large_family_of_isolated_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PARTS", 1)
    monkeypatch.setattr(near_dedup, "NODE", 4)
    draw = random.Random(5)
    core = [f"w{k}" for k in range(273)]
    rows = []
    for k in range(90):  # 0.81 like any other, 0.86 like its partner: one family, links in pairs only
        own = [f"own{k}x{j}" for j in range(31)]
        rows += [(2 * k + 1, " ".join(core + own)), (2 * k + 2, " ".join(core + own[:9] + [f"late{k}x{j}" for j in range(22)]))]
    draw.shuffle(rows)
    wanted = brute(rows)
    assert len({c for _, c in wanted.values()}) == 90
    assert found(spark, rows) == wanted


def test_large_root_is_compared_wholly(spark):
    draw = np.random.default_rng(6)
    sig = draw.integers(0, 256, (1500, near_dedup.TOKENS), dtype=np.uint8)  # halves are like no other text but their partner
    twin = sig.copy()
    for row in twin:
        row[draw.choice(near_dedup.TOKENS, 30, replace=False)] ^= 1
    rows = [(2 * k + j + 1, 100, bytes(s[k]), [7]) for k in range(1500) for j, s in enumerate((sig, twin))]
    classes = spark.createDataFrame(rows, "rep bigint, n_shingles bigint, sig binary, roots array<bigint>")
    families, _ = near_dedup.families_of(classes)
    assert {r["rep"]: r["label"] for r in families.collect()} == {i: i - (i + 1) % 2 for i in range(1, 3001)}


def test_rows_without_an_id(spark, tmp_path):
    one, two, three = (" ".join(f"{c}{k}" for k in range(30)) for c in "abc")
    df = spark.createDataFrame([(1, one, "a", 1), (None, one, "b", 1), (None, two, "c", 1), (None, two, "d", 1), (None, None, "e", 1), (2, None, "f", 1)], SCHEMA)
    kept = keep_one(spark, df, "")
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted([(1, one), (0, two), (0, ""), (2, "")])
    spark.createDataFrame([(1, three)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    others = [(k, " ".join(f"o{k}x{j}" for j in range(30)), "x", 1) for k in range(10, 70)]
    leaking = spark.createDataFrame([(None, three, "a", 1), (None, one, "b", 1), (3, three, "c", 1), (4, two, "d", 1), *others], SCHEMA)
    left = drop_leaks(spark, leaking, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left) == [(0, one), (4, two), *[o[:2] for o in others]]
