"""Benchmark decontamination by latent semantic retrieval.

Words are hashed into FEATURES features whose inverse document frequencies come from all documents. A randomised
SVD of TF-IDF passages (one distributed product of the passage matrix of all documents with a thin one, as partial
sums of one fixed size from each task) gives RANK latent directions, after the leading COMMON ones, which only tell
languages apart, are left out; each is divided by its singular value, so that no direction outweighs the rest.
Every passage of every document is then placed in that space and compared with the benchmark items by cosine. For
each candidate pair the longest common subsequence of words is taken over the item and the passage with its
surroundings: an item leaks if MATCH of its words recur in order, or if NEAR of them do and so does ANSWER of its
last quarter (its answer). A candidate whose surroundings hold fewer of the item's words than NEAR asks for cannot
pass, and is left out before.

Benchmark items are the stated query set: blocks of ITEM_BLOCK are broadcast one at a time, and a task compares them
in groups of ITEM_GROUP. Every passage of every document is searched.

Items of fewer than MIN_ITEM_WORDS words have too few for a share of them to tell: they leak where their words stand
in a text unbroken and in order; of fewer than LINE_WORDS words, where they make up a whole line.

Null, empty or wordless texts and items match nothing. Repeated rows get equal results; an empty table on either side gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.llm.common import PLACE, Words, chunks, free_name, materialise, mix, read_table, row_key, semi_by_id, session_defaults, tidy, utf8_parts, windows

FEATURES, RANK, COMMON, OVERSAMPLE = 8192, 128, 8, 16
#: A passage is WINDOW words long, one begins every STRIDE words.
WINDOW, STRIDE = 32, 16
COSINE, MATCH, NEAR, ANSWER = 0.35, 0.8, 0.6, 0.5
MIN_ITEM_WORDS, LINE_WORDS, ITEM_BLOCK, ITEM_GROUP = 8, 4, 4000, 400
#: Passage vectors and looked-up words that a task handles at once.
BLOCKS_AT_ONCE, WORDS_AT_ONCE, MARKS_AT_ONCE, DOCS_AT_ONCE, SCATTER_BLOCKS = 2048, 1 << 20, 1 << 22, 255, 128
_FIT_PARTS = 4


def _features(words: Words) -> np.ndarray:
    return (words.hash >> np.uint64(40)).astype(np.int64) % FEATURES


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """(documents that hold each feature, documents), over all documents; FEATURES + 1 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            raw, offsets = utf8_parts(batch.column(0))
            for i, j in chunks(offsets, 1 << 18):
                w = Words(raw, offsets, i, j, lower=True)
                feature = _features(w)
                for first in range(0, w.n_docs, DOCS_AT_ONCE):
                    last = min(first + DOCS_AT_ONCE, w.n_docs)
                    a, b = w.first_word[first], w.first_word[last]
                    held = np.zeros((last - first, FEATURES), np.uint8)
                    held[w.doc[a:b] - first, feature[a:b]] = 1
                    seen += held.sum(0, dtype=np.uint8)  # at most DOCS_AT_ONCE, the largest that fits
                n += w.n_docs
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, FEATURES)), pa.array(np.append(n, seen))], names=["feature", "docs"])

    made = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(tidy(run), "feature bigint, docs bigint")
    rows = dict(made.groupBy("feature").agg(F.sum("docs").alias("docs")).collect())
    return np.array([rows.get(f, 0) for f in range(FEATURES)], float), rows.get(-1, 0)


def passage_starts(n_words: int) -> np.ndarray:
    """Where passages begin: every STRIDE words, as far as a passage still brings new words."""
    return np.arange(0, max(1, n_words - (WINDOW - STRIDE)), STRIDE)


def _block_sums(words: Words, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, text, first word) of all passages: a passage is the sum of two blocks of STRIDE words."""
    full = np.flatnonzero(words.counts)
    n_blocks = -(-words.counts[full] // STRIDE)
    doc = np.repeat(full, n_blocks)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    first = words.first_word[doc] + nth * STRIDE
    if not len(first):
        return np.zeros((0, table.shape[1]), np.float32), doc, first
    # a word place beyond the end of its block reads the row of zeros
    rows = np.concatenate((table, np.zeros((1, table.shape[1]), table.dtype)))
    feature = np.append(_features(words), FEATURES)
    size = np.minimum(STRIDE, words.first_word[doc + 1] - first)
    out = np.zeros((len(first), table.shape[1]), table.dtype)
    for low in range(0, len(first), BLOCKS_AT_ONCE):
        part = slice(low, low + BLOCKS_AT_ONCE)
        for k in range(STRIDE):
            out[part] += rows[feature[np.where(k < size[part], first[part] + k, len(feature) - 1)]]
    follows = np.flatnonzero(doc[:-1] == doc[1:])
    out[follows] += out[follows + 1]  # reads the next block before it grows: numpy evaluates the right side first
    last = np.append(doc[:-1] != doc[1:], True)
    keep = ~last | (nth == 0)
    return out[keep], doc[keep], first[keep]


def _passage_products(words: Words, thin: np.ndarray, idf: np.ndarray, total: np.ndarray) -> None:
    """Add X^T X q of a chunk's passages to `total`, X being their TF-IDF rows of unit length and thin = idf * q.

    A passage is two blocks of STRIDE words, so the product of a passage with q is the sum of two block sums, and what
    comes back to a word is the sum over the passages that hold its block.
    """
    feature = _features(words)
    rows, doc, first = _block_sums(words, thin)
    if not len(first):
        return
    size = np.minimum(WINDOW, words.first_word[doc + 1] - first)
    square = np.concatenate(([0.0], np.cumsum(idf[feature] ** 2)))
    rows /= np.maximum(square[first + size] - square[first], 1e-12)[:, None].astype(np.float32)
    # a block's words get the passage that begins with it and the one that ends with it
    back = rows.copy()
    same = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    back[same] += rows[same - 1]
    passages = np.bincount(doc, minlength=words.n_docs)
    blocks = -(-words.counts // STRIDE)
    own = np.repeat(np.cumsum(passages) - passages, blocks)
    held = np.repeat(passages, blocks)
    nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    beyond = nth >= held  # the last passage of a text has a second block that begins no passage
    got = np.where(beyond[:, None], rows[own + held - 1], back[np.minimum(own + nth, len(back) - 1)])
    at = np.append(words.first_word[np.repeat(np.arange(words.n_docs), blocks)] + nth * STRIDE, len(words.doc))
    for low in range(0, len(got), SCATTER_BLOCKS):
        high = min(low + SCATTER_BLOCKS, len(got))
        found, place = np.unique(feature[at[low] : at[high]], return_inverse=True)
        block = np.repeat(np.arange(high - low), np.diff(at[low : high + 1]))
        times = np.bincount(place * (high - low) + block, minlength=len(found) * (high - low))
        total[found] += times.reshape(len(found), -1).astype(np.float32) @ got[low:high]


def fit_directions(docs: DataFrame, idf: np.ndarray, text_col: str = "text", seed: int = 11) -> np.ndarray:
    """[FEATURES, RANK] latent directions over their singular values, by a randomised SVD.

    One pass over all passages gives A g for A = X^T X and a random thin g; the eigenvectors of the approximation
    A g (g^T A g)^-1 (A g)^T follow from it on the driver.
    """
    spark = docs.sparkSession
    parts = 2 * max(_FIT_PARTS, spark.sparkContext.defaultParallelism)  # each gives a partial sum of one fixed size
    texts = docs.select(F.col(f"`{text_col}`").alias("text")).coalesce(parts)
    width = RANK + COMMON + OVERSAMPLE
    g, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((FEATURES, width)))
    thin = (idf[:, None] * g).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(g.shape, np.float64)
        for batch in batches:
            raw, offsets = utf8_parts(batch.column(0))
            for i, j in chunks(offsets, 1 << 19):
                _passage_products(Words(raw, offsets, i, j, lower=True), thin, idf, total)
        total *= idf[:, None]
        part = 512
        starts = list(range(0, FEATURES, part))
        yield pa.RecordBatch.from_arrays([pa.array(starts), pa.array([total[s : s + part].astype(np.float32).tobytes() for s in starts], pa.binary())], names=["start", "part"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        keep = {c: [group[c].iloc[0]] for c in group.columns if c != "part"}
        return pd.DataFrame(keep | {"part": [sum(np.frombuffer(p, np.float32).astype(float) for p in group["part"]).astype(np.float32).tobytes()]})

    # sums of sums, so that no task holds more than about the root of all partial sums of a slice
    fan = max(1, round(parts**0.5))
    made = texts.mapInArrow(tidy(run), "start bigint, part binary").withColumn("lot", F.pmod(F.spark_partition_id(), F.lit(fan)).cast("int")).select("start", "lot", "part")
    lots = made.groupBy("start", "lot").applyInPandas(add, "start bigint, lot int, part binary")
    rows = lots.select("start", "part").groupBy("start").applyInPandas(add, "start bigint, part binary").collect()
    y = np.concatenate([np.frombuffer(r["part"], np.float32).astype(float).reshape(-1, width) for r in sorted(rows, key=lambda r: r["start"])])
    held = (y != 0).any(1)
    shift = 1e-7 * np.linalg.norm(y, 2)  # keeps the small matrix positive definite
    y += shift * g
    core = g.T @ y
    root = np.linalg.cholesky((core + core.T) / 2)
    vectors, values, _ = np.linalg.svd(np.linalg.solve(root, y.T).T, full_matrices=False)
    values = values**2 - shift
    vectors[~held] = 0  # features of no passage
    own = int((values > 1e-6 * values[0]).sum())  # texts of few different words have fewer directions than are asked for
    chosen = slice(max(0, min(COMMON, own - RANK)), min(own, COMMON + RANK))
    # passages have unit length, so a direction of a value under 1 holds less than one of them, and is not blown up
    return np.pad(vectors[:, chosen] / np.sqrt(values[chosen] + 1), ((0, 0), (0, max(0, RANK - (chosen.stop - chosen.start)))))


def lcs_hits(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which words of `item` lie on one longest common subsequence with `text` (both of word hashes)."""
    masks: dict[int, int] = {}
    for k, x in enumerate(item.tolist()):
        masks[x] = masks.get(x, 0) | 1 << k
    full = (1 << len(item)) - 1
    v, rows, places = full, [], []
    for at, x in enumerate(text.tolist()):
        m = masks.get(x)
        if m is not None:  # a word the item lacks changes nothing
            u = v & m
            v = ((v + u) | (v - u)) & full
            rows.append(v)
            places.append(at)
    hit = np.zeros(len(item), bool)
    k = len(item)
    # walk back: a zero at bit b of row r says that the length grows at b in the first r rows
    for r in range(len(rows) - 1, -1, -1):
        before = rows[r - 1] if r else full
        now = (~rows[r]) & ((1 << k) - 1)
        if not now:
            break
        if now.bit_count() > ((~before) & ((1 << k) - 1)).bit_count():
            m = masks[int(text[places[r]])] & ((1 << k) - 1)
            top = m.bit_length() - 1
            hit[top] = True
            k = top
    return hit


def item_table(items: list[tuple[int, str]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(item_id, word hashes, features) of items that have words."""
    out = []
    for item, text in items:
        raw, offsets = utf8_parts(pa.array([text or ""]))
        w = Words(raw, offsets, 0, 1, lower=True)
        if len(w.start):
            out.append((int(item), w.hash, _features(w)))
    return out


LEAKS = "doc_id bigint, item_id bigint, cosine double, lcs double, answer double, first_word bigint"


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(LEAKS) one row for each document and item that it leaks."""
    spark = docs.sparkSession
    session_defaults(spark)
    named = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    seen, n = document_frequencies(named)
    wanted = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").dropna()
    if not n or wanted.isEmpty():
        return named.select("doc_id", *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in LEAKS.split(", ")[1:]]).limit(0)
    idf = np.log((n + 1) / (seen + 1)) + 0.05
    directions = (idf[:, None] * fit_directions(named, idf)).astype(np.float32)
    shared = spark.sparkContext.broadcast(directions)  # FEATURES x RANK numbers, 4 MB
    found = None
    numbered = materialise(wanted.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(-(-wanted.count() // ITEM_BLOCK)))))
    for block in sorted(r["block"] for r in numbered.select("block").distinct().collect()):
        items = item_table([(r["item_id"], r["text"]) for r in numbered.filter(F.col("block") == block).collect()])  # about ITEM_BLOCK rows
        if items:
            part = named.mapInArrow(tidy(_search(shared, spark.sparkContext.broadcast(items))), LEAKS)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], LEAKS)
    return found


class ShortItems:
    """Items of under MIN_ITEM_WORDS words, found as unbroken sequences."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]]):
        self.by_size: dict[int, dict[int, list[int]]] = {}
        for number, h, _ in items:
            key = mix(sum((mix(h[k : k + 1] * PLACE[k]) for k in range(len(h))), np.zeros(1, np.uint64)))
            self.by_size.setdefault(len(h), {}).setdefault(int(key[0]), []).append(number)

    def found(self, w: Words) -> list[tuple]:
        """Each (text, item) once, at its first place."""
        best: dict[tuple[int, int], tuple] = {}
        line = np.concatenate(([0], np.cumsum(w.b == 10)))[w.start] if self.by_size else None
        for size, items in self.by_size.items():
            key, doc, at = windows(w, size)
            hit = np.flatnonzero(np.isin(key, np.fromiter(items, np.uint64, len(items))))
            for k in hit.tolist():
                low, d = int(at[k]), int(doc[k])
                high = low + size
                whole = (low == w.first_word[d] or line[low - 1] < line[low]) and line[high - 1] == line[low] and (high == w.first_word[d + 1] or line[high] > line[low])
                if size >= LINE_WORDS or whole:
                    for number in items[int(key[k])]:
                        best.setdefault((d, number), (d, number, 1.0, 1.0, 1.0, low - int(w.first_word[d])))
        return list(best.values())


class ItemGroup:
    """Items with their places in the latent space and, for each, which words of the group it has."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]], table: np.ndarray):
        self.items = items
        points = np.stack([table[f].sum(0) for _, _, f in items])
        self.points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
        self.size = np.array([len(h) for _, h, _ in items])
        self.vocabulary = np.unique(np.concatenate([h for _, h, _ in items]))
        self.word = np.searchsorted(self.vocabulary, np.concatenate([h for _, h, _ in items]))
        self.word_at = np.cumsum(self.size) - self.size
        self.has = np.zeros((len(items), len(self.vocabulary) + 1), bool)  # the last column: a word that no item has
        self.has[np.repeat(np.arange(len(items)), self.size), self.word] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, len(self.vocabulary)).astype(np.int32)

    def hopeful(self, number: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Candidates (by place) whose surroundings hold NEAR of the item's words, as a long enough subsequence needs."""
        least = NEAR * self.size[item]
        some = number < len(self.vocabulary)
        before = np.concatenate(([0], np.cumsum(some)))
        low, high, number = before[low], before[high], number[some]  # words of no item count for nothing
        enough = np.flatnonzero(high - low >= least)
        left, flat, row = [enough[:0]], self.has.ravel(), (item * self.has.shape[1]).astype(np.int32)
        for k in _cuts((high - low)[enough], WORDS_AT_ONCE):  # first by the surroundings' words that the item has
            c = enough[k]
            at, n = _spans(low[c], high[c])
            held = flat[np.repeat(row[c], n) + number[at]]
            left.append(c[np.add.reduceat(held, np.cumsum(n) - n, dtype=np.int32) >= least[c]])
        left, out = np.concatenate(left), []
        step = max(1, MARKS_AT_ONCE // (len(self.vocabulary) + 1))
        for c in (left[k : k + step] for k in range(0, len(left), step)):  # then by the item's words that they have
            here = np.zeros((len(c), len(self.vocabulary) + 1), bool)
            at, n = _spans(low[c], high[c])
            here[np.repeat(np.arange(len(c)), n), number[at]] = True
            at, n = _spans(self.word_at[item[c]], self.word_at[item[c]] + self.size[item[c]])
            held = here[np.repeat(np.arange(len(c)), n), self.word[at]]
            out.append(c[np.add.reduceat(held, np.cumsum(n) - n, dtype=np.int32) >= least[c]])
        return np.concatenate([left[:0], *out])


def _cuts(size: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Runs of places whose sizes add up to `most` at most, or one place that alone exceeds it."""
    at = np.concatenate(([0], np.cumsum(size)))
    return (np.arange(i, j) for i, j in chunks(at, most))


def _spans(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers from each low up to its high, how many of each)."""
    n = high - low
    return np.arange(n.sum(), dtype=np.int32) + np.repeat((low - (np.cumsum(n) - n)).astype(np.int32), n), n


def _search(shared, items_shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, items = shared.value, items_shared.value
        short = ShortItems([x for x in items if len(x[1]) < MIN_ITEM_WORDS])
        items = [x for x in items if len(x[1]) >= MIN_ITEM_WORDS]
        groups = [ItemGroup(items[k : k + ITEM_GROUP], table) for k in range(0, len(items), ITEM_GROUP)]
        for batch in batches:
            raw, offsets = utf8_parts(batch.column(1))
            for i, j in chunks(offsets, 1 << 19):
                w = Words(raw, offsets, i, j, lower=True)
                vectors, doc, first = _block_sums(w, table)
                vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                rows = [r for g in groups for r in _confirmed(w, doc, first, vectors @ g.points.T, g)] + short.found(w)
                if rows:
                    ids = batch.column(0)
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i + d].as_py() for d in cols[0]], pa.int64()), *(pa.array(c, t) for c, t in zip(cols[1:], (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()), strict=True))], names=[x.split()[0] for x in LEAKS.split(", ")])

    return run


def _confirmed(w: Words, doc: np.ndarray, first: np.ndarray, cosine: np.ndarray, group: ItemGroup) -> list[tuple]:
    """The best confirmed place of each (text, item) among the candidates."""
    best: dict[tuple[int, int], tuple] = {}
    at, item = np.nonzero(cosine >= COSINE)
    if not len(at):
        return []
    hashes = w.hash
    low = np.maximum(w.first_word[doc[at]], first[at] - group.size[item])
    high = np.minimum(w.first_word[doc[at] + 1], first[at] + WINDOW + group.size[item])
    for c in group.hopeful(group.numbers(hashes), low, high, item).tolist():
        d, k, p = int(doc[at[c]]), int(item[c]), int(at[c])
        number, words, _ = group.items[k]
        hit = lcs_hits(words, hashes[low[c] : high[c]])
        share, answer = float(hit.mean()), float(hit[-max(3, len(words) // 4) :].mean())
        if share >= MATCH or (share >= NEAR and answer >= ANSWER):
            near, old = float(cosine[p, k]), best.get((d, k))
            if old is None or (share, near) > (old[3], old[2]):
                best[d, k] = (d, number, near, share, answer, int(first[p] - w.first_word[d]))
    return list(best.values())


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    rounded = [F.round(c, 6).alias(c) for c in ("cosine", "lcs", "answer")]
    return leaks(docs.select("doc_id", "text"), items).select("doc_id", "item_id", *rounded, "first_word")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that leak a benchmark item go, with or without a doc_id."""
    key = free_name(docs)
    keyed = docs.withColumn(key, row_key())
    found = materialise(leaks(keyed.select(key, "text"), read_table(spark, sf_dir, "benchmark"), key).select(F.col("doc_id").alias(key)).distinct())
    return semi_by_id(keyed, found, key, "left_anti").drop(key)
