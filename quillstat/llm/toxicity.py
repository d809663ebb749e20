"""Toxicity by compression distance.

A text is cut into windows of WINDOW words, each word behind a mark. Every window is compressed twice, behind one
dictionary trained by zstandard on toxic text and one trained on ordinary text, and the difference of the two lengths
is what the toxic dictionary saves. A document is judged by the distribution of its windows' savings: each saving has a
log-likelihood ratio between toxic and ordinary learning documents, and a logistic curve over their sums and over the
greatest savings gives a probability, moved so that the calibrated threshold lies at PREDICT_AT.

Both dictionaries hold the same large part, trained on windows of ordinary documents, next to the window, so that
ordinary wording costs the same with either. They differ in a small part: trained on toxic documents' windows, of
which only words with a telling beginning are left (toxic documents open words so TELLING_LIFT times as often as
ordinary ones, beyond chance), or on ordinary documents' windows, those with such words among them. Words never seen
in training still save what their beginning shares with the dictionary.

Of rows that share a doc_id the least text and the greatest label are learned from; null labels and ids aren't. A null
or empty text has no windows and gets the score of a document without savings. Repeated rows get equal scores. Without
labels of both kinds, or where no beginning of a word tells toxic texts from ordinary ones, every score is 0. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.llm.common import materialise, read_table, resident, session_defaults, tidy

#: At most so many labelled documents of each kind are learned from, picked by a hash of their ids.
LEARN_DOCS = 10_000
#: At most so many of their windows of each kind train a dictionary, picked by a hash of their documents and places.
LEARN_WINDOWS = 60_000
WINDOW = 4
#: Beginnings of words that are looked at, in characters; whole words are too.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: A telling beginning is in this share of toxic texts and in TELLING_LIFT times the share of ordinary ones; its
#: log-ratio times the root of its toxic texts is at least TELLING_SURE. The surest TELLING_MOST are kept.
TELLING_SHARE, TELLING_LIFT, TELLING_SURE, TELLING_MOST = 0.02, 6.0, 6.0, 4000
SHARED_BYTES, OWN_BYTES = 131072, 2048
LEVEL = 12
#: Savings are counted from LEAST_SAVED to MOST_SAVED bytes, the ends with all beyond.
LEAST_SAVED, MOST_SAVED = -4, 8
#: The threshold is the best by the share of toxic texts found less so many times the share of ordinary ones found.
ALARM_COST = 2.0
PREDICT_AT = 0.7

#: Windows compressed in one call, and windows whose savings a worker remembers; when full, it forgets all and goes on.
WINDOWS_AT_ONCE, CACHE_WINDOWS = 4000, 300_000

MARK = b"\n"
#: What stands around every window: the opening ends both dictionaries, so that a window begins with a match; the
#: closing is long enough for matches in a window's last word.
OPENING, CLOSING = b"\nwhat stands before every window", b"~1234567"


def text_windows(text: bytes) -> list[bytes]:
    """Windows of WINDOW words, A-Z lower-cased, as they are compressed but for the opening and closing."""
    words = text.lower().split()
    return [MARK + b" \n".join(words[k : k + WINDOW]) + b" " for k in range(0, len(words), WINDOW)]


def trained(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of `size` bytes at most; of too few samples, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=40, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionaries(toxic: list[bytes], ordinary: list[bytes], everyday: list[bytes]) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionaries: an own part, trained on the first two, and a shared part, trained on the last."""
    shared = trained(everyday, SHARED_BYTES)
    own = trained(toxic, OWN_BYTES), trained(ordinary, OWN_BYTES)
    size = max(map(len, own))
    return tuple(b"\0" * (size - len(x)) + x + shared + OPENING for x in own)


def _compressors(toxic: bytes, ordinary: bytes) -> tuple[list[zstandard.ZstdCompressor], dict[bytes, int]]:
    """Compressors, and the savings of windows met before; of the last query only, as each trains its own dictionaries."""

    def make() -> tuple[list[zstandard.ZstdCompressor], dict[bytes, int]]:
        made = []
        for content in (toxic, ordinary):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False))
        return made, {}

    return resident("toxicity", (toxic, ordinary), make)


def window_savings(windows: list[bytes], toxic: bytes, ordinary: bytes) -> np.ndarray:
    """Bytes that the toxic dictionary saves on each window, against the ordinary one."""
    compressors, known = _compressors(toxic, ordinary)
    if len(known) > CACHE_WINDOWS:
        known.clear()
    new = list(set(windows).difference(known))
    for k in range(0, len(new), WINDOWS_AT_ONCE):
        part = new[k : k + WINDOWS_AT_ONCE]
        whole = [OPENING + w + CLOSING for w in part]
        by_toxic, by_ordinary = (map(len, c.multi_compress_to_buffer(whole, threads=1)) for c in compressors)
        known.update((w, b - a) for w, a, b in zip(part, by_toxic, by_ordinary, strict=True))
    return np.fromiter((known[w] for w in windows), np.int64, len(windows))


def saving_counts(text: bytes, toxic: bytes, ordinary: bytes) -> np.ndarray:
    """How many windows of a text save each number of bytes from LEAST_SAVED to MOST_SAVED."""
    return batch_counts([text], toxic, ordinary)[0]


def batch_counts(texts: list[bytes], toxic: bytes, ordinary: bytes) -> list[np.ndarray]:
    """saving_counts of each text; short texts are compressed together."""
    out: list[np.ndarray] = []
    held: list[list[bytes]] = []

    def flush() -> None:
        sizes = np.cumsum([0, *map(len, held)])
        saved = np.clip(window_savings([w for ws in held for w in ws], toxic, ordinary), LEAST_SAVED, MOST_SAVED) - LEAST_SAVED
        out.extend(np.bincount(saved[i:j], minlength=MOST_SAVED - LEAST_SAVED + 1) for i, j in zip(sizes[:-1], sizes[1:], strict=True))
        held.clear()

    waiting = 0
    for text in texts:
        held.append(text_windows(text))
        waiting += len(held[-1])
        if waiting >= WINDOWS_AT_ONCE:
            flush()
            waiting = 0
    flush()
    return out


def measure(docs: DataFrame, toxic: bytes, ordinary: bytes, keep: list[str], text_col: str = "text") -> DataFrame:
    """`keep` and `saved`, the saving counts of each text."""
    session_defaults(docs.sparkSession)
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "UTF-8").alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    names = [*source.columns[:-1], "saved"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch_counts(batch.column(batch.num_columns - 1).to_pylist(), toxic, ordinary)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.list_(pa.int64()))], names=names)

    return source.mapInArrow(tidy(run), ", ".join([*fields, "saved array<bigint>"]))


def likelihoods(counts: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The log-likelihood ratio of each saving between windows of toxic and of ordinary documents."""
    bad, good = counts[toxic == 1].sum(0) + 1.0, counts[toxic == 0].sum(0) + 1.0
    return np.log(bad / bad.sum()) - np.log(good / good.sum())


def document_inputs(counts: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """What the logistic curve reads, from saving counts (a row each) and the ratios of the savings."""
    levels = np.arange(LEAST_SAVED, MOST_SAVED + 1)
    n = np.maximum(counts.sum(1), 1)
    total = counts @ ratio
    above = np.cumsum(counts[:, ::-1], 1)  # windows that save at least MOST_SAVED, one less, ...
    by_ratio = np.argsort(-ratio)

    def best(values: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
        """Mean of the k greatest values, or of all where there are fewer."""
        upto = np.minimum(np.cumsum(counts[:, order], 1), k)
        return np.diff(upto, axis=1, prepend=0) @ values[order] / np.minimum(n, k)

    down = np.arange(len(levels))[::-1]
    out = np.column_stack(
        (
            np.sign(total) * np.log1p(np.abs(total)),
            total / np.sqrt(n),
            best(levels, down, 1) / 8,
            best(levels, down, 3) / 8,
            np.log1p(above[:, MOST_SAVED - 3]),
            np.log1p(above[:, MOST_SAVED - 5]),
            np.minimum(3, 10 * above[:, MOST_SAVED - 3] / n),
            np.minimum(5, best(ratio, by_ratio, 5)),
            np.log(n) / 5,
        )
    )
    out[counts.sum(1) == 0] = 0
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton's method; the last weight is the intercept."""
    a = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(a.shape[1])
    penalty = np.full(len(w), ridge * max(len(x), 1) / 100)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def calibrated(odds: np.ndarray, toxic: np.ndarray) -> float:
    """The threshold of the greatest share of toxic rows found less ALARM_COST times that of ordinary rows found,
    halfway to the next lower odds."""
    order = np.argsort(-odds, kind="stable")
    gain = np.cumsum(toxic[order] / max(toxic.sum(), 1) - ALARM_COST * (1 - toxic[order]) / max((1 - toxic).sum(), 1))
    gain[:-1][odds[order][:-1] == odds[order][1:]] = -np.inf  # equal odds fall on one side
    k = int(gain.argmax())
    return float((odds[order][k] + odds[order][min(k + 1, len(order) - 1)]) / 2)


def held_out(column: str) -> F.Column:
    return F.coalesce(F.crc32(F.encode(F.col(column).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def learned_rows(docs: DataFrame, labels: DataFrame, limit: int = LEARN_DOCS) -> DataFrame:
    """(doc_id, toxic, text) of at most `limit` labelled documents of each kind whose crc32(doc_id) mod 3 isn't 1."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().filter(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picks = [known.filter(f"toxic = {k}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit) for k in (0, 1)]
    rows = materialise(picks[0].unionByName(picks[1]))
    held = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rows), "doc_id")  # 2 * LEARN_DOCS rows at most
    return materialise(held.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))


def _beginnings(text: str = "text") -> F.Column:
    """Distinct beginnings of a text's words, and its words with a space behind."""
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.array_distinct(F.split(lower, r"[\x20\x09-\x0D]+")), lambda w: F.length(w) >= BEGINNINGS[0])

    def cut(k: int) -> F.Column:
        return F.transform(F.filter(words, lambda w: F.length(w) >= k), lambda w: F.substring(w, 1, k))

    return F.array_distinct(F.concat(*map(cut, BEGINNINGS), F.transform(words, lambda w: F.concat(w, F.lit(" ")))))


def telling_beginnings(learned: DataFrame, n_toxic: int, n_ordinary: int) -> set[str]:
    """Beginnings of words by which toxic learning texts tell themselves from ordinary ones."""
    parts = learned.select("toxic", F.explode(_beginnings()).alias("part"))
    bad = parts.filter("toxic = 1").groupBy("part").agg(F.count("*").alias("bad")).filter(F.col("bad") >= max(3, TELLING_SHARE * n_toxic))
    bad = materialise(bad)  # the texts' parts over TELLING_SHARE at most
    good = parts.filter("toxic = 0").join(F.broadcast(bad.select("part")), "part", "left_semi").groupBy("part").agg(F.count("*").alias("good"))
    lift = F.log((F.col("bad") + 0.5) / (n_toxic + 1)) - F.log((F.coalesce("good", F.lit(0)) + 0.5) / (n_ordinary + 1))
    sure = bad.join(good, "part", "left").withColumn("lift", lift).withColumn("sure", lift * F.sqrt("bad"))
    kept = sure.filter((F.col("lift") >= float(np.log(TELLING_LIFT))) & (F.col("sure") >= TELLING_SURE)).orderBy(F.desc("sure"), "part").limit(TELLING_MOST)
    return {r["part"] for r in kept.select("part").collect()}


def training_windows(learned: DataFrame, telling: set[str]) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """(toxic windows of telling words, ordinary windows that hold one, ordinary windows), LEARN_WINDOWS of each at most."""

    def tells(word: bytes) -> bool:
        w = word.decode("utf-8", "replace")
        return w + " " in telling or any(w[:k] in telling for k in BEGINNINGS if len(w) >= k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, toxic, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for k, w in enumerate(text_windows(text.encode())):
                    found = [x for x in w.split() if tells(x)]
                    if toxic and found:
                        rows.append((0, doc, k, MARK + b" \n".join(found) + b" "))
                    elif not toxic:
                        rows.append((1 if found else 2, doc, k, w))
            yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r, strict=True)) for r in rows], shape)

    shape = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("nth", pa.int64()), ("piece", pa.binary())])
    made = materialise(learned.select("doc_id", "toxic", "text").mapInArrow(tidy(run), "kind int, doc_id bigint, nth bigint, piece binary"))

    def some(kinds: str) -> list[bytes]:
        rows = made.filter(f"kind in ({kinds})").orderBy(F.xxhash64("doc_id", "nth"), "doc_id", "nth").limit(LEARN_WINDOWS)
        return [bytes(r["piece"]) for r in rows.select("piece").collect()]

    toxic, hard, everyday = some("0"), some("1"), some("1, 2")
    return toxic, hard[: LEARN_WINDOWS // 3] + everyday[: max(len(toxic), len(hard))], everyday


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_windows, most_saved)."""
    learned = learned_rows(docs, labels)
    sizes = {r["toxic"]: r["n"] for r in learned.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_ordinary = sizes.get(1, 0), sizes.get(0, 0)
    telling = telling_beginnings(learned, n_toxic, n_ordinary) if n_toxic and n_ordinary else set()
    if not telling:
        return docs.select("doc_id", held_out("doc_id").alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0).cast("bigint").alias("n_windows"), F.lit(0).cast("bigint").alias("most_saved"))
    pair = dictionaries(*training_windows(learned, telling))
    table = measure(learned, *pair, keep=["toxic"]).toPandas()  # 2 * LEARN_DOCS rows at most
    counts, toxic = np.stack(table["saved"].to_numpy()), table["toxic"].to_numpy(float)
    ratio = likelihoods(counts, toxic)
    inputs = document_inputs(counts, ratio)
    weights = fit_logistic(inputs, toxic)
    threshold = calibrated(inputs @ weights[:-1], toxic)
    at = float(np.log(PREDICT_AT / (1 - PREDICT_AT)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            counts = batch.column(2).flatten().to_numpy().reshape(n, -1)
            odds = document_inputs(counts, ratio) @ weights[:-1] - threshold + at
            p = np.round(1 / (1 + np.exp(-np.clip(odds, -500, 500))), 9)
            total = counts.sum(1)
            most = np.where(total > 0, MOST_SAVED - (counts[:, ::-1] > 0).argmax(1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(p), pa.array((p >= PREDICT_AT).astype(np.int32)), pa.array(total), pa.array(most)], names=SCORES)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    measured = measure(docs.withColumn("held_out", held_out("doc_id")), *pair, keep=["doc_id", "held_out"])
    return measured.mapInArrow(tidy(run), f"doc_id {id_type}, held_out boolean, score double, predicted int, n_windows bigint, most_saved bigint")


SCORES = ["doc_id", "held_out", "score", "predicted", "n_windows", "most_saved"]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return score(docs.select("doc_id", "text"), labels)
