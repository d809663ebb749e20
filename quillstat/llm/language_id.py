"""Language identification by the nearest of several centroids a language.

A text becomes a vector of hashed byte n-grams within words (NGRAMS bytes long, lower-cased, anything but letters is a
space), each weighed by 1 + log of its count and by its inverse document frequency over all learning documents, scaled
to length 1. The documents of each language, a bounded sample of them, are clustered into CENTROIDS groups by spherical
k-means; a text gets the language of the centroid with the greatest cosine, which is its score. It is rejected where its
distance, 1 less the cosine, is greater than what all but REJECT_SHARE of the sample's documents of that centroid have.

A null text, or one without letters, is `und` with score 0. A text of which no n-gram was learned is as near to any
language: it gets the first in order, score 0, and is rejected. Without learning documents everything is `und`. Rows
without an id or a language are not learned from; rows repeated in full are learned from once in the sample. Texts are
taken whole. Repeated rows get equal results; an empty table gives an empty one. Extra columns are carried through,
unless they bear a result's name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstat.llm.common import chunks, materialise, read_table, session_defaults, tidy, utf8_parts

NGRAMS = (1, 2, 3)
BUCKETS = 8192
CENTROIDS, ROUNDS = 4, 12
#: Documents of each language that are clustered: SAMPLE_SLICES times SAMPLE_IN_SLICE at most, the least hashes.
SAMPLE_SLICES, SAMPLE_IN_SLICE = 64, 32
REJECT_SHARE = 0.005
#: Texts of a chunk that are vectors at the same time; a vector takes 4 * BUCKETS bytes.
CHUNK_TEXTS = 256
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)


@dataclass(frozen=True)
class Centroids:
    languages: list[str]  # of each centroid
    vectors: np.ndarray  # [centroid, BUCKETS], length 1
    idf: np.ndarray
    farthest: np.ndarray  # of each centroid, the distance beyond which a text is rejected


def ngram_counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(i, j, counts [text, BUCKETS]) of texts i to j, chunk by chunk."""
    lower = pc.binary_join_element_wise("", pc.utf8_lower(pc.fill_null(column, "")), " ")  # every text behind a space
    raw, offsets = utf8_parts(lower)
    for first, last in chunks(offsets):
        for i in range(first, last, CHUNK_TEXTS):
            j = min(last, i + CHUNK_TEXTS)
            b = np.append(_FOLD[raw[offsets[i] : offsets[j]]], np.uint8(32)).astype(np.uint32)  # and a space behind the last
            text = np.repeat(np.arange(j - i), np.diff(offsets[i : j + 1]))
            counts = np.zeros((j - i) * BUCKETS, np.int64)
            key = np.zeros(len(b), np.uint32)
            for n in range(1, max(NGRAMS) + 1):
                key = (key[: len(b) - n + 1] * np.uint32(257)) + b[n - 1 :] + np.uint32(1)
                if n not in NGRAMS:
                    continue
                m = len(key)
                # a space may be an n-gram's first or last place only, and not all of it
                inside = (b[:m] != 32) | (b[n - 1 : n - 1 + m] != 32) if n < 3 else np.ones(m, bool)
                for k in range(1, n - 1):
                    inside &= b[k : k + m] != 32
                at = np.flatnonzero(inside)
                at = at[at < len(text)]
                bucket = ((key[at] ^ (key[at] >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
                counts += np.bincount(text[at] * BUCKETS + bucket, minlength=len(counts))
            yield i, j, counts.reshape(j - i, BUCKETS)


def weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of length 1; a text without known n-grams stays all zero."""
    out = np.zeros(counts.shape, np.float32)
    at = np.nonzero(counts)
    out[at] = (1 + np.log(counts[at])) * idf[at[1]]
    size = np.sqrt(np.einsum("ij,ij->i", out, out))
    return out / np.where(size > 0, size, 1)[:, None]


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """(documents that hold each bucket, documents): counted in each task, then summed; BUCKETS rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for i, j, counts in ngram_counts(batch.column(0)):
                held += (counts > 0).sum(0)
                n += j - i
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(held[at], n))], names=["bucket", "n"])

    rows = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(tidy(run), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    held = np.zeros(BUCKETS, np.int64)
    total = 0
    for r in rows:
        if r["bucket"] < 0:
            total = r["n"]
        else:
            held[r["bucket"]] = r["n"]
    return held, total


def spherical_kmeans(x: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(centroids of length 1, owner of each row). Begins with the mean's farthest row, then always the row farthest
    from those taken; fewer centroids where rows are fewer or all the same."""
    means = x.mean(0)
    taken = [int((x @ means).argmin())]
    near = x @ x[taken[0]]
    while len(taken) < min(k, len(x)) and near.min() < 0.999999:
        taken.append(int(near.argmin()))
        near = np.maximum(near, x @ x[taken[-1]])
    centres = x[taken]
    for _ in range(rounds):
        owner = (x @ centres.T).argmax(1)
        sums = np.stack([x[owner == c].sum(0) if (owner == c).any() else centres[c] for c in range(len(centres))])
        new = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)[:, None]
        if np.allclose(new, centres, atol=1e-6):
            break
        centres = new
    return centres, (x @ centres.T).argmax(1)


def sampled(docs: DataFrame, lang_col: str, text_col: str, slices: int, in_slice: int) -> DataFrame:
    """(lang, h, text): of each language the rows of the least hashes in each slice. Only hashes are shuffled, and
    each task gives in_slice rows of a slice at most."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{lang_col}`").alias("lang"), F.xxhash64("doc_id", text).alias("h"), text.alias("text"))
    slot = F.pmod("h", F.lit(slices))
    nth = F.row_number().over(Window.partitionBy("lang", "slot").orderBy("mixed", "h"))
    keys = rows.select("lang", "h").distinct().withColumns({"slot": slot, "mixed": F.xxhash64("h")})
    picked = materialise(keys.withColumn("nth", nth).filter(F.col("nth") <= in_slice).select("lang", "h"))
    return rows.join(F.broadcast(picked), ["lang", "h"]).dropDuplicates(["lang", "h"])


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", slices: int = SAMPLE_SLICES, in_slice: int = SAMPLE_IN_SLICE) -> Centroids:
    """Document frequencies over all of `docs`, centroids over the sample. Each language is clustered in a task of its
    own, of slices * in_slice vectors at most; the driver gets CENTROIDS vectors a language."""
    session_defaults(docs.sparkSession)
    known = docs.filter(F.col(f"`{lang_col}`").isNotNull() & F.col("doc_id").isNotNull() & has_letter(F.col(f"`{text_col}`")))
    held, total = document_frequencies(known, text_col)
    idf = np.where(held > 0, np.log((1 + total) / (1 + held)) + 1, 0).astype(np.float32)

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("h")
        x = np.concatenate([weighed(counts, idf) for _, _, counts in ngram_counts(pa.array(rows["text"], pa.string()))])
        centres, owner = spherical_kmeans(x)
        distance = 1 - np.einsum("ij,ij->i", x, centres[owner])
        far = [float(np.quantile(distance[owner == c], 1 - REJECT_SHARE)) if (owner == c).any() else 0.0 for c in range(len(centres))]
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "nth": range(len(centres)), "vector": [c.astype(np.float32).tobytes() for c in centres], "far": far})

    made = sampled(known, lang_col, text_col, slices, in_slice).groupBy("lang").applyInPandas(cluster, "lang string, nth int, vector binary, far double")
    rows = sorted(made.collect(), key=lambda r: (r["lang"], r["nth"]))
    vectors = np.stack([np.frombuffer(r["vector"], np.float32) for r in rows]) if rows else np.zeros((0, BUCKETS), np.float32)
    return Centroids([r["lang"] for r in rows], vectors, idf, np.array([r["far"] for r in rows]))


def has_letter(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))


def classify(docs: DataFrame, model: Centroids, text_col: str = "text", reject: bool = False) -> DataFrame:
    """Replace the text by lang_pred, score and rejected; with `reject`, a rejected text's lang_pred is `und`."""
    session_defaults(docs.sparkSession)
    results = ("lang_pred", "score", "rejected")
    keep = [c for c in docs.columns if c not in (*results, text_col)]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], has_letter(F.col(f"`{text_col}`")).alias("__lettered"), F.col(f"`{text_col}`").alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-2]]
    names = np.array([*model.languages, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            best, cosine = np.full(batch.num_rows, len(model.languages)), np.zeros(batch.num_rows)
            if model.languages:
                for i, j, counts in ngram_counts(batch.column(batch.num_columns - 1)):
                    near = weighed(counts, model.idf) @ model.vectors.T
                    best[i:j], cosine[i:j] = near.argmax(1), near.max(1)
            lettered = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False)
            best, cosine = np.where(lettered, best, len(model.languages)), np.where(lettered, np.round(np.clip(cosine, 0, 1), 5), 0.0)
            off = (cosine <= 0) | (1 - cosine > np.append(model.farthest, -1.0)[best] + 1e-5)
            said = np.where(off, UNKNOWN, names[best]) if reject else names[best]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(said, pa.string()), pa.array(cosine), pa.array(off)], names=[*keep, *results])

    return source.mapInArrow(tidy(run), ", ".join([*fields, "lang_pred string, score double, rejected boolean"]))


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(column).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.filter(~held_out()))
    return classify(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
