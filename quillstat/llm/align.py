"""Alignment of two tokenizers' tokens over the bytes of a text.

Both encode the same bytes, space + text. The ends of both sides' tokens are joined into one sorted array; each
elementary interval between neighbouring ends lies in one token of either side, found by binary search, and is the one
overlap of that pair. An end that both sides share closes a group. How many documents link an id pair is counted over
the whole corpus, then every document's links are held against those counts.

Texts are cut where both tokenizers surely cut, before a single space that is followed by other than white space, and
each distinct part is encoded and aligned once as long as a worker remembers it. That holds for byte-level BPE, whose
split pattern always begins a piece there, and for pieces that have no space mark behind another character (`Pair`
checks that).

Counts of pairs are broadcast while they are at most BROADCAST_PAIRS; beyond that only the most frequent are, and the
rest are joined by a shuffle in which no key is frequent.

A null or empty text, or one whose tokens' bytes differ from space + text on either side, has no tokens: zeros and an
empty digest. Texts are taken whole. Repeated rows each count as a document. An empty table gives an empty result.
Extra columns are carried through, unless they bear a result's name.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.llm.common import chunks, free_name, read_table, resident, session_defaults, stored, tidy, utf8_parts

#: The mark of a space in pieces, and how many bits an id takes in a pair.
MARK, ID_BITS = "▁", 20
#: Characters of parts that a worker remembers; when over, it forgets all and goes on.
CACHE_CHARS = 4_000_000
#: Pairs whose counts are broadcast: 17 bytes each.
BROADCAST_PAIRS = 2_000_000
COUNTS = ("n_a", "n_b", "n_groups", "n_links")

_ODD_SPACE = re.compile(r" (?!\S)")
_CUT = re.compile(r"(?<! )(?= \S)")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as they are and the others as characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def parts_of(text: str) -> list[str]:
    """The text in parts, each without the space before it."""
    if _ODD_SPACE.search(text) is None and text[:1] != " ":
        return text.split(" ")
    return [p[1:] for p in _CUT.split(" " + text) if p]


class Pair:
    """Both tokenizers, and what is known of parts."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        to_byte = byte_of_char()
        vocabulary = json.loads(self.a.to_str())["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            if all(c in to_byte for c in token):
                self.bytes_a[k] = bytes(to_byte[c] for c in token)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece has a space mark behind another character")
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(p)) else p.replace(MARK, " ").encode() for p in pieces]
        self.len_a, self.len_b = (np.array([len(t) for t in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        most = max(len(self.bytes_a), len(self.bytes_b))
        if most >= 1 << ID_BITS:
            raise ValueError("too many ids")
        self.width = len(str(most))
        self.digits = np.frombuffer("".join(str(k).ljust(self.width, "\0") for k in range(most)).encode(), np.uint8).reshape(most, self.width)
        self.n_digits = (self.digits != 0).sum(1)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.figures = np.zeros((0, 5), np.int64)  # of each part: COUNTS, and whether both sides give its bytes
        self.groups: list[bytes] = []
        self.pairs, self.pair_at = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def add(self, parts: list[str]) -> None:
        """Encode and align parts that are not known."""
        whole = [b" " + p.encode() for p in parts]
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
        ids_b = self.b.encode(parts, num_threads=1)
        good = np.array([b"".join([self.bytes_a[k] for k in a]) == w and b"".join([self.bytes_b[k] for k in b]) == w for a, b, w in zip(ids_a, ids_b, whole, strict=True)], bool)
        ids_a, ids_b = ([i if ok else [] for i, ok in zip(ids, good, strict=True)] for ids in (ids_a, ids_b))
        figures, groups, pairs, per_part = self.align(ids_a, ids_b)
        start = len(self.known)
        self.known.update((p, start + k) for k, p in enumerate(parts))
        self.chars += sum(map(len, parts)) + 16 * len(parts)
        self.figures = np.concatenate((self.figures, np.column_stack((figures, good))))
        self.groups += groups
        self.pairs = np.concatenate((self.pairs, pairs))
        self.pair_at = np.concatenate((self.pair_at, self.pair_at[-1] + np.cumsum(per_part)))

    def align(self, ids_a: list[list[int]], ids_b: list[list[int]]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """(COUNTS of each part, groups as text, the pairs of all links, links of each part)."""
        n = len(ids_a)
        count_a, count_b = (np.array([len(i) for i in ids], np.int64) for ids in (ids_a, ids_b))
        flat_a, flat_b = (np.array([x for i in ids for x in i], np.int64) for ids in (ids_a, ids_b))
        end_a, end_b = np.cumsum(self.len_a[flat_a]), np.cumsum(self.len_b[flat_b])
        ends = np.union1d(end_a, end_b)
        own_a, own_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        pairs = flat_a[own_a] << ID_BITS | flat_b[own_b]
        shared = (end_a[own_a] == ends) & (end_b[own_b] == ends) if len(ends) else np.zeros(0, bool)
        part_of_a = np.repeat(np.arange(n), count_a)
        part_of_link = part_of_a[own_a]
        links = np.bincount(part_of_link, minlength=n)
        closed = np.bincount(part_of_link[shared], minlength=n)
        # groups as text: each group's ids of A, then those of B, every id with its separator behind it
        closing = ends[shared]
        group_a, group_b = np.searchsorted(closing, end_a), np.searchsorted(closing, end_b)
        place_a = np.arange(len(flat_a)) + np.searchsorted(group_b, group_a)
        place_b = np.arange(len(flat_b)) + np.searchsorted(group_a, group_b, side="right")
        ids = np.zeros(len(flat_a) + len(flat_b), np.int64)
        behind = np.full(len(ids), ord(","), np.uint8)
        ids[place_a], ids[place_b] = flat_a, flat_b
        behind[place_a[np.append(group_a[1:] != group_a[:-1], [True] * bool(len(group_a))).astype(bool)]] = ord("|")
        behind[place_b[np.append(group_b[1:] != group_b[:-1], [True] * bool(len(group_b))).astype(bool)]] = ord(";")
        size = self.n_digits[ids]
        wide = np.concatenate((self.digits[ids], np.zeros((len(ids), 1), np.uint8)), 1)
        wide[np.arange(len(ids)), size] = behind
        text = wide[np.arange(self.width + 1) <= size[:, None]].tobytes()
        upto = np.concatenate(([0], np.cumsum(size + 1)))[np.concatenate(([0], np.cumsum(count_a + count_b)))].tolist()
        return np.column_stack((count_a, count_b, closed, links)), [text[i : max(i, j - 1)] for i, j in zip(upto[:-1], upto[1:], strict=True)], pairs, links

    def documents(self, texts: list[str | None]) -> dict[str, np.ndarray | list]:
        """COUNTS, groups as text, and the links as (pair, times) of each text."""
        if self.chars > CACHE_CHARS:
            self.forget()
        parts = [parts_of(t) if t else [] for t in texts]
        if new := list(set().union(*parts).difference(self.known)):
            self.add(new)
        known = self.known
        rows = [[known[p] for p in ps] for ps in parts]
        size = np.array([len(r) for r in rows], np.int64)
        flat = np.array([k for r in rows for k in r], np.int64)
        owner = np.repeat(np.arange(len(rows)), size)
        sums = np.column_stack([np.bincount(owner, self.figures[flat, c], minlength=len(rows)) for c in range(5)]).astype(np.int64)
        good = (sums[:, 4] == size) & (size > 0)
        sums[~good] = 0
        groups = [b";".join([self.groups[k] for k in r]) if ok else b"" for r, ok in zip(rows, good.tolist(), strict=True)]
        held = good[owner]
        flat, owner = flat[held], owner[held]
        first, count = self.pair_at[flat], self.pair_at[flat + 1] - self.pair_at[flat]
        at = np.arange(count.sum()) + np.repeat(first - np.concatenate(([0], np.cumsum(count)))[:-1], count)
        key, times = np.unique(np.repeat(owner, count) << (2 * ID_BITS) | self.pairs[at], return_counts=True)
        upto = np.searchsorted(key, np.arange(len(rows) + 1) << (2 * ID_BITS))
        return {"figures": sums[:, :4], "groups": groups, "pairs": key & ((1 << 2 * ID_BITS) - 1), "times": times, "upto": upto}


def tokenizers_of(path_a: str, path_b: str) -> Pair:
    """Read once in each worker; the files must be at these paths on every machine."""
    return resident("align", (path_a, path_b), lambda: Pair(path_a, path_b))


def aligned(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", groups: bool = False) -> DataFrame:
    """Replace the text by COUNTS, groups_sha256, and the distinct linked `pairs` (A's id << ID_BITS | B's id) with how
    many `times` each is linked; with `groups`, also by the groups as text."""
    session_defaults(docs.sparkSession)
    made = [*COUNTS, "groups_sha256", "pairs", "times", *["groups"] * groups]
    keep = [c for c in docs.columns if c not in (*made, text_col)]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers_of(path_a, path_b)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            _, offsets = utf8_parts(column)
            for i, j in chunks(offsets):
                got = own.documents(column[i:j].to_pylist())
                upto = pa.array(got["upto"].astype(np.int32))
                digests = [hashlib.sha256(g).hexdigest() if g else "" for g in got["groups"]]
                columns = [*(pa.array(got["figures"][:, c]) for c in range(4)), pa.array(digests, pa.string())]
                columns += [pa.ListArray.from_arrays(upto, pa.array(got["pairs"])), pa.ListArray.from_arrays(upto, pa.array(got["times"].astype(np.int32)))]
                columns += [pa.array([g.decode() for g in got["groups"]], pa.string())] * groups
                yield pa.RecordBatch.from_arrays([*(c[i:j] for c in batch.columns[:-1]), *columns], names=[*keep, *made])

    shape = [*fields, *(f"{c} bigint" for c in COUNTS), "groups_sha256 string", "pairs array<bigint>", "times array<int>", *["groups string"] * groups]
    return source.mapInArrow(tidy(run), ", ".join(shape))


def expand_groups(with_groups: DataFrame) -> DataFrame:
    """Replace `groups` by a row for each pair in a group's product: nth_group, a_id, b_id."""
    keep = [F.col(f"`{c}`") for c in with_groups.columns if c not in ("groups", "nth_group", "a_id", "b_id")]
    rows = with_groups.filter("groups <> ''").select(*keep, F.posexplode(F.split("groups", ";")).alias("nth_group", "__group"))
    side = lambda k: F.explode(F.split(F.split("__group", r"\|")[k], ",").cast("array<int>"))
    return rows.withColumn("a_id", side(0)).withColumn("b_id", side(1)).drop("__group")


def pair_counts(with_pairs: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold each pair, and whether no pair of the same A id is in more."""
    counts = stored(with_pairs.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    a_id = F.shiftright("pair", ID_BITS)
    most = counts.groupBy(a_id.alias("a_id")).agg(F.max("n").alias("most"))
    return counts.withColumn("a_id", a_id).join(most, "a_id").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_corpus_counts(with_pairs: DataFrame, counts: DataFrame, most: int = BROADCAST_PAIRS) -> DataFrame:
    """Replace `pairs` and `times` by n_best and count_sum. with_pairs must be a written table, as it is read twice
    where there are more than `most` counts."""
    spark = with_pairs.sparkSession
    levels = {r["level"]: r["pairs"] for r in counts.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count("*").alias("pairs")).collect()}  # 64 rows at most
    low, total = 0, sum(levels.values())
    while total > most and levels:
        total -= levels.pop(min(levels))
        low = min(levels, default=63)
    head = counts.filter(F.col("n") >= F.lit(2).cast("double") ** low).toPandas() if total else pd.DataFrame({"pair": [], "n": [], "best": []})  # `most` rows at most
    head = head.sort_values("pair")
    table = spark.sparkContext.broadcast((head["pair"].to_numpy(np.int64), head["n"].to_numpy(np.int64), head["best"].to_numpy(bool)))
    keep = [c for c in with_pairs.columns if c not in ("pairs", "times", "n_best", "count_sum", "rest", "rest_times")]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in with_pairs.select(*[F.col(f"`{c}`") for c in keep]).schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = table.value
        for batch in batches:
            lists = batch.column(batch.num_columns - 2)
            pairs, times = lists.flatten().to_numpy(), batch.column(batch.num_columns - 1).flatten().to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            there = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            at, many, who = at[there], times[there].astype(np.int64), owner[there]
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], who, many * best[at])
            np.add.at(sums[1], who, many * n[at])
            upto = np.concatenate(([0], np.cumsum(np.bincount(owner[~there], minlength=batch.num_rows)))).astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(upto), pa.array(x[~there])) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sums[0]), pa.array(sums[1]), *rest], names=[*keep, "n_best", "count_sum", "rest", "rest_times"])

    met = with_pairs.select(*[F.col(f"`{c}`") for c in keep], "pairs", "times").mapInArrow(tidy(run), ", ".join([*fields, "n_best bigint, count_sum bigint, rest array<bigint>, rest_times array<int>"]))
    if not low:
        return met.drop("rest", "rest_times")
    key = free_name(met, "_row")
    met = stored(met.withColumn(key, F.monotonically_increasing_id()))
    rest = met.select(key, F.inline(F.arrays_zip(F.col("rest").alias("pair"), F.col("rest_times").alias("times")))).join(counts.filter(F.col("n") < F.lit(2).cast("double") ** low), "pair")
    more = rest.groupBy(key).agg(F.sum(F.col("times") * F.col("best").cast("int")).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    added = {"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))}
    return met.join(more, key, "left").withColumns(added).drop(key, "rest", "rest_times", "_best", "_sum")


def align_corpus(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", most: int = BROADCAST_PAIRS) -> DataFrame:
    """Replace the text by COUNTS, groups_sha256, n_best and count_sum."""
    made = stored(aligned(docs, path_a, path_b, text_col))
    return with_corpus_counts(made, stored(pair_counts(made)), most)


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    made = align_corpus(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return made.select(F.col("doc_id").cast("bigint").alias("doc_id"), *COUNTS, "n_best", "count_sum", "groups_sha256")
