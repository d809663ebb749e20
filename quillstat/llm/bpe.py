"""Byte-level BPE encoding and decoding.

Pieces of equal byte length sit in one numpy matrix. Each round, every row merges its leftmost pair of least
rank: pair ranks come from an open-addressed hash table, the row is compacted by one place, and only the two
pairs beside the merge are looked up again. A piece longer than LONG_PIECE bytes is merged on a heap instead,
by the same rule, because a matrix row costs the square of its length.

A null or empty text has no ids and decodes to no bytes. Texts are encoded whole; repeated rows get equal
results; an empty table gives an empty one. Extra columns are carried through, and a column that bears a
result's name is replaced.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.llm.common import chunks, read_table, resident, session_defaults, tidy, utf8_parts

LONG_PIECE = 256
#: Words that a worker remembers; when full, it forgets all and goes on.
CACHE_WORDS = 200_000
NO_RANK = np.int32(2**31 - 1)

#: The characters with the Unicode property White_Space.
_SPACE = r"\t-\r \x85\xa0  -     　"
#: Where the split pattern always cuts: it never matches across these parts, whatever stands beside them.
_PARTS = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class ByteBpe:
    """Ranks of byte strings, with the merge and lookup tables made from them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_len = np.array([len(t) for t in tokens], np.int64)
        self.token_at = np.concatenate(([0], np.cumsum(self.token_len)))[:-1]
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        pairs, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs.append(left << 32 | right)
                    values.append(rank)
        self._fill(np.array(pairs, np.uint64), np.array(values, np.int32))
        self.known: dict[str, bytes] = {}

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with linear probing; a quarter full at most."""
        self.bits = max(4, int(4 * max(len(keys), 1) - 1).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, 2**64 - 1, np.uint64)
        self.values = np.full(1 << self.bits, NO_RANK, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == np.uint64(2**64 - 1)
            _, first = np.unique(at[left][free], return_index=True)
            put = left[free][first]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NO_RANK if they don't merge; an id under 0 is padding."""
        key = left.astype(np.int64).astype(np.uint64) << np.uint64(32) | right.astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF)
        out = np.full(key.shape, NO_RANK, np.int32).ravel()
        todo = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        key = key.ravel()[todo]
        at = self._slot(key)
        while len(todo):
            there = self.keys[at]
            hit = there == key
            out[todo[hit]] = self.values[at[hit]]
            more = ~hit & (there != np.uint64(2**64 - 1))
            todo, key, at = todo[more], key[more], (at[more] + 1) & self.mask
        return out.reshape(left.shape)

    def merge_matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of one byte length (2 at least)."""
        n, width = len(pieces), len(pieces[0])
        ids = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8).reshape(n, width)]
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        row, length = np.arange(n), np.full(n, width)
        done: list[np.ndarray] = [ids[0]] * n
        while len(row):
            best = ranks.argmin(1)  # the first of equals: the leftmost
            low = ranks[np.arange(len(row)), best]
            stop = low == NO_RANK
            for k in np.flatnonzero(stop):
                done[row[k]] = ids[k, : length[k]]
            go = ~stop
            if not go.any():
                break
            ids, ranks, row, length, best, low = ids[go], ranks[go], row[go], length[go] - 1, best[go], low[go]
            here, cols = np.arange(len(row)), np.arange(ids.shape[1] - 1)
            ids[here, best] = low
            ids = np.take_along_axis(ids, cols + (cols > best[:, None]), 1)
            ids[cols >= length[:, None]] = -1
            if ids.shape[1] == 1:
                for k in range(len(row)):
                    done[row[k]] = ids[k]
                break
            ranks = np.take_along_axis(ranks, cols[:-1] + (cols[:-1] > best[:, None]), 1)
            at = np.minimum(best, ids.shape[1] - 2)
            ranks[here, at] = self.pair_ranks(ids[here, at], ids[here, at + 1])
            at = np.maximum(best - 1, 0)
            ranks[here, at] = self.pair_ranks(ids[here, at], ids[here, at + 1])
        return done

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, on a heap of (rank, place) over a linked list."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        token = [bytes([b]) for b in piece]
        first = self.pair_ranks(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(r), k) for k, r in enumerate(first) if r != NO_RANK]
        heapq.heapify(heap)
        alive = [True] * n

        def push(k: int) -> None:
            if k >= 0 and after[k] >= 0 and (r := self.ranks.get(token[k] + token[after[k]])) is not None:
                heapq.heappush(heap, (r, k))

        while heap:
            r, k = heapq.heappop(heap)
            if not alive[k] or (b := after[k]) < 0 or self.ranks.get(token[k] + token[b]) != r:
                continue
            token[k], ids[k] = token[k] + token[b], r
            alive[b], after[k] = False, after[b]
            if after[k] >= 0:
                before[after[k]] = k
            push(before[k])
            push(k)
        return np.array([x for x, ok in zip(ids, alive, strict=True) if ok], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids, as bytes of int32, of each distinct piece."""
        out: dict[bytes, bytes] = {}
        buckets: dict[int, list[bytes]] = {}
        for p in dict.fromkeys(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[p] = np.int32(whole).tobytes()
            elif len(p) > LONG_PIECE:
                out[p] = self.merge_long(p).tobytes()
            else:
                buckets.setdefault(len(p), []).append(p)
        for width, same in buckets.items():
            step = max(1, 400_000 // width)
            for k in range(0, len(same), step):
                part = same[k : k + step]
                out.update((p, i.tobytes()) for p, i in zip(part, self.merge_matrix(part), strict=True))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, their n + 1 offsets)."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        parts = [_PARTS.findall(t) for t in texts]
        new = set().union(*parts).difference(self.known) if parts else set()
        if new:
            split = {w: [p.encode() for p in self.pattern.findall(w)] for w in new}
            merged = self.encode_pieces([p for ps in split.values() for p in ps])
            self.known.update((w, b"".join([merged[p] for p in ps])) for w, ps in split.items())
        known = self.known
        rows = [b"".join([known[w] for w in p]) for p in parts]
        at = np.concatenate(([0], np.cumsum([len(r) // 4 for r in rows]))).astype(np.int64)
        return np.frombuffer(b"".join(rows), np.int32), at

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts one after another, their n + 1 offsets)."""
        length = self.token_len[ids]
        ends = np.concatenate(([0], np.cumsum(length)))
        take = np.arange(ends[-1]) + np.repeat(self.token_at[ids] - ends[:-1], length)
        return self.token_bytes[take], ends[at]


def tokenizer(path: str, pattern: str) -> ByteBpe:
    """Read once in each worker; the file must be at this path on every machine."""

    def read() -> ByteBpe:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        return ByteBpe(ranks, pattern)

    return resident("bpe", (path, pattern), read)


def _with(df: DataFrame, drop: tuple[str, ...], last: str) -> tuple[DataFrame, list[str]]:
    keep = [c for c in df.columns if c not in drop]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{last}`").alias("__in"))
    return source, [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]


def round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Replace the text by `ids` (array<int>) and what they decode to, `decoded` (binary), in one pass."""
    session_defaults(df.sparkSession)
    source, fields = _with(df, ("ids", "decoded", text_col), text_col)
    names = [*source.columns[:-1], "ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in batches:
            _, offsets = utf8_parts(texts := batch.column(batch.num_columns - 1))
            for i, j in chunks(offsets):
                ids, at = own.encode([t or "" for t in texts[i:j].to_pylist()])
                raw, ends = own.decode(ids, at)
                decoded = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(c[i:j] for c in batch.columns[:-1]), lists, decoded], names=names)

    return source.mapInArrow(tidy(run), ", ".join([*fields, "ids array<int>", "decoded binary"]))


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Replace the text by `ids`."""
    return round_trip(df, path, pattern, text_col).drop("decoded")


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Replace ids by `decoded` bytes; null ids decode to no bytes."""
    session_defaults(df.sparkSession)
    source, fields = _with(df, ("decoded", ids_col), ids_col)
    names = [*source.columns[:-1], "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in batches:
            rows = [np.array(r or [], np.int32) for r in batch.column(batch.num_columns - 1).to_pylist()]
            at = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
            raw, ends = own.decode(np.concatenate([np.zeros(0, np.int32), *rows]), at)
            decoded = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], decoded], names=names)

    return source.mapInArrow(tidy(run), ", ".join([*fields, "decoded binary"]))


def digests(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(round_trip(read_table(spark, sf_dir, "documents").select("doc_id", "text"), *public_vocabulary()))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: each document's ids with the digests of ids and decoded text."""
    session_defaults(spark)
    made = round_trip(docs.select("doc_id", "text", "lang", "source"), *public_vocabulary())
    return digests(made)
