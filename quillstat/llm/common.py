"""Session helpers and vectorised byte-level text primitives shared by the operators here."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word separators, space and \t\n\v\f\r.
SEPARATORS = (9, 10, 11, 12, 13, 32)
SEP = np.zeros(256, bool)
SEP[list(SEPARATORS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text handled at once inside a task; a longer single text is handled alone and whole.
CHUNK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
#: One random odd word per byte value; the same in every worker because the seed is fixed.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def session_defaults(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds (rows and bytes) and make sure a checkpoint folder exists.

    The folder is the one the cluster names in spark.checkpoint.dir; only where that is unset is a
    local default taken.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a session on one machine gets a local one; on a
    cluster, where executors would not see that, it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "/tmp/quillstat-checkpoints"


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    session_defaults(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, made: list[str] | None = None) -> DataFrame:
    """Cut lineage with a table in the shared folder. Unlike a checkpoint, it also forgets what the planner knew of
    the columns, which in a loop of joins grows from round to round until planning takes longer than the work. Its path
    is added to `made`, for who discards it in the end."""
    session_defaults(df.sparkSession)
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


_resident: dict[str, tuple] = {}


def resident(name: str, key: tuple, make: Callable):
    """What an operator keeps in a worker from task to task. Spark's workers outlive a stage, so that only the operator
    in use keeps anything: another name drops what was kept."""
    if _resident.get(name, (None,))[0] != key:
        _resident.clear()
        _resident[name] = (key, make())
    return _resident[name][1]


def tidy(run: Callable) -> Callable:
    """The same function over batches; in the end it gives freed memory back to the system, as the worker lives on."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return tidied


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    session_defaults(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: At most so many ids (8 bytes each) are broadcast to pick rows; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def few_parts(df: DataFrame, rows: int) -> DataFrame:
    """Small intermediate tables in as few partitions as their rows need."""
    return df.coalesce(1 + rows // 100_000) if rows <= BROADCAST_IDS else df


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """A join side of so many rows: broadcast while it is surely small, else shuffled."""
    return F.broadcast(df) if rows <= BROADCAST_IDS // 2 else df


def semi_by_id(df: DataFrame, ids: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """Rows of df whose id is (left_semi) or isn't (left_anti) among `ids`; texts are shuffled only for many ids."""
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, column, how).select(*df.columns)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The id of a row, or where it is null a key from its text, after all usual ids; equal texts have equal keys."""
    return F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.xxhash64(f"`{text_col}`").bitwiseAND(F.lit(2**62 - 1)) + F.lit(2**62))


def free_name(df: DataFrame, name: str = "_key") -> str:
    """A column name that df does not have."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(which: str, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        step = np.uint64(_BASE if which == "up" else _INVERSE)
        have = np.full(max(n, 1 << 16), step, np.uint64)
        have[0] = 1
        _powers[which] = have = np.cumprod(have)
    return have[:n]


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes stay within `most`, or one row that alone exceeds it."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """Words of the texts `i..j` of a column: spans in `b`, the text of each, and 64-bit hashes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, i: int, j: int, lower: bool = False):
        self.b = raw[offsets[i] : offsets[j]]
        self.at = offsets[i : j + 1] - offsets[i]
        self.n_docs = j - i
        b, at = self.b, self.at
        inside = ~SEP[b]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edges = at[:-1][at[:-1] < len(b)]
        first[edges] = inside[edges]
        ends = at[1:][at[1:] > 0] - 1
        last[ends] = inside[ends]
        self.inside = inside
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(at[1:], self.start, side="right")
        self.counts = np.bincount(self.doc, minlength=self.n_docs)
        self.first_word = np.concatenate(([0], np.cumsum(self.counts)))
        self._lower = lower
        self._sums = None

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self._sums is None:
            value = BYTE_VALUE[LOWER[self.b]] if self._lower else BYTE_VALUE[self.b]
            self._sums = np.zeros(len(self.b) + 1, np.uint64)
            np.cumsum(value * _power("up", len(self.b)), out=self._sums[1:])
        h = (self._sums[end] - self._sums[start]) * _power("down", len(self.b) + 1)[start]
        return mix(h + (end - start).astype(np.uint64))

    @property
    def hash(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array over each text."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.at[1:]] - total[self.at[:-1]]


#: One odd multiplier per place in a five-word window.
PLACE = _rng.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def windows(words: Words, size: int = 5, whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first word) of every window of `size` words that lies within one text.

    With whole_if_short, a text of 1 to size - 1 words gives its whole sequence as one window.
    """
    h, doc, n = words.hash, words.doc, len(words.doc)
    if n >= size:
        at = np.flatnonzero(doc[: n - size + 1] == doc[size - 1 :])
        key = np.zeros(len(at), np.uint64)
        for k in range(size):
            key += mix(h[at + k] * PLACE[k])
    else:
        at, key = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    key, own = mix(key), doc[at]
    if whole_if_short and len(short := np.flatnonzero((words.counts > 0) & (words.counts < size))):
        total = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = words.counts[short] > k
            total[has] += mix(h[words.first_word[short[has]] + k] * PLACE[k])
        more = mix(total + words.counts[short].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        key, own, at = np.concatenate((key, more)), np.concatenate((own, short)), np.concatenate((at, words.first_word[short]))
        order = np.argsort(own, kind="stable")
        key, own, at = key[order], own[order], at[order]
    return key, own, at


def in_doc(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A key that also tells the texts of a chunk apart."""
    return mix(key + doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
