"""Shared pieces: text batches, vectorised word hashing, working folders.

Every operator first selects the id and text columns that it needs under internal names, so further columns of the
input, whatever their names, cannot clash with its own.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch that goes to a Python worker; together they bound a worker's memory.
ARROW_ROWS, ARROW_BYTES = 2048, 16 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of this session: very long texts then travel in batches of their own."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


#: Bits of the map by which rows that a key may concern are told from all others: 4 MB, whatever the number of keys.
MAP_BITS = 1 << 25


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, longer by underscores where df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    return [next(n + "_" * k for k in range(len(taken) + 1) if n + "_" * k not in taken) for n in names]


def parted_by_keys(df: DataFrame, key: F.Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose key may be in the one column of keys, and those whose key is not, with df's columns.

    A map of MAP_BITS hashed keys tells them apart; it is all that is broadcast, so later joins shuffle the first part only. Keys beyond
    what the map can tell apart make that part larger, to the whole of df at worst, and lose nothing."""
    at, bucket, bits = free_names(df, "map_at", "map_bucket", "map_bits")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
    found = keys.toDF("key").select(place("key").alias("at")).groupBy(F.bitmap_bucket_number("at").alias(bucket))
    found = stored(found.agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias(bits)), "map", keep=True)
    marked = df.withColumn(at, place(key)).join(F.broadcast(found), F.bitmap_bucket_number(at) == F.col(bucket), "left")
    byte = f"cast(conv(hex(substring({bits}, cast(bitmap_bit_position({at}) div 8 as int) + 1, 1)), 16, 10) as bigint)"
    hit = F.expr(f"coalesce(getbit({byte}, cast(bitmap_bit_position({at}) % 8 as int)) = 1, false)")
    return tuple(marked.where(c).drop(at, bucket, bits) for c in (hit, ~hit))


def without_keys(df: DataFrame, key: F.Column, keys: DataFrame) -> DataFrame:
    """The rows of df whose key is not in the one column of keys; df's own columns may have any names."""
    (name,) = free_names(df, "key")
    some, others = parted_by_keys(df, key, keys)
    return others.union(some.join(keys.toDF(name).distinct(), key == F.col(name), "left_anti"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; where it is unset, one under the warehouse is set (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """What stored() writes within is deleted at the end, but for tables to keep."""
    paths: list[str] = []
    before = _passing.set(paths)
    try:
        yield
    finally:
        _passing.reset(before)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write to the shared folder and read again: computed once, and safe from the loss of executors."""
    path = work_dir(df.sparkSession, name)
    if not keep and (paths := _passing.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8; nulls are empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same over batches, giving freed memory back at the end of a task: workers live on, and share an executor's limit."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return whole


def pieces(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Ids and UTF-8 texts of an (id, text) batch, in runs of about `limit` bytes; a longer text is a run of its own."""
    texts, first, size = utf8(batch.column(1)), 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield batch.column(0).slice(first, i - first), texts[first:i]
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield batch.column(0).slice(first), texts[first:]


#: Classes of bytes: 0 separates words; words are digits, letters and all bytes of non-ASCII characters.
WORD_BYTES = np.zeros(256, np.uint8)
WORD_BYTES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
#: The same, with runs of ASCII punctuation as words of their own (class 2).
TOKEN_BYTES = WORD_BYTES.copy()
TOKEN_BYTES[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 2

_MULTIPLY, _LONG = np.uint64(0x9E3779B97F4A7C15), 256
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def hash_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of data[start : start + length], eight bytes a round for all spans at once."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.lib.stride_tricks.as_strided(padded.view()[:8].view(np.uint64), (len(padded) - 7,), (1,))
    with np.errstate(over="ignore"):
        h = (lengths.astype(np.uint64) + np.uint64(seed)) * _MULTIPLY
        live = np.flatnonzero(lengths <= _LONG)
        at, left = starts[live], lengths[live]
        while len(live):
            v = (h[live] ^ (lanes[at] & _MASKS[np.minimum(left, 8)])) * _MULTIPLY
            h[live] = v ^ (v >> np.uint64(29))
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    for i in np.flatnonzero(lengths > _LONG):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + lengths[i]].tobytes(), seed)
    return h


def same_spans(one: np.ndarray, at: np.ndarray, other: np.ndarray, place: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether one[at : at + length] and other[place : place + length] are the same bytes, for all spans at once."""
    lanes = []
    for data in (one, other):
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        lanes.append(np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(padded) - 7,), (1,)))
    same = np.ones(len(at), bool)
    live = np.flatnonzero(lengths > 0)
    shift = 0
    while len(live):
        masks = _MASKS[np.minimum(lengths[live] - shift, 8)]
        equal = (lanes[0][at[live] + shift] & masks) == (lanes[1][place[live] + shift] & masks)
        same[live[~equal]] = False
        shift += 8
        live = live[equal & (lengths[live] > shift)]
    return same


class Words:
    """The words of a run of texts: hashes, and where each text's words begin."""

    def __init__(self, texts: list[bytes], classes: np.ndarray = WORD_BYTES, lower: bool = True):
        self.data = np.frombuffer(b"\n".join(x.lower() if lower else x for x in texts) + b"\n", np.uint8)
        kinds = classes[self.data]
        edge = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
        edge = np.concatenate([[0], edge]).astype(np.int64)
        ends = np.concatenate([edge[1:], [len(kinds)]])
        keep = kinds[edge] > 0
        self.starts, self.lengths = edge[keep], (ends - edge)[keep]
        sizes = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
        self.first = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum(sizes)]))
        self.counts = np.diff(self.first)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.lengths, seed)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i] + self.lengths[i]].tobytes()

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def sums_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over the words first[i] to first[i + 1]."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]
