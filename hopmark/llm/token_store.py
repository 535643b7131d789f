"""Token-id files: fixed-width bit packing with block offsets (operator 4).

A shard file, little-endian throughout:

    bytes 0-7    magic b"HMBITS01"
    8-11         bits of an id, the fewest that hold the vocabulary
    12-15        ids of a block
    16-23        number of documents, D
    24-31        number of ids, T
    32-          D doc ids (int64; a null id is stored as the smallest int64), D + 1 id offsets (int64)
                 ceil(T / block) + 1 byte offsets of the packed blocks, from the start of the data (int64)
                 the packed blocks: each id takes `bits` bits, lowest first; each block ends on a byte

A block unpacks with three numpy calls, and any id is found from its number alone.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopmark.llm.bpe import RUN, TextEncoder
from hopmark.llm.common import bounded_batches, id_and_text, stored, tidy, work_dir

MAGIC, BLOCK, NULL_ID = b"HMBITS01", 4096, -(2**63)
#: Text bytes that aim for one shard; a task holds the packed ids of one.
SHARD_BYTES = 64 << 20


def min_bits(vocabulary: int) -> int:
    """Bits that hold ids below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as a stream of `bits` bits each, lowest first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    raw = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(raw.ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    raw = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = raw
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


class ShardWriter:
    """A shard file in the making: ids are packed as soon as they fill a block."""

    def __init__(self, bits: int, block: int = BLOCK):
        self.bits, self.block = bits, block
        self.doc_ids: list[int] = []
        self.counts: list[int] = []
        self.blocks: list[bytes] = []
        self.rest = np.zeros(0, np.uint32)

    def add(self, doc_ids: list[int | None], coded: list[bytes]) -> None:
        """Documents, given their ids as little-endian unsigned 32-bit integers."""
        self.doc_ids += [NULL_ID if i is None else i for i in doc_ids]
        self.counts += [len(c) // 4 for c in coded]
        ids = np.concatenate([self.rest, np.frombuffer(b"".join(coded), "<u4")])
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"an id needs more than {self.bits} bits")
        whole = len(ids) - len(ids) % self.block
        self.blocks += [pack(ids[i : i + self.block], self.bits) for i in range(0, whole, self.block)]
        self.rest = ids[whole:].copy()

    def parts(self) -> list[bytes]:
        """The pieces of the file, in order."""
        blocks = [*self.blocks, pack(self.rest, self.bits)] if len(self.rest) else self.blocks
        head = struct.pack("<8sIIqq", MAGIC, self.bits, self.block, len(self.doc_ids), sum(self.counts))
        tables = [np.array(self.doc_ids, "<i8"), np.concatenate([[0], np.cumsum(self.counts)]).astype("<i8"), np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<i8")]
        return [head, *(t.tobytes() for t in tables), *blocks]


def shard_bytes(doc_ids: list[int | None], coded: list[bytes], bits: int, block: int = BLOCK) -> bytes:
    """A shard file of documents."""
    own = ShardWriter(bits, block)
    own.add(doc_ids, coded)
    return b"".join(own.parts())


class Shard:
    """A shard file in memory, or mapped: documents and single ids by number."""

    def __init__(self, data: bytes | memoryview):
        self.data = memoryview(data)
        magic, self.bits, self.block, self.documents, self.tokens = struct.unpack_from("<8sIIqq", self.data)
        if magic != MAGIC:
            raise ValueError("not a shard of packed ids")
        at, n = 32, self.documents
        self.doc_ids = np.frombuffer(self.data, "<i8", n, at)
        self.offsets = np.frombuffer(self.data, "<i8", n + 1, at + 8 * n)
        self.block_offsets = np.frombuffer(self.data, "<i8", -(-self.tokens // self.block) + 1, at + 8 * (2 * n + 1))
        self.start = at + 8 * (2 * n + 1 + len(self.block_offsets))

    def range(self, first: int, last: int) -> np.ndarray:
        """Ids first to last - 1; unpacks only the blocks that hold them."""
        if first >= last:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, (last - 1) // self.block
        parts = [unpack(self.data[self.start + self.block_offsets[i] : self.start + self.block_offsets[i + 1]], self.bits, min(self.block, self.tokens - i * self.block)) for i in range(a, b + 1)]
        return np.concatenate(parts)[first - a * self.block : last - a * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.range(int(self.offsets[i]), int(self.offsets[i + 1]))


class LibraryEncoder(TextEncoder):
    """Ids by the tokenizers library; each distinct word of a text is handed to it once, in short runs, which it encodes faster than long ones."""

    cache, words = 600_000, 1 << 10

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__(path)
        del self.spec

    def encode_flat(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)


_ENCODERS: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


def write_file(uri: str, parts: list[bytes]) -> None:
    """Write under another name and rename: a task that runs twice leaves one whole file."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    part = f"{path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.part"
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(part) as out:
        for part_ in parts:
            out.write(part_)
    store.move(part, path)


def as_uri(path: str) -> str:
    return path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:"))


def write_shards(df: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Encode whole texts, append `end_id` to each, and write shard files in ascending order of id.

    Texts are dealt out by ranges of (id, hash of text) and sorted, so a repeated id is spread too and its rows stand in
    the order of their texts; null ids come first, null texts are empty. A task writes shards of about SHARD_BYTES of
    text, named by partition and number, so their names ascend as their ids do. Returns the manifest, written once: a row for each
    shard with shard (its name), part, number (in its part), documents, tokens. An empty table has no shards.
    """
    uri = as_uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, number = library_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        bits = min_bits(max(own.vocabulary, end_id + 1))
        end = end_id.to_bytes(4, "little")
        shard, ids, texts, size, waiting = ShardWriter(bits), [], [], 0, 0

        def encode() -> None:
            shard.add(ids, [c + end for c in own.encode(texts)])
            ids.clear()
            texts.clear()

        def flush() -> pa.RecordBatch:
            name = f"part-{part:08d}-{number:06d}.bits"
            write_file(f"{uri}/{name}", shard.parts())
            return pa.RecordBatch.from_pydict({"shard": [name], "part": pa.array([part], pa.int64()), "number": pa.array([number], pa.int64()), "documents": pa.array([len(shard.doc_ids)], pa.int64()), "tokens": pa.array([sum(shard.counts)], pa.int64())})

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t or "")
                size, waiting = size + len(texts[-1]), waiting + len(texts[-1])
                if waiting >= RUN:
                    encode()
                    waiting = 0
                if size >= SHARD_BYTES:
                    encode()
                    yield flush()
                    shard, number, size, waiting = ShardWriter(bits), number + 1, 0, 0
        encode()
        if shard.doc_ids:
            yield flush()

    bounded_batches(df.sparkSession)
    texts = id_and_text(df, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    ordered = by_ranges(texts).sortWithinPartitions("id", "tie", "text").select("id", "text")
    return stored(ordered.mapInArrow(tidy(run), "shard string, part long, number long, documents long, tokens long"), "manifest")


#: Partitions up to this number get their bounds from the ids alone.
BOUNDS = 1024


def by_ranges(texts: DataFrame) -> DataFrame:
    """Rows (id, text, tie) in partitions of ascending ranges of (id, tie), nulls first, as many as shuffles have.

    Quantiles of the ids are the bounds (null counts as the smallest); an id, or null, that is several bounds at once is dealt to the
    partitions between them by its ties. So only the ids are read for the bounds. With more than BOUNDS partitions, where comparing each
    row with every bound would cost more, Spark's own range exchange takes over, which samples whole rows; the rows' order is the same."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n > BOUNDS:
        return texts.repartitionByRange("id", "tie")
    key = F.coalesce("id", F.expr(f"cast({NULL_ID} as long)"))
    bounds = texts.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 100_000)).first()[0] if n > 1 else []
    if not bounds:
        return texts.repartition(1)
    held = F.array(*(F.expr(f"cast({b} as long)") for b in bounds))
    below, upto = F.size(F.filter(held, lambda b: b < key)), F.size(F.filter(held, lambda b: b <= key))
    share = F.col("tie") / F.lit(2.0**64) + F.lit(0.5)
    place = below + F.floor(share * (upto - below + 1)).cast("int")
    return texts.repartitionById(n, F.least(place, upto))


def shard_starts(manifest: DataFrame) -> tuple[DataFrame, int]:
    """shard, start (the number of ids before it), and how many shards there are.

    The driver gets one sum for each partition of the write; the shards of a partition are added up in a window of their own."""
    sums = sorted(tuple(r) for r in manifest.groupBy("part").agg(F.sum("tokens"), F.count("*")).collect())
    before = np.concatenate([[0], np.cumsum([n for _, n, _ in sums])]).tolist()
    spark = manifest.sparkSession
    bases = spark.createDataFrame([(p, int(b)) for (p, _, _), b in zip(sums, before, strict=False)], "part long, base long")
    earlier = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    inner = manifest.withColumn("inner", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))
    return inner.join(bases, "part").select("shard", (F.col("base") + F.col("inner")).alias("start")), sum(k for _, _, k in sums)


#: Tasks that read shards, at most.
READERS = 1 << 16


def read_shards(folder: str, starts: DataFrame, shards: int, digest: bool = False) -> DataFrame:
    """Every document of the shard files in starts (shard, start): doc_id, start (ids before it in all shards), ids (binary, unsigned
    32-bit); with digest, n_tokens and ids_crc32 (unsigned, of these bytes) in the place of ids. A task opens the files that its rows name, so
    what an attempt that was replaced has left is never read."""
    uri = as_uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{path}/{name}") as file:
                    shard = Shard(file.read_buffer())
                step = max(1, shard.documents * (2 << 20) // max(1, 4 * shard.tokens))
                for i in range(0, shard.documents, step):
                    j = min(i + step, shard.documents)
                    ids = memoryview(shard.range(int(shard.offsets[i]), int(shard.offsets[j])).astype("<u4", copy=False)).cast("B")
                    at = (4 * (shard.offsets[i : j + 1] - shard.offsets[i])).tolist()
                    parts = [ids[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
                    rest = [pa.array([len(x) // 4 for x in parts], pa.int64()), pa.array(map(zlib.crc32, parts), pa.int64())] if digest else [pa.array(map(bytes, parts), pa.binary())]
                    doc_ids = pa.array([None if d == NULL_ID else d for d in shard.doc_ids[i:j].tolist()], pa.int64())
                    yield pa.RecordBatch.from_arrays([doc_ids, pa.array(shard.offsets[i:j] + start, pa.int64()), *rest], names)

    schema = "doc_id long, start long, " + ("n_tokens long, ids_crc32 long" if digest else "ids binary")
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return starts.select("shard", "start").repartition(max(1, min(shards, READERS))).mapInArrow(tidy(run), schema)


def tokenize_to_files(df: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Write the shard files of a table and read them back, as read_shards(). Without a folder, they go to one in the
    shared folder. Empty tables give no rows."""
    folder = folder or work_dir(df.sparkSession, "token-ids")
    starts, shards = shard_starts(write_shards(df, folder, tokenizer_path, id_col, text_col))
    return read_shards(folder, starts, shards, digest)
