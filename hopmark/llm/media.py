"""Media columns: ISO base media files, written, walked and described without decoding payloads (operator 5)."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopmark.llm.common import bounded_batches, id_and_text, pieces, tidy

#: Bytes of a sample, samples of a chunk, samples from one key sample to the next, samples a second.
SAMPLE, CHUNK, KEY_EVERY, TIMESCALE = 192, 16, 8, 100
#: Boxes that hold boxes, with the bytes of their own fields that come first.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"dinf": 0, b"stbl": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"meta": 4}
CODEC = b"twos"  # sample entry for plain samples


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body if len(body) + 8 < 2**32 else struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def mux(payload: bytes, sample: int = SAMPLE, chunk: int = CHUNK, key_every: int = KEY_EVERY) -> bytes:
    """A file with one sound track whose samples are `payload` in pieces of `sample` bytes; no time stamps, so equal
    payloads give equal files."""
    n, rest = divmod(len(payload), sample)
    if rest or not n:
        raise ValueError(f"the payload must be a positive multiple of {sample} bytes")
    chunks = -(-n // chunk)
    last = n - (chunks - 1) * chunk
    runs = [(1, chunk, 1)] * (chunks > 1) + [(chunks, last, 1)] * (last != chunk or chunks == 1)
    keys = np.arange(1, n + 1, key_every, dtype=">u4")
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2")
    entry = box(CODEC, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))

    def moov(base: int) -> bytes:
        at = base + np.arange(chunks, dtype=np.int64) * chunk * sample
        offsets = full(b"stco", struct.pack(">I", chunks), at.astype(">u4").tobytes()) if base + len(payload) < 2**32 else full(b"co64", struct.pack(">I", chunks), at.astype(">u8").tobytes())
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", sample, n)),
            offsets,
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"smhd", bytes(4)), dinf, stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0)), full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8), flags=7)
        mvhd = full(b"mvhd", struct.pack(">IIII", 0, 0, TIMESCALE, n), struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = 8 if len(payload) + 8 < 2**32 else 16
    size = len(moov(len(ftyp)))
    return ftyp + moov(len(ftyp) + size + head) + box(b"mdat", payload)


class Box(NamedTuple):
    path: tuple[bytes, ...]
    start: int  # of the body
    end: int


#: Boxes nest so deep at most; what is deeper is not walked.
DEPTH = 64


def walk(data: bytes | memoryview) -> Iterator[Box]:
    """All boxes in the order of the file, each before those within it. A level ends at a box that does not fit."""
    open_: list[tuple[int, int, tuple[bytes, ...]]] = [(0, len(data), ())]  # levels: where the next box begins, the end, the path
    while open_:
        start, end, path = open_.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                continue
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            continue
        own = (*path, kind)
        yield Box(own, start + head, start + size)
        open_.append((start + size, end, path))
        if kind in CONTAINERS and len(own) < DEPTH:
            open_.append((start + head + CONTAINERS[kind], start + size, own))


class Track(NamedTuple):
    codec: str
    timescale: int
    duration: int  # in units of the timescale, summed from the sample table
    offsets: np.ndarray  # of each sample in the file
    sizes: np.ndarray
    keys: np.ndarray  # numbers of the key samples, from 0


def _table(data: bytes | memoryview, at: int, columns: int, kind: str = ">u4") -> np.ndarray:
    n = struct.unpack_from(">I", data, at + 4)[0]
    return np.frombuffer(data, kind, n * columns, at + 8).astype(np.int64).reshape(n, columns)


def tracks(data: bytes | memoryview) -> list[Track]:
    """The tracks of a file, from its sample tables; payloads are not read. A truncated table raises."""
    found: list[dict] = []
    for b in walk(data):
        if b.path[-1] == b"trak":
            found.append({})
        elif found and b.path[:-1] == (b"moov", b"trak", b"mdia", b"minf", b"stbl") or found and b.path[-1] == b"mdhd":
            found[-1][b.path[-1]] = b
    out = []
    for t in found:
        if not {b"mdhd", b"stsd", b"stts", b"stsc"} <= t.keys():
            continue
        version = data[t[b"mdhd"].start]
        timescale = struct.unpack_from(">I", data, t[b"mdhd"].start + (20 if version == 1 else 12))[0]
        codec = bytes(data[t[b"stsd"].start + 12 : t[b"stsd"].start + 16]).decode("latin-1")
        same, n = struct.unpack_from(">II", data, t[b"stsz"].start + 4)
        if same * n > len(data):
            raise ValueError("more samples than the file can hold")
        sizes = np.full(n, same, np.int64) if same else np.frombuffer(data, ">u4", n, t[b"stsz"].start + 12).astype(np.int64)
        chunk_at = _table(data, t[b"stco"].start, 1).ravel() if b"stco" in t else _table(data, t[b"co64"].start, 1, ">u8").ravel()
        runs = _table(data, t[b"stsc"].start, 3)
        each = np.zeros(len(chunk_at), np.int64)
        for i, (first, per, _) in enumerate(runs):
            each[first - 1 : runs[i + 1][0] - 1 if i + 1 < len(runs) else None] = per
        chunk = np.repeat(np.arange(len(chunk_at)), each)[:n]
        before = np.concatenate([[0], np.cumsum(sizes)])
        first_in = np.concatenate([[0], np.cumsum(each)])[:-1]
        offsets = chunk_at[chunk] + before[:n] - before[np.minimum(first_in, n)][chunk]
        stts = _table(data, t[b"stts"].start, 2)
        keys = _table(data, t[b"stss"].start, 1).ravel() - 1 if b"stss" in t else np.arange(n)
        out.append(Track(codec, int(timescale), int((stts[:, 0] * stts[:, 1]).sum()), offsets, sizes, keys))
    return out


def payload_of(data: bytes | memoryview, track: Track) -> bytes:
    """The samples of a track, in order; neighbouring samples are read in one piece."""
    if not len(track.offsets):
        return b""
    ends = track.offsets + track.sizes
    cut = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(ends)]]) - 1
    return b"".join(bytes(data[a:b]) for a, b in zip(track.offsets[first].tolist(), ends[last].tolist(), strict=True))


def feature(track: Track) -> str:
    """Codec, duration, and a digest of the byte ranges of the key samples."""
    ranges = np.column_stack([track.offsets[track.keys], track.sizes[track.keys]]).astype("<i8")
    shown = ",".join(f"{a}+{n}" for a, n in ranges[:2].tolist())
    return f"codec={track.codec};timescale={track.timescale};duration={track.duration};samples={len(track.sizes)};keys={len(ranges)};first={shown};ranges={zlib.crc32(ranges.tobytes()):08x}"


def padded(text: bytes, unit: int = SAMPLE) -> bytes:
    return text + b" " * (max(1, -(-len(text) // unit)) * unit - len(text))


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as media files: doc_id, n_bytes (of the text), media (binary).

    A text is UTF-8, filled with spaces to a positive multiple of SAMPLE bytes; null and empty texts are one sample of
    spaces. One row for each row; equal texts give equal files. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in pieces(batch):
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    bounded_batches(df.sparkSession)
    return id_and_text(df, id_col, text_col).mapInArrow(tidy(run), "doc_id long, n_bytes long, media binary")


PROBED = "doc_id long, n_bytes long, codec string, timescale long, duration long, key_ranges array<struct<start:long,size:long>>, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def probe(media: DataFrame) -> DataFrame:
    """Walk the boxes of each media file: codec, timescale, duration and key_ranges of its first track, and digests of
    the file and of its samples read back. A file without a readable track has null in these columns; null media stay."""
    names = [f.split(" ")[0] for f in ["doc_id", "n_bytes", "codec", "timescale", "duration", "key_ranges", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())])), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def one(data: bytes | None) -> list:
        if data is None:
            return [None] * 10
        tail = [len(data), hashlib.sha256(data).hexdigest()]
        try:
            found = tracks(data)
            t = found[0]
            payload = payload_of(data, t)
        except (IndexError, KeyError, ValueError, struct.error):
            return [None] * 7 + [*tail, None]
        keys = [{"start": int(t.offsets[k]), "size": int(t.sizes[k])} for k in t.keys]
        return [t.codec, t.timescale, t.duration, keys, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *tail, feature(t)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(x) for x in batch.column(2).to_pylist()]
            columns = [*zip(*rows, strict=True)] if rows else [[]] * 10
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(c), k) for c, k in zip(columns, kinds[2:], strict=True))], names)

    bounded_batches(media.sparkSession)
    return media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_bytes").cast("long").alias("n_bytes"), "media").mapInArrow(tidy(run), PROBED)


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts to media files and back to their description."""
    return probe(to_media(df, id_col, text_col))
