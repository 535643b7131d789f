"""Synthetic sequences of known strategies, with losses and reordering, and measurement-shaped rows from keys.

All randomness is a hash of (seed, row, place), so rows do not depend on partitions and survive recomputation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopmark.functions.labels import CLUSTER_GAP, MASS, MAX_CLUSTERS, MAX_INC, MODULUS, Config

EXACT = ("REFLECTION", "CONSTANT", "PER_DESTINATION", "PER_CONNECTION", "SINGLE", "PER_BUCKET")
TRIVIAL = ("REFLECTION", "CONSTANT")
FIRST_ADDRESS = 198 * 2**24 + 18 * 2**16 + 1


def one(strategy: str, config: Config, rng: np.random.Generator) -> np.ndarray:
    """A complete sequence of a strategy."""
    n, c, place = config.length, config.connections, np.arange(config.length)
    start = rng.integers(0, MODULUS, max(c, 2))
    if strategy == "REFLECTION":
        v = np.array(config.pattern) + start[0]
    elif strategy == "CONSTANT":
        v = np.full(n, start[0])
    elif strategy == "PER_DESTINATION":
        v = start[place % 2] + place // 2
    elif strategy == "PER_CONNECTION":
        v = start[place % c] + place // c
    elif strategy == "SINGLE":
        v = start[0] + np.concatenate([[0], np.cumsum(rng.integers(1, MAX_INC + 1, n - 1))])
    elif strategy == "PER_BUCKET":
        own = np.vstack([np.zeros((1, c), np.int64), np.cumsum(rng.integers(1, MAX_INC + 1, (config.requests - 1, c)), axis=0)])
        v = (start[:c] + own).ravel()
    elif strategy == "MULTI":
        k = int(rng.integers(2, MAX_CLUSTERS + 1))
        least = 2 * CLUSTER_GAP + 1
        extra = np.floor(rng.dirichlet(np.ones(k)) * (MODULUS - k * least)).astype(np.int64)
        starts = start[0] + np.concatenate([[0], np.cumsum(least + extra)[:-1]])
        which = rng.permutation(np.concatenate([np.arange(k), rng.integers(0, k, n - k)]) if n >= k else rng.permutation(k)[:n])
        v = starts[which] + rng.integers(0, CLUSTER_GAP + 1, n)
    elif strategy == "RANDOM":
        v = rng.integers(0, MODULUS, n)
    else:
        raise ValueError(f"no generator for {strategy}")
    return v % MODULUS


def impaired(v: np.ndarray, rng: np.random.Generator, loss: float = 0.2, reorder: float = 0.2) -> tuple[np.ndarray, np.ndarray, int]:
    """With losses (-1), and with losses and some of the values present exchanged; how many were."""
    lost = rng.choice(len(v), round(len(v) * loss), replace=False)
    lossy = v.copy()
    lossy[lost] = -1
    here = np.flatnonzero(lossy >= 0)
    moved = rng.choice(here, round(len(here) * reorder), replace=False)
    mixed = lossy.copy()
    new = rng.permutation(lossy[moved])
    mixed[moved] = np.roll(new, 1) if len(moved) > 1 and (new == lossy[moved]).all() else new
    return lossy, mixed, len(moved)


def text(v: np.ndarray) -> str:
    return ",".join("-" if x < 0 else str(x) for x in v.tolist())


def generate(spark: SparkSession, strategies: tuple[str, ...], each: int, config: Config = MASS, seed: int = 42, trivial: int | None = None) -> DataFrame:
    """SAMPLE_ID, IP_ADDR, GENERATOR_STRATEGY, IPID_SEQUENCE (complete), LOSSY_SEQUENCE, REORDERED_SEQUENCE, LOSS_COUNT,
    REORDERED_COUNT: `each` rows of each strategy (`trivial` of REFLECTION and CONSTANT)."""
    rows, at = None, 0
    for s in strategies:
        n = min(each, trivial) if trivial and s in TRIVIAL else each
        own = spark.range(at, at + n).select("id", F.lit(s).alias("s"))
        rows, at = own if rows is None else rows.union(own), at + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rng = np.random.default_rng((seed, i))
                v = one(s, config, rng)
                lossy, mixed, moved = impaired(v, rng)
                ip = FIRST_ADDRESS + i
                out.append((f"{s}-{i}", ".".join(str(ip >> k & 255) for k in (24, 16, 8, 0)), s, text(v), text(lossy), text(mixed), int((lossy < 0).sum()), moved))
            yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r, strict=True)) for r in out], pa.schema([(n, pa.int32() if n.endswith("COUNT") else pa.string()) for n in NAMES]))

    return rows.mapInArrow(run, ", ".join(f"{n} {'int' if n.endswith('COUNT') else 'string'}" for n in NAMES))


NAMES = ("SAMPLE_ID", "IP_ADDR", "GENERATOR_STRATEGY", "IPID_SEQUENCE", "LOSSY_SEQUENCE", "REORDERED_SEQUENCE", "LOSS_COUNT", "REORDERED_COUNT")


def with_timestamps(df: DataFrame, config: Config, rt_based: bool) -> DataFrame:
    """Send and receive times in microseconds: RT-based runs send 250 after the last reply, others every 20,000; a reply
    takes 2,000 and 100 more for each further connection. In closed form."""
    c, n = config.connections, config.length
    wait = lambda i: f"({i} * 2250 + 100 * (({i} div {c}) * {c * (c - 1) // 2} + (({i} % {c}) * (({i} % {c}) - 1)) div 2))"
    send = f"transform(sequence(0L, {n - 1}L), i -> 1700000000000000L + {wait('i') if rt_based else 'i * 20000'})"
    receive = f"transform({send}, (t, i) -> t + 2000 + (i % {c}) * 100)"
    return df.selectExpr("*", f"array_join({send}, ',') AS SEND_TIMESTAMP_SEQUENCE", f"array_join({receive}, ',') AS RECEIVE_TIMESTAMP_SEQUENCE")


def value_sql(div: str, pattern: str) -> str:
    """The value at place i of the sequence of key k, in the SQL of an engine with this whole division."""
    return (
        f"CASE k % 8 WHEN 0 THEN {pattern} + 7919 * k WHEN 1 THEN 7919 * k WHEN 2 THEN 7919 * k + 30011 * (i % 2) + (i {div} 2) "
        f"WHEN 3 THEN 7919 * k + 16001 * (i % 4) + (i {div} 4) WHEN 4 THEN 7919 * k + i * (1 + k % 21845) "
        f"WHEN 5 THEN 7919 * k + 17011 * (i % 4) * (i % 4) + (i {div} 4) * (2 + (k + i % 4) % 20000) "
        f"WHEN 6 THEN 7919 * k + 9000 * ((i * 7 + k) % 5) + (i * 31 + k) % 800 "
        f"ELSE ((k * 7919 + i * 104729 + 12345) % 2147483647 * 48271) % 2147483647 END % 65536"
    )


ADDRESS = "concat('10.', cast((k {div} 65536) % 256 as {s}), '.', cast((k {div} 256) % 256 as {s}), '.', cast(k % 256 as {s}))"


def from_keys(keys: DataFrame, config: Config, times: bool = False, lossy: bool = True) -> DataFrame:
    """Measurement-shaped rows from a long column k: k, IP_ADDR, IPID_SEQUENCE, on request SEND_TIMESTAMP_SEQUENCE; complete
    if not lossy."""
    ids = "element_at(array(" + ", ".join(f"{x}L" for x in config.request_ip_ids) + f"), cast(i % {len(config.request_ip_ids)} as int) + 1)"
    value = value_sql("div", ids)
    places = f"sequence(0L, {config.length - 1}L)"
    sequence = f"array_join(transform({places}, i -> CASE WHEN {'k % 97 = i' if lossy else 'false'} THEN '-' ELSE cast({value} as string) END), ',')"
    columns = ["k", ADDRESS.format(div="div", s="string") + " AS IP_ADDR", f"{sequence} AS IPID_SEQUENCE"]
    if times:
        columns.append(f"array_join(transform({places}, i -> CASE WHEN k % 89 = i THEN '-' ELSE cast(1000 * k + 20000 * i + (k * (i + 1)) % 977 as string) END), ',') AS SEND_TIMESTAMP_SEQUENCE")
    return keys.selectExpr(*columns)
