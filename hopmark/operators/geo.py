"""Addresses to continents: a range join by prefix buckets, or a caller's lookup."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = ("ZZ", "Unknown")


def address_number(column: str) -> str:
    p = f"transform(split({column}, '[.]'), x -> try_cast(x as bigint))"
    return f"CASE WHEN size({p}) = 4 AND forall({p}, v -> coalesce(v BETWEEN 0 AND 255, false)) THEN aggregate({p}, 0L, (a, v) -> a * 256 + v) END"


def continents(addresses: DataFrame, networks: DataFrame, bucket_bits: int = 16) -> DataFrame:
    """IP_ADDR, CONTINENT_CODE, CONTINENT of each distinct address; the smallest network that holds it wins.

    networks: net_lo, net_hi (numbers, both inclusive), CONTINENT_CODE, CONTINENT. A network is entered under each prefix of
    `bucket_bits` bits that it touches, so the range join is an equality join with a check. Addresses in no network, and
    those that are no IPv4 address, are unknown; so are those of a network without a code."""
    ips = addresses.select("IP_ADDR").distinct().withColumn("num", F.expr(address_number("IP_ADDR"))).withColumn("bucket", F.shiftright("num", 32 - bucket_bits))
    nets = networks.select("net_lo", "net_hi", "CONTINENT_CODE", "CONTINENT", F.explode(F.sequence(F.shiftright("net_lo", 32 - bucket_bits), F.shiftright("net_hi", 32 - bucket_bits))).alias("bucket"))
    hit = ips.join(nets, "bucket").where("num BETWEEN net_lo AND net_hi").groupBy("IP_ADDR").agg(F.min_by(F.struct("CONTINENT_CODE", "CONTINENT"), F.struct(F.col("net_hi") - F.col("net_lo"), "net_lo")).alias("c"))
    code = F.when(F.coalesce(F.col("c.CONTINENT_CODE"), F.lit("")) == "", F.lit(None)).otherwise(F.col("c.CONTINENT_CODE"))
    return ips.select("IP_ADDR").join(hit, "IP_ADDR", "left").select("IP_ADDR", F.coalesce(code, F.lit(UNKNOWN[0])).alias("CONTINENT_CODE"), F.when(code.isNull(), F.lit(UNKNOWN[1])).otherwise(F.col("c.CONTINENT")).alias("CONTINENT"))


def continents_by_lookup(addresses: DataFrame, make_lookup: Callable[[], Callable[[str], tuple[str, str] | None]]) -> DataFrame:
    """The same with a caller's lookup, made once a task (it may open a database there)."""

    def run(batches: Iterator) -> Iterator:
        lookup = make_lookup()
        for pdf in batches:
            found = [(lookup(ip) if ip else None) or UNKNOWN for ip in pdf["IP_ADDR"]]
            yield pdf.assign(CONTINENT_CODE=[f[0] for f in found], CONTINENT=[f[1] for f in found])

    return addresses.select("IP_ADDR").distinct().mapInPandas(run, "IP_ADDR string, CONTINENT_CODE string, CONTINENT string")
