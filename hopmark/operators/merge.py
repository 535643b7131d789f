"""Merging of a base and a mass campaign, coverage, and constraint checks. Each check raises ValueError."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopmark.functions.labels import CLASSIFIER_LABELS, LABELS
from hopmark.functions.sequences import share

LABEL = "IPID_SELECTION_STRATEGY"


def label_rows(spark) -> DataFrame:
    """The labels in order: position, IPID_SELECTION_STRATEGY."""
    return spark.createDataFrame(list(enumerate(LABELS)), f"position int, {LABEL} string")


def merge(base: DataFrame, mass: DataFrame) -> DataFrame:
    """The base rows: their own label unless UNCLASSIFIED, then the mass label, or NOT_ENOUGH_SAMPLES without one."""
    m = mass.select("IP_ADDR", F.col(LABEL).alias("mass_label"), F.lit(1).alias("hit"))
    label = F.when(F.col(LABEL) != "UNCLASSIFIED", F.col(LABEL)).when(F.col("hit").isNull(), F.lit("NOT_ENOUGH_SAMPLES")).otherwise(F.col("mass_label"))
    return base.select("IP_ADDR", LABEL).join(m, "IP_ADDR", "left").select("IP_ADDR", label.alias(LABEL))


def counts_and_distinct(df: DataFrame) -> tuple[int, int]:
    return tuple(df.agg(F.count("*"), F.countDistinct("IP_ADDR")).first())


def check_unique(df: DataFrame, name: str) -> int:
    """The number of rows; null addresses count as duplicates."""
    n, distinct = counts_and_distinct(df)
    if n != distinct:
        raise ValueError(f"{name}: duplicate IP_ADDR values")
    return n


def check_labels(df: DataFrame, name: str, allowed: tuple[str, ...] = LABELS) -> None:
    unknown = [r[0] for r in df.where(~F.coalesce(F.col(LABEL).isin(*allowed), F.lit(False))).select(LABEL).distinct().limit(5).collect()]
    if unknown:
        raise ValueError(f"{name}: unknown strategies {sorted(map(str, unknown))}")


class MergeStats(NamedTuple):
    rows: int
    not_enough_samples: int


def checked_merge(base: DataFrame, mass: DataFrame) -> tuple[DataFrame, MergeStats]:
    check_unique(mass, "mass")
    check_labels(base, "base", CLASSIFIER_LABELS)
    check_labels(mass, "mass", CLASSIFIER_LABELS)
    out = merge(base, mass)
    return out, MergeStats(*out.agg(F.count("*"), F.count_if(F.col(LABEL) == "NOT_ENOUGH_SAMPLES")).first())


def coverage(target: DataFrame, probed: DataFrame) -> DataFrame:
    """One row: distinct targets, distinct probed addresses, probed ones outside the targets, coverage in percent."""
    t, p = target.select("IP_ADDR"), probed.select("IP_ADDR")
    a = t.agg(F.countDistinct("IP_ADDR").alias("target_count"))
    b = p.agg(F.countDistinct("IP_ADDR").alias("probed_count"))
    c = p.subtract(t).agg(F.count("*").alias("outside_count"))
    return a.crossJoin(b).crossJoin(c).withColumn("coverage_percent", share(F.col("probed_count"), F.col("target_count")))


def checked_coverage(target: DataFrame, probed: DataFrame) -> dict:
    row = coverage(target, probed).first()
    if not row["target_count"]:
        raise ValueError("the target has no addresses")
    if row["outside_count"]:
        raise ValueError(f"{row['outside_count']} probed addresses are not in the target")
    return row.asDict()


def refinement_facts(rt: DataFrame, fixed: DataFrame) -> DataFrame:
    """One row: rows and distinct addresses of both, unclassified rows, and fixed rows that are not among those."""
    unclassified = rt.where(F.col(LABEL) == "UNCLASSIFIED")
    a = rt.agg(F.count("*").alias("rt_rows"), F.countDistinct("IP_ADDR").alias("rt_distinct"), F.count_if(F.col(LABEL) == "UNCLASSIFIED").alias("rt_unclassified"))
    b = fixed.agg(F.count("*").alias("fi_rows"), F.countDistinct("IP_ADDR").alias("fi_distinct"))
    c = fixed.join(unclassified.select("IP_ADDR"), "IP_ADDR", "left_anti").agg(F.count("*").alias("fi_outside"))
    return a.crossJoin(b).crossJoin(c)


def check_refinement(rt: DataFrame, fixed: DataFrame) -> dict:
    r = refinement_facts(rt, fixed).first()
    for bad, why in (
        (not r["rt_rows"], "the RT-based table is empty"),
        (r["rt_rows"] != r["rt_distinct"], "duplicate IP_ADDR values in the RT-based table"),
        (r["fi_rows"] != r["fi_distinct"], "duplicate IP_ADDR values in the fixed-interval table"),
        (r["fi_outside"], "fixed-interval addresses that are not RT-based UNCLASSIFIED"),
        (r["fi_rows"] > r["rt_unclassified"], "more fixed-interval rows than RT-based UNCLASSIFIED"),
        (not r["rt_unclassified"], "no RT-based UNCLASSIFIED rows"),
    ):
        if bad:
            raise ValueError(why)
    check_labels(rt, "RT-based")
    check_labels(fixed, "fixed-interval")
    return r.asDict()


def check_connection(df: DataFrame) -> None:
    if df.isEmpty():
        raise ValueError("the connection table is empty")
    check_unique(df, "connection")
    check_labels(df, "connection")


def tcp_facts(strategies: DataFrame, zmap: DataFrame) -> DataFrame:
    """One row: rows of both, distinct addresses, addresses without a reply, replies that are neither kind, of each kind."""
    z = zmap.select("IP_ADDR", F.lower(F.trim(F.col("REPLY_TYPE").cast("string"))).alias("reply"), F.lit(1).alias("hit"))
    joined = strategies.select("IP_ADDR").join(z, "IP_ADDR", "left")
    known = F.col("reply").isin("synack", "rst")
    facts = joined.agg(
        F.count_if(F.col("hit").isNull()).alias("missing"),
        F.count_if(F.col("hit").isNotNull() & (F.col("reply").isNull() | ~known)).alias("unsupported"),
        F.count_if(F.col("reply") == "synack").alias("synack"),
        F.count_if(F.col("reply") == "rst").alias("rst"),
    )
    a = strategies.agg(F.count("*").alias("rows"), F.countDistinct("IP_ADDR").alias("distinct_rows"))
    b = zmap.agg(F.count("*").alias("zmap_rows"), F.countDistinct("IP_ADDR").alias("zmap_distinct"))
    return a.crossJoin(b).crossJoin(facts)


def check_tcp(strategies: DataFrame, zmap: DataFrame) -> dict:
    r = tcp_facts(strategies, zmap).first()
    for bad, why in (
        (not r["rows"], "the strategy table is empty"),
        (r["rows"] != r["distinct_rows"], "duplicate IP_ADDR values in the strategies"),
        (r["zmap_rows"] != r["zmap_distinct"], "duplicate IP_ADDR values in the scan"),
        (r["missing"], "addresses without a scan reply"),
        (r["unsupported"], "unsupported reply types"),
        (not r["synack"] or not r["rst"], "both reply types are needed"),
    ):
        if bad:
            raise ValueError(why)
    check_labels(strategies, "strategies")
    return r.asDict()


def os_facts(os: DataFrame, strategies: DataFrame) -> DataFrame:
    """One row: rows, distinct addresses, identified rows (a name that is not blank), identified rows with a strategy."""
    name = F.lower(F.trim(F.col("OS_NAME").cast("string")))
    known = os.select("IP_ADDR").where(name.isNotNull() & (name != ""))
    hit = strategies.select("IP_ADDR", F.lit(1).alias("hit"))
    a = os.agg(F.count("*").alias("os_rows"), F.countDistinct("IP_ADDR").alias("os_distinct"))
    b = strategies.agg(F.count("*").alias("rows"), F.countDistinct("IP_ADDR").alias("distinct_rows"))
    c = known.join(hit, "IP_ADDR", "left").agg(F.count("*").alias("identified"), F.count_if(F.col("hit") == 1).alias("matched"))
    return a.crossJoin(b).crossJoin(c)


def check_os(os: DataFrame, strategies: DataFrame, dimension: DataFrame, both_groups: bool = False) -> dict:
    r = os_facts(os, strategies).first()
    for bad, why in (
        (not r["os_rows"], "the OS table is empty"),
        (not r["rows"], "the strategy table is empty"),
        (r["os_rows"] != r["os_distinct"], "duplicate IP_ADDR values in the OS table"),
        (r["rows"] != r["distinct_rows"], "duplicate IP_ADDR values in the strategies"),
        (not r["identified"], "no identified operating systems"),
        (not r["matched"], "no identified address has a strategy"),
    ):
        if bad:
            raise ValueError(why)
    named = os.select("IP_ADDR", F.lower(F.trim("OS_NAME")).alias("OS_NAME")).where("OS_NAME <> ''").join(strategies.select("IP_ADDR"), "IP_ADDR")
    unknown = [x[0] for x in named.join(F.broadcast(dimension), "OS_NAME", "left_anti").select("OS_NAME").distinct().limit(5).collect()]
    if unknown:
        raise ValueError(f"unknown operating systems {sorted(unknown)}")
    check_labels(strategies, "strategies")
    if both_groups and named.join(F.broadcast(dimension), "OS_NAME").select("OS_GROUP").distinct().count() < 2:
        raise ValueError("both groups of operating systems are needed")
    return r.asDict()


def follow_up_targets(strategies: DataFrame) -> DataFrame:
    """Unclassified addresses as the targets of the next scan."""
    return strategies.where(F.col(LABEL) == "UNCLASSIFIED").select("IP_ADDR", F.lit("").alias("REPLY_TYPE"))
