"""The registered queries, one for each operator of the inventory, and the SQL that gives the same rows.

The driver's tables hold no measurements, so each query first derives measurement-shaped rows from order keys by whole-number
expressions that both engines evaluate alike. The keys are dealt out anew, as the derived rows are much larger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopmark.functions import os_names, stats
from hopmark.functions.labels import BASE, LABELS, MASS, REQUEST_IP_IDS
from hopmark.functions.sequences import deltas, let, median, parse_times, steps, view
from hopmark.operators import classify, geo, increments, merge, reports, synthetic
from hopmark.plans import validation
from hopmark.sources import tables

LABEL = merge.LABEL
OS_CYCLE = ("ubuntu", " Cisco-IOS", "debian", "windows ", "mikrotik-routeros", "", "freebsd")
NETS = 40


class Inputs:
    """The derived relations of one set of tables.

    Spark guesses the size of sequences from that of the keys, far too small, and may broadcast them through the driver; so the
    sequences, and what is derived from their rows, are joined by sorted shuffles (a hint that passes on to labels and intervals)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def keys(self) -> DataFrame:
        n = self.spark.sparkContext.defaultParallelism
        return self.spark.read.parquet(f"{self.dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("k")).repartition(n)

    def base(self, times: bool = False) -> DataFrame:
        return synthetic.from_keys(self.keys(), BASE, times).hint("merge")

    def mass(self, times: bool = False) -> DataFrame:
        return synthetic.from_keys(self.keys().where("k % 11 <> 0"), MASS, times).hint("merge")

    def whole(self) -> DataFrame:
        """Mass sequences without a loss."""
        return synthetic.from_keys(self.keys().where("k % 11 <> 0"), MASS, lossy=False).hint("merge")

    def addresses(self, where: str = "true") -> DataFrame:
        return self.keys().where(where).select("k", F.expr(synthetic.ADDRESS.format(div="div", s="string")).alias("IP_ADDR"))

    def base_labels(self) -> DataFrame:
        return classify.classify_base(self.base())

    def mass_labels(self) -> DataFrame:
        return classify.classify_mass(self.mass())

    def merged(self) -> DataFrame:
        return merge.merge(self.base_labels(), self.mass_labels())

    def refined(self) -> DataFrame:
        """Mass labels of the addresses that the base run left unclassified."""
        return self.mass_labels().join(self.base_labels().where(F.col(LABEL) == "UNCLASSIFIED").select("IP_ADDR"), "IP_ADDR", "left_semi")

    def zmap(self) -> DataFrame:
        return self.addresses().selectExpr("IP_ADDR", "CASE k % 3 WHEN 0 THEN 'synack' WHEN 1 THEN ' SYNACK' ELSE 'Rst' END AS REPLY_TYPE")

    def os(self) -> DataFrame:
        names = ", ".join(f"'{n}'" for n in OS_CYCLE)
        return self.addresses("k % 5 < 3").selectExpr("IP_ADDR", f"element_at(array({names}), cast(k % {len(OS_CYCLE)} as int) + 1) AS OS_NAME")

    def intervals(self, mass: bool) -> DataFrame:
        return increments.probing_intervals(self.mass(True) if mass else self.base(True))

    def networks(self) -> DataFrame:
        rows = self.spark.range(NETS).selectExpr("id AS j").union(self.spark.range(NETS, NETS + 4).selectExpr("id AS j"))
        code = "element_at(array('EU', 'NA', 'AS', ''), cast(j % 4 as int) + 1)"
        lo = f"167772160L + CASE WHEN j < {NETS} THEN j * 512 ELSE (j - {NETS}) * 1024 + 64 END"
        return rows.selectExpr(f"{lo} AS net_lo", f"{lo} + CASE WHEN j < {NETS} THEN 299 ELSE 15 END AS net_hi", f"{code} AS CONTINENT_CODE", f"concat('Continent ', {code}) AS CONTINENT")

    def continents(self) -> DataFrame:
        return geo.continents(self.addresses(), self.networks())

    def samples(self) -> DataFrame:
        """Confusion-matrix input: what a key's class was made to be, and what it was called."""
        made = "element_at(array('REFLECTION', 'CONSTANT', 'PER_DESTINATION', 'PER_CONNECTION', 'SINGLE', 'PER_BUCKET', 'MULTI', 'RANDOM'), cast(k % 8 as int) + 1)"
        m = self.mass_labels().withColumnRenamed(LABEL, "DETECTED_STRATEGY")
        return self.addresses("k % 11 <> 0").selectExpr("IP_ADDR", f"{made} AS EXPECTED_STRATEGY", f"{made} AS GENERATOR_STRATEGY").join(m, "IP_ADDR")


# The same relations for the other engine.
_PATTERN = lambda n: "[" + ", ".join(str(REQUEST_IP_IDS[i % 5]) for i in range(n)) + "]"
_KEYS = "(SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders)"
_ADDR = synthetic.ADDRESS.format(div="//", s="VARCHAR")


def _raw(n: int, where: str) -> str:
    value = synthetic.value_sql("//", f"([{', '.join(map(str, REQUEST_IP_IDS))}][(i % 5) + 1])")
    return (
        f"SELECT k, {_ADDR} AS IP_ADDR, array_to_string(list_transform(range({n}), lambda i: CASE WHEN k % 97 = i THEN '-' ELSE CAST({value} AS VARCHAR) END), ',') AS IPID_SEQUENCE, "
        f"array_to_string(list_transform(range({n}), lambda i: CASE WHEN k % 89 = i THEN '-' ELSE CAST(1000 * k + 20000 * i + (k * (i + 1)) % 977 AS VARCHAR) END), ',') AS SEND_TIMESTAMP_SEQUENCE FROM {_KEYS} WHERE {where}"
    )


def _diff(a: str, n: str, d: int) -> str:
    return f"list_transform(range(1, {n} + 1 - {d}), lambda i: ({a}[i + {d}] - {a}[i]) & 65535)"


def _all(lst: str, lo: int, hi: int) -> str:
    return f"len(list_filter({lst}, lambda v: v NOT BETWEEN {lo} AND {hi})) = 0"


def _exact(n: int) -> str:
    one, two, four = (_diff("a", str(n), d) for d in (1, 2, 4))
    return (
        f"CASE WHEN len(list_distinct(list_transform(range(1, {n + 1}), lambda i: (a[i] - {_PATTERN(n)}[i]) & 65535))) = 1 THEN 'REFLECTION' WHEN {_all(one, 0, 0)} THEN 'CONSTANT' "
        f"WHEN {_all(two, 1, 1)} THEN 'PER_DESTINATION' WHEN {_all(four, 1, 1)} THEN 'PER_CONNECTION' WHEN {_all(one, 1, 21845)} THEN 'SINGLE' WHEN {_all(four, 1, 21845)} THEN 'PER_BUCKET' END"
    )


_LIMITS = {k: "[" + ", ".join(map(str, v)) + "]" for k, v in stats.limits(100).items()}
_PAIRS = lambda d: f"list_filter({_diff('a', '100', d)}, lambda v: v IS NOT NULL)"
_FAMILIES = (("full", 1), ("destination", 2), ("connection", 4))
_SQUARES = lambda b: f"CAST(list_sum(list_transform(range({b}), lambda b: len(list_filter(s, lambda v: v * {b} // 65536 = b)) * len(list_filter(s, lambda v: v * {b} // 65536 = b)))) AS BIGINT)"
_CTES = {
    "base": _raw(16, "true"),
    "mass": _raw(100, "k % 11 <> 0"),
    "whole": _raw(100, "k % 11 <> 0").replace("k % 97 = i", "false"),
    "wp": "SELECT IP_ADDR, list_transform(string_split(IPID_SEQUENCE, ','), lambda x: TRY_CAST(x AS BIGINT)) AS a FROM whole",
    "addr": f"SELECT k, {_ADDR} AS IP_ADDR FROM {_KEYS}",
    "bp": "SELECT k, IP_ADDR, list_transform(string_split(IPID_SEQUENCE, ','), lambda x: TRY_CAST(x AS INTEGER)) AS a FROM base",
    "blab": f"SELECT IP_ADDR, CASE WHEN len(list_filter(a, lambda x: x IS NOT NULL)) < 16 THEN 'UNCLASSIFIED' ELSE coalesce({_exact(16)}, 'UNCLASSIFIED') END AS {LABEL} FROM bp",
    "mp": "SELECT k, IP_ADDR, list_transform(string_split(IPID_SEQUENCE, ','), lambda x: TRY_CAST(x AS BIGINT)) AS a FROM mass",
    "ms": "SELECT *, list_sort(list_filter(a, lambda x: x IS NOT NULL)) AS s FROM mp",
    "mg": "SELECT *, list_transform(range(1, len(s)), lambda i: s[i + 1] - s[i]) AS g, s[1] + 65536 - s[len(s)] AS w FROM ms",
    "mstat": "SELECT k, IP_ADDR, a, CAST(len(s) AS BIGINT) AS n_present, " + f"{_SQUARES(16)} AS sum_squares, {_SQUARES(4)} AS legacy_squares, CAST(len(list_distinct(s)) AS BIGINT) AS n_distinct, CAST(greatest(coalesce(list_max(g), 0), w) AS BIGINT) AS max_gap, CAST(greatest(len(list_filter(g, lambda v: v > 800)) + CASE WHEN w > 800 THEN 1 ELSE 0 END, 1) AS BIGINT) AS n_clusters, " + ", ".join(f"CAST(len({_PAIRS(d)}) AS BIGINT) AS {f}_pairs, CAST(len(list_filter({_PAIRS(d)}, lambda v: v BETWEEN 1 AND 21845)) AS BIGINT) AS {f}_bounded" for f, d in _FAMILIES) + " FROM mg",
    "mlab": f"SELECT IP_ADDR, coalesce(CASE WHEN n_present = 100 THEN {_exact(100)} END, CASE WHEN n_distinct = 1 THEN 'CONSTANT' WHEN n_clusters BETWEEN 2 AND 16 THEN 'MULTI' WHEN n_present >= 2 AND sum_squares <= {_LIMITS['squares']}[n_present + 1] AND n_distinct >= {_LIMITS['distinct']}[n_present + 1] AND max_gap <= {_LIMITS['gap']}[n_present + 1] AND " + " AND ".join(f"{f}_bounded <= {_LIMITS['successes']}[{f}_pairs + 1]" for f, _ in _FAMILIES) + f" THEN 'RANDOM' ELSE 'UNCLASSIFIED' END) AS {LABEL} FROM mstat",
    "merged": f"SELECT IP_ADDR, CASE WHEN b.{LABEL} <> 'UNCLASSIFIED' THEN b.{LABEL} WHEN m.IP_ADDR IS NULL THEN 'NOT_ENOUGH_SAMPLES' ELSE m.{LABEL} END AS {LABEL} FROM blab b LEFT JOIN mlab m USING (IP_ADDR)",
    "refined": f"SELECT * FROM mlab WHERE IP_ADDR IN (SELECT IP_ADDR FROM blab WHERE {LABEL} = 'UNCLASSIFIED')",
    "zmap": "SELECT IP_ADDR, CASE k % 3 WHEN 0 THEN 'synack' WHEN 1 THEN ' SYNACK' ELSE 'Rst' END AS REPLY_TYPE FROM addr",
    "os": f"SELECT IP_ADDR, [{', '.join(repr(n) for n in OS_CYCLE)}][(k % {len(OS_CYCLE)}) + 1] AS OS_NAME FROM addr WHERE k % 5 < 3",
    "btimes": "SELECT IP_ADDR, list_filter(list_transform(string_split(SEND_TIMESTAMP_SEQUENCE, ','), lambda x: TRY_CAST(x AS BIGINT)), lambda v: v IS NOT NULL) AS t FROM base",
    "mtimes": "SELECT IP_ADDR, list_filter(list_transform(string_split(SEND_TIMESTAMP_SEQUENCE, ','), lambda x: TRY_CAST(x AS BIGINT)), lambda v: v IS NOT NULL) AS t FROM mass",
    "bgaps": "SELECT IP_ADDR, list_transform(range(1, len(t)), lambda i: t[i + 1] - t[i]) AS PROBING_INTERVALS FROM btimes",
    "mgaps": "SELECT IP_ADDR, list_transform(range(1, len(t)), lambda i: t[i + 1] - t[i]) AS PROBING_INTERVALS FROM mtimes",
    "binc": f"SELECT IP_ADDR, {LABEL}, CASE WHEN len(list_filter(a, lambda x: x IS NOT NULL)) < 16 THEN [] WHEN {LABEL} = 'PER_DESTINATION' THEN list_transform(range(14), lambda j: (a[j % 7 * 2 + j // 7 + 3] - a[j % 7 * 2 + j // 7 + 1]) & 65535) WHEN {LABEL} IN ('PER_CONNECTION', 'PER_BUCKET') THEN list_transform(range(12), lambda j: (a[j % 3 * 4 + j // 3 + 5] - a[j % 3 * 4 + j // 3 + 1]) & 65535) ELSE {_diff('a', '16', 1)} END AS INCREMENTS FROM bp JOIN blab USING (IP_ADDR)",
    "minc": f"SELECT IP_ADDR, {LABEL}, CASE WHEN len(list_filter(a, lambda x: x IS NOT NULL)) = 100 AND {LABEL} = 'PER_DESTINATION' THEN list_transform(range(98), lambda j: (a[j % 49 * 2 + j // 49 + 3] - a[j % 49 * 2 + j // 49 + 1]) & 65535) WHEN len(list_filter(a, lambda x: x IS NOT NULL)) = 100 AND {LABEL} IN ('PER_CONNECTION', 'PER_BUCKET') THEN list_transform(range(96), lambda j: (a[j % 24 * 4 + j // 24 + 5] - a[j % 24 * 4 + j // 24 + 1]) & 65535) ELSE {_PAIRS(1)} END AS INCREMENTS FROM mp JOIN mlab USING (IP_ADDR)",
    "labels10": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(LABELS)) + f") AS t(position, {LABEL})",
    "dim": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in os_names.dimension_rows()) + ") AS t(OS_NAME, OS_GROUP, OS_LABEL)",
    "nets": f"SELECT lo AS net_lo, lo + CASE WHEN j < {NETS} THEN 299 ELSE 15 END AS net_hi, ['EU', 'NA', 'AS', ''][(j % 4) + 1] AS code FROM (SELECT j, 167772160 + CASE WHEN j < {NETS} THEN j * 512 ELSE (j - {NETS}) * 1024 + 64 END AS lo FROM range({NETS + 4}) AS t(j))",
    "cont": "SELECT IP_ADDR, CASE WHEN coalesce(c, '') = '' THEN 'ZZ' ELSE c END AS CONTINENT_CODE, CASE WHEN coalesce(c, '') = '' THEN 'Unknown' ELSE 'Continent ' || c END AS CONTINENT FROM (SELECT IP_ADDR, arg_min(code, net_hi - net_lo) AS c FROM (SELECT DISTINCT IP_ADDR, 167772160 + k AS num FROM addr) LEFT JOIN nets ON num BETWEEN net_lo AND net_hi GROUP BY IP_ADDR)",
    "med": "SELECT * FROM (SELECT 'RT-based' AS MODE, IP_ADDR, list_aggregate(PROBING_INTERVALS, 'median') / CAST(1000.0 AS DOUBLE) AS MEDIAN_MS FROM bgaps UNION ALL SELECT 'Fixed-Interval', IP_ADDR, list_aggregate(PROBING_INTERVALS, 'median') / CAST(1000.0 AS DOUBLE) FROM mgaps)",
    "samples": f"SELECT IP_ADDR, ['REFLECTION', 'CONSTANT', 'PER_DESTINATION', 'PER_CONNECTION', 'SINGLE', 'PER_BUCKET', 'MULTI', 'RANDOM'][(k % 8) + 1] AS EXPECTED_STRATEGY, {LABEL} AS DETECTED_STRATEGY FROM addr JOIN mlab USING (IP_ADDR)",
}


def _with(sql: str) -> str:
    """The SQL with the derived relations that it uses; SQL that has its own is left as it is."""
    import re

    if sql.startswith("WITH "):
        return sql
    need: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+\(?(\w+)", text):
            if name in _CTES and name not in need:
                visit(_CTES[name])
                need.append(name)

    visit(sql)
    ctes = ", ".join(f"{n} AS MATERIALIZED ({_CTES[n]})" for n in need)
    return (f"WITH {ctes} " if need else "") + sql


_JOINED = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
_DJOIN = lambda c: f"array_to_string(list_transform({c}, lambda v: CAST(v AS VARCHAR)), ',')"
_SHARE = lambda n, t: f"CASE WHEN {t} > 0 THEN CAST(100.0 AS DOUBLE) * {n} / {t} ELSE 0.0 END"
_N = "CAST(count(*) AS BIGINT)"
_DIST = lambda t: f"SELECT position, {LABEL}, CAST(coalesce(n, 0) AS BIGINT) AS COUNT, CAST(100.0 AS DOUBLE) * coalesce(n, 0) / sum(coalesce(n, 0)) OVER () AS PERCENTAGE FROM labels10 LEFT JOIN (SELECT {LABEL}, count(*) AS n FROM {t} GROUP BY 1) USING ({LABEL})"


def _plain(sql: str, **frames: str):
    """A query of SQL that both engines take, over derived relations: name in the SQL -> method of Inputs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        inputs = Inputs(spark, sf_dir)
        return spark.sql(sql.format(**{k: "{" + k + "}" for k in frames}), **{k: getattr(inputs, m)() for k, m in frames.items()})

    return run, _with(sql.format(**{k: k for k in frames}))


def _query(make, sql: str | None = None):
    return (lambda spark, sf_dir: make(Inputs(spark, sf_dir))), _with(sql) if sql else None


def _facts(x: DataFrame) -> DataFrame:
    return x.select(*(F.col(c).cast("long").alias(c) for c in x.columns))


def _increment_sql(a: str, b: str) -> str:
    return f"""SELECT MODE, {LABEL}, CAST(INCREMENT AS INTEGER) AS INCREMENT, CAST(n AS BIGINT) AS COUNT, CAST(cum AS BIGINT) AS CUMULATIVE_COUNT, CAST(100.0 AS DOUBLE) * cum / kept AS CUMULATIVE_PERCENTAGE, CAST(total AS BIGINT) AS TOTAL_COUNT, CAST(kept AS BIGINT) AS RETAINED_COUNT, CAST(total - kept AS BIGINT) AS CLIPPED_COUNT
FROM (SELECT *, sum(n) OVER (PARTITION BY MODE, {LABEL}) AS kept FROM (SELECT *, sum(n) OVER (PARTITION BY MODE, {LABEL} ORDER BY INCREMENT) AS cum, sum(n) OVER (PARTITION BY MODE, {LABEL}) AS total
FROM (SELECT MODE, {LABEL}, INCREMENT, count(*) AS n FROM (SELECT 'RT-based' AS MODE, {LABEL}, unnest(INCREMENTS) AS INCREMENT FROM {a} UNION ALL SELECT 'Fixed-Interval', {LABEL}, unnest(INCREMENTS) FROM {b}) WHERE INCREMENT > 0 AND {LABEL} IN ('PER_DESTINATION', 'PER_CONNECTION', 'SINGLE', 'PER_BUCKET') GROUP BY 1, 2, 3)) WHERE cum - n < CAST(0.999 AS DOUBLE) * total)"""


_INTER = f"SELECT b.{LABEL} AS RT_BASED_STRATEGY, m.{LABEL} AS FIXED_INTERVAL_STRATEGY, {_N} AS COUNT FROM blab b JOIN mlab m USING (IP_ADDR) WHERE b.{LABEL} NOT IN ('MULTI', 'RANDOM', 'NOT_ENOUGH_SAMPLES') AND m.{LABEL} NOT IN ('MULTI', 'RANDOM', 'NOT_ENOUGH_SAMPLES') GROUP BY 1, 2"
_SEVEN = "(SELECT * FROM (VALUES " + ", ".join(f"('{x}')" for x in reports.INTERSECTION) + ") AS t(s))"
_SUMMARY = lambda t: f"SELECT {_N} AS n, min(v) AS lo, max(v) AS hi, avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.9) AS p90, quantile_cont(v, 0.99) AS pc FROM (SELECT unnest(PROBING_INTERVALS) AS v FROM {t})"
_ROUND = lambda df, *cs: df.select(*(F.round(c, 6).alias(c) if c in cs else F.col(c) for c in df.columns))


def _generated(i: Inputs) -> DataFrame:
    s = synthetic.generate(i.spark, validation.FIXED, 200, MASS, 42, 50)
    return reports.confusion(validation.detected(s, "IPID_SEQUENCE", False, MASS))


def _impaired(i: Inputs) -> DataFrame:
    s = synthetic.generate(i.spark, validation.IMPAIRED, 200, MASS, 42, 50)
    return reports.confusion(validation.detected(s, "REORDERED_SEQUENCE", False, MASS))


def _sampled(i: Inputs) -> DataFrame:
    return reports.sample(i.mass(), i.mass_labels(), "RANDOM", 25, 42)[0].select("IP_ADDR", "IPID_SEQUENCE")


def _views(i: Inputs) -> DataFrame:
    rows = let(i.mass(), a="transform(split(IPID_SEQUENCE, ','), x -> try_cast(x as int))")
    text = lambda sql: F.expr(f"array_join({sql}, ',', '-')")
    return rows.select("IP_ADDR", text(steps("a")).alias("inc_all"), text(steps(view("a", 0, 2))).alias("inc_src1"), text(steps(view("a", 1, 2))).alias("inc_src2"), text(steps(view("a", 3, 4))).alias("inc_con3"))


_VIEW = lambda first, stride, n: f"array_to_string(list_transform(range({n - 1}), lambda j: coalesce(CAST((a[{first + 1 + stride} + j * {stride}] - a[{first + 1} + j * {stride}]) & 65535 AS VARCHAR), '-')), ',')"

REGISTRY = {
    "SRC_01_base_scan": _query(lambda i: tables.scan_base(i.base()).select("IP_ADDR", _JOINED("ipids").alias("ipids")), f"SELECT IP_ADDR, CASE WHEN len(list_filter(a, lambda x: x IS NULL)) = 0 THEN {_DJOIN('a')} ELSE '' END AS ipids FROM bp"),
    "SRC_02_mass_scan": _query(lambda i: tables.scan_mass(i.mass()).select("IP_ADDR", _JOINED("ipids").alias("ipids")), f"SELECT IP_ADDR, {_DJOIN('list_transform(a, lambda x: coalesce(x, -1))')} AS ipids FROM mp"),
    "SRC_03_timestamp_scan": _query(lambda i: tables.scan_times(i.base(True)).select("IP_ADDR", _JOINED("times").alias("times")), f"SELECT IP_ADDR, {_DJOIN('t')} AS times FROM btimes"),
    "SRC_04_strategy_scan": _plain(f"SELECT IP_ADDR, CAST({LABEL} AS STRING) AS {LABEL} FROM {{blab}}", blab="base_labels"),
    "SRC_05_other_scans": _plain("SELECT 'zmap' AS source, CAST(count(*) AS BIGINT) AS n FROM {zmap} UNION ALL SELECT 'os', CAST(count(*) AS BIGINT) FROM {os}", zmap="zmap", os="os"),
    "SRC_07_row_count": _plain("SELECT CAST(count(*) AS BIGINT) AS n FROM {base}", base="base"),
    "SNK_06_follow_up_targets": _query(lambda i: merge.follow_up_targets(i.base_labels()), f"SELECT IP_ADDR, '' AS REPLY_TYPE FROM blab WHERE {LABEL} = 'UNCLASSIFIED'"),
    "PRJ_02_normalised_keys": _plain("SELECT IP_ADDR, lower(trim(CAST(OS_NAME AS STRING))) AS os_name, upper(trim(CAST(OS_NAME AS STRING))) AS upper_name FROM {os}", os="os"),
    "PRJ_04_reply_labels": _plain("SELECT IP_ADDR, CASE lower(trim(REPLY_TYPE)) WHEN 'synack' THEN 'SYN-ACK' ELSE 'RST' END AS TCP_FLAGS FROM {zmap}", zmap="zmap"),
    "PRJ_06_milliseconds": _query(lambda i: reports.interval_medians(i.intervals(False), i.intervals(True)), "SELECT MODE, IP_ADDR, MEDIAN_MS FROM med"),
    "FLT_02_allowed_labels": _plain(f"SELECT IP_ADDR, {LABEL} FROM {{blab}} WHERE {LABEL} IN ('SINGLE', 'PER_BUCKET')", blab="base_labels"),
    "FLT_03_null_aware_not_in": _plain("SELECT IP_ADDR, OS_NAME FROM {os} WHERE OS_NAME IS NULL OR OS_NAME NOT IN ('ubuntu', 'debian')", os="os"),
    "FLT_04_not_blank": _plain("SELECT IP_ADDR, OS_NAME FROM {os} WHERE OS_NAME IS NOT NULL AND trim(OS_NAME) <> ''", os="os"),
    "FLT_05_between": _plain("SELECT IP_ADDR, n_clusters FROM {mstat} WHERE n_clusters BETWEEN 2 AND 16", mstat="statistics"),
    "FLT_06_positive_known": _plain("SELECT IP_ADDR, CONTINENT_CODE FROM {cont} WHERE CONTINENT_CODE <> 'ZZ' AND CONTINENT_CODE IS NOT NULL", cont="continents"),
    "FLT_07_parameters": _query(lambda i: i.spark.sql(f"SELECT IP_ADDR FROM {{t}} WHERE {LABEL} = :label", args={"label": "SINGLE"}, t=i.base_labels()), f"SELECT IP_ADDR FROM blab WHERE {LABEL} = 'SINGLE'"),
    "FLT_08_all_numeric": _query(lambda i: let(i.base(), a="transform(split(IPID_SEQUENCE, ','), x -> try_cast(x as int))").where("forall(a, v -> v IS NOT NULL)").select("IP_ADDR"), "SELECT IP_ADDR FROM bp WHERE len(list_filter(a, lambda x: x IS NULL)) = 0"),
    "JN_01_merge": _query(lambda i: i.merged(), f"SELECT IP_ADDR, {LABEL} FROM merged"),
    "JN_02_refinement_facts": _query(lambda i: _facts(merge.refinement_facts(i.base_labels(), i.refined())), f"SELECT {_N} AS rt_rows, count(DISTINCT IP_ADDR) AS rt_distinct, CAST(count(*) FILTER (WHERE {LABEL} = 'UNCLASSIFIED') AS BIGINT) AS rt_unclassified, (SELECT {_N} FROM refined) AS fi_rows, (SELECT count(DISTINCT IP_ADDR) FROM refined) AS fi_distinct, (SELECT {_N} FROM refined r LEFT JOIN blab b USING (IP_ADDR) WHERE b.IP_ADDR IS NULL OR b.{LABEL} <> 'UNCLASSIFIED') AS fi_outside FROM blab"),
    "JN_03_common_population": _plain("SELECT CAST(count(*) AS BIGINT) AS n FROM {blab} b JOIN {mlab} m ON b.IP_ADDR = m.IP_ADDR", blab="base_labels", mlab="mass_labels"),
    "JN_04_intersection_counts": _query(lambda i: reports.intersection_counts(i.base_labels(), i.mass_labels()), _INTER),
    "JN_05_os_counts": _query(lambda i: reports.os_counts(i.os(), i.merged()), f"SELECT lower(trim(OS_NAME)) AS OS_NAME, {LABEL}, {_N} AS COUNT FROM os JOIN merged USING (IP_ADDR) WHERE trim(OS_NAME) <> '' GROUP BY 1, 2"),
    "JN_06_os_facts": _query(lambda i: _facts(merge.os_facts(i.os(), i.mass_labels())), f"SELECT {_N} AS os_rows, count(DISTINCT o.IP_ADDR) AS os_distinct, (SELECT {_N} FROM mlab) AS rows, (SELECT count(DISTINCT IP_ADDR) FROM mlab) AS distinct_rows, CAST(count(*) FILTER (WHERE trim(OS_NAME) <> '') AS BIGINT) AS identified, CAST(count(*) FILTER (WHERE trim(OS_NAME) <> '' AND m.IP_ADDR IS NOT NULL) AS BIGINT) AS matched FROM os o LEFT JOIN mlab m USING (IP_ADDR)"),
    "JN_07_tcp_facts": _query(lambda i: _facts(merge.tcp_facts(i.merged(), i.zmap())), f"SELECT {_N} AS rows, count(DISTINCT IP_ADDR) AS distinct_rows, (SELECT {_N} FROM zmap) AS zmap_rows, (SELECT count(DISTINCT IP_ADDR) FROM zmap) AS zmap_distinct, CAST(count(*) FILTER (WHERE REPLY_TYPE IS NULL) AS BIGINT) AS missing, CAST(count(*) FILTER (WHERE lower(trim(REPLY_TYPE)) NOT IN ('synack', 'rst')) AS BIGINT) AS unsupported, CAST(count(*) FILTER (WHERE lower(trim(REPLY_TYPE)) = 'synack') AS BIGINT) AS synack, CAST(count(*) FILTER (WHERE lower(trim(REPLY_TYPE)) = 'rst') AS BIGINT) AS rst FROM merged LEFT JOIN zmap USING (IP_ADDR)"),
    "JN_09_continent_medians": _query(lambda i: reports.interval_medians(i.intervals(False), i.intervals(True)).join(i.continents(), "IP_ADDR").where("CONTINENT_CODE <> 'ZZ'").select("MODE", "IP_ADDR", "MEDIAN_MS", "CONTINENT_CODE"), "SELECT MODE, IP_ADDR, MEDIAN_MS, CONTINENT_CODE FROM med JOIN cont USING (IP_ADDR) WHERE CONTINENT_CODE <> 'ZZ'"),
    "JN_11_raw_with_labels": _plain(f"SELECT r.IP_ADDR, r.IPID_SEQUENCE FROM {{mass}} r JOIN {{mlab}} m ON r.IP_ADDR = m.IP_ADDR WHERE m.{LABEL} = 'MULTI'", mass="mass", mlab="mass_labels"),
    "JN_12_continents": _query(lambda i: i.continents(), "SELECT IP_ADDR, CONTINENT_CODE, CONTINENT FROM cont"),
    "JN_13_os_dimension": _query(lambda i: i.os().select("IP_ADDR", F.lower(F.trim("OS_NAME")).alias("OS_NAME")).join(F.broadcast(os_names.dimension(i.spark)), "OS_NAME").select("IP_ADDR", "OS_NAME", "OS_GROUP", "OS_LABEL"), "SELECT IP_ADDR, d.OS_NAME, OS_GROUP, OS_LABEL FROM os o JOIN dim d ON lower(trim(o.OS_NAME)) = d.OS_NAME"),
    "AGG_01_base_distribution": _query(lambda i: reports.distribution(i.base_labels()), _DIST("blab")),
    "AGG_02_count_distinct": _plain(f"SELECT count(DISTINCT IP_ADDR) AS n FROM {{mlab}}", mlab="mass_labels"),
    "AGG_03_filtered_counts": _plain(f"SELECT CAST(count(*) FILTER (WHERE {LABEL} = 'RANDOM') AS BIGINT) AS n_random, CAST(count(*) FILTER (WHERE {LABEL} = 'MULTI') AS BIGINT) AS n_multi FROM {{mlab}}", mlab="mass_labels"),
    "AGG_06_interval_summary": _query(lambda i: _ROUND(reports.interval_summary(i.intervals(False)), "mean", "std"), f"SELECT n, lo, hi, round(mean, 6) AS mean, round(std, 6) AS std, p50, p90, pc FROM ({_SUMMARY('bgaps')})"),
    "AGG_08_quantile_vector": _query(lambda i: i.intervals(False).select(F.explode("PROBING_INTERVALS").alias("v")).agg(F.percentile("v", F.array(*(F.lit(x / 8) for x in range(9)))).alias("q")).select(F.posexplode("q").alias("i", "q")), "SELECT CAST(i AS INTEGER) AS i, q[i + 1] AS q FROM (SELECT quantile_cont(CAST(v AS DOUBLE), [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1]) AS q FROM (SELECT unnest(PROBING_INTERVALS) AS v FROM bgaps)), range(9) AS t(i)"),
    "AGG_09_list_median": _query(lambda i: i.intervals(False).select("IP_ADDR", F.expr(median("PROBING_INTERVALS")).alias("m")), "SELECT IP_ADDR, CAST(list_aggregate(PROBING_INTERVALS, 'median') AS DOUBLE) AS m FROM bgaps"),
    "AGG_11_interval_histogram": _query(lambda i: _ROUND(reports.interval_histogram(i.intervals(False)), "edge"), f"SELECT CAST(b AS INTEGER) AS bin, round(lo + b * width, 6) AS edge, CAST(coalesce(n, 0) AS BIGINT) AS COUNT FROM (SELECT lo, top, greatest((top - lo) / CAST(50.0 AS DOUBLE), CAST(1.0 AS DOUBLE)) AS width FROM (SELECT lo, CASE WHEN pc > lo THEN CAST(pc AS DOUBLE) ELSE CAST(hi AS DOUBLE) END AS top FROM ({_SUMMARY('bgaps')}))) CROSS JOIN range(50) AS r(b) LEFT JOIN (SELECT CAST(least(floor((v - lo) / width), 49) AS BIGINT) AS b, count(*) AS n FROM (SELECT unnest(PROBING_INTERVALS) AS v FROM bgaps), (SELECT lo, top, greatest((top - lo) / CAST(50.0 AS DOUBLE), CAST(1.0 AS DOUBLE)) AS width FROM (SELECT lo, CASE WHEN pc > lo THEN CAST(pc AS DOUBLE) ELSE CAST(hi AS DOUBLE) END AS top FROM ({_SUMMARY('bgaps')}))) WHERE v BETWEEN lo AND top GROUP BY 1) USING (b)"),
    "AGG_12_increment_cdf": _query(lambda i: reports.increment_cdf(increments.base_increments(i.base()), 5).select(LABEL, "COUNT", F.posexplode("QUANTILES").alias("i", "q")), f"SELECT {LABEL}, CAST(n AS BIGINT) AS COUNT, CAST(i AS INTEGER) AS i, q[i + 1] AS q FROM (SELECT {LABEL}, count(*) AS n, quantile_cont(CAST(v AS DOUBLE), [0, 0.25, 0.5, 0.75, 1]) AS q FROM (SELECT {LABEL}, unnest(INCREMENTS) AS v FROM binc) GROUP BY 1), range(5) AS t(i)"),
    "AGG_13_increment_distributions": _query(lambda i: reports.increment_distributions(increments.base_increments(i.base()), increments.mass_increments(i.mass())), _increment_sql("binc", "minc")),
    "AGG_14_intersection_table": _query(lambda i: reports.intersection(i.base_labels(), i.mass_labels()), f"SELECT RT_BASED_STRATEGY, FIXED_INTERVAL_STRATEGY, COUNT, CAST(sum(COUNT) OVER (PARTITION BY RT_BASED_STRATEGY) AS BIGINT) AS RT_BASED_TOTAL, CASE WHEN sum(COUNT) OVER (PARTITION BY RT_BASED_STRATEGY) > 0 THEN CAST(100.0 AS DOUBLE) * COUNT / sum(COUNT) OVER (PARTITION BY RT_BASED_STRATEGY) ELSE 0.0 END AS PERCENTAGE FROM (SELECT a.s AS RT_BASED_STRATEGY, b.s AS FIXED_INTERVAL_STRATEGY, CAST(coalesce(COUNT, 0) AS BIGINT) AS COUNT FROM {_SEVEN} a CROSS JOIN {_SEVEN} b LEFT JOIN ({_INTER}) c ON c.RT_BASED_STRATEGY = a.s AND c.FIXED_INTERVAL_STRATEGY = b.s)"),
    "AGG_15_refinement": _query(lambda i: reports.refinement(i.base_labels(), i.refined(), i.merged()), f"SELECT MEASUREMENT_TYPE, {LABEL}, CAST(n AS BIGINT) AS COUNT, CAST(sum(n) OVER (PARTITION BY MEASUREMENT_TYPE) AS BIGINT) AS TOTAL, CAST(100.0 AS DOUBLE) * n / sum(n) OVER (PARTITION BY MEASUREMENT_TYPE) AS PERCENTAGE FROM (SELECT 'RT-based' AS MEASUREMENT_TYPE, {LABEL}, count(*) AS n FROM blab GROUP BY 2 UNION ALL SELECT 'Fixed-Interval', {LABEL}, count(*) FROM refined GROUP BY 2 UNION ALL SELECT 'Fixed-Interval', 'NOT_ENOUGH_SAMPLES', (SELECT count(*) FROM blab WHERE {LABEL} = 'UNCLASSIFIED') - (SELECT count(*) FROM refined) UNION ALL SELECT 'RT-based & Connection-oriented', {LABEL}, count(*) FROM merged GROUP BY 2) WHERE n > 0"),
    "AGG_16_os_matrix": _query(lambda i: reports.os_matrix(i.os(), i.merged(), os_names.dimension(i.spark)).select("OS_GROUP", "OS_NAME", "OS_LABEL", LABEL, "COUNT", "OS_TOTAL", F.col("OS_POSITION").cast("long").alias("OS_POSITION"), "PERCENTAGE"), f"SELECT OS_GROUP, o.OS_NAME, OS_LABEL, l.{LABEL}, CAST(coalesce(n, 0) AS BIGINT) AS COUNT, CAST(total AS BIGINT) AS OS_TOTAL, CAST(place AS BIGINT) AS OS_POSITION, CAST(100.0 AS DOUBLE) * coalesce(n, 0) / total AS PERCENTAGE FROM (SELECT d.*, total, row_number() OVER (PARTITION BY OS_GROUP ORDER BY total DESC, lower(OS_LABEL)) AS place FROM (SELECT lower(trim(OS_NAME)) AS OS_NAME, count(*) AS total FROM os JOIN merged USING (IP_ADDR) WHERE trim(OS_NAME) <> '' GROUP BY 1) t JOIN dim d USING (OS_NAME)) o CROSS JOIN labels10 l LEFT JOIN (SELECT lower(trim(OS_NAME)) AS OS_NAME, {LABEL}, count(*) AS n FROM os JOIN merged USING (IP_ADDR) GROUP BY 1, 2) c ON c.OS_NAME = o.OS_NAME AND c.{LABEL} = l.{LABEL}"),
    "AGG_18_tcp_flags": _query(lambda i: reports.tcp_flags(i.merged(), i.zmap()), f"SELECT f AS TCP_FLAGS, {LABEL}, CAST(n AS BIGINT) AS COUNT, CAST(sum(n) OVER (PARTITION BY f) AS BIGINT) AS TOTAL, CAST(100.0 AS DOUBLE) * n / sum(n) OVER (PARTITION BY f) AS PERCENTAGE FROM (SELECT f, {LABEL}, count(*) AS n FROM (SELECT 'SYN-ACK/RST' AS f, {LABEL} FROM merged JOIN zmap USING (IP_ADDR) UNION ALL SELECT CASE lower(trim(REPLY_TYPE)) WHEN 'synack' THEN 'SYN-ACK' ELSE 'RST' END, {LABEL} FROM merged JOIN zmap USING (IP_ADDR)) GROUP BY 1, 2)"),
    "AGG_19_coverage": _query(lambda i: merge.coverage(i.base(), i.mass()), "SELECT count(DISTINCT b.IP_ADDR) AS target_count, (SELECT count(DISTINCT IP_ADDR) FROM mass) AS probed_count, (SELECT CAST(count(*) AS BIGINT) FROM (SELECT IP_ADDR FROM mass EXCEPT SELECT IP_ADDR FROM base)) AS outside_count, CAST(100.0 AS DOUBLE) * (SELECT count(DISTINCT IP_ADDR) FROM mass) / count(DISTINCT b.IP_ADDR) AS coverage_percent FROM base b"),
    "AGG_20_unknown_labels": _query(lambda i: i.merged().groupBy(LABEL).agg(F.count("*").alias("n")).join(F.broadcast(merge.label_rows(i.spark)), LABEL, "left").select(LABEL, "n", F.col("position").isNull().alias("unknown")), f"SELECT {LABEL}, {_N} AS n, false AS unknown FROM merged GROUP BY 1"),
    "AGG_21_confusion": _query(lambda i: reports.confusion(i.samples()), f"SELECT EXPECTED_STRATEGY, DETECTED_STRATEGY, {_N} AS COUNT FROM samples GROUP BY 1, 2"),
    "AGG_22_rejection": _query(lambda i: reports.rejection(i.samples()), f"SELECT EXPECTED_STRATEGY AS GENERATOR_STRATEGY, {_N} AS SAMPLE_COUNT, CAST(count(*) FILTER (WHERE DETECTED_STRATEGY = 'UNCLASSIFIED') AS BIGINT) AS REJECTED_COUNT, CAST(count(*) FILTER (WHERE DETECTED_STRATEGY = 'UNCLASSIFIED') AS DOUBLE) / count(*) AS REJECTION_RATE FROM samples GROUP BY 1"),
    "AGG_23_score_summary": _query(lambda i: reports.value_summary(i.statistics().join(i.mass_labels(), "IP_ADDR"), [LABEL], "max_gap", 1000.0), f"SELECT {LABEL}, {_N} AS COUNT, min(max_gap) AS MIN, quantile_cont(max_gap, 0.25) AS Q25, quantile_cont(max_gap, 0.5) AS MEDIAN, quantile_cont(max_gap, 0.75) AS Q75, max(max_gap) AS MAX, CAST(count(*) FILTER (WHERE max_gap < 1000) AS BIGINT) AS BELOW, CAST(100.0 AS DOUBLE) * count(*) FILTER (WHERE max_gap < 1000) / count(*) AS BELOW_PERCENTAGE FROM mstat JOIN mlab USING (IP_ADDR) GROUP BY 1"),
    "AGG_24_lower_quantile": _query(lambda i: reports.calibrated_threshold(i.statistics().join(i.mass_labels(), "IP_ADDR"), LABEL, "max_gap", 0.01), f"SELECT {LABEL}, q AS LOWER_QUANTILE, min(q) OVER () AS THRESHOLD FROM (SELECT {LABEL}, list_sort(list(max_gap))[CAST(floor(CAST(0.01 AS DOUBLE) * (count(*) - 1)) AS BIGINT) + 1] AS q FROM mstat JOIN mlab USING (IP_ADDR) GROUP BY 1)"),
    "WIN_03_views": _query(_views, f"SELECT IP_ADDR, {_VIEW(0, 1, 100)} AS inc_all, {_VIEW(0, 2, 50)} AS inc_src1, {_VIEW(1, 2, 50)} AS inc_src2, {_VIEW(3, 4, 25)} AS inc_con3 FROM mp"),
    "WIN_04_ecdf": _query(lambda i: reports.ecdf(i.statistics(), ["n_clusters"], "max_gap"), "SELECT n_clusters, max_gap, CAST(100.0 AS DOUBLE) * row_number() OVER (PARTITION BY n_clusters ORDER BY max_gap) / count(*) OVER (PARTITION BY n_clusters) AS CUMULATIVE_PERCENTAGE FROM mstat"),
    "SRT_02_seeded_sample": _query(_sampled, f"SELECT r.IP_ADDR, r.IPID_SEQUENCE FROM mass r JOIN mlab m USING (IP_ADDR) WHERE m.{LABEL} = 'RANDOM' ORDER BY md5(r.IP_ADDR || ':42'), r.IP_ADDR LIMIT 25"),
    "SRT_03_sorted_values": _query(lambda i: i.mass().select("IP_ADDR", F.expr("array_join(sort_array(filter(transform(split(IPID_SEQUENCE, ','), x -> try_cast(x as int)), v -> v IS NOT NULL)), ',')").alias("s")), f"SELECT IP_ADDR, {_DJOIN('s')} AS s FROM ms"),
    "SET_01_tagged_union": _plain(f"SELECT 'RT-based' AS MODE, IP_ADDR, {LABEL} FROM {{blab}} UNION ALL SELECT 'Fixed-Interval' AS MODE, IP_ADDR, {LABEL} FROM {{mlab}}", blab="base_labels", mlab="mass_labels"),
    "SET_02_distinct_union": _plain("SELECT DISTINCT IP_ADDR FROM (SELECT IP_ADDR FROM {base} UNION ALL SELECT IP_ADDR FROM {mass}) AS u", base="base", mass="mass"),
    "SET_03_except": _plain("SELECT IP_ADDR FROM {base} EXCEPT SELECT IP_ADDR FROM {mass}", base="base", mass="mass"),
    "FN_05_deltas": _query(lambda i: let(i.base(True), t=parse_times("SEND_TIMESTAMP_SEQUENCE")).select("IP_ADDR", F.expr(f"array_join({deltas('t')}, ',')").alias("d")), f"SELECT IP_ADDR, {_DJOIN('PROBING_INTERVALS')} AS d FROM bgaps"),
    "CLS_09_base_labels": _query(lambda i: i.base_labels(), f"SELECT IP_ADDR, {LABEL} FROM blab"),
    "CLS_15_mass_labels": _query(lambda i: i.mass_labels(), f"SELECT IP_ADDR, {LABEL} FROM mlab"),
    "CLS_16_mass_statistics": _query(lambda i: i.statistics(), "SELECT * EXCLUDE (k, a) FROM mstat"),
    "CLS_24_strict_parser": _query(lambda i: classify.parsed_strictly(i.mass(), MASS).select("IP_ADDR", _JOINED("values").alias("ipids")), f"SELECT IP_ADDR, {_DJOIN('list_transform(a, lambda x: CASE WHEN x BETWEEN 0 AND 65535 THEN x ELSE -1 END)')} AS ipids FROM mp"),
    "INC_01_base_increments": _query(lambda i: increments.base_increments(i.base()).select("IP_ADDR", LABEL, _JOINED("INCREMENTS").alias("increments")), f"SELECT IP_ADDR, {LABEL}, {_DJOIN('INCREMENTS')} AS increments FROM binc"),
    "INC_02_mass_increments": _query(lambda i: increments.mass_increments(i.mass()).select("IP_ADDR", LABEL, _JOINED("INCREMENTS").alias("increments")), f"SELECT IP_ADDR, {LABEL}, {_DJOIN('INCREMENTS')} AS increments FROM minc"),
    "INT_01_probing_intervals": _query(lambda i: i.intervals(True).select("IP_ADDR", _JOINED("PROBING_INTERVALS").alias("intervals")), f"SELECT IP_ADDR, {_DJOIN('PROBING_INTERVALS')} AS intervals FROM mgaps"),
    "GEN_01_generated_labels": _query(_generated),
    "GEN_04_impaired_labels": _query(_impaired),
    "GEN_05_timestamps": _query(lambda i: synthetic.with_timestamps(i.spark.range(1), MASS, True).select(F.col("SEND_TIMESTAMP_SEQUENCE").alias("sent"), F.col("RECEIVE_TIMESTAMP_SEQUENCE").alias("received")), "WITH RECURSIVE r(i, sent) AS (SELECT 0, 1700000000000000 UNION ALL SELECT i + 1, sent + 2000 + (i % 4) * 100 + 250 FROM r WHERE i < 99) SELECT string_agg(CAST(sent AS VARCHAR), ',' ORDER BY i) AS sent, string_agg(CAST(sent + 2000 + (i % 4) * 100 AS VARCHAR), ',' ORDER BY i) AS received FROM r"),
    "RPT_01_merged_distribution": _query(lambda i: reports.distribution(i.merged()), _DIST("merged")),
    "RPT_04_continent_intervals": _query(lambda i: _ROUND(reports.continent_intervals(i.intervals(False), i.intervals(True), i.continents(), 5).select("CONTINENT_CODE", "CONTINENT", "MODE", "IP_COUNT_MODE", "IP_COUNT_UNION", "P99_5_MS", F.posexplode("QUANTILES_MS").alias("i", "q")), "P99_5_MS", "q"), f"SELECT CONTINENT_CODE, CONTINENT, MODE, IP_COUNT_MODE, IP_COUNT_UNION, round(p, 6) AS P99_5_MS, CAST(i AS INTEGER) AS i, round(q[i + 1], 6) AS q FROM (SELECT CONTINENT_CODE, any_value(CONTINENT) AS CONTINENT, MODE, count(DISTINCT IP_ADDR) AS IP_COUNT_MODE, quantile_cont(MEDIAN_MS, 0.995) AS p, quantile_cont(MEDIAN_MS, [0.0, {0.995 * 1 / 4}, {0.995 * 2 / 4}, {0.995 * 3 / 4}, 0.995]) AS q FROM med JOIN cont USING (IP_ADDR) WHERE CONTINENT_CODE <> 'ZZ' GROUP BY 1, 3) JOIN (SELECT CONTINENT_CODE, count(DISTINCT IP_ADDR) AS IP_COUNT_UNION FROM med JOIN cont USING (IP_ADDR) GROUP BY 1) USING (CONTINENT_CODE), range(5) AS t(i)"),
}
Inputs.statistics = lambda self: classify.mass_statistics(self.mass())


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distribution of strategies in a base campaign: scan, parse, classify, count."""
    return REGISTRY["AGG_01_base_distribution"][0](spark, sf_dir)


def _all_queries() -> dict:
    from hopmark.plans.parts import PARTS

    return REGISTRY | PARTS


def queries() -> dict:
    return {k: run for k, (run, _) in _all_queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all_queries().items() if sql}
