"""Queries for the inventory's smaller parts: single functions, rules, checks, sinks and reports, with the SQL that gives the same rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopmark.functions import stats
from hopmark.functions.labels import BASE, LABELS, MASS
from hopmark.functions.sequences import every, exact_rules, let, literal, share, steps, tokens, view
from hopmark.operators import classify, geo, increments, merge, reports, synthetic
from hopmark.plans import registry as r
from hopmark.plans import validation
from hopmark.plans.registry import _DJOIN, _N, LABEL, Inputs, _plain, _query
from hopmark.sources import manifest, tables

# Inputs of single functions.
_BASE = lambda i: let(i.base(), a=tokens("IPID_SEQUENCE"))
_WHOLE = lambda i: _BASE(i).where("forall(a, v -> v IS NOT NULL)")
_WHOLE_SQL = "FROM bp WHERE len(list_filter(a, lambda x: x IS NULL)) = 0"
_ONE, _TWO, _FOUR = (r._diff("a", "16", d) for d in (1, 2, 4))
_SHIFT = f"list_transform(range(1, 17), lambda i: (a[i] - {r._PATTERN(16)}[i]) & 65535)"


def _rule(spark_sql: str, sql: str):
    """A position rule on complete base rows."""
    return _query(lambda i: _WHOLE(i).select("IP_ADDR", F.expr(spark_sql).alias("holds")), f"SELECT IP_ADDR, {sql} AS holds {_WHOLE_SQL}")


def _row(spark: SparkSession, facts: dict) -> DataFrame:
    return spark.range(1).select(*(F.lit(v).cast("double" if isinstance(v, float) else "long").alias(k) for k, v in facts.items()))


def _folder(spark: SparkSession) -> str:
    """The folder that all nodes share: the checkpoint folder, or the warehouse where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/_artifacts/{spark.sparkContext.applicationId}"


def _published(i: Inputs, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    return i.spark.read.parquet(tables.publish(df, f"{_folder(i.spark)}/{name}.pq", codec))


def _replaced(i: Inputs) -> DataFrame:
    """A second publication takes the place of the first."""
    path = f"{_folder(i.spark)}/replaced.pq"
    tables.publish(i.base_labels().limit(0), path)
    return i.spark.read.parquet(tables.publish(i.base_labels(), path))


def _imported(i: Inputs) -> DataFrame:
    kept = tables.publish(i.base_labels(), f"{_folder(i.spark)}/kept.pq")
    return _row(i.spark, {"n": tables.import_strategies(i.spark, kept, f"{_folder(i.spark)}/imported.pq")})


def _batches(i: Inputs) -> DataFrame:
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [pc.sum(pc.binary_length(b.column(0))).as_py() or 0]})

    return i.base().select("IPID_SEQUENCE").mapInArrow(run, "n long, size long").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))


def _last_octet(address: str) -> tuple[str, str] | None:
    """A caller's lookup, as a stand-in for a database."""
    n = int(address.rpartition(".")[2])
    return None if n % 3 == 0 else (("EU", "Europe") if n % 3 == 1 else ("NA", "North America"))


_SNAPSHOT = "connection_count: 4\nrequests_per_connection: 25\nrequest_ip_ids: [1, 2, 3, 4]\nfurther: ignored\n"
_MANIFEST = json.dumps({"tcp": {"zmap": "z1", "ipid": {"no-connection": {"rt-based": {"base": "tcp-80_a"}, "fixed-interval": {"mass": "tcp-80_b", "base": "tcp-80_d"}}, "connection": {"rt-based": {"base": "tcp-80_c"}}}}, "icmp": {"zmap": "z2", "ipid": {"no-connection": {"rt-based": {"base": "icmp_a"}}}}})


def _snapshot(i: Inputs) -> DataFrame:
    c = manifest.load_config(_SNAPSHOT)
    return _row(i.spark, {"connections": c.connections, "requests": c.requests, "length": c.length, "identifiers": len(c.request_ip_ids)})


def _manifest(i: Inputs) -> DataFrame:
    m = manifest.load_manifest(_MANIFEST)
    rows = [(x.target, x.measurement_id, x.stem) for x in manifest.measurements(m)] + [(p.kind, p.first.measurement_id, p.stem) for k in ("merged", "comparison") for p in manifest.pairs(m, k)]
    return i.spark.createDataFrame(rows, "target string, measurement_id string, stem string")


# The chi-square tail and the score, from series and recurrences of their own.
_LOWER = lambda a, x: f"list_sum(list_transform(range(0, 1600), lambda j: exp(({a} + j) * ln({x}) - {x} - lgamma({a} + j + 1.0))))"
_UPPER = lambda a, x: f"CASE WHEN {x} <= 0 THEN 1.0 ELSE greatest(0.0, least(1.0, 1.0 - {_LOWER(a, x)})) END"
_P = "CAST(21845 AS DOUBLE) / 65536"
_TAIL = lambda n, k: f"CASE WHEN {n} < 2 OR {k} <= 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range({k}, {n} + 1), lambda j: exp(lgamma({n} + 1.0) - lgamma(j + 1.0) - lgamma({n} - j + 1.0) + j * ln({_P}) + ({n} - j) * ln(1.0 - {_P}))))) END"
_GAP = "CASE WHEN n_present < 2 THEN 1.0 ELSE least(1.0, n_present * pow(1.0 - CAST(max_gap AS DOUBLE) / 65536, n_present - 1)) END"
_OCCUPANCY = (
    "occ AS (SELECT n, ps FROM (WITH RECURSIVE o(n, ps) AS (SELECT 0, [CAST(1.0 AS DOUBLE)] UNION ALL SELECT n + 1, list_transform(range(0, n + 2), lambda d: coalesce(ps[d + 1], 0) * d / 65536 + CASE WHEN d > 0 THEN ps[d] * (65536 - d + 1) / 65536 ELSE 0 END) FROM o WHERE n < 100) SELECT * FROM o))"
)
_UNIFORM = f"uni AS (SELECT n_present, sum_squares, CASE WHEN n_present < 2 THEN 1.0 ELSE {_UPPER('7.5', 'x')} END AS u FROM (SELECT DISTINCT n_present, sum_squares, (16.0 * sum_squares / greatest(n_present, 1) - n_present) / 2 AS x FROM mstat))"


def _joined_with(extra: list[str], sql: str) -> str:
    """The derived relations, then further ones, then the query."""
    head = r._with("SELECT 1 FROM mstat").removesuffix("SELECT 1 FROM mstat").rstrip()
    return f"{head}, {', '.join(extra)} {sql}"


_SCORES_SQL = _joined_with(
    [_OCCUPANCY, _UNIFORM],
    f"SELECT IP_ADDR, n_present, round(u, 8) AS uniformity, round(d, 8) AS occupancy, round(g, 8) AS gap, round(b, 8) AS bounded_increment, round(least(u, d, g, b), 8) AS score FROM (SELECT IP_ADDR, n_present, u, least(1.0, list_sum(ps[1 : n_distinct + 1])) AS d, {_GAP} AS g, least({', '.join(_TAIL(f'{f}_pairs', f'{f}_bounded') for f, _ in r._FAMILIES)}) AS b FROM mstat JOIN uni USING (n_present, sum_squares) JOIN occ ON occ.n = n_present)",
)
_COMPACT = [f"list_filter(list_transform(range({f}, 100, {d}), lambda i: a[i + 1]), lambda v: v IS NOT NULL)" for f, d in ((0, 1), (0, 2), (1, 2), (0, 4), (1, 4), (2, 4), (3, 4))]
_CHI2_CTES = [
    f"seven AS (SELECT IP_ADDR, unnest([{', '.join(_COMPACT)}]) AS c FROM mp)",
    "stp AS (SELECT IP_ADDR, list_transform(range(1, len(c)), lambda i: (c[i + 1] - c[i]) & 65535) AS s FROM seven)",
    f"sq AS (SELECT IP_ADDR, len(s) AS n, {r._SQUARES(4)} AS q FROM stp)",
    f"pq AS (SELECT n, q, CASE WHEN n < 2 THEN 1.0 ELSE {_UPPER('1.5', 'x')} END AS p FROM (SELECT DISTINCT n, q, (4.0 * q / greatest(n, 1) - n) / 2 AS x FROM sq))",
    "chi AS (SELECT IP_ADDR, min(p) AS p FROM sq JOIN pq USING (n, q) GROUP BY 1)",
]


def _chi2_sql(sql: str) -> str:
    head = r._with("SELECT 1 FROM mp JOIN mlab").removesuffix("SELECT 1 FROM mp JOIN mlab").rstrip()
    return f"{head}, {', '.join(_CHI2_CTES)} {sql}"


def _scores(i: Inputs) -> DataFrame:
    return classify.random_scores(i.mass()).select("IP_ADDR", "n_present", *(F.round(s, 8).alias(s) for s in classify.SCORES))


def _gammas(i: Inputs) -> DataFrame:
    return i.spark.createDataFrame([(m, x, round(stats.upper_gamma(m, x / 2), 8)) for m in (1, 7) for x in range(1, 61)], "m long, x long, q double")


def _tails(i: Inputs) -> DataFrame:
    return i.spark.createDataFrame([(n, k, round(stats.binomial_tail(n, k), 8)) for n in (2, 44, 79, 96, 98, 99) for k in range(0, n + 1)], "n long, k long, p double")


def _numbers(i: Inputs, column: str, sql: str, source: str = "base") -> DataFrame:
    return let(getattr(i, source)(), a=tokens("IPID_SEQUENCE")).select("IP_ADDR", F.expr(sql).alias(column))


def _series(i: Inputs) -> DataFrame:
    return i.merged().join(i.os(), "IP_ADDR").groupBy("OS_NAME", LABEL).agg(F.count("*").alias("n"))


def _strategies(i: Inputs, name: str) -> DataFrame:
    """Generated sequences, their length, and what the classifier calls them."""
    samples = synthetic.generate(i.spark, (name,), 200, MASS, 42)
    n = samples.select("IP_ADDR", "SAMPLE_ID", F.size(F.split("IPID_SEQUENCE", ",")).cast("long").alias("n"))
    return n.join(classify.classify_mass(samples), "IP_ADDR").select("SAMPLE_ID", "n", LABEL)


_GENERATED_SQL = f"SELECT '{{0}}-' || i AS SAMPLE_ID, CAST(100 AS BIGINT) AS n, '{{0}}' AS {LABEL} FROM range(200) AS t(i)"


def _metrics(i: Inputs) -> DataFrame:
    """The validation driver on a few samples a strategy: one row a data set."""
    found = validation.validate(i.spark, 50, 20)
    return i.spark.createDataFrame([(k, v["sample_count"], v["accuracy"]) for k, v in found.items() if "accuracy" in v], "DATASET string, n long, accuracy double")


def _calibrated(i: Inputs) -> DataFrame:
    s = synthetic.generate(i.spark, ("RANDOM",), 500, MASS, 42)
    rows = [classify.random_scores(s.select("IP_ADDR", F.col(c).alias("IPID_SEQUENCE"))).select(F.lit(n).alias("DATASET"), "score") for n, c in (("complete", "IPID_SEQUENCE"), ("lossy", "LOSSY_SEQUENCE"))]
    return reports.calibrated_threshold(rows[0].union(rows[1]), "DATASET", "score", 0.01)


def _inspected(i: Inputs) -> DataFrame:
    rows, _ = reports.sample(i.mass(), i.mass_labels(), "UNCLASSIFIED", 10, 42)
    return classify.random_scores(rows)


def _os_order(i: Inputs) -> DataFrame:
    m = r.REGISTRY["AGG_16_os_matrix"][0](i.spark, i.dir)
    return m.select("OS_GROUP", "OS_NAME", "OS_TOTAL", "OS_POSITION").distinct()


def _same(name: str):
    """A report is the aggregate of that name."""
    return r.REGISTRY[name]


def _renamed(name: str, columns: str):
    run, sql = r.REGISTRY[name]
    return (lambda spark, d: run(spark, d).selectExpr(*columns.split("; "))), f"SELECT {columns.replace('; ', ', ')} FROM ({sql})"


_VIEWS_SQL = ", ".join(f"{_DJOIN(x)} AS {n}" for n, x in (("full_steps", _ONE), ("destination_steps", _TWO), ("connection_steps", _FOUR)))
_INC = f"(SELECT 'RT-based' AS MODE, {LABEL}, unnest(INCREMENTS) AS v FROM binc)"

PARTS = {
    "SRC_06_batch_reader": _query(_batches, f"SELECT {_N} AS n, CAST(sum(strlen(IPID_SEQUENCE)) AS BIGINT) AS size FROM base"),
    "SRC_08_snapshot": _query(_snapshot, "SELECT CAST(4 AS BIGINT) AS connections, CAST(25 AS BIGINT) AS requests, CAST(100 AS BIGINT) AS length, CAST(4 AS BIGINT) AS identifiers"),
    "SRC_09_manifest": _query(_manifest, "SELECT * FROM (VALUES ('tcp.ipid.no-connection.rt-based.base', 'tcp-80_a', 'n-rt-b'), ('tcp.ipid.no-connection.fixed-interval.base', 'tcp-80_d', 'n-fi-b'), ('tcp.ipid.no-connection.fixed-interval.mass', 'tcp-80_b', 'n-fi-m'), ('tcp.ipid.connection.rt-based.base', 'tcp-80_c', 'c-rt-b'), ('icmp.ipid.no-connection.rt-based.base', 'icmp_a', 'n-rt-b'), ('merged', 'tcp-80_a', 'n-rt-b_fi-m'), ('comparison', 'tcp-80_a', 'n-rt-b_fi-b')) AS t(target, measurement_id, stem)"),
    "SRC_10_caller_lookup": _query(lambda i: geo.continents_by_lookup(i.addresses(), lambda: _last_octet), "SELECT DISTINCT IP_ADDR, ['ZZ', 'EU', 'NA'][(k % 256) % 3 + 1] AS CONTINENT_CODE, ['Unknown', 'Europe', 'North America'][(k % 256) % 3 + 1] AS CONTINENT FROM addr"),
    "SRC_11_store": _query(lambda i: i.spark.createDataFrame([(n, tables.exists(i.spark, f"{i.dir}/{n}")) for n in ("orders.parquet", "orders.parq")], "name string, found boolean"), "SELECT * FROM (VALUES ('orders.parquet', true), ('orders.parq', false)) AS t(name, found)"),
    "SNK_01_parquet_sink": _query(lambda i: _published(i, i.base_labels(), "labels", "snappy"), f"SELECT IP_ADDR, {LABEL} FROM blab"),
    "SNK_02_interval_sink": _query(lambda i: _published(i, i.intervals(False), "intervals").select("IP_ADDR", r._JOINED("PROBING_INTERVALS").alias("intervals")), f"SELECT IP_ADDR, {_DJOIN('PROBING_INTERVALS')} AS intervals FROM bgaps"),
    "SNK_03_atomic_publish": _query(_replaced, f"SELECT IP_ADDR, {LABEL} FROM blab"),
    "SNK_05_strategy_import": _query(_imported, f"SELECT {_N} AS n FROM blab"),
    "PRJ_01_label_cast": _plain(f"SELECT IP_ADDR, CAST({LABEL} AS VARCHAR(40)) AS label FROM {{mlab}}", mlab="mass_labels"),
    "PRJ_03_searched_case": _query(lambda i: merge.merge(i.base_labels(), i.mass_labels()).select("IP_ADDR", F.col(LABEL).alias("outcome")), f"SELECT IP_ADDR, {LABEL} AS outcome FROM merged"),
    "PRJ_05_literal_tag": _plain(f"SELECT 'Fixed-Interval' AS MODE, IP_ADDR, {LABEL} FROM {{mlab}}", mlab="mass_labels"),
    "PRJ_07_percentage": _query(lambda i: i.mass_labels().groupBy(LABEL).agg(F.count("*").alias("n")).select(LABEL, share(F.col("n"), F.sum("n").over(Window.partitionBy())).alias("PERCENTAGE")), f"SELECT {LABEL}, CAST(100.0 AS DOUBLE) * count(*) / sum(count(*)) OVER () AS PERCENTAGE FROM mlab GROUP BY 1"),
    "FLT_01_label_equality": _plain(f"SELECT IP_ADDR FROM {{blab}} WHERE {LABEL} = 'UNCLASSIFIED'", blab="base_labels"),
    "JN_08_replies_of_merged": _plain(f"SELECT m.IP_ADDR, m.{LABEL}, lower(trim(z.REPLY_TYPE)) AS reply FROM {{merged}} m JOIN {{zmap}} z ON m.IP_ADDR = z.IP_ADDR WHERE lower(trim(z.REPLY_TYPE)) IN ('synack', 'rst')", merged="merged", zmap="zmap"),
    "JN_10_group_counts": _renamed("RPT_04_continent_intervals", "CONTINENT_CODE; MODE; IP_COUNT_MODE; IP_COUNT_UNION"),
    "JN_14_scalar_subqueries": _plain(f"SELECT (SELECT CAST(count(*) AS BIGINT) FROM {{blab}}) AS base_rows, (SELECT CAST(count(*) AS BIGINT) FROM {{mlab}}) AS mass_rows, (SELECT CAST(count(*) AS BIGINT) FROM {{zmap}} WHERE REPLY_TYPE = 'Rst') AS rst_rows", blab="base_labels", mlab="mass_labels", zmap="zmap"),
    "AGG_04_two_key_counts": _plain(f"SELECT lower(trim(OS_NAME)) AS OS_NAME, {LABEL}, CAST(count(*) AS BIGINT) AS n FROM {{os}} o JOIN {{merged}} m ON o.IP_ADDR = m.IP_ADDR GROUP BY 1, 2", os="os", merged="merged"),
    "AGG_05_three_key_histogram": _query(lambda i: increments.base_increments(i.base()).select(F.lit("RT-based").alias("MODE"), LABEL, F.explode("INCREMENTS").alias("v")).where("v > 0").groupBy("MODE", LABEL, F.col("v").cast("long").alias("INCREMENT")).agg(F.count("*").alias("n")), f"SELECT MODE, {LABEL}, CAST(v AS BIGINT) AS INCREMENT, {_N} AS n FROM {_INC} WHERE v > 0 GROUP BY 1, 2, 3"),
    "AGG_07_scalar_quantile": _query(lambda i: i.intervals(False).select(F.explode("PROBING_INTERVALS").alias("v")).agg(F.percentile("v", F.lit(0.995)).alias("q")), "SELECT quantile_cont(CAST(v AS DOUBLE), 0.995) AS q FROM (SELECT unnest(PROBING_INTERVALS) AS v FROM bgaps)"),
    "AGG_10_any_value": _plain("SELECT CONTINENT_CODE, any_value(CONTINENT) AS CONTINENT, CAST(count(*) AS BIGINT) AS n FROM {cont} GROUP BY CONTINENT_CODE", cont="continents"),
    "AGG_17_shares_by_flag": _renamed("AGG_18_tcp_flags", f"TCP_FLAGS; {LABEL}; PERCENTAGE"),
    "WIN_01_running_count": _renamed("AGG_13_increment_distributions", f"MODE; {LABEL}; INCREMENT; CUMULATIVE_COUNT"),
    "WIN_02_cutoff": _plain("SELECT n_clusters, max_gap, n FROM (SELECT n_clusters, max_gap, CAST(count(*) AS BIGINT) AS n, sum(count(*)) OVER (PARTITION BY n_clusters ORDER BY max_gap) AS cum, sum(count(*)) OVER (PARTITION BY n_clusters) AS total FROM {mstat} GROUP BY n_clusters, max_gap) AS t WHERE 10 * (cum - n) < 9 * total", mstat="statistics"),
    "WIN_05_os_order": _query(_os_order, f"SELECT DISTINCT OS_GROUP, OS_NAME, OS_TOTAL, OS_POSITION FROM ({r.REGISTRY['AGG_16_os_matrix'][1]})"),
    "WIN_06_row_totals": _plain(f"SELECT OS_NAME, {LABEL}, n, CAST(sum(n) OVER (PARTITION BY OS_NAME) AS BIGINT) AS total FROM (SELECT OS_NAME, {LABEL}, CAST(count(*) AS BIGINT) AS n FROM {{os}} o JOIN {{merged}} m ON o.IP_ADDR = m.IP_ADDR GROUP BY 1, 2) AS t", os="os", merged="merged"),
    "WIN_07_compacted": _query(lambda i: _numbers(i, "present", "array_join(filter(a, v -> v IS NOT NULL), ',')"), f"SELECT IP_ADDR, {_DJOIN('list_filter(a, lambda x: x IS NOT NULL)')} AS present FROM bp"),
    "SRT_01_ordered": _plain(f"SELECT {LABEL}, CAST(count(*) AS BIGINT) AS n FROM {{merged}} GROUP BY {LABEL} ORDER BY {LABEL}", merged="merged"),
    "SET_04_concatenation": _query(lambda i: i.base_labels().unionByName(i.mass_labels()).groupBy(LABEL).agg(F.count("*").alias("n")), f"SELECT {LABEL}, {_N} AS n FROM (SELECT {LABEL} FROM blab UNION ALL SELECT {LABEL} FROM mlab) GROUP BY 1"),
    "FN_01_split": _query(lambda i: i.base().selectExpr("IP_ADDR", "element_at(split(IPID_SEQUENCE, ','), 3) AS third"), "SELECT IP_ADDR, string_split(IPID_SEQUENCE, ',')[3] AS third FROM base"),
    "FN_02_try_cast": _query(lambda i: i.base().selectExpr("IP_ADDR", "coalesce(try_cast(element_at(split(IPID_SEQUENCE, ','), 1) as bigint), -1L) AS v"), "SELECT IP_ADDR, coalesce(TRY_CAST(string_split(IPID_SEQUENCE, ',')[1] AS BIGINT), -1) AS v FROM base"),
    "FN_03_transform_filter": _query(lambda i: _numbers(i, "v", "array_join(transform(filter(a, x -> x > 1000), x -> x - 1000), ',')"), f"SELECT IP_ADDR, {_DJOIN('list_transform(list_filter(a, lambda x: x > 1000), lambda x: x - 1000)')} AS v FROM bp"),
    "FN_04_length": _query(lambda i: _numbers(i, "n", "cast(size(filter(a, v -> v IS NOT NULL)) as bigint)", "mass"), "SELECT IP_ADDR, CAST(len(list_filter(a, lambda x: x IS NOT NULL)) AS BIGINT) AS n FROM mp"),
    "FN_06_coalesce": _query(lambda i: _numbers(i, "v", "array_join(transform(a, x -> coalesce(x, -1)), ',')"), f"SELECT IP_ADDR, {_DJOIN('list_transform(a, lambda x: coalesce(x, -1))')} AS v FROM bp"),
    "FN_07_unnest": _query(lambda i: increments.base_increments(i.base()).select("IP_ADDR", F.explode(F.col("INCREMENTS").cast("array<long>")).alias("v")), "SELECT IP_ADDR, CAST(unnest(INCREMENTS) AS BIGINT) AS v FROM binc"),
    "FN_08_strings": _plain("SELECT IP_ADDR, lower(trim(OS_NAME)) || ':' || upper(OS_NAME) AS s FROM {os}", os="os"),
    "FN_09_floor_least": _plain("SELECT IP_ADDR, CAST(least(floor(max_gap / 1000.0), 49) AS BIGINT) AS bin FROM {mstat}", mstat="statistics"),
    "FN_10_hash": _plain("SELECT IP_ADDR, md5(concat(IP_ADDR, ':42')) AS h FROM {base}", base="base"),
    "FN_11_modular_difference": _query(lambda i: _numbers(i, "d", f"array_join({steps('a')}, ',')"), f"SELECT IP_ADDR, {_DJOIN(f'list_filter({_ONE}, lambda x: x IS NOT NULL)')} AS d FROM bp"),
    "FN_12_upper_gamma": _query(_gammas, f"SELECT m, x, round({_UPPER('(m + CAST(0.5 AS DOUBLE))', '(x / 2.0)')}, 8) AS q FROM (SELECT unnest([CAST(1 AS BIGINT), 7]) AS m) CROSS JOIN (SELECT CAST(unnest(range(1, 61)) AS BIGINT) AS x)"),
    "FN_13_binomial_tail": _query(_tails, f"SELECT n, k, round({_TAIL('n', 'k')}, 8) AS p FROM (SELECT n, unnest(range(0, n + 1)) AS k FROM (SELECT unnest([CAST(2 AS BIGINT), 44, 79, 96, 98, 99]) AS n))"),
    "FN_14_power_and_bounds": _plain("SELECT IP_ADDR, round(least(1.0, greatest(0.0, n_present * power(1.0 - CAST(max_gap AS DOUBLE) / 65536, n_present - 1))), 8) AS g FROM {mstat}", mstat="statistics"),
    "FN_15_sha256": _query(lambda i: i.base().select("IP_ADDR", F.sha2("IPID_SEQUENCE", 256).alias("h")), "SELECT IP_ADDR, sha256(IPID_SEQUENCE) AS h FROM base"),
    "FN_16_address_numbers": _query(lambda i: i.addresses().select("IP_ADDR", F.expr(geo.address_number("IP_ADDR")).alias("n")), "SELECT IP_ADDR, CAST(167772160 + k % 16777216 AS BIGINT) AS n FROM addr"),
    "DQ_01_coverage": _query(lambda i: _row(i.spark, merge.checked_coverage(i.base(), i.mass())), r.REGISTRY["AGG_19_coverage"][1]),
    "DQ_02_refinement": _query(lambda i: _row(i.spark, merge.check_refinement(i.base_labels(), i.refined())), r.REGISTRY["JN_02_refinement_facts"][1]),
    "DQ_03_unknown_labels": _query(lambda i: i.merged().where(~F.col(LABEL).isin(*LABELS)).select(LABEL).distinct(), f"SELECT DISTINCT {LABEL} FROM merged WHERE {LABEL} NOT IN (SELECT {LABEL} FROM labels10)"),
    "DQ_04_connection": _query(lambda i: _row(i.spark, dict(zip(("rows", "distinct_rows"), (merge.check_connection(i.merged()), merge.counts_and_distinct(i.merged()))[1], strict=True))), f"SELECT {_N} AS rows, count(DISTINCT IP_ADDR) AS distinct_rows FROM merged"),
    "DQ_05_os": _query(lambda i: _row(i.spark, merge.check_os(i.os(), i.mass_labels(), r.os_names.dimension(i.spark), True)), r.REGISTRY["JN_06_os_facts"][1]),
    "DQ_06_tcp": _query(lambda i: _row(i.spark, merge.check_tcp(i.merged(), i.zmap())), r.REGISTRY["JN_07_tcp_facts"][1]),
    "DQ_07_lengths": _query(lambda i: classify.parsed_strictly(i.mass(), MASS).groupBy(F.size("values").cast("long").alias("length")).agg(F.count("*").alias("n")), f"SELECT CAST(len(a) AS BIGINT) AS length, {_N} AS n FROM mp GROUP BY 1"),
    "DQ_08_positions": _query(lambda i: classify.parsed_strictly(i.base(), MASS).groupBy(F.size("values").cast("long").alias("length")).agg(F.count("*").alias("n")), f"SELECT CAST(100 AS BIGINT) AS length, {_N} AS n FROM base"),
    "CLS_01_views": _query(lambda i: _WHOLE(i).select("IP_ADDR", *(F.expr(f"array_join({steps('a', d)}, ',')").alias(f"{n}_steps") for n, d in (("full", 1), ("destination", 2), ("connection", 4)))), f"SELECT IP_ADDR, {_VIEWS_SQL} {_WHOLE_SQL}"),
    "CLS_02_reflection": _rule(f"size(array_distinct(zip_with(a, {literal(BASE.pattern)}, (x, y) -> (x - y) & 65535))) = 1", f"len(list_distinct({_SHIFT})) = 1"),
    "CLS_03_constant": _rule(every(steps("a"), 0), r._all(_ONE, 0, 0)),
    "CLS_04_per_destination": _rule(every(steps("a", 2), 1), r._all(_TWO, 1, 1)),
    "CLS_05_per_connection": _rule(every(steps("a", 4), 1), r._all(_FOUR, 1, 1)),
    "CLS_06_single": _rule(every(steps("a"), 1, 21845), r._all(_ONE, 1, 21845)),
    "CLS_07_per_bucket": _rule(every(steps("a", 4), 1, 21845), r._all(_FOUR, 1, 21845)),
    "CLS_08_priority": _rule(f"coalesce({exact_rules('a', BASE)}, 'UNCLASSIFIED')", f"coalesce({r._exact(16)}, 'UNCLASSIFIED')"),
    "CLS_10_presence": _plain("SELECT IP_ADDR, n_present FROM {mstat}", mstat="statistics"),
    "CLS_11_mass_exact": _query(lambda i: classify.classify_mass(i.whole()).where(F.col(LABEL).isin(*LABELS[:6])), f"SELECT IP_ADDR, {r._exact(100)} AS {LABEL} FROM wp WHERE {r._exact(100)} IS NOT NULL"),
    "CLS_12_constant_fallback": _plain("SELECT IP_ADDR FROM {mstat} WHERE n_present >= 1 AND n_distinct = 1", mstat="statistics"),
    "CLS_13_clusters": _plain("SELECT IP_ADDR, n_clusters FROM {mstat}", mstat="statistics"),
    "CLS_14_multi": _plain("SELECT IP_ADDR, n_clusters BETWEEN 2 AND 16 AND n_distinct > 1 AS holds FROM {mstat}", mstat="statistics"),
    "CLS_17_occupancy": _plain("SELECT IP_ADDR, n_present, n_distinct FROM {mstat}", mstat="statistics"),
    "CLS_18_gap_bound": _query(lambda i: _scores(i).select("IP_ADDR", "gap"), r._with(f"SELECT IP_ADDR, round({_GAP}, 8) AS gap FROM mstat")),
    "CLS_19_bounded_increments": _query(lambda i: _scores(i).select("IP_ADDR", "bounded_increment"), r._with(f"SELECT IP_ADDR, round(least({', '.join(_TAIL(f'{f}_pairs', f'{f}_bounded') for f, _ in r._FAMILIES)}), 8) AS bounded_increment FROM mstat")),
    "CLS_20_scores": (_query(_scores)[0], _SCORES_SQL),
    "CLS_21_legacy_bins": _plain("SELECT IP_ADDR, n_present, legacy_squares FROM {mstat}", mstat="statistics"),
    "CLS_22_increment_uniformity": (_query(lambda i: classify.increment_uniformity(i.mass()).select("IP_ADDR", F.round("MINIMUM_CHI2_P_VALUE", 8).alias("MINIMUM_CHI2_P_VALUE")))[0], _chi2_sql("SELECT IP_ADDR, round(p, 8) AS MINIMUM_CHI2_P_VALUE FROM chi")),
    "CLS_23_diagnostics": _query(lambda i: classify.random_scores(i.mass())),
    "CLS_26_protocols": _query(lambda i: i.spark.createDataFrame([(x, manifest.measurement_protocol(x)) for x in ("tcp-80_a", "icmp_b", "udp-53_c")], "id string, protocol string"), "SELECT * FROM (VALUES ('tcp-80_a', 'tcp'), ('icmp_b', 'icmp'), ('udp-53_c', 'udp-dns')) AS t(id, protocol)"),
    "INC_03_labels_with_increments": _query(lambda i: increments.base_increments(i.base()).select("IP_ADDR", LABEL, F.size("INCREMENTS").cast("long").alias("n")), f"SELECT IP_ADDR, {LABEL}, CAST(len(INCREMENTS) AS BIGINT) AS n FROM binc"),
    "INT_02_interval_counts": _query(lambda i: i.intervals(False).select("IP_ADDR", F.size("PROBING_INTERVALS").cast("long").alias("n")), "SELECT IP_ADDR, CAST(len(PROBING_INTERVALS) AS BIGINT) AS n FROM bgaps"),
    "GEN_02_multi": _query(lambda i: _strategies(i, "MULTI"), _GENERATED_SQL.format("MULTI")),
    "GEN_03_random": _query(lambda i: _strategies(i, "RANDOM"), _GENERATED_SQL.format("RANDOM")),
    "GEN_06_serialised": _query(lambda i: _numbers(i, "s", "array_join(a, ',', '-')"), "SELECT IP_ADDR, IPID_SEQUENCE AS s FROM base"),
    "GEN_07_validation": _query(_metrics, "SELECT * FROM (VALUES ('rt-based', CAST(240 AS BIGINT), CAST(1.0 AS DOUBLE)), ('fixed-interval', 340, 1.0), ('lossy', 120, 1.0), ('lossy-reordered', 120, 1.0)) AS t(DATASET, n, accuracy)"),
    "GEN_08_calibration": _query(_calibrated),
    "GEN_09_value_cdf": _query(lambda i: reports.ecdf(i.statistics().join(i.mass_labels(), "IP_ADDR"), [LABEL], "sum_squares"), f"SELECT {LABEL}, sum_squares, CAST(100.0 AS DOUBLE) * row_number() OVER (PARTITION BY {LABEL} ORDER BY sum_squares) / count(*) OVER (PARTITION BY {LABEL}) AS CUMULATIVE_PERCENTAGE FROM mstat JOIN mlab USING (IP_ADDR)"),
    "RPT_02_interval_histogram": _same("AGG_11_interval_histogram"),
    "RPT_03_increment_cdf": _same("AGG_12_increment_cdf"),
    "RPT_05_increment_distributions": _same("AGG_13_increment_distributions"),
    "RPT_06_intersection": _same("AGG_14_intersection_table"),
    "RPT_07_refinement": _query(lambda i: reports.refinement(i.base_labels(), i.refined()), f"SELECT MEASUREMENT_TYPE, {LABEL}, CAST(n AS BIGINT) AS COUNT, CAST(sum(n) OVER (PARTITION BY MEASUREMENT_TYPE) AS BIGINT) AS TOTAL, CAST(100.0 AS DOUBLE) * n / sum(n) OVER (PARTITION BY MEASUREMENT_TYPE) AS PERCENTAGE FROM (SELECT 'RT-based' AS MEASUREMENT_TYPE, {LABEL}, count(*) AS n FROM blab GROUP BY 2 UNION ALL SELECT 'Fixed-Interval', {LABEL}, count(*) FROM refined GROUP BY 2 UNION ALL SELECT 'Fixed-Interval', 'NOT_ENOUGH_SAMPLES', (SELECT count(*) FROM blab WHERE {LABEL} = 'UNCLASSIFIED') - (SELECT count(*) FROM refined)) WHERE n > 0"),
    "RPT_08_connection_refinement": _same("AGG_15_refinement"),
    "RPT_09_tcp_flags": _same("AGG_18_tcp_flags"),
    "RPT_10_os_by_strategy": _same("AGG_16_os_matrix"),
    "RPT_11_confusion_shares": _query(lambda i: reports.confusion(i.samples()).withColumn("PERCENTAGE", share(F.col("COUNT"), F.sum("COUNT").over(Window.partitionBy("EXPECTED_STRATEGY")))), f"SELECT EXPECTED_STRATEGY, DETECTED_STRATEGY, {_N} AS COUNT, CAST(100.0 AS DOUBLE) * count(*) / sum(count(*)) OVER (PARTITION BY EXPECTED_STRATEGY) AS PERCENTAGE FROM samples GROUP BY 1, 2"),
    "RPT_12_uniformity_summary": (
        _query(lambda i: r._ROUND(reports.value_summary(classify.increment_uniformity(i.mass()).join(i.mass_labels(), "IP_ADDR"), [LABEL], "MINIMUM_CHI2_P_VALUE", 0.05), "MIN", "Q25", "MEDIAN", "Q75", "MAX"))[0],
        _chi2_sql(f"SELECT {LABEL}, {_N} AS COUNT, round(min(p), 6) AS MIN, round(quantile_cont(p, 0.25), 6) AS Q25, round(quantile_cont(p, 0.5), 6) AS MEDIAN, round(quantile_cont(p, 0.75), 6) AS Q75, round(max(p), 6) AS MAX, CAST(count(*) FILTER (WHERE p < 0.05) AS BIGINT) AS BELOW, CAST(100.0 AS DOUBLE) * count(*) FILTER (WHERE p < 0.05) / count(*) AS BELOW_PERCENTAGE FROM chi JOIN mlab USING (IP_ADDR) GROUP BY 1"),
    ),
    "RPT_13_score_summary": _query(lambda i: r._ROUND(reports.value_summary(classify.random_scores(i.mass()).join(i.mass_labels(), "IP_ADDR"), [LABEL], "score", 1e-5), "MIN", "Q25", "MEDIAN", "Q75", "MAX")),
    "RPT_14_inspector": _query(_inspected),
    "MRG_01_merge_stats": _query(lambda i: _row(i.spark, merge.checked_merge(i.base_labels(), i.mass_labels())[1]._asdict()), f"SELECT {_N} AS rows, CAST(count(*) FILTER (WHERE {LABEL} = 'NOT_ENOUGH_SAMPLES') AS BIGINT) AS not_enough_samples FROM merged"),
}
