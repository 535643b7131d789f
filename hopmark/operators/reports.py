"""Aggregates behind the reports. All group by partial aggregation; only tables of a few labels are made dense."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopmark.functions.labels import LABELS
from hopmark.functions.sequences import median, share
from hopmark.operators.merge import LABEL, label_rows

#: Labels that the strategy intersection compares, and those of the increment comparison.
INTERSECTION = ("REFLECTION", "CONSTANT", "PER_DESTINATION", "PER_CONNECTION", "SINGLE", "PER_BUCKET", "UNCLASSIFIED")
INCREMENT_STRATEGIES = ("PER_DESTINATION", "PER_CONNECTION", "SINGLE", "PER_BUCKET")
MODES = ("RT-based", "Fixed-Interval")
#: Fixed value: the third bar of the refinement.
CONNECTION = "RT-based & Connection-oriented"


def distribution(strategies: DataFrame) -> DataFrame:
    """position, IPID_SELECTION_STRATEGY, COUNT, PERCENTAGE of all ten labels; unknown labels are left out."""
    n = strategies.groupBy(LABEL).agg(F.count("*").alias("n"))
    rows = F.broadcast(label_rows(strategies.sparkSession)).join(n, LABEL, "left").select("position", LABEL, F.coalesce("n", F.lit(0)).alias("COUNT"))
    return rows.withColumn("PERCENTAGE", share(F.col("COUNT"), F.sum("COUNT").over(Window.partitionBy())))


def interval_summary(intervals: DataFrame, column: str = "PROBING_INTERVALS", clip: float = 0.99, exact: bool = True) -> DataFrame:
    """One row: n, lo, hi, mean, std, p50, p90, pc. Exact percentiles interpolate; percentile_approx otherwise."""
    q = (lambda p: F.percentile("v", F.lit(p))) if exact else (lambda p: F.percentile_approx("v", F.lit(p)))
    v = intervals.select(F.explode(column).alias("v"))
    return v.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), q(0.5).alias("p50"), q(0.9).alias("p90"), q(clip).alias("pc"))


def interval_histogram(intervals: DataFrame, column: str = "PROBING_INTERVALS", bins: int = 50, clip: float = 0.99, exact: bool = True) -> DataFrame:
    """bin (from 0), lower edge, count of fixed-width bins up to the clip percentile; empty bins are there. No values: no rows."""
    s = interval_summary(intervals, column, clip, exact).where("n > 0").select("lo", F.expr("CASE WHEN pc > lo THEN cast(pc as double) ELSE cast(hi as double) END").alias("top"))
    s = s.withColumn("width", F.greatest((F.col("top") - F.col("lo")) / F.lit(float(bins)), F.lit(1.0)))
    v = intervals.select(F.explode(column).alias("v")).crossJoin(F.broadcast(s)).where("v BETWEEN lo AND top")
    n = v.groupBy(F.expr(f"cast(least(floor((v - lo) / width), {bins - 1}) as int)").alias("bin")).agg(F.count("*").alias("n"))
    every = s.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "width")
    return every.join(n, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("edge"), F.coalesce("n", F.lit(0)).alias("COUNT"))


def increment_cdf(increments: DataFrame, points: int = 200, exact: bool = True) -> DataFrame:
    """By label: count, and the increments at `points` even quantiles from 0 to 1."""
    p = F.array(*(F.lit(i / (points - 1)) for i in range(points)))
    q = F.percentile("v", p) if exact else F.percentile_approx("v", p)
    return increments.select(LABEL, F.explode("INCREMENTS").alias("v")).groupBy(LABEL).agg(F.count("*").alias("COUNT"), q.alias("QUANTILES"))


def increment_distributions(rt: DataFrame, fixed: DataFrame, quantile: float = 0.999) -> DataFrame:
    """MODE x label x increment: counts up to the first increment at which `quantile` of all is reached, cumulative shares of
    those kept, and how many were clipped. Only positive increments of the counting strategies."""
    both = None
    for mode, df in zip(MODES, (rt, fixed), strict=True):
        rows = df.where(F.col(LABEL).isin(*INCREMENT_STRATEGIES)).select(F.lit(mode).alias("MODE"), LABEL, F.explode("INCREMENTS").alias("INCREMENT")).where("INCREMENT > 0")
        both = rows if both is None else both.unionByName(rows)
    n = both.groupBy("MODE", LABEL, "INCREMENT").agg(F.count("*").alias("COUNT"))
    series = Window.partitionBy("MODE", LABEL)
    n = n.withColumn("CUMULATIVE_COUNT", F.sum("COUNT").over(series.orderBy("INCREMENT").rowsBetween(Window.unboundedPreceding, 0))).withColumn("TOTAL_COUNT", F.sum("COUNT").over(series))
    kept = n.where(F.col("CUMULATIVE_COUNT") - F.col("COUNT") < F.lit(quantile) * F.col("TOTAL_COUNT")).withColumn("RETAINED_COUNT", F.sum("COUNT").over(series))
    return kept.select("MODE", LABEL, "INCREMENT", "COUNT", "CUMULATIVE_COUNT", share(F.col("CUMULATIVE_COUNT"), F.col("RETAINED_COUNT")).alias("CUMULATIVE_PERCENTAGE"), "TOTAL_COUNT", "RETAINED_COUNT", (F.col("TOTAL_COUNT") - F.col("RETAINED_COUNT")).alias("CLIPPED_COUNT"))


def intersection_counts(rt: DataFrame, fixed: DataFrame, labels: tuple[str, ...] = INTERSECTION) -> DataFrame:
    """Counts of addresses in both, by the two labels."""
    a = rt.select("IP_ADDR", F.col(LABEL).alias("RT_BASED_STRATEGY")).where(F.col("RT_BASED_STRATEGY").isin(*labels))
    b = fixed.select("IP_ADDR", F.col(LABEL).alias("FIXED_INTERVAL_STRATEGY")).where(F.col("FIXED_INTERVAL_STRATEGY").isin(*labels))
    return a.join(b, "IP_ADDR").groupBy("RT_BASED_STRATEGY", "FIXED_INTERVAL_STRATEGY").agg(F.count("*").alias("COUNT"))


def intersection(rt: DataFrame, fixed: DataFrame, labels: tuple[str, ...] = INTERSECTION) -> DataFrame:
    """The dense table of both labels, with shares of each RT-based label."""
    names = rt.sparkSession.createDataFrame([(x,) for x in labels], "s string")
    grid = names.select(F.col("s").alias("RT_BASED_STRATEGY")).crossJoin(names.select(F.col("s").alias("FIXED_INTERVAL_STRATEGY")))
    keys = ["RT_BASED_STRATEGY", "FIXED_INTERVAL_STRATEGY"]
    dense = F.broadcast(grid).join(intersection_counts(rt, fixed, labels), keys, "left").select(*keys, F.coalesce("COUNT", F.lit(0)).alias("COUNT"))
    dense = dense.withColumn("RT_BASED_TOTAL", F.sum("COUNT").over(Window.partitionBy("RT_BASED_STRATEGY")))
    return dense.withColumn("PERCENTAGE", share(F.col("COUNT"), F.col("RT_BASED_TOTAL")))


def refinement(rt: DataFrame, fixed: DataFrame, connection: DataFrame | None = None) -> DataFrame:
    """Shares of labels: of the RT-based table; of its unclassified rows after the fixed-interval run, the rest being
    NOT_ENOUGH_SAMPLES; and of the connection table, if there is one. Zero rows are left out."""
    one = rt.groupBy(LABEL).agg(F.count("*").alias("COUNT")).select(F.lit(MODES[0]).alias("MEASUREMENT_TYPE"), LABEL, "COUNT")
    two = fixed.groupBy(LABEL).agg(F.count("*").alias("COUNT"))
    rest = rt.agg(F.count_if(F.col(LABEL) == "UNCLASSIFIED").alias("u")).crossJoin(fixed.agg(F.count("*").alias("f"))).select(F.lit("NOT_ENOUGH_SAMPLES").alias(LABEL), (F.col("u") - F.col("f")).alias("COUNT"))
    two = two.unionByName(rest).groupBy(LABEL).agg(F.sum("COUNT").alias("COUNT")).select(F.lit(MODES[1]).alias("MEASUREMENT_TYPE"), LABEL, "COUNT")
    rows = one.unionByName(two)
    if connection is not None:
        rows = rows.unionByName(connection.groupBy(LABEL).agg(F.count("*").alias("COUNT")).select(F.lit(CONNECTION).alias("MEASUREMENT_TYPE"), LABEL, "COUNT"))
    rows = rows.where("COUNT > 0").withColumn("TOTAL", F.sum("COUNT").over(Window.partitionBy("MEASUREMENT_TYPE")))
    return rows.withColumn("PERCENTAGE", share(F.col("COUNT"), F.col("TOTAL")))


def tcp_flags(strategies: DataFrame, zmap: DataFrame) -> DataFrame:
    """Shares of labels among all replies and by reply: one aggregation over grouping sets."""
    z = zmap.select("IP_ADDR", F.lower(F.trim(F.col("REPLY_TYPE").cast("string"))).alias("reply")).where(F.col("reply").isin("synack", "rst"))
    joined = strategies.select("IP_ADDR", LABEL).join(z, "IP_ADDR")
    n = joined.groupingSets([[F.col(LABEL)], [F.col(LABEL), F.col("reply")]], F.col(LABEL), F.col("reply")).agg(F.count("*").alias("COUNT"), F.grouping("reply").alias("g"))
    flag = F.when(F.col("g") == 1, "SYN-ACK/RST").when(F.col("reply") == "synack", "SYN-ACK").otherwise("RST")
    n = n.select(flag.alias("TCP_FLAGS"), LABEL, "COUNT").withColumn("TOTAL", F.sum("COUNT").over(Window.partitionBy("TCP_FLAGS")))
    return n.withColumn("PERCENTAGE", share(F.col("COUNT"), F.col("TOTAL")))


def os_counts(os: DataFrame, strategies: DataFrame) -> DataFrame:
    named = os.select("IP_ADDR", F.lower(F.trim(F.col("OS_NAME").cast("string"))).alias("OS_NAME")).where("OS_NAME IS NOT NULL AND OS_NAME <> ''")
    return named.join(strategies.select("IP_ADDR", LABEL), "IP_ADDR").groupBy("OS_NAME", LABEL).agg(F.count("*").alias("COUNT"))


def os_matrix(os: DataFrame, strategies: DataFrame, dimension: DataFrame) -> DataFrame:
    """Labels of each operating system that occurs, with zeros, its totals and shares, and its place within its group: by
    falling total, then by label without regard to case."""
    spark = os.sparkSession
    n = os_counts(os, strategies)
    seen = n.groupBy("OS_NAME").agg(F.sum("COUNT").alias("OS_TOTAL")).join(F.broadcast(dimension), "OS_NAME")
    seen = seen.withColumn("OS_POSITION", F.row_number().over(Window.partitionBy("OS_GROUP").orderBy(F.desc("OS_TOTAL"), F.lower("OS_LABEL"))))
    grid = seen.crossJoin(F.broadcast(label_rows(spark).select(LABEL)))
    dense = grid.join(n, ["OS_NAME", LABEL], "left").select("OS_GROUP", "OS_NAME", "OS_LABEL", LABEL, F.coalesce("COUNT", F.lit(0)).alias("COUNT"), "OS_TOTAL", "OS_POSITION")
    return dense.withColumn("PERCENTAGE", share(F.col("COUNT"), F.col("OS_TOTAL")))


def interval_medians(rt: DataFrame, fixed: DataFrame) -> DataFrame:
    """MODE, IP_ADDR, MEDIAN_MS: the median probing interval of each address, in milliseconds."""
    rows = None
    for mode, df in zip(MODES, (rt, fixed), strict=True):
        one = df.select(F.lit(mode).alias("MODE"), "IP_ADDR", (F.expr(median("PROBING_INTERVALS")) / F.lit(1000.0)).alias("MEDIAN_MS"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def continent_intervals(rt: DataFrame, fixed: DataFrame, continents: DataFrame, points: int = 256, exact: bool = True) -> DataFrame:
    """By continent and mode: addresses, addresses of the continent in either mode, the 99.5th percentile and `points` even
    quantiles up to it of the addresses' median intervals."""
    m = interval_medians(rt, fixed).where("MEDIAN_MS >= 0").join(continents, "IP_ADDR").where("CONTINENT_CODE <> 'ZZ'")
    p = F.array(*(F.lit(0.995 * i / (points - 1)) for i in range(points)))
    q = F.percentile if exact else F.percentile_approx
    by_mode = m.groupBy("CONTINENT_CODE", "MODE").agg(F.any_value("CONTINENT").alias("CONTINENT"), F.countDistinct("IP_ADDR").alias("IP_COUNT_MODE"), q("MEDIAN_MS", F.lit(0.995)).alias("P99_5_MS"), q("MEDIAN_MS", p).alias("QUANTILES_MS"))
    union = m.groupBy("CONTINENT_CODE").agg(F.countDistinct("IP_ADDR").alias("IP_COUNT_UNION"))
    return by_mode.join(F.broadcast(union), "CONTINENT_CODE").select("CONTINENT_CODE", "CONTINENT", "MODE", "IP_COUNT_MODE", "IP_COUNT_UNION", "P99_5_MS", "QUANTILES_MS")


def value_summary(df: DataFrame, group: list[str], value: str, below: float) -> DataFrame:
    """By group: count, min, quartiles, max, and how many are below a threshold."""
    q = lambda p: F.percentile(value, F.lit(p))
    out = df.groupBy(*group).agg(F.count("*").alias("COUNT"), F.min(value).alias("MIN"), q(0.25).alias("Q25"), q(0.5).alias("MEDIAN"), q(0.75).alias("Q75"), F.max(value).alias("MAX"), F.count_if(F.col(value) < below).alias("BELOW"))
    return out.withColumn("BELOW_PERCENTAGE", share(F.col("BELOW"), F.col("COUNT")))


def ecdf(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Each value with the share of its group's values up to its place in ascending order."""
    w = Window.partitionBy(*group)
    place = F.row_number().over(w.orderBy(value))
    return df.select(*group, value, (F.lit(100.0) * place / F.count("*").over(w)).alias("CUMULATIVE_PERCENTAGE"))


def calibrated_threshold(scores: DataFrame, group: str, value: str, rate: float) -> DataFrame:
    """By dataset the score at place floor(rate * (n - 1)) in ascending order, and the least of these over all datasets."""
    w = Window.partitionBy(group)
    rows = scores.select(group, value, (F.row_number().over(w.orderBy(value)) - 1).alias("i"), F.count("*").over(w).alias("n"))
    own = rows.where(F.col("i") == F.floor(F.lit(rate) * (F.col("n") - 1))).select(group, F.col(value).alias("LOWER_QUANTILE"))
    return own.withColumn("THRESHOLD", F.min("LOWER_QUANTILE").over(Window.partitionBy()))


def sample(raw: DataFrame, strategies: DataFrame, label: str, k: int, seed: int) -> tuple[DataFrame, int]:
    """k rows of a label in the order of a seeded hash of the address, the same at every run, and the population."""
    rows = raw.join(strategies.where(F.col(LABEL) == label).select("IP_ADDR"), "IP_ADDR")
    return rows.orderBy(F.md5(F.concat(F.col("IP_ADDR"), F.lit(f":{seed}"))), "IP_ADDR").limit(k), rows.count()


def confusion(df: DataFrame) -> DataFrame:
    """EXPECTED_STRATEGY, DETECTED_STRATEGY, COUNT"""
    return df.groupBy("EXPECTED_STRATEGY", "DETECTED_STRATEGY").agg(F.count("*").alias("COUNT"))


def confusion_metrics(counts: DataFrame, generated: tuple[str, ...], detected: tuple[str, ...] = LABELS[:9]) -> dict:
    """Metrics of a confusion matrix: a few numbers a class, taken to the driver. Labels outside raise."""
    import math

    cell = {(r[0], r[1]): r[2] for r in counts.collect()}
    wrong = sorted({a for a, _ in cell} - {*generated}), sorted({b for _, b in cell} - {*detected})
    if any(wrong):
        raise ValueError(f"strategies outside the matrix: expected {wrong[0]}, detected {wrong[1]}")
    total = sum(cell.values())
    support = {a: sum(cell.get((a, b), 0) for b in detected) for a in generated}
    predicted = {b: sum(cell.get((a, b), 0) for a in generated) for b in detected}
    div = lambda a, b: a / b if b else 0.0
    classes = {}
    for a in generated:
        hit = cell.get((a, a), 0)
        p, r = div(hit, predicted[a]), div(hit, support[a])
        classes[a] = {"support": support[a], "predicted": predicted[a], "correct": hit, "precision": p, "recall": r, "f1": div(2 * p * r, p + r)}
    correct = sum(c["correct"] for c in classes.values())
    agree = sum(support[a] * predicted[a] for a in generated)
    accuracy, chance = div(correct, total), div(agree, total * total)
    spread = math.sqrt((total**2 - sum(v * v for v in predicted.values())) * (total**2 - sum(v * v for v in support.values())))
    mean = lambda k: div(sum(c[k] for c in classes.values()), len(classes))
    weighted = lambda k: div(sum(c[k] * c["support"] for c in classes.values()), total)
    return {
        "sample_count": total,
        "correct_count": correct,
        "misclassified_count": total - correct,
        "accuracy": accuracy,
        "balanced_accuracy": mean("recall"),
        "macro": {k: mean(k) for k in ("precision", "recall", "f1")},
        "weighted": {k: weighted(k) for k in ("precision", "recall", "f1")},
        "cohen_kappa": (accuracy - chance) / (1 - chance) if chance < 1 else 1.0,
        "multiclass_matthews_correlation_coefficient": div(correct * total - agree, spread),
        "classes": classes,
        "detected_output_counts": predicted,
        "confusion_matrix": {"generated_class_order": [*generated], "detected_class_order": [*detected], "counts": [[cell.get((a, b), 0) for b in detected] for a in generated], "row_percentages": [[100.0 * div(cell.get((a, b), 0), support[a]) for b in detected] for a in generated]},
    }


def rejection(df: DataFrame, expected: str = "UNCLASSIFIED") -> DataFrame:
    """By generator: how many were detected as `expected`."""
    n = df.groupBy("GENERATOR_STRATEGY").agg(F.count("*").alias("SAMPLE_COUNT"), F.count_if(F.col("DETECTED_STRATEGY") == expected).alias("REJECTED_COUNT"))
    return n.withColumn("REJECTION_RATE", F.when(F.col("SAMPLE_COUNT") > 0, F.col("REJECTED_COUNT") / F.col("SAMPLE_COUNT")).otherwise(F.lit(0.0)))


def abbreviated(n: float) -> str:
    """Counts for display: 1.2k, 3.4M."""
    for size, unit in ((1_000_000, "M"), (1_000, "k")):
        if n >= size:
            text = f"{n / size:.1f}"
            return text.removesuffix(".0") + unit
    return str(int(n))


def percent_text(p: float) -> str:
    return "0" if p == 0 else f"{p:.1f}" if p < 1 else f"{p:.0f}"
