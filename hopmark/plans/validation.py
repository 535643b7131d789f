"""Validation of the classifier on synthetic data, and calibration of the score's threshold."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopmark.functions.labels import BASE, MASS, Config
from hopmark.operators import classify, reports, synthetic
from hopmark.sources.tables import write_json

#: What each data set generates, and what its classifier may answer.
RT = synthetic.EXACT
FIXED = (*RT, "MULTI", "RANDOM")
IMPAIRED = ("CONSTANT", "MULTI", "RANDOM")


def detected(samples: DataFrame, sequence: str, base: bool, config: Config) -> DataFrame:
    raw = samples.select("IP_ADDR", F.col(sequence).alias("IPID_SEQUENCE"))
    labels = classify.classify_base(raw, config) if base else classify.classify_mass(raw, config)
    labels = labels.select("IP_ADDR", F.col("IPID_SELECTION_STRATEGY").alias("DETECTED_STRATEGY"))
    return samples.select("IP_ADDR", "GENERATOR_STRATEGY", F.col("GENERATOR_STRATEGY").alias("EXPECTED_STRATEGY")).join(labels, "IP_ADDR")


def validate(spark: SparkSession, each: int = 100_000, trivial: int = 1_000, seed: int = 42) -> dict:
    """Five data sets: complete base and mass sequences, mass with losses, with losses and reordering, and clusters under the base
    classifier, which must reject them."""
    rt = synthetic.generate(spark, RT, each, BASE, seed, trivial)
    fixed = synthetic.generate(spark, FIXED, each, MASS, seed + 1, trivial)
    hurt = fixed.where(F.col("GENERATOR_STRATEGY").isin(*IMPAIRED))
    outside = synthetic.generate(spark, ("MULTI",), each, BASE, seed + 2)
    metrics = lambda df, names: reports.confusion_metrics(reports.confusion(df), names)
    return {
        "rt-based": metrics(detected(rt, "IPID_SEQUENCE", True, BASE), RT),
        "fixed-interval": metrics(detected(fixed, "IPID_SEQUENCE", False, MASS), FIXED),
        "lossy": metrics(detected(hurt, "LOSSY_SEQUENCE", False, MASS), IMPAIRED),
        "lossy-reordered": metrics(detected(hurt, "REORDERED_SEQUENCE", False, MASS), IMPAIRED),
        "out-of-scope": {r["GENERATOR_STRATEGY"]: r["REJECTION_RATE"] for r in reports.rejection(detected(outside, "IPID_SEQUENCE", True, BASE)).collect()},
    }


def calibrate(spark: SparkSession, cache: str, each: int = 1_000_000, rate: float = 1e-4, seed: int = 42) -> dict:
    """The score below which `rate` of random sequences fall: complete, lossy and reordered; kept by its parameters."""
    wanted = {"each": each, "rate": rate, "seed": seed, "length": MASS.length}
    if os.path.exists(cache):
        with open(cache, encoding="utf-8") as f:
            kept = json.load(f)
        if kept.get("parameters") == wanted:
            return kept
    samples = synthetic.generate(spark, ("RANDOM",), each, MASS, seed)
    rows = None
    for name, column in (("complete", "IPID_SEQUENCE"), ("lossy", "LOSSY_SEQUENCE"), ("lossy-reordered", "REORDERED_SEQUENCE")):
        one = classify.random_scores(samples.select("IP_ADDR", F.col(column).alias("IPID_SEQUENCE"))).select(F.lit(name).alias("DATASET"), "score")
        rows = one if rows is None else rows.union(one)
    found = reports.calibrated_threshold(rows, "DATASET", "score", rate).collect()
    out = {"parameters": wanted, "datasets": {r["DATASET"]: r["LOWER_QUANTILE"] for r in found}, "threshold": min(r["LOWER_QUANTILE"] for r in found)}
    write_json(spark, cache, out)
    return out
