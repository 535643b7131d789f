"""python -m hopmark.cli COMMAND ...: the commands of a campaign."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from hopmark.operators import classify, reports
from hopmark.plans import validation
from hopmark.plans.postprocess import Campaign
from hopmark.sources import manifest as m
from hopmark.sources.tables import CODECS, scan


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--manifest", default="data.json")
    p.add_argument("--raw", default="data/raw")
    p.add_argument("--out", default="data/processed")
    p.add_argument("--compression", choices=[*CODECS], default="zstd")
    p.add_argument("--threads", type=int, default=0)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("classify", "measure", "coverage", "inspect"):
        c = sub.add_parser(name)
        c.add_argument("target")
        c.add_argument("--reclassify", action="store_true")
        c.add_argument("--label", default="UNCLASSIFIED")
        c.add_argument("--count", type=int, default=10)
        c.add_argument("--seed", type=int, default=42)
    for name in ("merge", "compare"):
        c = sub.add_parser(name)
        c.add_argument("first")
        c.add_argument("second")
    sub.add_parser("analyse").add_argument("--reclassify", action="store_true")
    c = sub.add_parser("validate")
    c.add_argument("--samples", type=int, default=100_000)
    c = sub.add_parser("calibrate")
    c.add_argument("--samples", type=int, default=1_000_000)
    c.add_argument("--cache", default="threshold.json")
    c = sub.add_parser("worker")
    c.add_argument("prefix")
    c.add_argument("checkpoint")
    c.add_argument("--once", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.master(f"local[{a.threads or '*'}]").getOrCreate() if SparkSession.getActiveSession() is None else SparkSession.getActiveSession()
    if a.command == "validate":
        print(json.dumps(validation.validate(spark, a.samples), indent=2))
        return 0
    if a.command == "calibrate":
        print(json.dumps(validation.calibrate(spark, a.cache, a.samples), indent=2))
        return 0
    if a.command == "worker":
        from hopmark.streaming.worker import watch

        watch(spark, a.prefix, a.checkpoint, a.once).awaitTermination()
        return 0
    manifest = m.load_manifest(m.read_text(spark, a.manifest))
    campaign = Campaign(spark, manifest, a.raw, a.out, a.compression)
    if a.command == "analyse":
        done = campaign.run(a.reclassify)
        print(json.dumps(done, indent=2))
        return int(any(v != "done" for v in done.values()))
    runs = [m.resolve(manifest, t) for t in ([a.target] if hasattr(a, "target") else [a.first, a.second])]
    if None in runs:
        print("the manifest has no such run", file=sys.stderr)
        return 1
    if a.command == "classify":
        reports.distribution(campaign.strategies(runs[0], a.reclassify)).show()
    elif a.command == "measure":
        campaign.measurement(runs[0], a.reclassify)
    elif a.command == "coverage":
        print(json.dumps(campaign.coverage(runs[0])))
    elif a.command == "inspect":
        raw = scan(spark, campaign.source(runs[0], "ipid.pq"), ["IP_ADDR", "IPID_SEQUENCE"])
        rows, n = reports.sample(raw, campaign.strategies(runs[0]), a.label, a.count, a.seed)
        print(f"{n} rows")
        classify.random_scores(rows, campaign.config(runs[0])).show(a.count, False)
    elif a.command == "merge":
        campaign.merged(m.Pair("merged", *runs))
    else:
        campaign.comparison(m.Pair("comparison", *runs))
    return 0


if __name__ == "__main__":
    sys.exit(main())
