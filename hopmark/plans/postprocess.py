"""The manifest-driven batch: every run, pair and report of a campaign, with Parquet aggregates and JSON facts."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from hopmark.functions import os_names
from hopmark.operators import classify, increments, merge, reports
from hopmark.sources import manifest as m
from hopmark.sources.tables import import_strategies, publish, scan, scan_strategies, write_json

log = logging.getLogger(__name__)


class Campaign:
    def __init__(self, spark: SparkSession, manifest: dict, raw: str, out: str, codec: str = "zstd"):
        self.spark, self.manifest, self.raw, self.out, self.codec = spark, manifest, Path(raw), Path(out), codec

    def source(self, run: m.Measurement, name: str) -> str:
        return str(self.raw / "ipid" / run.measurement_id / name)

    def zmap(self, run: m.Measurement | str | None, name: str = "zmap.pq") -> str:
        return str(self.raw / "zmap" / str(run.zmap_id if isinstance(run, m.Measurement) else run) / name)

    def config(self, run: m.Measurement):
        return m.load_config(m.read_text(self.spark, self.source(run, "ipid.snapshot.yaml")))

    def save(self, df: DataFrame, path: Path, facts: dict | None = None) -> DataFrame:
        os.makedirs(path.parent, exist_ok=True)
        publish(df, str(path), self.codec)
        out = self.spark.read.parquet(str(path))
        if facts is not None:
            write_json(self.spark, str(path.with_suffix(".json")), facts)
        return out

    def strategies(self, run: m.Measurement, reclassify: bool = False) -> DataFrame:
        """Persisted labels first, then those made before, else classify; `reclassify` always classifies."""
        path, kept = run.artifact(self.out, "strategies"), self.source(run, "strategies.pq")
        if not reclassify and os.path.exists(kept):
            os.makedirs(path.parent, exist_ok=True)
            import_strategies(self.spark, kept, str(path), self.codec)
        elif reclassify or not path.exists():
            raw, config = scan(self.spark, self.source(run, "ipid.pq"), ["IP_ADDR", "IPID_SEQUENCE"]), self.config(run)
            labels = classify.classify_mass(raw, config) if run.scale == "mass" else classify.classify_base(raw, config, run.protocol == "tcp")
            self.save(labels, path)
        return scan_strategies(self.spark, str(path))

    def coverage(self, run: m.Measurement) -> dict:
        target = self.zmap(run) if run.scale == "base" else self.source(run, "targets.pq")
        target = target if os.path.exists(target) else self.zmap(run)
        facts = merge.checked_coverage(scan(self.spark, target, ["IP_ADDR"]), scan(self.spark, self.source(run, "ipid.pq"), ["IP_ADDR"]))
        write_json(self.spark, str(run.artifact(self.out, "coverage", "json")), facts)
        return facts

    def measurement(self, run: m.Measurement, reclassify: bool = False) -> None:
        self.coverage(run)
        labels = self.strategies(run, reclassify)
        self.save(reports.distribution(labels), run.artifact(self.out, "distribution"), {r["IPID_SELECTION_STRATEGY"]: r["COUNT"] for r in reports.distribution(labels).collect()})
        raw, config = scan(self.spark, self.source(run, "ipid.pq"), ["IP_ADDR", "IPID_SEQUENCE", "SEND_TIMESTAMP_SEQUENCE"]), self.config(run)
        gaps = self.save(increments.probing_intervals(raw), run.artifact(self.out, "intervals"))
        self.save(reports.interval_histogram(gaps, exact=False), run.artifact(self.out, "interval-histogram"), {k: v for k, v in reports.interval_summary(gaps, exact=False).first().asDict().items()})
        steps = increments.mass_increments(raw, config) if run.scale == "mass" else increments.base_increments(raw, config, run.protocol == "tcp")
        steps = self.save(steps, run.artifact(self.out, "increments"))
        self.save(reports.increment_cdf(steps, exact=False), run.artifact(self.out, "increment-cdf"))

    def merged(self, pair: m.Pair) -> None:
        base, mass = self.strategies(pair.first), self.strategies(pair.second)
        labels, stats = merge.checked_merge(base, mass)
        labels = self.save(labels, pair.artifact(self.out, "strategies"), stats._asdict())
        self.save(reports.distribution(labels), pair.artifact(self.out, "distribution"))
        facts = merge.check_refinement(base, mass)
        tcp = pair.first.protocol == "tcp"
        connection = m.resolve(self.manifest, "tcp.ipid.connection.rt-based.base") if tcp else None
        self.save(reports.refinement(base, mass, self.strategies(connection) if connection else None), pair.artifact(self.out, "strategy-refinement"), facts)
        self.os_report(labels, pair.first, pair.artifact(self.out, "os-by-strategy"))
        if tcp:
            scan_ = scan(self.spark, self.zmap(pair.first), ["IP_ADDR", "REPLY_TYPE"])
            self.save(reports.tcp_flags(labels, scan_), pair.artifact(self.out, "tcp-flags-by-strategy"), merge.check_tcp(labels, scan_))

    def os_report(self, labels: DataFrame, run: m.Measurement, path: Path) -> None:
        source = self.raw / "os" / str(self.manifest[run.protocol].get("os")) / "os.pq"
        if source.exists():
            table, names = scan(self.spark, str(source), ["IP_ADDR", "OS_NAME"]), os_names.dimension(self.spark)
            facts = merge.check_os(table, labels, names)
            self.save(reports.os_matrix(table, labels, names), path, facts)

    def comparison(self, pair: m.Pair, continents: DataFrame | None = None) -> None:
        steps = [self.spark.read.parquet(str(r.artifact(self.out, "increments"))) for r in (pair.first, pair.second)]
        self.save(reports.increment_distributions(*steps), pair.artifact(self.out, "increment-distributions"))
        self.save(reports.intersection(self.strategies(pair.first), self.strategies(pair.second)), pair.artifact(self.out, "strategy-intersection"))
        if continents is not None:
            gaps = [self.spark.read.parquet(str(r.artifact(self.out, "intervals"))) for r in (pair.first, pair.second)]
            self.save(reports.continent_intervals(*gaps, continents, exact=False), pair.artifact(self.out, "continent-intervals"))

    def run(self, reclassify: bool = False, continents: DataFrame | None = None) -> dict[str, str]:
        """All units in order; a unit that fails is reported and the next goes on."""
        done: dict[str, str] = {}

        def unit(name: str, work: Callable[[], None]) -> None:
            try:
                work()
                done[name] = "done"
            except Exception as e:  # each unit stands alone
                log.warning("%s: %s", name, e)
                done[name] = f"failed: {e}"

        for r in m.measurements(self.manifest):
            unit(r.target, lambda r=r: self.measurement(r, reclassify))
        if run := m.resolve(self.manifest, "tcp.ipid.connection.rt-based.base"):
            unit("tcp connection os", lambda: self.os_report(self.strategies(run), run, run.artifact(self.out, "os-by-strategy")))
        for p in m.pairs(self.manifest, "merged"):
            unit(f"merged {p.stem}", lambda p=p: self.merged(p))
        for p in m.pairs(self.manifest, "comparison"):
            unit(f"comparison {p.stem}", lambda p=p: self.comparison(p, continents))
        return done
