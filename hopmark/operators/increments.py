"""Increments and probing intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopmark.functions.labels import BASE, Config
from hopmark.functions.sequences import deltas, let, parse_times, steps, view
from hopmark.operators.classify import _with_base, mass_increments

__all__ = ["base_increments", "mass_increments", "probing_intervals"]


def base_increments(raw: DataFrame, config: Config = BASE, skip_first: bool = False) -> DataFrame:
    """IP_ADDR, IPID_SELECTION_STRATEGY, INCREMENTS: label and increments in one pass from the raw sequences.

    PER_DESTINATION: one destination's steps after the other's; PER_CONNECTION and PER_BUCKET: one connection's after the
    other's; all other complete rows: the whole sequence's. Rows without a complete sequence have none."""
    rows = _with_base(raw, config, skip_first)
    c = config.connections
    seq = f"slice(seq2, {c + 1}, {config.length - c})" if skip_first else "seq2"
    rows = let(rows, s=seq)
    by = lambda n: f"concat({', '.join(steps(view('s', i, n)) for i in range(n))})"
    chosen = f"CASE WHEN s IS NULL THEN array() WHEN IPID_SELECTION_STRATEGY = 'PER_DESTINATION' THEN {by(2)} WHEN IPID_SELECTION_STRATEGY IN ('PER_CONNECTION', 'PER_BUCKET') THEN {by(c)} ELSE {steps('s')} END"
    return rows.select("IP_ADDR", "IPID_SELECTION_STRATEGY", F.expr(f"cast({chosen} as array<int>)").alias("INCREMENTS"))


def probing_intervals(raw: DataFrame, column: str = "SEND_TIMESTAMP_SEQUENCE") -> DataFrame:
    """IP_ADDR, PROBING_INTERVALS: microseconds between consecutive timestamps that are present; null stays null."""
    rows = let(raw.select("IP_ADDR", column), ts=parse_times(column))
    return rows.select("IP_ADDR", F.expr(f"CASE WHEN ts IS NOT NULL THEN {deltas('ts')} END").alias("PROBING_INTERVALS"))
