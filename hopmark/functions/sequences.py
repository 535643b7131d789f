"""Sequences as array columns: parsing, 16-bit steps, views. All are SQL expressions that Spark evaluates in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopmark.functions.labels import Config


def let(df: DataFrame, **values: str) -> DataFrame:
    """Bind expressions to names so that each is evaluated once a row: a generator is not inlined as a projection is."""
    for name, sql in values.items():
        df = df.select("*", F.explode(F.array(F.expr(sql))).alias(name))
    return df


def tokens(column: str, kind: str = "int") -> str:
    return f"transform(split({column}, ','), x -> try_cast(x as {kind}))"


def parse_base(column: str) -> str:
    """All values, or an empty array if any token is no number; null stays empty."""
    t = tokens(column)
    return f"CASE WHEN {column} IS NOT NULL AND forall({t}, v -> v IS NOT NULL) THEN {t} ELSE array() END"


def parse_mass(column: str, missing: int = -1) -> str:
    return f"transform(split({column}, ','), x -> coalesce(try_cast(x as int), {missing}))"


def parse_times(column: str) -> str:
    """The numbers, without missing ones."""
    return f"filter({tokens(column, 'bigint')}, v -> v IS NOT NULL)"


def parse_fixed(column: str, length: int) -> str:
    """Values of 0 to 65535, null where missing or out of range, filled with nulls to `length`; a longer one raises."""
    t = f"transform(split({column}, ','), x -> CASE WHEN try_cast(x as int) BETWEEN 0 AND 65535 THEN try_cast(x as int) END)"
    size = f"size(split({column}, ','))"
    return f"CASE WHEN {column} IS NULL THEN array_repeat(cast(null as int), {length}) WHEN {size} > {length} THEN raise_error('sequence is longer than {length}') ELSE concat({t}, array_repeat(cast(null as int), {length} - {size})) END"


def steps(array: str, stride: int = 1) -> str:
    """16-bit differences of values `stride` places apart; null where either is missing."""
    rest = f"greatest(size({array}) - {stride}, 0)"
    return f"zip_with(slice({array}, {1 + stride}, {rest}), slice({array}, 1, {rest}), (b, a) -> (b - a) & 65535)"


def deltas(array: str) -> str:
    """Plain differences of neighbours; none for fewer than two."""
    rest = f"greatest(size({array}) - 1, 0)"
    return f"zip_with(slice({array}, 2, {rest}), slice({array}, 1, {rest}), (b, a) -> b - a)"


def every(array: str, low: int, high: int | None = None) -> str:
    return f"forall({array}, v -> v BETWEEN {low} AND {low if high is None else high})"


def view(array: str, first: int, stride: int) -> str:
    """Every stride-th value from `first` (from 0) on."""
    return f"filter({array}, (v, i) -> i % {stride} = {first})"


def literal(values: list) -> str:
    return f"array({', '.join(map(str, values))})"


def exact_rules(array: str, config: Config, skip_first: bool = False) -> str:
    """The first position rule that a complete sequence meets, or null. With skip_first, each connection's first value is
    the handshake's and is left out of every view."""
    c, pattern = config.connections, config.pattern
    if skip_first:
        array, pattern = f"slice({array}, {c + 1}, {config.length - c})", pattern[c:]
    shift = f"size(array_distinct(zip_with({array}, {literal(pattern)}, (x, y) -> (x - y) & 65535))) = 1"
    one, two, own = steps(array), steps(array, 2), steps(array, c)
    return (
        f"CASE WHEN {shift} THEN 'REFLECTION' WHEN {every(one, 0)} THEN 'CONSTANT' WHEN {every(two, 1)} THEN 'PER_DESTINATION' "
        f"WHEN {every(own, 1)} THEN 'PER_CONNECTION' WHEN {every(one, 1, 21845)} THEN 'SINGLE' WHEN {every(own, 1, 21845)} THEN 'PER_BUCKET' END"
    )


def median(array: str) -> str:
    """Median with linear interpolation; null for an empty array."""
    s, n = f"array_sort({array})", f"size({array})"
    return f"CASE WHEN {n} > 0 THEN (element_at({s}, cast(({n} + 1) div 2 as int)) + element_at({s}, cast({n} div 2 + 1 as int))) / 2.0D END"


def share(n: Column, total: Column) -> Column:
    """Percentage; 0 of nothing."""
    return F.when(total > 0, F.lit(100.0) * n / total).otherwise(F.lit(0.0))
