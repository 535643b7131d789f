"""Selection strategies of base and mass sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopmark.functions import stats
from hopmark.functions.labels import BASE, BINS, CLUSTER_GAP, LABELS, LEGACY_BINS, MASS, MAX_CLUSTERS, MAX_INC, MODULUS, TAU, Config
from hopmark.functions.sequences import exact_rules, let, parse_fixed

SEQ = "IPID_SEQUENCE"


def classify_base(raw: DataFrame, config: Config = BASE, skip_first: bool = False) -> DataFrame:
    """IP_ADDR, IPID_SELECTION_STRATEGY. Rows with a missing value, or of another length, are UNCLASSIFIED. Native, narrow."""
    return _with_base(raw, config, skip_first).select("IP_ADDR", "IPID_SELECTION_STRATEGY")


def _with_base(raw: DataFrame, config: Config, skip_first: bool) -> DataFrame:
    tokens = f"transform(split({SEQ}, ','), x -> try_cast(x as int))"
    rows = let(raw.select("IP_ADDR", SEQ), seq=tokens)
    rows = let(rows, seq2=f"CASE WHEN size(seq) = {config.length} AND forall(seq, v -> coalesce(v BETWEEN 0 AND 65535, false)) THEN seq END").drop("seq")
    return rows.select("*", F.expr(f"CASE WHEN seq2 IS NULL THEN 'UNCLASSIFIED' ELSE coalesce({exact_rules('seq2', config, skip_first)}, 'UNCLASSIFIED') END").alias("IPID_SELECTION_STRATEGY"))


def parse_matrix(column: pa.Array, length: int) -> np.ndarray:
    """Sequences as a matrix, -1 where missing (no number, or outside 0 to 65535); longer ones raise."""
    column = column.fill_null("")
    parts = pc.split_pattern(column, ",")
    sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    if len(sizes) and sizes.max() > length:
        raise ValueError(f"a sequence is longer than {length}")
    flat = pc.utf8_trim_whitespace(parts.flatten())
    ok = pc.match_substring_regex(flat, r"^\+?[0-9]{1,9}$")
    values = pc.if_else(ok, flat, pa.scalar("-1")).cast(pa.int64()).to_numpy(zero_copy_only=False)
    out = np.full((len(sizes), length), -1, np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[rows, inner] = np.where(values < MODULUS, values, -1)
    return out


def features(v: np.ndarray, config: Config) -> dict[str, np.ndarray]:
    """Whole-number statistics of each row of a matrix with -1 for missing values."""
    present = v >= 0
    n = present.sum(axis=1)
    s = np.sort(np.where(present, v, MODULUS * 4), axis=1)
    gaps = np.diff(s, axis=1)
    gaps[np.arange(1, v.shape[1])[None] >= n[:, None]] = 0
    last = s[np.arange(len(v)), np.maximum(n - 1, 0)]
    wrap = np.where(n > 0, s[:, 0] + MODULUS - last, 0)
    squares, legacy = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
    for bins, total in ((BINS, squares), (LEGACY_BINS, legacy)):
        own = np.where(present, v * bins // MODULUS, -1)
        for b in range(bins):
            total += (own == b).sum(axis=1) ** 2
    out = {
        "n_present": n,
        "sum_squares": squares,
        "legacy_squares": legacy,
        "n_distinct": (gaps > 0).sum(axis=1) + (n > 0),
        "max_gap": np.maximum(gaps.max(axis=1, initial=0), wrap),
        "n_clusters": np.maximum((gaps > CLUSTER_GAP).sum(axis=1) + (wrap > CLUSTER_GAP), 1),
    }
    for name, stride in (("full", 1), ("destination", 2), ("connection", config.connections)):
        both = present[:, stride:] & present[:, :-stride]
        step = (v[:, stride:] - v[:, :-stride]) % MODULUS
        out[f"{name}_pairs"] = both.sum(axis=1)
        out[f"{name}_bounded"] = (both & (step >= 1) & (step <= MAX_INC)).sum(axis=1)
    return out


FAMILIES = ("full", "destination", "connection")


def random_compatible(f: dict[str, np.ndarray], longest: int, tau: float = TAU) -> np.ndarray:
    """Score of at least tau, by the whole-number limits; two values or more."""
    lim = {k: np.array(x) for k, x in stats.limits(longest, tau).items()}
    n = f["n_present"]
    ok = (n >= 2) & (f["sum_squares"] <= lim["squares"][n]) & (f["n_distinct"] >= lim["distinct"][n]) & (f["max_gap"] <= lim["gap"][n])
    for name in FAMILIES:
        ok &= f[f"{name}_bounded"] <= lim["successes"][f[f"{name}_pairs"]]
    return ok


def exact_codes(v: np.ndarray, config: Config) -> np.ndarray:
    """Codes of the position rules for complete rows; -1 where none holds."""
    pattern = np.array(config.pattern)
    shift = (v - pattern) % MODULUS
    steps = {d: (v[:, d:] - v[:, :-d]) % MODULUS for d in (1, 2, config.connections)}
    within = lambda d, a, b: ((steps[d] >= a) & (steps[d] <= b)).all(axis=1)
    c = config.connections
    rules = [(shift == shift[:, :1]).all(axis=1), within(1, 0, 0), within(2, 1, 1), within(c, 1, 1), within(1, 1, MAX_INC), within(c, 1, MAX_INC)]
    return np.select(rules, range(6), -1)


def mass_codes(v: np.ndarray, config: Config, tau: float = TAU) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    f = features(v, config)
    n = f["n_present"]
    code = np.where(n == config.length, exact_codes(v, config), -1)
    constant = (n >= 1) & (f["n_distinct"] == 1)
    multi = (f["n_clusters"] >= 2) & (f["n_clusters"] <= MAX_CLUSTERS)
    rest = np.select([constant, multi & (n >= 1), random_compatible(f, config.length, tau)], [1, 6, 7], 8)
    return np.where(code >= 0, code, rest), f


STATISTICS = ("n_present", "sum_squares", "legacy_squares", "n_distinct", "max_gap", "n_clusters", *(f"{f}_{x}" for f in FAMILIES for x in ("pairs", "bounded")))
SCORES = ("uniformity", "occupancy", "gap", "bounded_increment", "score")
_NAMES = pa.array(LABELS)


def _kernel(raw: DataFrame, config: Config, columns: str, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in columns.split(", ")]
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *make(parse_matrix(b.column(1), config.length))], names)

    return raw.select(F.col("IP_ADDR").cast("string"), F.col(SEQ).cast("string")).mapInArrow(run, columns)


def classify_mass(raw: DataFrame, config: Config = MASS, tau: float = TAU) -> DataFrame:
    """IP_ADDR, IPID_SELECTION_STRATEGY of long sequences with losses.

    Position rules for complete rows; then one value only, 2 to 16 circular clusters, and the randomness score. An Arrow
    kernel works on batches as matrices: the same rules as array expressions cost about three times as much. Null
    sequences have no values and are UNCLASSIFIED; longer ones than configured raise. No shuffle.
    """
    return _kernel(raw, config, "IP_ADDR string, IPID_SELECTION_STRATEGY string", lambda v: [_NAMES.take(pa.array(mass_codes(v, config, tau)[0]))])


def mass_statistics(raw: DataFrame, config: Config = MASS) -> DataFrame:
    """IP_ADDR and the whole-number statistics that decide mass labels."""
    return _kernel(raw, config, "IP_ADDR string, " + ", ".join(f"{s} long" for s in STATISTICS), lambda v: [pa.array(features(v, config)[s], pa.int64()) for s in STATISTICS])


def component_scores(f: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    n = f["n_present"].tolist()
    out = {
        "uniformity": [stats.uniformity(a, s) for a, s in zip(n, f["sum_squares"].tolist(), strict=True)],
        "occupancy": [stats.occupancy(a)[d] for a, d in zip(n, f["n_distinct"].tolist(), strict=True)],
        "gap": [stats.gap_bound(a, g) for a, g in zip(n, f["max_gap"].tolist(), strict=True)],
    }
    tails = [[stats.binomial_tail(a, k) for a, k in zip(f[f"{x}_pairs"].tolist(), f[f"{x}_bounded"].tolist(), strict=True)] for x in FAMILIES]
    out["bounded_increment"] = [min(t) for t in zip(*tails, strict=True)]
    arrays = {k: np.array(x, float) for k, x in out.items()}
    arrays["score"] = np.clip(np.min([*arrays.values()], axis=0), 0, 1) if n else np.zeros(0)
    return arrays


def random_scores(raw: DataFrame, config: Config = MASS) -> DataFrame:
    """IP_ADDR, n_present, the four component scores, their least one, and which component limits it."""

    def make(v: np.ndarray) -> list[pa.Array]:
        f = features(v, config)
        s = component_scores(f)
        which = np.argmin([s[k] for k in SCORES[:4]], axis=0) if len(v) else np.zeros(0, int)
        return [pa.array(f["n_present"], pa.int64()), *(pa.array(s[k], pa.float64()) for k in SCORES), pa.array(SCORES[:4]).take(pa.array(which))]

    return _kernel(raw, config, "IP_ADDR string, n_present long, " + ", ".join(f"{s} double" for s in SCORES) + ", limiting string", make)


def _squares_of_steps(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps between consecutive values present: their number, and the sum of squared counts in the legacy bins."""
    present = v >= 0
    order = np.argsort(~present, axis=1, kind="stable")
    packed = np.take_along_axis(v, order, axis=1)
    n = np.maximum(present.sum(axis=1) - 1, 0)
    step = (packed[:, 1:] - packed[:, :-1]) % MODULUS
    own = np.where(np.arange(step.shape[1])[None] < n[:, None], step * LEGACY_BINS // MODULUS, -1)
    return n, sum((own == b).sum(axis=1) ** 2 for b in range(LEGACY_BINS))


def increment_uniformity(raw: DataFrame, config: Config = MASS) -> DataFrame:
    """IP_ADDR, MINIMUM_CHI2_P_VALUE: the least chi-square p-value of the steps of seven subsequences: all values, both
    destinations, each connection; values that are missing are passed over."""

    def make(v: np.ndarray) -> list[pa.Array]:
        views = [v, v[:, ::2], v[:, 1::2], *(v[:, c :: config.connections] for c in range(config.connections))]
        p = [[stats.uniformity(a, s, LEGACY_BINS) for a, s in zip(*(x.tolist() for x in _squares_of_steps(w)), strict=True)] for w in views]
        return [pa.array([min(x) for x in zip(*p, strict=True)], pa.float64())]

    return _kernel(raw, config, "IP_ADDR string, MINIMUM_CHI2_P_VALUE double", make)


def mass_increments(raw: DataFrame, config: Config = MASS) -> DataFrame:
    """IP_ADDR, IPID_SELECTION_STRATEGY, INCREMENTS: by destination or connection where the label says so and the row is
    complete; else the steps of neighbours that are both present."""
    c = config.connections

    def make(v: np.ndarray) -> list[pa.Array]:
        codes, f = mass_codes(v, config)
        whole = f["n_present"] == config.length
        rows = []
        for row, code, ok in zip(v, codes.tolist(), whole.tolist(), strict=True):
            stride = {2: 2, 3: c, 5: c}.get(code, 1) if ok else 1
            parts = [row[i::stride] for i in range(stride)]
            rows.append(np.concatenate([((p[1:] - p[:-1]) % MODULUS)[(p[1:] >= 0) & (p[:-1] >= 0)] for p in parts]))
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        return [_NAMES.take(pa.array(codes)), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))]

    return _kernel(raw, config, "IP_ADDR string, IPID_SELECTION_STRATEGY string, INCREMENTS array<int>", make)


def parsed_strictly(raw: DataFrame, config: Config) -> DataFrame:
    """IP_ADDR, values: the inspector's parser, -1 where missing."""
    return raw.select("IP_ADDR", F.expr(f"transform({parse_fixed(SEQ, config.length)}, v -> coalesce(v, -1))").alias("values"))
