"""Importance resampling as a quality classifier (operator 2).

Two generative models over hashed word n-grams: one of target text (labelled good), one of the raw corpus. The
importance weight of a text is the ratio of its probabilities under the two; Gumbel noise on the log weights makes the top k
a sample without replacement in proportion to the weights. k is a parameter; if it is not given, it is the number of texts that are more
likely target than not by the labelled sample: those whose ratio per n-gram is at least the threshold. To let k decide between texts of all lengths, the
weights that are sampled are those of NGRAMS n-grams: the log ratio of a text is scaled to that length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopmark.llm.common import TOKEN_BYTES, Words, bounded_batches, pieces, stored, tidy

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
#: Labelled rows used, at most about: texts of the target model, and of the choice of the threshold.
LABELLED = 20_000
#: N-grams' worth of the raw model that the target model is smoothed with.
PRIOR = 20_000.0
#: Log ratios are kept as whole multiples of 1 / UNIT, so their sums do not depend on an order.
UNIT = 1 << 20
SEED = 20240
#: The length, in n-grams, that log weights are scaled to.
NGRAMS = 1000
#: A good text lost counts as so many bad texts kept.
GOOD_OVER_BAD = 4.0


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, Words]:
    """Buckets of all words and of all pairs of neighbouring words within a text (the first word's is -1)."""
    w = Words(texts, TOKEN_BYTES, lower=False)
    h = w.hashes()
    shift = np.uint64(64 - BUCKET_BITS)
    with np.errstate(over="ignore"):
        pair = (h[:-1] * np.uint64(0xD6E8FEB86659FD93) ^ h[1:]) * np.uint64(0x9E3779B97F4A7C15)
    two = np.full(len(h), -1, np.int64)
    two[1:] = (pair >> shift).astype(np.int64)
    two[w.first[:-1][w.counts > 0]] = -1
    return (h >> shift).astype(np.int64), two, w


class Model(NamedTuple):
    """log(target / raw) of each bucket, in whole multiples of 1 / UNIT; and the labelled sample: ids, and for each 0 (bad),
    1 (good) or 2 (good, and part of the target text, so of no use for the threshold)."""

    ratios: np.ndarray
    ids: np.ndarray
    label: np.ndarray


def labelled_sample(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality", most: int = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """About `most` labelled ids, chosen by a hash, in ascending order, and their labels as in Model; half of the good ones
    are target text. Of several labels of one id the lowest counts; null ids and labels do not."""
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(quality_col).cast("long").alias("q")).where("id IS NOT NULL AND q IS NOT NULL")
    share = min(1_000_000, -(-most * 1_000_000 // max(1, rows.count())))
    label = F.when(F.min("q") <= 0, 0).otherwise(1 + F.pmod(F.shiftright(F.xxhash64("id"), 32), F.lit(2)))
    got = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share).groupBy("id").agg(label.alias("label")).collect()
    got = sorted((r["id"], r["label"]) for r in got)
    return np.array([i for i, _ in got], np.int64), np.array([x for _, x in got], np.int64)


def lookup(ids: pa.Array, model_ids: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The labels of the ids in the sample, -1 for all others."""
    own = ids.fill_null(0).to_numpy(zero_copy_only=False)
    out = np.full(len(own), -1, np.int64)
    if len(model_ids):
        at = np.minimum(np.searchsorted(model_ids, own), len(model_ids) - 1)
        known = (model_ids[at] == own) & ~ids.is_null().to_numpy(zero_copy_only=False)
        out[known] = values[at[known]]
    return out


def fit_models(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR) -> Model:
    """Count the n-grams of all documents, and of the labelled good ones in the sample. A task sends a row for each bucket at
    most, and as many come to the driver. Without target texts all ratios are 0."""
    bounded_batches(docs.sparkSession)
    ids, label = labelled_sample(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for own, texts in pieces(batch):
                one, two, w = ngrams(texts)
                wanted = (lookup(own, ids, label) == 2)[w.owners()]
                for grams in (one, two):
                    ok = grams >= 0
                    raw += np.bincount(grams[ok], minlength=BUCKETS)
                    target += np.bincount(grams[ok & wanted], minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = texts.mapInArrow(tidy(run), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counts["bucket"]], target[counts["bucket"]] = counts["raw"], counts["target"]
    q = (raw + 1.0) / (raw.sum() + BUCKETS)
    p = (target + prior * q) / (target.sum() + prior)
    ratios = np.log(p / q) if target.sum() else np.zeros(BUCKETS)
    return Model(np.rint(ratios * UNIT).astype(np.int64), ids, label)


def log_weights(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Log importance weight (in 1 / UNIT) and number of n-grams of each text."""
    one, two, w = ngrams(texts)
    each = model.ratios[one] + np.where(two >= 0, model.ratios[two], 0)
    total = np.concatenate([[0], np.cumsum(each)])
    return total[w.first[1:]] - total[w.first[:-1]], np.maximum(2 * w.counts - 1, 0)


def weights(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, weight (in 1 / UNIT), n, good (the label in the sample, else -1), tie (a hash of id and text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, texts in pieces(batch):
                weight, n = log_weights(model, texts)
                yield pa.RecordBatch.from_arrays([ids, pa.array(weight), pa.array(n, pa.int64()), pa.array(lookup(ids, model.ids, model.label)), batch.column(2).slice(at, len(texts))], ["id", "weight", "n", "good", "tie"])
                at += len(texts)

    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.select("id", "text", F.xxhash64("id", "text").alias("tie")).mapInArrow(tidy(run), "id long, weight long, n long, good long, tie long")


def threshold(scored: DataFrame) -> float:
    """The ratio per n-gram that parts good from bad labelled texts best (of the sample; by the sum of the two shares
    that are right, that of good ones taken GOOD_OVER_BAD times; the lowest such). Without both kinds: the lowest ratio of the kind that there is, if good, else none."""
    rows = scored.where("good IN (0, 1) AND n > 0").select("weight", "n", "good").toPandas()
    r, y = (rows["weight"] / UNIT / rows["n"]).to_numpy(float), rows["good"].to_numpy() == 1
    if not y.any():
        return -np.inf
    if y.all():
        return float(r.min())
    order = np.argsort(r, kind="stable")
    r, y = r[order], y[order]
    bad_below = np.concatenate([[0], np.cumsum(~y)]) / (~y).sum()
    good_above = 1 - np.concatenate([[0], np.cumsum(y)]) / y.sum()
    ok = np.concatenate([[True], r[1:] != r[:-1], [True]])
    best = int(np.argmax(np.where(ok, bad_below + GOOD_OVER_BAD * good_above, -1)))
    if best == 0:
        return -np.inf
    return float((r[best - 1] + r[best]) / 2) if best < len(r) else np.inf


def kth_largest(rows: DataFrame, column: str, k: int) -> int:
    """The k-th largest value of a long column, by histograms of 4,096 bins that narrow down on it; exact."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    left = k  # the value sought is the left-th largest of those in low..high
    while low < high:
        width = max(1, -(-(high - low + 1) // 4096))
        bins = rows.where(F.col(column).between(low, high)).groupBy(F.expr(f"cast(({column} - {low}L) div {width}L as long)").alias("bin")).count().collect()
        for b in sorted(bins, key=lambda b: -b["bin"]):
            if left <= b["count"]:
                low, high = low + b["bin"] * width, min(high, low + (b["bin"] + 1) * width - 1)
                break
            left -= b["count"]
    return low


class Choice(NamedTuple):
    """The threshold, and the least key of a chosen row, with the least tie among rows of that key."""

    cut: float
    key: int
    tie: int


def key_sql(seed: int = SEED) -> str:
    """Log weight of NGRAMS n-grams of the text, plus Gumbel noise from a hash of id and text; in 1 / UNIT."""
    uniform = f"((pmod(xxhash64(tie, {seed}L), 4503599627370496L) + 0.5D) / 4503599627370496D)"
    return f"cast(round(({NGRAMS}D * (weight / {UNIT}D) / n - ln(-ln({uniform}))) * {UNIT}D) as long)"


def choose(scored: DataFrame, k: int | None = None) -> tuple[DataFrame, Choice]:
    """Gumbel top k: rows with key and selected. k: as many as are above the threshold, if not given. Texts without n-grams
    are never chosen; rows that agree in id and text stay or go together."""
    cut = threshold(scored)
    cut = max(min(cut, 1e6), -1e6)
    keyed = scored.withColumn("key", F.when(F.col("n") > 0, F.expr(key_sql())))
    real = keyed.where("key IS NOT NULL")
    if k is None:
        k = real.where(F.col("weight") / F.lit(float(UNIT)) >= F.lit(cut) * F.col("n")).count()
    k = min(k, real.count())
    if k <= 0:
        return keyed.withColumn("selected", F.lit(False)), Choice(cut, 2**63 - 1, 2**63 - 1)
    key = kth_largest(real, "key", k)
    at = real.where(F.col("key") == key)
    tie = kth_largest(at, "tie", k - real.where(F.col("key") > key).count())
    chosen = F.coalesce((F.col("key") > key) | (F.col("key") == key) & (F.col("tie") >= tie), F.lit(False))
    return keyed.withColumn("selected", chosen), Choice(cut, key, tie)


def importance_resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None) -> DataFrame:
    """doc_id, n_ngrams, log_weight, ratio (log weight per n-gram; null without any), gumbel_key, selected.

    One row for each document. Null and empty texts have weight 0 and are not selected. An empty table gives no rows; without
    labels every text with words is kept. Two passes over the texts; what is gathered is bounded by the number of buckets.
    """
    scored = stored(weights(docs, fit_models(docs, labels, id_col, text_col), id_col, text_col), "weights")
    keyed, _ = choose(scored, k)
    unit = F.lit(float(UNIT))
    return keyed.select(F.col("id").alias("doc_id"), F.col("n").alias("n_ngrams"), (F.col("weight") / unit).alias("log_weight"), F.when(F.col("n") > 0, F.col("weight") / unit / F.col("n")).alias("ratio"), (F.col("key") / unit).alias("gumbel_key"), "selected")


def keep_selected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The selected rows with all their columns. The weights are whole numbers, so computing them again gives the same
    decisions, and the texts need no shuffle."""
    model = fit_models(docs, labels, id_col, text_col)
    _, choice = choose(stored(weights(docs, model, id_col, text_col), "weights"))
    names = docs.columns
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for _, texts in pieces(pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(place)], ["id", "text"])):
                weight, n = log_weights(model, texts)
                rows = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(weight), pa.array(n, pa.int64())], [*names, "weight", "n"])
                at += len(texts)

    bounded_batches(docs.sparkSession)
    inner = [f"c{i}" for i in range(len(names))]
    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip([*inner, "weight", "n"], [*docs.schema.fields, *scored_fields()], strict=True))
    again = docs.mapInArrow(tidy(run), schema).withColumn("tie", F.xxhash64(F.col(inner[names.index(id_col)]).cast("long"), F.col(inner[place]).cast("string")))
    key = F.expr(key_sql())
    chosen = (F.col("n") > 0) & ((key > choice.key) | (key == choice.key) & (F.col("tie") >= choice.tie))
    return again.where(chosen).select(*(F.col(c).alias(n) for c, n in zip(inner, names, strict=True)))


def scored_fields() -> list:
    from pyspark.sql.types import LongType, StructField

    return [StructField("weight", LongType()), StructField("n", LongType())]
