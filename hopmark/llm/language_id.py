"""Language identification by a linear-chain conditional random field over words (operator 6).

Each word of a text has a label, its language, so text that changes language within a document is labelled word by word.
Emissions are sums of learned weights of hashed features: the word itself (lexicon), its affixes and its n-grams;
transitions are learned too. Forward-backward gives each word's label probabilities, whose mean over the document names it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopmark.llm.common import Words, bounded_batches, hash_spans, pieces, sums_by_text, tidy

BUCKET_BITS, NGRAM = 16, 3
#: The sample that the field is fitted on: about so many documents a language, and a run of so many words of each.
#: A longer word than SAMPLE_LETTERS gives a piece of that length to the sample, at a place chosen by a hash.
SAMPLE_DOCS, SAMPLE_WORDS, SAMPLE_LETTERS = 400, 200, 100
#: Training: words of a sequence, passes, sequences a step, learning rate, weight decay.
LENGTH, PASSES, STEP, RATE, DECAY = 40, 4, 256, 0.3, 1e-5
#: Bytes of texts that are labelled in one go.
RUN = 2 << 20
_LETTER = re.compile(r"[^\W\d_]")
#: Affixes as (seed, length in bytes, from the end).
AFFIXES = ((11, 1, False), (12, 2, False), (13, 3, False), (21, 2, True), (22, 3, True), (23, 4, True))


class Features(NamedTuple):
    """Of distinct words: fixed features as a matrix, and n-grams as one list with the first of each word."""

    fixed: np.ndarray
    grams: np.ndarray
    first: np.ndarray

    def scores(self, weights: np.ndarray) -> np.ndarray:
        out = weights[self.fixed].sum(axis=1, dtype=np.float64)
        total = np.zeros((len(self.grams) + 1, weights.shape[1]))
        np.cumsum(weights[self.grams], axis=0, out=total[1:])
        size = np.diff(self.first)
        return out + (total[self.first[1:]] - total[self.first[:-1]]) / np.maximum(size, 1)[:, None]

    def gradient(self, of: np.ndarray) -> np.ndarray:
        """From gradients of the words' scores to those of the weights."""
        size = np.diff(self.first)
        at = np.concatenate([self.fixed.T.ravel(), self.grams])
        values = np.concatenate([np.tile(of, (self.fixed.shape[1], 1)), np.repeat(of / np.maximum(size, 1)[:, None], size, axis=0)])
        return np.column_stack([np.bincount(at, values[:, k], 1 << BUCKET_BITS) for k in range(of.shape[1])])


def features(w: Words, which: np.ndarray) -> Features:
    """Features of the words numbered `which`."""
    starts, lengths = w.starts[which], w.lengths[which]
    shift = np.uint64(64 - BUCKET_BITS)
    columns = [hash_spans(w.data, starts, lengths, 1)]
    for seed, n, last in AFFIXES:
        size = np.minimum(lengths, n)
        columns.append(hash_spans(w.data, starts + (lengths - size) * last, size, seed))
    grams = np.maximum(lengths - NGRAM + 1, 0)
    first = np.concatenate([[0], np.cumsum(grams)])
    inner = np.arange(first[-1]) - np.repeat(first[:-1], grams)
    at = np.repeat(starts, grams) + inner
    gram_hash = hash_spans(w.data, at, np.full(len(at), NGRAM, np.int64), 31)
    return Features(np.column_stack([c >> shift for c in columns]).astype(np.int64), (gram_hash >> shift).astype(np.int64), first)


class Field(NamedTuple):
    """A fitted field: labels in ascending order, weights of features and labels, transition scores."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray


def marginals(emit: np.ndarray, first: np.ndarray, transitions: np.ndarray, moves: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Label probabilities of all words, and on request summed probabilities of all transitions; sequences are first[i] to
    first[i + 1].

    All sequences advance together, the longest first, so each step is one product for those that are still running."""
    n, labels = emit.shape
    local = np.exp(emit - emit.max(axis=1, keepdims=True))
    move = np.exp(transitions - transitions.max())
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    start, length = first[:-1][order], counts[order]
    longest = int(length[0]) if len(length) else 0
    running = np.searchsorted(-length, -np.arange(longest), side="left")
    ahead, back = np.empty((n, labels)), np.empty((n, labels))
    state = None
    for t in range(longest):
        at = start[: running[t]] + t
        state = local[at] if t == 0 else (state[: len(at)] @ move) * local[at]
        state /= state.sum(axis=1, keepdims=True)
        ahead[at] = state
    state = np.zeros((0, labels))
    for t in range(longest - 1, -1, -1):
        at = start[: running[t]] + t
        now = np.ones((len(at), labels))
        if len(state):
            now[: len(state)] = (state * local[at[: len(state)] + 1]) @ move.T
            now[: len(state)] /= now[: len(state)].sum(axis=1, keepdims=True)
        back[at] = state = now
    both = ahead * back
    both /= both.sum(axis=1, keepdims=True)
    if not moves:
        return both, None
    inner = np.ones(n, bool)
    inner[first[1:][counts > 0] - 1] = False
    a = np.flatnonzero(inner)
    joint = ahead[a][:, :, None] * move[None] * (local[a + 1] * back[a + 1])[:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    return both, joint.sum(axis=0)


def fit(samples: list[tuple[str, bytes]], seed: int = 7) -> Field:
    """Fit on (language, run of words). Half of the training sequences are one run's, the others join a run with the one before it in a random
    order, of whatever language, so that changes of language are among what the transitions learn."""
    labels = sorted({lang for lang, _ in samples})
    rng = np.random.default_rng(seed)
    w = Words([text for _, text in sorted(samples)])
    lang = np.array([labels.index(x) for x, _ in sorted(samples)])
    k, total = len(labels), len(w.starts)
    weights, transitions = np.zeros((1 << BUCKET_BITS, k)), np.zeros((k, k))
    if k < 2 or not total:
        return Field(labels, weights.astype(np.float32), transitions)
    owner = w.owners()
    runs = [(a, min(a + LENGTH, b)) for a0, b in zip(w.first[:-1], w.first[1:], strict=True) for a in range(a0, b, LENGTH)]
    order = rng.permutation(len(runs))
    sequences = []
    for i, r in enumerate(order):
        a, b = runs[r]
        if i % 2:
            c, d = runs[order[i - 1]]
            cut = int(rng.integers(1, LENGTH))
            sequences.append(np.concatenate([np.arange(a, min(b, a + cut)), np.arange(c, d)[-(LENGTH - cut) :]]))
        else:
            sequences.append(np.arange(a, b))
    _, distinct, number = np.unique(w.hashes(), return_index=True, return_inverse=True)
    squares, squares_t = np.full_like(weights, 1e-6), np.full_like(transitions, 1e-6)
    for _ in range(PASSES):
        for s in range(0, len(sequences), STEP):
            part = sequences[s : s + STEP]
            at = np.concatenate(part)
            first = np.concatenate([[0], np.cumsum([len(x) for x in part])])
            used, local = np.unique(number[at], return_inverse=True)
            own = features(w, distinct[used])
            truth = lang[owner[at]]
            p, moves = marginals(own.scores(weights)[local], first, transitions)
            p[np.arange(len(at)), truth] -= 1.0
            g = own.gradient(np.column_stack([np.bincount(local, p[:, j], len(used)) for j in range(k)])) / len(at) + DECAY * weights
            seen = np.zeros((k, k))
            inner = np.ones(len(at), bool)
            inner[first[1:] - 1] = False
            i = np.flatnonzero(inner)
            np.add.at(seen, (truth[i], truth[i + 1]), 1.0)
            gt = (moves - seen) / len(at)
            squares += g * g
            squares_t += gt * gt
            weights -= RATE * g / np.sqrt(squares)
            transitions -= RATE * gt / np.sqrt(squares_t)
    return Field(labels, weights.astype(np.float32), transitions)


def word_labels(field: Field, texts: list[bytes]) -> tuple[Words, np.ndarray]:
    """The words of texts, and the label probabilities of each."""
    w = Words(texts)
    if not len(w.starts) or not field.labels:
        return w, np.zeros((len(w.starts), len(field.labels)))
    _, distinct, number = np.unique(w.hashes(), return_index=True, return_inverse=True)
    scores = features(w, distinct).scores(field.weights)
    return w, marginals(scores[number], w.first, field.transitions, False)[0]


def classify(field: Field, texts: list[bytes]) -> tuple[list[str], list[float], list[float]]:
    """Language, its mean probability over the words of each text, and the mean over the words of each one's own best label; `und` and 0 without
    letters."""
    w, p = word_labels(field, texts)
    sure = sums_by_text(p.max(axis=1, initial=0.0), w.first) / np.maximum(w.counts, 1)
    total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, axis=0)])
    mean = (total[w.first[1:]] - total[w.first[:-1]]) / np.maximum(w.counts, 1)[:, None]
    names, scores = [], []
    for text, n, m in zip(texts, w.counts.tolist(), mean, strict=True):
        if not n or not field.labels or _LETTER.search(text.decode("utf-8", "replace")) is None:
            names.append("und")
            scores.append(0.0)
        else:
            best = int(np.argmax(m))
            names.append(field.labels[best])
            scores.append(float(min(max(m[best], 0.0), 1.0)))
    return names, scores, [0.0 if n == "und" else x for n, x in zip(names, sure.tolist(), strict=True)]


def training_sample(rows: DataFrame, docs: int = SAMPLE_DOCS, words: int = SAMPLE_WORDS) -> list[tuple[str, bytes]]:
    """Of rows (id, text, lang): about `docs` documents of each language, chosen by a hash, and a run of `words` words at
    a place chosen by a hash. The driver gets docs x languages runs at most, whatever the number of rows."""
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1_000_000, -(-docs * 1_000_000 // n)))).otherwise(share)
    mark = F.xxhash64("id", "text")
    chosen = rows.where(F.pmod(mark, F.lit(1_000_000)) < share).select("lang", "text", F.abs(F.shiftright(mark, 24)).alias("mark"))

    def piece(word: str, mark: int) -> str:
        at = mark % max(1, len(word) - SAMPLE_LETTERS + 1)
        return word[at : at + SAMPLE_LETTERS]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, mark in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                parts = text.split()
                first = mark % max(1, len(parts) - words + 1)
                out.append(" ".join(piece(x, mark) for x in parts[first : first + words]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["lang", "text"])

    return [(r["lang"], r["text"].encode()) for r in chosen.mapInArrow(cut, "lang string, text string").collect()]


def _rows(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))


def fit_on(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train: F.Column | None = None) -> Field:
    """Fit on the rows that `train` (over id_col and others) allows; null counts as no."""
    bounded_batches(df.sparkSession)
    return fit(training_sample(_rows(df if train is None else df.where(train), id_col, text_col, lang_col)))


def language_id(df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1: the mean probability of that label over the words).

    Texts that are null or have no letters are `und` with score 0, and so is every text if the field was fitted on no
    rows. Of equal means, the first label in ascending order wins. One row for each row of the input; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in pieces(batch, RUN):
                names, scores, _ = classify(field, texts)
                yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    bounded_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def keep_identified(df: DataFrame, field: Field, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows with letters whose words' own labels have a mean probability of `least` or more, with all their columns: a text in several
    languages stays if its words are labelled with confidence. No shuffle."""
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for _, texts in pieces(pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(place)], ["id", "text"]), RUN):
                names, _, sure = classify(field, texts)
                keep = [n != "und" and s >= least for n, s in zip(names, sure, strict=True)]
                yield batch.slice(at, len(texts)).filter(pa.array(keep, pa.bool_()))
                at += len(texts)

    bounded_batches(df.sparkSession)
    return df.mapInArrow(tidy(run), df.schema)
