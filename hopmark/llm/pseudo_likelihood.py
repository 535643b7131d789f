"""Masked pseudo-likelihood with a bidirectional window network (operator 10).

Each token is predicted from the tokens on both its sides, itself masked: embeddings of WINDOW tokens on the left and on the
right, each place with weights of its own, a tanh layer, and a softmax in two levels, over classes of tokens and over the tokens of
the class. A document's score is the sum of the conditional log-probabilities of all its tokens.

Tokens are hashed to 2^14 numbers. All tokens of all documents give the counts of numbers and of neighbours, from which the embeddings and
the output weights start (a factorisation of the neighbours' log ratios). Then every document trains the network once, in the round that a hash
deals it to, with each of its tokens as a target: a round's gradients over all its documents are summed, and each row
of weights takes a step by the mean over the tokens that it serves. Sums are exact or of double precision and weights are rounded to
whole multiples of UNIT, so the result does not depend on how the rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopmark.llm.common import TOKEN_BYTES, Words, bounded_batches, id_and_text, pieces, stored, tidy

TOKEN_BITS, INPUT_BITS = 14, 12
TOKENS, INPUTS = 1 << TOKEN_BITS, 1 << INPUT_BITS
#: The commonest tokens are classes of their own; the others are dealt to SHARED classes by frequency, with as much of the sum of the counts' square
#: roots in each: classes of common tokens are small, which makes the least work in all.
OWN, SHARED = 32, 96
CLASSES = OWN + SHARED
DIM, WINDOW = 12, 3
HIDDEN = 2 * DIM
#: Rounds, tokens' worth of a prior on steps and ratios, and the longest step of a weight.
ROUNDS, PRIOR, LONGEST = 3, 20.0, 0.3
#: Step sizes: the hidden layer's outputs are small, so the weights on them take longer steps.
RATES = {"left": 0.3, "right": 0.3, "place": 0.02, "hidden": 0.02, "bias": 0.02, "out": 8.0, "out_bias": 0.5, "member": 16.0}
SCALE, UNIT = 0.25, 1e-5
#: Tokens that are sorted by class at once, and those whose class probabilities are held at once.
CHUNK, BLOCK = 1 << 16, 1 << 10
#: Tokens that a task adds up at once.
RUN = 1 << 18


class Classes(NamedTuple):
    """Of each token number its class, and the log of its share of the class's count; of each class its tokens, and where a token stands."""

    of: np.ndarray
    log_share: np.ndarray
    members: list[np.ndarray]
    place: np.ndarray


def tokens(texts: list[bytes]) -> tuple[np.ndarray, Words]:
    w = Words(texts, TOKEN_BYTES)
    return (w.hashes() >> np.uint64(64 - TOKEN_BITS)).astype(np.int64), w


def make_classes(counts: np.ndarray) -> Classes:
    n = counts + 1.0  # numbers that do not occur count as one
    order = np.argsort(-counts, kind="stable")
    of = np.empty(len(n), np.int64)
    of[order[:OWN]] = np.arange(OWN)
    rest = order[OWN:]
    cost = np.cumsum(np.sqrt(n[rest]))
    at = np.arange(SHARED)
    starts = np.searchsorted(cost, cost[-1] * at / SHARED)
    starts = np.minimum(np.maximum.accumulate(starts - at) + at, len(rest) - SHARED + at)  # no class is empty
    of[rest] = OWN + np.searchsorted(starts, np.arange(len(rest)), side="right") - 1
    members = [np.flatnonzero(of == c) for c in range(CLASSES)]
    place = np.empty(len(n), np.int64)
    for m in members:
        place[m] = np.arange(len(m))
    return Classes(of, np.log(n / np.bincount(of, n, CLASSES)[of]), members, place)


Params = dict[str, np.ndarray]
EDGE = INPUTS - 1  # the input beyond the ends of a document


class Spans(NamedTuple):
    """Where the tokens of each document begin, and their numbers."""

    first: np.ndarray
    counts: np.ndarray


def windows(t: np.ndarray, w: Words | Spans) -> np.ndarray:
    """Inputs around each token: WINDOW on the left, from far to near, and WINDOW on the right; a column lies in one piece."""
    n = len(t)
    padded = np.full(n + 2 * WINDOW, EDGE, np.int64)
    padded[WINDOW : WINDOW + n] = np.minimum(t >> (TOKEN_BITS - INPUT_BITS), EDGE - 1)
    shifts = [*range(-WINDOW, 0), *range(1, WINDOW + 1)]
    out = np.empty((2 * WINDOW, n), np.int64)
    for x, s in zip(out, shifts, strict=True):
        x[:] = padded[WINDOW + s : WINDOW + s + n]
        for d in range(abs(s)):  # so many tokens at an end of a document have no neighbour there
            long = w.counts > d
            x[w.first[:-1][long] + d if s < 0 else w.first[1:][long] - 1 - d] = EDGE
    return out.T


#: Numbers are summed over tasks in rows of so many columns.
ROW = 64


def summed(data: DataFrame, size: int, add, kind: str = "long") -> np.ndarray:
    """`size` numbers, summed over all tasks: add(batch) yields what to add to them. A task sends only rows of ROW numbers that are not all zero."""
    names = [f"w{i}" for i in range(ROW)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(-(-size // ROW) * ROW, np.int64 if kind == "long" else np.float64)
        add(own[:size], batches)
        own = own.reshape(-1, ROW)
        used = np.flatnonzero(own.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *(pa.array(own[used, i]) for i in range(ROW))], ["row", *names])

    sums = data.mapInArrow(tidy(run), "row long, " + ", ".join(f"{c} {kind}" for c in names)).groupBy("row").agg(*(F.sum(c).alias(c) for c in names))
    out = np.zeros((-(-size // ROW), ROW), np.int64 if kind == "long" else np.float64)
    table = sums.toArrow()
    rows = table.column("row").to_numpy()
    for i, c in enumerate(names):
        out[rows, i] = table.column(c).to_numpy()
    return out.ravel()[:size]


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Spans]]:
    """Token numbers of whole documents, from rows of training_tokens(), in runs of RUN tokens or a little more."""
    parts, sizes, held = [], [], 0
    for b in batches:
        for raw, counts in zip(b.column("tokens").to_pylist(), b.column("counts").to_pylist(), strict=True):
            parts.append(np.frombuffer(raw, "<u2"))
            sizes.append(np.frombuffer(counts, "<i8"))
            held += len(parts[-1])
            if held >= RUN:
                yield spanned(parts, sizes)
                parts, sizes, held = [], [], 0
    if parts:
        yield spanned(parts, sizes)


def spanned(parts: list[np.ndarray], sizes: list[np.ndarray]) -> tuple[np.ndarray, Spans]:
    counts = np.concatenate(sizes)
    return np.concatenate(parts).astype(np.int64), Spans(np.concatenate([[0], np.cumsum(counts)]), counts)


def count_tokens(data: DataFrame) -> np.ndarray:
    """Counts of all token numbers over all documents."""

    def add(n: np.ndarray, batches: Iterator[pa.RecordBatch]) -> None:
        for t, _ in runs(batches):
            n += np.bincount(t, minlength=TOKENS)

    return summed(data, TOKENS, add)


def count_neighbours(data: DataFrame, classes: Classes) -> np.ndarray:
    """How often each input stands next to a token of each class, on its left and on its right, over all documents."""
    of = classes.of

    def add(n: np.ndarray, batches: Iterator[pa.RecordBatch]) -> None:
        for t, w in runs(batches):
            x, y = windows(t, w), of[t]
            for side, c in enumerate((WINDOW - 1, WINDOW)):
                n[side * INPUTS * CLASSES : (side + 1) * INPUTS * CLASSES] += np.bincount(x[:, c] * CLASSES + y, minlength=INPUTS * CLASSES)

    return summed(data, 2 * INPUTS * CLASSES, add).reshape(2, INPUTS, CLASSES)


def rounded(p: Params) -> Params:
    return {k: (np.rint(v / UNIT) * UNIT).astype(np.float32) for k, v in p.items()}


def initial(counts: np.ndarray, near: np.ndarray, classes: Classes) -> Params:
    """Embeddings and output weights whose products are the log ratios of neighbours, as near as DIM numbers a side come; output biases are the
    classes' log shares, and tokens of a class differ by their shares alone."""
    total = np.bincount(classes.of, counts + 1.0, CLASSES)
    share = total / total.sum()
    embed, out = [], []
    for side in near.astype(np.float64):
        n = side.sum(axis=1, keepdims=True)
        ratio = np.log((side + PRIOR * share) / (n + PRIOR) / share)
        weight = np.sqrt(n + 1.0)
        ratio *= np.sqrt(share)
        # the singular vectors of weight * ratio, from the small product of its columns
        _, v = np.linalg.eigh(np.einsum("xi,xj,x->ij", ratio, ratio, weight[:, 0] ** 2))
        v = v[:, ::-1][:, :DIM].T
        v *= np.sign(v[np.arange(DIM), np.abs(v).argmax(axis=1)])[:, None]
        back = v / np.sqrt(share)
        left = np.einsum("xi,di->xd", ratio, v)
        scale = np.maximum(np.abs(left).max(axis=0), 1e-9)
        embed.append(left / scale * 2)
        out.append(back * scale[:, None] / 2)
    place = np.repeat(np.array([0.1, 0.1, 0.2, 0.2, 0.1, 0.1])[:, None], DIM, axis=1)
    return rounded({
        "left": embed[0],
        "right": embed[1],
        "place": place,
        "hidden": np.eye(HIDDEN) * SCALE,
        "bias": np.zeros((1, HIDDEN)),
        "out": np.concatenate(out) / SCALE,
        "out_bias": np.log(share)[None],
        "member": np.zeros((TOKENS, HIDDEN)),
    })


#: Numbers between this and its negative have exponentials, and sums of them, without a maximum taken off first.
SAFE = 60.0


class Layers:
    """The weights as they are applied: of each place and input what it adds to the hidden layer; output weights of classes and, for each class, of its
    tokens, with the biases as a last row for a hidden layer that ends in a one."""

    def __init__(self, p: Params, classes: Classes):
        self.bias, kind = p["bias"], p["out"].dtype
        self.inputs = [(p["left" if c < WINDOW else "right"] * p["place"][c]) @ p["hidden"][(c >= WINDOW) * DIM :][:DIM] for c in range(2 * WINDOW)]
        self.out = np.concatenate([p["out"], p["out_bias"]])
        member = np.concatenate([p["member"], classes.log_share[:, None].astype(kind)], axis=1)
        self.members = [np.ascontiguousarray(member[m].T) for m in classes.members]
        # a hidden layer is between -1 and 1
        self.safe = np.abs(member).sum(axis=1).max() < SAFE

    def hidden(self, x: np.ndarray) -> np.ndarray:
        """The hidden layer around each token, and a one."""
        h = np.ones((len(x), HIDDEN + 1), self.out.dtype)
        z = np.take(self.inputs[0], x[:, 0], axis=0)
        for c in range(1, 2 * WINDOW):
            z += np.take(self.inputs[c], x[:, c], axis=0)
        z += self.bias
        np.tanh(z, out=h[:, :HIDDEN])
        return h

    def exponents(self, h: np.ndarray, c: int | None = None) -> np.ndarray:
        """What the softmax over classes, or over the tokens of class c, takes the exponentials of."""
        z = h @ (self.out if c is None else self.members[c])
        if not (c is not None and self.safe) and (z.max() > SAFE or z.min() < -SAFE):
            z -= z.max(axis=1, keepdims=True)
        return z

    def log_prob(self, h: np.ndarray, y: np.ndarray, c: int | None = None) -> np.ndarray:
        """The log-probability of each row's own y."""
        z = self.exponents(h, c)
        return z[np.arange(len(z)), y].astype(np.float64) - np.log(sums_of_rows(np.exp(z, out=z)))


def sums_of_rows(e: np.ndarray) -> np.ndarray:
    return e @ np.ones(e.shape[1], e.dtype)


def by_class(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of tokens by class, and where each class begins in it."""
    small = y.astype(np.uint8 if CLASSES <= 256 else np.uint16)  # sorted by digits
    return np.argsort(small, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(y, minlength=CLASSES))])


def shared(edge: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each class of several tokens that occurs, and its places in the order."""
    for c in range(OWN, CLASSES):
        if edge[c] < edge[c + 1]:
            yield c, slice(edge[c], edge[c + 1])


def log_probs(p: Params, classes: Classes, t: np.ndarray, w: Words | Spans) -> np.ndarray:
    """The conditional log-probability of each token."""
    out = np.empty(len(t))
    x, layers = windows(t, w), Layers(p, classes)
    for s in range(0, len(t), CHUNK):
        own = t[s : s + CHUNK]
        order, edge = by_class(classes.of[own])
        own = own[order]
        y, place = classes.of[own], classes.place[own]
        h = np.take(layers.hidden(x[s : s + CHUNK]), order, axis=0)
        got = np.empty(len(own))
        for b in range(0, len(own), BLOCK):
            got[b : b + BLOCK] = layers.log_prob(h[b : b + BLOCK], y[b : b + BLOCK])
        for c, at in shared(edge):
            got[at] += layers.log_prob(h[at], place[at], c)
        out[s + order] = got
    return out


class Gradient:
    """Gradients of the log-likelihood, summed over tokens, and the numbers of tokens that rows of weights served."""

    def __init__(self, like: Params):
        self.sums = {k: np.zeros(v.shape) for k, v in like.items()}
        self.served = {"left": np.zeros(INPUTS), "right": np.zeros(INPUTS), "class": np.zeros(CLASSES), "all": np.zeros(1)}

    def add(self, p: Params, classes: Classes, x: np.ndarray, t: np.ndarray) -> None:
        layers, sums = Layers(p, classes), self.sums
        back, inner = np.ascontiguousarray(p["out"].T), np.zeros((2 * WINDOW, HIDDEN, INPUTS))
        outer = np.zeros((HIDDEN + 1, CLASSES))
        for s in range(0, len(t), CHUNK):
            own, around = t[s : s + CHUNK], x[s : s + CHUNK]
            order, edge = by_class(classes.of[own])
            own = own[order]
            y, place = classes.of[own], classes.place[own]
            h = np.take(layers.hidden(around), order, axis=0)
            dh = np.take(back, y, axis=0)
            for b in range(0, len(own), BLOCK):
                at = slice(b, b + BLOCK)
                e = layers.exponents(h[at])
                part = 1 / sums_of_rows(np.exp(e, out=e))[:, None]
                outer -= (h[at] * part).T @ e
                dh[at] -= (e @ back) * part
            here = np.flatnonzero(np.diff(edge))
            outer[:, here] += np.add.reduceat(h, edge[here], axis=0).T
            for c, at in shared(edge):
                d = layers.exponents(h[at], c)
                d *= -1 / sums_of_rows(np.exp(d, out=d))[:, None]
                d[np.arange(len(d)), place[at]] += 1
                dh[at] += d @ layers.members[c][:HIDDEN].T
                sums["member"][classes.members[c]] += d.T @ h[at, :HIDDEN]
            dh *= 1 - h[:, :HIDDEN] ** 2
            sums["bias"] += dh.sum(axis=0)
            self.served["class"] += np.diff(edge)
            columns = np.ascontiguousarray(dh.T, np.float64)
            for c in range(2 * WINDOW):
                v = around[:, c][order]
                for k, d in enumerate(columns):
                    inner[c, k] += np.bincount(v, d, INPUTS)
                self.served["left" if c < WINDOW else "right"] += np.bincount(v, minlength=INPUTS)
        sums["out"] += outer[:HIDDEN]
        sums["out_bias"] += outer[HIDDEN]
        for c in range(2 * WINDOW):  # from what an input adds to the hidden layer to the weights that it is made of
            side, half = "left" if c < WINDOW else "right", slice((c >= WINDOW) * DIM, (c >= WINDOW) * DIM + DIM)
            placed = inner[c].T @ p["hidden"][half].T
            sums[side] += placed * p["place"][c]
            sums["place"][c] += (placed * p[side]).sum(axis=0)
            sums["hidden"][half] += (p[side] * p["place"][c]).T @ inner[c].T
        self.served["all"] += len(t)

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in (*self.sums.values(), *self.served.values())])

    def load(self, flat: np.ndarray) -> Gradient:
        at = 0
        for held in (self.sums, self.served):
            for k, v in held.items():
                held[k] = flat[at : at + v.size].reshape(v.shape)
                at += v.size
        return self

    def step(self, p: Params, counts: np.ndarray) -> Params:
        """The weights after one step: each row by the mean over the tokens that it served."""
        per, all_ = self.served, float(self.served["all"][0]) + PRIOR
        share = counts / max(1.0, counts.sum())
        size = {
            "left": per["left"][:, None] + PRIOR,
            "right": per["right"][:, None] + PRIOR,
            "place": all_,
            "hidden": all_,
            "bias": all_,
            "out": per["class"][None] + PRIOR,
            "out_bias": per["class"][None] + PRIOR,
            "member": (share * all_)[:, None] + PRIOR,
        }
        return rounded({k: v + np.clip(RATES[k] * self.sums[k] / size[k], -LONGEST, LONGEST) for k, v in p.items()})


def training_tokens(texts: DataFrame, rounds: int) -> DataFrame:
    """Token numbers and lengths of whole documents as binary rows, and the round that a hash of id and text deals each run to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mark = batch.column(2).to_numpy()
            at = 0
            for _, part in pieces(batch, 1 << 20):
                t, w = tokens(part)
                for r in range(rounds):
                    own = mark[at : at + len(part)] == r
                    if w.counts[own].sum():
                        keep = np.repeat(own, w.counts)
                        yield pa.RecordBatch.from_pydict({"round": [r], "tokens": pa.array([t[keep].astype("<u2").tobytes()], pa.binary()), "counts": pa.array([w.counts[own].astype("<i8").tobytes()], pa.binary())})
                at += len(part)

    marked = texts.withColumn("mark", F.pmod(F.xxhash64("id", "text"), F.lit(rounds)))
    return marked.mapInArrow(tidy(run), "round long, tokens binary, counts binary")


def gradient(data: DataFrame, p: Params, classes: Classes) -> Gradient:
    """Summed over all tokens of all rows of data."""

    def add(sums: np.ndarray, batches: Iterator[pa.RecordBatch]) -> None:
        own = Gradient(p)
        for t, w in runs(batches):
            own.add(p, classes, windows(t, w), t)
        sums += own.flat()

    out = Gradient(p)
    return out.load(summed(data, len(out.flat()), add, "double"))


def fit(texts: DataFrame, rounds: int = ROUNDS) -> tuple[Params, Classes]:
    data = stored(training_tokens(texts, max(1, rounds)), "tokens")
    whole = data.select("tokens", "counts")
    counts = count_tokens(whole)
    classes = make_classes(counts)
    p = initial(counts, count_neighbours(whole, classes), classes)
    for r in range(rounds):
        p = gradient(data.where(F.col("round") == r).select("tokens", "counts"), p, classes).step(p, counts)
    return p, classes


def lm_score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_tokens, log_prob (summed conditional log-probabilities of all tokens), mean_log_prob.

    Fitted on the table itself, then all whole texts are scored. Null, empty and blank texts have no tokens, log_prob 0 and a
    null mean. One row for each row of the input; repeated rows score alike. An empty table gives no rows. Every token of every document is
    a target of the training once.
    """
    bounded_batches(df.sparkSession)
    texts = id_and_text(df, id_col, text_col)
    p, classes = fit(texts, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, part in pieces(batch, 1 << 20):
                t, w = tokens(part)
                each = log_probs(p, classes, t, w)
                total = np.array([each[a:b].sum() for a, b in zip(w.first[:-1], w.first[1:], strict=True)], float)
                mean = [x / n if n else None for x, n in zip(total.tolist(), w.counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(w.counts, pa.int64()), pa.array(total), pa.array(mean, pa.float64())], ["doc_id", "n_tokens", "log_prob", "mean_log_prob"])

    return texts.mapInArrow(tidy(run), "doc_id long, n_tokens long, log_prob double, mean_log_prob double")
