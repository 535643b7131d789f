"""Benchmark decontamination by suffix arrays of the training texts (operator 8).

The words of a run of documents (a shard) become numbers, and a suffix array orders its suffixes, to the full length of the
longest test item. Every suffix of every test item is looked up by binary search, all at once; the neighbours of its place
in the array give its longest verbatim match. Where that is a window or more, the range of suffixes that share the window
gives all places, and each place's own match is measured word by word. Numbers of words are checked byte by byte, so no match rests on
a hash. Words that no item has end a match, so they only cut the text; runs between them that are shorter than the shortest
window cannot hold one and are left out of the array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopmark.llm.common import Words, bounded_batches, id_and_text, pieces, same_spans, tidy, work_dir

WINDOW = 13
#: Bytes of item texts that are looked up at once; more items are read block by block within a task.
BLOCK_BYTES = 4 << 20
#: Bytes of document texts of one suffix array.
SHARD_BYTES = 8 << 20
#: Pairs of a place and a suffix that are measured at once.
PAIRS = 1 << 20


class Items(NamedTuple):
    """The test items of a block, as numbers of their distinct words (from 1)."""

    ids: list[str]
    source: Words
    seed: int
    hashes: np.ndarray  # of the distinct words, ascending
    sample: np.ndarray  # a place of each distinct word in `source`
    words: np.ndarray  # all items' words; a zero ends each item
    suffix: np.ndarray  # places in `words` of all suffixes
    left: np.ndarray  # words from there to the end of the item
    window: np.ndarray  # words of a window of its item
    owner: np.ndarray  # the item of each suffix


def prepare(ids: list[int | str], texts: list[bytes], window: int = WINDOW) -> Items:
    w, seed = Words(texts), 0
    while True:  # until no two words share a hash
        hashes, sample, code = np.unique(w.hashes(seed), return_index=True, return_inverse=True)
        other = sample[code]
        if (w.lengths == w.lengths[other]).all() and same_spans(w.data, w.starts, w.data, w.starts[other], w.lengths).all():
            break
        seed += 1
    owner = w.owners()
    words = np.zeros(len(code) + len(w.counts), np.int64)
    suffix = np.arange(len(code)) + owner
    words[suffix] = code + 1
    left = np.repeat(w.first[1:], w.counts) - np.arange(len(code))
    return Items([str(i) for i in ids], w, seed, hashes, sample, words, suffix, left, np.minimum(w.counts, window)[owner], owner)


def suffix_array(text: np.ndarray, keep: np.ndarray, depth: int) -> np.ndarray:
    """Positions `keep` of `text` in the order of their suffixes, by prefix doubling until all differ or `depth` words decide.

    Zero, which ends each run of words, is the smallest; what follows it does not count."""
    rank, reach = text, 1
    while reach < min(depth, len(text)):
        after = np.zeros(len(text), np.int64)
        after[:-reach] = rank[reach:]
        joint = rank * (int(rank.max()) + 1) + after
        joint[text == 0] = 0
        found, rank = np.unique(joint, return_inverse=True)
        reach *= 2
        if len(found) > np.count_nonzero(text):
            break
    return keep[np.argsort(rank[keep], kind="stable")]


def _common(text: np.ndarray, at: np.ndarray, words: np.ndarray, query: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of places: words in common, up to `most`, and the sign of the first difference (text - words)."""
    size, sign = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    live, k = np.flatnonzero(most > 0), 0
    while len(live):
        a, b = text[np.minimum(at[live] + k, len(text) - 1)], words[query[live] + k]
        same = (a == b) & (a > 0)
        sign[live[~same]] = np.sign(a - b)[~same]
        live, k = live[same], k + 1
        size[live] = k
        live = live[most[live] > k]
    return size, sign


class Shard:
    """The suffix array of a run of documents, over the words that the items have."""

    def __init__(self, w: Words, items: Items):
        self.counts, self.first, self.owner = w.counts, w.first, w.owners()
        self.text = self.array = self.origin = np.zeros(0, np.int64)
        if not len(items.hashes) or not len(w.starts):
            return
        h = w.hashes(items.seed)
        place = np.minimum(np.searchsorted(items.hashes, h), len(items.hashes) - 1)
        known = np.flatnonzero(items.hashes[place] == h)
        at, src = items.sample[place[known]], items.source
        known, at = (x[w.lengths[known] == src.lengths[at]] for x in (known, at))
        known = known[same_spans(w.data, w.starts[known], src.data, src.starts[at], w.lengths[known])]
        code = np.zeros(len(h), np.int64)
        code[known] = place[known] + 1
        # runs of words of the items, cut at documents
        inside, owner, shortest = code > 0, self.owner, int(items.window.min())
        change = np.concatenate([[True], (inside[1:] != inside[:-1]) | (owner[1:] != owner[:-1]), [True]])
        edges = np.flatnonzero(change)
        start, length = edges[:-1], np.diff(edges)
        long = inside[start] & (length >= shortest)
        start, length = start[long], length[long]
        first = np.cumsum(length + 1) - length - 1
        inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        at = np.repeat(first, length) + inner
        self.origin = np.full(int((length + 1).sum()), -1, np.int64)  # the word's number among all words of the run
        self.origin[at] = np.repeat(start, length) + inner
        self.text = np.zeros(len(self.origin), np.int64)
        self.text[at] = code[self.origin[at]]
        self.array = suffix_array(self.text, at, int(items.left.max()))

    def _search(self, items: Items, which: np.ndarray, most: np.ndarray, right: bool) -> np.ndarray:
        """Of the suffixes `which`, cut to `most` words, the first place in the array that is not below (right: that is above)."""
        lo, hi = np.zeros(len(which), np.int64), np.full(len(which), len(self.array), np.int64)
        while (live := np.flatnonzero(lo < hi)).size:
            mid = (lo[live] + hi[live]) // 2
            size, sign = _common(self.text, self.array[mid], items.words, items.suffix[which[live]], most[live])
            below = np.where(size >= most[live], right, sign < 0)
            lo[live] = np.where(below, mid + 1, lo[live])
            hi[live] = np.where(below, hi[live], mid)
        return lo

    def longest(self, items: Items) -> tuple[np.ndarray, np.ndarray]:
        """Of every suffix of the items: the words of its longest verbatim match, and its place among the words of the run."""
        every = np.arange(len(items.suffix))
        if not len(self.array):
            return np.zeros(len(every), np.int64), np.full(len(every), -1, np.int64)
        spot = self._search(items, every, items.left, False)
        before, after = self.array[np.maximum(spot - 1, 0)], self.array[np.minimum(spot, len(self.array) - 1)]
        one, two = (_common(self.text, x, items.words, items.suffix, items.left)[0] for x in (before, after))
        return np.maximum(one, two), self.origin[np.where(two >= one, after, before)]

    def matches(self, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All places of all windows (numbers of words of the run), the suffix that each window begins, and the words that
        each place has in common with that suffix."""
        which = np.flatnonzero((items.left >= items.window) & (self.longest(items)[0] >= items.window))
        lo, hi = (self._search(items, which, items.window[which], right) for right in (False, True))
        n = hi - lo
        suffix = np.repeat(which, n)
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = self.array[np.repeat(lo, n) + inner]
        size = np.empty(len(at), np.int64)
        for i in range(0, len(at), PAIRS):
            part = suffix[i : i + PAIRS]
            size[i : i + PAIRS] = _common(self.text, at[i : i + PAIRS], items.words, items.suffix[part], items.left[part])[0]
        return self.origin[at], suffix, size


class Found(NamedTuple):
    """What the documents of a shard share with the items: numbers of hits at the edges of words, items of each document, and
    maximal matches as (document, item, word of the item, word of the document, words)."""

    delta: np.ndarray
    names: list[set[str]]
    longest: np.ndarray
    locations: list[list[tuple[str, int, int, int]]]


def search_shard(w: Words, blocks: Iterator[Items]) -> Found:
    n = len(w.counts)
    found = Found(np.zeros(len(w.starts) + 1, np.int64), [set() for _ in range(n)], np.zeros(n, np.int64), [[] for _ in range(n)])
    for items in blocks:
        shard = Shard(w, items)
        place, suffix, size = shard.matches(items)
        if not len(place):
            continue
        doc = shard.owner[place]
        np.maximum.at(found.longest, doc, size)
        for d, i in np.unique(np.column_stack([doc, items.owner[suffix]]), axis=0).tolist():
            found.names[d].add(items.ids[i])
        np.add.at(found.delta, place, 1)
        np.add.at(found.delta, place + items.window[suffix], -1)
        # a match is maximal if the words before do not agree too: no match of the suffix before it at the place before it
        number = items.suffix[suffix] - items.owner[suffix]  # of the word among the items' words
        key, before = place * (len(items.suffix) + 1) + number, (place - 1) * (len(items.suffix) + 1) + number - 1
        same = np.isin(before, key)
        own = number - items.source.first[items.owner[suffix]]
        whole = np.flatnonzero(~(same & (own > 0) & (place > shard.first[doc])))
        for d, i, a, p, k in zip(doc[whole].tolist(), items.owner[suffix[whole]].tolist(), own[whole].tolist(), (place - shard.first[doc])[whole].tolist(), size[whole].tolist(), strict=True):
            found.locations[d].append((items.ids[i], a, p, k))
    return found


HITS = "id long, n_words long, spans array<long>, items array<string>, longest long, locations array<struct<item:string,item_word:long,word:long,words:long>>"
_LOCATION = pa.list_(pa.struct([("item", pa.string()), ("item_word", pa.int64()), ("word", pa.int64()), ("words", pa.int64())]))


def _spans(found: Found, w: Words) -> list[list[int]]:
    """Of each document, the hit words as starts and ends, one after the other."""
    hit = np.cumsum(found.delta)[:-1] > 0
    out: list[list[int]] = [[] for _ in w.counts]
    for d in np.flatnonzero(found.longest).tolist():
        h = np.concatenate([[False], hit[w.first[d] : w.first[d + 1]], [False]])
        out[d] = np.flatnonzero(h[1:] != h[:-1]).tolist()
    return out


def item_blocks(items: DataFrame, item_id_col: str, item_text_col: str, window: int) -> Callable[[], Iterator[Items]]:
    """The test items, ready for a task: in the closure if they are one block, else read block by block from the shared folder."""
    spark = items.sparkSession
    test = items.select(F.col(item_id_col).cast("string").alias("id"), F.col(item_text_col).cast("string").alias("text"))
    test = test.where("text IS NOT NULL").withColumn("id", F.coalesce("id", F.lit("")))
    size = test.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= BLOCK_BYTES:
        rows = test.collect()
        held = prepare([r["id"] for r in rows], [r["text"].encode() for r in rows], window)
        return lambda: iter([held])
    folder, blocks = work_dir(spark, "items"), -(-size // BLOCK_BYTES)
    test.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks))).repartition("block").sortWithinPartitions("block").write.partitionBy("block").parquet(folder)

    def read() -> Iterator[Items]:
        import os

        import pyarrow.parquet as pq
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + os.path.abspath(folder.removeprefix("file:")))
        for info in sorted(store.get_file_info(fs.FileSelector(path)), key=lambda x: x.path):
            if "block=" in info.path:
                rows = pq.read_table(info.path, filesystem=store, columns=["id", "text"], partitioning=None)
                yield prepare(rows["id"].to_pylist(), [x.encode() for x in rows["text"].to_pylist()], window)

    return read


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Verbatim overlaps of documents with test items.

    Returns per row of docs: doc_id, n_words, spans (array of long: start and end of each run of hit words, one after
    the other), items (array of string: the ids of items with a window in it), longest (words of the longest verbatim
    match that holds a window; 0 if none), locations (the maximal matches that begin with a window: item, item_word, word, words). A
    window is `window` words in a row of an item; a shorter item that has words is one window. Null and wordless texts have no words and
    no hits, and such items no windows. One pass over the documents without a shuffle; items beyond BLOCK_BYTES are searched block by block
    within each task. No test items, or no documents, are no special case.
    """
    bounded_batches(docs.sparkSession)
    blocks = item_blocks(items, item_id_col, item_text_col, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in pieces(batch, SHARD_BYTES):
                w = Words(texts)
                found = search_shard(w, blocks())
                columns = [ids, pa.array(w.counts, pa.int64()), pa.array(_spans(found, w), pa.list_(pa.int64())), pa.array([sorted(x) for x in found.names], pa.list_(pa.string())), pa.array(found.longest)]
                rows = [[dict(zip(("item", "item_word", "word", "words"), x, strict=True)) for x in sorted(d)] for d in found.locations]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, _LOCATION)], ["id", "n_words", "spans", "items", "longest", "locations"])

    return id_and_text(docs, id_col, text_col).mapInArrow(tidy(run), HITS).withColumnRenamed("id", "doc_id")


def longest_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Of each test item that shares a word with the documents: item_id, words (of its longest verbatim match, of any length), item_word (where
    it begins in the item), doc_id and word (where in a document). Of equal matches, the least (doc_id, word, item_word)."""
    bounded_batches(docs.sparkSession)
    blocks = item_blocks(items, item_id_col, item_text_col, 1)
    names = ["item_id", "words", "item_word", "doc_id", "word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in pieces(batch, SHARD_BYTES):
                w = Words(texts)
                for block in blocks():
                    shard = Shard(w, block)
                    size, _ = shard.longest(block)
                    best = np.zeros(len(block.ids), np.int64)
                    np.maximum.at(best, block.owner, size)
                    which = np.flatnonzero((size > 0) & (size == best[block.owner]))
                    lo, hi = (shard._search(block, which, size[which], right) for right in (False, True))
                    suffix = np.repeat(which, hi - lo)
                    place = shard.origin[shard.array[np.repeat(lo, hi - lo) + np.arange(len(suffix)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]]
                    doc = shard.owner[place]
                    own = block.suffix[suffix] - block.owner[suffix] - block.source.first[block.owner[suffix]]
                    values = [pa.array([block.ids[i] for i in block.owner[suffix].tolist()], pa.string()), pa.array(size[suffix]), pa.array(own), ids.take(pa.array(doc)), pa.array(place - shard.first[doc])]
                    yield pa.RecordBatch.from_arrays(values, names)

    found = id_and_text(docs, id_col, text_col).mapInArrow(tidy(run), "item_id string, words long, item_word long, doc_id long, word long")
    best = F.max(F.struct("words", *((-F.coalesce(c, F.lit(2**62))).alias(c) for c in ("doc_id", "word", "item_word"))))
    rows = found.groupBy("item_id").agg(best.alias("m"))
    doc = F.when(F.col("m.doc_id") > -(2**62), -F.col("m.doc_id"))
    return rows.select("item_id", F.col("m.words").alias("words"), (-F.col("m.item_word")).alias("item_word"), doc.alias("doc_id"), (-F.col("m.word")).alias("word"))


def contamination(found: DataFrame) -> DataFrame:
    """Digest of overlaps(): n_hit, n_items, items_sha256 (of the sorted item ids, comma-joined), contaminated (a hit, and
    at least one word in 20 hit), longest, locations."""
    rows = found.withColumn("n_hit", F.expr("aggregate(transform(spans, (v, i) -> IF(i % 2 = 1, v, -v)), 0L, (a, v) -> a + v)"))
    names = F.array_sort(F.array_distinct("items"))
    return rows.select("doc_id", "n_words", "n_hit", F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "longest", "locations")


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs in which no window of a test item occurs, with all their columns: affected documents go, however long.
    Each row is decided by its own text in one pass, without a shuffle; null texts stay."""
    place, blocks = docs.columns.index(text_col), item_blocks(items, item_id_col, item_text_col, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for _, texts in pieces(pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(place)], ["id", "text"]), SHARD_BYTES):
                found = search_shard(Words(texts), blocks())
                yield batch.slice(at, len(texts)).filter(pa.array(found.longest == 0))
                at += len(texts)

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(tidy(run), docs.schema)
