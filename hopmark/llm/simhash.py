"""SimHash near-duplicates by deletion-variant signatures (operator 7).

Two fingerprints of 64 bits that differ in at most two bits, cut into two segments of 32 bits, agree in one segment but
for at most one bit. So each fingerprint is entered under the 64 variants of its segments in which one bit is a
wildcard; an equality join on the variants finds all pairs, and the whole fingerprints are compared. (Cutting so that
one segment agrees wholly would take three segments of 21 bits, whose lists grow 1,024 times as fast.)
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopmark.llm.common import Words, bounded_batches, id_and_text, parted_by_keys, passing_tables, pieces, stored, tidy, without_keys
from hopmark.llm.graph import connected_components

BITS, SEED, DISTANCE = 64, 42, 2
#: Variants with up to so many fingerprints are joined pair by pair; larger ones by sub-variants, without pairs.
PAIRWISE = 256


def shingles(text: bytes, size: int) -> list[bytes]:
    words = text.lower().split()
    if not words:
        return []
    return [b" ".join(words)] if len(words) < size else list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def fingerprint(text: bytes, size: int = 3, seed: int = SEED) -> int:
    """Bits set in over half of the XXH64 hashes of the word shingles, repeats included; as a signed 64-bit integer."""
    parts = shingles(text, size)
    if not parts:
        return 0
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, parts, repeat(seed))), np.uint8)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 8 << 16):
        counts += np.unpackbits(hashes[i : i + (8 << 16)]).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(parts)).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """id, fp (signed 64-bit) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in pieces(batch):
                yield pa.RecordBatch.from_arrays([ids, pa.array([fingerprint(t, shingle) for t in texts], pa.int64())], ["id", "fp"])

    bounded_batches(df.sparkSession)
    return id_and_text(df, id_col, text_col).mapInArrow(tidy(run), "id long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """A row for each fingerprint and wildcard bit p: key is p and the rest of that bit's segment."""
    rows = fps.select("rep", "fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("p"))
    segment = "(shiftrightunsigned(fp, p - p % 32) & 4294967295L)"
    return rows.selectExpr("rep", "fp", f"shiftleft(cast(p as long), 32) | ({segment} & ~shiftleft(1L, p % 32)) AS key")


def hot_keys(fps: DataFrame, often: int = PAIRWISE) -> DataFrame:
    """Variants that look crowded in a sample of one fingerprint in 64. They are only routed another way, so the sample
    decides on the load of tasks, never on results."""
    some = variants(fps.where(F.pmod(F.xxhash64("fp"), F.lit(64)) == 0))
    return stored(some.groupBy("key").count().where(F.col("count") >= often).select("key"), "hot")


def links(fps: DataFrame, pairwise: int = PAIRWISE, often: int = PAIRWISE) -> DataFrame:
    """Edges (a, b) that join the same fingerprints as all pairs (rep, fp) within two bits.

    A variant of up to `pairwise` fingerprints gives its verified pairs. The fingerprints of larger ones are entered
    under all their variants with two wildcards, out of the bits in which such fingerprints differ: those under one such
    variant are all within two bits of each other, and each is joined to the smallest. That path makes no pairs and
    drops nothing; it costs at most 2,080 short rows for each distinct crowded fingerprint (64 bits, two at a time), however large the crowd. A pair of which one variant is small and another large is found by either way.
    """
    hot = hot_keys(fps, often)
    rows, crowded = variants(fps), None
    if not hot.isEmpty():
        crowded = rows.join(hot, "key").select("rep", "fp").distinct()
        rows = rows.join(hot, "key", "left_anti")
    live = rows.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    live = stored(live, "live")
    few = live.where(F.col("n") <= pairwise)
    other = few.select("key", F.col("rep").alias("rep2"), F.col("fp").alias("fp2"))
    near = (F.col("rep") < F.col("rep2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= DISTANCE)
    pairs = few.join(other, "key").where(near).select(F.col("rep").alias("a"), F.col("rep2").alias("b"))
    many = live.where(F.col("n") > pairwise).select("rep", "fp").distinct()
    many = stored(many if crowded is None else many.union(crowded).distinct(), "crowded")
    if many.isEmpty():
        return pairs
    differ = many.agg(F.expr("bit_or(fp) ^ bit_and(fp)")).first()[0]
    bits = [i for i in range(BITS) if differ >> i & 1]
    masks = [m - 2**64 if m >= 2**63 else m for m in ((1 << i) | (1 << j) for n, i in enumerate(bits) for j in bits[n:])]
    two = many.select("rep", "fp", F.explode(F.lit(masks)).alias("mask")).selectExpr("rep", "mask", "fp & ~mask AS part")
    least = two.groupBy("mask", "part").agg(F.min("rep").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = two.join(least, ["mask", "part"]).where("rep <> b").select(F.col("rep").alias("a"), "b")
    return pairs.union(stars)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, pairwise: int = PAIRWISE) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id: the smallest id reached by links of at most two
    differing bits, its own included.

    One row for each row of the input. Null, empty and blank texts have fingerprint zero, which is linked as any other;
    fewer words than a shingle count as one shingle. A row with a null id takes the component of its fingerprint; if no
    row of a component has an id, that is null. Rows of one fingerprint are one node of the graph, so copies cost one
    row each, and only differing fingerprints are joined. An empty table gives no rows.
    """
    with passing_tables(df.sparkSession):
        rows = stored(fingerprints(df, id_col, text_col, shingle), "fingerprints", keep=True)
        nodes = stored(rows.groupBy("fp").agg(F.min("id").alias("rep")), "nodes")
        known = nodes.where("rep IS NOT NULL")
        found = connected_components(links(known, pairwise))
        named = nodes.join(found, nodes["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
        named = stored(named, "components", keep=True)
    return rows.join(named, "fp", "left").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near copies have 4/5 of their distinct shingles of SHINGLE words in common, or more. Sketches of SKETCH words of 64 one-bit minima of hashed
#: shingles sort proposed pairs: bits differ with probability (1 - similarity) / 2, so the similarity read from 768 bits deviates by
#: 0.022 at 0.8. Pairs of SURE or more (over four deviations above) are near copies, those below DOUBTFUL (almost four below) are not;
#: the sets of all others are intersected.
SKETCH, SHINGLE, SURE, DOUBTFUL = 12, 5, 0.9, 0.72
_MULTIPLIERS = np.random.default_rng(SEED).integers(0, 2**64, 64 * SKETCH, np.uint64) | np.uint64(1)
NOT_SPACE = np.ones(256, np.uint8)
NOT_SPACE[[0x20, *range(9, 14)]] = 0
#: The minima also propose pairs: those of BAND functions together are a key, 64 keys for each text. Two texts of similarity s share one with probability
#: 1 - (1 - s^12)^64: 0.989 at 0.8, 0.9999 at 0.85, 0.11 at 0.5.
BAND = 12
#: Lists of up to so many texts under a key are compared pair by pair; in larger ones, each with the list's hub and a neighbour.
LIST = 8


def shingle_hashes(w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, repeats included, of words and their hashes, and the number of each text's; fewer
    words than a shingle count as one."""
    place, end = np.arange(len(h)), np.repeat(w.first[1:], w.counts)
    joint = h.copy()
    with np.errstate(over="ignore"):
        for k in range(1, SHINGLE):
            ok = np.flatnonzero(place + k < end)
            mixed = joint[ok] * np.uint64(0x9FB21C651E98DF25) ^ h[ok + k]
            joint[ok] = mixed ^ (mixed >> np.uint64(29))
    n = np.maximum(w.counts - SHINGLE + 1, (w.counts > 0).astype(np.int64))
    keep = end - place >= SHINGLE
    keep[w.first[:-1][w.counts > 0]] = True
    return joint[keep], n


class Sets(NamedTuple):
    """Of each text: the sketch of its set of shingles as SKETCH signed numbers, the keys (no words: zeros), the whole set as 32-bit hashes, a digest
    of the set, and its size."""

    sketch: np.ndarray
    keys: np.ndarray
    grams: list[np.ndarray]
    whole: np.ndarray
    size: np.ndarray


def shingle_sets(w: Words) -> Sets:
    joint, n = shingle_hashes(w, w.hashes(SEED))
    ends = np.cumsum(n)
    some = np.flatnonzero(n)
    bits = np.zeros((len(n), 64 * SKETCH), np.uint8)
    keys = np.zeros((len(n), 64 * SKETCH // BAND), np.uint64)
    grams, digests, size = [], np.zeros(len(n), np.uint64), np.zeros(len(n), np.int64)
    with np.errstate(over="ignore"):
        if len(some):
            for j, m in enumerate(_MULTIPLIERS):
                least = np.minimum.reduceat(joint * m, (ends - n)[some])
                least ^= least >> np.uint64(31)
                least *= np.uint64(0xBF58476D1CE4E5B9)
                bits[some, j] = least >> np.uint64(63)
                mixed = (keys[some, j // BAND] ^ least) * np.uint64(0x9FB21C651E98DF25)
                keys[some, j // BAND] = (mixed ^ (mixed >> np.uint64(29))) + np.uint64(j % BAND == 0) * np.uint64(j)
        for i, (a, b) in enumerate(zip((ends - n).tolist(), ends.tolist(), strict=True)):
            u = np.unique(joint[a:b])
            digests[i], size[i] = ((u ^ (u >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)).sum(), len(u)
            grams.append(np.unique((u >> np.uint64(32)).astype(np.uint32)).view(np.int32))
    return Sets(np.packbits(bits, axis=1).view(np.int64), keys.view(np.int64), grams, digests.view(np.int64), size)


SKETCHED = [f"s{i}" for i in range(SKETCH)]
#: Columns that tell sets of shingles apart: 128 bits of digests and the size.
NAMES = ["fp", "whole", "n"]


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(parts) if parts else [], kind))


def all_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, h (a hash of the text), fp, a digest of the set of shingles and its size, the sketch as s0, s1, ..., its keys (none
    without words), and the whole set (grams)."""
    bounded_batches(df.sparkSession)
    texts = id_and_text(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for ids, part in pieces(batch, 1 << 20):
                sets = shingle_sets(Words(part, NOT_SPACE))
                fps = pa.array([fingerprint(t) for t in part], pa.int64())
                columns = [ids, batch.column(2).slice(done, len(part)), fps, pa.array(sets.whole), pa.array(sets.size), *(pa.array(np.ascontiguousarray(c)) for c in sets.sketch.T)]
                yield pa.RecordBatch.from_arrays([*columns, _lists([k[: len(k) * (x > 0)] for k, x in zip(sets.keys, sets.size, strict=True)], pa.int64()), _lists(sets.grams, pa.int32())], ["id", "h", *NAMES, *SKETCHED, "keys", "grams"])
                done += len(part)

    return texts.withColumn("h", text_hash("text")).mapInArrow(tidy(run), ", ".join(f"{n} long" for n in ["id", "h", *NAMES, *SKETCHED]) + ", keys array<long>, grams array<int>")


def text_hash(text_col: str) -> F.Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def _sides(nodes: DataFrame) -> tuple[DataFrame, DataFrame, F.Column, F.Column]:
    """The columns of nodes as those of an edge's ends; bits in which the sketches of a and b differ, and whether these and the sizes of
    the sets allow a similarity of 4/5."""
    a, b = (nodes.select(F.col("rep").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in ["n", *SKETCHED])) for n in ("a", "b"))
    differ = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in SKETCHED), F.lit(0))
    sizes = (5 * F.col("a_n") >= 4 * F.col("b_n")) & (5 * F.col("b_n") >= 4 * F.col("a_n"))
    return a, b, differ, sizes & (differ <= int(32 * SKETCH * (1 - DOUBTFUL)))


def verified(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """Of pairs (a, b, differ), those whose sets, grams (rep, grams), have 4/5 of their union in common; sketches that differ little are proof."""
    sure = F.col("differ") <= int(32 * SKETCH * (1 - SURE))
    doubtful = pairs.where(~sure).select("a", "b")
    wanted = doubtful.select(F.col("a").alias("rep")).union(doubtful.select("b")).distinct()
    some, _ = parted_by_keys(grams, F.col("rep"), wanted)
    sets = stored(some.join(wanted, "rep", "left_semi"), "sets")
    one, two = (sets.select(F.col("rep").alias(n), F.col("grams").alias(f"{n}_set")) for n in ("a", "b"))
    alike = 9 * F.size(F.array_intersect("a_set", "b_set")) >= 4 * (F.size("a_set") + F.size("b_set"))
    return pairs.where(sure).select("a", "b").union(doubtful.join(one, "a").join(two, "b").where(alike).select("a", "b"))


def proposals(nodes: DataFrame, often: int = PAIRWISE) -> DataFrame:
    """Distinct pairs (a > b) of nodes (rep, keys) to compare; their number grows with that of the nodes, however large a list is."""
    return proposed(nodes, often)[0]


def proposed(nodes: DataFrame, often: int) -> tuple[DataFrame, DataFrame]:
    """The pairs of proposals(), and the nodes (rep) that stand in long lists, of which not all pairs are among them.

    Lists of up to LIST nodes under one key give all their pairs. In larger ones each node is paired with the list's hub, the node that
    has most others under all its long lists together, so with the text that the others are copies of; and with a neighbour in an order that differs from
    key to key. Lists that a sample shows to be crowded are ordered in salted parts, and their sizes are taken from the sample."""
    rows = nodes.select("rep", F.explode("keys").alias("key"))
    some = nodes.where(F.pmod(F.xxhash64("rep"), F.lit(64)) == 0).select(F.explode("keys").alias("key"))
    hot = stored(some.groupBy("key").agg((64 * F.count("*")).alias("n")).where(F.col("n") >= 64 * often), "hot")
    crowded = rows.join(hot, "key").select("rep", "key", "n", F.pmod(F.xxhash64("rep"), F.lit(64)).cast("int").alias("salt"))
    live = rows.join(hot, "key", "left_anti").withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    live = stored(live.select("rep", "key", "n"), "live")
    few = live.where(F.col("n") <= LIST).select("key", F.col("rep").alias("a"))
    pairs = few.join(few.select("key", F.col("a").alias("b")), "key").where("a > b").select("a", "b")
    many = live.where(F.col("n") > LIST).select("rep", "key", "n", F.lit(0).alias("salt")).union(crowded)
    many = stored(many.withColumn("others", F.sum("n").over(Window.partitionBy("rep"))).select("rep", "key", "salt", "others"), "many")
    hubs = many.groupBy("key").agg(F.expr("max(struct(others, rep)).rep").alias("other"))
    order = Window.partitionBy("key", "salt").orderBy(F.xxhash64("rep", "key"))
    next_to = many.select("rep", F.lag("rep").over(order).alias("other")).where("other IS NOT NULL")
    stars = many.join(hubs, "key").select("rep", "other").union(next_to).where("rep <> other")
    return pairs.union(stars.select(F.greatest("rep", "other").alias("a"), F.least("rep", "other").alias("b"))).distinct(), many.select("rep").distinct()


#: Shingles of texts in long lists are counted in so many cells, to sort the rarest first.
CELLS = 1 << 18


def rare_first(sets: DataFrame) -> DataFrame:
    """rep, n, i, gram: of each set (rep, grams) its size and its rarest grams, in one order for all, by number i from 0. Two sets with 4/5 of their union in common
    have one of these in common: with sizes n and m they share 4/9 (n + m) grams at least, and m is 4/5 n or more, so the first that they share has
    at most n - 4/9 (n + m), or n / 5, before it.

    The order is by the counts of CELLS cells of grams, then by the grams; any order will do, and this one makes few sets share their first grams."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, np.int64)
        for b in batches:
            n += np.bincount(b.column(0).flatten().to_numpy().view(np.uint32) % CELLS, minlength=CELLS)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used])], ["cell", "n"])

    found = sets.select("grams").mapInArrow(tidy(cells), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS, np.int64)
    counts[found.column("cell").to_numpy()] = found.column("n").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rep, grams in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                g = grams.values.to_numpy().view(np.uint32)
                first = g[np.lexsort((g, counts[g % CELLS]))][: len(g) // 5 + 1]
                k = len(first)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, rep)), pa.array(np.full(k, len(g), np.int32)), pa.array(np.arange(k, dtype=np.int32)), pa.array(first.view(np.int32))], ["rep", "n", "i", "gram"])

    return sets.select("rep", "grams").where(F.size("grams") > 0).mapInArrow(tidy(run), "rep long, n int, i int, gram int")


def crowd_pairs(sets: DataFrame, found: DataFrame) -> DataFrame:
    """All pairs (a > b) of sets (rep, grams) that may have 4/5 of their union in common and that the components found (node, component) do not join yet.

    Pairs share one of their rarest grams, at places that leave enough grams behind them. Grams all of whose sets are in one component, and sets that are too
    large or small for all others under a gram, are left out before pairs are made."""
    rows = rare_first(sets).join(found, F.col("rep") == F.col("node"), "left").select("rep", "n", "i", "gram", F.coalesce("component", "rep").alias("c"))
    # 9 (n - i) >= 4 (n + m) bounds the other's size m, and 5 m >= 4 n as well
    rows = rows.withColumn("most", F.floor((5 * F.col("n") - 9 * F.col("i")) / 4))
    rows = stored(rows, "rare")
    ends = rows.groupBy("gram").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("n").alias("least"), F.max("most").alias("far")).where("c0 < c1")
    live = rows.join(ends, "gram").where("most >= least AND n <= far").select("rep", "n", "most", "gram", "c")
    # without those, the bounds are tighter still
    live = stored(live, "rare")
    ends = live.groupBy("gram").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("gram")
    live = stored(live.join(ends, "gram"), "rare")
    other = live.select("gram", *(F.col(c).alias(f"{c}2") for c in ("rep", "n", "most", "c")))
    near = (F.col("rep") > F.col("rep2")) & (F.col("c") != F.col("c2")) & (F.col("most") >= F.col("n2")) & (F.col("most2") >= F.col("n"))
    return live.join(other, "gram").where(near).select(F.col("rep").alias("a"), F.col("rep2").alias("b")).distinct()


def wide_links(nodes: DataFrame, grams: DataFrame, often: int = PAIRWISE) -> DataFrame:
    """Edges (a, b) between nodes (rep, n, s0, ..., keys) with sets of shingles grams (rep, grams): the proposals with 4/5 of their sets' union
    in common; and, of the nodes in long lists, whose pairs are not all proposed, all further pairs of that similarity that would join components. So
    whatever shares a key is linked."""
    left, right, differ, near = _sides(nodes)
    first, many = proposed(nodes, often)
    pairs = stored(first, "candidates")
    pairs = stored(pairs.join(left, "a").join(right, "b").where(near).select("a", "b", differ.alias("differ")), "near")
    edges, many = stored(verified(pairs, grams), "links"), stored(many, "many")
    if many.isEmpty():
        return edges
    some, _ = parted_by_keys(grams, F.col("rep"), many)
    sets = stored(some.join(many, "rep", "left_semi"), "crowd")
    known = connected_components(edges)
    more = stored(crowd_pairs(sets, known).withColumn("differ", F.lit(64 * SKETCH)), "candidates")
    return edges.union(stored(verified(more, sets), "links"))


#: The row of a group that stays: the smallest id, null ids last, then the smallest hash of the text.
FIRST = "struct(id IS NULL AS no_id, id, h)"


def grouped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of df: id, h (a hash of the text), first (the row of its group that stays, as FIRST).

    Groups are joined by the links of near_duplicates() and by those of wide_links(). The nodes are sets of shingles with fingerprints, never ids,
    so rows that share an id are told apart by their texts."""
    rows = stored(all_fingerprints(df, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()), "fingerprints")
    nodes = rows.groupBy(*NAMES).agg(F.min("rid").alias("rep"), F.expr(f"min({FIRST})").alias("first"), F.min_by(F.struct("keys", *SKETCHED), "rid").alias("own"))
    nodes = stored(nodes.select(*NAMES, "rep", "first", "own.*"), "nodes")
    same = nodes.groupBy("fp").agg(F.min("rep").alias("lead"))
    edges = nodes.join(same, "fp").where("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b"))
    edges = edges.union(links(stored(same.withColumnRenamed("lead", "rep").select("rep", "fp"), "narrow")))
    edges = edges.union(wide_links(nodes, rows.select(F.col("rid").alias("rep"), "grams")))
    found = connected_components(edges)
    named = nodes.join(found, nodes["rep"] == found["node"], "left").select(*NAMES, "first", F.coalesce("component", "rep").alias("component"))
    named = stored(named, "components")
    firsts = named.groupBy("component").agg(F.min("first").alias("least"))
    lead = stored(named.join(firsts, "component").select(*NAMES, F.col("least").alias("first")), "firsts")
    return rows.select("id", "h", *NAMES).join(lead, NAMES, "left").select("id", "h", "first")


def copy_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id (the smallest id of the group, its own included) of each row: groups by the links of near_duplicates() and
    by near copies with 4/5 of their distinct five-word shingles in common or more. Null, empty and blank texts are one group; rows with a null
    id take the group of their text, whose component_id is null if none of it has an id."""
    return grouped(df, id_col, text_col).select(F.col("id").alias("doc_id"), F.col("first.id").alias("component_id"))


def without_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of copy_groups(), with all its columns: that of the smallest id (null ids last; of several texts with one id, that of
    the smallest hash). Of rows that agree in id and text, any one. Rows that share an id but not a group stay."""
    with passing_tables(df.sparkSession):
        found = stored(grouped(df, id_col, text_col).groupBy("id", "h", "first").count(), "decisions", keep=True)
    key = lambda i, h: F.struct(i.isNull(), F.coalesce(i, F.lit(0)), h)
    mark = key(F.col(id_col).cast("long"), text_hash(text_col))
    stays = (F.col("first.no_id") == F.col("id").isNull()) & F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.h") == F.col("h"))
    own = key(F.col("id"), F.col("h")).alias("key")
    repeated = stored(found.where(stays & (F.col("count") > 1)).select(own), "repeated", keep=True)
    single = without_keys(df, mark, found.where(~stays | (F.col("count") > 1)).select(own))
    if repeated.isEmpty():
        return single
    some, _ = parted_by_keys(df, mark, repeated)
    inner = some.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), mark.alias("key")).join(repeated, "key", "left_semi")
    return single.union(inner.groupBy("key").agg(F.first("row").alias("row")).select("row.*"))
