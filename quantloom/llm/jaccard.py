"""Near-duplicate join: Jaccard of five-word shingles with Bayesian candidate pruning.

1. Every whole text becomes its set of shingle hashes; texts with the same set collapse to one representative.
2. Representatives get MinHash values; bands of them name buckets.  With 5 values a band and 32 bands a pair of
   similarity 0.8 shares no bucket with probability 3e-6.
3. Documents that share buckets form candidate components, found from (document, bucket's smallest document) edges.  A
   small component is one group.  A larger one is cut into blocks of bounded size, by set size (only sizes within the
   threshold's ratio can match) and by the first of a document's buckets, so that documents of one bucket mostly sit
   together.  Two blocks are a group only if some bucket has documents of both, so a component that is long because its
   buckets form a chain costs no more than its buckets do.  One whose buckets overlap much, as those of many variants of
   one text do, is cut into fewer blocks by plain hashes, of which each two of neighbouring sizes meet.
4. In a group, pairs compare MinHash values step by step.  With m values compared and k equal, the posterior of
   similarity >= t under a uniform prior is 1 - I_t(k + 1, m - k + 1); pairs below ``tolerance`` are dropped.  The rest
   are verified exactly on their shingle sets.
5. A group returns link counts and a spanning forest of its links, so no list of all pairs exists anywhere, and the
   forests' components are the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.components import connected_components
from quantloom.llm.reduce import split
from quantloom.llm.scratch import table
from quantloom.llm.words import chunks, grams, mix

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
#: MinHash values compared between two looks at the posterior.
STEP = 16
#: Pairs are dropped once the posterior probability of reaching the threshold is below this.
TOLERANCE = 1e-7
#: A block holds about so many documents and shingles at most.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 400_000
#: Pairs left for each set at which all sets are compared at once instead of pair by pair, and shingles taken at a time.
DENSE, DENSE_SHINGLES = 8, 4096

_U32 = np.uint32


@cache
def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 2 * k + 1, dtype=np.uint64))
    return (seed[:k] >> np.uint64(32)).astype(_U32) | _U32(1), (seed[k:] >> np.uint64(32)).astype(_U32)


def signatures(hashes: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """k MinHash values (unsigned 32 bit) of each of the sets that ``first`` delimits; all ones for an empty set."""
    full = np.flatnonzero(np.diff(first))
    out = np.full((len(first) - 1, k), 0xFFFFFFFF, dtype=_U32)
    if full.size:
        short = (hashes >> np.uint64(32)).astype(_U32)
        at = first[:-1][full]
        mul, add = _permutations(k)
        value = np.empty_like(short)
        for j in range(k):
            np.multiply(short, mul[j], out=value)
            np.bitwise_xor(value, value >> _U32(15), out=value)
            np.multiply(value, _U32(0x2C1B3C6D), out=value)
            np.add(value, add[j], out=value)
            out[full, j] = np.minimum.reduceat(value, at)
    return out


def shingle_sets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sorted distinct shingle hashes, first entry of each document) for runs of documents."""
    for lo, hi, words in chunks(column):
        g, _, first = grams(words, SHINGLE_WORDS, short=True)
        doc = np.repeat(np.arange(hi - lo), np.diff(first))
        order = np.lexsort((g, doc))
        g = g[order]
        new = np.ones(len(g), dtype=bool)
        if len(g):
            new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])  # lexsort keeps documents in order
        yield g[new], np.concatenate(([0], np.cumsum(np.bincount(doc[new], minlength=hi - lo)))).astype(np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    data = pa.py_buffer(np.ascontiguousarray(rows).tobytes())
    return pa.Array.from_buffers(pa.binary(width), len(rows), [None, data]).cast(pa.binary())


def sketch(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, k1, k2, n, sig): two independent hashes of the shingle set, its size and the MinHash values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for g, first in shingle_sets(batch.column(1)):
                n = len(first) - 1
                full = np.flatnonzero(np.diff(first))
                keys = np.zeros((2, n), dtype=np.uint64)
                for i, salt in enumerate((0x51ED270B0A1F39C5, 0xA24BAED4963EE407)):
                    if full.size:
                        keys[i, full] = np.add.reduceat(mix(g ^ np.uint64(salt)), first[:-1][full])
                ids = batch.column(0).slice(at, n)
                at += n
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), pa.array(np.diff(first)), _binary(signatures(g, first, BANDS * ROWS))],
                    names=["doc_id", "k1", "k2", "n", "sig"],
                )

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, k1 long, k2 long, n long, sig binary")


@cache
def _least_matches(m: int, t: float, tolerance: float) -> int:
    """Fewest equal values among m at which the posterior of similarity >= t is at least ``tolerance``."""
    for k in range(m + 1):
        # 1 - I_t(k + 1, m - k + 1) is the chance of at most k successes in m + 1 trials of probability t.
        tail = sum(math.comb(m + 1, j) * t**j * (1 - t) ** (m + 1 - j) for j in range(k + 1))
        if tail >= tolerance:
            return k
    return m


def verify_block(sig_a, sig_b, sets_a, sets_b, t: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of the pairs with Jaccard >= t: lengths, then MinHash values in steps, then the sets."""
    size_a, size_b = np.array([len(x) for x in sets_a]), np.array([len(x) for x in sets_b])
    small, large = np.minimum.outer(size_a, size_b), np.maximum.outer(size_a, size_b)
    a, b = np.nonzero((small > 0) & (small >= t * large - 1e-9))
    equal = np.zeros(len(a), dtype=np.int32)
    for lo in range(0, sig_a.shape[1], STEP):
        hi = min(lo + STEP, sig_a.shape[1])
        for part in range(0, len(a), 1 << 16):
            s = slice(part, part + (1 << 16))
            equal[s] += (sig_a[a[s], lo:hi] == sig_b[b[s], lo:hi]).sum(axis=1, dtype=np.int32)
        keep = equal >= _least_matches(hi, t, tolerance)
        a, b, equal = a[keep], b[keep], equal[keep]
        if not len(a):
            break
    if len(a) > DENSE * (len(sets_a) + len(sets_b)):
        common = _common(sets_a, sets_b)[a, b]
    else:
        common = np.array([_shared(sets_a[x], sets_b[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], dtype=np.int64)
    good = common >= t * (size_a[a] + size_b[b] - common) - 1e-9
    return a[good], b[good]


def _shared(u: np.ndarray, v: np.ndarray) -> int:
    at = np.searchsorted(v, u)
    at[at == len(v)] = 0
    return int((v[at] == u).sum())


def _common(sets_a: list[np.ndarray], sets_b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share: products of incidence matrices, some shingles at a time."""
    flat = [np.concatenate(x) for x in (sets_a, sets_b)]
    both = np.intersect1d(*(np.unique(x) for x in flat))
    out = np.zeros((len(sets_a), len(sets_b)), dtype=np.float32)
    if not len(both):
        return out.astype(np.int64)
    entries = []
    for hashes, sets in zip(flat, (sets_a, sets_b), strict=True):
        column, row = np.searchsorted(both, hashes), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        column[column == len(both)] = 0
        known = both[column] == hashes
        column, row = column[known], row[known]
        order = np.argsort(column, kind="stable")
        entries.append((column[order], row[order], len(sets)))
    for lo in range(0, len(both), DENSE_SHINGLES):
        sides = []
        for column, row, n in entries:
            s = slice(*np.searchsorted(column, (lo, lo + DENSE_SHINGLES)))
            side = np.zeros((n, min(DENSE_SHINGLES, len(both) - lo)), dtype=np.float32)
            side[row[s], column[s] - lo] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T  # whole numbers below 2**24
    return out.astype(np.int64)


def _forest(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs that join two trees, in order: a spanning forest."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    out = []
    for x, y in pairs:
        if (u := root(x)) != (v := root(y)):
            up[u] = v
            out.append((x, y))
    return out


def _verify_groups(t: float, tolerance: float):
    def run(group: pa.Table) -> pa.Table:
        ids = group.column("doc_id").to_numpy()
        copies, right, cross = group.column("copies").to_numpy(), group.column("side").to_numpy() == 1, group.column("g1")[0].as_py() != group.column("g2")[0].as_py()
        sets: list[np.ndarray] = []
        sig = []
        for g, first in shingle_sets(group.column("text")):
            sets += [g[a:b] for a, b in zip(first, first[1:], strict=False)]
            sig.append(signatures(g, first, BANDS * ROWS))
        sig = np.concatenate(sig)
        left = np.flatnonzero(~right)
        other = np.flatnonzero(right) if cross else left
        a, b = verify_block(sig[left], sig[other], [sets[i] for i in left], [sets[i] for i in other], t, tolerance)
        a, b = left[a], other[b]
        keep = ids[a] != ids[b] if cross else ids[a] < ids[b]
        a, b = a[keep], b[keep]
        counts = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
        linked = np.flatnonzero(counts)
        edges = _forest(zip(ids[a].tolist(), ids[b].tolist(), strict=True))
        return pa.table({
            "doc_id": pa.array([*ids[linked].tolist(), *[x for x, _ in edges]], pa.int64()),
            "other": pa.array([None] * len(linked) + [y for _, y in edges], pa.int64()),
            "n_links": pa.array([*counts[linked].astype(np.int64).tolist(), *[0] * len(edges)], pa.int64()),
        })

    return run


def _small_seats(members: DataFrame) -> DataFrame:
    """(rep, copies, cut, g1, g2, side): one group for each component."""
    return members.select("rep", "copies", F.lit(False).alias("cut"), F.col("comp").alias("g1"), F.col("comp").alias("g2"), F.lit(0).alias("side"))


def _seats(placed: DataFrame, met: DataFrame) -> DataFrame:
    """Seats of the members of blocks (``placed``) in the groups of each two blocks (``met``: g1 <= g2)."""
    left = placed.join(met.withColumnRenamed("g1", "block"), "block").select("rep", "copies", F.lit(True).alias("cut"), F.col("block").alias("g1"), "g2", F.lit(0).alias("side"))
    right = placed.join(met.where("g1 <> g2").withColumnRenamed("g2", "block"), "block").select("rep", "copies", F.lit(True).alias("cut"), "g1", F.col("block").alias("g2"), F.lit(1).alias("side"))
    return left.union(right)


def _parts(docs: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(docs / BLOCK_DOCS), F.ceil(shingles / BLOCK_SHINGLES))


def _block_seats(members: DataFrame, keys: DataFrame, buckets: DataFrame) -> DataFrame:
    """The same for large components: a group for each two blocks, or one, that have documents in a common bucket.

    Where a component's buckets overlap so much that this seats its documents more often than blocks of plain hashes would
    if each two of neighbouring classes met, it gets those instead.
    """
    held = table(keys.join(members.select("rep"), "rep").join(buckets.select("key"), "key"), "held_buckets")
    homes = held.groupBy("rep").agg(F.min(F.xxhash64("key")).alias("home"))
    at_home = members.select("rep", "copies", "comp", "class", "n").join(homes, "rep")
    size = at_home.groupBy("comp", "class", "home").agg(_parts(F.count(F.lit(1)), F.sum("n")).alias("parts"))
    block = F.xxhash64("comp", "class", "home", F.pmod(F.xxhash64("rep"), F.col("parts")))
    placed = table(at_home.join(size, ["comp", "class", "home"]).select("rep", "copies", "comp", "class", "n", block.alias("block")), "placed")
    present = table(held.join(placed.select("rep", "class", "block"), "rep").select("key", "class", "block").distinct(), "present")
    x, y = present.alias("x"), present.alias("y")
    fits = (F.col("x.key") == F.col("y.key")) & (F.col("x.block") <= F.col("y.block")) & (F.abs(F.col("x.class") - F.col("y.class")) <= 1)
    met = table(x.join(y, fits).select(F.col("x.block").alias("g1"), F.col("y.block").alias("g2")).distinct(), "block_pairs")

    # Seats that either way takes, by component; blocks and classes are few against documents.
    sizes = placed.groupBy("comp", "block").agg(F.count(F.lit(1)).alias("c"))
    ends = met.select(F.col("g1").alias("block")).union(met.where("g1 <> g2").select(F.col("g2").alias("block")))
    by_bucket = ends.join(sizes, "block").groupBy("comp").agg(F.sum("c").alias("seats"))
    classes = table(placed.groupBy("comp", "class").agg(F.count(F.lit(1)).alias("c"), _parts(F.count(F.lit(1)), F.sum("n")).alias("parts")), "size_classes")
    near = classes.alias("x").join(classes.alias("y"), (F.col("x.comp") == F.col("y.comp")) & (F.abs(F.col("x.class") - F.col("y.class")) <= 1))
    by_hash = near.groupBy(F.col("x.comp").alias("comp")).agg(F.sum(F.col("x.c") * F.col("y.parts")).alias("plain"))
    plain = table(by_bucket.join(by_hash, "comp").where("plain < seats").select("comp"), "plain_components")
    blocks = classes.join(plain, "comp", "left_semi").select("comp", "class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    blocks = blocks.select("comp", "class", F.xxhash64("comp", "class", "part").alias("block"))
    x, y = blocks.alias("x"), blocks.alias("y")
    fits = (F.col("x.comp") == F.col("y.comp")) & (F.col("x.block") <= F.col("y.block")) & (F.abs(F.col("x.class") - F.col("y.class")) <= 1)
    plain_met = table(x.join(y, fits).select(F.col("x.block").alias("g1"), F.col("y.block").alias("g2")).distinct(), "plain_pairs")
    dealt = placed.join(plain, "comp", "left_semi").join(classes.select("comp", "class", "parts"), ["comp", "class"])
    dealt = dealt.select("rep", "copies", F.xxhash64("comp", "class", F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("block"))
    kept = placed.join(plain, "comp", "left_anti").select("rep", "copies", "block")
    return _seats(kept, met).union(_seats(dealt, plain_met))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", t: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, class_id, n_links) for every row of ``docs``.

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles is at least ``t``; a text of
    one to four words is one shingle.  class_id is the smallest doc_id of the connected component, n_links the number
    of other documents linked to this one, exact copies included.  Null or empty texts have no shingles and link to
    nothing.  A null doc_id gets a null class and no links.  Rows that repeat a doc_id count as one document made of
    all of their texts.  An empty table gives an empty result; a very long text is one task's work; other columns are not
    read, whatever their names.  Of equal texts the smallest doc_id stands for all; links of equal strength need no order.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    sketched = table(sketch(rows), "sketches")
    known = sketched.where("doc_id IS NOT NULL AND n > 0")
    reps = table(
        known.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n")), "representatives"
    )
    own = known.join(reps.select("k1", "k2", "rep", "copies"), ["k1", "k2"]).where("doc_id = rep")
    step = 4 * ROWS
    keys = own.select(
        "rep", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * step + 1, F.lit(step))))).alias("key")
    )
    keys = table(keys, "bands")
    buckets = table(keys.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("key", "a"), "buckets")
    edges = keys.join(buckets, "key").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    candidates = table(connected_components(edges), "candidates").withColumnsRenamed({"node": "rep", "root": "comp"})
    # Set sizes whose logarithm to the base 1/t rounds alike share a class; only equal or neighbouring classes can match.
    size = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(1 / t)) + 1e-9).cast("int")
    by_rep = reps.groupBy("rep").agg(F.max("n").alias("n"), F.sum("copies").alias("copies"))
    members = table(candidates.join(by_rep, "rep").withColumn("class", size), "members")
    large = members.groupBy("comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w")).where((F.col("c") > BLOCK_DOCS) | (F.col("w") > BLOCK_SHINGLES)).select("comp", F.lit(True).alias("cut"))
    members = table(members.join(large, "comp", "left"), "members")
    seats = _small_seats(members.where("cut IS NULL"))
    if not large.isEmpty():
        seats = table(seats.union(_block_seats(members.where("cut"), keys, buckets)), "seats")
    maybe, _ = split(rows, ["doc_id"], seats.select(F.col("rep").alias("doc_id")).distinct())
    texts = maybe.join(seats, maybe.doc_id == seats.rep).select("doc_id", "copies", "text", "cut", "g1", "g2", "side")
    groups = texts.groupBy("cut", "g1", "g2")
    found = table(groups.applyInArrow(_verify_groups(t, tolerance), "doc_id long, other long, n_links long"), "links")
    classes = table(connected_components(found.where("other IS NOT NULL").select(F.col("doc_id").alias("a"), F.col("other").alias("b"))), "classes")
    links = found.groupBy(F.col("doc_id").alias("rep")).agg(F.sum("n_links").alias("n"))
    groups = by_rep.join(classes.withColumnsRenamed({"node": "rep"}), "rep", "left").join(links.select("rep", F.col("n").alias("linked")), "rep", "left")
    verdict = groups.select("rep", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    result = reps.select("k1", "k2", "rep").join(verdict, "rep").select("k1", "k2", "class_id", "n_links")
    result = table(result, "verdicts")
    out = sketched.select("doc_id", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("k1")).alias("k1"), "k2").join(result, ["k1", "k2"], "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` whose document is the smallest of its class, or has a null id."""
    losers = table(near_duplicates(docs, doc_id, text, **options).where("doc_id <> class_id").select(F.col("doc_id").alias("_loser")).distinct(), "losers")
    return docs.join(losers, docs[doc_id].cast("long") == losers["_loser"], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """Class and number of links of every document; null texts are classes of their own."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
