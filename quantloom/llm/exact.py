"""Exact dedup of batches against immutable snapshots: filters screen digests, exact buckets and bytes decide.

1. A batch's texts are grouped by SHA-256 first: one row for each text of the batch, by map-side combine, however many
   copies it has.
2. Each earlier snapshot has static binary-fuse filters over the 64-bit keys of its digests, one for each shard of at
   most about ``SHARD_KEYS`` keys, written with it and never changed.  A batch's keys meet the filters of their shards;
   what no filter knows is new.
3. What a filter knows is joined with the exact buckets of that snapshot (key, digest, the row that stays), and the
   bytes of both texts are compared.  Only texts that a bucket knows are read again for this.
4. New texts make the batch's own snapshot, which screens later batches.

Copies inside a batch are told by SHA-256; between a batch and a snapshot by the bytes.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm import fuse
from quantloom.llm.reduce import split
from quantloom.llm.scratch import table

#: Keys of a snapshot in one filter, and keys that meet one filter in one task, about.
SHARD_KEYS = 1 << 19
#: Batches that the registered query makes of a table, by doc_id, the largest first.
BATCHES = 3

_GROUP = "sha string, key long, n long, keep struct<doc_id:bigint,row:bigint>"


class Snapshot(NamedTuple):
    """Texts of one point in time: exact buckets (``_GROUP``), their filters, and how many shards the keys have."""

    buckets: DataFrame
    filters: DataFrame
    shards: int


def digests(docs: DataFrame, batch: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(batch, doc_id, row, sha) for every row; null counts as empty. ``row`` tells repeated rows apart."""
    rows = docs.select(batch.cast("int").alias("batch"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), _sha(text).alias("sha"))
    return rows.withColumn("row", F.monotonically_increasing_id())


def _sha(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256)


def grouped(rows: DataFrame) -> DataFrame:
    """(batch, ``_GROUP``): a row for each text of a batch, with its copies and the one that stays: the largest (doc_id, row)."""
    out = rows.groupBy("batch", "sha").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "row")).alias("keep"))
    return out.select("batch", "sha", F.xxhash64("sha").alias("key"), "n", "keep")


def snapshot(groups: DataFrame) -> Snapshot:
    """A snapshot of texts that no earlier one has (``_GROUP``): its buckets and filters are written once."""
    buckets = table(groups.select("sha", "key", "n", "keep"), "buckets")
    shards = 1 << max(0, math.ceil(math.log2(max(1, buckets.count()) / SHARD_KEYS)))

    def build(keys: pd.DataFrame) -> pd.DataFrame:
        made = fuse.build(keys["key"].to_numpy())
        return pd.DataFrame({"shard": [keys["shard"].iloc[0]], "seed": [made.seed], "segment": [made.segment], "marks": [made.fingerprints.tobytes()]})

    filters = buckets.select("key", _shard(shards)).groupBy("shard").applyInPandas(build, "shard long, seed long, segment long, marks binary")
    return Snapshot(buckets, table(filters, "filters"), shards)


def _shard(shards: int) -> Column:
    return F.col("key").bitwiseAND(F.lit(shards - 1).cast("long")).alias("shard")


def screen(groups: DataFrame, earlier: Snapshot, count: int) -> DataFrame:
    """The keys out of ``count`` groups that the snapshot's filters may know; a key that it has is never missing."""
    import numpy as np

    parts = max(1, math.ceil(count / (earlier.shards * SHARD_KEYS)))  # so that no task meets more keys than it can hold
    keys = groups.select("key", _shard(earlier.shards), F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part"))
    filters = earlier.filters.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def probe(met: pd.DataFrame, made: pd.DataFrame) -> pd.DataFrame:
        if not len(met) or not len(made):
            return pd.DataFrame({"key": pd.Series([], dtype="int64")})
        one = made.iloc[0]
        known = fuse.contains(fuse.Filter(int(one["seed"]), int(one["segment"]), np.frombuffer(one["marks"], np.uint8)), met["key"].to_numpy())
        return pd.DataFrame({"key": met["key"][known]})

    return keys.groupBy("shard", "part").cogroup(filters.groupBy("shard", "part")).applyInPandas(probe, "key long").distinct()


def _same_bytes(found: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The digests of ``found`` (sha, own and their rows that stay) whose texts are equal byte for byte.

    The rows that stay are read again, all others are kept out of the shuffle; one pair of texts meets for each digest.
    """
    of = lambda side: found.select("sha", F.xxhash64(f"{side}.doc_id").alias("of"), F.lit(side).alias("side"))  # noqa: E731  a null id has a hash too
    wanted = table(of("own").union(of("their")).groupBy("sha", "of").agg(F.count_distinct("side").alias("sides")), "wanted")
    rows = docs.select(_sha(text).alias("sha"), F.xxhash64(F.col(f"`{doc_id}`").cast("long")).alias("of"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    maybe, _ = split(rows, ["sha", "of"], wanted)
    texts = maybe.groupBy("sha", "of").agg(F.min("text").alias("least"), F.max("text").alias("most"))
    both = texts.join(wanted, ["sha", "of"]).groupBy("sha").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("sides").alias("sides"))
    return both.where("least = most AND sides = 2").select("sha")


def decide(docs: DataFrame, batch: Column, batches: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``, dealt into batches 0 to ``batches`` - 1.

    Of equal texts, the row with the largest doc_id in the earliest batch stays; of rows that share that doc_id too,
    one.  Null texts count as empty ones and are copies of them; a null doc_id is smaller than any other; a very long
    text is hashed whole and never grouped by its bytes alone; an empty table gives an empty result; other columns are
    not read, whatever their names.  A group of copies is one row per batch before it meets anything, and rows find
    their group by a join that Spark can split.
    """
    rows = table(digests(docs, batch, doc_id, text), "digests")
    groups = table(grouped(rows), "groups")
    counts = dict(groups.groupBy("batch").count().collect())
    made: list[Snapshot] = []
    settled = None
    for b in range(batches):
        own = groups.where(F.col("batch") == b).drop("batch")
        count, known = counts.get(b, 0), None
        if not count:
            continue
        for earlier in made:
            hits = screen(own, earlier, count)
            theirs = earlier.buckets.select("sha", "key", F.col("keep").alias("their"))
            found = own.join(hits, "key", "left_semi").select("sha", "key", "n", F.col("keep").alias("own")).join(theirs, ["key", "sha"])
            known = found if known is None else known.union(found)
        if known is not None:
            known = table(known, "known")
            known = table(known.join(_same_bytes(known, docs, doc_id, text), "sha", "left_semi"), "copies")
            own = own.join(known.select("sha"), "sha", "left_anti")
        made.append(snapshot(own))
        new = made[-1].buckets.select(F.lit(b).alias("batch"), "sha", "n", "keep")
        if known is not None:
            new = new.union(known.select(F.lit(b).alias("batch"), "sha", "n", F.col("their").alias("keep")))
        settled = new if settled is None else settled.union(new)
    if settled is None:
        settled = groups.select("batch", "sha", "n", "keep")
    sizes = settled.groupBy("sha", "keep").agg(F.sum("n").alias("size"), F.collect_list("batch").alias("batches")).where("size > 1")
    shared = table(sizes.select(F.explode("batches").alias("batch"), "sha", "keep", "size"), "shared")
    maybe, single = split(rows, ["batch", "sha"], shared)
    maybe = maybe.join(shared, ["batch", "sha"], "left").withColumn("keep", F.coalesce("keep", F.struct("doc_id", "row")))
    maybe = maybe.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.coalesce("size", F.lit(1)).alias("group_size"), (F.col("row") == F.col("keep.row")).alias("kept"), F.col("sha").alias("text_sha256"))
    return maybe.union(single.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")))


def by_range(docs: DataFrame, batches: int, doc_id: str = "doc_id") -> Column:
    """Batches of equally wide ranges of ids, the largest ids first; null ids are in the last one."""
    least, most = docs.agg(F.min(f"`{doc_id}`"), F.max(f"`{doc_id}`")).first()
    if least is None:
        return F.lit(0)
    edges = [most - (most - least + 1) * k // batches for k in range(1, batches)]
    place = sum((F.when(F.col(f"`{doc_id}`") <= edge, 1).otherwise(0) for edge in edges), F.lit(0))
    return F.when(F.col(f"`{doc_id}`").isNull(), batches - 1).otherwise(place)


def query(spark, sf_dir: str) -> DataFrame:
    """Every document with the copy of its text that stays, as three batches by doc_id, the largest first.

    The cases are those of ``decide``.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decide(docs, by_range(docs, BATCHES), BATCHES)


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
