import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import exact, fuse


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 200_000])
def test_filter_knows_its_keys_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(-(2**63), 2**63 - 1, n, dtype=np.int64)
    made = fuse.build(np.concatenate([keys, keys[: n // 2]]))
    assert fuse.contains(made, keys).all()
    others = rng.integers(-(2**63), 2**63 - 1, 100_000, dtype=np.int64)
    assert fuse.contains(made, others).mean() < 0.006
    assert len(made.fingerprints) <= (1.2 * n + 2**14 if n >= 1000 else 100)


def _brute(rows):
    """(doc_id, keep_id, group_size, kept, digest) of each row."""
    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault(t or "", []).append((d is not None, d or 0, i))
    out = []
    for i, (d, t) in enumerate(rows):
        own = groups[t or ""]
        known, best, at = max(own)
        out.append((d, best if known else None, len(own), at == i, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def _got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def _rows():
    rng = random.Random(3)
    texts = [f"text {i}" for i in range(150)] + ["é漢 " * 3, "x" * 300_000, " ", "a\x00b"]
    rows = [(d, rng.choice(texts) if rng.random() < 0.6 else "hot" if rng.random() < 0.6 else f"own {d}") for d in range(600)]
    return [*rows, (None, "hot"), (None, "only null"), (None, "only null"), (7, None), (8, ""), (9, None), (55, "tie"), (55, "tie"), (599, "tie"), (599, "tie"), (-4, "hot")]


def test_equals_brute_force(spark, monkeypatch):
    rows = _rows()
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, batch int, sha string").repartition(5)
    want = _brute(rows)
    for batches, keys in ((1, 1 << 19), (3, 1 << 19), (4, 20)):
        monkeypatch.setattr(exact, "SHARD_KEYS", keys)
        assert _got(exact.decide(docs, exact.by_range(docs, batches), batches)) == want


def test_filters_and_bytes_decide(spark, monkeypatch):
    """A snapshot's copies are met through its filters, and only texts of equal bytes are copies."""
    docs = spark.createDataFrame([(2, "a"), (1, "a"), (0, "b")], "doc_id long, text string")
    batch = F.when(F.col("doc_id") == 2, 0).otherwise(1)
    size = lambda: {r.doc_id: (r.keep_id, r.group_size) for r in exact.decide(docs, batch, 2).collect()}
    assert size() == {2: (2, 2), 1: (2, 2), 0: (0, 1)}
    monkeypatch.setattr(exact, "_sha", lambda text: F.lit("one digest"))  # all texts of one digest: bytes alone tell them apart
    two = docs.where("doc_id <> 1")
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact.decide(two, batch, 2).collect()} == {2: (2, 1), 0: (0, 1)}
    monkeypatch.undo()
    monkeypatch.setattr(exact, "screen", lambda groups, earlier, count: groups.select("key").limit(0))
    assert size() == {2: (2, 1), 1: (1, 1), 0: (0, 1)}


def test_screen_passes_few_strangers(spark):
    known = exact.grouped(exact.digests(spark.range(3000).select("id", F.col("id").cast("string").alias("text")), F.lit(0), "id")).drop("batch")
    made = exact.snapshot(known)
    others = exact.grouped(exact.digests(spark.range(3000, 23000).select("id", F.col("id").cast("string").alias("text")), F.lit(0), "id")).drop("batch")
    assert exact.screen(known, made, 3000).count() == 3000
    assert exact.screen(others, made, 20000).count() < 150


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact.decide(docs, exact.by_range(docs, 3), 3).count() == 0
