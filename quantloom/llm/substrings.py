"""Repeated passages: confirm recurring passages, compile sharded Aho-Corasick automata, stream the documents through them.

0. Copies.  Of documents with equal texts only that of the smallest doc_id is searched; all windows of the others are
   repeated.  Equality is by two 64-bit hashes of the whole text.
1. Anchors.  Each 13-word window's anchor is the five-word phrase in it with the smallest hash; equal windows have equal
   anchors, and one word in five starts one.  Only anchors met in two documents at least can belong to a recurring
   window (one shuffle of anchor hashes with the smallest and largest document).
2. Confirmation.  The windows round such anchors, as 64-bit hashes, are counted by document: those met in two documents
   at least recur, and the smallest of these documents owns them.
3. Passages.  An owner's recurring windows that follow each other make passages, cut from its text in pieces of at most
   ``PIECE_WINDOWS`` windows.  Each other document that has the hash of a window of a piece is sent the piece.
4. Automata.  A task compiles the pieces sent to a run of documents into Aho-Corasick automata of at most about
   ``SHARD_WINDOWS`` windows over word numbers, and streams the whole documents through each.  The automata alone say
   where a passage occurs: hashes only choose which pieces a document meets, and words are compared.
5. A window is repeated in a document if its owner is smaller; its words are covered.

Two different windows of one hash would hide one another (n windows: a chance of about n / 2**64 for each).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.reduce import split
from quantloom.llm.scratch import table
from quantloom.llm.words import Words, chunks, grams

WINDOW, ANCHOR = 13, 5
#: Windows of a passage in one piece, at most.
PIECE_WINDOWS = 48
#: Windows compiled into one automaton, about.
SHARD_WINDOWS = 50_000
#: An automaton reads a word's number as two symbols: it looks through a state's branches one by one, so few are better.
_BASE = 128
#: Stands for a null doc_id, which no owner is smaller than.
_NO_ID = -(1 << 63)
#: Bytes of documents streamed at once, unless one is longer.
RUN_BYTES = 4 << 20


def _anchors(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, document, first and last window) of each run of windows that share an anchor, in order."""
    g, at, bounds = grams(words, anchor)
    span = window - anchor + 1
    docs = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    n = len(g) - span + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return np.zeros(0, np.uint64), none, none, none
    least = g[:n].copy()
    for j in range(1, span):
        np.minimum(least, g[j : n + j], out=least)
    place = np.zeros(n, dtype=np.int64)
    for j in range(span - 1, -1, -1):
        place[g[j : n + j] == least] = j
    place += np.arange(n)
    whole = docs[:n] == docs[span - 1 :]  # windows inside one document
    index = np.flatnonzero(whole)
    if not len(index):
        return np.zeros(0, np.uint64), none, none, none
    place, doc = place[index], docs[index]
    begin = np.ones(len(index), dtype=bool)
    begin[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(begin)
    last = np.append(first[1:], len(index)) - 1
    start = at[index] - words.first[doc]  # word number in its document
    return g[place[first]], doc[first], start[first], start[last]


def _input(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("tk"), "text")


def _anchor_bounds(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0).to_numpy(zero_copy_only=False), 0
            for lo, hi, words in chunks(batch.column(2)):
                h, doc, _, _ = _anchors(words, window, anchor)
                if len(h):
                    owner = ids[lo:hi][doc]
                    order = np.argsort(h, kind="stable")
                    h, owner = h[order], owner[order]
                    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                    low, high = np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first)
                    yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(low), pa.array(high - low)], names=["h", "lo", "more"])

    out = rows.mapInArrow(run, "h long, lo long, more long")
    return out.groupBy("h").agg(F.min("lo").alias("lo"), F.max(F.col("lo") + F.col("more")).alias("hi")).where("lo < hi").select("h")


def _anchor_places(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in chunks(batch.column(2)):
                h, doc, _, _ = _anchors(words, window, anchor)
                if len(h):
                    ordinal = np.arange(len(h)) - np.searchsorted(doc, doc)
                    take = pa.array(doc + lo)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(ordinal.astype(np.int32))], names=["h", "doc_id", "tk", "o"]
                    )

    return rows.mapInArrow(run, "h long, doc_id long, tk long, o int")


def _windows(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """rows: doc_id, tk, text, os.  (wh, doc_id, tk) of each different window under one of the listed anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(3)
            for lo, hi, words in chunks(batch.column(2)):
                _, doc, first, last = _anchors(words, window, anchor)
                g, _, begin = grams(words, window)
                bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
                hashes, docs = [], []
                for d in range(hi - lo):
                    a, b = bounds[d], bounds[d + 1]
                    chosen = listed[lo + d].values.to_numpy(zero_copy_only=False)
                    edge = np.zeros(begin[d + 1] - begin[d] + 1, dtype=np.int32)
                    np.add.at(edge, first[a:b][chosen], 1)
                    np.add.at(edge, last[a:b][chosen] + 1, -1)
                    own = np.unique(g[begin[d] : begin[d + 1]][np.cumsum(edge[:-1]) > 0])
                    hashes.append(own)
                    docs.append(np.full(len(own), lo + d))
                if hashes:
                    take = pa.array(np.concatenate(docs))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), batch.column(0).take(take), batch.column(1).take(take)], names=["wh", "doc_id", "tk"])

    return rows.mapInArrow(run, "wh long, doc_id long, tk long")


def _pieces(rows: DataFrame, window: int) -> DataFrame:
    """rows: doc_id, text, owned (hashes of the windows that the document owns).  (owner, whs, passage) for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, owned = batch.column(0), batch.column(1), batch.column(2)
            for lo, hi, words in chunks(texts):
                g, _, begin = grams(words, window)
                owners, hashes, passages = [], [], []
                for d in range(hi - lo):
                    own = g[begin[d] : begin[d + 1]]
                    _, once = np.unique(own, return_index=True)
                    at = np.sort(once[np.isin(own[once], owned[lo + d].values.to_numpy(zero_copy_only=False).view(np.uint64))])
                    if not len(at):
                        continue
                    parts = texts[lo + d].as_py().encode("utf-8").split()  # splits at the ASCII white space that delimits words
                    for run_ in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                        for i in range(0, len(run_), PIECE_WINDOWS):
                            piece = run_[i : i + PIECE_WINDOWS]
                            owners.append(ids[lo + d].as_py())
                            hashes.append(own[piece].view(np.int64))
                            passages.append(b" ".join(parts[piece[0] : piece[-1] + window]))
                if owners:
                    yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(passages, pa.binary())], names=["owner", "whs", "passage"])

    return rows.mapInArrow(run, "owner long, whs array<long>, passage binary")


def _copies(rows: DataFrame) -> DataFrame:
    """(doc_id, tk) of rows whose whole text a smaller doc_id has too."""
    keys = rows.select("doc_id", "tk", F.xxhash64(F.lit(1), "text").alias("tk2"))
    owners = keys.groupBy("tk", "tk2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("tk", "tk2", "lo")
    owners = table(owners, "copy_owners")  # joined as a table, so that a hot text's rows can be split
    return table(keys.join(owners, ["tk", "tk2"]).where("doc_id > lo").select("doc_id", "tk").distinct(), "copies")


def _without(rows: DataFrame, copies: DataFrame) -> DataFrame:
    maybe, others = split(rows, ["doc_id", "tk"], copies)
    return others.union(maybe.join(copies, ["doc_id", "tk"], "left_anti").select(*rows.columns))


def passages_met(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, tk, whole, pieces): for each document the passages of smaller doc_ids (owner, passage) that it may hold.

    ``tk`` is xxhash64 of the text and tells rows apart that repeat a doc_id; those do not count as earlier for each
    other.  ``whole`` marks copies of an earlier text, whose pieces are null.  Null texts have no words; rows with a
    null doc_id are neither searched nor counted as earlier.
    """
    rows = _input(docs, doc_id, text).where("doc_id IS NOT NULL AND text IS NOT NULL")
    copies = _copies(rows)
    rows = _without(rows, copies)
    recurring = table(_anchor_bounds(rows, window, anchor), "recurring")
    places = _anchor_places(rows, window, anchor).join(recurring, "h", "left_semi")
    listed = table(places.groupBy("doc_id", "tk").agg(F.sort_array(F.collect_set("o")).alias("os")), "listed")
    maybe, _ = split(rows, ["doc_id", "tk"], listed)
    windows = table(_windows(maybe.join(listed, ["doc_id", "tk"]).select("doc_id", "tk", "text", "os"), window, anchor), "windows")
    confirmed = windows.groupBy("wh").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    owned = table(confirmed.groupBy(F.col("lo").alias("doc_id")).agg(F.collect_list("wh").alias("owned")), "owned")
    owners, _ = split(rows, ["doc_id"], owned)
    pieces = _pieces(owners.join(owned, "doc_id").select("doc_id", "text", "owned"), window)
    pieces = table(pieces.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    sent = windows.join(pieces.select("piece", "owner", F.explode("whs").alias("wh")), "wh").where("doc_id > owner").select("doc_id", "tk", "piece").distinct()
    sent = table(sent, "sent")
    met = sent.join(pieces.select("piece", "owner", "passage"), "piece").groupBy("doc_id", "tk").agg(F.collect_list(F.struct("owner", "passage")).alias("pieces"))
    whole = copies.select("doc_id", "tk", F.lit(True).alias("whole"), F.lit(None).cast("array<struct<owner:bigint,passage:binary>>").alias("pieces"))
    return table(met.select("doc_id", "tk", F.lit(False).alias("whole"), "pieces").union(whole), "met")


def _symbols(numbers: list[int]) -> tuple[int, ...]:
    """Two symbols for each word number; 0, for a word of no pattern, is a number like any other."""
    at = np.array(numbers, dtype=np.int64)
    return tuple(np.stack([at // _BASE + _BASE, at % _BASE], axis=1).ravel().tolist())


def _automata(pieces: dict[bytes, int], number: dict[bytes, int], window: int) -> Iterator:
    """Automata over the windows of the pieces, each pattern with its owner; ``number`` gets a number for each word."""
    import ahocorasick

    automaton, size = None, 0
    for passage, owner in pieces.items():
        codes = _symbols([number.setdefault(w, len(number) + 1) for w in passage.split(b" ")])
        if automaton is None:
            automaton, size = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), 0
        for i in range(0, len(codes) - 2 * window + 2, 2):
            automaton.add_word(codes[i : i + 2 * window], owner)
        size += len(codes) // 2 - window + 1
        if size >= SHARD_WINDOWS:
            automaton.make_automaton()
            yield automaton
            automaton = None
    if automaton is not None:
        automaton.make_automaton()
        yield automaton


def located(ids: list[int], texts: list[list[bytes]], pieces: dict[bytes, int], window: int) -> list[np.ndarray]:
    """For each document the words at which a window of ``pieces`` with a smaller owner starts, found by automata."""
    if not pieces:
        return [np.zeros(0, np.int64)] * len(ids)
    number: dict[bytes, int] = {}
    shards = list(_automata(pieces, number, window))
    stream: list[int] = []  # all documents; 0, a number that no pattern has, ends each and stands for unknown words
    begin = [0]
    for words in texts:
        stream += [number.get(w, 0) for w in words]
        stream.append(0)
        begin.append(len(stream))
    codes, bounds, own = _symbols(stream), np.array(begin), np.array(ids, dtype=np.int64)
    places, docs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for automaton in shards:
        found = np.fromiter(chain.from_iterable(automaton.iter(codes)), dtype=np.int64).reshape(-1, 2)
        last = found[:, 0] // 2
        doc = np.searchsorted(bounds, last, side="right") - 1
        smaller = found[:, 1] < own[doc]
        docs.append(doc[smaller])
        places.append(last[smaller] - bounds[doc[smaller]] - window + 1)
    doc, place = np.concatenate(docs), np.concatenate(places)
    order = np.lexsort((place, doc))
    return np.split(place[order], np.searchsorted(doc[order], np.arange(1, len(ids))))


def _without_windows(words: list[bytes], starts: np.ndarray, window: int) -> list[bytes]:
    if not len(starts):
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return [w for w, n in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not n]


def _streamed(docs: DataFrame, doc_id: str, text: str, window: int, anchor: int, digest: bool) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, starts) of every row; kept words or their SHA-256."""
    met = passages_met(docs, doc_id, text, window, anchor)
    rows = _input(docs, doc_id, text)
    maybe, clean = split(rows, ["doc_id", "tk"], met)
    joined = maybe.join(met, ["doc_id", "tk"], "left").select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "pieces")
    joined = joined.union(clean.select("doc_id", "text", F.lit(False).alias("whole"), F.lit(None).cast(met.schema["pieces"].dataType).alias("pieces")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            starts = located([_NO_ID if i is None else i for i in ids], texts, pieces, window)
            starts = [np.arange(len(t) - window + 1) if w and len(t) >= window else s for t, w, s in zip(texts, copied, starts, strict=True)]
            kept = [_without_windows(t, s, window) for t, s in zip(texts, starts, strict=True)]
            joined_ = [b" ".join(k) for k in kept]
            out = [hashlib.sha256(k).hexdigest() for k in joined_] if digest else [k.decode("utf-8") for k in joined_]
            columns = [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(t) - len(k) for t, k in zip(texts, kept, strict=True)], pa.int64()), pa.array(out, pa.string()), pa.array(starts, pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept", "starts"])

        for batch in batches:
            ids, texts, copied, pieces, size = [], [], [], {}, 0
            for i, value, whole, sent in zip(*batch.columns, strict=True):
                data = (value.as_py() or "").encode("utf-8")
                ids.append(i.as_py())
                texts.append(data.split())
                copied.append(whole.as_py())
                if sent.is_valid:
                    at = sent.values
                    pieces.update(zip(at.field("passage").to_pylist(), at.field("owner").to_pylist(), strict=True))
                size += len(data)
                if size >= RUN_BYTES or len(pieces) * PIECE_WINDOWS >= SHARD_WINDOWS:
                    yield flush()
                    ids, texts, copied, pieces, size = [], [], [], {}, 0
            if ids:
                yield flush()

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, starts array<int>")


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, starts) of the rows with repeated windows: the words, from 0, at which one starts.

    A window of ``window`` words is repeated if its words also make a window of a document with a smaller doc_id.
    """
    return _streamed(docs, doc_id, text, window, anchor, True).select("doc_id", "starts").where(F.size("starts") > 0)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row: kept words joined by one space, or their SHA-256 with ``digest``.

    Null and empty texts have no words; rows with a null doc_id keep all words; repeated rows get equal results; an
    empty table gives none.  A very long text is one task's work and is streamed whole; other columns are not read,
    whatever their names.
    """
    return _streamed(docs, doc_id, text, window, ANCHOR, digest).select("doc_id", "n_words", "n_removed", "kept")


def query(spark, sf_dir: str) -> DataFrame:
    """Per document its words, how many of them go, and the digest of the rest; null texts have no words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_repeats(docs, digest=True)
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
r AS (SELECT rid, i FROM (SELECT rid, doc_id, i, min(doc_id) OVER (PARTITION BY g) AS lo FROM g) WHERE lo < doc_id),
c AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS p FROM r),
a AS (SELECT w.rid, w.doc_id, w.w, coalesce(list(c.p) FILTER (c.p IS NOT NULL), []) AS gone FROM w LEFT JOIN c USING (rid) GROUP BY w.rid, w.doc_id, w.w),
k AS (SELECT rid, string_agg(x, ' ' ORDER BY p) AS kept FROM (
        SELECT u.rid, u.p, u.x FROM (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w) u LEFT JOIN c USING (rid, p) WHERE c.rid IS NULL) GROUP BY rid)
SELECT a.doc_id, len(a.w)::BIGINT AS n_words, len(a.gone)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM a LEFT JOIN k USING (rid)
"""
