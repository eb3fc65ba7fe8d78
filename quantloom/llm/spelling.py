"""Spelling variants: words of edit distance one, found by automata over broadcast trie shards.

1. Words are counted: a task counts its own runs of letters, then one shuffle of (word, count) adds them up.
2. The vocabulary, ordered by length and word, is cut into shards of at most ``SHARD_WORDS`` words.  A shard is a compact
   trie: a byte and two numbers for each node, nodes of one parent side by side.
3. Shards are broadcast in blocks of at most ``BLOCK_BYTES``.  Under each block every word that fits its lengths is
   intersected depth-first, as a Levenshtein automaton of distance one, with every shard: the walk leaves the path of the
   word itself by one edit at most, and follows only edges that the trie has.
4. A block gives one row per word: near words counted, the best of them.  Blocks are added up.
5. Forms are followed to the last by doubling pointers: counts grow fivefold at each step, which bounds the rounds.

Work is words times shards of fitting length; each block is one pass over the vocabulary, not over the documents.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.scratch import table
from quantloom.llm.slices import lowered, slices, spans, strings

LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form is this many times as frequent as its variant.
RATIO = 5
#: A run loses a code point if this divides the checksum of its document and text.
NOISE = 199
#: Words of one trie shard, at most.
SHARD_WORDS = 100_000
#: Bytes of the shards broadcast together, unless a single one is larger.
BLOCK_BYTES = 64 << 20
#: Words intersected in one task, about.
TASK_WORDS = 4_000
#: Checksums of longer runs are taken one by one.
_LONG = 48

_LETTER = re.compile("[A-Za-zÀ-ÿ]")
_ASCII = np.array([i < 128 and bool(_LETTER.match(chr(i))) for i in range(256)])
_SAFE = np.array([i < 128 for i in range(256)]) & ~_ASCII
_LEAD = 0xC3  # the first of the two UTF-8 bytes of U+00C0 to U+00FF, and of no other character
_CRC = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], dtype=np.uint32)


def _extended(sums: np.ndarray, most: int) -> np.ndarray:
    """What a CRC-32 contributes once 0 to ``most`` more bytes follow: crc(a + b) = this of crc(a) at len(b), xor crc(b)."""
    out = np.empty((most + 1, len(sums)), dtype=np.uint32)
    out[0] = sums
    for i in range(most):
        out[i + 1] = (out[i] >> np.uint32(8)) ^ _CRC[out[i] & np.uint32(255)]
    return out


def _counted(rows: DataFrame, least: int, noise: int | None) -> DataFrame:
    """rows: doc_id, text.  (word, n), added up within slices only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = ["" if i is None else str(i) for i in batch.column(0).to_pylist()]
            prefixes = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], dtype=np.uint32)
            for first, raw, bounds in slices(batch.column(1), _SAFE):
                lead = raw == _LEAD
                inside = _ASCII[raw] | lead
                inside[1:] |= lead[:-1]
                starts, ends = spans(inside, bounds)
                doubled = np.concatenate(([0], np.cumsum(lead)))
                points = ends - starts - (doubled[ends] - doubled[starts])
                chosen = points >= least
                starts, ends, points = starts[chosen], ends[chosen], points[chosen]
                if not len(starts):
                    continue
                runs = strings(lowered(raw), starts, ends).dictionary_encode()
                codes, words = runs.indices.to_numpy(), runs.dictionary
                total = np.bincount(codes, minlength=len(words))
                more: Counter = Counter()
                if noise:
                    doc, length = first + np.searchsorted(bounds, starts, side="right") - 1, ends - starts
                    own = np.array([zlib.crc32(w) for w in words.cast(pa.large_binary()).to_pylist()], dtype=np.uint32)
                    sums = _extended(prefixes[first : first + len(bounds)], _LONG)[np.minimum(length, _LONG), doc - first] ^ own[codes]
                    for i in np.flatnonzero(length > _LONG):
                        sums[i] = zlib.crc32(words[codes[i]].as_py().encode(), int(prefixes[doc[i]]))
                    for i in np.flatnonzero(sums % np.uint32(noise) == 0):
                        total[codes[i]] -= 1
                        at = int(sums[i]) % int(points[i])
                        if points[i] > least:
                            word = words[codes[i]].as_py()
                            more[word[:at] + word[at + 1 :]] += 1
                used = np.flatnonzero(total)
                both = [pa.concat_arrays([words.take(pa.array(used)).cast(pa.string()), pa.array(list(more), pa.string())]), pa.array(np.concatenate([total[used], np.fromiter(more.values(), np.int64, len(more))]))]
                yield pa.RecordBatch.from_arrays(both, names=["word", "n"])

    return rows.mapInArrow(run, "word string, n long")


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", noise: int | None = None) -> DataFrame:
    """(word, n): the lower-cased (A to Z) runs of letters of all texts, long and frequent enough.

    With ``noise`` = k, a run loses one code point where k divides the CRC-32 of "<doc_id>:<lower-cased run>".
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return _counted(rows, LEAST_LENGTH, noise).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Trie:
    """A compact trie over sorted Latin-1 words: children of a node are neighbours, so an edge is found by ``bytes.find``."""

    def __init__(self, labels: bytes, child: list[int], word: list[int]):
        self.labels, self.child, self.word = labels, child, word  # child[i] to child[i + 1]: the children of node i

    @classmethod
    def build(cls, words: list[bytes]) -> Trie:
        """Level by level over the sorted words; a node is a range of words with one prefix."""
        labels, child, ends = bytearray(1), [], []
        level, depth = [(0, len(words))], 0
        while level:
            below: list[tuple[int, int]] = []
            for lo, hi in level:
                at = lo
                ends.append(-1)
                if at < hi and len(words[at]) == depth:
                    ends[-1] = at
                    at += 1
                child.append(len(labels))
                while at < hi:
                    label, begin = words[at][depth], at
                    while at < hi and words[at][depth] == label:
                        at += 1
                    labels.append(label)
                    below.append((begin, at))
            level, depth = below, depth + 1
        child.append(len(labels))
        return cls(bytes(labels), child, ends)

    def _walk(self, node: int, word: bytes, i: int) -> int:
        """The number of the word that ends where ``word[i:]`` leads to from ``node``, or -1."""
        labels, child = self.labels, self.child
        for j in range(i, len(word)):
            node = labels.find(word[j : j + 1], child[node], child[node + 1])
            if node < 0:
                return -1
        return self.word[node]

    def near(self, word: bytes, longer: bool = True, same: bool = True, shorter: bool = True) -> set[int]:
        """Numbers of all words at edit distance one, of the lengths asked for.

        Depth-first along the word's own path; at each node the automaton's one edit is tried on each edge there is.
        """
        labels, child, walk = self.labels, self.child, self._walk
        out, node = set(), 0
        for i in range(len(word) + 1):
            lo, hi = child[node], child[node + 1]
            if shorter and i < len(word):
                out.add(walk(node, word, i + 1))
            if longer or same:
                own = word[i] if i < len(word) else -1
                for at in range(lo, hi):
                    if longer:
                        out.add(walk(at, word, i))
                    if same and own >= 0 and labels[at] != own:
                        out.add(walk(at, word, i + 1))
            if i < len(word):
                node = labels.find(word[i : i + 1], lo, hi)
                if node < 0:
                    break
        out.discard(-1)
        return out


def trie_shards(words: DataFrame) -> DataFrame:
    """(shard, least, most, size, blob) over (word, n): the lengths in a shard, its bytes, and its words with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(held: pa.Table) -> pa.RecordBatch:
            blob = pa.BufferOutputStream()
            with pa.ipc.new_stream(blob, held.schema) as sink:
                sink.write_table(held)
            lengths = pc.utf8_length(held["word"])
            value = blob.getvalue().to_pybytes()
            columns = [pa.array([pc.min(lengths).as_py()], pa.int32()), pa.array([pc.max(lengths).as_py()], pa.int32()), pa.array([len(value)], pa.int64()), pa.array([value], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["least", "most", "size", "blob"])

        held = None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            while len(held) >= SHARD_WORDS:
                yield made(held.slice(0, SHARD_WORDS).combine_chunks())
                held = held.slice(SHARD_WORDS)
        if held is not None and len(held):
            yield made(held.combine_chunks())

    parts = max(1, math.ceil(words.count() / SHARD_WORDS))
    placed = words.select("word", "n", F.length("word").alias("_l")).repartitionByRange(parts, "_l", "word").sortWithinPartitions("_l", "word")
    return placed.select("word", "n").mapInArrow(run, "least int, most int, size long, blob binary").withColumn("shard", F.monotonically_increasing_id())


def _loaded(blob: bytes) -> tuple[Trie, list[bytes], list[int]]:
    held = pa.ipc.open_stream(blob).read_all()
    both = sorted(zip((w.encode("latin-1") for w in held["word"].to_pylist()), held["n"].to_pylist(), strict=True))
    words = [w for w, _ in both]
    return Trie.build(words), words, [n for _, n in both]


def _met(words: DataFrame, block) -> DataFrame:
    """(word, n_near, best): what each word is near to in a broadcast block of (least, most, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = [(least, most, *_loaded(blob)) for least, most, blob in block.value]
        for batch in batches:
            found = []
            for word in batch.column(0).to_pylist():
                key, count, best = word.encode("latin-1"), 0, None
                for least, most, trie, names, ns in tries:
                    fits = [least <= len(key) + d <= most for d in (1, 0, -1)]
                    if any(fits):
                        near = trie.near(key, *fits)
                        count += len(near)
                        for i in near:
                            if best is None or (-ns[i], names[i]) < best:
                                best = (-ns[i], names[i])
                if count:
                    found.append((word, count, -best[0], best[1].decode("latin-1")))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "best_n", "best"])

    return words.select("word").mapInArrow(run, "word string, n_near long, best_n long, best string")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) for each of (word, n) that has a word at distance one; the best is the most frequent
    and, of these, the smallest by code points."""
    spark = words.sparkSession
    shards = table(trie_shards(words), "tries")
    dealt = table(words.repartition(max(spark.sparkContext.defaultParallelism, math.ceil(words.count() / TASK_WORDS)), "word"), "dealt")
    heads, blocks, held = shards.select("shard", "least", "most", "size").orderBy("least", "shard").collect(), [], 0  # a row for each SHARD_WORDS words
    for head in heads:
        if not blocks or held + head.size > BLOCK_BYTES:
            blocks, held = [*blocks, []], 0
        blocks[-1].append(head)
        held += head.size
    found = None
    for block in blocks:
        loaded = shards.where(F.col("shard").isin([h.shard for h in block])).select("least", "most", "blob").collect()
        sent = spark.sparkContext.broadcast([(r.least, r.most, bytes(r.blob)) for r in loaded])
        fitting = dealt.where(F.length("word").between(min(h.least for h in block) - 1, max(h.most for h in block) + 1))
        one = table(_met(fitting, sent), "near")
        sent.destroy()
        found = one if found is None else found.union(one)
    if found is None:
        found = spark.createDataFrame([], "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("top")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("top.word").alias("best"), (-F.col("top.n")).alias("best_n"))


def _roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) for each (word, form): forms followed ``steps`` times at least."""
    out = table(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(math.ceil(math.log2(max(1, steps)))):
        on = out.select(F.col("word").alias("root"), F.col("root").alias("next"))
        out = table(out.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return out


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", noise: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``vocabulary``.

    The form is the near word of largest n, the smallest of equal ones, if it is ``RATIO`` times as frequent as the
    word; the root follows forms to the last one.  Null and empty texts have no words; a null doc_id is an empty one in
    the checksum; repeated rows count again; an empty table has no words; a very long text is read in slices; other
    columns are not read, whatever their names.
    """
    words = table(vocabulary(docs, doc_id, text, noise), "vocabulary")
    near = table(words.join(neighbours(words), "word", "left"), "near_words")
    form = F.when(F.col("best_n") >= RATIO * F.col("n"), F.col("best"))
    near = near.withColumn("form", form)
    most = words.agg(F.max("n")).first()[0] or 1
    roots = _roots(near.where("form IS NOT NULL"), math.ceil(math.log(max(RATIO, most), RATIO)))
    out = near.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n"))


def query(spark, sf_dir: str) -> DataFrame:
    """Words of all documents, some with a letter dropped, with their forms; the cases are those of ``variants``."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"), noise=NOISE)


#: Remainders of the sixteen half bytes by the CRC-32 polynomial.
_HALVES = ", ".join(str(reduce(lambda c, _: c >> 1 ^ 0xEDB88320 * (c & 1), range(4), i)) for i in range(16))

SQL = rf"""
WITH RECURSIVE
runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents),
low AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n FROM runs WHERE length(r) >= {LEAST_LENGTH} GROUP BY ALL),
hexed AS (SELECT r, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)) AS x FROM low),
halves AS (SELECT r, n, list_transform(range(length(x)), lambda i: (instr('0123456789ABCDEF', substr(x, (i + CASE WHEN i % 2 = 0 THEN 2 ELSE 0 END)::INT, 1)) - 1)::BIGINT) AS x FROM hexed),
sums AS (SELECT r, n, xor(4294967295, list_reduce([4294967295::BIGINT] || x, lambda c, b: xor(c >> 4, [{_HALVES}][((xor(c, b)) & 15) + 1]::BIGINT))) AS h FROM halves),
noisy AS (SELECT CASE WHEN h % {NOISE} = 0 THEN substr(r, 1, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, n FROM sums),
v AS (SELECT word, sum(n)::BIGINT AS n FROM noisy WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
d AS (SELECT word, n, p, substr(word, 1, (p - 1)::INT) || substr(word, (p + 1)::INT) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v)),
near AS (SELECT a.word, b.word AS other, b.n FROM d a JOIN d b ON a.d = b.d AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM d a JOIN v b ON a.d = b.word UNION SELECT b.word, a.word, a.n FROM d a JOIN v b ON a.d = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS top FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {RATIO} * v.n THEN other END AS form, CASE WHEN top >= {RATIO} * v.n THEN top END AS form_n FROM v LEFT JOIN best USING (word)),
follow AS (SELECT word, word AS root FROM f UNION ALL SELECT follow.word, f.form FROM follow JOIN f ON f.word = follow.root WHERE f.form IS NOT NULL),
last AS (SELECT follow.word, root FROM follow JOIN f ON f.word = root WHERE f.form IS NULL)
SELECT f.word, f.form, last.root, f.n, f.n_near, f.form_n FROM f JOIN last USING (word)
"""
