"""Phrase collocations: level-wise counts, each level pruned by the one before, cuts scored from the level tables.

1. Level 1 counts words per language.  A task counts the words of its own slices; one shuffle of (lang, phrase, count)
   adds them up, and what is frequent makes the level's table.
2. Level k reads the texts again.  The frequent phrases of k - 1 words are broadcast as a bit table of bounded size, and
   a phrase of k words is emitted only where both of the phrases of k - 1 words in it are frequent.  A phrase is at most
   as frequent as its parts, so none is lost; a bit that two phrases share only lets more through to the exact count.
3. A candidate's cuts are joined with the level tables, where all parts of a frequent phrase are.
4. A candidate of fewer words goes if a longer one that holds it is frequent enough; the best of each language are
   ranked in ``SALTS`` parts first, so that no language's candidates meet in one task.

Counts are by the words themselves: hashes only choose bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.scratch import table
from quantloom.llm.slices import lowered, slices, spans, strings

LEAST, WORDS, TOP = 10, 3, 2000
#: A phrase goes if a longer one around it has at least this share of its occurrences, in hundredths.
COVERED = 50
#: Bits broadcast for the frequent phrases of a level: eight for each, 2**MAX_BITS at most (32 MB); past that more
#: phrases are counted, and none is lost.
MAX_BITS = 28
#: Bytes of text counted at once; a task holds some thirty times as much.
SLICE_BYTES = 2 << 20
#: Parts in which a language's candidates are ranked first.
SALTS = 64

#: A counted phrase: its words, a line break (no phrase has one), its language; one column keeps the counting maps small.
_ROW = "key string, n long"
_BREAK = np.array([i in b".,;:!?\n\x0b\x0c\r" for i in range(256)])
_GAP = np.array([i in b" \t" for i in range(256)])
_BLOCK = 16  # a row of the bit table has 2**16 bits


def _hash(lang: str, word: str) -> int:
    """What ``F.xxhash64(lang, word)`` gives, without sign."""
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang, 42))


def _turned(h: np.ndarray, i: int) -> np.ndarray:
    return h if not i else (h << np.uint64(7 * i)) | (h >> np.uint64(64 - 7 * i))


def bit_table(level: DataFrame, words: int) -> np.ndarray:
    """The bits of phrases of so many words as one array of bytes, whose length is a power of two up to the bound.

    A phrase's bit comes from the hashes of its words, each turned by its place.
    """
    bits = min(MAX_BITS, max(_BLOCK, math.ceil(math.log2(8 * max(1, level.count())))))
    part = F.split("phrase", " ")
    turned = [F.xxhash64("lang", part[i]) for i in range(words)]
    turned = [h if not i else F.shiftleft(h, 7 * i).bitwiseOR(F.shiftrightunsigned(h, 64 - 7 * i)) for i, h in enumerate(turned)]
    spots = level.select(reduce(lambda a, b: a.bitwiseXOR(b), turned).bitwiseAND(F.lit((1 << bits) - 1)).alias("spot"))

    def packed(held: pd.DataFrame) -> pd.DataFrame:
        marks = np.zeros(1 << _BLOCK, dtype=bool)
        marks[held["spot"].to_numpy() & ((1 << _BLOCK) - 1)] = True
        return pd.DataFrame({"block": [held["spot"].iloc[0] >> _BLOCK], "marks": [np.packbits(marks, bitorder="little").tobytes()]})

    rows = spots.distinct().groupBy(F.shiftright("spot", _BLOCK).alias("block")).applyInPandas(packed, "block long, marks binary").collect()
    out = np.zeros((1 << bits - _BLOCK, (1 << _BLOCK) // 8), dtype=np.uint8)
    for row in rows:
        out[row.block] = np.frombuffer(row.marks, np.uint8)
    return out.ravel()


def _known(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    spots = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[spots >> np.uint64(3)] >> (spots & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a number from 0 for each key, the different keys by number)."""
    coded = pa.array(keys).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy()


def _counted(rows: DataFrame, k: int, bits) -> DataFrame:
    """rows: lang, text.  ``_ROW`` for the phrases of ``k`` words of each slice, added up within it only."""

    def of_slice(langs: list[str], doc_lang: np.ndarray, raw: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch | None:
        broken = _BREAK[raw]
        starts, ends = spans(~(broken | _GAP[raw]), bounds)
        if len(starts) < k:
            return None
        doc = np.searchsorted(bounds, starts, side="right") - 1
        # Words of one piece share a number: breaks before them, and one more for each document.
        piece = np.cumsum(broken, dtype=np.int32)[starts] + doc.astype(np.int32)
        coded = strings(lowered(raw), starts, ends).dictionary_encode()
        del broken, starts, ends
        words, size = coded.dictionary, len(coded.dictionary)
        keys, named = _numbered(doc_lang[doc] * size + coded.indices.to_numpy())  # a word of a language has one number
        lang, code = named // size, named % size
        at = np.arange(len(keys))
        if k > 1:
            hashes = np.fromiter((_hash(langs[g], w) for g, w in zip(lang.tolist(), words.take(pa.array(code)).to_pylist(), strict=True)), np.uint64, len(code))
            grams = reduce(np.bitwise_xor, (_turned(hashes[keys[i : len(keys) - k + 2 + i]], i) for i in range(k - 1)))
            known = _known(bits.value, grams)  # of the k - 1 words from each one on
            at = np.flatnonzero(known[:-1] & known[1:] & (piece[: len(keys) - k + 1] == piece[k - 1 :]))
            if not len(at):
                return None
        # A phrase's number comes from that of its first words and its last one.
        number, ways = keys[at], []
        for i in range(1, k):
            number, pairs = _numbered(number * len(code) + keys[at + i])
            ways.append(pairs)
        counts = np.bincount(number) if k > 1 else np.bincount(keys, minlength=len(code))
        parts, first = [], np.arange(len(counts))
        for pairs in reversed(ways):
            first, last = pairs[first] // len(code), pairs[first] % len(code)
            parts.append(last)
        parts = [words.take(pa.array(code[p])) for p in (first, *reversed(parts))]
        phrases = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
        tongue = pa.DictionaryArray.from_arrays(pa.array(lang[first].astype(np.int32)), pa.array(langs, pa.string())).cast(pa.string())
        keyed = pc.binary_join_element_wise(phrases.cast(pa.string()), tongue, "\n")
        return pa.RecordBatch.from_arrays([keyed, pa.array(counts)], names=["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            langs, doc_lang = names.dictionary.to_pylist(), names.indices.to_numpy().astype(np.int64)
            for first, raw, bounds in slices(batch.column(1), _BREAK, SLICE_BYTES):
                out = of_slice(langs, doc_lang[first:], raw, bounds)
                if out is not None:
                    yield out

    return rows.mapInArrow(run, _ROW)


def _added(counted: DataFrame, least: int = 0) -> DataFrame:
    """(lang, phrase, n): the counts of all slices, those of ``least`` or more."""
    out = counted.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    phrase = F.substring_index("key", "\n", 1)
    return out.select(F.substring("key", F.length(phrase) + 2, F.length("key")).alias("lang"), phrase.alias("phrase"), "n")


def levels(docs: DataFrame, text: str = "text", lang: str = "lang", words: int = WORDS, least: int = LEAST) -> tuple[DataFrame, list[DataFrame]]:
    """((lang, n) of all words, the level tables): (lang, phrase, n) of the phrases of 1, 2, ... words found ``least`` times or more."""
    rows = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    first = table(_added(_counted(rows, 1, None)), "words")
    total = table(first.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    found = [table(first.where(F.col("n") >= least), "level")]
    for k in range(2, words + 1):
        bits = docs.sparkSession.sparkContext.broadcast(bit_table(found[-1], k - 1))
        found.append(table(_added(_counted(rows, k, bits), least), "level"))
        bits.destroy()
    return total, found


def _part(start: int, count: int) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), start, count), " ")


def _scored(level: DataFrame, k: int, found: list[DataFrame]) -> DataFrame:
    """(lang, phrase, a, l, r, score) for a level's phrases: the cut of the lowest score, the first of equal ones."""
    out = level.select("lang", "phrase", F.col("n").alias("a"))
    cuts = []
    for j in range(1, k):
        for side, of, part in ((f"l{j}", found[j - 1], _part(1, j)), (f"r{j}", found[k - j - 1], _part(j + 1, k - j))):
            out = out.withColumn("_part", part).join(of.select("lang", F.col("phrase").alias("_part"), F.col("n").alias(side)), ["lang", "_part"]).drop("_part")
        score = F.expr(f"(cast(1000000 AS decimal(7,0)) * (cast(a AS decimal(15,0)) * cast(a AS decimal(15,0)))) DIV (cast(l{j} AS decimal(18,0)) * cast(r{j} AS decimal(18,0)))")
        cuts.append(F.struct(score.alias("score"), F.lit(j).alias("k"), F.col(f"l{j}").alias("l"), F.col(f"r{j}").alias("r")))
    out = out.withColumn("cut", F.least(*cuts) if len(cuts) > 1 else cuts[0])
    return out.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _covered(found: list[DataFrame], k: int) -> DataFrame:
    """(lang, phrase, top): the most occurrences of a longer candidate that holds a phrase of ``k`` words."""
    held = [
        found[j - 1].select("lang", F.explode(F.array_distinct(F.array(*(_part(i, k) for i in range(1, j - k + 2))))).alias("phrase"), "n") for j in range(k + 1, len(found) + 1)
    ]
    return reduce(DataFrame.union, held).groupBy("lang", "phrase").agg(F.max("n").alias("top"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", words: int = WORDS, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``words`` words.

    Null languages are ``und``; null and empty texts have no words; repeated rows count again; ties are ranked by
    occurrences, then by the phrase's bytes; an empty table gives none; a very long text is read in slices that end at
    breaks; other columns are not read, whatever their names.
    """
    total, found = levels(docs, text, lang, words, least)
    chosen = []
    for k in range(2, words + 1):
        scored = _scored(found[k - 1], k, found)
        if k < words:
            scored = scored.join(_covered(found, k), ["lang", "phrase"], "left").where(f"top IS NULL OR 100 * top < {COVERED} * a").drop("top")
        chosen.append(scored)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    out = reduce(DataFrame.union, chosen).withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= top)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return out.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """Each language's best 2000 phrases of two or three words; the cases are those of ``collocations``."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
WITH p AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS n FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3)) AS x(k) WHERE len(w) >= k)) GROUP BY ALL),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, n AS a FROM f WHERE k > 1 AND n >= {LEAST}),
x AS MATERIALIZED (SELECT lang, k, phrase, a, j, array_to_string(w[1:j], ' ') AS lp, array_to_string(w[j + 1:k], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
cut AS (SELECT x.lang, x.k, x.phrase, x.a, j, l.n AS l, r.n AS r, ((1000000::HUGEINT * x.a * x.a) // (l.n::HUGEINT * r.n))::BIGINT AS score
        FROM x JOIN f l ON l.lang = x.lang AND l.phrase = lp JOIN f r ON r.lang = x.lang AND r.phrase = rp),
s AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase, k ORDER BY score, j) = 1),
h AS (SELECT lang, phrase, max(a) AS top FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
o AS (SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, score
      FROM s LEFT JOIN h ON h.lang = s.lang AND h.phrase = s.phrase AND s.k = 2 WHERE top IS NULL OR 100 * top < {COVERED} * a)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) WHERE rank <= {TOP}
"""
