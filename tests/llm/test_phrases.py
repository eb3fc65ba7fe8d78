import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quantloom.llm import phrases


def _brute(rows, longest, least, top):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    candidates = {x: n for x, n in f.items() if len(x[1]) > 1 and n >= least}
    out = {}
    for (lang, p), a in candidates.items():
        inside = [n for (g, q), n in candidates.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if not any(100 * n >= 50 * a for n in inside):
            score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(g, i): (p.decode(), -a, left, right, total[g], -s) for g, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top], 1)}


def _rows():
    rng = random.Random(11)
    words = ["the", "The", "of", "é", "É", "漢字", "a-b", "x\x00", "new", "york", "city", " ", "z" * 300, "(", "was"]
    phrases_ = ["New York City", "new york", "of the", "é 漢字 a-b", "the the the"]
    rows = []
    for _ in range(150):
        parts = [rng.choice(phrases_) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randrange(0, 40))]
        rows.append(("".join(p + rng.choice([" ", " ", " ", "  ", "\t", ".", ", ", "\n", "\r\n", "?!"]) for p in parts), rng.choice(["en", "en", "en", "de", None, "und", "", "a\nb"])))
    return [*rows, (None, "en"), ("", "en"), (" \n", None), ("lonely words", "fr"), rows[3], rows[3], ("new york " * 3000, "en")]


@pytest.mark.parametrize(("longest", "least", "top"), [(3, 10, 2000), (3, 3, 7), (4, 2, 2000), (2, 10, 2000)])
def test_equals_brute_force(spark, monkeypatch, longest, least, top):
    rows = _rows()
    docs = spark.createDataFrame([(t, g, 1, "p") for t, g in rows], "text string, lang string, n int, phrase string").repartition(3)
    want = _brute(rows, longest, least, top)
    for bits, size in ((28, 8 << 20), (16, 40)):
        monkeypatch.setattr(phrases, "MAX_BITS", bits)
        monkeypatch.setattr(phrases, "SLICE_BYTES", size)
        got = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(docs, words=longest, least=least, top=top).collect()}
        assert got == want


def test_levels_emit_only_phrases_of_frequent_parts(spark):
    docs = spark.createDataFrame([("a b c d. " * 10 + "a b x y z. b c", "en")], "text string, lang string")
    rows = docs.select("lang", "text")
    _, found = phrases.levels(docs)
    bits = spark.sparkContext.broadcast(phrases.bit_table(found[0], 1))
    pairs = {r.phrase: r.n for r in phrases._added(phrases._counted(rows, 2, bits)).collect()}
    assert pairs == {"a b": 11, "b c": 11, "c d": 10}  # x, y and z are rare
    bits = spark.sparkContext.broadcast(phrases.bit_table(found[1], 2))
    assert {r.phrase: r.n for r in phrases._added(phrases._counted(rows, 3, bits)).collect()} == {"a b c": 10, "b c d": 10}


def test_scores_past_64_bits(spark):
    level = lambda rows: spark.createDataFrame(rows, "lang string, phrase string, n long")
    big = 9 * 10**13
    words, pairs = level([("en", "a", big + 7), ("en", "b", big + 1)]), level([("en", "a b", big)])
    (row,) = phrases._scored(pairs, 2, [words, pairs]).collect()
    assert (row.l, row.r, row.score) == (big + 7, big + 1, 10**6 * big * big // ((big + 7) * (big + 1)))


def test_hash_is_sparks(spark):
    rows = [("en", "a b"), ("", ""), ("und", "漢字 é"), ("de", "x" * 100)]
    got = [r.h for r in spark.createDataFrame(rows, "lang string, phrase string").select(F.xxhash64("lang", "phrase").alias("h")).collect()]
    assert [h % 2**64 for h in got] == [phrases._hash(a, b) for a, b in rows]


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
