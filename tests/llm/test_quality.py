import random
import re

import pytest

from quantloom.llm import quality


def _brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
    full = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, repeated = len(words), len(covered)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), repeated, n < 50 or 100 * repeated > 50 * n)


def _texts():
    rng = random.Random(4)
    out = [None, "", " \n\t", "a", "a a a a", "a b c a b c", "x\ny\nx\n \n \nx ", "# $5 <b> | 100%", "é漢 z\u0085 \x1c😀 z", "w " * 60, "\r\n".join(["one two three"] * 30)]
    for _ in range(60):
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 140))]
        out.append("".join(w + rng.choice([" ", " ", " ", "\n", "\t ", "#"]) for w in words))
    return out


def test_counts_equal_brute_force(spark):
    texts = _texts()
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_words int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(docs, keep=["doc_id"]).select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
    for i, t in enumerate(texts):
        assert got[i] == _brute(t), repr(t)


def _good(i):
    return " ".join(f"word{i}x{j}" for j in range(60))


def test_hosts(spark):
    """A host that mostly fails takes its good documents with it; a small one is pulled to the mean; none for null."""
    rows = [(i, "short text", "bad") for i in range(30)] + [(100, _good(1), "bad")] + [(200 + i, _good(i), "good") for i in range(30)]
    rows += [(300, "short", "small"), (301, _good(9), "small"), (400, _good(3), None), (401, "x", None), (None, _good(4), "good"), (200, _good(0), "good")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = quality.judge(docs)
    kept = sorted((r.doc_id or 0) for r in out.where("kept").select("_row.doc_id").collect())
    assert kept == [0, *sorted([200, *range(200, 230)]), 301, 400]
    n, failed = 64 - 2, 31  # rows of hosts, and those that fail
    rates = {r.host: r.fail_rate for r in quality.host_verdicts(quality.rule_features(docs, "text", [docs.source]), "source").collect()}
    m, raw = failed / n + 0, [30 / 31, 0.0, 0.5]
    mean = sum(raw) / 3
    v = sum((x - mean) ** 2 for x in raw) / 2
    total = {"bad": (30, 31), "good": (0, 32), "small": (1, 2)}
    m = 31 / 65
    k = min(1000.0, max(1.0, m * (1 - m) / v - 1))
    for h, (f, c) in total.items():
        assert rates[h] == pytest.approx((f + m * k) / (c + k))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert quality.judge(docs).count() == 0


def test_very_long_texts_and_clashing_names(spark):
    long = " ".join(f"w{i}" for i in range(120_000))
    rows = [(1, long, "a", 7, False), (2, "# " * 100_000, "a", 8, True), (3, None, "b", 9, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, kept boolean")
    got = {r["_row"].doc_id: r for r in quality.judge(docs).collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[1].base_failed) == (120_000, 0, False)
    assert (got[2].n_words, got[2].n_symbols, got[2].n_repeat_words, got[2].base_failed) == (100_000, 100_000, 100_000, True)
    assert got[3].n_words == 0 and got[3].base_failed and [tuple(got[i]["_row"]) for i in (1, 2, 3)] == rows
