import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from quantloom.llm import slices, spelling


def _near(a, b):
    """Edit distance one, by the definition."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _words(rows, noise):
    out = Counter()
    for d, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(c.lower() if c.isascii() else c for c in r)
            h = zlib.crc32(f"{'' if d is None else d}:{r}".encode())
            if noise and h % noise == 0:
                at = h % len(r)
                r = r[:at] + r[at + 1 :]
            out[r] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def _brute(rows, noise):
    words = _words(rows, noise)
    near = {w: sorted((-n, x) for x, n in words.items() if _near(w, x)) for w in words}
    form = {w: x[0][1] if x and -x[0][0] >= 5 * words[w] else None for w, x in near.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def _rows():
    rng = random.Random(12)
    letters = "abcdeéß×ÿÀ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 9))) for _ in range(30)]
    words += [w[:i] + rng.choice(letters) * rng.randrange(2) + w[i + 1 :] for w in words for i in (0, 3, len(w) - 1)]
    words += ["Straße", "STRAßE", "aaaaaaa", "aaaaaa", "aaaaaaaa", "x" * 70, "x" * 71, "ab" * 40]
    weights = [rng.choice([1, 1, 1, 6, 40, 300]) for _ in words]
    rows = [(d, "".join(w + rng.choice([" ", "-", "1", "漢", "\n", "’"]) for w in rng.choices(words, weights, k=200))) for d in range(70)]
    rows += [(900, "chainabc " * 6 + "chainabd " * 40 + "chainaed " * 300)]
    return [*rows, (None, "abcdef " * 9), (None, None), (1, None), (2, ""), (3, rows[3][1]), (3, rows[3][1])]


@pytest.mark.parametrize("noise", [None, 199, 3])
def test_equals_brute_force(spark, monkeypatch, noise):
    rows = _rows()
    docs = spark.createDataFrame([(d, t, 1, "w") for d, t in rows], "doc_id long, text string, n int, word string").repartition(4)
    want = _brute(rows, noise)
    assert sum(x[0] is not None for x in want.values()) > 4 and any(x[0] and x[1] != x[0] for x in want.values())
    for shard, block, size in ((100_000, 64 << 20, 8 << 20), (7, 2000, 500)):
        monkeypatch.setattr(spelling, "SHARD_WORDS", shard)
        monkeypatch.setattr(spelling, "BLOCK_BYTES", block)
        monkeypatch.setattr(slices.slices, "__defaults__", (size,))
        got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs, noise=noise).collect()}
        assert got == want


def test_automaton_finds_all_and_only_words_at_distance_one():
    rng = random.Random(5)
    words = sorted({bytes(rng.choice(b"abc\xe9") for _ in range(rng.randrange(0, 7))) for _ in range(900)})
    trie = spelling.Trie.build(words)
    for w in [*rng.sample(words, 150), b"abcabcabc", b"\xff"]:
        assert {words[i] for i in trie.near(w)} == {x for x in words if _near(w, x)}
        assert {words[i] for i in trie.near(w, longer=False, shorter=False)} == {x for x in words if _near(w, x) and len(x) == len(w)}
    assert spelling.Trie.build([]).near(b"abc") == set()


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_slices_cut_long_texts_at_safe_bytes_only():
    column = pa.array(["abc def ghi", None, "", "jkl", "mno pqr"] * 20)
    seen = []
    for first, data, bounds in slices.slices(column, spelling._SAFE, 6):
        starts, ends = slices.spans(spelling._ASCII[data], bounds)
        seen += slices.strings(data, starts, ends).to_pylist()
        assert bounds[0] == 0 and bounds[-1] == len(data) and first + len(bounds) - 1 <= len(column)
    assert seen == ["abc", "def", "ghi", "jkl", "mno", "pqr"] * 20
