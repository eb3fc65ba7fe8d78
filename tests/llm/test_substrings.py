import hashlib
import random
import re

from quantloom.llm import substrings


def _brute(rows, n=13):
    """(words, removed, kept text) of each row; a window counts if a smaller doc_id has it."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (d, t), w in zip(rows, words, strict=True):
        if d is not None:
            for i in range(len(w) - n + 1):
                key = tuple(w[i : i + n])
                first[key] = min(d, first.get(key, d))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {p for i in range(len(w) - n + 1) if d is not None and first[tuple(w[i : i + n])] < d for p in range(i, i + n)}
        out.append((len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def _rows():
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "of", "é漢", "#", "and"]) if rng.random() < 0.5 else "".join(rng.choice("abcdef") for _ in range(4))
    shared = [[word() for _ in range(rng.choice([12, 13, 14, 30, 80]))] for _ in range(12)]
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "x " * 200), (1004, "x " * 199 + "y"), (1005, "a b c")]
    for d in range(90):
        parts = []
        for _ in range(rng.randrange(0, 6)):
            parts += rng.choice(shared) if rng.random() < 0.8 else [word() for _ in range(rng.randrange(1, 40))]
        rows.append((d, "".join(w + rng.choice([" ", "\n", "\t", "  ", "  "]) for w in parts)))
    rows += [(500 + d, rows[d][1]) for d in (20, 40, 40, 41)] + [(600, "a b c")]  # whole copies
    rows = list(dict(rows).items())
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark, monkeypatch):
    rows = _rows()
    docs = spark.createDataFrame([(d, t, "h", 1) for d, t in rows], "doc_id long, text string, h string, starts int")
    want = {d: x for (d, _), x in zip(rows, _brute(rows), strict=True)}
    assert sum(x[1] > 0 for x in want.values()) > 20
    for piece, shard in ((substrings.PIECE_WINDOWS, substrings.SHARD_WINDOWS), (5, 7)):
        monkeypatch.setattr(substrings, "PIECE_WINDOWS", piece)
        monkeypatch.setattr(substrings, "SHARD_WINDOWS", shard)
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs).collect()} == want
    digests = {r.doc_id: r.kept for r in substrings.remove_repeats(docs, digest=True).collect()}
    assert digests == {d: hashlib.sha256(x[2].encode()).hexdigest() for d, x in want.items()}


def test_repeated_ids_nulls_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(None, text), (4, text), (4, text), (4, "before " + text), (9, text), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_removed) for r in substrings.remove_repeats(docs).collect())
    assert got == [(0, 0), (2, 0), (4, 0), (4, 0), (4, 0), (9, 20)]
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_automata_locate():
    """Only what the automata find counts: a document that is sent other passages keeps its words."""
    words = [f"w{i}".encode() for i in range(40)]
    piece = b" ".join(words[5:25])
    found = substrings.located([7, 3, 9, 8], [words, words, [b"x", *words[6:20]], [b"y"] * 30], {piece: 5}, 13)
    assert [x.tolist() for x in found] == [list(range(5, 13)), [], [1, 2], []]
    assert [x.tolist() for x in substrings.located([7], [words], {}, 13)] == [[]]
    long = [b"a"] * 200_000 + words
    assert substrings.located([7], [long], {piece: 5, b" ".join([b"a"] * 13): 6}, 13)[0].tolist()[-8:] == list(range(200_005, 200_013))
