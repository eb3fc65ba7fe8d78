import random

import numpy as np

from quantloom.llm import contamination as C


def _words(text):
    return C.folded_words(text or "").tolist()


def _distance(window, item):
    row = list(range(len(window) + 1))
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(window, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def _brute(docs, items):
    out = {}
    for d, text in docs:
        w = _words(text)
        for i, t in items:
            item = _words(t)
            k = int(C.MAX_EDITS * len(item) + 1e-9)
            best = min((_distance(w[a : a + len(item) + k], item) for a in range(len(w))), default=99) if item else 99
            if item and best <= k:
                out[d, i] = best
    return out


def _data():
    rng = random.Random(11)
    common = ["the", "of", "and", "to"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rng.choice([12, 20, 33, 50])))) for i in range(12)]
    docs = []
    for d in range(60):
        body = [word() for _ in range(rng.randrange(5, 120))]
        if d % 2:
            leak = rng.choice(items)[1].split()
            for _ in range(rng.randrange(0, int(0.2 * len(leak)) + 1)):
                at = rng.randrange(len(leak))
                leak[at : at + rng.choice([0, 1])] = rng.choice([[], [word()]])
            at = rng.randrange(len(body))
            body[at:at] = leak
        docs.append((d, (", " if d % 3 else " ").join(x.upper() if d % 5 == 0 else x for x in body)))
    return docs, items


def test_recall_against_brute_force(spark, monkeypatch):
    docs, items = _data()
    rows = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, edits string")
    find = lambda **o: {(r.doc_id, r.item_id): r.edits for r in C.contaminated(*rows, **o).collect()}
    want = _brute(docs, items)
    assert len(want) > 20
    assert find(exact=True) == want
    got = find()
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want)
    assert all(got[p] >= want[p] for p in got) and sum(got[p] == want[p] for p in got) >= 0.95 * len(got)
    monkeypatch.setattr(C, "BLOCK_WORDS", 60)
    assert find(exact=True) == want  # many blocks


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g"), (1, None), (2, ""), (3, "A, b; c d\ne f g."), (3, "A, b; c d\ne f g."), (4, "x " * 5000)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "a b"), (7, "a b c d e f g"), (8, None), (9, "")], "item_id long, text string")
    assert [tuple(r) for r in C.contaminated(docs, bench).collect()] == [(3, 7, 0, 7, 0)]
    assert C.contaminated(docs.limit(0), bench).count() == 0
    assert C.contaminated(docs, bench.limit(0)).count() == 0
    left = C.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 2, 4]


def _leaks(rng, sizes):
    word = lambda n: rng.integers(1, 1 << 62, n).astype(np.uint64)
    for i, n in enumerate(sizes):
        item = word(n)
        leak = item.tolist()
        for _ in range(int(C.MAX_EDITS * n)):
            at = int(rng.integers(len(leak)))
            kind = int(rng.integers(3))
            leak[at : at + (kind != 1)] = [] if kind == 0 else [int(word(1)[0])]
        yield i, item, np.concatenate([word(30), np.array(leak, np.uint64), word(30)])


def test_table_names_the_candidates_at_every_length():
    """Leaks at the edit bound: those that embedding and sampling find, from 12 to 1000 words; none without the table."""
    for n, trials in ((12, 60), (50, 60), (200, 40), (400, 25), (1000, 15)):
        found, possible = 0, 0
        for i, item, text in _leaks(np.random.default_rng(n), [n] * trials):
            for block in (C.ItemBlock([(i, item)], C.MAX_EDITS), C.ItemBlock([(i, item)], C.MAX_EDITS, exact=True)):
                hit = any(block.search(text, np.array([0, len(text)])))
                found, possible = found + (hit and not block.exact), possible + (hit and block.exact)
            block.exact = False
            block.sampled[:] = 0
            assert not any(block.search(text, np.array([0, len(text)])))
        assert possible >= 0.95 * trials and found >= 0.95 * possible, (n, found, possible)


def test_equal_windows_always_meet():
    rng = np.random.default_rng(9)
    items = [(i, rng.integers(1, 1 << 62, n).astype(np.uint64)) for i, n in enumerate([1, 2, 5, 13, 60, 300, 900])]
    block = C.ItemBlock(items, C.MAX_EDITS)
    for i, w in items:
        text = np.concatenate([rng.integers(1, 1 << 62, 7).astype(np.uint64), w])
        assert (i, 7, len(w), 0) in {x[1:] for x in block.search(text, np.array([0, len(text)]))}


def test_long_items_at_the_edit_bound():
    rng = np.random.default_rng(5)
    word = lambda n: rng.integers(1, 1 << 62, n).astype(np.uint64)
    items = [(i, word(n)) for i, n in enumerate([12, 50, 200, 400, 400, 1000, 1000, 1000])]
    block = C.ItemBlock(items, C.MAX_EDITS)
    for i, w in items:
        bad = rng.permutation(len(w))[: int(C.MAX_EDITS * len(w))]
        leak = w.copy()
        leak[bad] = word(len(bad))
        text = np.concatenate([word(30), leak, word(30)])
        assert {x[1] for x in block.search(text, np.array([0, len(text)]))} == {i}


def test_clashing_names_and_items_of_equal_text(spark):
    docs = spark.createDataFrame([(1, "x a b c d e f g y", 5, "r"), (2, "nothing here", 6, "s")], "doc_id long, text string, _bad int, item_id string")
    bench = spark.createDataFrame([(7, "a b c d e f g"), (8, "A, b c d e f g"), (9, "a b c d e f h")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start_word, r.n_words, r.edits) for r in C.contaminated(docs, bench).collect())
    assert got[:2] == [(1, 7, 1, 7, 0), (1, 8, 1, 7, 0)] and got[2][:2] == (1, 9) and got[2][4] == 1
    left = C.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, "nothing here", 6, "s")]
