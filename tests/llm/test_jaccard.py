import random

import numpy as np

from quantloom.llm import jaccard


def _sets(text):
    w = [x for x in (text or "").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _brute(rows, t=0.8):
    sets = [(d, _sets(x)) for d, x in rows]
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = dict.fromkeys(up, 0)
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and len(x & y) >= t * len(x | y) - 1e-9:
                links[a] += 1
                links[b] += 1
                u, v = sorted((root(a), root(b)))
                up[v] = u
    return {d: (root(d), links[d]) for d in up}


def _rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 6)))
    texts = [None, "", " \n", "one", "one", "one two", "a b c d e", "a  b c\nd e", "a b c d e f"]
    for _ in range(25):
        base = [word() for _ in range(rng.choice([6, 30, 120, 400]))]
        for _ in range(rng.randrange(1, 14)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts, 1))


def test_equals_brute_force(spark):
    rows = _rows()
    docs = spark.createDataFrame([(d, t, "s", 1) for d, t in rows], "doc_id long, text string, class_id string, n int")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(docs).collect()}
    assert got == _brute(rows)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for c, _ in got.values()}


def test_blocks_of_a_large_component(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 7)
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(docs).collect()} == _brute(rows)


def test_nulls_repeats_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(None, text), (None, None), (4, text), (4, text), (9, text + " more"), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.class_id) for r in jaccard.near_duplicates(docs).collect()))
    assert got == [(-1, None), (-1, None), (2, 2), (4, 4), (4, 4), (9, 4)]
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0
    assert jaccard.keep_one(docs.limit(0)).count() == 0


def test_chain_of_documents(spark, monkeypatch):
    """One component of all documents, in which each is similar to its neighbours only: work follows the buckets."""
    n, monkey = 3000, {}
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 32)
    seats = jaccard._block_seats
    monkeypatch.setattr(jaccard, "_block_seats", lambda *a: monkey.setdefault("seats", seats(*a)))
    docs = spark.range(n).selectExpr("id AS doc_id", "array_join(transform(sequence(2 * id, 2 * id + 59), x -> substr(sha2(cast(x as string), 256), 1, 8)), ' ') AS text")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(docs).collect()}
    near = lambda d: sum(0 <= d + k < n and 56 - 2 * abs(k) >= 0.8 * (56 + 2 * abs(k)) for k in range(-9, 10) if k)
    assert got == {d: (0, near(d)) for d in range(n)}
    groups = monkey["seats"].select("g1", "g2").distinct()
    blocks = groups.where("g1 = g2").count()
    assert blocks > 100 and groups.count() < 60 * blocks < blocks * blocks / 4


def test_very_long_text(spark):
    long = " ".join(f"w{i % 9973}x{i // 7}" for i in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, long + " more"), (3, "short")], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(docs).collect()) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]


def test_dense_and_single_comparison_agree(monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(300) < 0.95], rng.integers(0, 1 << 60, 10, dtype=np.uint64)])) for _ in range(40)] + [np.zeros(0, np.uint64)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    sig = jaccard.signatures(np.concatenate(sets), first, 160)
    found = []
    for dense, step in ((10**9, 4096), (0, 4096), (0, 7)):
        monkeypatch.setattr(jaccard, "DENSE", dense)
        monkeypatch.setattr(jaccard, "DENSE_SHINGLES", step)
        found.append([x.tolist() for x in jaccard.verify_block(sig[:20], sig[20:], sets[:20], sets[20:], 0.8, 1e-7)])
    assert found[0] == found[1] == found[2] and len(found[0][0]) > 50


def test_many_variants_of_one_text_take_few_seats(spark, monkeypatch):
    """Variants share most buckets but not all: their component is cut into few blocks, and no link is lost."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(300):
        words = list(base)
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(words)))
    seen = {}
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 32)
    seats = jaccard._block_seats
    monkeypatch.setattr(jaccard, "_block_seats", lambda *a: seen.setdefault("seats", seats(*a)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(docs).collect()} == _brute(rows)
    most = seen["seats"].groupBy("rep").count().agg({"count": "max"}).first()[0]
    assert most <= 3 * -(-300 // 32)


def test_extra_columns_pass_through(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(2, text, 1, "a"), (1, text, 2, "b"), (None, text, 3, "c"), (9, None, 4, "d")], "doc_id long, text string, class_id int, n_links string")
    assert sorted(r.class_id for r in jaccard.keep_one(docs).collect()) == [2, 3, 4]
