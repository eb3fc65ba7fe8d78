import random

from quantloom.llm import lines


def _brute(rows, t=0.8, least=1):
    flat = sorted((d, i, frozenset(x.split())) for d, text in rows if d is not None and text is not None for i, x in enumerate(text.split("\n")))
    return {
        (d, i) for d, i, s in flat if len(s) >= least
        and any((e, j) < (d, i) and len(q) >= least and len(q & s) >= t * len(q | s) - 1e-9 for e, j, q in flat)
    }


def _rows():
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "of", "and", "a"]) if rng.random() < 0.3 else "".join(rng.choice("abcdefghij") for _ in range(3))
    pool = [[word() for _ in range(rng.choice([2, 5, 6, 9, 20, 40]))] for _ in range(60)]
    rows = []
    for d in range(160):
        out = []
        for _ in range(rng.randrange(0, 7)):
            x = list(rng.choice(pool)) if rng.random() < 0.7 else [word() for _ in range(12)]
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                x[rng.randrange(len(x))] = word()
            out.append(" ".join(x))
        rows.append((d, "\n".join(out)))
    return rows


def test_equals_brute_force(spark):
    rows = _rows()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, line_no string")
    want = _brute(rows)
    assert len(want) > 30
    assert {tuple(r) for r in lines.repeated_lines(docs).collect()} == want
    left = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert left == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in want) for d, t in rows}


def test_edges(spark):
    line = "one two three four five six"
    docs = spark.createDataFrame([(None, line), (5, line), (5, line), (6, f"{line}\n\n{line}"), (7, None), (8, ""), (1, "a b")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.text) for r in lines.dedup_lines(docs).collect() if r.text is not None)
    assert got == [(0, line), (1, "a b"), (5, line), (5, line), (6, ""), (8, "")]
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_lines_of_few_words(spark):
    rng = random.Random(4)
    rows = _rows() + [(1000 + d, "\n".join(" ".join(rng.choice("abcdef") for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 30]))) for _ in range(4))) for d in range(60)]
    rows += [(2000, "w x y z"), (2001, "w x y z v"), (2002, "p q r"), (2003, "p q r s"), (2004, "r  q p q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = _brute(rows)
    assert want > _brute(rows, least=5) and {(2001, 0), (2004, 0)} <= want and (2003, 0) not in want
    assert {tuple(r) for r in lines.repeated_lines(docs).collect()} == want


def test_rows_of_one_id_lose_their_own_lines(spark):
    line = "one two three four five six"
    docs = spark.createDataFrame([(1, line), (2, f"{line}\nold words stay here as well"), (2, f"new words stay here as ever\n{line}")], "doc_id long, text string")
    assert sorted(r.text for r in lines.dedup_lines(docs).collect()) == ["new words stay here as ever", "old words stay here as well", line]


def test_very_long_text_and_clashing_names(spark):
    names = ["sid", "k", "k2", "u", "s", "p", "open", "led", "near", "copy", "plain", "line", "tk", "_spot"]
    own = lambda i: " ".join(f"w{i * 8 + j}" for j in range(8))
    text = "\n".join(own(i % 1500) for i in range(6000))
    docs = spark.createDataFrame([(1, text, *names), (2, "short line of a few words\n" + "w " * 100_000, *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert got[1].text == "\n".join(map(own, range(1500))) and got[1].sid == "sid" and got[1].open == "open" and got[2].text == docs.where("doc_id = 2").first().text


def test_null_texts_have_no_lines_without_ansi(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, ""), (3, "a\nb")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert {r.doc_id: r.n_lines for r in lines.query(spark, str(tmp_path)).collect()} == {1: 0, 2: 1, 3: 2}
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_passes_read_the_sets_once(spark, monkeypatch):
    scans, candidates = [], lines._candidates
    monkeypatch.setattr(lines, "_candidates", lambda x, y, t: scans.append(x._jdf.queryExecution().optimizedPlan().toString().count("Relation [")) or candidates(x, y, t))
    rows = [(d, f"a b c d e f g{d}") for d in range(4)]
    assert {r.doc_id for r in lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {d for d, _ in _brute(rows)}
    assert len(scans) >= lines.PASSES and set(scans[: lines.PASSES]) == {1}


def test_numbers_of_lines_come_with_the_lines(spark, tmp_path):
    rows = [(1, "a b c d\nx"), (1, "a b c d\nx"), (2, ""), (3, None), (None, "a\nb\nc"), (4, "\n\na b c d\n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = lines.query(spark, str(tmp_path))
    assert "isnull(text" in got._jdf.queryExecution().optimizedPlan().toString()  # no other text is parted for the count
    assert sorted(((r.doc_id or 0), r.n_lines, r.removed_lines) for r in got.collect()) == [(0, 3, ""), (1, 2, ""), (1, 2, ""), (2, 1, ""), (3, 0, ""), (4, 4, "2")]


def test_words_are_counted_alike_in_short_and_long_texts(spark, monkeypatch):
    docs = spark.createDataFrame([("a b a\n\na c ",), (" d\te\n" * 40,), ("a f\n" * 40,), (None,), ("",)], "text string")
    ranks = [lines.rarity_table(docs, "text").first().ranks]
    monkeypatch.setattr(lines, "_SHORT", 0)
    ranks.append(lines.rarity_table(docs, "text").first().ranks)
    assert ranks[0] == ranks[1] and sorted(r >> 57 for r in ranks[0])[:7] == [0, 0, 10, 10, 10, 10, 62]  # b and c once, a 43 times, no word beyond f


def test_only_sets_with_a_shared_key_look_for_a_lead(spark, monkeypatch):
    sizes, plain = {}, lines.table
    rows = [(d, " ".join(f"w{d}x{j}" for j in range(12))) for d in range(200)] + [(900, " ".join(f"w7x{j}" for j in range(11)) + " other"), (901, " ".join(f"w7x{j}" for j in range(12))), (902, " ".join(f"w7x{j}" for j in range(12)))]

    def noted(df, name):
        out = plain(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(lines, "table", noted)
    got = {tuple(r) for r in lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _brute(rows) == {(900, 0), (901, 0), (902, 0)}
    assert 0 < sizes["keyed"] <= 30  # of 603 keys of 201 sets; copies have none, others may pass the bit table


def test_parities_of_sets_on_both_sides_of_the_bound(spark):
    rng = random.Random(9)
    pool = [[f"{rng.randrange(10**6)}" for _ in range(n)] for n in (58, 63, 64, 65, 66, 72, 80, 130)]
    rows = [(-1, "\n".join(" ".join(x) for x in pool))]
    for d in range(60):
        x = list(rng.choice(pool))
        for _ in range(rng.randrange(0, len(x) // 5)):
            rng.choice([lambda: x.append(f"n{rng.random()}"), lambda: x.pop(rng.randrange(len(x))), lambda: x.__setitem__(rng.randrange(len(x)), f"n{rng.random()}")])()
        rows.append((d, " ".join(x)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = _brute(rows)
    assert 10 < len(want) < 60 and {tuple(r) for r in lines.repeated_lines(docs).collect()} == want
    wide = lines._wide(docs, "doc_id", "text", lines.THRESHOLD)
    assert {(r.n > 64) == (r.some is not None) for r in wide.select("n", "some").collect()} == {True}
