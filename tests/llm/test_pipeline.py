import hashlib
import random

from test_contamination import _brute as contaminated
from test_jaccard import _brute as classes
from test_lines import _brute as repeated
from test_quality import _brute as rules
from tokenizers import Tokenizer

import corpus_pipeline
from quantloom.llm import bpe


def _documents():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 7)))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(3)]
    line = " ".join(word() for _ in range(12))
    rows = []
    for d in range(60):
        body = [" ".join(word() for _ in range(15)) for _ in range(6)]
        if d % 6 == 0:
            body.append(line)
        if d % 10 == 3:
            body.insert(2, items[d % 3][1])
        rows.append((d, "\n".join(body), "en", f"host{d % 4}", 1))
    rows += [(100 + d, f"{rows[d][1]} {word()}", "en", "host1", 1) for d in range(1, 20, 3)]
    rows += [(200 + d, "too short", "en", "spam", 1) for d in range(25)] + [(230, rows[5][1][::-1], "en", "spam", 1), (240, None, None, None, None), (241, "", "de", "host2", 0), (None, rows[7][1][::-1], "en", "host3", 1)]
    return rows, items


def _expected(rows, items):
    failed = {}
    for d, t, _, s, _ in rows:
        failed.setdefault(s, []).append(rules(t)[5])
    docs = [r for r in rows if not rules(r[1])[5] and r[3] != "spam"]
    gone = repeated([(r[0], r[1]) for r in docs])
    docs = [(r[0], "\n".join(x for i, x in enumerate(r[1].split("\n")) if (r[0], i) not in gone)) for r in docs]
    kept = {c for c, _ in classes([r for r in docs if r[0] is not None]).values()}
    docs = [r for r in docs if r[0] is None or r[0] in kept]
    bad = {d for d, _ in contaminated([r for r in docs if r[0] is not None], items)}
    return [r for r in docs if r[0] is None or r[0] not in bad], bad


def test_equals_brute_force(spark, tmp_path):
    rows, items = _documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want, bad = _expected(rows, items)
    assert bad and len(want) < len(rows) - 30
    t = Tokenizer.from_file(bpe.vocabulary_path())
    digest = lambda text: hashlib.sha256(t.decode(t.encode(text, add_special_tokens=False).ids, skip_special_tokens=False).encode()).hexdigest()
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id if r.doc_id is not None else -1), r.decoded_sha256) for r in got) == sorted(((d if d is not None else -1), digest(x)) for d, x in want)


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_and_clashing_names(spark, tmp_path):
    rows, items = _documents()
    names = ["sid", "k", "host", "class_id", "open", "keys"]
    rows = [(*r, *names) for r in rows] + [(*rows[1], *names)] * 2
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{n}` string" for n in names)
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
    kept = docs.where("doc_id = 1").collect()
    assert len(kept) == 3 and all(r.sid == "sid" and r.keys == "keys" for r in kept)
