import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

from quantloom.llm import bpe


def _texts():
    rng = random.Random(5)
    alphabet = list("abcXYZ 019  \n\t'.,é漢😀  \x1c\x85 ’") + ["<|endoftext|>", "'s", "'ll", "   ", "\r\n"]
    out = [None, "", " ", "a", "<|endoftext|>", "x<|endoftext|><|endoftext|> y ", "a" * 50_000, " \n" * 5000, "The the. Tion élève überß"]
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 80))) for _ in range(400)]


def test_equals_the_library(spark):
    texts = _texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "again", "y"), (3, "a", "z")], "doc_id long, text string, n_tokens_ string")
    t = Tokenizer.from_file(bpe.vocabulary_path())
    got = {(r.doc_id, r.n_tokens_): r for r in bpe.encode_texts(docs, keep=("doc_id", "n_tokens_")).collect()}
    assert len(got) == len(texts) + 2
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert list(got[i, "x"].ids) == ids, text
        assert got[i, "x"].n_tokens == len(ids)
        assert got[i, "x"].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i, "x"].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_round_trip_and_empty(spark):
    docs = spark.createDataFrame([(1, "héllo\n\nwörld  ")], "doc_id long, text string")
    assert bpe.decode_ids(bpe.encode_texts(docs)).first().decoded_text == "héllo\n\nwörld  "
    assert bpe.encode_texts(docs.limit(0)).count() == 0


def test_cuts_are_certain():
    b = bpe.codec(bpe.vocabulary_path())
    raw = "thing123漢漢 x".encode()
    parts = b.fragments(raw)
    assert b"".join(parts) == raw and len(parts) > 1
    assert all(not b.inside[x[-1], y[0]] for x, y in zip(parts, parts[1:], strict=False))


def test_other_models_and_clashing_names_are_refused(spark, tmp_path):
    import json

    import pytest

    with open(bpe.vocabulary_path(), encoding="utf-8") as file:
        spec = json.load(file)
    for key, value in (("ignore_merges", True), ("byte_fallback", True), ("dropout", 0.1), ("continuing_subword_prefix", "##"), ("type", "WordPiece")):
        (tmp_path / "m.json").write_text(json.dumps(spec | {"model": spec["model"] | {key: value}}), encoding="utf-8")
        with pytest.raises(ValueError):
            bpe.ForcedBoundaryBpe(str(tmp_path / "m.json"))
    docs = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, n_tokens int")
    with pytest.raises(ValueError):
        bpe.encode_texts(docs, keep=("doc_id", "n_tokens"))
    assert bpe.encode_texts(docs).first().n_tokens == 1
