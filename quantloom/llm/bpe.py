"""Byte-pair encoding and decoding with forced-boundary splitting.

A pair of bytes that lies inside no vocabulary token can never be inside an output token either, so every place where
such a pair occurs is a certain cut: merges never reach over it.  Each pre-token is cut there, the fragments are
encoded independently with the vocabulary's merges, and their ids are concatenated.  This bounds the work of a merge
loop by the longest fragment, not by the longest run of letters or spaces in a text.  Fragments repeat, so a worker
keeps the ids of up to ``CACHE_SIZE`` pre-tokens.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, models, pre_tokenizers

#: Pre-tokens whose ids one worker remembers; the memory is emptied when it is full.
CACHE_SIZE = 400_000
#: Longer pre-tokens are encoded anew each time.
CACHE_CHARS = 40

# Fixed value: the public pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters only are split by PATTERN here; for others the library's own pre-tokenizer is asked, as
#: two Unicode tables may class rare characters differently.
_COMMON = regex.compile(r"[\t\n\v\f\r\x20-\x7e¡-¬®-ɏ]*+")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


class ForcedBoundaryBpe(dict):
    """Maps a pre-token to its ids (little-endian unsigned 32-bit); itself the memory of those met before."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kind = spec["pre_tokenizer"]
        if spec["normalizer"] or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"]:
            raise ValueError("only byte-level vocabularies without normalizer and prefix space are supported")
        model = spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd:
            raise ValueError(f"only plain byte-pair models are supported, without {', '.join(odd) or model['type']}")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must match plainly")
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merger = models.BPE(vocab=vocab, merges=merges)
        self.alphabet = byte_alphabet()
        back = {c: b for b, c in self.alphabet.items()}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        self.inside = np.zeros((256, 256), dtype=bool)  # byte pairs that occur inside a token
        for token, i in vocab.items():
            if token in self.special:
                continue
            raw = bytes(back[c] for c in token)
            self.bytes_of[i] = raw
            for pair in zip(raw, raw[1:], strict=False):
                self.inside[pair] = True
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.pattern = regex.compile(PATTERN)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False)

    def fragments(self, raw: bytes) -> list[bytes]:
        """``raw`` cut wherever its bytes make a pair that no token contains."""
        if len(raw) < 2:
            return [raw]
        codes = np.frombuffer(raw, dtype=np.uint8)
        cuts = np.flatnonzero(~self.inside[codes[:-1], codes[1:]]) + 1
        ends = [*cuts.tolist(), len(raw)]
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def __missing__(self, piece: str) -> bytes:
        alphabet, ids = self.alphabet, []
        for fragment in self.fragments(piece.encode("utf-8")):
            ids += [t.id for t in self.merger.tokenize("".join(map(alphabet.__getitem__, fragment)))]
        out = np.array(ids, dtype="<u4").tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_SIZE:
                self.clear()
            self[piece] = out
        return out

    def pieces(self, text: str) -> list[str]:
        if _COMMON.fullmatch(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def encode(self, text: str) -> bytes:
        """Ids of the whole text, as little-endian unsigned 32-bit integers."""
        if self.split_special is None or not self.split_special.search(text):
            return b"".join(map(self.__getitem__, self.pieces(text)))
        out = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append(np.array([self.special[part]], dtype="<u4").tobytes())
            elif part:
                out.append(b"".join(map(self.__getitem__, self.pieces(part))))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Text of the ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


_CODECS: dict[str, ForcedBoundaryBpe] = {}


def codec(path: str) -> ForcedBoundaryBpe:
    """The worker's codec for the vocabulary at ``path``, loaded once."""
    if path not in _CODECS:
        _CODECS[path] = ForcedBoundaryBpe(path)
    return _CODECS[path]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_texts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Columns ``keep`` of every row, with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array<int>).

    Null counts as empty (no tokens).  Rows are handled alone: repeated rows give repeated results, an empty table an
    empty one, and a text of any length is encoded whole.  ``path`` must be readable on every executor.  A kept column may not
    have the name of a new one; other columns are not read, whatever their names.
    """
    path = path or vocabulary_path()
    new = {"n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids}
    if clash := sorted(new & set(keep)):
        raise ValueError(f"columns that are made here cannot be kept: {clash}")
    kept = docs.select(*[f"`{c}`" for c in keep], docs[text].alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1])
    schema += (", " if schema else "") + "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        sha = hashlib.sha256
        for batch in batches:
            n, sums, back, ids = [], [], [], []
            for value in batch.column(batch.num_columns - 1):
                encoded = bpe.encode(value.as_py() or "")
                n.append(len(encoded) // 4)
                sums.append(sha(encoded).hexdigest())
                back.append(sha(bpe.decode(encoded).encode("utf-8")).hexdigest())
                if with_ids:
                    ids.append(np.frombuffer(encoded, dtype="<i4"))
            columns = [*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(sums, pa.string()), pa.array(back, pa.string())]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            names = [*batch.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return kept.mapInArrow(run, schema)


def decode_ids(rows: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``rows`` with a column decoded_text: the text of each id array (null: empty)."""
    path = path or vocabulary_path()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", decoded_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            texts = [bpe.decode(np.asarray(v.as_py() or [], dtype="<u4").tobytes()) for v in batch.column(batch.schema.get_field_index(ids))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded_text"])

    return rows.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's tokens counted, with digests of their ids and of the text decoded from them; null counts as empty,
    other cases are those of ``encode_texts``."""
    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
