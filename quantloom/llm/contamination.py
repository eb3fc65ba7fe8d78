"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit verification over word windows.

A text and an item are words: runs of characters other than white space and ASCII punctuation, ASCII and Latin-1
letters in lower case.  A document is contaminated by an item of n words if some n-word window of it, ended at up to k
words more or fewer, is within edit distance k = floor(``max_edits`` n) of the item (insert, delete, replace a word).

A window can be that close only if it keeps all but k of the item's words, so an index of the items' rarer words first
leaves out the starts that cannot be; this count filter loses nothing.  What it leaves is embedded by the CGK random walk:
step j writes the current word and moves on if a random bit of (j, word) says so, so close edit distance becomes close
Hamming distance.  Each of an item's repetitions has a walk of its own and samples one position of it; a window is a
candidate for the item if its walk holds the item's word at one of the sampled positions, and only candidates get an exact
edit distance.  The chance to agree at a position falls with the root of the item's length, so longer items get more
repetitions, as many as a miss of ``MISS`` asks for at the edit bound; equal windows are never missed, and a leak usually
offers several windows.  With ``exact`` every window that passes the count filter is compared.

Items are dealt into blocks of about ``BLOCK_WORDS`` words at most, one pass over the documents for each block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.reduce import split
from quantloom.llm.scratch import table
from quantloom.llm.words import CHUNK_BYTES, mix, split_words, text_buffer

MAX_EDITS = 0.2
#: The chance to miss a window at the edit bound that repetitions are chosen for, and the most of them.
MISS, MOST_REPEATS = 1e-3, 64
#: Words of more items than this are left out of an item's count, if enough others remain to ask for ``MIN_HITS`` of them.
RARE_ITEMS, MIN_HITS = 4, 3
#: Words of items held by a task at once.
BLOCK_WORDS = 1_000_000
#: Windows embedded at once.
BATCH_WINDOWS = 4096

_U = np.uint64


def _fold_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[ord("A") : ord("Z") + 1] += 32
    for c in range(33, 127):
        if not chr(c).isalnum():
            out[c] = 32
    return out


_FOLD = _fold_table()


def folded(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with punctuation as spaces and ASCII and Latin-1 capitals as small letters; offsets stay valid."""
    out = _FOLD[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


def folded_words(text: str) -> np.ndarray:
    """Word hashes of one text."""
    data = folded(np.frombuffer(text.encode("utf-8"), dtype=np.uint8))
    return split_words(data, np.array([0, len(data)], dtype=np.int64)).hashes


def repeats_for(size: np.ndarray) -> np.ndarray:
    """Repetitions for items of these sizes; agreement at the bound was measured from 0.4 at 50 words to 0.14 at 1000."""
    agree = np.minimum(0.4, 4.4 / np.sqrt(np.maximum(size, 1)))
    return np.minimum(MOST_REPEATS, np.ceil(np.log(MISS) / np.log1p(-agree))).astype(np.int64)


def walked(windows: np.ndarray, lengths: np.ndarray, row: np.ndarray, repeat: np.ndarray, spot: np.ndarray) -> np.ndarray:
    """For each (row of ``windows``, repetition): the word that the repetition's CGK walk holds at its sampled position;
    0 past the row's length."""
    order = np.argsort(-spot, kind="stable")
    row, salt, spot = row[order], repeat[order].astype(np.uint64) * _U(0x9E3779B1), spot[order]
    at, limit = np.zeros(len(row), dtype=np.int64), windows.shape[1] - 1
    out = np.zeros(len(row), dtype=np.uint64)
    for j in range(int(spot[0]) + 1 if len(spot) else 0):
        n = int(np.searchsorted(-spot, -j, side="right"))  # walks that go on to step j
        word = np.where(at[:n] < lengths[row[:n]], windows[row[:n], np.minimum(at[:n], limit)], _U(0))
        ends = spot[:n] == j
        out[order[:n][ends]] = word[ends]
        at[:n] += (mix(word + salt[:n] + _U(j * 0x85EBCA77 + 1)) & _U(1)).astype(np.int64)
    return out


def edit_distances(windows: np.ndarray, lengths: np.ndarray, items: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, words used) for each row: the prefix of the window closest to the item, the longest among equals."""
    m = windows.shape[1]
    column = np.arange(m + 1)
    row = np.tile(column, (len(windows), 1))
    for i in range(items.shape[1]):
        live = i < sizes
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (windows != items[:, i : i + 1]))
        new = np.minimum.accumulate(new - column, axis=1) + column
        row = np.where(live[:, None], new, row)
    row = np.where(column <= lengths[:, None], row, 1 << 20)
    return row.min(axis=1), m - row[:, ::-1].argmin(axis=1)


class ItemBlock:
    """Items of a block with an index of their rare words and an LSH table."""

    def __init__(self, items: list[tuple[int, np.ndarray]], max_edits: float, exact: bool = False) -> None:
        self.exact = exact
        self.items = [(i, w) for i, w in items if len(w)]
        self.size = np.array([len(w) for _, w in self.items], dtype=np.int64)
        self.most = (max_edits * self.size + 1e-9).astype(np.int64)  # edits allowed
        width = int((self.size + self.most).max()) if self.items else 1
        self.padded = np.zeros((len(self.items), width), dtype=np.uint64)
        for r, (_, w) in enumerate(self.items):
            self.padded[r, : len(w)] = w
        self._index()
        self.repeats = repeats_for(self.size)
        self.places = np.random.default_rng(0).random(MOST_REPEATS) * 2  # in item lengths: walks mostly end after two
        row, repeat = self._turns(np.arange(len(self.items)))
        #: The LSH table: an item's word at each of its repetitions' sampled positions.
        self.sampled = np.zeros((len(self.items), MOST_REPEATS), dtype=np.uint64)
        self.sampled[row, repeat] = walked(self.padded, self.size, row, repeat, self._spots(row, repeat))

    def _turns(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``items``, repetition) for each repetition of each of them."""
        n = self.repeats[items]
        return np.repeat(np.arange(len(items)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    def _spots(self, items: np.ndarray, repeat: np.ndarray) -> np.ndarray:
        return (self.places[repeat] * self.size[items]).astype(np.int64)

    def _candidates(self, windows: np.ndarray, rest: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Which item-sized windows agree with their item at a sampled position of some repetition."""
        row, repeat = self._turns(items)
        word = walked(windows, np.minimum(self.size[items], rest), row, repeat, self._spots(items[row], repeat))
        out = np.zeros(len(items), dtype=bool)
        out[row[(word == self.sampled[items[row], repeat]) & (word != 0)]] = True
        return out

    def _index(self) -> None:
        """(word, item) pairs sorted by word; words of many items count only for items that have too few others."""
        common: dict[int, int] = {}
        for _, w in self.items:
            for x in set(w.tolist()):
                common[x] = common.get(x, 0) + 1
        words, owners = [], []
        self.need = np.zeros(len(self.items), dtype=np.int64)
        for r, (_, w) in enumerate(self.items):
            rare = np.array([common[x] <= RARE_ITEMS for x in w.tolist()])
            used = w[rare] if rare.sum() - self.most[r] >= MIN_HITS else w
            self.need[r] = max(1, len(used) - self.most[r])
            own = np.unique(used)
            words.append(own)
            owners.append(np.full(len(own), r))
        words_, owners_ = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (words, owners))
        order = np.argsort(words_, kind="stable")
        self.words, self.owners = words_[order].astype(np.uint64), owners_[order]
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[(self.words & _U((1 << 20) - 1)).astype(np.int64)] = True

    def starts(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, start word) of each window that has enough words of the item to be close to it."""
        at = np.flatnonzero(self.bits[(hashes & _U((1 << 20) - 1)).astype(np.int64)])
        lo = np.searchsorted(self.words, hashes[at], side="left")
        n = np.searchsorted(self.words, hashes[at], side="right") - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        if not len(at):
            return at, at
        owner = self.owners[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        at = np.repeat(at, n)
        order = np.argsort(owner, kind="stable")  # by item, then place
        owner, at = owner[order], at[order]
        last = np.arange(len(at)) + self.need[owner] - 1
        fits = last < len(at)
        begin, last = np.flatnonzero(fits), last[fits]
        i = owner[begin]
        reach = self.size[i] + self.most[i]
        doc = np.searchsorted(first, at, side="right")
        good = (owner[last] == i) & (doc[last] == doc[begin]) & (at[last] - at[begin] < reach)
        begin, last, i, reach = begin[good], last[good], i[good], reach[good]
        low = np.maximum(at[last] - reach + 1, first[doc[begin] - 1])
        count = at[begin] - low + 1
        found = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        packed = np.unique(np.repeat(i, count) << 40 | found)
        return packed >> 40, packed & ((1 << 40) - 1)

    def _shares_words(self, windows: np.ndarray, reach: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Which windows have all but the allowed edits of their item's words, counted with repetition."""
        out = np.zeros(len(items), dtype=bool)
        for i in np.unique(items).tolist():
            rows = np.flatnonzero(items == i)
            inside = np.arange(windows.shape[1]) < reach[rows, None]
            words, times = np.unique(self.items[i][1], return_counts=True)
            shared = np.zeros(len(rows), dtype=np.int64)
            for word, n in zip(words, times.tolist(), strict=True):
                shared += np.minimum(((windows[rows] == word) & inside).sum(axis=1), n)
            out[rows] = shared >= self.size[i] - self.most[i]
        return out

    def search(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item, start word, words, distance) of windows within distance, in the documents of ``first``;
        among them the closest, then first, of each document and item."""
        items, at = self.starts(hashes, first)
        lo = 0
        while lo < len(at):
            hi = min(len(at), lo + BATCH_WINDOWS)
            yield from self._verify(hashes, first, items[lo:hi], at[lo:hi])
            lo = hi

    def _verify(self, hashes, first, items, at):
        doc = np.searchsorted(first, at, side="right") - 1
        index = np.minimum(at[:, None] + np.arange(self.padded.shape[1]), len(hashes) - 1)
        windows, rest = hashes[index], first[doc + 1] - at
        keep = self._shares_words(windows, np.minimum(self.size[items] + self.most[items], rest), items)
        windows, rest, items, at, doc = windows[keep], rest[keep], items[keep], at[keep], doc[keep]
        if not len(at):
            return
        if not self.exact:
            named = self._candidates(windows, rest, items)
            windows, rest, items, at, doc = windows[named], rest[named], items[named], at[named], doc[named]
        if len(at):
            d, used = self._compare(windows, rest, items)
            yield from self._close(doc, at, items, d, used)

    def _compare(self, windows: np.ndarray, rest: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edit distances of each window's prefixes to its item; windows of items of one size are compared at once."""
        d, used = np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
        reach = self.size + self.most
        for n in np.unique(self.size[item]).tolist():
            rows = np.flatnonzero(self.size[item] == n)
            i = item[rows]
            m = int(reach[i[0]])
            d[rows], used[rows] = edit_distances(windows[rows, :m], np.minimum(m, rest[rows]), self.padded[i, :n], self.size[i])
        return d, used

    def _close(self, doc, at, item, d, used) -> Iterator[tuple[int, int, int, int, int]]:
        for x in np.flatnonzero(d <= self.most[item]).tolist():
            yield int(doc[x]), self.items[item[x]][0], int(at[x]), int(used[x]), int(d[x])


#: A word of an item, as ``folded_words`` finds it.
_ITEM_WORD = r"[^\x09-\x0D !-/:-@\[-`{-~]+"


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """Items by block: dealt by hash into so many that each has half of ``BLOCK_WORDS`` in the mean, or all in one."""
    rows = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{text}`").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    words = rows.agg(F.sum(F.regexp_count("t", F.lit(_ITEM_WORD)))).first()[0]
    if words is None:
        return
    parts = 1 if words <= BLOCK_WORDS else math.ceil(2 * words / BLOCK_WORDS)
    for part in range(parts):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", max_edits: float = MAX_EDITS, exact: bool = False) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, edits): the closest, then first, window of each document and item.

    Null or empty texts and items match nothing, null ids are skipped, repeated rows give one result, empty tables an
    empty one.  Of windows equally close the first counts, then the shortest; items of equal text are found each.  A very
    long text is searched whole in one task, a longer item than a block is a block; other columns are not read.  ``exact`` compares
    every window that passes the count filter, without embedding.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id IS NOT NULL")
    schema = "doc_id long, item_id long, start_word long, n_words long, edits long"
    out = None
    for block in _blocks(benchmark, item_id, item_text):
        sent = rows.sparkSession.sparkContext.broadcast(block)  # about BLOCK_WORDS words at most, or one item

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = ItemBlock([(i, folded_words(t)) for i, t in sent.value], max_edits, exact)
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                best: dict[tuple[int, int], tuple[int, int, int]] = {}
                data, offsets = text_buffer(batch.column(1))
                lo, n = 0, len(offsets) - 1
                while lo < n:
                    hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, side="right")) - 1))
                    part = folded(data[int(offsets[lo]) : int(offsets[hi])])
                    words = split_words(part, offsets[lo : hi + 1] - offsets[lo])
                    for d, item, start, used, edits in items.search(words.hashes, words.first):
                        key, value = (int(ids[lo + d]), item), (edits, start - int(words.first[d]), used)
                        if key not in best or value < best[key]:
                            best[key] = value
                    lo = hi
                if best:
                    pairs, values = zip(*best.items(), strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64()), *(pa.array([v[j] for v in values], pa.int64()) for j in (1, 2, 0))],
                        names=["doc_id", "item_id", "start_word", "n_words", "edits"],
                    )

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    if out is None:
        return rows.sparkSession.createDataFrame([], schema)
    best = F.min(F.struct("edits", "start_word", "n_words")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.start_word", "b.n_words", "b.edits")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` without the documents that some item contaminates; rows with a null id stay."""
    bad = table(contaminated(docs, benchmark, doc_id, text, **options).select(F.col("doc_id").alias("_bad")).distinct(), "contaminated")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{doc_id}`").cast("long").alias("_bad"))
    maybe, clean = split(keyed, ["_bad"], bad)
    return maybe.join(bad, "_bad", "left_anti").select("_row.*").union(clean.select("_row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    """The closest window of each document and benchmark item that are close; null texts and ids have none."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
