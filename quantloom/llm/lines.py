"""Near-duplicate lines: exact set-similarity join on line tokens (DataFrame functions only).

A line's tokens are its distinct words, as 64-bit hashes.  They are ordered by rarity: first by the logarithm of how often
their hash bucket occurs in the whole corpus (a table of fixed size, ``BUCKETS`` numbers, counted over all documents and
read by tasks as a scalar subquery), then by hash.  Any fixed order keeps the join exact; this one keeps the frequent
words out of the prefixes.

For Jaccard >= t two sets of x and y tokens need x >= t y and an overlap of t/(1+t) (x+y), so they share one of their
first x - ceil(t x) + 1 tokens (prefix filter), their sizes fit (length filter), and the places of that token leave
room for the overlap (positional filter).  Parities of 64 classes of tokens, 128 where both sets are large, bound the sets'
difference from below and spare most other pairs the verification.  Sets of equal tokens collapse first, which is all that sets need of so few
tokens that even one token more makes them differ too much (three at t = 0.8): they post nothing.

One earlier similar set is enough to remove a set, so not all pairs of a large group need be met:

1. Sets that agree in their two smallest, two largest or outermost token hashes look at the one of the smallest doc_id under such a
   key first.  Where parity and sizes say that the two are similar, the set is led and looks no further.  Keys are counted
   before, and only sets with a key that another set has take part.
2. All other sets are joined with all earlier sets by the filters above, a part of the tokens at a time.
3. The pairs of both steps are verified on token arrays, fetched for these sets only.
4. A set whose lead does not hold is joined with all earlier sets after all, so the result is exact.

Postings name tokens by 32-bit hashes: those route only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.quality import words_of
from quantloom.llm.reduce import split
from quantloom.llm.scratch import table

THRESHOLD = 0.8
#: Passes over the postings: disk for their shuffle is a part of what one pass would take.
PASSES = 4
BUCKETS = 1 << 18
#: Characters of a text whose words are counted without parting its lines first.
_SHORT = 1 << 20
#: Bits of a token number that hold its hash; the bits above hold its rank, 0..62.
_HASH_BITS = 57


def _plain(text: Column) -> Column:
    """Whether the words of each line of ``text`` are parted by single spaces and nothing else."""
    odd = F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" "))
    for white in ("  ", " \n", "\n ", "\t", "\x0b", "\f", "\r"):
        odd = odd | F.contains(text, F.lit(white))
    return ~odd


def _words(line: Column, plain: Column) -> Column:
    """``words_of`` a line; a plain one is spared the regular expression."""
    return F.when(plain & (line != ""), F.split(line, " ")).otherwise(words_of(line))


def _tokens(line: Column, plain: Column) -> Column:
    """The tokens of a line: hashes of its distinct words in ascending order."""
    return F.sort_array(F.array_distinct(F.transform(_words(line, plain), lambda w: F.xxhash64(w))))


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, tk, n_lines, plain, line_no, line) of rows with an id; line_no counts from 0, ``tk`` tells texts of one doc_id apart."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    n_lines = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    return _exploded(rows.select("doc_id", F.xxhash64("text").alias("tk"), n_lines.alias("n_lines"), _plain(F.col("text")).alias("plain"), F.split("text", "\n").alias("lines")))


def _exploded(rows: DataFrame) -> DataFrame:
    """A row for each of ``lines``, with line_no and line; what stands beside was computed once for the text, which is not carried along.

    Outer, here and for words, because a plain one is planned with a filter on the array's size, which splits the text twice.
    """
    return rows.select(*[c for c in rows.columns if c != "lines"], F.posexplode_outer("lines").alias("line_no", "line"))


def rarity_table(docs: DataFrame, text: str) -> DataFrame:
    """One row, ``ranks``: the rank (0..62, rare first) of each hash bucket, in the bits above a hash, from counts over all words of ``docs``."""
    value = F.col(f"`{text}`")
    parts = F.when(F.octet_length(value) <= _SHORT, F.array(F.replace(value, F.lit("\n"), F.lit(" ")))).otherwise(F.split(value, "\n"))
    lines = _exploded(docs.select(_plain(value).alias("plain"), parts.alias("lines")))
    words = lines.select(F.explode_outer(_words(F.col("line"), F.col("plain"))).alias("w")).where("w <> ''")
    counts = table(words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).count(), "counts")  # at most BUCKETS rows
    rank = F.coalesce(F.least(F.lit(62), (2 * F.log2("count")).cast("int")), F.lit(0)).cast("tinyint")
    every = docs.sparkSession.range(BUCKETS).join(counts, F.col("id") == F.col("b"), "left").select(F.struct("id", rank.alias("rank")).alias("r"))
    return table(every.agg(F.array_sort(F.collect_list("r")).alias("r")).select(F.transform("r", lambda r: F.shiftleft(r["rank"].cast("long"), _HASH_BITS)).alias("ranks")), "ranks")


def _wide(docs: DataFrame, doc_id: str, text: str, t: float) -> DataFrame:
    """A row for each line, numbered ``sid``: its text's n_lines, its size n, the hashes k, k2 and the parities of its set, its prefix p, and its keys."""
    keep = ["doc_id", "tk", "n_lines", "line_no", "sid", "u"]
    lines = _lines(docs, doc_id, text).select("doc_id", "tk", "n_lines", "line_no", F.monotonically_increasing_id().alias("sid"), _tokens(F.col("line"), F.col("plain")).alias("u"))

    def number(h: Column) -> Column:
        return F.get(F.col("ranks"), h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).bitwiseOR(h.bitwiseAND(F.lit((1 << _HASH_BITS) - 1)))

    # The subquery's column is used once, and row numbers keep it apart from the tokens, so it becomes a part of the
    # expression and is not copied into each row.
    rows = lines.select(*keep, rarity_table(docs, text).scalar().alias("ranks"))
    rows = rows.select(*keep, F.sort_array(F.transform("u", number)).alias("s"))
    n, u = F.size("u"), lambda i: F.get("u", i)
    prefix = n - F.ceil(n * F.lit(t) - 1e-9).cast("int") + 1
    alone = (n == 0) | (n < (n + 1) * F.lit(t) - 1e-9)  # only equal sets are similar enough
    keys = F.array(F.xxhash64(u(F.lit(0)), u(F.lit(1))), F.xxhash64(u(n - 1), u(n - 2)), F.xxhash64(u(F.lit(0)), u(n - 1)))
    p = F.transform(F.slice("s", F.lit(1), F.when(alone, 0).otherwise(prefix)), lambda x: F.hash(x))
    return rows.select(
        "doc_id", "tk", "n_lines", "line_no", "sid", n.alias("n"), F.xxhash64("u").alias("k"), F.xxhash64(F.lit(1), "u").alias("k2"), p.alias("p"),
        F.expr(_PARITY).alias("sig"), F.when(n > _MANY, F.expr(_PARITY_OF_SOME)).alias("some"), F.when(~alone, keys).alias("keys"),
    )


def _verified(pairs: DataFrame, docs: DataFrame, wide: DataFrame, doc_id: str, text: str, t: float) -> DataFrame:
    """Of each pair (a, b) of lines with Jaccard >= t, on tokens fetched for these lines only, the later one: (sid, doc_id, tk, line_no)."""
    needed = table(pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct(), "needed")
    maybe, _ = split(wide.select("sid", "k", "doc_id", "tk", "line_no"), ["sid"], needed)
    places = table(maybe.join(needed, "sid", "left_semi"), "places")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows, _ = split(rows, ["doc_id"], places.select("doc_id").distinct())
    lines, _ = split(_exploded(rows.select("doc_id", _plain(F.col("text")).alias("plain"), F.split("text", "\n").alias("lines"))), ["doc_id", "line_no"], places)
    # Rows may repeat a doc_id with other texts: of such lines only those of the set itself count.
    tokens = lines.join(places, ["doc_id", "line_no"]).select("sid", "k", F.struct("doc_id", "line_no", "tk", "sid").alias("f"), _tokens(F.col("line"), F.col("plain")).alias("u"))
    tokens = table(tokens, "tokens").where(F.xxhash64("u") == F.col("k"))
    common, place = F.size(F.array_intersect("ua", "ub")), lambda f: F.struct(f"{f}.doc_id", f"{f}.line_no")
    return (
        pairs.join(tokens.select(F.col("sid").alias("a"), F.col("f").alias("fa"), F.col("u").alias("ua")), "a")
        .join(tokens.select(F.col("sid").alias("b"), F.col("f").alias("fb"), F.col("u").alias("ub")), "b")
        .where((place("fb") != place("fa")) & (common >= t * (F.size("ua") + F.size("ub") - common) - 1e-9))
        .select(F.when(place("fb") < place("fa"), F.col("fa")).otherwise(F.col("fb")).alias("f"))
        .select("f.sid", "f.doc_id", "f.tk", "f.line_no")
        .distinct()
    )


#: The parity of the tokens that fall on each of 64 bits, and of those among them with another bit set: together the parities
#: of 128 classes.  Two sets differ in as many tokens as such parities, or more.  Sets of up to ``_MANY`` tokens have the first
#: alone: they may differ in so few tokens that 64 classes tell.
_MANY = 64
_PARITY = "aggregate(s, 0L, (a, x) -> a ^ shiftleft(1L, cast(x & 63 as int)))"
_SOME = ", ".join(["0L"] * 64 + [f"shiftleft(1L, {i})" for i in range(64)])  # a constant: one look a token is cheaper than shifts
_PARITY_OF_SOME = f"aggregate(s, 0L, (a, x) -> a ^ get(array({_SOME}), cast(x & 127 as int)))"
_LOW = (1 << 24) - 1
#: Marks postings of sets that look for earlier ones.
_OPEN = 1 << 62


def _parities(sig: Column, some: Column, other_sig: Column, other_some: Column) -> Column:
    """How many of the parities that two sets have in common differ, of 128 or of 64."""
    every, differ = sig.bitwiseXOR(other_sig), some.bitwiseXOR(other_some)
    return F.coalesce(F.bit_count(differ) + F.bit_count(every.bitwiseXOR(differ)), F.bit_count(every))


def _sized(nx: Column, ny: Column, t: float) -> Column:
    return F.least(nx, ny) >= F.greatest(nx, ny) * t - 1e-9


def _may_differ(nx: Column, ny: Column, t: float) -> Column:
    """In how many tokens similar sets of these sizes differ at most."""
    return (nx + ny) * F.lit((1 - t) / (1 + t)) + 1e-9


def _led(wide: DataFrame, copies: DataFrame, t: float) -> DataFrame:
    """(a, b): sets with one of the smallest doc_id under one of their keys that seems similar, one b for each a."""
    rows = wide.where("keys IS NOT NULL").select("sid", "doc_id", "n", "sig", "some", "keys")
    sets = _marked(rows.select("sid", "keys"), copies.select("sid"), "copy").where("not copy")
    shared = table(sets.select(F.explode("keys").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("w"), "shared_keys")
    maybe, _ = split(rows.select("sid", "doc_id", "n", "sig", "some", F.explode("keys").alias("w")), ["w"], shared)
    keyed = table(maybe.join(copies.select("sid"), "sid", "left_anti"), "keyed")
    of_least = [F.min_by(c, "doc_id").alias(f"h_{c}") for c in ("sid", "n", "sig", "some")]
    heads = keyed.groupBy("w").agg(F.min("doc_id").alias("h_doc"), *of_least, F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    bits = _parities(F.col("sig"), F.col("some"), F.col("h_sig"), F.col("h_some"))
    # As many parities as so many tokens change in the mean, of 128 or of 64.
    half = F.when(F.col("some").isNull() | F.col("h_some").isNull(), 32.0).otherwise(64.0)
    seems = bits <= half * (1 - F.pow(1 - 1 / half, _may_differ(F.col("n"), F.col("h_n"), t))) + 1e-9
    near = keyed.join(heads, "w").where((F.col("h_doc") <= F.col("doc_id")) & (F.col("sid") != F.col("h_sid")) & _sized(F.col("n"), F.col("h_n"), t) & seems)
    return near.groupBy(F.col("sid").alias("a")).agg(F.min_by("h_sid", bits.cast("long")).alias("b"))


def _postings(sets: DataFrame) -> DataFrame:
    """(w, sid, doc_id, at, sig, some) for each prefix token; ``at`` packs whether the set is open, its size and the token's place."""
    rows = sets.select("sid", "doc_id", "n", "sig", "some", "open", F.posexplode("p").alias("i", "w"))
    at = F.shiftleft(F.col("n").cast("long"), 24).bitwiseOR(F.col("i").cast("long"))
    return rows.select("w", "sid", "doc_id", F.when(F.col("open"), at.bitwiseOR(F.lit(_OPEN))).otherwise(at).alias("at"), "sig", "some")


def _candidates(x: DataFrame, y: DataFrame, t: float) -> DataFrame:
    """(a, b): open sets a of the postings ``x`` with the sets b of ``y``, of smaller or equal doc_id, that pass all filters under some token."""
    x, y = x.alias("x"), y.alias("y")
    size = lambda at: F.shiftright(at.bitwiseAND(F.lit(_OPEN - 1)), 24)
    nx, ix, ny, iy = size(F.col("x.at")), F.col("x.at").bitwiseAND(F.lit(_LOW)), size(F.col("y.at")), F.col("y.at").bitwiseAND(F.lit(_LOW))
    overlap = F.ceil((nx + ny) * F.lit(t / (1 + t)) - 1e-9)
    earlier = (F.col("y.doc_id") < F.col("x.doc_id")) | ((F.col("y.doc_id") == F.col("x.doc_id")) & (F.col("y.sid") != F.col("x.sid")))
    asks = F.when(F.col("x.at") >= _OPEN, earlier).otherwise(F.lit(False))  # one term, so that both sides stay one exchange
    differ = _parities(F.col("x.sig"), F.col("x.some"), F.col("y.sig"), F.col("y.some"))
    fits = asks & (differ <= _may_differ(nx, ny, t)) & _sized(nx, ny, t) & (F.least(nx - ix, ny - iy) >= overlap)
    return x.join(y, (F.col("x.w") == F.col("y.w")) & fits).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct()


def _marked(rows: DataFrame, sids: DataFrame, name: str) -> DataFrame:
    """``rows`` with a column that tells whether ``sids`` has their sid; only rows that may be in it are shuffled."""
    maybe, others = split(rows, ["sid"], sids)
    told = maybe.join(sids.select("sid", F.lit(True).alias(name)), "sid", "left")
    return others.withColumn(name, F.lit(False)).union(told.select(*rows.columns, F.coalesce(name, F.lit(False)).alias(name)))


def _judged(docs: DataFrame, wide: DataFrame, doc_id: str, text: str, t: float) -> DataFrame:
    """(doc_id, tk, line_no) of every line to remove, from the table of ``_wide``."""
    wide = wide.where("n > 0")
    # The first line of each set of tokens stands for it; only sets that may have several lines are grouped.
    shared = table(wide.groupBy("k", "k2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("k", "k2"), "shared_sets")
    several = table(split(wide.select("k", "k2", "doc_id", "tk", "line_no", "sid"), ["k", "k2"], shared)[0], "lines_of_shared_sets")
    firsts = several.groupBy("k", "k2").agg(F.min(F.struct("doc_id", "line_no", "sid")).alias("f"))
    copies = several.join(firsts, ["k", "k2"]).where(F.col("sid") != F.col("f.sid"))
    copies = table(copies.select("sid", "doc_id", "tk", "line_no", F.col("f.sid").alias("first"), (F.struct("f.doc_id", "f.line_no") < F.struct("doc_id", "line_no")).alias("later")), "copies")
    led = table(_led(wide, copies, t), "led")
    # Copies and led sets are told apart in one go, and each pass reads the outcome once instead of both sides of the mark.
    told = table(copies.select("sid", F.lit(True).alias("copy")).union(led.select("a", F.lit(False))), "told")
    maybe, others = split(wide.where(F.size("p") > 0).select("sid", "doc_id", "n", "sig", "some", "p"), ["sid"], told)
    opened = maybe.join(told, "sid", "left").where("copy IS NULL OR NOT copy").withColumn("open", F.col("copy").isNull()).drop("copy")
    marked = table(opened.union(others.withColumn("open", F.lit(True))), "marked")
    parts = []
    for part in range(PASSES):  # only a part of the postings is shuffled at a time
        postings = _postings(marked).where(F.pmod("w", F.lit(PASSES)) == part)
        parts.append(table(_candidates(postings, postings, t), "rest"))
    rest = table(reduce(DataFrame.union, parts).distinct(), "rest")
    near = table(_verified(led.union(rest), docs, wide, doc_id, text, t), "near")
    misled = table(led.select(F.col("a").alias("sid")).join(near, "sid", "left_anti"), "misled")
    if not misled.isEmpty():
        asking = split(marked, ["sid"], misled)[0].join(misled, "sid", "left_semi")
        x = table(_postings(asking.withColumn("open", F.lit(True))), "misled_postings")
        y, _ = split(_postings(marked), ["w"], x.select("w").distinct())
        again = table(_candidates(x, y, t), "again")
        near = table(near.union(_verified(again, docs, wide, doc_id, text, t)).distinct(), "near")
    gone = copies.where("later").select("doc_id", "tk", "line_no")
    beside = copies.where("not later").join(near.select(F.col("sid").alias("first")), "first", "left_semi").select("doc_id", "tk", "line_no")  # rows that repeat a doc_id
    return gone.union(beside).union(near.select("doc_id", "tk", "line_no")).distinct()


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", t: float = THRESHOLD) -> DataFrame:
    """(doc_id, line_no) of every line to remove.

    A line of at least one word goes if some earlier line of the input, by (doc_id, line_no), has tokens of Jaccard
    similarity >= ``t``; lines are judged on the input, not on what is left.  Of equal lines the first stays.  Lines of
    equal place (rows that repeat a doc_id) do not remove each other.  Rows with a null id or text have no part in this;
    empty texts and lines without a word are never removed; a very long text is one row of its lines; an empty table
    gives no rows.
    """
    return _judged(docs, table(_wide(docs, doc_id, text, t), "wide_lines"), doc_id, text, t).select("doc_id", "line_no").distinct()


def _removed(docs: DataFrame, wide: DataFrame, doc_id: str, text: str, t: float) -> DataFrame:
    gone = _judged(docs, wide, doc_id, text, t)
    return table(gone.groupBy(F.col("doc_id").alias("_doc"), F.col("tk").alias("_tk")).agg(F.sort_array(F.collect_list("line_no")).alias("_gone")), "removed")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", t: float = THRESHOLD) -> DataFrame:
    """``docs`` with the lines of ``repeated_lines`` cut out of ``text``; other columns, null texts and row count stay.

    A text of which every line goes becomes empty; an empty table stays empty.  Where rows share a doc_id but not their
    text, each loses its own repeated lines only.  Extra columns may have any name but ``_row``, ``_doc``, ``_tk`` and ``_gone``.
    """
    removed = _removed(docs, table(_wide(docs, doc_id, text, t), "wide_lines"), doc_id, text, t)
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{doc_id}`").cast("long").alias("_doc"), F.xxhash64(F.col(f"`{text}`")).alias("_tk"))
    maybe, clean = split(d, ["_doc", "_tk"], removed)
    joined = maybe.join(removed, ["_doc", "_tk"], "left").select("_row", "_gone").union(clean.select("_row", F.lit(None).cast("array<int>").alias("_gone")))
    value = F.col(f"_row.`{text}`")
    left = F.array_join(F.filter(F.split(value, "\n"), lambda _, i: ~F.array_contains(F.col("_gone"), i)), "\n")
    new = F.when(F.col("_gone").isNull(), value).otherwise(left)
    return joined.select(*[new.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many of them go, and their numbers.  A null text has no lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wide = table(_wide(docs, "doc_id", "text", THRESHOLD), "wide_lines")
    removed = _removed(docs, wide, "doc_id", "text", THRESHOLD)
    # Every text has a first line, which tells their number; rows without an id or a text are not among the lines.
    others = docs.where("doc_id IS NULL OR text IS NULL")
    counts = others.select("doc_id", F.xxhash64("text").alias("tk"), F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
    counts = counts.union(wide.where("line_no = 0").select("doc_id", "tk", F.col("n_lines").cast("long")))
    joined = counts.join(removed, (F.col("doc_id") == F.col("_doc")) & (F.col("tk") == F.col("_tk")), "left")
    gone = F.coalesce(F.col("_gone"), F.array().cast("array<int>"))
    return joined.select("doc_id", "n_lines", F.size(gone).cast("long").alias("n_removed"), F.array_join(gone.cast("array<string>"), ",").alias("removed_lines"))


SQL = r"""
WITH ln AS (
  SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
tk AS (
  SELECT doc_id, line_no, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS s FROM ln),
st AS (
  SELECT row_number() OVER () AS k, s, len(s) AS n, min((doc_id, line_no)) AS f FROM tk WHERE len(s) >= 1 GROUP BY s),
wd AS (SELECT k, n, f, unnest(s) AS w FROM st),
df AS (SELECT w, count(*) AS c FROM wd GROUP BY w),
px AS (
  SELECT k, n, f, w FROM (SELECT k, n, f, wd.w, row_number() OVER (PARTITION BY k ORDER BY c, wd.w) AS i FROM wd JOIN df USING (w) WHERE c > 0)
  WHERE i <= n - ceil(n * 0.8 - 1e-9) + 1),
cd AS (
  SELECT DISTINCT x.k AS a, y.k AS b FROM px x JOIN px y ON x.w = y.w
  WHERE y.f < x.f AND least(x.n, y.n) >= 0.8 * greatest(x.n, y.n) - 1e-9),
pr AS (
  SELECT cd.a AS k FROM cd JOIN wd x ON x.k = cd.a JOIN wd y ON y.k = cd.b AND y.w = x.w
  GROUP BY cd.a, cd.b, x.n, y.n HAVING count(*) >= 0.8 * (x.n + y.n - count(*)) - 1e-9),
gone AS (
  SELECT tk.doc_id, tk.line_no FROM tk JOIN st ON tk.s = st.s WHERE st.k IN (SELECT DISTINCT k FROM pr) OR st.f < (tk.doc_id, tk.line_no)),
per AS (SELECT doc_id, count(*) AS c, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS r FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(c, 0)::BIGINT AS n_removed,
       coalesce(r, '') AS removed_lines
FROM documents d LEFT JOIN per USING (doc_id)
"""
