"""Quality rules with host-level verdicts (DataFrame functions only).

Rules judge each text; a host whose shrunken failure rate is high rejects all of its documents.  Per-text counts come
from array functions inside the row, so the text is never shuffled: only (host, failures, documents) is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.scratch import table

WHITE = " \t\n\x0b\f\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
HOST_FAIL_RATE = 0.6
#: Distinct repeated windows up to which positions are found by looking each window up in their list.
_FEW = 12


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than space and U+0009..U+000D; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _repeat_words(hashes: Column) -> Column:
    """Words in three-word windows found twice or more, from the windows' hashes in order."""
    none = F.array().cast("array<int>")

    def positions(s: Column) -> Column:
        twice = F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1))))

        def by_lookup(d: Column) -> Column:
            return F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: F.array_contains(d, F.get(hashes, i)))

        def by_sort() -> Column:
            pairs = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
            return _let(
                pairs,
                lambda p: F.sort_array(
                    F.transform(
                        F.filter(p, lambda q, k: (q["x"] == F.get(p, k - 1)["x"]).eqNullSafe(True) | (q["x"] == F.get(p, k + 1)["x"]).eqNullSafe(True)),
                        lambda q: q["i"],
                    )
                ),
            )

        return _let(twice, lambda d: F.when(F.size(d) == 0, none).when(F.size(d) <= _FEW, by_lookup(d)).otherwise(by_sort()))

    at = F.when(F.size(hashes) < 2, none).otherwise(_let(F.sort_array(hashes), positions))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        at,
        start,
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def rule_features(df: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """``keep`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed for each row."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    counts = df.select(
        F.struct(*keep).alias("_keep"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.inline(F.array(F.struct(words_of(F.col(text)).alias("_words")))),
    )
    w = F.col("_words")
    windows = F.when(
        F.size(w) < 3, F.array().cast("array<bigint>")
    ).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    counts = counts.select(
        "_keep",
        "n_symbols",
        "n_dup_lines",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.inline(F.array(F.struct(windows.alias("_windows")))),
    )
    out = counts.select("_keep.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", _repeat_words(F.col("_windows")).alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_verdicts(features: DataFrame, host: str, max_rate: float = HOST_FAIL_RATE) -> DataFrame:
    """(host, n_docs, n_failed, fail_rate, host_rejected) with rates shrunk by an empirical beta prior.

    The prior's mean m is the overall failure rate; its strength k = m(1-m)/v - 1, v the variance of the hosts' raw
    rates, held within 1..1000 (1000 where v is 0 or there is one host).  fail_rate = (n_failed + m k)/(n_docs + k).
    Rows with a null host belong to no host.
    """
    per = (
        features.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    )
    per = table(per, "hosts")
    prior = per.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("m"), F.var_samp(F.col("n_failed") / F.col("n_docs")).alias("v")
    ).select("m", F.when(F.coalesce(F.col("v"), F.lit(0.0)) <= 0, F.lit(1000.0)).otherwise(F.least(F.lit(1000.0), F.greatest(F.lit(1.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1))).alias("k"))
    m, k = (prior.first() or (None, None))[:2]  # one row of two numbers
    rate = (F.col("n_failed") + F.lit((m or 0.0) * k)) / (F.col("n_docs") + F.lit(k))
    return per.withColumn("fail_rate", rate).withColumn("host_rejected", rate > max_rate)


def judge(docs: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None, max_rate: float = HOST_FAIL_RATE) -> DataFrame:
    """Rule counts, base_failed, host_rejected and kept of each row of ``docs``, with its columns ``keep`` (all by default).

    Null or empty text has no words and fails; a null host is judged by its own text alone; repeated rows are judged
    alike; an empty table gives an empty result; a text is one row however long.  Columns pass through inside ``_row``,
    so their names clash with nothing.  ``kept`` is false where the rules fail or the host is rejected.  Windows are told
    apart by 64-bit hashes.
    The counts are written once to the shared folder and used twice.
    """
    names = docs.columns if keep is None else keep
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")
    features = table(rule_features(docs, text, [row, F.col(f"`{host}`").alias("_host")]), "features")
    bad = table(host_verdicts(features, "_host", max_rate).where("host_rejected").select(F.col("host").alias("_host"), F.lit(True).alias("_bad")), "bad_hosts")
    judged = features.join(bad, "_host", "left")
    rejected = F.coalesce(F.col("_bad"), F.lit(False))
    return judged.withColumn("host_rejected", rejected).withColumn("kept", ~F.col("base_failed") & ~rejected)


def query(spark, sf_dir: str) -> DataFrame:
    """Rule counts and verdict of every document; a null text has no words and fails."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = judge(docs, keep=["doc_id"])
    return out.select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tri AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
ln AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
base AS (
  SELECT w.rid, w.doc_id, w.source, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ln.l) - len(list_distinct(ln.l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN ln USING (rid) LEFT JOIN cov USING (rid)),
judged AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM base),
host AS (SELECT source, count(*) AS n, sum(base_failed::BIGINT) AS f FROM judged WHERE source IS NOT NULL GROUP BY source),
prior AS (
  SELECT sum(f)::DOUBLE / sum(n) AS m,
         CASE WHEN coalesce(var_samp(f::DOUBLE / n), 0) <= 0 THEN 1000.0
              ELSE least(1000.0, greatest(1.0, (sum(f)::DOUBLE / sum(n)) * (1 - sum(f)::DOUBLE / sum(n)) / var_samp(f::DOUBLE / n) - 1)) END AS k
  FROM host),
bad AS (SELECT source FROM host, prior WHERE (f + m * k) / (n + k) > 0.6)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad))) AS kept
FROM judged
"""
