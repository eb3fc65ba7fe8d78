"""URL filter: prefix rules, then logistic regression on hashed character n-grams of host and path.

The model is fitted on a small labelled table of URLs (``labelled_urls.csv``, or any other): it knows trades by the words
in their hosts and paths, so a host of blocked words it has met in other hosts is blocked, and one of unknown words is
not.  Scoring is a row's work: no shuffle.
"""

from __future__ import annotations

import csv
import hashlib
from pathlib import Path
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.extraction import host_of
from quantloom.llm.quality import _let

GRAMS = (3, 4, 5)
FEATURES = 1 << 17
#: Rows of the labelled table that a model is fitted on, at most; the first by url and label.
MAX_LABELLED = 20_000
BLOCK_AT = 0.5


class Rule(NamedTuple):
    """``host/path`` prefix with its verdict; it fits the host and all its subdomains."""

    prefix: str
    verdict: str


# The rules of the contract.
RULES = (
    Rule("com/en/", "block"),
    Rule("example.com/en/7", "allow"),
    Rule("net/de/", "allow"),
    Rule("example.net/de/8", "block"),
    Rule("org/es/", "block"),
)

#: The small labelled table: URLs of many shapes, written by hand, under names that are in none of the test tables.
LABELLED = Path(__file__).with_name("labelled_urls.csv")


def labelled_urls(spark: SparkSession, path: str | Path = LABELLED) -> DataFrame:
    """(url, label) of a small CSV file that the driver reads; label 1 for what is to be blocked."""
    with open(path, encoding="utf-8", newline="") as file:
        rows = [(r["url"], int(r["label"])) for r in csv.DictReader(file)]
    return spark.createDataFrame(rows, "url string, label int")


def path_of(url: Column) -> Column:
    """Path of a URL: what follows the host, up to '?' or '#'; empty for null or without '://'."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _grams(tag: str, n: int):
    """From an array of characters to its different n-grams; finding the i-th character of a string would take i steps."""
    return lambda c: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(F.lit(tag), *[F.get(c, i + j) for j in range(n)])))


def grams_of(host: Column, path: Column, sizes: tuple[int, ...] = GRAMS) -> Column:
    """Different character n-grams of host and path, the host's between '^' and '$'."""

    def of(text: Column, tag: str) -> Column:
        one = [F.when(F.length(text) >= n, _let(F.split(text, ""), _grams(tag, n))).otherwise(F.array().cast("array<string>")) for n in sizes]
        return F.concat(*one)

    return F.concat(of(F.concat(F.lit("^"), host, F.lit("$")), "h"), of(path, "p"))


def _features(rows: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="_features").transform(rows.withColumn("_grams", grams_of(F.col("host"), F.col("path"))))


def train(labelled: DataFrame, max_rows: int = MAX_LABELLED, strength: float = 0.01) -> LogisticRegressionModel:
    """Model fitted on the first ``max_rows`` rows of (url, label); rows with a null in either are left out, repeated rows count each time."""
    rows = labelled.where("url IS NOT NULL AND label IS NOT NULL").orderBy("url", "label").limit(max_rows)
    rows = rows.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("label").cast("double").alias("label"))
    return LogisticRegression(featuresCol="_features", regParam=strength, maxIter=50, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y").fit(_features(rows.coalesce(1)))


def rule_columns(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(longest fitting rule's prefix, its verdict), null where none fits."""
    prefix, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.prefix), r.prefix)):  # the longest ends outermost
        name, _, rest = rule.prefix.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        prefix, verdict = F.when(fits, F.lit(rule.prefix)).otherwise(prefix), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return prefix, verdict


def judge_urls(pages: DataFrame, model: LogisticRegressionModel, rules: tuple[Rule, ...] = RULES, page_id: str = "page_id", url: str = "url", block_at: float = BLOCK_AT) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row.

    The longest rule that fits decides; else the model's probability of block, ``score``, at ``block_at`` or more
    blocks.  A null url, or one without '://', has an empty host and path and is judged by the model on those.  A very
    long url is judged whole.  Repeated rows are judged alike; an empty table gives an empty result; other columns are
    not read, whatever their names.
    """
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(_features(rows))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    score = F.get(vector_to_array("_p"), F.lit(1))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(score >= block_at, "block").otherwise("allow")).alias("verdict"), score.alias("score"))


_FITTED: dict[tuple[str, str], LogisticRegressionModel] = {}


def default_model(spark: SparkSession) -> LogisticRegressionModel:
    """The model of ``LABELLED``, fitted once for each content of the file in a Spark application."""
    key = spark.sparkContext.applicationId, hashlib.sha256(LABELLED.read_bytes()).hexdigest()
    if key not in _FITTED:
        _FITTED[key] = train(labelled_urls(spark))
    return _FITTED[key]


def query(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's url, null and repeated ones too."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), default_model(spark))
