"""Descriptions of strategies: text templates per language, filled in with parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXTS = ("concept", "long", "short", "regime")


def read_strategies(spark: SparkSession, path: str) -> DataFrame:
    """(strategy, lang, concept, long, short, regime) of JSON files: an object by strategy, then by language; what a text
    lacks is empty."""
    kind = f"map<string, map<string, struct<{', '.join(f'{t}:string' for t in TEXTS)}>>>"
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("strategy", "langs"))
    rows = whole.select("strategy", F.explode("langs").alias("lang", "t"))
    return rows.select("strategy", "lang", *[F.coalesce(F.col(f"t.{t}"), F.lit("")).alias(t) for t in TEXTS])


def explained(templates: DataFrame, rsi_ob: int = 70, sma_main_len: int = 200, sma1_len: int = 20, sma2_len: int = 60) -> DataFrame:
    """``templates`` with the names in braces in ``long`` and ``short`` replaced by their values; rsi_os is 100 - rsi_ob."""
    values = {"rsi_ob": rsi_ob, "rsi_os": 100 - rsi_ob, "sma_main_len": sma_main_len, "sma1_len": sma1_len, "sma2_len": sma2_len}
    out = templates
    for name, value in values.items():
        out = out.withColumns({c: F.replace(F.col(c), F.lit("{" + name + "}"), F.lit(str(value))) for c in ("long", "short")})
    return out
