"""Keep rows that cannot match out of a shuffle, by a bit table of bounded size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The bit table has at most 2**MAX_BITS bits, in at most 2**(MAX_BITS - 6) broadcast rows.
MAX_BITS = 26


def split(rows: DataFrame, keys: list[str], needed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose keys may be in ``needed``, rows whose keys are certainly not), columns unchanged.

    ``needed`` (a table with the same key columns) becomes a table of hashed bits, eight for each of its rows until
    the bound is met; past that more rows pass the first test, never fewer.  Null keys are never in ``needed``.
    """
    bits = min(MAX_BITS, max(10, math.ceil(math.log2(8 * max(1, needed.count())))))
    spot = F.xxhash64(*keys).bitwiseAND(F.lit((1 << bits) - 1))
    one = F.expr("shiftleft(1L, cast(_spot & 63 as int))")
    table = needed.select(spot.alias("_spot")).groupBy(F.shiftright("_spot", 6).alias("_word")).agg(F.bit_or(one).alias("_bits"))
    marked = rows.withColumn("_spot", spot).withColumn("_word", F.shiftright("_spot", 6)).join(F.broadcast(table), "_word", "left")
    hit = F.coalesce(F.expr("shiftrightunsigned(_bits, cast(_spot & 63 as int)) & 1L = 1L"), F.lit(False))
    return marked.where(hit).select(*rows.columns), marked.where(~hit).select(*rows.columns)
