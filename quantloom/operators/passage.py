"""First passage: the first bar after an event at which a level is reached, by a tree of block extremes.

A node of level 1 holds ``FAN`` bars, a node of level j + 1 holds ``FAN`` nodes of level j; each child carries its least
low, its greatest high, and whether one of its bars ends a trade by itself.  An event looks at the node round its first bar
at each level (only at children after its own), which names the first child that reaches a level, and goes down from
there, one node per level.  So an event meets as many rows as the tree has levels, twice, whatever the horizon: two levels
up to 1,024 bars, three up to 32,768.  All joins are equi-joins on (series, level, node).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.windows import KEYS

FAN = 32


def levels_for(horizon: int) -> int:
    """Levels of which two neighbouring nodes at the top cover any ``horizon`` bars."""
    levels = 1
    while FAN**levels < horizon:
        levels += 1
    return levels


def tree(bars: DataFrame, levels: int, keys: list[str], columns: list[str], flag: Column | None = None) -> DataFrame:
    """(keys, level, node, kids) over bars with bar_no, low and high; children of level 1 carry their bar's ``columns``.

    All levels come from one pass: a bar counts towards its child at each level, which map-side combine adds up.
    """
    bar = F.struct(F.col("bar_no").cast("long").alias("no"), *columns)
    ends = F.coalesce(flag if flag is not None else F.lit(False), F.lit(False))
    places = F.array(*[F.struct(F.lit(j).alias("level"), F.floor(F.col("bar_no") / FAN ** (j - 1)).cast("long").alias("at")) for j in range(1, levels + 1)])
    each = bars.select(*keys, F.col("low").alias("lo"), F.col("high").alias("hi"), ends.alias("ends"), bar.alias("bar"), F.explode(places).alias("place"))
    own = each.groupBy(*keys, F.col("place.level").alias("level"), F.floor(F.col("place.at") / FAN).alias("node"), F.col("place.at").alias("at")).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_or("ends").alias("ends"), F.first(F.when(F.col("place.level") == 1, F.col("bar"))).alias("bar")
    )
    return own.groupBy(*keys, "level", "node").agg(F.sort_array(F.collect_list(F.struct("at", "lo", "hi", "ends", "bar"))).alias("kids"))


def looked_at(levels: int) -> Column:
    """The nodes that an event from bar _from to bar _to looks at first: (level, node, after), children up to ``after`` left out."""
    of = lambda no, level: F.floor(F.col(no) / FAN**level).cast("long")
    look = lambda level, node, after: F.struct(F.lit(level).alias("level"), node.alias("node"), after.cast("long").alias("after"))
    out = [look(1, of("_from", 1), F.col("_from") - 1)]
    out += [F.when(of("_from", j - 1) != of("_to", j - 1), look(j, of("_from", j), of("_from", j - 1))) for j in range(2, levels + 1)]
    out.append(F.when(of("_from", levels) != of("_to", levels), look(levels, of("_from", levels) + 1, F.lit(-1))))
    out.append(F.when(of("_from", 1) != of("_to", 1), look(1, of("_to", 1), of("_to", 0))))  # for the bar at the end
    return F.array_compact(F.array(*out))


def first_passage(events: DataFrame, bars: DataFrame, horizon: int, low: Column, high: Column, columns: list[str], keys: list[str] = KEYS, flag: Column | None = None) -> DataFrame:  # noqa: B006
    """``events`` with the bar at which each ends: f_{column} of the first bar from _from to _to whose low is at most
    ``low`` or high at least ``high`` or that has the ``flag``; else of the bar at _to.  ``met`` tells which, ``offset``
    how far it is from the event.

    Events have the keys, bar_no, _from and _to (a bar that exists, at most ``horizon`` bars from _from on); their rows
    are distinct.  Null prices reach nothing, null keys match nothing.
    """
    levels = levels_for(horizon)
    nodes = tree(bars, levels, keys, columns, flag)
    reaches = lambda kid: F.coalesce((kid["lo"] <= F.col("_low")) | (kid["hi"] >= F.col("_high")) | kid["ends"], F.lit(False))

    def first(level: Column, after: Column) -> Column:
        kid = F.get(F.filter("kids", lambda k: (k["at"] > after) & reaches(k)), F.lit(0))
        scale = F.pow(F.lit(float(FAN)), level - 1).cast("long")
        return F.when(kid.isNotNull(), F.struct((kid["at"] * scale).alias("start"), (level - 1).alias("level"), kid["at"].alias("at"), kid["bar"].alias("bar")))

    out = events.withColumns({"_low": low, "_high": high})
    own = out.columns
    looks = out.withColumn("_look", F.explode(looked_at(levels))).select(*own, F.col("_look.level").alias("level"), F.col("_look.node").alias("node"), "_look.after")
    met = looks.join(nodes, [*keys, "level", "node"])
    at_end = F.get(F.filter("kids", lambda k: (F.col("level") == 1) & (k["at"] == F.col("_to"))), F.lit(0))["bar"]
    met = met.withColumns({"_found": first(F.col("level"), F.col("after")), "_last": at_end})
    out = met.groupBy(*own).agg(F.min_by("_found", F.col("_found.start")).alias("_found"), F.first("_last", ignorenulls=True).alias("_last"))
    for level in range(levels - 1, 0, -1):
        down = F.col("_found.level") == level
        out = out.withColumns({"level": F.when(down, F.lit(level)), "node": F.when(down, F.col("_found.at"))}).join(nodes, [*keys, "level", "node"], "left")
        out = out.withColumn("_found", F.when(F.col("node").isNotNull(), first(F.lit(level), F.lit(-1))).otherwise(F.col("_found"))).drop("level", "node", "kids")
    inside = F.coalesce(F.col("_found.start") <= F.col("_to"), F.lit(False))
    out = out.withColumn("met", inside).withColumn("_bar", F.when(F.col("met"), F.col("_found.bar")).otherwise(F.col("_last")))
    out = out.withColumns({"offset": (F.col("_bar.no") - F.col("bar_no")).cast("int"), **{f"f_{c}": F.col(f"_bar.{c}") for c in columns}})
    return out.drop("_low", "_high", "_found", "_last", "_bar")
