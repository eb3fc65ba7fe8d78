"""Trade journal and presets kept as Parquet and JSON in a folder that the cluster shares."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The names of the columns.
_TEXT = ("datetime", "symbol", "timeframe", "direction", "strategy_id")
JOURNAL_SCHEMA = ", ".join([
    "id bigint", *[f"{c} string" for c in _TEXT], *[f"{c} double" for c in ("size", "entry_price", "exit_price", "pnl_pct", "r_multiple")],
    *[f"{c} string" for c in ("outcome", "emotion", "tags", "mistakes", "notes", "created_at")],
])
PRESET_SCHEMA = "coin string, interval string, strat_id string, direction string, params map<string,double>"
#: What a change has beside a journal's columns: the place of a new row in its change, and whether the id is gone.
_CHANGE = f"{JOURNAL_SCHEMA}, place bigint, gone boolean"
_NAME = re.compile(r"(\d{8})-(\d+)-(\d+)-(add|end|all)-[0-9a-f]{32}")


class _Change(NamedTuple):
    number: int
    base: int  # the largest id before it
    top: int  # and after it
    kind: str  # add: new or changed rows, end: ids that are gone, all: the rows as they then were
    folder: str


class Journal:
    """A log of changes below ``path``: each insert, update or delete appends one folder with just its own rows.

    A folder's name has its number, the largest ids before and after it and its kind, so a writer learns what it needs from
    a listing, and new rows are stored by their place and get their ids from the name: nothing is read or written again
    when another writer comes first.  Readers take each id's newest change since the newest compaction.

    A change's number is claimed by creating a file that must not exist yet; who loses the claim takes the next number, so
    no change is lost and none is applied twice.  Local and HDFS folders create files so; an object store may not, and then
    needs one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._hadoop = jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(conf)

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _changes(self) -> list[_Change]:
        """All published changes by number."""
        root = self._hadoop.Path(self.path)
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(_Change(int(m[1]), int(m[2]), int(m[3]), m[4], n) for n in names if (m := _NAME.fullmatch(n)))

    def _live(self, changes: list[_Change]) -> list[_Change]:
        """The newest compaction and what came after it."""
        starts = [i for i, c in enumerate(changes) if c.kind == "all"]
        return changes[starts[-1] :] if starts else changes

    def rows(self) -> DataFrame:
        """The journal as it is: each id's newest change, without those that are gone."""
        return self._read(self._live(self._changes()))

    def _read(self, changes: list[_Change]) -> DataFrame:
        if not changes:
            return self.spark.createDataFrame([], JOURNAL_SCHEMA)
        stored = self.spark.read.schema(_CHANGE).parquet(*[f"{self.path}/{c.folder}" for c in changes])
        name = F.split(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2), "-")
        rows = stored.withColumns({"_number": name[0].cast("bigint"), "id": F.coalesce("id", name[1].cast("bigint") + F.col("place"))})
        if all(c.kind == "add" and c.top > c.base for c in changes):  # every id is new
            newest = rows
        else:
            fields = F.struct(*[c for c in rows.columns if c not in ("id", "_number")])
            newest = rows.groupBy("id").agg(F.max_by(fields, "_number").alias("r")).select("id", "r.*")
        return newest.where("NOT coalesce(gone, false)").drop("gone", "place", "_number")

    def _write(self, rows: DataFrame, name: str) -> str:
        """Stores rows under a name that no reader looks at."""
        folder = f"{name}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def _publish(self, staged: str, kind: str, added: int = 0, still: Callable[[list[_Change]], bool] = lambda changes: True, patience: float = 60.0) -> bool:
        """Gives a stored folder the next number; False, and the folder goes, if ``still`` does not hold for what is there.

        ``patience`` seconds after a claim without a change its writer counts as lost.
        """
        while still(changes := self._changes()):
            number, top = (changes[-1].number, changes[-1].top) if changes else (0, 0)
            target, waited = number + 1, 0.0
            while not self._claim(target) and self._changes() == changes:
                if waited >= patience:
                    target, waited = target + 1, 0.0
                    continue
                time.sleep(0.2)
                waited += 0.2
            name = f"{target:08d}-{top}-{top + added}-{kind}-{staged.rpartition('-')[2]}"
            if self._changes() == changes and self._fs.rename(self._at(staged), self._at(name)):
                return True
        self._fs.delete(self._at(staged), True)
        return False

    def _claim(self, number: int) -> bool:
        return self._fs.createNewFile(self._at(f"{number:08d}.claim"))

    def _whole(self, new: DataFrame, names: list[str]) -> DataFrame:
        kinds = {f.name: f.dataType for f in self.spark.createDataFrame([], _CHANGE).schema}
        return new.select(*[(F.col(c) if c in new.columns and c in names else F.lit(None)).cast(kinds[c]).alias(c) for c in kinds])

    def insert(self, new: DataFrame) -> None:
        """Adds rows; missing columns are null, ids go on from the largest in the order of the columns.

        The rows are sorted and stored once, then numbered from what was stored: a lost executor cannot deal them out anew.
        """
        names = [f.name for f in self.spark.createDataFrame([], JOURNAL_SCHEMA).schema if f.name != "id"]
        ordered = self._whole(new, names).sort(*[F.col(c).asc_nulls_first() for c in names])
        raw = self._write(ordered.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "raw")
        stored = self.spark.read.parquet(f"{self.path}/{raw}")
        before, total = {}, 0
        for part, n in sorted(stored.groupBy("_part").count().collect()):  # a row for each partition
            before[part], total = total, total + n
        if total:
            offset: Column = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_part"))
            nth = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
            staged = self._write(stored.withColumn("place", (offset + nth).cast("bigint")).drop("_part", "_at"), "new")
            self._publish(staged, "add", total)
        self._fs.delete(self._at(raw), True)

    def update(self, rows: DataFrame) -> None:
        """Puts rows with ids in place of those that have the ids; columns that are missing become null."""
        self._publish(self._write(self._whole(rows.where("id IS NOT NULL"), rows.columns), "new"), "add")

    def delete(self, ids: list[int]) -> None:
        """Marks ids as gone; those that nothing has are passed over."""
        marks = self.spark.createDataFrame([(i,) for i in ids], "id bigint").withColumn("gone", F.lit(True))
        self._publish(self._write(self._whole(marks, marks.columns), "new"), "end")

    def compact(self) -> None:
        """Writes the rows as they are as one change, from which readers start; again, if another change comes first."""
        while changes := self._changes():
            rows = self._read(self._live(changes))
            if self._publish(self._write(self._whole(rows, rows.columns), "new"), "all", 0, lambda now, then=changes: now == then):
                return

    def vacuum(self) -> None:
        """Removes changes that the newest compaction holds; readers that listed them before fail."""
        changes = self._changes()
        for change in changes[: len(changes) - len(self._live(changes))]:
            self._fs.delete(self._at(change.folder), True)

    def import_csv(self, path: str) -> None:
        """Rows of a CSV journal that are not there yet, compared without id."""
        old = self.spark.read.csv(path, header=True)
        have = self.rows()
        names = [c for c in have.columns if c != "id" and c in old.columns]
        fresh = old.select(*[F.expr(f"try_cast(`{c}` AS {have.schema[c].dataType.simpleString()})").alias(c) for c in names]).distinct()
        self.insert(fresh.exceptAll(have.select(*names)))

    def totals(self) -> DataFrame:
        return self.rows().agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pnl_pct") > 0).alias("wins"), F.count_if(F.col("pnl_pct") < 0).alias("losses"), F.sum("pnl_pct").alias("total_pnl"))


def read_presets(spark: SparkSession, path: str) -> DataFrame:
    """(name, coin, interval, strat_id, direction, params) of a JSON object of presets by name."""
    whole = spark.read.text(path, wholetext=True)
    kind = f"map<string, struct<{', '.join(f.name + ':' + f.dataType.simpleString() for f in spark.createDataFrame([], PRESET_SCHEMA).schema)}>>"
    entries = whole.select(F.explode(F.from_json("value", kind)).alias("name", "p"))
    return entries.select("name", "p.*")


def write_presets(presets: DataFrame, path: str) -> None:
    """Presets as JSON text, one object by name (a few dozen rows)."""
    fields = F.struct("coin", "interval", "strat_id", "direction", "params")
    presets.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", fields)))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def delete_presets(presets: DataFrame, names: list[str]) -> DataFrame:
    """``presets`` without the named ones."""
    return presets.where(~F.col("name").isin(names))
