"""Ordered and keyed work that stays spread out when one group holds much of the data.

`Window.partitionBy(key)` puts a whole key into one task, which is wrong once one team, race or year holds a third of
all rows. The helpers here never do that: rows are range-partitioned on (key, order) into as many slices as the session
has shuffle partitions, the slices are written to the checkpoint folder, each slice is scanned on its own, and what the
earlier slices contribute is added from a table with at most one row per slice, which is written as well. There is one way of working for all
sizes of data.
"""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: So many rows of one side of a join, at most, are sent to every task.
MOST_SENT = 10_000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which every executor can reach.

    Only a local session that names no folder gets one of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="echelon-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """What is run here gives back the disk of its shuffles when it ends, not when the driver happens to collect its garbage.

    For frames that nothing runs again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder of the session; the shuffles behind it leave the disks."""
    shared_folder(df.sparkSession)
    with shuffles_released(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan of its own, so that no one else holds its shuffles


def let_go(spark: SparkSession) -> None:
    """Ask for the garbage of the driver, after a step that wrote much and needs little of it from here on.

    Spark deletes checkpoints (with `spark.cleaner.referenceTracking.cleanCheckpoints`) and broadcasts when the driver finds them
    unused, which an idle driver seldom looks for. Frees nothing that is still in use.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def few(df: DataFrame) -> DataFrame:
    """One side of a join, written: mostly a handful of rows (teams of a season, categories) that very many rows are joined with.

    At most MOST_SENT rows are sent to the tasks, so that the other side stays where it is; more of them are met through shuffles.
    """
    kept = checkpointed(df)
    return F.broadcast(kept) if kept.limit(MOST_SENT + 1).count() <= MOST_SENT else shuffled(kept)


def _same(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(and_, [left[a].eqNullSafe(right[b]) for a, b in pairs])


class Arranged:
    """Rows in a total order within each key, ready for running and whole-group values."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> None:
        self.df = df
        self.keys = list(keys)
        self.order = list(order)

    def _with(self, df: DataFrame) -> "Arranged":
        return Arranged(df, self.keys, self.order)

    def _groups(self, within: Sequence[str]) -> list[str]:
        return ["_slice", *self.keys, *within]

    def with_columns(self, columns: dict[str, Column]) -> "Arranged":
        return self._with(self.df.withColumns(columns))

    def running(self, name: str, how: str, value: Column, inclusive: bool = True, within: Sequence[str] = ()) -> "Arranged":
        """Running `sum` or `max`; `within` may name columns that never decrease along the order."""
        return self.runnings({name: value}, how, inclusive, within)

    def runnings(self, columns: dict[str, Column], how: str = "sum", inclusive: bool = True, within: Sequence[str] = ()) -> "Arranged":
        """Several running values of the same kind, in one pass: name -> value."""
        combine = {"sum": F.sum, "max": F.max}[how]
        frame = (
            Window.partitionBy(*self._groups(within))
            .orderBy(*self.order)
            .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        )
        local = {name: combine(value).over(frame) for name, value in columns.items()}
        carry = self._carry({name: combine(value) for name, value in columns.items()}, combine, within)
        merged = self._attach_to_first(self.df.withColumns(local), carry, within)
        if how == "sum":
            result = {name: F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(f"_carry_{name}"), F.lit(0)) for name in columns}
        else:
            result = {name: F.greatest(F.col(name), F.col(f"_carry_{name}")) for name in columns}
        return self._with(merged.withColumns(result).drop(*[f"_carry_{name}" for name in columns]))

    def _carry(self, aggregates: dict[str, Column], combine, within: Sequence[str]) -> DataFrame:
        # Only the first group of a slice can continue one from an earlier slice, so at
        # most one row per slice is left after the filter: safe to broadcast.
        earlier = (
            Window.partitionBy(*self.keys, *within)
            .orderBy("_slice")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        per_slice = self.df.groupBy(*self._groups(within)).agg(*[value.alias(f"_part_{name}") for name, value in aggregates.items()])
        carried = per_slice.withColumns({f"_carry_{name}": combine(f"_part_{name}").over(earlier) for name in aggregates})
        known = F.coalesce(*[F.col(f"_carry_{name}").cast("string") for name in aggregates])
        # Written, since the rows are read for it and again for what follows: unwritten, every running value doubles the plan.
        return checkpointed(carried.where(known.isNotNull()).drop(*[f"_part_{name}" for name in aggregates]))

    def _attach(self, df: DataFrame, extra: DataFrame, within: Sequence[str]) -> DataFrame:
        names = self._groups(within)
        renamed = extra.withColumnsRenamed({name: f"_r_{name}" for name in names})
        joined = df.join(F.broadcast(renamed), _same(df, renamed, [(n, f"_r_{n}") for n in names]), "left")
        return joined.drop(*[f"_r_{n}" for n in names])

    def _attach_to_first(self, df: DataFrame, carry: DataFrame, within: Sequence[str]) -> DataFrame:
        # At most one row per slice, so the slice alone finds it. A key of one number takes the driver a megabyte, one of
        # several columns a whole memory page, however few the rows are.
        names = self._groups(within)
        renamed = carry.withColumnsRenamed({name: f"_r_{name}" for name in names})
        joined = df.join(F.broadcast(renamed), F.col("_slice") == F.col("_r__slice"), "left")
        same = reduce(and_, [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names])
        values = {c: F.when(same, F.col(c)) for c in carry.columns if c not in names}
        return joined.withColumns(values).drop(*[f"_r_{n}" for n in names])

    def whole(self, name: str, how: str, value: Column, within: Sequence[str] = ()) -> "Arranged":
        """`sum`, `min` or `max` over the whole (key, within) group on each of its rows."""
        return self.wholes({name: (how, value)}, within)

    def wholes(self, columns: dict[str, tuple[str, Column]], within: Sequence[str] = ()) -> "Arranged":
        """Several such values of the same groups, in one pass: name -> (how, value)."""
        combine = {"sum": F.sum, "min": F.min, "max": F.max}
        here, group = Window.partitionBy(*self._groups(within)), Window.partitionBy(*self.keys, *within)
        local = {name: combine[how](value).over(here) for name, (how, value) in columns.items()}
        # Groups that lie in several slices are the first or the last of each: only those are gathered.
        edge = F.struct(*self.keys, *within)
        edges = self.df.groupBy("_slice").agg(F.min(edge).alias("_lowest"), F.max(edge).alias("_highest"))
        edges = edges.withColumnRenamed("_slice", "_edge_slice")
        outer = self.df.join(F.broadcast(edges), F.col("_slice") == F.col("_edge_slice")).where(edge.eqNullSafe(F.col("_lowest")) | edge.eqNullSafe(F.col("_highest")))
        parts = outer.groupBy(*self._groups(within)).agg(*[combine[how](value).alias(f"_part_{name}") for name, (how, value) in columns.items()])
        carried = {f"_carry_{name}": combine[how](f"_part_{name}").over(group) for name, (how, _) in columns.items()}
        spanning = parts.withColumns({"_slices": F.count(F.lit(1)).over(group), **carried}).where("_slices > 1")
        spanning = checkpointed(spanning.drop("_slices", *[f"_part_{name}" for name in columns]))
        merged = self._attach(self.df.withColumns(local), spanning, within)
        filled = {name: F.coalesce(F.col(f"_carry_{name}"), F.col(name)) for name in columns}
        return self._with(merged.withColumns(filled).drop(*carried))

    def done(self, *helpers: str) -> DataFrame:
        extra = [c for c in self.df.columns if c.startswith("_o")]
        return self.df.drop(*helpers, *extra, "_slice")


def arrange(df: DataFrame, keys: Sequence[str], order: Sequence[Column], leave_out: Sequence[str] = ()) -> Arranged:
    """Prepare `df` for scans over `order` within `keys`.

    `order` holds ascending expressions that together are unique within a key, so
    that a hot key can be cut anywhere. Columns that only the order needs can be left out of what is written.
    """
    prepared = df.withColumns({f"_o{i}": expression for i, expression in enumerate(order)}).drop(*leave_out)
    names = [f"_o{i}" for i in range(len(order))]
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = prepared.repartitionByRange(slices, *keys, *names).withColumn("_slice", F.spark_partition_id())
    return Arranged(checkpointed(ranged), keys, names)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "_rank") -> DataFrame:
    """The first `k` rows of each key with their position.

    Spark limits each map task to `k` rows per key before the shuffle
    (WindowGroupLimit), so a hot key sends `k` rows per task, not all of them.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_rows(df, keys, order, 1).drop("_rank")


def dealt_out(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows in ranges of `keys` over as many tasks as the session has shuffle partitions, however few bytes they are.

    For rows that are multiplied next: adaptive execution sizes tasks by the bytes before that and would make one task of them.
    Neighbours stay together, so that what they are multiplied to packs well.
    """
    return df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of an equi-join whose size has no bound: it reaches the join through a shuffle, never whole through the driver.

    Spark alone goes by the size of the compressed columns that were read, however many times as large the rows are in memory
    and whatever they were multiplied by since; at some size it sends millions of rows to every task.
    """
    return df.hint("merge")


def skew_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join of a large side with one that has few rows per key.

    The right side is written first. Both sides then reach the join through plain shuffles, and adaptive execution can
    split a key that holds much of the left side over several tasks; it can't when one side is aggregated on the key in
    the same stage.
    """
    return left.join(shuffled(checkpointed(right)), list(on), how)
