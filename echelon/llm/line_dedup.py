"""Line deduplication over levelled sorted runs of line hashes.

A run holds the distinct line keys of one batch, as 128-bit hashes in sorted order, each with the number of documents that
have it. New batches add runs at level 0. As soon as a level has `fanout` runs, they are merged into one run of the next
level, so n batches leave at most fanout * log(n) runs and every key is rewritten log(n) times. Documents are joined with
the runs by a sort-merge semi join on the hashes alone; their texts do not travel for that.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from echelon.llm.common import fresh_path, stored, text_of

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FANOUT = 4
BATCHES = 4
KEY = ("key1", "key2")
_RUN = "key1 bigint, key2 bigint, docs bigint"


def lines_of(text: str | Column) -> Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(text_of(text), "\n", -1)


def _lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else; the fast built-in serves texts of ASCII only."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    """The key of a line whose A-Z are in lower case already."""
    return F.btrim(line, F.lit(SPACE))


def _hashed(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("key1"), F.xxhash64(F.lit("second"), key).alias("key2"))


def _row_key(id: Column, text: Column) -> list[Column]:
    """A key of 128 bits for rows with this id and text; rows that share it have the same lines."""
    return [F.xxhash64(id, text).alias("row1"), F.xxhash64(F.lit("second"), id, text).alias("row2")]


def line_keys(docs: DataFrame, id: str = "doc_id", text: str = "text", least_chars: int = 1) -> DataFrame:
    """One row per row of `docs` and distinct line key of at least `least_chars` code points: row1, row2, key1, key2."""
    value = text_of(text)
    # texts are compared by hashing them, structs of hashes would be compared pair by pair
    keys = F.filter(F.transform(F.split(_lowered(value), "\n", -1), line_key), lambda key: F.char_length(key) >= least_chars)
    each = docs.select(*_row_key(F.col(id), value), F.explode(F.transform(F.array_distinct(keys), _hashed)).alias("line"))
    return each.select("row1", "row2", "line.key1", "line.key2")


@dataclass(frozen=True)
class LineRuns:
    """The live runs, oldest first: (level, path). Adding a batch returns a new value; files are written once and never changed."""

    runs: tuple[tuple[int, str], ...] = ()
    fanout: int = FANOUT

    def add(self, lines: DataFrame) -> LineRuns:
        """Add the run of a batch, given its line keys, and merge the levels that are full."""
        spark = lines.sparkSession
        counted = lines.groupBy(*KEY).agg(F.count("*").alias("docs"))
        grown = replace(self, runs=(*self.runs, (0, _write_run(counted))))
        level = 0
        while sum(at == level for at, _ in grown.runs) >= self.fanout:
            full = [path for at, path in grown.runs if at == level]
            merged = spark.read.schema(_RUN).parquet(*full).groupBy(*KEY).agg(F.sum("docs").alias("docs"))
            rest = tuple(run for run in grown.runs if run[0] != level)
            grown = replace(grown, runs=(*rest, (level + 1, _write_run(merged))))
            level += 1
        return grown

    def keys(self, spark: SparkSession) -> DataFrame:
        """key1, key2 and the number of documents over all runs."""
        if not self.runs:
            return spark.createDataFrame([], _RUN)
        return spark.read.schema(_RUN).parquet(*[path for _, path in self.runs]).groupBy(*KEY).agg(F.sum("docs").alias("docs"))

    def frequent(self, spark: SparkSession, least_docs: int) -> DataFrame:
        return self.keys(spark).where(F.col("docs") >= least_docs).select(*KEY)


def _write_run(keys: DataFrame) -> str:
    path = fresh_path(keys.sparkSession, "run")
    keys.repartitionByRange(*KEY).sortWithinPartitions(*KEY).write.parquet(path)
    return path


def _found(ordered: Column, steps: Column, value: Column) -> Column:
    """Whether a sorted array has the value, by halving: `steps` are falling powers of two, the first at least its size."""

    def advance(at: Column, step: Column) -> Column:
        return F.when(F.get(ordered, at + step - 1) <= value, at + step).otherwise(at)

    # beyond the end `get` gives null, which is no step
    return F.coalesce(F.get(ordered, F.aggregate(steps, F.lit(0), advance) - 1) == value, F.lit(False))


def strip_lines(docs: DataFrame, lines: DataFrame, keys: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of `docs` as `doc` (all its columns) with the `kept` lines, without those whose key is in `keys`.

    `lines` has the line keys of `docs`. Only keys that go travel back to their documents.
    """
    gone = lines.join(keys.hint("merge"), list(KEY), "left_semi").groupBy("row1", "row2").agg(F.sort_array(F.collect_set(F.struct(*KEY))).alias("gone"))
    value = text_of(F.col(f"doc.{text}"))
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), *_row_key(F.col(id), text_of(text)))
    met = packed.join(gone, ["row1", "row2"], "left")
    steps = F.transform(F.sequence(F.ceil(F.log2(F.size("gone") + 1)).cast("int"), F.lit(0)), lambda bit: F.call_function("shiftleft", F.lit(1), bit))
    kept = F.filter(lines_of(value), lambda line: ~_found(F.col("gone"), steps, _hashed(line_key(_lowered(line)))))
    return met.select("doc", F.when(F.col("gone").isNull(), lines_of(value)).otherwise(kept).alias("kept"))


def repeated_lines(docs: DataFrame, least_docs: int, least_chars: int, batches: int, id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The line keys of all rows, and the keys found in at least `least_docs` rows after adding them batch by batch."""
    lines = stored(line_keys(docs, id, text, least_chars), "lines")
    runs = LineRuns()
    for batch in range(batches):
        runs = runs.add(lines.where(F.pmod("row1", F.lit(batches)) == batch))
    # written, so that a key of very many rows is dealt to several tasks in the join
    return lines, stored(runs.frequent(docs.sparkSession, least_docs), "frequent")


def dedup_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, batches: int = BATCHES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: `doc` (all its columns as a struct), `n_lines`, `n_dropped` and the text that is left.

    A line goes if its key (stripped of white space, A-Z in lower case) has at least `least_chars` code points and is found
    in at least `least_docs` rows; all its lines go, in every row. A key that repeats within a row counts once; equal rows
    count one by one. All rows go through the runs in `batches` batches (by a hash of the row), so that any of them can be
    redone alone. Null and empty texts are one empty line, which stays. Columns of any name and null ids are kept as they
    are; an empty table gives no rows.
    """
    lines, keys = repeated_lines(docs, least_docs, least_chars, batches, id, text)
    stripped = strip_lines(docs, lines, keys, id, text)
    n_lines = F.size(lines_of(F.col(f"doc.{text}"))).cast("long")
    return stripped.select("doc", n_lines.alias("n_lines"), (n_lines - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text_left"))


def dedup_new_batch(runs: LineRuns, docs: DataFrame, least_docs: int = 1, least_chars: int = 1, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, LineRuns]:
    """A new batch without the lines that at least `least_docs` earlier rows have, and the runs with the batch added."""
    lines = stored(line_keys(docs, id, text, least_chars), "lines")
    stripped = strip_lines(docs, lines, stored(runs.frequent(docs.sparkSession, least_docs), "frequent"), id, text)
    return stripped.select("doc", F.array_join("kept", "\n").alias("text_left")), runs.add(lines)


def line_report(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_lines, n_dropped and the digest of what is left of every row of `docs`."""
    done = dedup_lines(docs, least_docs, least_chars, id=id, text=text)
    return done.select(F.col(f"doc.{id}").alias(id), "n_lines", "n_dropped", F.sha2("text_left", 256).alias("kept_sha256"))
