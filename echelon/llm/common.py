"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (`spark.checkpoint.dir`); a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="llm-shared-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again: its lineage ends there and executors may be lost."""
    path = fresh_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def stored_and_released(frame: DataFrame, name: str) -> DataFrame:
    """`stored`, and the shuffles that the writing needed leave the disks at its end; for frames that nothing else runs."""
    conf, key = frame.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return stored(frame, name)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def token_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_hashes(text: str | Column) -> Column:
    """One 64-bit hash per word: maximal runs of letters, digits and marks, in lower case. No words: an empty array."""
    words = F.split(F.lower(text_of(text)), r"[^\p{L}\p{N}\p{M}]+", -1)
    return F.transform(F.filter(words, lambda word: word != ""), lambda word: F.xxhash64(word))


def pieces(column: pa.Array, most: int) -> Iterator[pa.Array]:
    """Slices of a list column with about `most` values each; a longer list is a slice of its own."""
    ends = column.offsets.to_numpy()
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, side="right")) - 1)
        yield column.slice(start, stop - start)
        start = stop
