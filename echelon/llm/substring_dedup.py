"""Repeated passages found by hashes at the positions of a difference cover.

A difference cover of a period v is a set of places modulo v in which every distance modulo v occurs between two members.
Two places of equal passages, however they lie, therefore reach covered positions together after at most v - 1 words. So
only runs of `window - v + 1` words that start at covered positions are hashed (the anchors, 5 of 21 positions), and every
pair of equal windows holds a common anchor at the same distance from both starts. Texts are read again only where an anchor
is found anywhere else: each window around such an anchor is extended to its whole length, hashed to 96 bits, and repeated
if its hash starts elsewhere, too. Anchors choose what is looked at, windows decide.

Hashes travel packed: a task gives each bucket of hashes one row with the distinct hashes of a chunk of texts, sorted. A hash
that all texts share is sent once by each chunk, and what comes back is the numbers of those found in other chunks. There is
no pair of documents anywhere. Texts of equal content are one text, with their number.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from echelon.llm.common import pieces, text_of

WINDOW = 35
#: Perfect difference covers: every distance modulo the period occurs once.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
#: UTF-8 bytes of text for each bucket of hashes, and words whose hashes a task holds at a time.
BUCKET_BYTES, CHUNK_WORDS = 4_000_000, 600_000
SPACE = r"[\x20\x09-\x0D]+"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_MULTIPLY = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
PACKED = "target bigint, chunk bigint, key1 binary, key2 binary, keys binary, checks binary, places binary"

#: For a piece of texts: hashes, second hashes, the number of hashes of each text.
Keyed = Callable[[np.ndarray, np.ndarray, pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]


def period_of(window: int) -> int:
    """The largest period known that leaves anchors of at least a third of the window."""
    return max(period for period in COVERS if period <= max(1, 2 * window // 3))


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(32))) * _MULTIPLY[1]
    value = (value ^ (value >> np.uint64(29))) * _MULTIPLY[1]
    return value ^ (value >> np.uint64(32))


def run_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of `size` words, built of the hashes of two runs of half the words (or more, overlapping)."""
    value, length = _mixed(words + np.uint64(seed)), 1
    while length < size:
        step = min(length, size - length)
        if len(value) <= step:
            return value[:0]
        value = _mixed(value[:-step] * _MULTIPLY[0] + value[step:])
        length += step
    return value


def _of_documents(value: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place in it and hash of the runs that end in the text they start in."""
    owner = np.repeat(np.arange(len(lengths)), lengths)[: len(value)]
    place = np.arange(len(value)) - (np.cumsum(lengths) - lengths)[owner]
    whole = place + size <= lengths[owner]
    return owner[whole], place[whole], value[whole]


def anchors_of(window: int) -> Keyed:
    period = period_of(window)
    size = window - period + 1
    covered = np.isin(np.arange(period), COVERS[period])

    def keyed(words: np.ndarray, lengths: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        owner, place, value = _of_documents(run_hashes(words, size), lengths, size)
        kept = covered[place % period] & (lengths[owner] >= window)
        return value[kept], np.zeros(0, np.uint32), np.bincount(owner[kept], minlength=len(lengths))

    return keyed


def candidates(places: np.ndarray, words: int, window: int) -> np.ndarray:
    """Windows that hold one of the anchors: `places` are their numbers among the anchors of a text of so many words."""
    period = period_of(window)
    cover = np.array(COVERS[period])
    at = places // len(cover) * period + cover[places % len(cover)]
    edge = np.zeros(words + 1, np.int64)
    np.add.at(edge, np.maximum(at - period + 1, 0), 1)
    np.add.at(edge, at + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[: max(0, words - window + 1)] > 0)


def windows_of(window: int) -> Keyed:
    def keyed(words: np.ndarray, lengths: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first, second = run_hashes(words, window), run_hashes(words, window, seed=1)
        starts = np.cumsum(lengths) - lengths
        chosen = [candidates(np.frombuffer(places.as_py(), np.int32), int(n), window) for places, n in zip(batch.column("places"), lengths, strict=True)]
        at = np.concatenate([start + one for start, one in zip(starts, chosen, strict=True)] or [starts]).astype(np.int64)
        return first[at], second[at].astype(np.uint32), np.array([len(one) for one in chosen], np.int64)

    return keyed


def _groups(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys, places in it where another key begins, and how many are equal."""
    order = np.lexsort((checks, keys)) if len(checks) else np.argsort(keys, kind="stable")
    changed = np.ones(len(order), bool)
    changed[1:] = np.diff(keys[order]) != 0
    if len(checks):
        changed[1:] |= np.diff(checks[order]) != 0
    first = np.flatnonzero(changed)
    return order, first, np.diff(np.append(first, len(order)))


def _sent(batch: pa.RecordBatch, keyed: Keyed, chunk: int, buckets: int) -> Iterator[tuple]:
    """The rows of a chunk: its texts with the hashes that it has twice itself, and a row for each bucket of its hashes.

    Of texts with several copies all hashes are repeated, which needs no answer.
    """
    column = batch.column("words")
    words, lengths = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.diff(column.offsets.to_numpy())
    keys, checks, counts = keyed(words, lengths, batch)
    order, first, equal = _groups(keys, checks)
    several = np.repeat(equal, equal) > 1
    copies = np.repeat(batch.column("copies").to_numpy(zero_copy_only=False), counts)[order] > 1
    known = np.sort(order[several & ~copies]).astype(np.int32)
    one, two = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("key1", "key2"))
    yield -1 - chunk, chunk, one.tobytes(), two.tobytes(), counts.astype(np.int32).tobytes(), None, known.tobytes()
    place = np.where((several | copies)[first], -1, order[first]).astype(np.int32)
    kept, check = keys[order[first]], checks[order[first]] if len(checks) else checks
    bucket = ((kept >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(bucket)) if len(bucket) else []
    start = 0
    for end in ends:
        yield int(bucket[start]), chunk, None, None, kept[start:end].tobytes(), check[start:end].tobytes(), place[start:end].tobytes()
        start = end


def _packed(rows: DataFrame, keyed: Keyed, buckets: int, chunk_words: int) -> DataFrame:
    names = [part.split()[0] for part in PACKED.split(", ")]
    types = [pa.int64(), pa.int64(), *[pa.binary()] * 5]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            done = 0
            for words in pieces(batch.column("words"), chunk_words):
                sent = list(_sent(batch.slice(done, len(words)), keyed, chunk, buckets))
                yield pa.RecordBatch.from_arrays([pa.array(one, kind) for one, kind in zip(zip(*sent, strict=True), types, strict=True)], names)
                done += len(words)
                chunk += 1

    return rows.mapInArrow(send, PACKED)


def _met(table: pa.Table) -> pa.Table:
    """Of a bucket: for each chunk, the places of the hashes that another chunk has, too. A chunk's own row stays as it is."""
    if table.column("target")[0].as_py() < 0:
        return table.select(["chunk", "key1", "key2", "keys", "places"])
    keys, checks, places = (np.frombuffer(b"".join(table.column(name).to_pylist()), kind) for name, kind in (("keys", np.uint64), ("checks", np.uint32), ("places", np.int32)))
    chunks = table.column("chunk").to_numpy()
    from_row = np.repeat(np.arange(len(chunks)), [len(one) // 8 for one in table.column("keys").to_pylist()])
    order, first, equal = _groups(keys, checks)
    shared = np.repeat((equal > 1) | np.logical_or.reduceat(places[order] < 0, first), equal)
    answer = np.sort(order[shared & (places[order] >= 0)])
    ends = np.searchsorted(from_row[answer], np.arange(len(chunks) + 1))
    found = [(int(chunks[i]), places[answer[a:b]].tobytes()) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
    none = pa.nulls(len(found), pa.binary())
    return pa.table([pa.array([one for one, _ in found], pa.int64()), none, none, none, pa.array([two for _, two in found], pa.binary())], ["chunk", "key1", "key2", "keys", "places"])


def _returned(table: pa.Table) -> pa.Table:
    """Of a chunk: each text that has repeated hashes, with their numbers among its hashes."""
    own = next((i for i, one in enumerate(table.column("keys")) if one.is_valid), None)
    counts = np.frombuffer(table.column("keys")[own].as_py(), np.int32)
    one, two = (np.frombuffer(table.column(name)[own].as_py(), np.int64) for name in ("key1", "key2"))
    places = np.sort(np.frombuffer(b"".join(table.column("places").to_pylist()), np.int32))
    starts = np.cumsum(counts.astype(np.int64)) - counts
    ends = np.searchsorted(places, np.append(starts, counts.sum()))
    found = [i for i in range(len(counts)) if ends[i + 1] > ends[i]]
    packed = [(places[ends[i] : ends[i + 1]] - starts[i]).astype(np.int32).tobytes() for i in found]
    return pa.table([pa.array(one[found]), pa.array(two[found]), pa.array(packed, pa.binary())], ["key1", "key2", "places"])


def repeated(rows: DataFrame, keyed: Keyed, buckets: int, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """key1, key2 and places (packed numbers) of the texts with hashes that are found more than once in `rows`.

    `rows` have key1, key2, copies and words (hashes of the words). A text of several copies has each of its hashes elsewhere;
    it counts for others, but is itself no row of the result.
    """
    answered = "chunk bigint, key1 binary, key2 binary, keys binary, places binary"
    met = _packed(rows, keyed, buckets, chunk_words).groupBy("target").applyInArrow(_met, answered)
    return met.groupBy("chunk").applyInArrow(_returned, "key1 bigint, key2 bigint, places binary")


def spaced_words(text: str | Column) -> Column:
    """One 64-bit hash per word between white space, as it is."""
    return F.transform(F.filter(F.split(text_of(text), SPACE, -1), lambda word: word != ""), lambda word: F.xxhash64(word))


def _kept(texts: pa.Array, places: pa.Array, window: int) -> pa.Array:
    counts, gone, digests = [], [], []
    for text, packed in zip(texts, places, strict=True):
        # of a whole text without repeats nothing but the digest is held
        words = _WORD.findall(text.as_py().encode())
        edge = np.zeros(len(words) + 1, np.int64)
        if packed.is_valid:
            at = np.frombuffer(packed.as_py(), np.int32)
            edge[at] += 1
            edge[at + window] -= 1
        covered = np.cumsum(edge)[: len(words)] > 0
        counts.append(len(words))
        gone.append(int(covered.sum()))
        left = words if not gone[-1] else [word for word, out in zip(words, covered.tolist(), strict=True) if not out]
        digests.append(hashlib.sha256(b" ".join(left)).hexdigest())
    return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())], ["n_words", "n_removed", "kept_sha256"])


def _report(text: Column, places: Column, window: int) -> Column:
    @F.arrow_udf("n_words bigint, n_removed bigint, kept_sha256 string")
    def run(texts: pa.Array, packed: pa.Array) -> pa.Array:
        return _kept(texts, packed, window)

    return run(text, places)


def repeated_windows(docs: DataFrame, text: str = "text", window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """The distinct texts of `docs` with repeated windows: key1, key2 (128 bits of the text), text, copies, places.

    `places` (int32, packed) are the starts of the windows of `window` words that start anywhere else, too.
    """
    value = text_of(text)
    key = [F.xxhash64(value).alias("key1"), F.xxhash64(F.lit("second"), value).alias("key2")]
    size = docs.agg(F.coalesce(F.sum(F.octet_length(value)), F.lit(0)).alias("bytes")).first()["bytes"]
    buckets = 1 + size // bucket_bytes
    read = docs.select(*key, F.lit(1).cast("long").alias("copies"), spaced_words(value).alias("words"))
    anchors = repeated(read, anchors_of(window), buckets, chunk_words)
    # copies have equal anchors, all of them repeated
    anchors = anchors.groupBy("key1", "key2").agg(F.first("places").alias("places"))
    texts = docs.select(*key, value.alias("text")).groupBy("key1", "key2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    near = texts.join(anchors, ["key1", "key2"])
    found = repeated(near.select("key1", "key2", "copies", "places", spaced_words("text").alias("words")), windows_of(window), buckets, chunk_words)

    @F.arrow_udf("binary")
    def starts(texts: pa.Array, copies: pa.Array, packed: pa.Array, numbers: pa.Array) -> pa.Array:
        out = []
        for one, many, places, number in zip(texts, copies, packed, numbers, strict=True):
            words = sum(1 for _ in _WORD.finditer(one.as_py().encode()))
            if many.as_py() > 1:
                out.append(np.arange(words - window + 1, dtype=np.int32).tobytes())
            else:
                at = candidates(np.frombuffer(places.as_py(), np.int32), words, window)
                out.append(at[np.frombuffer(number.as_py(), np.int32)].astype(np.int32).tobytes())
        return pa.array(out, pa.binary())

    met = near.join(found.withColumnRenamed("places", "numbers"), ["key1", "key2"], "left").where("numbers IS NOT NULL OR copies > 1")
    return met.select("key1", "key2", "text", "copies", starts("text", "copies", "places", "numbers").alias("places"))


def substring_report(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """One row per row of `docs`: id, n_words, n_removed, kept_sha256 (of the words left, joined by one space).

    A word is a maximal run without white space (space and 9 to 13), taken as it is. A word goes if it is covered by a window
    of `window` words whose words also start anywhere else: in another document, in a copy or in the same document, where
    the two may overlap. Null and empty texts have no words, and texts shorter than a window lose none. Repeated rows are
    copies of each other. Null ids stay, other columns aren't read, an empty table gives no rows.
    """
    value = text_of(text)
    key = [F.xxhash64(value).alias("key1"), F.xxhash64(F.lit("second"), value).alias("key2")]
    windows = repeated_windows(docs, text, window, **options)
    lost = windows.select("key1", "key2", _report(F.col("text"), F.col("places"), window).alias("lost"))
    base = docs.select(F.col(id).alias("id"), *key, _report(value, F.lit(None).cast("binary"), window).alias("whole"))
    met = base.join(lost, ["key1", "key2"], "left").select("id", F.coalesce("lost", "whole").alias("report"))
    return met.select(F.col("id").alias(id), "report.*")


def without_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """`docs` with all its columns; texts that hold repeated windows become the words left, joined by one space."""
    value = text_of(text)
    key = [F.xxhash64(value).alias("key1"), F.xxhash64(F.lit("second"), value).alias("key2")]
    windows = repeated_windows(docs, text, window, **options)

    @F.arrow_udf("string")
    def left(texts: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for one, packed in zip(texts, places, strict=True):
            words = _WORD.findall(one.as_py().encode())
            edge = np.zeros(len(words) + 1, np.int64)
            at = np.frombuffer(packed.as_py(), np.int32)
            edge[at] += 1
            edge[at + window] -= 1
            out.append(b" ".join(word for word, depth in zip(words, np.cumsum(edge).tolist(), strict=False) if not depth).decode())
        return pa.array(out, pa.string())

    shorter = windows.select("key1", "key2", left("text", "places").alias("shorter"))
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), *key)
    met = packed.join(shorter, ["key1", "key2"], "left")
    return met.select(F.when(F.col("shorter").isNull(), F.col("doc")).otherwise(F.col("doc").withField(text, F.col("shorter"))).alias("doc")).select("doc.*")
