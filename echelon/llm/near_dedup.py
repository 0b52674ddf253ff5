"""Near duplicates by DartMinHash signatures, banded joining and exact verification.

A text is the set of its runs of five words: each weighs 1 however often it is found, so that signatures estimate what is
verified. Darts are thrown at the plane of element weight and rank: every unit cell of an element's weight gets darts at
ranks of a Poisson process, each with a place in the cell and a coordinate, all drawn from hashes of element and cell, so
equal regions get equal darts in all texts. A text keeps, of the darts that lie within its weights, the one of the lowest
rank per coordinate. Ranks are only searched up to a bound at which about k ln k + 2k darts are found, so a signature costs
the number of elements plus that number. Two texts agree in a coordinate with the probability of their resemblance.

Texts of equal words are one node. Nodes that agree in all coordinates of a band meet in a bucket. In each bucket one node,
the centre, is paired with all others; it is the one that meets the most nodes in all its buckets, such as the original among
its copies. Pairs whose signatures agree in far too few coordinates are left out, the others verified by the resemblance of
their sets of runs; linked nodes get a common label. Buckets whose nodes still have several labels go on with further centres,
taken from the labels with the fewest nodes there, until no two nodes of different labels are left that have not met. Runs that
no other node of those buckets has can't be shared, so their number bounds what two nodes may have in common; who can't reach
the similarity by that bound is left out. These comparisons run inside the tasks: the sets of runs of a chunk of a bucket meet
those of its centres, and only links come out, however many pairs fall just short of the similarity.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from echelon.llm.common import stored, text_of, word_hashes
from echelon.llm.fingerprints import let, shingle_hashes

WORDS = 5
SIMILARITY = 0.8
BANDS = 25
ROWS = 5
#: Centres of a bucket with several labels in a further round; in the first round there is one.
CENTRES = 256
#: Standard errors that the agreement of two signatures may fall short of the similarity before a pair is left out.
ERRORS = 4.5
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
#: Runs of those nodes of a bucket that a task compares with its centres.
CHUNK_RUNS = 1_000_000
#: Words of the texts whose signatures are computed together.
TOGETHER = 100_000


def mixed(value: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    value = value ^ (value >> np.uint64(30))
    value = value * np.uint64(0xBF58476D1CE4E5B9)
    value = value ^ (value >> np.uint64(27))
    value = value * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def uniform(value: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from 64-bit integers."""
    return ((value >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """A hash for each run of `size` words; fewer words are a single run."""
    words = words.view(np.uint64)
    if not len(words):
        return words
    size = min(size, len(words))
    value = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        value = mixed(value * np.uint64(_ODD[0]) + words[i : len(words) - size + 1 + i])
    return mixed(value + np.uint64(size))


def weighted(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of a text and their weights, which are 1: repeats don't count in the resemblance either."""
    elements = np.unique(shingles(words))
    return elements, np.ones(len(elements))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """A row of k dart hashes for each non-empty weighted set."""
    out = np.zeros((len(sets), k), np.uint64)
    todo, factor = np.arange(len(sets)), 1.0
    while len(todo):
        full = _thrown([sets[i] for i in todo], k, factor, out, todo)
        todo, factor = todo[~full], factor * 2
    return out


def _thrown(sets: list[tuple[np.ndarray, np.ndarray]], k: int, factor: float, out: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Throw darts up to each set's rank bound, write the full signatures to `out` and tell which are full."""
    sizes = [len(elements) for elements, _ in sets]
    elements = np.concatenate([one for one, _ in sets])
    weights = np.concatenate([one for _, one in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    bound = factor * k * (math.log(k) + 2) / np.bincount(owner, weights, len(sets))
    # a cell for each started unit of weight
    cells = np.ceil(weights).astype(np.int64)
    number = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
    seed = mixed(np.repeat(elements, cells) + number.astype(np.uint64) * np.uint64(_ODD[1]))
    room = np.repeat(weights, cells) - number
    owner = np.repeat(owner, cells)
    rank = np.zeros(len(seed))
    hits_owner, hits_rank, hits_coordinate, hits_dart = [], [], [], []
    arrival = 0
    while len(seed):
        dart = mixed(seed + np.uint64((arrival * _ODD[2]) & (2**64 - 1)))
        rank = rank - np.log(uniform(dart))
        inside = rank <= bound[owner]
        seed, rank, owner, room, dart = seed[inside], rank[inside], owner[inside], room[inside], dart[inside]
        hit = uniform(mixed(dart + np.uint64(_ODD[3]))) <= room  # the last cell may be started only
        coordinate = (mixed(dart + np.uint64(_ODD[4])) % np.uint64(k)).astype(np.int64)
        hits_owner.append(owner[hit])
        hits_rank.append(rank[hit])
        hits_coordinate.append(coordinate[hit])
        hits_dart.append(dart[hit])
        arrival += 1
    place = np.concatenate(hits_owner) * k + np.concatenate(hits_coordinate)
    ranks, darts = np.concatenate(hits_rank), np.concatenate(hits_dart)
    order = np.argsort(-ranks, kind="stable")
    found = np.zeros(len(sets) * k, np.uint64)
    seen = np.zeros(len(sets) * k, bool)
    found[place[order]] = darts[order]  # the last one written has the lowest rank
    seen[place] = True
    full = seen.reshape(-1, k).all(axis=1)
    out[rows[full]] = found.reshape(-1, k)[full]
    return full


def band_hashes(rows: np.ndarray, bands: int, size: int) -> np.ndarray:
    value = np.zeros((len(rows), bands), np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(_ODD[5])
    for i in range(size):
        value = mixed(value * np.uint64(_ODD[0]) + rows[:, i::size][:, :bands])
    return value


SIGNATURE = "struct<bands: array<bigint>, sketch: binary>"


def _signed(column: pa.Array, bands: int, size: int) -> pa.Array:
    words, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
    hashes: list[np.ndarray] = [np.zeros(0, np.int64)] * len(column)
    sketches = [b""] * len(column)
    together: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if together:
            signed = signatures([weighted(words[offsets[i] : offsets[i + 1]]) for i in together], bands * size)
            low = signed.astype(np.uint8)
            for i, row, sketch in zip(together, band_hashes(signed, bands, size).view(np.int64), low, strict=True):
                hashes[i], sketches[i] = row, sketch.tobytes()
        together.clear()
        held = 0

    for i in range(len(column)):
        length = int(offsets[i + 1] - offsets[i])
        if length:
            together.append(i)
            held += length
            if held >= TOGETHER:
                flush()
    flush()
    return pa.StructArray.from_arrays([pa.array(hashes, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["bands", "sketch"])


def signature_of(words: Column, bands: int = BANDS, size: int = ROWS) -> Column:
    """The signature of a text, given by its word hashes: a hash per band, and the low byte of each coordinate.

    Both are empty for a text without words.
    """

    @F.arrow_udf(SIGNATURE)
    def run(column: pa.Array) -> pa.Array:
        return _signed(column, bands, size)

    return run(words)


def agreement(one: Column, other: Column) -> Column:
    """Estimated resemblance by the sketches of two texts, corrected for bytes that agree by chance."""

    @F.arrow_udf("double")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        out = [float((np.frombuffer(a.as_py(), np.uint8) == np.frombuffer(b.as_py(), np.uint8)).mean()) for a, b in zip(left, right, strict=True)]
        return pa.array([(share - 1 / 256) / (1 - 1 / 256) for share in out], pa.float64())

    return run(one, other)


def resemblance(one: Column, other: Column) -> Column:
    """Jaccard resemblance of the sets of five-word runs of two texts, given by their word hashes."""

    @F.arrow_udf("double")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        known: tuple[bytes, np.ndarray] | None = None
        for a, b in zip(left, right, strict=True):
            x = np.unique(shingles(a.values.to_numpy(zero_copy_only=False)))
            words = b.values.to_numpy(zero_copy_only=False)
            key = words.tobytes()
            if known is None or known[0] != key:  # a centre is on the right of many pairs
                known = key, np.unique(shingles(words))
            y = known[1]
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / max(1, len(x) + len(y) - both))
        return pa.array(out, pa.float64())

    return run(one, other)


def _pair_of_hashes(*values: Column) -> list[Column]:
    return [F.xxhash64(*values), F.xxhash64(F.lit("second"), *values)]


def _content(id: Column, text: Column) -> list[Column]:
    """128 bits of the id and text of a row; rows that share them can be taken for each other."""
    return [one.alias(name) for one, name in zip(_pair_of_hashes(id, text), ("row1", "row2"), strict=True)]


def _same_words(words: Column, text: Column) -> list[Column]:
    """128 bits of the words of a text; texts without words are told apart by their content."""
    what = [F.when(F.size(words) > 0, words), F.when(F.size(words) == 0, text)]
    return [one.alias(name) for one, name in zip(_pair_of_hashes(*what), ("words1", "words2"), strict=True)]


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that it is linked with, over any number of links (one, other)."""
    ends = links.select("one", "other").union(links.select(F.col("other"), F.col("one")))
    labels = stored(ends.groupBy(F.col("one").alias("node")).agg(F.least("node", F.min("other")).alias("label")), "labels")
    while True:
        known = labels.select(F.col("node").alias("other"), F.col("label").alias("near"))
        lowest = ends.join(known, "other").groupBy(F.col("one").alias("node")).agg(F.min("near").alias("near"))
        lower = labels.join(lowest, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        # follow each label to the label of its node; written, so that a label of very many nodes is dealt to several tasks
        lower = stored(lower, "lower")
        jump = stored(lower.join(lower.select(F.col("label").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("label"), F.col("label").alias("further")), "jump")
        moved = lower.join(jump, "label").select("node", F.least("label", "further").alias("label"), "was")
        after = stored(moved, "labels")
        labels = after.select("node", "label")
        if after.where("label != was").isEmpty():
            return labels


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (one, other) whose texts are similar enough, tested by their sketches first."""

    def ends(column: str) -> list[DataFrame]:
        return [texts.select(F.col("node").alias(end), F.col(column).alias(f"{column}_{end}")) for end in ("one", "other")]

    ones, others = ends("sketch")
    met = pairs.join(ones, "one").join(others, "other").withColumn("agreement", agreement(F.col("sketch_one"), F.col("sketch_other")))
    least = similarity - ERRORS * F.sqrt(F.lit(similarity * (1 - similarity)) / F.length("sketch_one"))
    probable = met.where(F.col("agreement") >= least).select("one", "other")
    ones, others = ends("text")
    met = probable.join(ones, "one").join(others, "other")
    likeness = resemblance(word_hashes("text_one"), word_hashes("text_other"))
    return met.select("one", "other", likeness.alias("likeness")).where(F.col("likeness") >= similarity - 1e-9).select("one", "other")


def _runs(texts: DataFrame) -> DataFrame:
    """node, runs (its distinct runs), size and shared (the number of those that some other node of `texts` has, too)."""
    runs = stored(texts.select("node", F.array_distinct(let(word_hashes("text"), lambda words: shingle_hashes(words, WORDS))).alias("runs")), "runs")
    # a run with a single node needs no join back: the count carries the node
    alone = runs.select("node", F.explode("runs").alias("run")).groupBy("run").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    own = alone.groupBy("node").agg(F.count("*").alias("own"))
    size = F.size("runs")
    return runs.join(own, "node", "left").select("node", "runs", size.alias("size"), (size - F.coalesce("own", F.lit(0))).alias("shared"))


def _compared(here: DataFrame, centres: DataFrame, runs: DataFrame, similarity: float) -> DataFrame:
    """Links (one, other) between the nodes of each bucket and its centres of other labels."""
    chunks = here.groupBy("bucket").agg(F.ceil(F.sum("size") / CHUNK_RUNS).cast("int").alias("chunks")).join(centres.select("bucket").distinct(), "bucket")
    members = here.join(chunks, "bucket").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    members = members.select("bucket", "chunk", "node", "label").join(runs.select("node", "runs", "shared"), "node")
    sent = centres.join(chunks, "bucket").join(runs.select(F.col("node").alias("centre"), "runs", "shared"), "centre")
    sent = sent.select("bucket", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "centre", "own", "runs", "shared")

    def links(of_chunk: pd.DataFrame, of_bucket: pd.DataFrame) -> pd.DataFrame:
        one: list[np.ndarray] = []
        other: list[np.ndarray] = []
        if len(of_chunk):
            nodes, labels, shared = (of_chunk[c].to_numpy() for c in ("node", "label", "shared"))
            sizes = np.array([len(r) for r in of_chunk.runs])
            flat, owner = np.concatenate(list(of_chunk.runs)), np.repeat(np.arange(len(nodes)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for centre, own, run, common in zip(of_bucket.centre, of_bucket.own, of_bucket.runs, of_bucket.shared, strict=True):
                least = similarity * (sizes + len(run)) / (1 + similarity) - 1e-9  # runs in common that the similarity needs
                open_nodes = (labels != own) & (np.minimum(shared, common) >= least)
                if open_nodes.any():
                    low, high = np.searchsorted(flat, run, "left"), np.searchsorted(flat, run, "right")
                    met = np.concatenate([owner[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True) if b > a] or [owner[:0]])
                    found = nodes[open_nodes & (np.bincount(met, minlength=len(nodes)) >= least)]
                    one.append(found)
                    other.append(np.full(len(found), centre))
        empty = np.zeros(0, np.int64)
        return pd.DataFrame({"one": np.concatenate([empty, *one]).astype("int64"), "other": np.concatenate([empty, *other]).astype("int64")})

    grouped = members.groupBy("bucket", "chunk").cogroup(sent.groupBy("bucket", "chunk"))
    return grouped.applyInPandas(links, "one bigint, other bigint").distinct()


def _mixed(here: DataFrame) -> DataFrame:
    """Buckets whose nodes have several labels."""
    return here.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("bucket")


def _next_centres(here: DataFrame, tried: DataFrame) -> DataFrame:
    """Up to `CENTRES` untried nodes of each bucket that has untried nodes of several labels, rare labels first."""
    untried = here.join(tried, ["bucket", "node"], "left_anti")
    # where a single label has untried nodes, all of them have met the nodes of the others
    choice = untried.join(_mixed(untried), "bucket", "left_semi").join(here.groupBy("bucket", "label").agg(F.count("*").alias("of_label")), ["bucket", "label"])
    first = Window.partitionBy("bucket").orderBy("of_label", "node")
    kept = choice.withColumn("n", F.row_number().over(first)).where(F.col("n") <= CENTRES)
    return kept.select("bucket", F.col("node").alias("centre"), F.col("label").alias("own"))


def _links(buckets: DataFrame, texts: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame | None]:
    """Verified links (one, other) and the labels of linked nodes; no link between differing labels is left out."""
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("nodes"))
    met = buckets.join(sizes, "bucket").groupBy("node").agg(F.sum("nodes").alias("met"))
    # the node that meets the most is the centre: an aggregate, so that a large bucket is cut down before the shuffle
    centre = F.min(F.struct((-F.col("met")).alias("less"), "node")).alias("centre")
    centres = stored(buckets.join(met, "node").groupBy("bucket").agg(centre).select("bucket", F.col("centre.node").alias("centre")), "centres")
    pairs = buckets.join(centres, "bucket").where("node != centre").select(F.col("node").alias("one"), F.col("centre").alias("other"))
    # two centres of different buckets are paired once
    pairs = pairs.select(F.least("one", "other").alias("one"), F.greatest("one", "other").alias("other")).distinct()
    links = stored(_verified(pairs, texts, similarity), "links")
    labels, tried, runs = components(links), None, None
    while True:
        met = centres.select("bucket", F.col("centre").alias("node"))
        tried = met if tried is None else tried.union(met)
        here = buckets.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
        here = stored(here.join(_mixed(here), "bucket", "left_semi"), "mixed")
        if runs is None:
            runs = stored(_runs(texts.join(here.select("node").distinct(), "node", "left_semi")), "runs")
        here = here.join(runs.where(F.col("shared") >= similarity * F.col("size") - 1e-9).select("node", "size"), "node")
        centres = stored(_next_centres(here, tried), "centres")
        if centres.isEmpty():
            return links, labels
        new = stored(_compared(here, centres, runs, similarity), "links")
        if not new.isEmpty():
            links = links.union(new)
            labels = components(links)


def near_duplicate_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of `docs`: id, row1 and row2 (hashes of id and text), class_id (the smallest id of its class), keep.

    Rows are of one class if their texts have the same words, or are linked by texts that resemble each other by at least
    `similarity`. `keep` marks the rows to keep of each class: those with its smallest id (null ids come last) and, of
    equal ids, the smallest hash; only rows with the same id and text can be marked together. Texts without words, null
    and empty ones too, are of one class if they are the same text (null counts as empty). Other columns are not read; an
    empty table gives no rows.
    """
    value = text_of(text)
    # words are needed several times, so they become a column of their own first
    read = docs.select(F.col(id).alias("id"), value.alias("text"), word_hashes(text).alias("words"))
    signed = read.select("id", *_content(F.col("id"), F.col("text")), *_same_words(F.col("words"), F.col("text")), signature_of(F.col("words"), bands, rows).alias("signature"))
    signed = stored(signed.select("*", "signature.*").drop("signature"), "signatures")
    # one node for all texts of the same words, with one of their rows; the table is written, so its numbers stay
    chosen = F.min(F.struct("row1", "row2", "bands", "sketch")).alias("chosen")
    nodes = signed.groupBy("words1", "words2").agg(chosen).select("words1", "words2", "chosen.*").withColumn("node", F.monotonically_increasing_id())
    nodes = stored(nodes, "nodes")
    placed = nodes.select("node", F.posexplode("bands").alias("band", "hash")).select("node", F.xxhash64("band", "hash").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    buckets = stored(placed.join(shared, "bucket").select("bucket", "node"), "buckets")
    involved = nodes.join(buckets.select("node").distinct(), "node").select("row1", "row2", "node", "sketch")
    read = docs.select(value.alias("text"), *_content(F.col(id), value))
    texts = stored(read.join(involved, ["row1", "row2"]).select("node", "sketch", "text").dropDuplicates(["node"]), "texts")
    _, labels = _links(buckets, texts, similarity)

    numbered = signed.drop("bands", "sketch").join(nodes.select("words1", "words2", "node"), ["words1", "words2"])
    named = numbered.join(labels, "node", "left").select("id", "row1", "row2", F.coalesce("label", "node").alias("label"))
    first = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row1"), F.col("row2"))
    done = named.join(named.groupBy("label").agg(F.min(first).alias("head")), "label")
    keep = (F.col("row1") == F.col("head.row1")) & (F.col("row2") == F.col("head.row2"))
    return done.select(F.col("id").alias(id), "row1", "row2", F.col("head.id").alias("class_id"), keep.alias("keep"))


def without_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` with all its columns, one row of each class of near duplicates."""
    classes = near_duplicate_classes(docs, id, text, **options)
    chosen = classes.where("keep").select("row1", "row2").distinct()
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), *_content(F.col(id), text_of(text)))
    met = packed.join(chosen, ["row1", "row2"], "left_semi")
    # rows with the same id and text are the only ones left to choose from
    first = met.withColumn("n", F.row_number().over(Window.partitionBy("row1", "row2").orderBy("row1"))).where("n = 1")
    return first.select("doc.*")
