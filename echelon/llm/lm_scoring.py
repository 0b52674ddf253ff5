"""Cross-entropy difference: how much better a target model than a background model predicts each document.

Both models are bigram models over words, of the same kind and over one vocabulary, counted over whole corpora: absolute
discounting interpolated with an add-one unigram model. Every word and every bigram of either corpus is counted, at every
size, and nothing of a model passes through the driver but three totals. Words and bigrams are known by 64-bit hashes.

The tokens are written once, in batches of about `TOKENS` with a vocabulary of their own. A batch asks for the counts of its
distinct bigrams: their hashes, sorted and packed, go to the buckets of the hash space, each bucket adds up what all batches
sent, and the totals return to each batch in the order in which it sent the hashes, so no hash travels back. The same way
serves the words. However often a word or bigram occurs, a batch sends it once, so no bucket grows with a hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from echelon.llm.common import pieces, stored_and_released, text_of, word_hashes

DISCOUNT = 0.75
#: The history of a document's first word, among word hashes.
BEGIN = 0
#: Tokens of a batch (a longer text is a batch of its own), and keys that a bucket gets from all batches, about.
TOKENS, KEYS = 2_000_000, 1_000_000
_ASKED = "bucket bigint, batch bigint, n bigint, keys binary, counts binary"
_TOLD = "bucket bigint, batch bigint, n bigint, totals binary, kinds bigint"


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes: the high bytes are mostly equal and take next to no room."""
    planes = np.ascontiguousarray(values.astype(np.uint64, copy=False).view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def unpacked(blob: bytes, n: int) -> np.ndarray:
    """The `n` numbers of `packed`, unsigned."""
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(blob, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel()


def _batches(corpus: DataFrame, kind: str, target: bool) -> DataFrame:
    """The tokens of a corpus (id, words): a row per batch, with words as places in a list of its own, frequent ones first.

    Batches of the target have odd numbers. `BEGIN` is in every list.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            done = 0
            for words in pieces(batch.column("words"), TOKENS):
                ids = batch.column("id").slice(done, len(words))
                done, lengths = done + len(words), np.diff(words.offsets.to_numpy()).astype(np.int64)
                tokens = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                known, tokens, n = np.unique(np.append(tokens, np.uint64(BEGIN)), return_inverse=True, return_counts=True)
                order = np.argsort(-n, kind="stable")
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                tokens = place[tokens[:-1]]
                listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                rest = (2 * number + target, lengths, len(tokens), len(known), packed(tokens), packed(known[order]))
                yield pa.RecordBatch.from_arrays([listed, *[pa.array([one]) for one in rest]], names)
                number += 1

    names = ["ids", "batch", "lengths", "n_tokens", "n_words", "tokens", "words"]
    return corpus.mapInArrow(pack, f"ids array<{kind}>, batch bigint, lengths array<bigint>, n_tokens bigint, n_words bigint, tokens binary, words binary")


class Batch:
    """The distinct bigrams of a batch by places in its list of words, in the order of their hashes, and its words in theirs."""

    def __init__(self, row: pa.Table | pa.RecordBatch) -> None:
        self.number, n_tokens, n_words, tokens, words = (row[name][0].as_py() for name in ("batch", "n_tokens", "n_words", "tokens", "words"))
        self.ids, self.lengths = row["ids"][0].values, row["lengths"][0].values.to_numpy(zero_copy_only=False)
        self.words = unpacked(words, n_words)
        tokens = unpacked(tokens, n_tokens).astype(np.int64)
        history = np.empty_like(tokens)
        history[1:] = tokens[:-1]
        starts = np.cumsum(self.lengths) - self.lengths
        history[starts[self.lengths > 0]] = int(np.flatnonzero(self.words == BEGIN)[0])
        self.n, self.begun = (np.bincount(one, minlength=len(self.words)) for one in (tokens, history))
        code, self.place, pair_n = np.unique(history * len(self.words) + tokens, return_inverse=True, return_counts=True)
        self.history, self.word = np.divmod(code, len(self.words))
        pairs = _mixed(self.words[self.history], self.words[self.word])
        self.pair_order, self.word_order = np.argsort(pairs), np.argsort(self.words)
        self.pairs, self.pair_n = pairs[self.pair_order], pair_n[self.pair_order]

    def per_pair(self, sorted_values: np.ndarray) -> np.ndarray:
        return _put_back(sorted_values, self.pair_order)

    def per_word(self, sorted_values: np.ndarray) -> np.ndarray:
        return _put_back(sorted_values, self.word_order)


def _put_back(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty_like(values)
    out[order] = values
    return out


def _mixed(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two; overflow is meant."""
    mixed = history * np.uint64(0x9E3779B97F4A7C15) + word
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(29))


def _asked(batch: int, keys: np.ndarray, counts: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """A row for each of the 2 ** bits buckets that the sorted keys of a batch fall into."""
    bucket = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
    found, start = np.unique(bucket, return_index=True)
    edges = [*start.tolist(), len(keys)]
    for one, a, b in zip(found.tolist(), edges[:-1], edges[1:], strict=True):
        blob = packed(np.diff(keys[a:b], prepend=np.uint64(0))), packed(np.concatenate([count[a:b] for count in counts]))
        yield pa.RecordBatch.from_pylist([{"bucket": one, "batch": batch, "n": b - a, "keys": blob[0], "counts": blob[1]}])


def _told(key: tuple, rows: pa.Table, kinds: int) -> pa.Table:
    """What all batches sent to a bucket, added up and returned to each of them.

    For every key, in the order sent: each of the `kinds` counts over the target, each over the background, and whether this
    batch is the one of its corpus that stands for the key. The column `kinds` adds up to the distinct keys of both corpora.
    """
    rows = rows.sort_by("batch")
    batch, sizes = rows["batch"].to_numpy(), rows["n"].to_numpy()
    keys = np.concatenate([np.cumsum(unpacked(blob.as_py(), n), dtype=np.uint64) for blob, n in zip(rows["keys"], sizes, strict=True)])
    counts = np.concatenate([unpacked(blob.as_py(), kinds * n).reshape(kinds, n) for blob, n in zip(rows["counts"], sizes, strict=True)], axis=1)
    distinct, place = np.unique(keys, return_inverse=True)
    target = np.repeat(batch % 2 == 1, sizes)
    totals, stands = [], np.zeros(len(keys), np.int64)
    for corpus in (target, ~target):
        of = np.flatnonzero(corpus)
        for count in counts:
            # doubles hold whole numbers up to 2 ** 53
            totals.append(np.bincount(place[of], count[of], len(distinct)).astype(np.int64)[place])
        stands[of[np.unique(place[of], return_index=True)[1]]] = 1
    wide = np.stack([*totals[:kinds], *totals[kinds:], stands])
    ends = np.cumsum(sizes)
    blobs = [packed(wide[:, b - n : b].ravel()) for n, b in zip(sizes, ends, strict=True)]
    first = np.zeros(len(sizes), np.int64)
    first[0] = len(distinct)
    return pa.table({"bucket": rows["bucket"], "batch": rows["batch"], "n": rows["n"], "totals": pa.array(blobs, pa.binary()), "kinds": first})


def _totals(rows: pa.Table, kinds: int) -> list[np.ndarray]:
    """The totals returned to a batch: 2 * kinds + 1 arrays in the order of its sorted keys."""
    rows = rows.sort_by("bucket")
    parts = [unpacked(blob.as_py(), (2 * kinds + 1) * n).reshape(-1, n) for blob, n in zip(rows["totals"], rows["n"].to_pylist(), strict=True)]
    return list(np.concatenate(parts, axis=1).astype(np.int64)) if parts else [np.zeros(0, np.int64)] * (2 * kinds + 1)


def _bits(keys: int) -> int:
    """Buckets in powers of two, for about `KEYS` keys each."""
    return max(0, -(-keys // KEYS) - 1).bit_length()


def _told_all(asked: DataFrame, kinds: int, name: str) -> DataFrame:
    def told(key: tuple, rows: pa.Table) -> pa.Table:
        return _told(key, rows, kinds)

    return stored_and_released(asked.groupBy("bucket").applyInArrow(told, _TOLD), name)


def _met(batches: DataFrame, told: DataFrame, work: Callable[[Batch, pa.Table], pa.Table], schema: str) -> DataFrame:
    """`work` for each batch and what it was told."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        return work(Batch(left), right)

    return batches.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(one, schema)


def _asked_words(batch: Batch, told: pa.Table, bits: int) -> pa.Table:
    """The words of a batch: how often they occur, how often as history, and the bigrams that the batch stands for."""
    stands = batch.per_pair(_totals(told, 1)[2])
    followers = np.bincount(batch.history, stands, len(batch.words)).astype(np.int64)
    counts = [one[batch.word_order] for one in (batch.n, batch.begun, followers)]
    return pa.Table.from_batches(_asked(batch.number, batch.words[batch.word_order], counts, bits))


def _scored(batch: Batch, told: pa.Table, size: dict[str, int], kinds: int, columns: list[str]) -> pa.Table:
    """The losses of the documents of a batch, given what it was told of its bigrams and of its words."""
    of_word = told["of_word"]
    pairs, words = _totals(told.filter(pc.invert(of_word)), 1), _totals(told.filter(of_word), 3)
    row = np.repeat(np.arange(len(batch.lengths)), batch.lengths)
    means = []
    for corpus, name in enumerate(("target", "background")):
        n, begun, followers = (batch.per_word(one) for one in words[3 * corpus : 3 * corpus + 3])
        seen = np.maximum(np.where(batch.words == BEGIN, begun, n), 1)
        left = np.maximum(1 - (begun - DISCOUNT * followers) / seen, 1e-9)
        direct = np.maximum(batch.per_pair(pairs[corpus]) - DISCOUNT, 0) / seen[batch.history]
        unigram = (n + 1) / (size[name] + kinds + 1)
        loss = -np.log(direct + left[batch.history] * unigram[batch.word])
        means.append(np.bincount(row, loss[batch.place], len(batch.lengths)) / np.maximum(batch.lengths, 1))
    return pa.table([batch.ids, pa.array(batch.lengths), *map(pa.array, means), pa.array(means[0] - means[1])], columns)


def cross_entropy_difference(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_tokens, target_loss, background_loss (nats per token) and their difference `score`.

    The lower the score, the more a document is like the target. A text without words (or null) has no tokens, losses 0
    and score 0. Null ids and repeated rows stay rows of their own and repeated texts count as often as they occur. Other
    columns are not read. An empty target or an empty table still gives proper models: all words are equally likely.
    """
    kind = docs.select(id).schema[0].dataType.simpleString()
    corpora = docs.select(F.col(id).alias("id"), word_hashes(text).alias("words")), target.select(F.lit(None).cast(kind).alias("id"), word_hashes(text).alias("words"))
    batches = stored_and_released(_batches(corpora[0], kind, False).union(_batches(corpora[1], kind, True)), "tokens")
    odd = F.col("batch") % 2 == 1
    sums = {"target": F.when(odd, F.col("n_tokens")), "background": F.when(~odd, F.col("n_tokens")), "tokens": F.col("n_tokens"), "words": F.col("n_words")}
    size = batches.agg(*[F.coalesce(F.sum(value), F.lit(0)).alias(name) for name, value in sums.items()]).first().asDict()

    def ask(tables: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for at in range(len(table)):
                batch = Batch(table.slice(at, 1))
                yield from _asked(batch.number, batch.pairs, [batch.pair_n], bits)

    pairs = _told_all(batches.mapInArrow(partial(ask, bits=_bits(size["tokens"])), _ASKED), 1, "bigrams")
    words = _told_all(_met(batches, pairs, partial(_asked_words, bits=_bits(size["words"])), _ASKED), 3, "words")
    kinds = words.agg(F.coalesce(F.sum("kinds"), F.lit(1))).first()[0] - 1  # without BEGIN
    told = pairs.withColumn("of_word", F.lit(False)).union(words.withColumn("of_word", F.lit(True))).where(~odd)
    columns = [id, "n_tokens", "target_loss", "background_loss", "score"]
    schema = f"`{id}` {kind}, n_tokens bigint, target_loss double, background_loss double, score double"
    return _met(batches.where(~odd), told, partial(_scored, size=size, kinds=kinds, columns=columns), schema)


def good_texts(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The texts of `docs` that a label calls good, as a target corpus; repeated and null labels count once and never.

    The labels grow with the documents, so they are joined by a shuffle at every size.
    """
    good = labels.where(F.col(label) == 1).select(F.col(id).alias("id")).distinct().hint("merge")
    return docs.select(F.col(id).alias("id"), text_of(text).alias(text)).join(good, "id", "left_semi").select(text)
