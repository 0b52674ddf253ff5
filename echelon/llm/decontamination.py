"""Benchmark decontamination: a BM25 index of test items, queried with every passage of the corpus.

Passages are overlapping windows of a text's words, long enough that any copy of an item lies within one. An item's score
is divided by the score of its own text, so one threshold serves all items. Posting lists are in item order, in blocks with
the largest impact of each block. Retrieval is block-max WAND: lists are sorted by their next item, the pivot is the first
item at which the lists' largest impacts reach the threshold, and whole blocks are skipped when their maxima don't. Every
item above the threshold is retrieved. Before that, windows are tested in bulk by the same bound: of each item the terms with
the largest impacts are essential, all others together can give `rest`, so a window whose essential terms of an item give less
than threshold - rest can't retrieve it. What is retrieved is verified by the words of question and answer that lie in runs
of three or more words shared with the passage.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from echelon.llm.common import pieces, stored, word_hashes

THRESHOLD = 0.6
OVERLAP = 0.6
WHOLE_OVERLAP = 0.8
K1, B = 1.2, 0.75
BLOCK = 16
RUN = 3
#: Share of an item's own score that its essential terms make up at least.
ESSENTIAL = 0.7
#: Test items in one index. More are searched index by index.
MOST_ITEMS = 20_000
#: Words whose windows are tested together.
TOGETHER = 400_000
LAST_SENTENCE = re.compile(r"[.?!\n]\s*(?=[^.?!\n]*[^\W_][^.?!\n]*[.?!\s]*$)")


def answer_start(text: str) -> int:
    """Where the answer begins: the last sentence or line. A text of one sentence has its answer in its last quarter."""
    found = [match.end() for match in LAST_SENTENCE.finditer(text)]
    return found[-1] if found and text[: found[-1]].strip() else len(text) * 3 // 4


@dataclass(frozen=True)
class Item:
    id: int | None
    words: tuple[int, ...]
    answer: int  # number of words of the question


class Posting:
    """The items of a term, ascending, with normalised impacts and the maximum of each block."""

    __slots__ = ("items", "impacts", "best", "blocks")

    def __init__(self, pairs: list[tuple[int, float]]):
        self.items = [item for item, _ in pairs]
        self.impacts = [impact for _, impact in pairs]
        self.best = max(self.impacts)
        self.blocks = [max(self.impacts[i : i + BLOCK]) for i in range(0, len(pairs), BLOCK)]


@dataclass(frozen=True)
class Statistics:
    """Of all items of a benchmark: their number, mean and longest length, and how many have each word."""

    items: int
    mean: float
    longest: int
    having: dict[int, int]


class Index:
    """Some items of a benchmark, with the statistics of all of them; without any, these are all."""

    def __init__(self, items: list[Item], whole: Statistics | None = None):
        self.items = items
        count = [Counter(item.words) for item in items]
        if whole is None:
            lengths = [len(item.words) for item in items]
            whole = Statistics(len(items), sum(lengths) / max(1, len(items)) or 1.0, max(lengths, default=1), Counter(word for words in count for word in words))
        mean = whole.mean
        idf = {word: math.log(1 + (whole.items - n + 0.5) / (n + 0.5)) for word, n in whole.having.items()}
        lists: dict[int, list[tuple[int, float]]] = defaultdict(list)
        essential: dict[int, list[tuple[int, float]]] = defaultdict(list)
        self.rest = np.zeros(len(items))
        for number, (item, words) in enumerate(zip(items, count, strict=True)):
            length = K1 * (1 - B + B * len(item.words) / mean)
            raw = {word: idf[word] * n * (K1 + 1) / (n + length) for word, n in words.items()}
            own = sum(raw.values())
            share = 0.0
            for word, impact in sorted(raw.items(), key=lambda pair: (-idf[pair[0]], -pair[1], pair[0])):
                lists[word].append((number, impact / own))
                if share < ESSENTIAL:
                    essential[word].append((number, impact / own))
                    share += impact / own
            self.rest[number] = 1 - share
        self.postings = {word: Posting(pairs) for word, pairs in lists.items()}
        self.longest = whole.longest
        # the essential postings as arrays, by term
        self.terms = np.array(sorted(essential), np.int64)
        lengths = [len(essential[word]) for word in self.terms.tolist()]
        self.lengths = np.array(lengths, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        flat = [pair for word in self.terms.tolist() for pair in essential[word]]
        self.flat_item = np.array([item for item, _ in flat], np.int64)
        self.flat_impact = np.array([impact for _, impact in flat])

    def windows(self, words: np.ndarray, doc: np.ndarray, offset: np.ndarray, threshold: float) -> np.ndarray:
        """(document, window) pairs in which the bound of some item reaches the threshold; window w begins at w * longest."""
        if not len(self.terms) or not len(words):
            return np.zeros((0, 2), np.int64)
        place = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[place] == words)
        term, doc, window = place[hit], doc[hit], offset[hit] // self.longest
        # a word lies in two windows, which overlap by half
        term, doc, window = np.tile(term, 2), np.tile(doc, 2), np.concatenate([window, window - 1])
        term, doc, window = (x[window >= 0] for x in (term, doc, window))
        span = int(window.max(initial=0)) + 1
        key = np.unique(np.stack([doc * span + window, term], 1), axis=0) if len(term) else np.zeros((0, 2), np.int64)
        at, term = key[:, 0], key[:, 1]
        # one row for each essential posting
        repeat = self.lengths[term]
        posting = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat) + np.repeat(self.starts[term], repeat)
        pair, back = np.unique(np.repeat(at, repeat) * len(self.items) + self.flat_item[posting], return_inverse=True)
        bound = np.bincount(back, self.flat_impact[posting], len(pair)) + self.rest[pair % len(self.items)]
        at = np.unique(pair[bound >= threshold - 1e-9] // len(self.items))
        return np.stack([at // span, at % span], 1)

    def retrieve(self, words: set[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose score for these words is at least `threshold`, by block-max WAND."""
        lists = [posting for posting in map(self.postings.get, words) if posting is not None]
        cursors = [[posting.items[0], 0, posting] for posting in lists]
        found = []
        while cursors:
            cursors.sort(key=lambda cursor: cursor[0])
            bound, pivot = 0.0, None
            for at, (_, _, posting) in enumerate(cursors):
                bound += posting.best
                if bound >= threshold - 1e-9:
                    pivot = at
                    break
            if pivot is None:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # the blocks that hold the pivot item, or would
            blocks, border = 0.0, len(self.items)
            for cursor in cursors[: pivot + 1]:
                posting = cursor[2]
                block = bisect_left(posting.items, item, cursor[1]) // BLOCK
                if block < len(posting.blocks):
                    blocks += posting.blocks[block]
                    end = (block + 1) * BLOCK
                    border = min(border, posting.items[end] if end < len(posting.items) else len(self.items))
            if blocks < threshold - 1e-9:  # no item before the next border can pass
                if pivot + 1 < len(cursors):
                    border = min(border, cursors[pivot + 1][0])
                target = max(border, item + 1)
                moved = cursors[: pivot + 1]
            elif cursors[0][0] == item:
                score = sum(posting.impacts[i] for _, i, posting in cursors[: pivot + 1])
                if score >= threshold - 1e-9:
                    found.append((item, score))
                target, moved = item + 1, cursors[: pivot + 1]
            else:
                target, moved = item, [cursor for cursor in cursors[: pivot + 1] if cursor[0] < item]
            for cursor in moved:
                i = bisect_left(cursor[2].items, target, cursor[1])
                cursor[1] = i
                cursor[0] = cursor[2].items[i] if i < len(cursor[2].items) else None
            cursors = [cursor for cursor in cursors if cursor[0] is not None]
        return found

    def verify(self, number: int, words: list[int]) -> tuple[float, float, float]:
        """Shares of the words of question, answer and both that lie in runs of `RUN` words shared with the passage."""
        item = self.items[number]
        run = min(RUN, len(item.words))
        there = {tuple(words[i : i + run]) for i in range(len(words) - run + 1)}
        covered = [False] * len(item.words)
        for i in range(len(item.words) - run + 1):
            if item.words[i : i + run] in there:
                covered[i : i + run] = [True] * run

        def share(part: list[bool]) -> float:
            return sum(part) / len(part) if part else 1.0

        return share(covered[: item.answer]), share(covered[item.answer :]), share(covered)


def leaks(index: Index, column: pa.Array, threshold: float, overlap: float, whole: float) -> list[list[dict]]:
    """For each text, given by its word hashes, the verified items with the best passage of each."""
    words, lengths = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    starts = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(lengths)), lengths)
    found: list[dict[int, dict]] = [{} for _ in lengths]
    for row, window in index.windows(words, doc, np.arange(len(words)) - starts[doc], threshold).tolist():
        begin = window * index.longest
        passage = words[starts[row] + begin : starts[row] + min(begin + 2 * index.longest, lengths[row])].tolist()
        for number, score in index.retrieve(set(passage), threshold):
            question, answer, both = index.verify(number, passage)
            if question >= overlap and (answer >= overlap or both >= whole):
                one = {"item_id": index.items[number].id, "score": score, "question": question, "answer": answer, "start": begin}
                if number not in found[row] or found[row][number]["score"] < score:
                    found[row][number] = one
    return [[one[number] for number in sorted(one)] for one in found]


LEAKS = "array<struct<item_id: bigint, score: double, question: double, answer: double, start: int>>"
_LEAK = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64()), ("start", pa.int32())]))


def build_indexes(benchmark: DataFrame, id: str = "item_id", text: str = "text", most_items: int = MOST_ITEMS) -> list[Index]:
    """Indexes of at most `most_items` test items each, read from a table that is small beside the corpus.

    Scores and windows don't depend on how the items are divided: the statistics are those of all items.

    Items without words are left out, as nothing can be found for them. An item without an id is found under a null id, but
    if items with an id have the same question and answer, it is found as those.
    """
    rows = benchmark.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")
    cut = F.udf(answer_start, "int")
    parts = rows.select("id", "text", cut("text").alias("cut"))
    parts = parts.select("id", word_hashes("text").alias("words"), F.size(word_hashes(F.expr("substring(text, 1, cut)"))).alias("question"))
    parts = parts.where("size(words) > 0")
    named = parts.where("id IS NOT NULL")
    nameless = parts.where("id IS NULL").join(named.select("words", "question").distinct(), ["words", "question"], "left_anti")
    numbered = stored(named.unionByName(nameless).withColumn("number", F.monotonically_increasing_id()), "items")
    length = F.size("words")
    whole = numbered.agg(F.count("*").alias("items"), F.avg(length).alias("mean"), F.max(length).alias("longest")).first()
    terms = numbered.select("number", F.explode(F.array_distinct("words")).alias("word"))
    having = terms.join(terms.groupBy("word").agg(F.count("*").alias("n")), "word").groupBy("number").agg(F.collect_list(F.struct("word", "n")).alias("having"))
    ordered = numbered.join(having, "number").orderBy("id", "words")
    indexes, items, known = [], [], {}

    def flush() -> None:
        nonlocal items, known
        if items:
            indexes.append(Index(items, Statistics(whole["items"], whole["mean"], whole["longest"], known)))
        items, known = [], {}

    for row in ordered.toLocalIterator():
        items.append(Item(row.id, tuple(row.words), min(row.question, len(row.words))))
        known.update((one.word, one.n) for one in row.having)
        if len(items) == most_items:
            flush()
    flush()
    return indexes


def leaked_items(text: str | Column, indexes: list[Index], spark, threshold: float = THRESHOLD, overlap: float = OVERLAP, whole: float = WHOLE_OVERLAP) -> Column:
    """The test items that a text holds: an array of item_id, score, overlaps and the word at which the passage begins."""

    def search(index: Index) -> Column:
        shared = spark.sparkContext.broadcast(index)

        @F.arrow_udf(LEAKS)
        def run(column: pa.Array) -> pa.Array:
            found = [one for piece in pieces(column, TOGETHER) for one in leaks(shared.value, piece, threshold, overlap, whole)]
            return pa.array(found, _LEAK)

        return run(word_hashes(text))

    return F.concat(F.array().cast(LEAKS), *[search(index) for index in indexes])


def contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **limits: float) -> DataFrame:
    """One row per document and test item that it holds: id, item_id, score, question and answer overlap, start.

    Rows of `docs` with a null or empty text hold nothing. Repeated rows give repeated results; other columns are not read.
    Empty tables on either side give no rows.
    """
    found = docs.select(F.col(id).alias("id"), leaked_items(text, build_indexes(benchmark), docs.sparkSession, **limits).alias("found"))
    one = found.select("id", F.explode("found").alias("leak"))
    return one.select(F.col("id").alias(id), "leak.item_id", "leak.score", F.col("leak.question").alias("question_overlap"), F.col("leak.answer").alias("answer_overlap"), "leak.start")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **limits: float) -> DataFrame:
    """`docs` with all its columns, without the rows that hold a test item."""
    return docs.where(F.size(leaked_items(text, build_indexes(benchmark), docs.sparkSession, **limits)) == 0)
