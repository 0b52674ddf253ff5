"""Spelling variants of words found in sorted permuterm rotations.

A word and a terminator, rotated to every place, give all its rotations. Two words that differ by the code point at one place
have rotations that are equal up to their last code point, the edited one; if a word has one code point more than another, a
whole rotation of the shorter is the prefix of one of the longer without that code point. So every rotation enters the order
twice, whole and without its last code point, and words next to each other by a single edit meet in ranges of one prefix.
Such a range holds a whole rotation at most and one word for each last code point, so it is bounded by the alphabet. Each
range is read once: its words get their number of neighbours there and the best of the others, never a list of pairs. An
inserted code point within a run of equal ones is counted at the first place of the run only.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from echelon.llm.common import stored, text_of

LEAST_LENGTH = 7
LEAST_COUNT = 2
#: How many times as often as a word its form has to be.
RATIO = 10
#: One of so many runs loses a code point.
SLIPS = 31
TERMINATOR = "$"
#: Distinct words that a task counts before it hands them on, and code points of a text that it splits at a time.
HELD, PIECE = 200_000, 1_000_000
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}


def runs_of(text: str, piece: int = PIECE) -> Iterator[str]:
    """Maximal runs of letters; a long text is split between runs."""
    start = 0
    while len(text) - start > piece:
        end = start + piece
        if last := _RUN.match(text, end):  # a run goes on here
            end = last.end()
        yield from _RUN.findall(text, start, end)
        start = end
    yield from _RUN.findall(text, start)


def slipped(run: str, seed: int, slips: int) -> str:
    """A run without the code point that its checksum points at, if the checksum is one of `slips`."""
    sum = zlib.crc32(run.encode(), seed)
    if sum % slips:
        return run
    at = sum % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", slips: int = SLIPS) -> DataFrame:
    """word, n: how often each word is found in all texts, after the slips; null ids count as empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def given() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for id, text in zip(batch.column("id"), batch.column("text"), strict=True):
                seed = zlib.crc32(f"{id.as_py()}:".encode())
                lowered: Counter[str] = Counter()
                for run, n in Counter(runs_of(text.as_py())).items():
                    lowered[run.translate(_LOWER)] += n
                for run, n in lowered.items():
                    held[slipped(run, seed, slips)] += n
                if len(held) >= HELD:
                    yield given()
        yield given()

    read = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"), text_of(text).alias("text"))
    return read.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """word, n and, for each place of the terminator, the rotation whole and without its last code point.

    `edited` tells whether the last code point was left out, `counts` whether it is the first of a run of equal ones.
    """
    word, at = F.col("word"), F.col("at")
    each = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.char_length("word"))).alias("at"))
    head = F.concat(F.substr(word, at + 1), F.lit(TERMINATOR))
    last, before = F.substr(word, at, F.lit(1)), F.substr(word, at - 1, F.lit(1))
    whole = F.struct(F.concat(head, F.substr(word, F.lit(1), at)).alias("prefix"), F.lit(False).alias("edited"), F.lit(False).alias("counts"))
    first = (at == 1) | (before != last)
    cut = F.struct(F.concat(head, F.substr(word, F.lit(1), at - 1)).alias("prefix"), F.lit(True).alias("edited"), first.alias("counts"))
    both = F.when(at > 0, F.array(whole, cut)).otherwise(F.array(whole))
    return each.select("word", "n", F.explode(both).alias("rotation")).select("word", "n", "rotation.*")


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near (words that differ by one edit) and the best of them: the smallest struct (less = -n, word)."""
    members = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "word", "edited", "counts"))).alias("members")
    ranges = rotations(words).groupBy("prefix").agg(members).where(F.size("members") > 1)
    edited = F.size(F.filter("members", lambda one: one["edited"])).cast("long")
    inserted = F.size(F.filter("members", lambda one: one["counts"])).cast("long")
    counted = ranges.select("members", edited.alias("cut"), inserted.alias("inserted"))
    whole = (F.size("members") > F.col("cut")).cast("long")

    def met(one, i):
        best = F.when(i == 0, F.get("members", F.lit(1))).otherwise(F.get("members", F.lit(0)))
        near = F.when(one["edited"], F.col("cut") - 1 + F.when(one["counts"], whole).otherwise(F.lit(0))).otherwise(F.col("inserted"))
        return F.struct(one["word"].alias("word"), near.alias("near"), F.struct(best["less"].alias("less"), best["word"].alias("word")).alias("best"))

    each = counted.select(F.explode(F.transform("members", met)).alias("met")).select("met.*")
    return each.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: forms (word, form) followed to the last. A form is more frequent than its word, so there is an end."""
    found = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = found.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        after = stored(joined, "roots")
        found = after.select("word", "root")
        if after.where("moved").isEmpty():
            return found


def spelling_variants(
    docs: DataFrame, id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, slips: int = SLIPS
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are runs of letters (A to Z in either case, U+00C0 to U+00FF), A to Z in lower case; a run whose checksum with the
    id of its document is a multiple of `slips` loses one code point first. Words of at least `least_length` code points and
    `least_count` occurrences stay. A word's form is the most frequent of the words one edit away (ties: the smallest), if
    that is at least `ratio` times as frequent; `root` is where forms end, the word itself if it has none. Null and empty
    texts have no words, a null id counts as an empty one, repeated rows count as often as they are there; other columns
    aren't read, and without words there are no rows.
    """
    counts = word_counts(docs, id, text, slips).where((F.char_length("word") >= least_length) & (F.col("n") >= least_count))
    words = stored(counts, "words")
    met = words.join(neighbours(words), "word", "left")
    near, often = F.coalesce("n_near", F.lit(0).cast("long")), -F.col("best.less") >= ratio * F.col("n")
    named = met.select("word", "n", near.alias("n_near"), F.when(often, F.col("best.word")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n"))
    named = stored(named, "forms")
    last = roots(named.where("form IS NOT NULL"))
    return named.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
