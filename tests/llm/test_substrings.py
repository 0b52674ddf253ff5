import collections
import hashlib
import random
import re

import numpy as np
import pytest

from echelon.llm import substring_dedup
from tests.llm.conftest import rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(rows, window):
    """Every window of every row counted by its words."""
    words = [WORD.findall(text or "") for _, text in rows]
    seen = collections.Counter(tuple(one[i : i + window]) for one in words for i in range(len(one) - window + 1))
    out = []
    for (id, _), one in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(one) - window + 1):
            if seen[tuple(one[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        left = [word for i, word in enumerate(one) if i not in gone]
        out.append((id, len(one), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


def texts(seed, window, n=60):
    """Random words with passages of lengths around the window at random places, copies, loops and odd white space."""
    numbers = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    passages = [numbers.choices(words, k=window + k) for k in (-2, -1, 0, 0, 1, 7, 40)]
    rows = []
    for i in range(n):
        parts = numbers.choices(words, k=numbers.randrange(0, 90))
        for _ in range(numbers.randrange(0, 3)):
            at = numbers.randrange(0, len(parts) + 1)
            parts[at:at] = numbers.choice(passages)
        rows.append((i, numbers.choice([" ", "\n", " \t ", "\x0b"]).join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "loop " * (2 * window)), (103, "once " * window), (104, "twice " * (window + 1)), (None, rows[5][1]), (105, None), (106, ""), (107, " x y " * window)]
    return rows


@pytest.mark.parametrize("period", substring_dedup.COVERS)
def test_every_distance_occurs_in_a_cover(period):
    cover = substring_dedup.COVERS[period]
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("window", [1, 2, 5, 11, 35])
def test_report_equals_brute_force(spark, window):
    rows = texts(window, window)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = substring_dedup.substring_report(docs, window=window, bucket_bytes=500, chunk_words=300)
    assert rows_of(got) == by_hand(rows, window)


def test_texts_left(spark):
    rows = texts(3, 7)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = [(row.doc_id, hashlib.sha256(" ".join(WORD.findall(row.text or "")).encode()).hexdigest()) for row in substring_dedup.without_repeats(docs, window=7).collect()]
    assert sorted(left, key=repr) == sorted([(id, digest) for id, _, _, digest in by_hand(rows, 7)], key=repr)


def test_awkward_rows(spark, awkward, nothing):
    rows = [(row.doc_id, row.text) for row in awkward.collect()]
    for window in (4, 35):
        assert rows_of(substring_dedup.substring_report(awkward, window=window)) == by_hand(rows, window)
    assert substring_dedup.without_repeats(awkward).columns == awkward.columns
    assert substring_dedup.substring_report(nothing).collect() == []
    assert substring_dedup.without_repeats(nothing).collect() == []


def test_run_hashes_tell_runs_apart():
    words = np.arange(50, dtype=np.uint64) % np.uint64(7)
    for size in (1, 2, 3, 15, 35):
        value = substring_dedup.run_hashes(words, size)
        assert len(value) == 50 - size + 1
        assert len(set(value.tolist())) == min(7, len(value))
        assert len(substring_dedup.run_hashes(words[: size - 1], size)) == 0
