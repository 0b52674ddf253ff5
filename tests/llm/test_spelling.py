import collections
import random
import re
import zlib

from echelon.llm import spelling
from tests.llm.conftest import rows_of

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lowered(run):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in run)


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(rows, length, count, ratio, slips):
    n = collections.Counter()
    for id, text in rows:
        for run in map(lowered, RUN.findall(text or "")):
            h = zlib.crc32(f"{'' if id is None else id}:{run}".encode())
            if h % slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {word: many for word, many in n.items() if len(word) >= length and many >= count}
    best, number = {}, {}
    for word, many in words.items():
        others = [other for other in words if near(word, other)]
        number[word] = len(others)
        first = min(others, key=lambda other: (-words[other], other), default=None)
        best[word] = first if first is not None and words[first] >= ratio * many else None
    out = []
    for word in words:
        root = word
        while best[root] is not None:
            root = best[root]
        out.append((word, best[word], root, words[word], number[word], words[best[word]] if best[word] else None))
    return sorted(out, key=repr)


def texts(seed):
    numbers = random.Random(seed)
    letters = "abcABéÉ×"
    words = ["".join(numbers.choices(letters, k=numbers.randrange(1, 7))) for _ in range(60)] + ["aab", "ab", "aaab", "aaaab", "abab", "bbbb", "bbb"]
    weights = [10 ** numbers.uniform(0, 3) for _ in words]
    return [(numbers.choice([i, None, i % 5]), numbers.choice([" ", "-", "9", "Ā"]).join(numbers.choices(words, weights, k=numbers.randrange(0, 200)))) for i in range(60)]


def test_variants_equal_brute_force(spark):
    for seed, (length, count, ratio, slips) in enumerate([(1, 1, 2, 7), (2, 2, 3, 31), (3, 1, 10, 3)]):
        rows = texts(seed)
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
        got = rows_of(spelling.spelling_variants(docs, least_length=length, least_count=count, ratio=ratio, slips=slips))
        assert got == by_hand(rows, length, count, ratio, slips)


def test_chains_of_forms_end_at_the_root(spark):
    rows = [(1, " ".join(["abcdefgh"] * 1000 + ["abcdefg"] * 100 + ["abcdef"] * 10 + ["abcde"]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = spelling.spelling_variants(docs, least_length=1, least_count=1, slips=10**9)
    assert {row.word: row.root for row in got.collect()} == dict.fromkeys(["abcde", "abcdef", "abcdefg", "abcdefgh"], "abcdefgh")


def test_long_texts_are_split_between_runs():
    text = " ".join("x" * (i % 9) for i in range(500)) + "y" * 100
    for piece in (1, 7, 64, 10_000):
        assert list(spelling.runs_of(text, piece)) == RUN.findall(text)


def test_awkward_rows(awkward, nothing):
    rows = [(row.doc_id, row.text) for row in awkward.collect()]
    assert rows_of(spelling.spelling_variants(awkward, least_length=3)) == by_hand(rows, 3, 2, 10, 31)
    assert rows_of(spelling.spelling_variants(awkward, least_length=1, least_count=1)) == by_hand(rows, 1, 1, 10, 31)
    assert spelling.spelling_variants(nothing).collect() == []
