"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text of at most `chunk` code points is encoded at once. A longer one is encoded in chunks that overlap. Both encodings
carry offsets; they are spliced at a boundary that both have and that provably stands in the encoding of the whole text:
after a letter or digit that something of another kind follows (white space, a mark, punctuation, a digit after a letter).
No match of the pre-tokenizer's pattern goes on there, it has no look-behind, and its look-ahead concerns white space only;
so one match ends and another begins there whatever surrounds it. Only code points whose kind never changed between
versions of Unicode count. If the overlap has no such place, it is widened to the last one of the left chunk; if that
chunk has none at all, both are encoded as one, and the next chunk is as long as both, so that the work stays linear.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache
from unicodedata import category, ucd_3_2_0

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from echelon.llm.common import text_of, token_path

CHUNK = 1 << 16
OVERLAP = 1 << 9
#: Code points that go to the tokenizer in one call; an encoding takes some hundred bytes per token.
CALL = 1 << 17


@lru_cache(maxsize=2)
def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def splits_at_space(tokenizer) -> bool:
    """Whether the argument in this module's docstring holds: no normaliser, and the byte-level pattern cuts the text."""
    return tokenizer.normalizer is None and "ByteLevel(" in repr(tokenizer.pre_tokenizer) and "use_regex=True" in repr(tokenizer.pre_tokenizer)


class Encoded:
    """The tokens of text[start:end], by their offsets in the whole text."""

    def __init__(self, tokenizer, text: str, start: int, end: int):
        self.start, self.end = start, end
        spans = tokenizer.encode(text[start:end], add_special_tokens=False).offsets
        self.starts = [start + a for a, _ in spans]
        self.ends = [start + b for _, b in spans]

    def __len__(self) -> int:
        return len(self.starts)

    def before(self, place: int) -> int | None:
        """How many tokens end at `place` or earlier, None if a token spans it."""
        count = bisect_left(self.starts, place)
        return count if not count or self.ends[count - 1] <= place else None


@lru_cache(maxsize=1 << 16)
def kind(char: str) -> str | None:
    """The first letter of the general category (white space: Z), None if it changed or may yet change."""
    if char in "\t\n\r":
        return "Z"
    now = category(char)[0]
    return now if now == ucd_3_2_0.category(char)[0] != "C" else None


def stands(text: str, place: int, special: tuple[str, ...]) -> bool:
    """Whether a match of the pattern provably ends before text[place], whatever surrounds it; not within a special string."""
    before = kind(text[place - 1])
    if before not in ("L", "N") or kind(text[place]) in (before, None):
        return False
    return all(text.find(one, max(0, place - len(one) + 1), place + len(one) - 1) < 0 for one in special)


def splice(text: str, left: Encoded, right: Encoded, special: tuple[str, ...]) -> tuple[int, int, int] | None:
    """The last stable boundary in the overlap, and the numbers of tokens before it in `left` and `right`."""
    for place in range(left.end - 1, right.start, -1):
        if stands(text, place, special):
            counts = left.before(place), right.before(place)
            if None not in counts:
                return place, *counts
    return None


def count_long(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text of any length, encoded chunk by chunk."""
    total, skipped, size = 0, 0, chunk
    special = tuple(one.content for one in tokenizer.get_added_tokens_decoder().values())
    left = Encoded(tokenizer, text, 0, min(chunk, len(text)))
    while left.end < len(text):
        end = min(left.end + size, len(text))
        last = next((place for place in range(left.end - 1, left.start, -1) if stands(text, place, special) and left.before(place) is not None), left.start)
        width = max(overlap, 2 * (left.end - last))
        while True:
            start = max(left.start, left.end - width)
            right = Encoded(tokenizer, text, start, end)
            found = splice(text, left, right, special) if start > left.start else None
            if found or start == left.start:
                break
            width *= 4
        if found:
            _, kept, dropped = found
            total += kept - skipped
            skipped, size = dropped, chunk
        else:
            # both chunks were encoded as one, which starts where `left` did, so `skipped` still holds
            size = right.end - right.start
        left = right
    return total + len(left) - skipped


def count_tokens(texts: list[str], path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    tokenizer = load(path)
    whole = not splits_at_space(tokenizer)
    counts = [0] * len(texts)
    call: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        encoded = tokenizer.encode_batch_fast([texts[i] for i in call], add_special_tokens=False)
        for i, one in zip(call, encoded, strict=True):
            counts[i] = len(one)
        call.clear()
        size = 0

    for i, text in enumerate(texts):
        if len(text) > chunk and not whole:
            counts[i] = count_long(tokenizer, text, chunk, overlap)
            continue
        call.append(i)
        size += len(text)
        if size >= CALL:
            flush()
    flush()
    return counts


def token_count(text: str | Column, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Number of tokens of a text column as the library gives them; null and empty texts have none."""
    path = path or token_path("byte_bpe_50k.json")

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array(count_tokens(texts.to_pylist(), path, chunk, overlap), pa.int64())

    return counted(text_of(text))


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 512, id: str = "doc_id", text: str = "text", **sizes: int) -> DataFrame:
    """One row per row of `docs`: id, n_bytes, n_tokens and whether n_tokens exceeds `limit`.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids stay rows of their own. Other columns of
    `docs` are not read. An empty table gives no rows.
    """
    counted = docs.select(id, F.octet_length(text_of(text)).cast("long").alias("n_bytes"), token_count(text, path, **sizes).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
