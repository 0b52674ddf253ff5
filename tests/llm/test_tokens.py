import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from echelon.llm import byte_bpe, token_counts
from tests.llm.conftest import LONG, rows_of

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ALPHABETS = ("aab", "the ing tion s", " \n\t  \r", "\u00e9\u6f22\u5b57\U0001f642\u00f1\u200d\u0301", "0123456789", "-=_*'\"<|>")


def drawn(random_numbers, most):
    letters = random_numbers.choice(ALPHABETS)
    return "".join(random_numbers.choice(letters if random_numbers.random() < 0.8 else "".join(ALPHABETS)) for _ in range(random_numbers.randint(0, most)))


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(RANKS, public_tokenizers.PATTERN, most_words=50, most_steps=2000)  # small tables, to be dropped often


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.transducer.ranks, special_tokens={})


def test_transducer_equals_library(codec, library):
    numbers = random.Random(5)
    for _ in range(1500):
        text = drawn(numbers, 60)
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text)
        assert "".join(codec.decode(ids)) == text


@pytest.mark.parametrize("text", ["a" * 700, " " * 600, "-" * 500, "=" * 300 + "x", "\n" * 200, "\u6f22" * 300, "ab" * 400])
def test_transducer_on_long_runs(codec, library, text):
    assert codec.encode(text) == library.encode_ordinary(text)


def test_stream_keeps_open_sequences():
    text = "\u00e9\u6f22\U0001f642a"
    data = text.encode()
    for size in (1, 2, 3, 5):
        stream = byte_bpe.Utf8Stream()
        pieces = [stream.feed(data[i : i + size]) for i in range(0, len(data), size)]
        assert "".join(pieces) + stream.finish() == text


@pytest.mark.parametrize("data", [b"\xff", b"a\xe6\xbc", b"\xf0\x9f", b"\xc3(", b"\xed\xa0\x80", b"\xe6\xff\x80x", b"\xf4\x90\x80\x80"])
def test_stream_replaces_ill_formed_bytes(data):
    stream = byte_bpe.Utf8Stream()
    assert "".join(stream.feed(data[i : i + 1]) for i in range(len(data))) + stream.finish() == data.decode("utf-8", "replace")


def test_encode_documents(awkward, library):
    got = rows_of(byte_bpe.encode_documents(awkward))
    want = []
    for row in awkward.collect():
        text = row.text or ""
        ids = library.encode_ordinary(text)
        want.append((row.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_columns_round_trip(awkward):
    back = awkward.select("text", byte_bpe.decoded(byte_bpe.encoded("text")).alias("back")).collect()
    assert all((row.text or "") == row.back for row in back)


def test_empty_tables(nothing):
    assert byte_bpe.encode_documents(nothing).count() == 0
    assert token_counts.token_counts(nothing).count() == 0


def test_resynchronised_counts_equal_whole_ones():
    tokenizer = token_counts.load(JSON)
    numbers = random.Random(11)
    for _ in range(150):
        text = " ".join(drawn(numbers, 120) for _ in range(numbers.randint(1, 8))) + numbers.choice(["", "x" * 400, " " * 500, "<|endoftext|> ", "\u6f22" * 200])
        whole = len(tokenizer.encode(text, add_special_tokens=False))
        for chunk, overlap in ((40, 4), (200, 16), (333, 64)):
            assert token_counts.count_long(tokenizer, text, chunk, overlap) == whole


def test_overlaps_widen_where_nothing_aligns():
    tokenizer = token_counts.load(JSON)
    text = "word " * 30 + "x" * 900 + " end of it " * 20
    assert token_counts.count_long(tokenizer, text, 100, 8) == len(tokenizer.encode(text, add_special_tokens=False))


def test_token_counts(awkward):
    tokenizer = token_counts.load(JSON)
    want = []
    for row in awkward.collect():
        text = row.text or ""
        n = len(tokenizer.encode(text, add_special_tokens=False))
        want.append((row.doc_id, len(text.encode()), n, n > 512))
    assert rows_of(token_counts.token_counts(awkward)) == sorted(want, key=repr)
    assert len(LONG) > token_counts.CHUNK
    assert rows_of(token_counts.token_counts(awkward, chunk=1000, overlap=16)) == sorted(want, key=repr)


SPACELESS = "\u6f22\u5b57\u3002" * 400
UNBROKEN = "\u6f22\u5b57" * 600
SPECIAL = "a<|endoftext|>b'll9\u0301 <|endoftext|>\u3002\u6f22" * 60


@pytest.mark.parametrize("text", [SPACELESS, UNBROKEN, SPECIAL, UNBROKEN + SPACELESS + "x " * 300 + UNBROKEN, "e\u0301" * 700, "a1" * 900, "it's'" * 300, "!" * 900 + "a"])
@pytest.mark.parametrize("sizes", [(64, 20), (200, 32)])
def test_splices_without_spaces_equal_library(text, sizes):
    tokenizer = token_counts.load(JSON)
    assert token_counts.count_long(tokenizer, text, *sizes) == len(tokenizer.encode(text, add_special_tokens=False))


def test_splices_of_drawn_texts_equal_library():
    numbers = random.Random(8)
    tokenizer = token_counts.load(JSON)
    for _ in range(300):
        text = "".join(drawn(numbers, 60) for _ in range(8)) + numbers.choice(["", "<|endoftext|>", "<|endo"]) + drawn(numbers, 60)
        assert token_counts.count_long(tokenizer, text, 40, 15) == len(tokenizer.encode(text, add_special_tokens=False)), text


@pytest.mark.parametrize("piece", ["\u6f22\u5b57\u3002", "\u6f22", "word ", "1a", "! "])
def test_long_texts_are_encoded_a_bounded_number_of_times(piece, monkeypatch):
    sizes = []
    encoded = token_counts.Encoded

    def counted(tokenizer, text, start, end):
        sizes.append(end - start)
        return encoded(tokenizer, text, start, end)

    monkeypatch.setattr(token_counts, "Encoded", counted)
    text = piece * (40_000 // len(piece))
    token_counts.count_long(token_counts.load(JSON), text, 1000, 50)
    assert sum(sizes) < 5 * len(text)
