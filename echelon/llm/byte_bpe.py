"""Byte-level BPE: encoding by a lazily determinised transducer, streaming decoding by a UTF-8 state machine.

A sequence of tokens is the BPE encoding of its bytes exactly if every token encodes to itself and every two neighbours,
joined, encode to those two. So a non-deterministic transducer that walks the vocabulary's trie and, at a token's end,
goes back to the root where the pair with the token before is valid, has exactly one accepting path per input: the
encoding. `Transducer` determinises it as bytes are seen. A state is the set of open hypotheses (trie node, last token,
tokens not yet emitted); what all hypotheses share is emitted at once, so a token waits for at most as many bytes as the
longest token has. States and steps are kept for the next words, in bounded tables that are dropped when full.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from echelon.llm.common import text_of, token_path

#: Kept steps and words of one Python worker.
MOST_STEPS = 400_000
MOST_WORDS = 250_000
#: Tokens that are decoded at a time.
DECODE_CHUNK = 8192


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Transducer:
    """Encodes one match of the pre-tokenizer's pattern after another."""

    def __init__(self, ranks: dict[bytes, int], most_steps: int = MOST_STEPS):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.most_steps = most_steps
        self.split: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._compile()
        self._clear()

    def _compile(self) -> None:
        """The trie: `edges[node * 256 + byte]` is the next node, `ends[node]` the token that ends there."""
        self.edges: dict[int, int] = {}
        self.ends: list[int | None] = [None]
        for token, rank in self.ranks.items():
            node = 0
            for byte in token:
                key = node * 256 + byte
                following = self.edges.get(key)
                if following is None:
                    following = self.edges[key] = len(self.ends)
                    self.ends.append(None)
                node = following
            self.ends[node] = rank
        inner = {key >> 8 for key in self.edges}
        self.open = [node in inner for node in range(len(self.ends))]

    def _clear(self) -> None:
        start = ((0, None, ()),)
        self.states: list[tuple] = [start]
        self.numbers: dict[tuple, int] = {start: 0}
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.rest: list[tuple[int, ...] | None] = [()]

    def _parts(self, data: bytes, most: int = 1) -> list[bytes]:
        """Merge the pair of the lowest rank, leftmost first, until no pair is in the vocabulary or `most` parts are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > most:
            best, place = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 60:
                break
            parts[place : place + 2] = [parts[place] + parts[place + 1]]
        return parts

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts of a token's last merge; None for a single byte and for a token that its own bytes do not merge to."""
        if token not in self.split:
            parts = self._parts(token, 2)
            self.split[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.split[token]

    def is_sound(self, token: bytes) -> bool:
        return len(token) == 1 or self.halves(token) is not None

    def is_valid(self, before: int | None, token: int) -> bool:
        """Whether `token` may follow `before`: no merge across their boundary comes before the merges that make them.

        The merges are undone from the last one on. While parts a and b touch at the boundary, a merge of the two takes
        place if its rank is below that of the merge that uses a, or at most that of the merge that uses b (the left one
        of two equal merges comes first).
        """
        if before is None:
            return self.is_sound(self.bytes_of[token])
        known = self.pairs.get((before, token))
        if known is None:
            if len(self.pairs) > self.most_steps:
                self.pairs.clear()
            known = self.pairs[before, token] = self._touch(self.bytes_of[before], self.bytes_of[token])
        return known

    def _touch(self, left: bytes, right: bytes) -> bool:
        if not self.is_sound(right):
            return False
        ranks, below = self.ranks, 1 << 60
        while True:
            rank = ranks.get(left + right)
            if rank is not None and rank < below:
                return False
            made_left = ranks[left] if len(left) > 1 else -1
            made_right = ranks[right] if len(right) > 1 else -1
            if made_left > made_right:
                below, left = made_left, self.halves(left)[1]
            elif made_right >= 0:
                below, right = made_right + 1, self.halves(right)[0]
            else:
                return True

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Determinise one step: the next state and the tokens that it emits."""
        after = []
        edges, ends, opens, pairs = self.edges, self.ends, self.open, self.pairs
        for node, last, waiting in self.states[state]:
            following = edges.get(node * 256 + byte)
            if following is None:
                continue
            token = ends[following]
            if token is not None:
                valid = pairs.get((last, token))
                if self.is_valid(last, token) if valid is None else valid:
                    after.append((0, token, (*waiting, token)))
            if opens[following]:
                after.append((following, last, waiting))
        # each hypothesis is a way to end within the longest token, so there are few
        first, length = after[0][2], 0
        shortest = min([len(waiting) for _, _, waiting in after])
        while length < shortest and all([waiting[length] == first[length] for _, _, waiting in after]):
            length += 1
        shared = first[:length]
        if length:
            after = [(node, last, waiting[length:]) for node, last, waiting in after]
        key = tuple(after)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.rest.append(next((waiting for node, _, waiting in key if node == 0), None))
        step = self.steps[state * 256 + byte] = (number, shared)
        return step

    def encode(self, word: bytes) -> list[int]:
        if len(self.steps) > self.most_steps:
            self._clear()
        steps, state, out = self.steps, 0, []
        for byte in word:
            step = steps.get(state * 256 + byte)
            if step is None:
                step = self._step(state, byte)
            state, emitted = step
            if emitted:
                out += emitted
        out += self.rest[state]
        return out


class Utf8Stream:
    """Incremental UTF-8: each piece of bytes goes in, the text that is complete so far comes out.

    The state is the open sequence (at most three bytes); ill-formed bytes become U+FFFD, as a decoder with replacement does.
    """

    def __init__(self) -> None:
        self.open = b""

    @staticmethod
    def _tail(data: bytes) -> int:
        """Length of an unfinished sequence at the end of `data`."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= byte <= 0xDF else 3 if 0xE0 <= byte <= 0xEF else 4 if 0xF0 <= byte <= 0xF4 else 1
            if need <= back:
                return 0
            second = data[len(data) - back + 1] if back > 1 else None
            low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
            high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
            return back if second is None or low <= second <= high else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.open + data
        tail = self._tail(data)
        self.open = data[len(data) - tail :] if tail else b""
        return data[: len(data) - tail].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


class Codec:
    def __init__(self, path: str, pattern: str, most_words: int = MOST_WORDS, most_steps: int = MOST_STEPS):
        import regex

        self.matches = regex.compile(pattern).findall
        self.transducer = Transducer(read_ranks(path), most_steps)
        self.bytes_of = self.transducer.bytes_of
        self.most_words = most_words
        self.digits = {id: str(id) for id in self.bytes_of}
        self.words: dict[str, list[int]] = {}

    def trim(self) -> None:
        """Give back what was kept for the next words; the trie stays."""
        self.words.clear()
        self.transducer._clear()
        self.transducer.pairs.clear()

    def _ids(self, word: str) -> list[int]:
        if len(self.words) >= self.most_words:
            self.words.clear()
        ids = self.words[word] = self.transducer.encode(word.encode())
        return ids

    def encode(self, text: str) -> list[int]:
        words, known, out = self.words, self.words.get, []
        for word in self.matches(text):
            out += known(word) or self._ids(word)
        return out

    def decode_bytes(self, ids: Iterable[int]) -> Iterator[bytes]:
        """The bytes of a stream of ids, `DECODE_CHUNK` tokens at a time."""
        ids = list(ids)
        for start in range(0, len(ids), DECODE_CHUNK):
            yield b"".join(map(self.bytes_of.__getitem__, ids[start : start + DECODE_CHUNK]))

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """The text of a stream of ids, piece by piece."""
        stream = Utf8Stream()
        for data in self.decode_bytes(ids):
            yield stream.feed(data)
        yield stream.finish()


@contextmanager
def no_cycle_search():
    """The tables hold millions of small tuples without cycles; searching them for garbage again and again takes a fifth of the time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _defaults(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or token_path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encoded(text: str | Column, path: str | None = None, pattern: str | None = None) -> Column:
    """The token ids of a text column, without special tokens; null and empty texts give an empty array."""
    path, pattern = _defaults(path, pattern)

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        own = codec(path, pattern)
        with no_cycle_search():
            return pa.array([own.encode(one.as_py()) for one in texts], pa.list_(pa.int32()))

    return run(text_of(text))


def decoded(ids: str | Column, path: str | None = None, pattern: str | None = None) -> Column:
    """The text of an array of token ids; null gives the empty text, ill-formed UTF-8 becomes U+FFFD."""
    path, pattern = _defaults(path, pattern)

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        own = codec(path, pattern)
        return pa.array(["".join(own.decode(one.as_py())) for one in values], pa.string())

    return run(F.coalesce(F.col(ids) if isinstance(ids, str) else ids, F.array().cast("array<int>")))


def round_trip(text: str | Column, path: str | None = None, pattern: str | None = None, release: bool = False) -> Column:
    """Encode, then decode the ids: a struct of n_tokens, ids_sha256 and decoded_sha256. The ids stay in the task.

    `release` gives back the kept words and steps (some 200 MB a worker) after each partition, for jobs in which the
    workers serve other operators as well; without it they speed up the next partition.
    """
    path, pattern = _defaults(path, pattern)

    def digests(own: Codec, value: str) -> dict:
        ids = own.encode(value)
        data, stream = hashlib.sha256(), Utf8Stream()
        for piece in own.decode_bytes(ids):
            data.update(stream.feed(piece).encode())
        data.update(stream.finish().encode())
        return {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(" ".join(map(own.digits.__getitem__, ids)).encode()).hexdigest(), "decoded_sha256": data.hexdigest()}

    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    @F.arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for texts in batches:
            with no_cycle_search():
                rows = [digests(own, one.as_py()) for one in texts]
            yield pa.array(rows, kind)
        if release:
            own.trim()

    return run(text_of(text))


def encode_documents(
    docs: DataFrame, path: str | None = None, pattern: str | None = None, id: str = "doc_id", text: str = "text", release: bool = False
) -> DataFrame:
    """One row per row of `docs`: id, n_tokens and the digests of the ids and of the decoded text.

    A null text counts as empty: no tokens and the digests of nothing. Repeated rows and null ids stay rows of their own;
    other columns of `docs` are not read; an empty table gives no rows.
    """
    return docs.select(id, round_trip(text, path, pattern, release).alias("coded")).select(id, "coded.n_tokens", "coded.ids_sha256", "coded.decoded_sha256")
