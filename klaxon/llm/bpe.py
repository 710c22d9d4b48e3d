"""Byte-level BPE with a public vocabulary: encoding, decoding and their digests.

A text is cut into pre-tokens; each distinct pre-token is merged once per worker and kept in
a bounded memo.  Merging walks a queue of (merge rank, position) over a doubly linked list of
symbols: the lowest rank first, leftmost among equals; an entry whose pair has changed since
it was queued is stale and is skipped.  Decoding concatenates the vocabulary's byte strings.

Nulls: a null text is encoded as the empty text (no ids).  Repeated rows are encoded each on
their own, an empty table gives an empty result, other columns pass through; a column that has
the name of an output is replaced.  Texts are never cut, however long.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from struct import pack

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from klaxon.llm.common import appended, map_batches, texts_of, with_columns

# The White_Space class and the pre-token pattern of the vocabulary.
SPACE = "\t-\r \x85\xa0  -     　"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

# Entries of each of the two halves of a memo, and the longest text that is kept in one.
MEMO_ENTRIES = 200_000
MEMO_CHARS = 48
# What keeps a text from being cut at single spaces and line feeds alone.
UNEVEN = re.compile(r"\s\s|[^\S \n]|^\s|\s\Z")

OUTPUTS = {
    "ids": T.BinaryType(),
    "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(),
    "decoded": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown}
    hidden = (b for b in range(256) if b not in set(shown))
    return letters | {chr(256 + i): b for i, b in enumerate(hidden)}


class Memo(dict):
    """A dict that fills itself through `make`; when full, only what is asked for again stays."""

    def __init__(self, make, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.make = make
        self.entries = entries
        self.older: dict = {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= MEMO_CHARS:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        self[key] = value


class ByteBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.strings = {i: bytes(letters[c] for c in s) for s, i in vocab.items()}
        self.single = [vocab[c] for c in sorted(letters, key=letters.get)]
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[left], vocab[right]] = rank
            self.merged.append(vocab[left + right])
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.strings |= {i: s.encode() for s, i in self.added.items()}
        longest = sorted(self.added, key=len, reverse=True)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")").split if longest else None
        self.pre_token_pattern = regex.compile(PRE_TOKEN)
        self.pre_tokens = self.pre_token_pattern.findall
        self.pieces = Memo(self.merge)
        self.words = Memo(self.encode_word)

    def merge(self, piece: str) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers."""
        rank_of, merged, single = self.ranks.get, self.merged, self.single
        symbols = [single[b] for b in piece.encode()]
        count = len(symbols)
        if count > 1:
            # Rank of the pair that begins at each symbol, -1 where it can't be merged.
            pair = [rank_of(p, -1) for p in zip(symbols, symbols[1:])]
            pair.append(-1)
            # An entry is rank * 2^32 + position, so ties go to the leftmost.
            queue = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
            heapify(queue)
            right = list(range(1, count + 1))
            left = list(range(-1, count - 1))
            while queue:
                entry = heappop(queue)
                i = entry & 0xFFFFFFFF
                rank = entry >> 32
                if pair[i] != rank:  # stale
                    continue
                j = right[i]
                new = symbols[i] = merged[rank]
                symbols[j] = pair[j] = -1
                after = right[i] = right[j]
                if after < count:
                    left[after] = i
                    rank = pair[i] = rank_of((new, symbols[after]), -1)
                    if rank >= 0:
                        heappush(queue, rank << 32 | i)
                else:
                    pair[i] = -1
                before = left[i]
                if before >= 0:
                    rank = pair[before] = rank_of((symbols[before], new), -1)
                    if rank >= 0:
                        heappush(queue, rank << 32 | before)
            symbols = [s for s in symbols if s >= 0]
        return pack(f"<{len(symbols)}I", *symbols)

    def encode_run(self, text: str) -> bytes:
        """Ids of a text without added tokens, pre-token by pre-token."""
        return b"".join(map(self.pieces.__getitem__, self.pre_tokens(text)))

    def encode_word(self, word: str) -> bytes:
        """Ids of a word after a space, or after a line feed that the word begins with."""
        return self.encode_run(word if word[:1] == "\n" else " " + word)

    def encode_plain(self, text: str) -> bytes:
        """As encode_run; a text of words parted by single spaces or line feeds goes by whole words.

        No pre-token goes on past such a space or line feed, so the words are independent.
        """
        if UNEVEN.search(text):
            return self.encode_run(text)
        first, *words = text.replace("\n", " \n").split(" ")
        return self.encode_run(first) + b"".join(map(self.words.__getitem__, words))

    def encode(self, text: str) -> bytes:
        if self.split_added is None or not any(s in text for s in self.added):
            return self.encode_plain(text)
        return b"".join(
            self.added[x].to_bytes(4, "little") if x in self.added else self.encode_plain(x)
            for x in self.split_added(text)
        )

    def decode(self, ids: bytes) -> str:
        strings = map(self.strings.__getitem__, memoryview(ids).cast("I").tolist())
        return b"".join(strings).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_documents(
    df: DataFrame, path: str, text_col: str = "text", outputs: tuple[str, ...] = ("ids", "n_tokens")
) -> DataFrame:
    """`df` with the named outputs of OUTPUTS; `decoded` comes from the ids alone.

    path: a vocabulary file that every executor can open under this name.
    """
    schema = appended(df, [T.StructField(n, OUTPUTS[n]) for n in outputs])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        decoding = "decoded" in outputs or "decoded_sha256" in outputs
        for batch in batches:
            found: dict[str, list] = {n: [] for n in outputs}
            for text in texts_of(batch.column(text_col)):
                ids = bpe.encode(text)
                made = {"ids": ids, "n_tokens": len(ids) // 4}
                if "ids_sha256" in found:
                    made["ids_sha256"] = hashlib.sha256(ids).hexdigest()
                if decoding:
                    made["decoded"] = bpe.decode(ids)
                if "decoded_sha256" in found:
                    made["decoded_sha256"] = hashlib.sha256(made["decoded"].encode()).hexdigest()
                for n in outputs:
                    found[n].append(made[n])
            kinds = {"ids": pa.binary(), "n_tokens": pa.int64()}
            arrays = {n: pa.array(found[n], kinds.get(n, pa.string())) for n in outputs}
            yield with_columns(batch, schema.names, arrays)

    return map_batches(df, work, schema)


def decode_ids(df: DataFrame, path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """`df` with the text of its ids; null ids give a null text."""
    schema = appended(df, [T.StructField(into, T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x) for x in batch.column(ids_col).to_pylist()]
            yield with_columns(batch, schema.names, {into: pa.array(texts, pa.string())})

    return map_batches(df, work, schema)
