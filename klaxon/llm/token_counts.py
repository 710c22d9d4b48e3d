"""Token counts that follow edits: a segment tree of pre-tokens per document.

The leaves of a document's tree are runs of up to RUN pre-tokens; every node holds the
characters and tokens below it.  An edit descends by characters to the leaf that it touches,
cuts the text into pre-tokens anew from just before the edit until a cut falls on an old one
behind it, encodes only those pre-tokens, and corrects the sums on the paths upward.  The
pattern looks ahead by one character at most beyond a pre-token and never back, so a pre-token
that ends two characters before the edit stands, and so does everything after a common cut.

Counts are those of the text as ordinary text: strings of added tokens count as their pieces.

Nulls: a null text is empty, with no tokens; a null list of edits is no edit; a null bound or
text of an edit is 0 or empty.  Bounds beyond the text are moved to its end, and a stop before
its start to the start.  Repeated rows keep a tree each; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from klaxon.llm.bpe import Memo, loaded
from klaxon.llm.common import appended, map_batches, texts_of, with_columns

RUN = 64


class Counter:
    """Token counts of pre-tokens of one vocabulary."""

    def __init__(self, path: str):
        bpe = loaded(path)
        self.cut = bpe.pre_tokens
        self.cut_from = bpe.pre_token_pattern.finditer
        self.tokens = Memo(lambda piece: len(bpe.merge(piece)) // 4)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


class Tree:
    """One document: its text, runs of (characters, tokens) of pre-tokens, and sums over runs."""

    def __init__(self, text: str, count: Counter, runs: list[tuple[list[int], list[int]]] | None = None):
        self.text, self.count = text, count
        if runs is None:
            pieces = count.cut(text)
            chars, tokens = list(map(len, pieces)), list(map(count.tokens.__getitem__, pieces))
            runs = [(chars[i : i + RUN], tokens[i : i + RUN]) for i in range(0, len(pieces), RUN)]
        self.runs = runs or [([], [])]
        self.width = 1 << (len(self.runs) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (chars, tokens) in enumerate(self.runs):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(chars), sum(tokens)
        for i in range(self.width - 1, 0, -1):
            self.add_up(i)
        self.encoded = 0

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def add_up(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def find(self, place: int) -> tuple[int, int]:
        """(run, its first character) of the run that `place` falls in, or the last."""
        node, begin = 1, 0
        while node < self.width:
            node *= 2
            if place >= begin + self.chars[node] and self.chars[node + 1]:
                begin += self.chars[node]
                node += 1
        return node - self.width, begin

    def edit(self, start: int, stop: int, text: str) -> None:
        """Put `text` in place of the characters start .. stop - 1."""
        length = len(self.text)
        start = min(max(start, 0), length)
        stop = min(max(stop, start), length)
        moved = len(text) - (stop - start)
        self.text = self.text[:start] + text + self.text[stop:]
        # The first pre-token that ends less than two characters before the edit.
        first, begin = self.find(max(0, start - 2))
        chars, tokens = self.runs[first]
        kept = 0
        while kept < len(chars) and begin + chars[kept] < start - 1:
            begin += chars[kept]
            kept += 1
        # Old pre-tokens are passed until a new cut behind the edit meets one of theirs.
        run, at, old = first, kept, begin
        new_chars, new_tokens = [], []
        place, edited_to = begin, start + len(text)
        met = False
        for found in self.count.cut_from(self.text, begin):
            piece = found.group()
            place = found.end()
            new_chars.append(len(piece))
            new_tokens.append(self.count.tokens[piece])
            self.encoded += len(piece)
            if place < edited_to:
                continue
            while old < place - moved and run < len(self.runs):
                if at < len(self.runs[run][0]):
                    old += self.runs[run][0][at]
                    at += 1
                else:
                    run, at = run + 1, 0
            if old == place - moved and old >= stop:
                met = True
                break
        if not met:
            run, at = len(self.runs), 0
        rest_chars, rest_tokens = (self.runs[run][0][at:], self.runs[run][1][at:]) if run < len(self.runs) else ([], [])
        self.runs[first] = (chars[:kept] + new_chars + rest_chars, tokens[:kept] + new_tokens + rest_tokens)
        last = min(run, len(self.runs) - 1)
        for i in range(first + 1, last + 1):
            self.runs[i] = ([], [])
        nodes = set()
        for i in range(first, last + 1):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(self.runs[i][0]), sum(self.runs[i][1])
            nodes.add((self.width + i) // 2)
        while nodes and 0 not in nodes:
            for node in nodes:
                self.add_up(node)
            nodes = {node // 2 for node in nodes}

    def stored(self) -> bytes:
        """The runs as 32-bit integers: how many, their sizes, characters, tokens."""
        sizes = [len(chars) for chars, _ in self.runs]
        flat = [x for chars, _ in self.runs for x in chars] + [x for _, tokens in self.runs for x in tokens]
        return np.array([len(sizes), *sizes, *flat], "<i4").tobytes()

    @classmethod
    def opened(cls, text: str, state: bytes, count: Counter) -> Tree:
        numbers = np.frombuffer(state, "<i4").tolist()
        sizes = numbers[1 : 1 + numbers[0]]
        flat, runs, at, total = numbers[1 + numbers[0] :], [], 0, sum(sizes)
        for size in sizes:
            runs.append((flat[at : at + size], flat[total + at : total + at + size]))
            at += size
        return cls(text, count, runs)


def count_tokens(df: DataFrame, path: str, text_col: str = "text", state: bool = True) -> DataFrame:
    """`df` with n_tokens and, with `state`, the tree of each text as token_tree."""
    new = [T.StructField("n_tokens", T.LongType())]
    new += [T.StructField("token_tree", T.BinaryType())] if state else []
    schema = appended(df, new)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            trees = [Tree(text, count) for text in texts_of(batch.column(text_col))]
            made = {"n_tokens": pa.array([t.n_tokens for t in trees], pa.int64())}
            if state:
                made["token_tree"] = pa.array([t.stored() for t in trees], pa.binary())
            yield with_columns(batch, schema.names, made)

    return map_batches(df, work, schema)


def apply_edits(
    df: DataFrame, path: str, edits_col: str, text_col: str = "text", tree_col: str | None = None
) -> DataFrame:
    """`df` after its edits, with n_tokens before them, and what they led to.

    edits_col: array<struct<start, stop, text>>, applied one after the other.  tree_col: trees
    from count_tokens; where missing they are built first.
    """
    new = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("edited_text", T.StringType()),
        T.StructField("edited_tokens", T.LongType()),
        T.StructField("encoded_chars", T.LongType()),
        T.StructField("edited_tree", T.BinaryType()),
    ]
    schema = appended(df, new)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            before, trees = [], []
            states = batch.column(tree_col).to_pylist() if tree_col else [None] * batch.num_rows
            for text, state, edits in zip(texts_of(batch.column(text_col)), states, batch.column(edits_col).to_pylist()):
                tree = Tree(text, count) if state is None else Tree.opened(text, state, count)
                before.append(tree.n_tokens)
                for edit in edits or []:
                    tree.edit(edit["start"] or 0, edit["stop"] or 0, edit["text"] or "")
                trees.append(tree)
            made = {
                "n_tokens": pa.array(before, pa.int64()),
                "edited_text": pa.array([t.text for t in trees], pa.string()),
                "edited_tokens": pa.array([t.n_tokens for t in trees], pa.int64()),
                "encoded_chars": pa.array([t.encoded for t in trees], pa.int64()),
                "edited_tree": pa.array([t.stored() for t in trees], pa.binary()),
            }
            yield with_columns(batch, schema.names, made)

    return map_batches(df, work, schema)


def example_edits(text: Column) -> Column:
    """Three edits that every text gets in the query: in its middle, its first quarter and at its end."""
    n = F.length(F.coalesce(text, F.lit("")))
    half, quarter = F.floor(n / 2).cast("int"), F.floor(n / 4).cast("int")

    def edit(start: Column, stop: Column, put: Column) -> Column:
        return F.struct(start.alias("start"), stop.alias("stop"), F.coalesce(put, F.lit("")).alias("text"))

    return F.array(
        edit(half, half + 20, F.substring(text, 1, 12)),
        edit(quarter, quarter + 8, F.lit("")),
        edit(n + 1000, n + 1000, F.substring(text, 1, 10)),
    )
