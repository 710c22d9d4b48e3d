"""Token ids of whole texts by a public tokenizer, worked out once per distinct word.

The bytes of a batch of texts are cut where no pre-token can go on: before an ASCII blank that
follows a visible character, and between an ASCII letter and a plain mark.  Arrow codes the
words so found, the tokenizer sees the ones it has not met, and numpy strings their ids
together.  A cut that is left out costs time only, so doubtful places (beyond ASCII, close to
the parts of an added token) are not cut.

Words and their ids are kept in a table of about TABLE_BYTES; when that is full, the words that
came again stay.  Very long words are not kept.
"""

from __future__ import annotations

import functools
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from klaxon.llm.common import bytes_of

TABLE_BYTES = 24 << 20
# Longer words are encoded where they stand and not kept.
LONG_WORD = 256
# The tokenizer's answers take about a kilobyte a word: it is asked for so many at once.
ASKED_WORDS = 4096

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
VISIBLE = np.zeros(256, bool)
VISIBLE[33:127] = True
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 13, 32]] = True
MARK = np.zeros(256, bool)
MARK[[ord(c) for c in ".,;:!?"]] = True


def beyond_visible(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For places after a byte of 128 or more: whether the character there is surely not white space.

    White space beyond ASCII begins with one of C2 85, C2 A0, E1 9A, E2 80, E2 81 or E3 80.
    """
    back = [body[np.maximum(at - k, 0)] for k in (1, 2, 3)]
    two = (back[1] == 0xC2) & ((back[0] == 0x85) | (back[0] == 0xA0))
    three = ((back[2] >= 0xE1) & (back[2] <= 0xE3)) & np.isin(back[1], (0x9A, 0x80, 0x81))
    return ~(two | three)


def word_ends(ends: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of the words over `body`, index of each text's first word and the end)."""
    cut = np.zeros(len(body) + 1, bool)
    if len(body) > 1:
        before, after = body[:-1], body[1:]
        blank = BLANK[after]
        cut[1:-1] = (VISIBLE[before] & blank) | (LETTER[before] & MARK[after])
        far = np.flatnonzero(blank & (before >= 128)) + 1
        cut[far] = beyond_visible(body, far)
    cut[ends] = True
    cut[len(body)] = True
    offsets = np.flatnonzero(cut)
    if not len(body):
        offsets = np.zeros(1, np.int64)
    return offsets, np.searchsorted(offsets, ends)


def lowered(ends: np.ndarray, body: np.ndarray) -> np.ndarray:
    """`body` with the first letter of words in lower case, for tokenizers that lower-case all.

    Only where the next byte can't begin a combining mark, which normalisation may take first,
    and never inside a word, which might turn a plain string into an added token.
    """
    if len(body) < 2:
        return body
    upper = (body >= 65) & (body <= 90)
    first = np.zeros(len(body), bool)
    first[1:] = BLANK[body[:-1]]
    first[ends[:-1][ends[:-1] < len(body)]] = True
    follows = np.zeros(len(body), bool)
    follows[:-1] = (body[1:] < 0x80) | (body[1:] == 0xC3)
    at = np.flatnonzero(upper & first & follows)
    if len(at):
        body = body.copy()
        body[at] += 32
    return body


class WordTable:
    """Ids of words: a bounded table that fills itself through the tokenizer."""

    def __init__(self, path: str, limit: int = TABLE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        kinds = str(type(self.tokenizer.normalizer)) + str(self.tokenizer.normalizer)
        self.lowers = "Lowercase" in kinds
        self.limit = limit
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        if any(BLANK[b] or MARK[b] for x in added for b in x.encode()):
            raise ValueError("an added token holds a blank or a mark that words are cut at")
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.large_binary())
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, "<u4")
        # Which words came again after they were learnt.
        self.again = np.zeros(0, bool)

    def asked(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, how many of each word) straight from the tokenizer."""
        parts, counts = [np.zeros(0, "<u4")], []
        for at in range(0, len(words), ASKED_WORDS):
            texts = [w.decode() for w in words[at : at + ASKED_WORDS]]
            found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            counts += map(len, found)
            parts.append(np.fromiter(chain.from_iterable(found), "<u4"))
        return np.concatenate(parts), np.array(counts, np.int64)

    def add(self, words: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.ids = np.concatenate([self.ids, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        self.again = np.concatenate([self.again, np.zeros(len(words), bool)])

    def shrink(self) -> None:
        """Keep the words that came again since they were learnt; none if these fill half the table."""
        keep = np.flatnonzero(self.again)
        ids, ends = self.strung(keep, np.arange(len(keep) + 1))
        words = self.words.take(pa.array(keep))
        self.clear()
        if words.nbytes + ids.nbytes + ends.nbytes <= self.limit // 2:
            self.add(words, ids, np.diff(ends))

    def learn(self, words: pa.Array) -> np.ndarray:
        """Places in the table of distinct words, all of which it holds afterwards."""
        if self.words.nbytes + self.ids.nbytes + self.starts.nbytes > self.limit:
            self.shrink()
        found = pc.index_in(words, value_set=self.words)
        place = found.fill_null(-1).to_numpy().astype(np.int64)
        unseen = place < 0
        self.again[place[~unseen]] = True
        if unseen.any():
            place[unseen] = len(self.words) + np.arange(np.count_nonzero(unseen))
            new = words.filter(pa.array(unseen))
            self.add(new, *self.asked(new.to_pylist()))
        return place

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids) of a column of texts; a null is empty."""
        ends, body = bytes_of(column)
        body = lowered(ends, body) if self.lowers else body
        offsets, firsts = word_ends(ends, body)
        many = len(offsets) - 1
        if not many:
            return np.zeros(0, "<u4"), np.zeros(len(column) + 1, np.int64)
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), many, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body)]
        )
        long = np.flatnonzero(np.diff(offsets) > LONG_WORD)
        if len(long):
            return self.encode_long(words, firsts, long)
        coded = words.dictionary_encode()
        return self.strung(self.learn(coded.dictionary)[coded.indices.to_numpy()], firsts)

    def strung(self, places: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = self.starts[places]
        counts = self.starts[places + 1] - starts
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(starts - ends[:-1], counts) + np.arange(ends[-1])
        return self.ids[at], ends[firsts]

    def encode_long(self, words: pa.Array, firsts: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), with the long words encoded where they stand."""
        keep = np.ones(len(words), bool)
        keep[long] = False
        short = words.filter(pa.array(keep))
        coded = short.dictionary_encode()
        places = self.learn(coded.dictionary)[coded.indices.to_numpy()] if len(short) else np.zeros(0, np.int64)
        counts = np.zeros(len(words), np.int64)
        counts[keep] = self.starts[places + 1] - self.starts[places]
        own = [self.asked([words[i].as_py()])[0] for i in long.tolist()]
        counts[long] = [len(x) for x in own]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = np.zeros(ends[-1], "<u4")
        starts = self.starts[places]
        many = counts[keep]
        into = np.repeat(ends[:-1][keep], many)
        step = np.arange(len(into)) - np.repeat(np.cumsum(many) - many, many)
        ids[into + step] = self.ids[np.repeat(starts, many) + step]
        for i, x in zip(long.tolist(), own):
            ids[ends[i] : ends[i + 1]] = x
        return ids, ends[firsts]

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)


@functools.lru_cache(maxsize=1)
def word_table(path: str) -> WordTable:
    """One table at a time: a reused worker that turns to another vocabulary drops the last one."""
    return WordTable(path)
