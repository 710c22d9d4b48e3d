"""The tokenizer is asked for a bounded number of words at once, with the same ids."""

import pytest

pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from klaxon.llm import word_ids  # noqa: E402


class Watched:
    def __init__(self, tokenizer):
        self.tokenizer, self.most = tokenizer, 0

    def encode_batch_fast(self, words, **how):
        self.most = max(self.most, len(words))
        return self.tokenizer.encode_batch_fast(words, **how)


def test_words_are_asked_in_parts():
    table = word_ids.WordTable(public_tokenizers.path("byte_bpe_50k.json"))
    words = [f"word{i}x{i * i}".encode() for i in range(10_000)]
    whole = [x.ids for x in table.tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False)]
    table.tokenizer = Watched(table.tokenizer)
    ids, counts = table.asked(words)
    assert table.tokenizer.most <= 4096
    assert counts.tolist() == [len(x) for x in whole] and ids.tolist() == [i for x in whole for i in x]
    ids, counts = table.asked([])
    assert len(ids) == len(counts) == 0 and ids.dtype == "<u4"
