"""Word tables and token files against the tokenizers library and a plain zstandard reader."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from klaxon.llm import token_files
from klaxon.llm.word_ids import WordTable
from klaxon.session import fresh_path

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, _text string, _doc int, path string"
BITS = [
    "the", "The", "É", "é", "é", "Ṉ", "H̱", " ", " ", " ", "  ", "\n", "\t", "\r\n", ".", ",", "?!", "'s", "'S",
    "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "<|startoftext|>", "1", "23", "\x1c", "\x85", "ͅ", "İ", "ẞ", "Σ", "ς",
    "日本", "\U0001f600", "x" * 300, "A", "b", "_", "-", "…", " ", "　", "​", "﻿", "don't", "I'LL", "\x00",
    "\xa0", " ", " ", " ", " ",
]


def plain_tokenizer(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def odd_texts(many, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 25))) for _ in range(many)] + [None, "", " ", "A", "\n"]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_word_table(path):
    # A table of 20 kB is cleared again and again.
    for limit, texts in ((1 << 24, odd_texts(4000, 1)), (20_000, odd_texts(3000, 2))):
        table, tokenizer = WordTable(path, limit), plain_tokenizer(path)
        for at in range(0, len(texts), 500):
            part = texts[at : at + 500]
            ids, ends = table.encode(pa.array(part, pa.string()))
            want = [x.ids for x in tokenizer.encode_batch([t or "" for t in part], add_special_tokens=False)]
            assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want


def test_word_table_of_nothing():
    ids, ends = WordTable(BYTES).encode(pa.array([], pa.string()))
    assert len(ids) == 0 and ends.tolist() == [0]


def expected(rows, tokenizer):
    """(doc_id, start, n_tokens, crc32) in order of id; rows of one id may stand in any order of their own."""
    found, start = [], 0
    for doc, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        found.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        start += len(ids)
    return found


@pytest.fixture(scope="module")
def table(spark):
    texts = odd_texts(300, 3) + ["a long text of words " * 30_000, ""]
    rows = [(7 * i, t) for i, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame([(d, t, "clash", 1, "clash") for d, t in rows], SCHEMA).repartition(3)


def test_round_trip(spark, table):
    folder = fresh_path(spark, "test-tokens")
    manifest = token_files.write_token_files(table, BYTES, folder, shards=3, frame_ids=1000)
    want = expected(sorted((r["doc_id"], r["text"]) for r in table.collect()), plain_tokenizer(BYTES))
    got = sorted(tuple(r) for r in token_files.read_documents(manifest, with_ids=True).collect())
    assert [(*r[:4], bytes(r[4])) for r in got] == want
    # The same from the folder alone, and some documents by id: two in one frame, the long one, one that isn't there.
    again = token_files.read_manifest(spark, folder)
    wanted = spark.createDataFrame([(0,), (7,), (7 * 305,), (3,), (None,)], "doc_id bigint")
    some = sorted(tuple(r) for r in token_files.read_selected(again, wanted).collect())
    assert [(*r[:4], bytes(r[4])) for r in some] == [w for w in want if w[0] in (0, 7, 7 * 305)]


def test_only_the_frames_asked_for(spark, table):
    folder = fresh_path(spark, "test-tokens")
    manifest = token_files.write_token_files(table, BYTES, folder, shards=2, frame_ids=1000)
    paths = {r["path"] for r in manifest.collect()}
    assert len(paths) == 2
    for path in paths:
        file = token_files.TokenFile(path)
        groups = file.groups()
        docs, lengths = file.index(groups[1])
        file.ids(groups[1], 2, 0, int(lengths[0]))
        assert file.decompressed == 1 < len(file.frames) - len(groups)
        # Any zstandard reader finds all ids, the index frames being skippable.
        with open(path, "rb") as raw:
            whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw.read()), read_across_frames=True).read()
        assert whole == b"".join(file.data(k) for k, f in enumerate(file.frames) if f.size)


def test_damage_is_found(spark, table, tmp_path):
    manifest = token_files.write_token_files(table, BYTES, fresh_path(spark, "test-tokens"), shards=1)
    path = manifest.first()["path"]
    body = bytearray(open(path, "rb").read())
    frame = next(f for f in token_files.TokenFile(path).frames if f.size)
    body[frame.offset + frame.packed // 2] ^= 1
    broken, short = tmp_path / "broken.zst", tmp_path / "short.zst"
    broken.write_bytes(body)
    short.write_bytes(body[:-20])
    file = token_files.TokenFile(str(broken))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        for k, f in enumerate(file.frames):
            if f.size:
                file.data(k)
    with pytest.raises(ValueError):
        token_files.TokenFile(str(short))


def test_odd_tables(spark):
    tokenizer = plain_tokenizer(BYTES)
    for rows in ([], [(None, None)], [(1, "same")] * 4 + [(None, "x"), (None, None), (2, "")]):
        df = spark.createDataFrame([(d, t, "clash", 1, "clash") for d, t in rows], SCHEMA).repartition(3)
        folder = fresh_path(spark, "test-tokens")
        got = token_files.read_documents(token_files.write_token_files(df, BYTES, folder), with_ids=True).collect()
        got = sorted(map(tuple, got), key=lambda r: r[1])
        assert [r[0] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
        assert [r[1] for r in got] == [sum(r[2] for r in got[:i]) for i in range(len(got))]
        own = lambda r: (r[0] is not None, r[0] or 0, r[2], r[3])
        assert sorted(map(own, got)) == sorted(map(own, expected(rows, tokenizer)))


def test_registered(spark):
    from klaxon.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    want = expected([(r["doc_id"], r["text"]) for r in docs], plain_tokenizer(BYTES))
    got = sorted(tuple(r) for r in QUERIES["op13_token_files"](spark, folder).collect())
    assert got == [w[:4] for w in want]
