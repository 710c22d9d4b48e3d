"""Cutting texts into pieces takes a bounded amount of a worker's memory beside its tables."""

import os
import subprocess
import sys

import pytest

pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# A process of its own, as a worker is.  `Rows` stands in for a table and gives back what the worker runs.
PROGRAM = """
import random, sys
from unittest import mock
sys.path.insert(0, sys.argv[1])
import pyarrow as pa
import public_tokenizers
from klaxon.llm import packing

class Rows(mock.MagicMock):
    def select(self, *columns): return self
    def mapInArrow(self, work, schema): return work

def megabytes(field):
    said = next(x for x in open("/proc/self/status") if x.startswith(field))
    return int(said.split()[1]) / 1e3

path = public_tokenizers.path("word_bpe_49k.json")
with mock.patch.object(packing, "F"):
    work = packing.pieces_of(Rows(), path)
dice = random.Random(7)
words = ["".join(dice.choices("abcdefghijklmnop", k=dice.randint(2, 9))) for _ in range(100_000)]

def batches():
    for at in range(0, 5600, 700):
        texts = [" ".join(dice.choices(words, k=1000)) for _ in range(700)]
        yield pa.RecordBatch.from_arrays([pa.array(range(at, at + 700)), pa.array(texts)], names=["_doc", "_text"])

packing.word_table(path)
begin, tokens = megabytes("VmRSS"), 0
for batch in work(batches()):
    tokens += sum(batch.column("length").to_pylist())
print(tokens, round(megabytes("VmHWM") - begin))
"""


def test_memory_beside_the_tables():
    said = subprocess.run([sys.executable, "-c", PROGRAM, ROOT], capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr
    tokens, most = map(int, said.stdout.split())
    assert tokens > 5600 * 1000
    assert most < 100
