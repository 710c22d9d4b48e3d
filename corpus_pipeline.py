"""A training corpus from raw documents: filter, deduplicate twice, pack.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns what it
keeps of `docs` with the columns of `docs`, the last one the packed pieces.  Every stage works
on all that the one before it kept; `run` writes each stage's rows below the shared folder and
reads them again.

Nulls: rows without a text pass the toxicity stage (score 0) and leave at the language stage,
like texts without a letter; null ids are kept as rows like others.  Extra columns are kept,
whatever their names.  Of equal texts and ids one row stays; repeated rows are filtered each before
that.  Very long texts are judged whole and packed in pieces.  An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from klaxon.llm import exact_dedup, langid, near_dedup, packing, toxicity
from klaxon.llm.common import fold, shipped, stored, table

TOXIC = 0.5

# Networks and nearest centroids have no SQL form.
ORACLE_SQL = None


def unused(docs: DataFrame, name: str) -> str:
    """`name` with as many underscores before it as make no column of `docs` start with it."""
    taken = [c.lower() for c in docs.columns]
    while any(c.startswith(name) for c in taken):
        name = "_" + name
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the network doesn't find toxic; it learns from the labels outside the held-out fold."""
    into = unused(docs, "_toxicity")
    scored = toxicity.classify(docs, table(spark, sf_dir, "labels"), use=fold() != 0, into=into)
    return scored.filter(F.col(into) < TOXIC).select(docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a letter that are near to a centroid of their language."""
    prefix = unused(docs, "_judged_")
    judged = langid.identify(docs, use=fold() != 0, prefix=prefix)
    return judged.filter(~F.col(prefix + "rejected")).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id."""
    return exact_dedup.drop_duplicates(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the smallest id."""
    return near_dedup.drop_near_duplicates(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequence and place."""
    return packing.pack(packing.pieces_of(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", shipped(drop_toxic)),
    ("language_id", shipped(drop_unknown_language)),
    ("exact_dedup", shipped(drop_copies)),
    ("near_dedup", shipped(drop_near_copies)),
    ("packing", shipped(pack_sequences)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
