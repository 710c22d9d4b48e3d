"""Bounded, repeatable samples of labelled rows for fitting a classifier."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_label(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(_id, _label) with one row per id: the largest label that isn't null."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    return known.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))


def labelled_sample(
    documents: DataFrame,
    labels: DataFrame,
    label_col: str,
    use: Column,
    bounds: dict[int | None, int],
    longest: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """_id, _label, _text of labelled texts of at most `longest` characters, one per id.

    `use` tells which ids may be learned from.  `bounds`: how many ids at most, by label or (None)
    in all: the smallest by hash among those that have such a text, so labels without a document
    take no place.  Of several texts of an id the least by hash is taken.  Null texts are not.
    The bounds also are those of the broadcast.
    """
    texts = documents.filter(F.length(text_col) <= longest).select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text")
    )
    known = one_label(labels.filter(use), id_col, label_col).join(texts.select("_id"), "_id", "left_semi")
    order = (F.xxhash64("_id"), F.col("_id"))
    parts = [
        (known if label is None else known.filter(F.col("_label") == label)).orderBy(*order).limit(bound)
        for label, bound in bounds.items()
    ]
    chosen = functools.reduce(DataFrame.union, parts)
    least = F.min(F.struct(F.xxhash64("_text").alias("hash"), F.col("_text").alias("text")))
    rows = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_label").agg(least.alias("_least"))
    return rows.select("_id", "_label", F.col("_least.text").alias("_text"))
