"""Exact duplicates by a content sort, with DataFrame functions only.

Rows are put in the order of (first bytes of the text, its digest, the text, the id).  Sampled
rows cut that order into buckets: each bucket is sorted externally by Spark, equal texts are
then neighbours, and each row is compared in full with the one before it.  The order ends in
the id, so a large group of copies is cut into several buckets like any other rows; the last
text of a bucket is compared with the first of the next to join what a cut has parted.

Only the cuts (a few per shuffle partition) and one row per cut ever meet in one place.

Nulls: a null text equals the empty text.  Null ids come after all others, so one stays only in
a group without any id.  Repeated rows (same id and text) count each, one of them stays.  An
empty table gives an empty result.  Columns of other names are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from klaxon.llm.common import shuffle_partitions, stored

# Bytes of the text that lead the sort key; the digest orders what agrees in them.
LEAD_BYTES = 24
# Buckets for each shuffle partition, and sampled rows for each bucket.
BUCKETS_PER_PARTITION = 4
SAMPLES_PER_BUCKET = 40


def content_key(text: Column) -> Column:
    """A short text that orders like (first bytes, SHA-256)."""
    lead = F.hex(F.substring(text.cast("binary"), 1, LEAD_BYTES))
    return F.concat(lead, F.lit("!"), F.sha2(text, 256))


def id_key(id_col: Column, keep: str) -> Column:
    """16 hex digits that put the id which stays first; null ids last."""
    number = id_col.cast("long")
    number = F.bitwise_not(number) if keep == "max" else number
    flipped = number.bitwiseXOR(F.lit(-(2**63)).cast("long"))
    return F.coalesce(F.lpad(F.hex(flipped), 16, "0"), F.lit("Z"))


def cuts(keyed: DataFrame, buckets: int) -> list[str]:
    """Sampled splitters: keys of rows, at most buckets - 1 of them, in order."""
    rows = keyed.count()
    wanted = buckets * SAMPLES_PER_BUCKET
    sample = keyed if rows <= wanted else keyed.sample(wanted / rows, seed=5)
    found = sorted(r[0] for r in sample.select(F.concat("_body", "_order")).collect())
    return sorted({found[i * len(found) // buckets] for i in range(1, buckets)}) if found else []


def search(key: Column, splitters: list, kind: str = "string") -> Column:
    """How many of the rising splitters are not above the key, by binary search."""
    if not splitters:
        return F.lit(0)
    ordered = F.split(F.lit(",".join(map(str, splitters))), ",").cast(f"array<{kind}>")
    start = F.struct(F.lit(0).alias("low"), F.lit(len(splitters)).alias("high"))

    def halve(span: Column, _: Column) -> Column:
        middle = F.floor((span["low"] + span["high"]) / 2).cast("int")
        below = F.element_at(ordered, middle + 1) <= key
        done = span["low"] >= span["high"]
        return F.struct(
            F.when(~done & below, middle + 1).otherwise(span["low"]).alias("low"),
            F.when(~done & ~below, middle).otherwise(span["high"]).alias("high"),
        )

    steps = F.sequence(F.lit(1), F.lit(len(splitters).bit_length() + 1))
    return F.aggregate(steps, start, halve)["low"]


def sorted_runs(df: DataFrame, id_col: str, text_col: str, keep: str, normalize, payload: bool) -> DataFrame:
    """Each row with its bucket and its run of equal texts there, stored.

    `_edge` holds the text of the first and of the last row of a bucket.  With `payload` the
    row itself is carried as `_row`, its text only once where it is not normalised.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalize(text) if normalize else text
    others = [c for c in df.columns if normalize or c != text_col] if payload else []
    keyed = df.select(
        F.col(id_col).alias("_id"),
        text.alias("_text"),
        content_key(text).alias("_body"),
        id_key(F.col(id_col), keep).alias("_order"),
        F.col(text_col).isNull().alias("_was_null"),
        *([F.struct(*others).alias("_row")] if others else []),
    )
    splitters = cuts(keyed.select("_body", "_order"), BUCKETS_PER_PARTITION * shuffle_partitions(df.sparkSession))
    placed = keyed.withColumn("_bucket", search(F.concat("_body", "_order"), splitters))
    order = Window.partitionBy("_bucket").orderBy("_body", "_text", "_order")
    before = F.lag("_text").over(order)
    first, last = before.isNull(), F.lead("_order").over(order).isNull()
    marked = placed.select(
        "*",
        first.alias("_head"),
        last.alias("_tail"),
        (first | (before != F.col("_text"))).alias("_new"),
    )
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = marked.withColumn("_run", F.sum(F.col("_new").cast("long")).over(so_far))
    kept = ["_id", "_bucket", "_run", "_new", "_head", "_tail"]
    kept += ["_was_null", "_text"] if payload and not normalize else []
    kept += ["_row"] if others else []
    return stored(
        runs.select(
            *kept,
            F.substring_index("_body", "!", -1).alias("_sha"),
            F.when(F.col("_head") | F.col("_tail"), F.col("_text")).alias("_edge"),
        ),
        "content-sort",
    )


def continued(runs: DataFrame) -> DataFrame:
    """Buckets whose first run goes on from the bucket before; at most one row per cut."""
    tails = runs.filter("_tail").select((F.col("_bucket") + 1).alias("_bucket"), F.col("_edge").alias("_left"))
    heads = runs.filter("_head").select("_bucket", F.col("_edge").alias("_right"))
    return tails.join(heads, "_bucket").filter(F.col("_left") == F.col("_right")).select("_bucket")


def mark_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalize=None
) -> DataFrame:
    """One row per row: `id_col`, keep_id, group_size, kept, text_sha256.

    keep: "min" or "max" id of equal texts.  normalize: a function of the text column, or None.
    """
    runs = sorted_runs(df, id_col, text_col, keep, normalize, payload=False)
    parted = continued(runs).withColumn("_cont", F.lit(True))
    sizes = Window.partitionBy("_bucket", "_run")
    start = F.max(F.when(F.col("_new"), F.struct("_id"))).over(sizes)
    rows = runs.select(
        "_id", "_bucket", "_run", "_new", "_sha", "_tail",
        F.count(F.lit(1)).over(sizes).alias("_size"),
        start["_id"].alias("_first"),
    )
    chained = chains(runs, parted)
    # One row per cut at most on the broadcast side.
    return rows.join(F.broadcast(chained), ["_bucket", "_run"], "left").select(
        F.col("_id").alias(id_col),
        F.when(F.col("_chain").isNotNull(), F.col("_chain_first")).otherwise(F.col("_first")).alias("keep_id"),
        F.coalesce("_chain_size", "_size").alias("group_size"),
        (F.col("_new") & ~F.coalesce("_goes_on", F.lit(False))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def chains(runs: DataFrame, parted: DataFrame) -> DataFrame:
    """Runs that a cut has parted, with size and first id of the whole; at most two rows per cut."""
    summed = runs.groupBy("_bucket", "_run").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.when(F.col("_new"), F.struct("_id"))).alias("_start"),
        F.max("_tail").alias("_last_run"),
    )
    after = parted.select((F.col("_bucket") - 1).alias("_bucket"), F.lit(True).alias("_followed"))
    pieces = (
        summed.filter((F.col("_run") == 1) | F.col("_last_run"))
        .join(F.broadcast(parted), "_bucket", "left")
        .join(F.broadcast(after), "_bucket", "left")
        .withColumn("_goes_on", (F.col("_run") == 1) & F.coalesce("_cont", F.lit(False)))
        .filter(F.col("_goes_on") | (F.col("_last_run") & F.coalesce("_followed", F.lit(False))))
    )
    order = Window.orderBy("_bucket", "_run")
    numbered = pieces.withColumn("_chain", F.sum((~F.col("_goes_on")).cast("long")).over(order))
    whole = numbered.groupBy("_chain").agg(
        F.sum("_n").alias("_chain_size"), F.max(F.when(~F.col("_goes_on"), F.col("_start"))).alias("_s")
    )
    return numbered.join(whole, "_chain").select(
        "_bucket", "_run", "_chain", "_chain_size", F.col("_s._id").alias("_chain_first"), "_goes_on"
    )


def drop_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalize=None
) -> DataFrame:
    """The rows of `df` that stay, with all their columns."""
    runs = sorted_runs(df, id_col, text_col, keep, normalize, payload=True)
    parted = continued(runs).select("_bucket", F.lit(1).cast("long").alias("_run"))
    stay = runs.filter("_new").join(F.broadcast(parted), ["_bucket", "_run"], "left_anti")
    text = F.when(~F.col("_was_null"), F.col("_text")) if not normalize else None
    return stay.select(
        *[text.alias(c) if c == text_col and text is not None else F.col(f"_row.`{c}`").alias(c) for c in df.columns]
    )
