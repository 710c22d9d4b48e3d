"""Near duplicates: DartMinHash signatures, banded joining, exact checks, connected classes.

Two texts are linked if the Jaccard similarity of their sets of WIDTH-word shingles (A-Z
folded) is at least THRESHOLD; classes are the connected components of the links.

1. Each text gets a signature of BANDS x ROWS coordinates.  Equal texts are one node from here.
2. Nodes that agree in a whole band share a bucket.  A pair at the threshold shares none with a
   probability of 5 in 100,000; more similar pairs less.
3. In each bucket the node that meets most others in all its buckets is compared with the rest
   (one pair per member), by the sets themselves.  That joins nearly all there is to join.
4. Buckets that still hold several classes are compared in tiles: those outside the hub's
   class against all, by signature first, then by the sets.  Inside one class nothing is left
   to find, so a large group of near copies costs one comparison per member.

A text of fewer than WIDTH words that has any is one shingle; texts without words (null, empty,
white space) are linked to none but texts of the same bytes, null counting as empty.  Null ids
are members like others; the smallest id of a class, nulls last, names it and stays.  Rows
repeated in full count each; one of them stays.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from klaxon.llm.common import bytes_of, map_batches, slices, stored
from klaxon.llm.darts import EMPTY, signatures
from klaxon.llm.words import U, hashes, mix, shingles, spans

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
# Signature agreement below which a pair isn't looked at: four deviations under the threshold.
ESTIMATE = 0.65
TILE = 256


def digest(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles, number per row)."""
    ends, body = bytes_of(column)
    starts, stops, per_row = spans(ends, body)
    found, number = shingles(hashes(body, starts, stops), per_row, width)
    row = np.repeat(np.arange(len(number)), number)
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    return found[new], np.bincount(row[new], minlength=len(number))


def sketches(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_uid, _id, _digest, _size, _sig and _keys (a bucket key per band) of each row, stored."""
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = np.array([3**i for i in range(ROWS)], U)
        for batch in slices(batches, "_text"):
            found, number = shingle_sets(batch.column("_text"), WIDTH)
            ranks = signatures(found, np.ones(len(found)), number, BANDS * ROWS)
            keys = mix((ranks.reshape(-1, BANDS, ROWS) * odd).sum(2) + np.arange(1, BANDS + 1, dtype=U))
            short = (mix(ranks) >> U(32)).astype(np.uint32)
            empty = (ranks == EMPTY).all(1)
            ends, body = bytes_of(batch.column("_text"))
            raw = body.tobytes()
            digests = [hashlib.sha256(raw[a:b]).digest()[:16] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            lists = [None if e else k for k, e in zip(keys.view(np.int64), empty.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    pa.array(digests, pa.binary()),
                    pa.array(number.astype(np.int32)),
                    pa.array([x.tobytes() for x in short], pa.binary()),
                    pa.array(lists, pa.list_(pa.int64())),
                ],
                names=["_id", "_digest", "_size", "_sig", "_keys"],
            )

    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    made = map_batches(rows, work, f"_id {kind}, _digest binary, _size int, _sig binary, _keys array<bigint>")
    return stored(made.withColumn("_uid", F.monotonically_increasing_id()), "sketches")


def sets_of(df: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_uid, _set): the shingle sets of the given nodes (_uid, _digest, _id), stored."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found, number = shingle_sets(batch.column("_text"), WIDTH)
            parts = np.split(found, np.cumsum(number)[:-1])
            packed = pa.array([x.tobytes() for x in parts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("_uid"), packed], names=["_uid", "_set"])

    texts = df.select(F.col(id_col).alias("_own"), F.col(text_col).alias("_text"), digest(F.col(text_col)).alias("_digest"))
    wanted = texts.join(nodes, "_digest").filter(F.col("_own").eqNullSafe(F.col("_id"))).select("_uid", "_text")
    # Rows repeated in full come several times.
    return stored(map_batches(wanted, work, "_uid bigint, _set binary").dropDuplicates(["_uid"]), "shingle-sets")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are as similar as the threshold; neither is empty."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return common >= THRESHOLD * (len(a) + len(b) - common)


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (_a, _b) whose sets are similar enough, stored."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("_left"), batch.column("_right"))
            keep = [similar(*(np.frombuffer(x.as_buffer(), U) for x in pair)) for pair in pairs]
            both = pa.RecordBatch.from_arrays([batch.column("_a"), batch.column("_b")], names=["_a", "_b"])
            yield both.filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("_uid").alias("_a"), F.col("_set").alias("_left"))
    right = sets.select(F.col("_uid").alias("_b"), F.col("_set").alias("_right"))
    return stored(map_batches(pairs.join(left, "_a").join(right, "_b"), work, "_a bigint, _b bigint"), "links")


def components(links: DataFrame) -> DataFrame:
    """(_uid, _class): the smallest node that links lead to, for every node with a link; stored.

    Each round takes the least label among the neighbours and then the label of that label, so
    rounds grow with the logarithm of the longest path.
    """
    both = links.select("_a", "_b").union(links.select("_b", "_a"))
    edges = stored(both.distinct(), "edges")
    labels = stored(edges.groupBy(F.col("_a").alias("_uid")).agg(F.least(F.min("_b"), F.first("_a")).alias("_class")), "labels")
    while True:
        near = labels.select(F.col("_uid").alias("_b"), F.col("_class").alias("_near"))
        least = edges.join(near, "_b").groupBy(F.col("_a").alias("_uid")).agg(F.min("_near").alias("_near"))
        step = labels.join(least, "_uid").select("_uid", F.least("_class", "_near").alias("_next"), "_class")
        jump = step.select(F.col("_uid").alias("_next"), F.col("_next").alias("_jump"))
        after = step.join(jump, "_next", "left").select(
            "_uid",
            F.least("_next", F.coalesce("_jump", "_next")).alias("_class"),
            (F.least("_next", F.coalesce("_jump", "_next")) != F.col("_class")).alias("_moved"),
        )
        after = stored(after, "labels")
        labels = after.select("_uid", "_class")
        if after.filter("_moved").isEmpty():
            return labels


def hubs(members: DataFrame) -> DataFrame:
    """(_key, _hub): of each bucket the node that meets most others over all its buckets."""
    known = members.groupBy("_uid").agg(F.sum(F.col("_many") - 1).alias("_meets"))
    best = members.join(known, "_uid").groupBy("_key").agg(F.max(F.struct("_meets", "_uid")).alias("_best"))
    return best.select("_key", F.col("_best._uid").alias("_hub"))


def comparable(left: Column, right: Column) -> Column:
    """Sizes that a similarity at the threshold allows."""
    return F.least(left, right) >= THRESHOLD * F.greatest(left, right)


def tiles(members: DataFrame, hub: DataFrame, classes: DataFrame, sig: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between different classes of one bucket; each pair is looked at in its first bucket alone."""
    labelled = members.join(classes, "_uid", "left").withColumn("_class", F.coalesce("_class", "_uid"))
    open_keys = labelled.groupBy("_key").agg(
        F.min("_class").alias("_low"), F.max("_class").alias("_high")
    ).filter("_low < _high").select("_key")
    own = classes.select(F.col("_uid").alias("_hub"), F.col("_class").alias("_hub_class"))
    hub_class = (
        hub.join(open_keys, "_key").join(own, "_hub", "left")
        .select("_key", F.coalesce("_hub_class", "_hub").alias("_hub_class"))
    )
    placed = labelled.join(hub_class, "_key").withColumn("_in", F.col("_class") == F.col("_hub_class"))
    size = placed.groupBy("_key").agg(
        F.ceil(F.sum(F.col("_in").cast("int")) / TILE).cast("int").alias("_ins"),
        F.greatest(F.lit(1), F.ceil(F.sum((~F.col("_in")).cast("int")) / TILE)).cast("int").alias("_outs"),
    )
    # Blocks of outsiders come first: 0 .. outs-1, then those of the hub's class.
    block = F.when(
        F.col("_in"), F.col("_outs") + F.pmod(F.xxhash64("_uid"), F.greatest(F.lit(1), "_ins")).cast("int")
    ).otherwise(F.pmod(F.xxhash64("_uid"), F.col("_outs")).cast("int"))
    blocked = placed.join(size, "_key").withColumn("_block", block)
    every = F.sequence(F.lit(0), F.col("_outs") + F.col("_ins") - 1)
    partner = F.when(F.col("_in"), F.sequence(F.lit(0), F.col("_outs") - 1)).otherwise(every)
    copied = blocked.select(
        "_key", "_band", "_uid", "_class", "_size", "_block", F.explode(partner).alias("_other")
    ).select(
        "_key", "_band", "_uid", "_class", "_size", "_block",
        F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"),
    )

    def work(tile: pa.Table) -> pa.Table:
        uid, label, count, block = (tile.column(c).to_numpy() for c in ("_uid", "_class", "_size", "_block"))
        marks = np.frombuffer(b"".join(tile.column("_sig").to_pylist()), np.uint32).reshape(len(uid), BANDS, ROWS)
        own = [np.frombuffer(x.as_buffer(), U) for x in tile.column("_set").combine_chunks()]
        band, alone = tile.column("_band")[0].as_py(), tile.column("_i")[0].as_py() == tile.column("_j")[0].as_py()
        found = []
        for i in range(len(uid) - 1):
            other = slice(i + 1, None)
            # Pairs inside a block belong to the tile of that block with itself.
            rest = (label[other] != label[i]) & (alone | (block[other] != block[i]))
            rest &= np.minimum(count[other], count[i]) >= THRESHOLD * np.maximum(count[other], count[i])
            rest = np.flatnonzero(rest) + i + 1
            if len(rest):
                agree = marks[rest] == marks[i]
                first = ~agree[:, :band].all(2).any(1)
                rest = rest[first & (agree.mean((1, 2)) >= ESTIMATE)]
                found += [(min(uid[i], uid[j]), max(uid[i], uid[j])) for j in rest if similar(own[i], own[j])]
        a, b = zip(*found) if found else ((), ())
        return pa.table({"_a": pa.array(a, pa.int64()), "_b": pa.array(b, pa.int64())})

    signed = copied.join(sig, "_uid").join(sets, "_uid")
    return stored(signed.groupBy("_key", "_i", "_j").applyInArrow(work, "_a bigint, _b bigint"), "more-links")


def classes_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_uid, _id, _digest and _class (a node's _uid) of each row."""
    rows = sketches(df, id_col, text_col)
    nodes = stored(rows.groupBy("_digest").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_uid")).alias("_n")).select("_digest", F.col("_n._uid").alias("_node")), "nodes")
    own = rows.join(nodes.select(F.col("_node").alias("_uid")), "_uid", "left_semi")
    banded = own.select("_uid", "_size", F.posexplode("_keys").alias("_band", "_key"))
    shared = banded.groupBy("_key").agg(F.count(F.lit(1)).alias("_many")).filter("_many > 1")
    members = stored(banded.join(shared, "_key"), "buckets")
    wanted = members.select("_uid").distinct()
    sets = sets_of(df, rows.select("_uid", "_digest", "_id").join(wanted, "_uid"), id_col, text_col)
    hub = stored(hubs(members), "hubs")
    center = hub.join(members.select("_key", F.col("_uid").alias("_hub"), F.col("_size").alias("_hub_size")), ["_key", "_hub"])
    star = (
        members.join(center, "_key")
        .filter((F.col("_uid") != F.col("_hub")) & comparable(F.col("_size"), F.col("_hub_size")))
        .select(F.least("_uid", "_hub").alias("_a"), F.greatest("_uid", "_hub").alias("_b"))
        .distinct()
    )
    star = stored(star, "pairs")
    links = linked(star, sets)
    found = components(links)
    extra = tiles(members, hub, found, rows.select("_uid", "_sig"), sets)
    if not extra.isEmpty():
        found = components(links.union(extra))
    return (
        rows.select("_uid", "_id", "_digest")
        .join(nodes, "_digest")
        .join(found.select(F.col("_uid").alias("_node"), "_class"), "_node", "left")
        .select("_uid", "_id", "_digest", F.coalesce("_class", "_node").alias("_class"))
    )


def mark_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: `id_col`, class_id (smallest id of its class), class_size, kept."""
    rows = stored(classes_of(df, id_col, text_col), "classes")
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "_uid"))
    named = rows.groupBy("_class").agg(first.alias("_first"), F.count(F.lit(1)).alias("class_size"))
    return rows.join(named, "_class").select(
        F.col("_id").alias(id_col),
        F.col("_first._id").alias("class_id"),
        "class_size",
        (F.col("_uid") == F.col("_first._uid")).alias("kept"),
    )


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` that stay, one of each class, with all their columns."""
    rows = stored(classes_of(df, id_col, text_col), "classes")
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "_uid", "_digest"))
    stay = rows.groupBy("_class").agg(first.alias("_first")).select(
        F.col("_first._digest").alias("_digest"), F.col("_first._id").alias("_keep_id")
    )
    whole = df.select(F.struct(*df.columns).alias("_row"), F.col(id_col).alias("_own"), digest(F.col(text_col)).alias("_digest"))
    kept = whole.join(stay, (whole["_digest"] == stay["_digest"]) & whole["_own"].eqNullSafe(stay["_keep_id"]), "left_semi")
    # Only rows repeated in id and text are left to thin out.
    one = kept.dropDuplicates(["_digest"])
    return one.select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns])
