"""A Merkle manifest of a dataset, with inclusion proofs by pointer jumping.

H is SHA-256 in lower-case hex over its inputs one after the other.  Each row is a leaf: H of its
fields, each `-` if null, else its UTF-8 byte count, `:` and its value.  The leaves of a group (a
language) ascend by id; every two neighbours become their H, a last one without a neighbour its own
H, level by level until one node stands: the group's subroot.  The subroots, ordered by group (null
first, bytewise), become the root in the same way.

1. Places: rows are range-partitioned by (group, id, leaf) and numbered by partition and place; the
   count of each group in each partition gives the rows their index without a window over a group.
2. Nodes: BAND levels at a time, the 2**BAND nodes below one node are hashed in one row.
3. Proofs: each node holds the sibling on its way to its parent.  In every round a node joins the
   ancestor it points at, takes over that one's pointer, so the distance doubles, and appends its
   segment of siblings.  Only nodes that will still be pointed at stay in a round: level 0 and the
   levels that are multiples of the next distance.

The tree of groups is far smaller than those of rows; its nodes take part in every round.

Ties: rows of one group and id are ordered by leaf; rows that agree in it too are interchangeable
and each has its own place.  Nulls: a null id comes first in its group, a null group is a group of
its own.  A text may be empty or of any length.  An empty table gives an empty result.  Columns
that aren't named as fields are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from klaxon.llm.common import shuffle_partitions, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Levels that are hashed in one row: 2**BAND nodes come together, whatever the input.
BAND = 8
# The tree over the subroots.
TOP = -1
# One step of a proof: a letter (L or R: the sibling is on that side, N: none) and 32 bytes.
STEP = 33


def leaf_hash(values: Sequence[Column]) -> Column:
    """H of the values as text, each with its byte count."""
    texts = [v.cast("string") for v in values]
    return F.sha2(
        F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256
    )


# -- places ----------------------------------------------------------------------------------


def placed(rows: DataFrame, group: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(`rows` with `tree` and `index`, one row per tree: `tree`, group, `leaves`).

    Trees are numbered in the order of their groups, rows of a tree in the given order.
    """
    spark = rows.sparkSession
    ranged = (
        rows.withColumn("_scan", F.monotonically_increasing_id())
        .repartitionByRange(shuffle_partitions(spark), F.col(group).asc_nulls_first(), *order, "_scan")
        .sortWithinPartitions(F.col(group).asc_nulls_first(), *order, "_scan")
        .drop("_scan")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id())
    )
    kept = stored(ranged, "merkle-leaves")
    # One row per partition and group in it.
    spans = kept.groupBy(F.col("_part").alias("part"), F.col(group).alias("group")).agg(
        F.min("_place").alias("first"), F.count(F.lit(1)).alias("many")
    )
    before = F.sum("many").over(Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("before", F.coalesce(before, F.lit(0)))
    groups = spans.groupBy("group").agg(F.sum("many").alias("leaves"))
    # One row per group meets in this window.
    trees = groups.withColumn("tree", F.row_number().over(Window.orderBy(F.col("group").asc_nulls_first())).cast("long") - 1)
    trees = stored(trees, "merkle-trees")
    spans = spans.join(trees.select(F.col("group").alias("_of"), "tree"), F.col("group").eqNullSafe(F.col("_of")))
    spans = spans.select("part", "tree", "first", "before", "_of")
    found = kept.join(spans, (F.col("_part") == F.col("part")) & F.col(group).eqNullSafe(F.col("_of")))
    index = F.col("_place") - F.col("first") + F.col("before")
    return found.withColumn("index", index).drop("_part", "_place", "part", "first", "before", "_of"), trees


# -- nodes -----------------------------------------------------------------------------------


def height(leaves: Column) -> Column:
    """Levels above the leaves: the least h with 2**h >= leaves."""
    return F.when(leaves <= 1, F.lit(0)).otherwise(F.length(F.bin(leaves - 1)))


def hashed_levels(digests: str, levels: str) -> Column:
    """An array of arrays: the digests and, above them, as many levels as said."""
    return F.expr(f"""
        aggregate(
            sequence(1, {levels} + 1),
            array({digests}),
            (made, step) -> if(step > {levels}, made, concat(made, array(transform(
                sequence(0, cast((size(element_at(made, -1)) - 1) div 2 as int)),
                i -> sha2(concat(element_at(made, -1)[2 * i],
                                 coalesce(get(element_at(made, -1), 2 * i + 1), '')), 256)
            ))))
        )""")


def band_of(nodes: DataFrame, base: int) -> DataFrame:
    """Bands of `nodes` (tree, index, digest, height) at level `base`: one row per 2**BAND of them."""
    bands = nodes.groupBy("tree", F.shiftright("index", BAND).alias("band"), "height").agg(
        F.sort_array(F.collect_list(F.struct("index", "digest"))).alias("_nodes")
    )
    return (
        bands.withColumn("_digests", F.expr("transform(_nodes, x -> x.digest)"))
        .withColumn("_levels", F.least(F.lit(BAND), F.col("height") - base).cast("int"))
        .select("tree", "band", "height", "_levels", hashed_levels("_digests", "_levels").alias("_made"))
    )


def tree_nodes(leaves: DataFrame, most: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(one row per node below a root, one row per root) of all trees in `leaves`.

    leaves: tree, index, digest, height; `most`: the greatest height.
    Nodes: tree, level, index, segment (the step to the parent).  Roots: tree, digest.
    """
    below, roots, base, at = None, None, 0, leaves
    while True:
        bands = stored(band_of(at, base), f"{name}-{base}")
        steps = bands.select("tree", "band", F.posexplode("_made").alias("up", "_row"), "_levels")
        steps = steps.filter(F.col("up") < F.col("_levels"))
        nodes = steps.select(
            "tree",
            (F.col("up") + base).cast("long").alias("level"),
            F.expr(f"shiftleft(band, {BAND} - up)").alias("_first"),
            F.posexplode(
                F.expr("""transform(_row, (x, i) -> case
                    when i % 2 = 1 then concat(encode('L', 'utf-8'), unhex(_row[i - 1]))
                    when i + 1 < size(_row) then concat(encode('R', 'utf-8'), unhex(_row[i + 1]))
                    else concat(encode('N', 'utf-8'), unhex(repeat('00', 32))) end)""")
            ).alias("_i", "segment"),
        ).select("tree", "level", (F.col("_first") + F.col("_i")).alias("index"), "segment")
        done = bands.filter(F.col("height") == base + F.col("_levels"))
        done = done.select("tree", F.expr("element_at(_made, -1)[0]").alias("digest"))
        below = nodes if below is None else below.unionByName(nodes)
        roots = done if roots is None else roots.unionByName(done)
        base += BAND
        if base >= most:
            return below, roots
        at = bands.filter(F.col("height") > base).select(
            "tree", F.col("band").alias("index"), F.expr("element_at(_made, -1)[0]").alias("digest"), "height"
        )


# -- proofs ----------------------------------------------------------------------------------


def jumped(nodes: DataFrame, longest: int) -> DataFrame:
    """Leaves of the row trees with all steps to the root: tree, index, segment.

    nodes: tree, level, index, segment and the parent's place (up_tree, up_level, up_index; null
    where the parent is the root); `longest`: the longest way to the root.
    """
    distance = 1
    while distance < longest:
        further = 2 * distance
        top = F.col("tree") == TOP
        source = nodes.filter(top | (F.col("level") % further == 0))
        # What has reached the root stays out of the join.
        done, source = source.filter("up_tree is null"), source.filter("up_tree is not null")
        target = nodes.filter(top | (F.col("level") % further == distance)).select(
            F.col("tree").alias("up_tree"),
            F.col("level").alias("up_level"),
            F.col("index").alias("up_index"),
            F.col("segment").alias("_more"),
            F.struct("up_tree", "up_level", "up_index").alias("_next"),
        )
        joined = source.join(target, ["up_tree", "up_level", "up_index"], "left")
        nodes = joined.select(
            "tree",
            "level",
            "index",
            F.concat("segment", F.coalesce("_more", F.lit(b""))).alias("segment"),
            F.col("_next.up_tree").alias("up_tree"),
            F.col("_next.up_level").alias("up_level"),
            F.col("_next.up_index").alias("up_index"),
        ).unionByName(done)
        distance = further
        if distance < longest:
            nodes = stored(nodes, f"merkle-jump-{distance}")
    return nodes.filter((F.col("tree") != TOP) & (F.col("level") == 0)).select("tree", "index", "segment")


def with_parents(nodes: DataFrame, trees: DataFrame, top_height: int) -> DataFrame:
    """Nodes with the place of their parent; a node below a subroot points at the subroot's place in the top tree."""
    heights = trees.select("tree", "height")
    inside = F.col("level") + 1 < F.col("height")
    rooted = (F.col("tree") == TOP) | F.lit(top_height == 0)
    under = nodes.join(heights.unionByName(heights.sparkSession.createDataFrame([(TOP, top_height)], "tree long, height int")), "tree")

    def place(within: Column, above: Column) -> Column:
        return F.when(inside, within).when(~rooted, above)

    return under.select(
        "tree",
        "level",
        "index",
        "segment",
        place(F.col("tree"), F.lit(TOP).cast("long")).alias("up_tree"),
        place(F.col("level") + 1, F.lit(0).cast("long")).alias("up_level"),
        place(F.shiftright("index", 1), F.col("tree")).alias("up_index"),
    )


def folded(leaf: str, segment: str) -> Column:
    """The root that a leaf and its steps lead to."""
    return F.expr(f"""
        aggregate(
            sequence(0, octet_length({segment}) div {STEP}),
            {leaf},
            (at, i) -> if({STEP} * i >= octet_length({segment}), at, case
                decode(substr({segment}, {STEP} * i + 1, 1), 'utf-8')
                when 'L' then sha2(concat(lower(hex(substr({segment}, {STEP} * i + 2, 32))), at), 256)
                when 'R' then sha2(concat(at, lower(hex(substr({segment}, {STEP} * i + 2, 32)))), 256)
                else sha2(at, 256) end)
        )""")


def proof_hash(segment: str) -> Column:
    """H of the siblings from the leaf to the root."""
    return F.sha2(
        F.expr(f"""
        array_join(transform(sequence(0, octet_length({segment}) div {STEP}), i -> if(
            {STEP} * i >= octet_length({segment})
                or decode(substr({segment}, {STEP} * i + 1, 1), 'utf-8') = 'N',
            '', lower(hex(substr({segment}, {STEP} * i + 2, 32))))), '')"""),
        256,
    )


def prove(rows: DataFrame, group: str, order: Sequence[str], leaf: str = "leaf") -> DataFrame:
    """`rows` with `subroot`, `root` and `segment`: the steps of their proofs, STEP bytes each.

    rows must hold the hex digest `leaf`; the columns tree, index, segment, subroot, root are taken.
    """
    found, trees = placed(rows, group, [*order, leaf])
    trees = trees.withColumn("height", height(F.col("leaves")).cast("int"))
    # Two numbers to the driver.
    tallest, groups = trees.agg(F.coalesce(F.max("height"), F.lit(0)), F.count(F.lit(1))).first()
    leaves = found.join(trees.select("tree", "height"), "tree")
    below, subroots = tree_nodes(
        leaves.select("tree", "index", F.col(leaf).alias("digest"), "height"), tallest, "merkle-rows"
    )
    subroots = stored(subroots, "merkle-subroots")
    top_height = max(groups - 1, 0).bit_length()
    tops = subroots.select(
        F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("index"), "digest", F.lit(top_height).alias("height")
    )
    above, root = tree_nodes(tops, top_height, "merkle-top")
    nodes = with_parents(below.unionByName(above), trees, top_height)
    # A group of one row has no node below its subroot: its way is the subroot's.
    single = trees.filter("leaves = 1").select("tree", F.lit(0).cast("long").alias("index"))
    lone = with_parents(above, trees, top_height).filter("level = 0").select(
        F.col("index").alias("tree"), "segment", "up_tree", "up_level", "up_index"
    )
    lone = single.join(lone, "tree").select(
        "tree", F.lit(0).cast("long").alias("level"), "index", "segment", "up_tree", "up_level", "up_index"
    )
    proofs = jumped(nodes.unionByName(lone), tallest + top_height)
    return (
        found.join(proofs, ["tree", "index"], "left")
        .withColumn("segment", F.coalesce("segment", F.lit(b"")))
        .join(subroots.withColumnRenamed("digest", "subroot"), "tree")
        .withColumn("root", F.lit(root.first()["digest"] if groups else None).cast("string"))
    )


def manifest(
    df: DataFrame,
    fields: Sequence[str] = FIELDS,
    group: str = "lang",
    id_col: str = "doc_id",
    changed: dict[str, Column] | None = None,
    changes: Column | None = None,
) -> DataFrame:
    """One row per row: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    `changed` and `changes` play a reader whose copy differs: in rows where `changes` holds, the
    fields named in `changed` have other values, and folded_root is worked out from those.
    """
    values = {f: F.col(f) for f in fields}
    held = df.select(
        F.col(id_col).alias("_id"),
        F.col(group).cast("string").alias("_group"),
        leaf_hash(list(values.values())).alias("leaf"),
        (
            F.when(changes, leaf_hash(list((values | changed).values()))) if changed else F.lit(None).cast("string")
        ).alias("_other"),
    )
    # Hashed once: the ranges are sampled from what is stored.
    proved = prove(stored(held, "merkle-hashes"), "_group", ["_id"])
    proved = proved.withColumn("_own", F.coalesce("_other", "leaf")).withColumn("folded_root", folded("_own", "segment"))
    return proved.select(
        F.col("_id").alias(id_col),
        "leaf",
        "subroot",
        "root",
        proof_hash("segment").alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
