"""Location titles, canonical regions and the titles no mapping knows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from klaxon.functions import columns as C


def lookup(mappings: DataFrame) -> DataFrame:
    """(title, mapped): one row per cleaned title, the row with the largest id."""
    cleaned = mappings.select(C.clean_title("raw_title").alias("_title"), "region_id", "id")
    return cleaned.groupBy("_title").agg(F.max_by("region_id", "id").alias("_mapped"))


def normalize_regions(df: DataFrame, mappings: DataFrame, title: str) -> DataFrame:
    """Add `region_id` for a location title.

    The mapping table is joined without a hint: Spark broadcasts it while it is small and
    shuffles, with skew splitting, once it is not.
    """
    joined = df.withColumn("_title", C.clean_title(title)).join(lookup(mappings), "_title", "left")
    region = (
        F.when(C.is_blank(title), F.lit(C.UNKNOWN_REGION))
        .when(F.col("_mapped").isNotNull(), F.col("_mapped"))
        .otherwise(C.region_slug(title))
    )
    return joined.withColumn("region_id", region).drop("_title", "_mapped")


def discover_unrecognized(df: DataFrame, mappings: DataFrame, title: str, seen_at: str) -> DataFrame:
    """Titles without a mapping, trimmed, case kept: how often and when they were seen.

    Runs on feed rows before any debounce, so every repeat counts.
    """
    known = lookup(mappings).select("_title")
    per_title = (
        df.filter(~C.is_blank(title))
        .groupBy(C.trimmed(title).alias("raw_title"))
        .agg(
            F.count("*").alias("occurrences_count"),
            F.min(seen_at).alias("first_seen_at"),
            F.max(seen_at).alias("last_seen_at"),
        )
    )
    unmapped = per_title.withColumn("_title", F.lower("raw_title")).join(known, "_title", "left_anti")
    return unmapped.select(
        C.content_key("raw_title").alias("id"),
        "raw_title",
        "occurrences_count",
        "first_seen_at",
        "last_seen_at",
    )


def merge_unrecognized(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored statistics plus fresh ones; a stored row keeps its id."""
    both = stored.withColumn("_stored", F.col("id")).unionByName(fresh, allowMissingColumns=True)
    return both.groupBy("raw_title").agg(
        F.coalesce(F.max("_stored"), F.max("id")).alias("id"),
        F.sum("occurrences_count").alias("occurrences_count"),
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
    )


def purge_mapped_titles(unrecognized: DataFrame, mapped_titles: DataFrame, title: str = "raw_title") -> DataFrame:
    """Drop discovery rows whose very spelling has been mapped."""
    mapped = mapped_titles.select(C.trimmed(title).alias("raw_title")).distinct()
    return unrecognized.join(mapped, "raw_title", "left_anti")


def review_queue(unrecognized: DataFrame) -> DataFrame:
    return unrecognized.orderBy(F.desc("occurrences_count"), "raw_title")


def list_regions(regions: DataFrame) -> DataFrame:
    return regions.select("region_id", "display_name", "created_at").orderBy("region_id")


def list_mappings(mappings: DataFrame) -> DataFrame:
    return mappings.select("id", "raw_title", "region_id", "created_at", "updated_at").orderBy("raw_title")


# --- maintenance ----------------------------------------------------------------------
# Requests carry `seq`, their order.  Each job says what every request came to: a null
# `reason` means accepted.


class RegionChange(NamedTuple):
    regions: DataFrame
    rejected: DataFrame


class MappingChange(NamedTuple):
    mappings: DataFrame
    unrecognized: DataFrame
    rejected: DataFrame


def validate_regions(requests: DataFrame) -> DataFrame:
    """Region requests (seq, region_id, display_name) with `reason`, null where valid."""
    reason = (
        F.when(C.is_blank("region_id"), F.lit("BLANK_REGION_ID"))
        .when(
            ~F.col("region_id").rlike(C.REGION_ID_PATTERN),
            F.lit("BAD_REGION_ID"),
        )
        .when(C.is_blank("display_name"), F.lit("BLANK_DISPLAY_NAME"))
    )
    return requests.withColumn("reason", reason)


def validate_mappings(requests: DataFrame) -> DataFrame:
    """Mapping requests (seq, raw_title, region_id) with `reason`, null where valid."""
    reason = F.when(C.is_blank("raw_title"), F.lit("BLANK_TITLE")).when(
        C.is_blank("region_id"), F.lit("BLANK_REGION_ID")
    )
    return requests.withColumn("reason", reason)


def _settle(requests: DataFrame, key: str, taken: DataFrame, conflict: str) -> DataFrame:
    """Give still-valid requests a `reason` if their `key` is taken, or asked for earlier.

    Only the least seq per key can win, and map tasks keep just that one; the losers are
    told apart by a join on (key), never by sorting a key's requests in one task.
    """
    winners = requests.filter(F.col("reason").isNull()).groupBy(key).agg(F.min("seq").alias("_first"))
    free = winners.join(taken.select(key).distinct(), key, "left_anti").withColumn("_free", F.lit(True))
    wins = F.coalesce(F.col("_free") & (F.col("seq") == F.col("_first")), F.lit(False))
    return (
        requests.join(free, key, "left")
        .withColumn("reason", F.when(F.col("reason").isNull() & ~wins, F.lit(conflict)).otherwise(F.col("reason")))
        .drop("_first", "_free")
    )


def judge_regions(regions: DataFrame, requests: DataFrame) -> DataFrame:
    """What each region request comes to: `reason` is null if it is created."""
    return _settle(validate_regions(requests), "region_id", regions, "REGION_EXISTS")


def add_regions(regions: DataFrame, requests: DataFrame, as_of: Column) -> RegionChange:
    judged = judge_regions(regions, requests)
    created = judged.filter(F.col("reason").isNull()).select(
        F.upper(C.trimmed("region_id")).alias("region_id"),
        C.trimmed("display_name").alias("display_name"),
        as_of.alias("created_at"),
    )
    return RegionChange(regions.unionByName(created), judged.filter(F.col("reason").isNotNull()))


def mapping_fk_check(mappings: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose region exists, rows whose region does not)."""
    known = regions.select("region_id").distinct()
    return mappings.join(known, "region_id", "left_semi"), mappings.join(known, "region_id", "left_anti")


def cascade_mappings(mappings: DataFrame, remaining_regions: DataFrame) -> DataFrame:
    """Mappings left after regions were removed."""
    return mapping_fk_check(mappings, remaining_regions)[0]


def judge_mappings(mappings: DataFrame, regions: DataFrame, requests: DataFrame) -> DataFrame:
    """What each mapping request comes to: `reason` is null if it is registered.

    A request for a region that does not exist never takes the title.
    """
    known = regions.select(F.col("region_id").alias("_region")).distinct().withColumn("_known", F.lit(True))
    placed = (
        validate_mappings(requests)
        .withColumn("_region", F.upper(C.trimmed("region_id")))
        .withColumn("_title", C.clean_title("raw_title"))
        .join(known, "_region", "left")
        .withColumn(
            "reason",
            F.when(
                F.col("reason").isNull() & F.col("_known").isNull(), F.lit("NO_SUCH_REGION")
            ).otherwise(F.col("reason")),
        )
        .drop("_known")
    )
    taken = mappings.select(F.col("raw_title").alias("_title"))
    return _settle(placed, "_title", taken, "Mapping for title already exists")


def add_mappings(
    mappings: DataFrame, regions: DataFrame, unrecognized: DataFrame, requests: DataFrame, as_of: Column
) -> MappingChange:
    """Register titles; a registered title leaves the discovery table."""
    judged = judge_mappings(mappings, regions, requests)
    accepted = judged.filter(F.col("reason").isNull())
    created = accepted.select(
        C.content_key("_title").alias("id"),
        F.col("_title").alias("raw_title"),
        F.col("_region").alias("region_id"),
        as_of.alias("created_at"),
        as_of.alias("updated_at"),
    )
    return MappingChange(
        mappings.unionByName(created),
        purge_mapped_titles(unrecognized, accepted),
        judged.filter(F.col("reason").isNotNull()).drop("_title", "_region"),
    )


def delete_mappings(mappings: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining mappings, ids that were not found)."""
    wanted = ids.select("id").distinct()
    return mappings.join(wanted, "id", "left_anti"), wanted.join(mappings.select("id"), "id", "left_anti")


def assign_unrecognized(
    mappings: DataFrame, regions: DataFrame, unrecognized: DataFrame, assignments: DataFrame, as_of: Column
) -> MappingChange:
    """Map discovered titles, named by (seq, id), to `region_id`."""
    named = assignments.join(unrecognized.select("id", "raw_title"), "id", "left")
    found = F.col("raw_title").isNotNull()
    missing = named.filter(~found).withColumn("reason", F.lit("Unrecognized location not found"))
    change = add_mappings(mappings, regions, unrecognized, named.filter(found), as_of)
    return change._replace(rejected=change.rejected.unionByName(missing.select(*change.rejected.columns)))


def check_seed(regions: DataFrame, mappings: DataFrame) -> DataFrame:
    """Problems of a seed: (kind, subject), empty when it can be loaded."""
    bad_ids = validate_regions(regions.withColumn("seq", F.lit(0))).filter(F.col("reason").isNotNull())
    _, orphans = mapping_fk_check(mappings, regions)
    repeated = mappings.groupBy(C.clean_title("raw_title").alias("subject")).count().filter("count > 1")
    twice = regions.groupBy(F.col("region_id").alias("subject")).count().filter("count > 1")
    named = lambda df, kind, subject: df.select(F.lit(kind).alias("kind"), F.col(subject).alias("subject"))
    return (
        named(bad_ids, "INVALID_REGION", "region_id")
        .unionByName(named(twice, "REPEATED_REGION", "subject"))
        .unionByName(named(orphans, "UNKNOWN_REGION", "raw_title"))
        .unionByName(named(repeated, "REPEATED_TITLE", "subject"))
    )


def load_seed(spark, regions_path: str, mappings_path: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Seed tables from CSV: regions (region_id, display_name), mappings (raw_title, region_id)."""
    regions = spark.read.csv(regions_path, header=True, schema="region_id string, display_name string")
    mappings = spark.read.csv(mappings_path, header=True, schema="raw_title string, region_id string")
    return (
        regions.withColumn("created_at", as_of),
        mappings.select(
            C.content_key(C.clean_title("raw_title")).alias("id"),
            C.clean_title("raw_title").alias("raw_title"),
            "region_id",
            as_of.alias("created_at"),
            as_of.alias("updated_at"),
        ),
    )
