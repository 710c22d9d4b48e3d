"""The driver's tables as alerts, regions and subscriptions.

Rules, the same in Spark here and in SQL in ``klaxon.plans.oracles``:
events become feed alerts, nations regions and mappings, customers subscriptions, and
orders the change log of the subscriptions.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from klaxon.functions import columns as C
from klaxon.sources.feeds import snapshot_to_events

AS_OF = "2024-02-01T00:00:00Z"
INSTANT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def as_of() -> Column:
    return F.to_timestamp(F.lit(AS_OF))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def raw_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Feed alerts: id, location_title, started_at, alert_type, plus `seen_at`."""
    e = table(spark, folder, "events")
    number = (F.col("user_id") % 30).cast("string")
    title = (
        F.when(F.col("event_id") % 97 == 0, F.lit(None).cast("string"))
        .when(F.col("event_id") % 3 == 0, F.concat(F.lit("NATION_"), number))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit("  nation_"), number, F.lit(" ")))
        .otherwise(F.concat(F.lit("Nation_"), number))
    )
    kind = (
        F.when(F.col("event_id") % 50 == 0, F.lit(""))
        .when(F.col("event_type") == "click", F.lit("air_raid"))
        .when(F.col("event_type") == "view", F.lit("artillery_shelling"))
        .when(F.col("event_type") == "purchase", F.lit("chemical"))
        .when(F.col("event_type") == "signup", F.lit("urban_fights"))
        .otherwise(F.lit("Drone Attack"))
    )
    seen = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").alias("id"),
        title.alias("location_title"),
        F.date_format(seen, INSTANT).alias("started_at"),
        kind.alias("alert_type"),
        seen.alias("seen_at"),
    )


def regions(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "nation")
    return n.select(
        F.concat("n_name", F.lit("_REGION")).alias("region_id"),
        F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string")).alias("display_name"),
        as_of().alias("created_at"),
    )


def mappings(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "nation")
    return n.select(
        F.col("n_nationkey").cast("long").alias("id"),
        F.lower("n_name").alias("raw_title"),
        F.concat("n_name", F.lit("_REGION")).alias("region_id"),
        as_of().alias("created_at"),
        as_of().alias("updated_at"),
    )


def subscriptions(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    severity = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("INFO"))
        .when(F.col("c_mktsegment") == "AUTOMOBILE", F.lit("WARNING"))
        .when(F.col("c_mktsegment") == "MACHINERY", F.lit("CRITICAL"))
        .when(F.col("c_mktsegment") == "FURNITURE", F.lit(""))
    )
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("user_id"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("DISCORD")).otherwise(F.lit("NTFY")).alias("channel"),
        F.concat(F.lit("topic-"), (F.col("c_custkey") % 40).cast("string")).alias("recipient_address"),
        F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"), F.lit("_REGION")).alias("region_id"),
        severity.alias("min_severity"),
        (F.col("c_acctbal") >= 0).alias("active"),
        as_of().alias("created_at"),
    )


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Normalized alert events of the feed."""
    return snapshot_to_events(raw_alerts(spark, folder), mappings(spark, folder), as_of())


def with_lineage(events: DataFrame) -> DataFrame:
    """Log lineage for alert events: three partitions, offsets from the provider's id."""
    number = F.regexp_extract("event_id", "([0-9]+)$", 1).cast("long")
    return events.select(
        "*",
        F.lit("events.raw-alerts").alias("topic"),
        (number % 3).cast("int").alias("partition"),
        number.alias("offset"),
    )


def number_of(event_id: str = "event_id") -> Column:
    return F.regexp_extract(event_id, "([0-9]+)$", 1).cast("long")


def change_log(spark: SparkSession, folder: str) -> DataFrame:
    """Subscription changes from orders: seq = order key, id = its customer."""
    o = table(spark, folder, "orders")
    op = (
        F.when(F.col("o_orderstatus") == "F", F.lit("CREATE"))
        .when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderkey") % 7 == 0), F.lit("DELETE"))
        .otherwise(F.lit("UPDATE"))
    )
    create = op == "CREATE"
    # Beyond the last customer there are ids nobody has.
    wanted = F.col("o_custkey") + F.when(F.col("o_orderkey") % 41 == 0, F.lit(100_000_000)).otherwise(F.lit(0))
    region = F.when(F.col("o_orderkey") % 4 == 0, F.lit(" ")).otherwise(
        F.concat(F.lit("NATION_"), (F.col("o_orderkey") % 25).cast("string"), F.lit("_REGION"))
    )
    severity = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("CRITICAL"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit("WARNING"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.lit(""))
    )
    return o.select(
        F.col("o_orderkey").alias("seq"),
        op.alias("op"),
        F.when(~create, wanted).alias("id"),
        F.when(create, F.concat(F.lit("user-"), F.col("o_custkey").cast("string"))).alias("user_id"),
        F.when(create & (F.col("o_orderkey") % 13 != 0), F.lit("NTFY")).alias("channel"),
        F.when(create, F.concat(F.lit("topic-"), (F.col("o_custkey") % 40).cast("string"))).alias(
            "recipient_address"
        ),
        region.alias("region_id"),
        severity.alias("min_severity"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 2 == 0).alias("active"),
    )


def region_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Region requests from customers: repeats, known regions, bad and blank ids."""
    c = table(spark, folder, "customer")
    number = (F.col("c_custkey") % 60).cast("string")
    region = (
        F.when(F.col("c_custkey") % 19 == 0, F.concat(F.lit("bad-"), number))
        .when(F.col("c_custkey") % 23 == 0, F.lit(" "))
        .otherwise(F.concat(F.lit("NATION_"), number, F.lit("_REGION")))
    )
    return c.select(
        F.col("c_custkey").alias("seq"),
        region.alias("region_id"),
        F.when(F.col("c_custkey") % 29 == 0, F.lit("")).otherwise(
            F.concat(F.lit(" Area "), F.col("c_custkey").cast("string"), F.lit(" "))
        ).alias("display_name"),
    )


def mapping_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Mapping requests from customers: repeats, mapped titles, unknown and blank regions."""
    c = table(spark, folder, "customer")
    number = F.col("c_custkey") % 200
    title = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" Nation_"), number.cast("string"))).otherwise(
        F.concat(F.lit("NATION_"), number.cast("string"), F.lit("\t"))
    )
    region = F.when(F.col("c_custkey") % 31 == 0, F.lit("  ")).otherwise(
        F.concat(F.lit(" nation_"), (F.col("c_custkey") % 28).cast("string"), F.lit("_region"))
    )
    return c.select(F.col("c_custkey").alias("seq"), title.alias("raw_title"), region.alias("region_id"))
