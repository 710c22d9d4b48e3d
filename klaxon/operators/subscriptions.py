"""Subscription table: searches and change-log jobs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from klaxon.functions import columns as C
from klaxon.operators.delivery import ROUTING_KEYS
from klaxon.schemas import SUBSCRIPTION, SUBSCRIPTION_CHANGE

DEFAULT_SEVERITY = "INFO"


class SubscriptionChange(NamedTuple):
    subscriptions: DataFrame
    rejected: DataFrame


# --- searches -------------------------------------------------------------------------


def find_subscriptions(
    subscriptions: DataFrame, user: str | None = None, region: str | None = None, active: bool | None = None
) -> DataFrame:
    """Search by any of user, region and active.

    With a user given the region is compared without regard to case; as the leading
    criterion it must match exactly.
    """
    has_user = user is not None and user.strip() != ""
    has_region = region is not None and region.strip() != ""
    found = subscriptions
    if has_user:
        found = found.filter(F.col("user_id") == user)
    if has_region and has_user:
        found = found.filter(F.upper("region_id") == region.upper())
    elif has_region:
        found = found.filter(F.col("region_id") == region)
    if active is not None:
        found = found.filter(F.col("active") == F.lit(active))
    return found


def find_by_recipient(
    subscriptions: DataFrame, recipient: str, channel: str, active: bool | None = None
) -> DataFrame:
    found = subscriptions.filter((F.col("recipient_address") == recipient) & (F.col("channel") == channel))
    return found if active is None else found.filter(F.col("active") == F.lit(active))


def find_by_user_region_channel(subscriptions: DataFrame, user: str, region: str, channel: str) -> DataFrame:
    return subscriptions.filter(
        (F.col("user_id") == user) & (F.col("region_id") == region) & (F.col("channel") == channel)
    )


def get_by_id(table: DataFrame, key: int) -> DataFrame:
    return table.filter(F.col("id") == key)


# --- changes --------------------------------------------------------------------------


def validate_creates(changes: DataFrame) -> DataFrame:
    """CREATE rows with `reason`, null where valid."""
    reason = (
        F.when(C.is_blank("user_id"), F.lit("userId must not be blank"))
        .when(F.col("channel").isNull(), F.lit("channel must not be null"))
        .when(~F.col("channel").isin(*ROUTING_KEYS), F.lit("channel is not known"))
        .when(C.is_blank("recipient_address"), F.lit("recipientAddress must not be blank"))
        .when(C.is_blank("region_id"), F.lit("BLANK_REGION_ID"))
    )
    return changes.filter(F.col("op") == "CREATE").withColumn("reason", reason)


def created_id() -> Column:
    """The id a CREATE gets: a hash of its place in the log and its user."""
    return C.content_key("seq", "user_id")


def created_rows(changes: DataFrame, as_of: Column) -> DataFrame:
    """New subscription rows of valid CREATEs, with the `seq` they come from."""
    return validate_creates(changes).filter(F.col("reason").isNull()).select(
        created_id().alias("id"),
        "user_id",
        "channel",
        "recipient_address",
        "region_id",
        F.when(C.is_blank("min_severity"), F.lit(DEFAULT_SEVERITY)).otherwise(F.col("min_severity")).alias(
            "min_severity"
        ),
        F.lit(True).alias("active"),
        as_of.alias("created_at"),
        "seq",
    )


def apply_subscription_changes(subscriptions: DataFrame, changes: DataFrame, as_of: Column) -> SubscriptionChange:
    """Apply CREATE / UPDATE / DELETE rows in the order of `seq`.

    The result is what running the log one by one would give: an id exists from its CREATE
    (or always, in the base) until its first DELETE; changes outside that span are rejected.
    An UPDATE overwrites region and minimum severity unless blank, and active unless null.
    All changes of an id fold into one row before they meet the table.
    """
    known = subscriptions.select(*SUBSCRIPTION.names, F.lit(None).cast("long").alias("_born")).unionByName(
        created_rows(changes, as_of).withColumnRenamed("seq", "_born")
    )
    # The last value and its seq are enough: if the last one came before the CREATE, all did.
    log = changes.filter(F.col("op").isin("UPDATE", "DELETE") & F.col("id").isNotNull())
    update = F.col("op") == "UPDATE"
    folds = [F.max(F.when(F.col("op") == "DELETE", F.col("seq"))).alias("_deleted_seq")]
    for name, given in (
        ("region_id", ~C.is_blank("region_id")),
        ("min_severity", ~C.is_blank("min_severity")),
        ("active", F.col("active").isNotNull()),
    ):
        seq = F.when(update & given, F.col("seq"))
        folds += [F.max_by(name, seq).alias(f"_{name}"), F.max(seq).alias(f"_{name}_seq")]
    folded = log.groupBy("id").agg(*folds)

    counts = lambda seq: F.col(seq).isNotNull() & (
        F.col("_born").isNull() | (F.col(seq) > F.col("_born"))
    )
    changed = lambda name: F.when(counts(f"_{name}_seq"), F.col(f"_{name}")).otherwise(F.col(name)).alias(name)
    merged = (
        known.join(folded, "id", "left")
        .filter(~counts("_deleted_seq"))
        .select(
            "id",
            "user_id",
            "channel",
            "recipient_address",
            changed("region_id"),
            changed("min_severity"),
            changed("active"),
            "created_at",
        )
    )
    return SubscriptionChange(merged, _rejected(subscriptions, changes, as_of))


def _rejected(subscriptions: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """Changes that do not apply, with `reason`."""
    existing = subscriptions.select("id", F.lit(None).cast("long").alias("_born")).unionByName(
        created_rows(changes, as_of).select("id", F.col("seq").alias("_born"))
    ).withColumn("_exists", F.lit(True))
    later = changes.filter(F.col("op").isin("UPDATE", "DELETE")).join(existing, "id", "left")
    alive = F.col("_exists") & (F.col("_born").isNull() | (F.col("seq") > F.col("_born")))
    first_delete = (
        later.filter(alive & (F.col("op") == "DELETE")).groupBy("id").agg(F.min("seq").alias("_gone"))
    )
    missing = later.join(first_delete, "id", "left").filter(
        ~F.coalesce(alive & (F.col("_gone").isNull() | (F.col("seq") <= F.col("_gone"))), F.lit(False))
    )
    unknown = changes.filter(~F.coalesce(F.col("op").isin("CREATE", "UPDATE", "DELETE"), F.lit(False)))
    shape = changes.columns
    return (
        validate_creates(changes)
        .filter(F.col("reason").isNotNull())
        .select(*shape, "reason")
        .unionByName(missing.select(*shape, F.lit("Subscription not found").alias("reason")))
        .unionByName(unknown.select(*shape, F.lit("Unknown operation").alias("reason")))
    )


def create_subscriptions(subscriptions: DataFrame, requests: DataFrame, as_of: Column) -> SubscriptionChange:
    return apply_subscription_changes(subscriptions, _as_log(requests, "CREATE"), as_of)


def update_subscriptions(subscriptions: DataFrame, requests: DataFrame, as_of: Column) -> SubscriptionChange:
    return apply_subscription_changes(subscriptions, _as_log(requests, "UPDATE"), as_of)


def delete_subscriptions(subscriptions: DataFrame, requests: DataFrame, as_of: Column) -> SubscriptionChange:
    return apply_subscription_changes(subscriptions, _as_log(requests, "DELETE"), as_of)


def _as_log(requests: DataFrame, op: str) -> DataFrame:
    """Complete a single-operation request table to the change-log columns."""
    have = set(requests.columns)
    return requests.select(
        *[
            F.lit(op).alias("op")
            if f.name == "op"
            else (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in SUBSCRIPTION_CHANGE.fields
        ]
    )


def deactivate_recipients(subscriptions: DataFrame, recipients: DataFrame) -> DataFrame:
    """Set every subscription of the listed (recipient_address, channel) pairs inactive."""
    listed = recipients.select("recipient_address", "channel").distinct().withColumn("_off", F.lit(True))
    return (
        subscriptions.join(listed, ["recipient_address", "channel"], "left")
        .withColumn("active", F.when(F.col("_off"), F.lit(False)).otherwise(F.col("active")))
        .select(*subscriptions.columns)
    )


def deactivated_regions(subscriptions: DataFrame, recipients: DataFrame) -> DataFrame:
    """The regions a deactivation touches."""
    listed = recipients.select("recipient_address", "channel").distinct()
    touched = subscriptions.join(listed, ["recipient_address", "channel"], "left_semi")
    return touched.filter(~C.is_blank("region_id")).select("region_id").distinct()
