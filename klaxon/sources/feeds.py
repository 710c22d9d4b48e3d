"""Reading provider snapshots and pushed alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from klaxon.functions import columns as C
from klaxon.operators.regions import normalize_regions
from klaxon.operators.running import running_last
from klaxon.schemas import FEED_ALERT, SNAPSHOT

# Fixed value: event ids of polled alerts are this prefix and the provider's id.
FEED_ID_PREFIX = "alerts-in-ua-"

# Polls per slot when a feed's poll sequence is walked; a feed is split into such slots.
POLLS_PER_SLOT = 100_000


_BROKEN = "_broken"


def read_snapshot_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Files of one JSON snapshot per line, one row per line: `text`, `source_file` and what it holds.

    Unknown fields are ignored, blank lines are none.  `unreadable` tells the lines that are no
    snapshot.
    """
    reader = spark.readStream if streaming else spark.read
    lines = reader.text(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("source_file"))
    tolerant = StructType([*SNAPSHOT.fields, StructField(_BROKEN, StringType(), True)])
    body = F.from_json("text", tolerant, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN})
    read = lines.filter(~C.is_blank("text")).withColumn("_body", body)
    unreadable = F.col("_body").isNull() | F.col(f"_body.{_BROKEN}").isNotNull()
    return read.select("text", "source_file", unreadable.alias("unreadable"), *(f"_body.{c}" for c in SNAPSHOT.names))


def split_unreadable(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshots, quarantine: source_file, text) of `read_snapshot_lines`; neither stops the feed."""
    good = lines.filter("not unreadable").select(*SNAPSHOT.names)
    return good, lines.filter("unreadable").select("source_file", "text")


def read_snapshots(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Files of one JSON snapshot per line, one row per alert.  `split_unreadable` has the other lines."""
    return explode_alerts(split_unreadable(read_snapshot_lines(spark, path, streaming))[0])


def decode_snapshots(stored: DataFrame, payload: str = "payload") -> DataFrame:
    """Stored polls (JSON text in `payload`) to one row per alert, other columns kept."""
    others = [c for c in stored.columns if c != payload]
    body = F.from_json(payload, SNAPSHOT).alias("_body")
    return explode_alerts(stored.select(*others, body).select(*others, "_body.alerts"))


def explode_alerts(snapshots: DataFrame) -> DataFrame:
    """One row per element of `alerts`; a null or empty array gives none."""
    others = [c for c in snapshots.columns if c not in ("alerts", "disclaimer")]
    return snapshots.select(*others, F.explode("alerts").alias("_alert")).select(*others, "_alert.*")


def drop_unchanged_snapshots(
    polls: DataFrame,
    feed: str = "feed",
    seq: str = "seq",
    version: str = "last_modified",
    polls_per_slot: int = POLLS_PER_SLOT,
) -> DataFrame:
    """Drop a poll whose version equals the last non-blank version before it in its feed.

    A blank version is never suppressed and never remembered.  Versions are compared on the
    three narrow columns only, feed by feed in slots of the sequence; the payloads are
    joined back by (feed, seq, version).  Repeats of a (feed, seq) are one poll: each is
    compared with what came before that number, and the largest version of them is remembered.
    """
    known = F.when(~C.is_blank(version), F.col(version))
    narrow = polls.select(feed, seq, known.alias("_known"))
    one = narrow.groupBy(feed, seq).agg(F.max("_known").alias("_kept"))
    before = running_last(one, [feed], seq, "_kept", "_before", polls_per_slot, inclusive=False)
    unchanged = before.filter(F.col("_before").isNotNull()).select(feed, seq, F.col("_before").alias(version))
    return polls.join(unchanged, [feed, seq, version], "left_anti")


def snapshot_to_events(
    feed_alerts: DataFrame, mappings: DataFrame, as_of: Column, id_prefix: str = FEED_ID_PREFIX
) -> DataFrame:
    """Feed alerts to alert events; alerts without a title are dropped."""
    titled = feed_alerts.filter(~C.is_blank("location_title"))
    kind = C.event_type("alert_type")
    content = C.content_id(*[c for c in FEED_ALERT.names if c in feed_alerts.columns])
    return (
        normalize_regions(titled, mappings, "location_title")
        .withColumn("event_type", kind)
        .select(
            F.coalesce(F.concat(F.lit(id_prefix), F.col("id").cast("string")), content).alias("event_id"),
            "region_id",
            "event_type",
            F.lit("ACTIVE").alias("status"),
            C.severity_of_type("event_type").alias("severity"),
            C.parse_instant("started_at", as_of).alias("event_timestamp"),
        )
    )


def with_ingest_defaults(pushed: DataFrame, as_of: Column) -> DataFrame:
    """Fill what a pushed alert may leave out; the id becomes a hash of its content."""
    content = C.content_id("region_id", "event_type", "status", "severity", F.unix_micros("event_timestamp"))
    return pushed.select(
        F.coalesce("event_id", content).alias("event_id"),
        "region_id",
        "event_type",
        F.coalesce("status", F.lit("ACTIVE")).alias("status"),
        F.coalesce("severity", F.lit("WARNING")).alias("severity"),
        F.coalesce("event_timestamp", as_of).alias("event_timestamp"),
    )


def merge_feeds(polled: DataFrame, pushed: DataFrame) -> DataFrame:
    """One log of two feeds: `polled` has been through the debounce, `pushed` never is."""
    return polled.unionByName(pushed)
