"""The alert and anomaly logs: JSON values keyed by region, on Kafka or in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.types import StringType, StructField, StructType

from klaxon.schemas import ALERT_JSON, ANOMALY_JSON, LOG_RECORD

# --- fixed values -----------------------------------------------------------------
RAW_ALERTS = "events.raw-alerts"
ANOMALIES = "events.anomalies"
LOG_PARTITIONS = 3
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
# ----------------------------------------------------------------------------------

_WRITE = {"ignoreNullFields": "false", "timestampFormat": TIMESTAMP_FORMAT}
_BROKEN = "_broken"
_LINEAGE = ["topic", "partition", "offset"]


def read_log_files(spark: SparkSession, path: str, streaming: bool = False, files_per_batch: int | None = None):
    """Log records kept in Parquet files with the columns Kafka would give."""
    if not streaming:
        return spark.read.schema(LOG_RECORD).parquet(path)
    reader = spark.readStream.schema(LOG_RECORD)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def read_kafka(spark: SparkSession, servers: str, topic: str, streaming: bool = True, **options) -> DataFrame:
    """Log records of a Kafka topic from its start.  Needs the Kafka package on the classpath."""
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    reader = reader.option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    reader = reader.option("startingOffsets", "earliest").options(**options)
    return reader.load().select(
        "topic",
        "partition",
        "offset",
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
    )


def _parsed(log: DataFrame, schema: StructType) -> DataFrame:
    tolerant = StructType([*schema.fields, StructField(_BROKEN, StringType(), True)])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}
    return log.withColumn("_body", F.from_json("value", tolerant, options))


def _is_bad():
    # Null and empty values give a null body and no corrupt text.
    return F.col("_body").isNull() | F.col(f"_body.{_BROKEN}").isNotNull() | (F.trim("value") == "")


def flag_malformed(log: DataFrame, schema: StructType = ALERT_JSON) -> DataFrame:
    """The log with `is_bad`: the value cannot be read as `schema`."""
    return _parsed(log, schema).withColumn("is_bad", F.coalesce(_is_bad(), F.lit(True))).drop("_body")


def split_malformed(log: DataFrame, schema: StructType = ALERT_JSON) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine) records; neither stops the stream."""
    flagged = flag_malformed(log, schema)
    return flagged.filter("not is_bad").drop("is_bad"), flagged.filter("is_bad").drop("is_bad")


def decode_alerts(log: DataFrame) -> DataFrame:
    """Alert events with their lineage; undecodable records are left out (see split_malformed)."""
    good = _parsed(log, ALERT_JSON).filter(~F.coalesce(_is_bad(), F.lit(True)))
    return good.select(
        F.col("_body.eventId").alias("event_id"),
        F.col("_body.regionId").alias("region_id"),
        F.col("_body.eventType").alias("event_type"),
        F.col("_body.status").alias("status"),
        F.col("_body.severity").alias("severity"),
        F.col("_body.timestamp").alias("event_timestamp"),
        *_LINEAGE,
    )


def decode_anomalies(log: DataFrame) -> DataFrame:
    good = _parsed(log, ANOMALY_JSON).filter(~F.coalesce(_is_bad(), F.lit(True)))
    return good.select(
        F.col("_body.anomalyId").alias("anomaly_id"),
        F.col("_body.regionId").alias("region_id"),
        F.col("_body.anomalyType").alias("anomaly_type"),
        F.col("_body.description").alias("description"),
        F.col("_body.eventCount").alias("event_count"),
        F.col("_body.windowDurationSeconds").alias("window_duration_seconds"),
        F.col("_body.severity").alias("severity"),
        F.col("_body.detectedAt").alias("detected_at"),
        F.col("_body.triggeringEventIds").alias("triggering_event_ids"),
        *_LINEAGE,
    )


def encode_alerts(alerts: DataFrame) -> DataFrame:
    """(key, value) per alert; the key keeps a region's records in one Kafka partition."""
    body = F.struct(
        F.col("event_id").alias("eventId"),
        F.col("region_id").alias("regionId"),
        F.col("event_type").alias("eventType"),
        "status",
        "severity",
        F.col("event_timestamp").alias("timestamp"),
    )
    return _encoded(alerts, body)


def encode_anomalies(anomalies: DataFrame) -> DataFrame:
    body = F.struct(
        F.col("anomaly_id").alias("anomalyId"),
        F.col("region_id").alias("regionId"),
        F.col("anomaly_type").alias("anomalyType"),
        "description",
        F.col("event_count").alias("eventCount"),
        F.col("window_duration_seconds").alias("windowDurationSeconds"),
        "severity",
        F.col("detected_at").alias("detectedAt"),
        F.col("triggering_event_ids").alias("triggeringEventIds"),
    )
    return _encoded(anomalies, body)


def _encoded(rows: DataFrame, body) -> DataFrame:
    lineage = [c for c in _LINEAGE if c in rows.columns]
    return rows.select(*lineage, F.col("region_id").alias("key"), F.to_json(body, _WRITE).alias("value"))


# An offset is run, batch and rank: bits of the last two.
BATCH_BITS, RANK_BITS = 24, 28


def as_log_records(
    encoded: DataFrame, topic: str, partitions: int = LOG_PARTITIONS, batch_id: int | None = None, run: int = 0
) -> DataFrame:
    """Give encoded rows the lineage columns of a log file; existing ones are kept.

    With a `batch_id` rows without an offset get one that a replay of the batch gives again: the
    number of the run in the upper bits, then the batch, then a rank that rises with event time
    within a region.
    """
    have = set(encoded.columns)
    partition = F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int")
    if batch_id is not None and "offset" not in have:
        placed = encoded if "partition" in have else encoded.withColumn("partition", partition)
        return as_log_records(_with_offsets(placed, run, batch_id), topic, partitions)
    return encoded.select(
        (F.col("topic") if "topic" in have else F.lit(topic)).alias("topic"),
        (F.col("partition") if "partition" in have else partition).alias("partition"),
        (F.col("offset") if "offset" in have else F.lit(None).cast("long")).alias("offset"),
        "key",
        "value",
    )


def _with_offsets(placed: DataFrame, run: int, batch_id: int) -> DataFrame:
    """Ranks from 0 in each log partition by region, event time and content.

    Rows are ranked within (region, hour), where a rank starts from the sum of the hours before;
    the counts of these are all that a partition brings together.
    """
    at = F.coalesce(F.get_json_object("value", "$.timestamp"), F.get_json_object("value", "$.detectedAt"), F.lit(""))
    slot = ["partition", "key", "_hour"]
    timed = placed.withColumn("_at", at).withColumn("_hour", F.substring("_at", 1, 13))
    before = Window.partitionBy("partition").orderBy("key", "_hour").rowsBetween(Window.unboundedPreceding, -1)
    bases = timed.groupBy(*slot).count().select(
        *(F.col(c).alias(f"_of{c}") for c in slot), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base")
    )
    same = F.lit(True)
    for c in slot:
        same = same & F.col(c).eqNullSafe(F.col(f"_of{c}"))
    own = Window.partitionBy(*slot).orderBy("_at", "value")
    first = (run << (BATCH_BITS + RANK_BITS)) + (batch_id << RANK_BITS)
    ranked = timed.withColumn("_nth", F.row_number().over(own)).join(bases, same)
    offset = F.lit(first).cast("long") + F.col("_base") + F.col("_nth") - 1
    return ranked.withColumn("offset", offset).select(*placed.columns, "offset")


def write_log_files(encoded: DataFrame, path: str, topic: str, mode: str = "append") -> None:
    """Append records to a file log, one folder per log partition.

    REBALANCE lets a log partition that holds most rows be several files.
    """
    records = as_log_records(encoded, topic)
    records.hint("rebalance", "partition").write.mode(mode).partitionBy("partition").parquet(path)


def write_kafka(encoded: DataFrame, servers: str, topic: str) -> None:
    """Publish to Kafka; the broker partitions by key.  Needs the Kafka package."""
    out = encoded.select("key", "value").write.format("kafka")
    out.option("kafka.bootstrap.servers", servers).option("topic", topic).save()
