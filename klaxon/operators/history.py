"""Append-only alert and anomaly history: Parquet, one folder per UTC day."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from klaxon.schemas import ALERT_HISTORY, ANOMALY_EVENT

DAY = "event_date"
BATCH = "batch_id"
RUN = "run_id"


def to_alert_history(alerts: DataFrame, as_of: Column) -> DataFrame:
    """Alert events with lineage to history rows; `received_at` is filled where missing."""
    received = F.coalesce("received_at", as_of) if "received_at" in alerts.columns else as_of
    return alerts.select(
        "event_id",
        "region_id",
        "event_type",
        "status",
        "severity",
        "event_timestamp",
        received.alias("received_at"),
        F.col("topic").alias("kafka_topic"),
        F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
    )


def split_incomplete(history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(complete rows, rows with a null in a NOT NULL column)."""
    complete = F.lit(True)
    for name in ALERT_HISTORY.names:
        complete = complete & F.col(name).isNotNull()
    return history.filter(complete), history.filter(~complete)


def archive_alerts(alerts: DataFrame, path: str, as_of: Column, mode: str = "append") -> DataFrame:
    """Append complete rows to the history; returns the quarantined rest."""
    complete, incomplete = split_incomplete(to_alert_history(alerts, as_of))
    write_days(complete, path, "event_timestamp", mode)
    return incomplete


def archive_anomalies(anomalies: DataFrame, path: str, mode: str = "append") -> None:
    """Append anomalies to their history, triggering ids included."""
    write_days(anomalies.select(*ANOMALY_EVENT.names), path, "detected_at", mode)


def write_days(
    rows: DataFrame, path: str, at: str, mode: str = "append", batch_id: int | None = None, run_id: str = "0"
) -> None:
    """One folder per day, rows of a region together inside a file.

    REBALANCE splits a crowded day into even files and merges thin ones, without sampling.
    The sort gives narrow region and time ranges per row group, which is what the filters
    of the finders below are pushed down to.  With a `batch_id` the rows of that micro-batch
    replace what an earlier attempt of it wrote in the same run; other runs' rows stay.
    """
    laid_out = rows.withColumn(DAY, F.to_date(at)).hint("rebalance", DAY).sortWithinPartitions(DAY, "region_id", at)
    if batch_id is None:
        laid_out.write.mode(mode).partitionBy(DAY).parquet(path)
        return
    replacing = laid_out.withColumn(RUN, F.lit(run_id)).withColumn(BATCH, F.lit(batch_id)).write.mode("overwrite")
    replacing.option("partitionOverwriteMode", "dynamic").partitionBy(RUN, BATCH, DAY).parquet(path)


def _with_day(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(DAY, DateType(), True)])


def read_alert_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_with_day(ALERT_HISTORY)).parquet(path)


def read_anomaly_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_with_day(ANOMALY_EVENT)).parquet(path)


def history_of_region(history: DataFrame, region: str, at: str) -> DataFrame:
    """A region's history, newest first; `at` is event_timestamp or detected_at."""
    return history.filter(F.col("region_id") == region).orderBy(F.desc(at))


def history_between(history: DataFrame, region: str, start: datetime, end: datetime, at: str) -> DataFrame:
    """A region's history from `start` to `end`, both included.

    The day filter prunes folders; Spark does not infer it from the time filter.
    """
    found = history.filter((F.col("region_id") == region) & F.col(at).between(F.lit(start), F.lit(end)))
    if DAY in history.columns:
        first, last = (t.astimezone(timezone.utc).date() for t in (start, end))
        found = found.filter(F.col(DAY).between(F.lit(first), F.lit(last)))
    return found
