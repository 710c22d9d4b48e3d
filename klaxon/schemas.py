"""Declared schemas.  Nothing in this package infers a schema from data."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


_S, _L, _I, _B, _T = StringType(), LongType(), IntegerType(), BooleanType(), TimestampType()

FEED_ALERT = _struct(
    id=_L,
    location_title=_S,
    location_type=_S,
    started_at=_S,
    finished_at=_S,
    updated_at=_S,
    alert_type=_S,
    location_uid=_S,
)

# One poll of the provider: all ongoing alerts in one JSON object.
SNAPSHOT = _struct(alerts=ArrayType(FEED_ALERT), disclaimer=_S)

# A stored poll: which feed, its place in the feed, and the version header it came with.
STORED_SNAPSHOT = _struct(feed=_S, seq=_L, last_modified=_S, payload=_S)

ALERT_EVENT = _struct(
    event_id=_S,
    region_id=_S,
    event_type=_S,
    status=_S,
    severity=_S,
    event_timestamp=_T,
)

# Field names of an alert inside the JSON log.
ALERT_JSON = _struct(
    eventId=_S,
    regionId=_S,
    eventType=_S,
    status=_S,
    severity=_S,
    timestamp=_T,
)

ANOMALY_JSON = _struct(
    anomalyId=_S,
    regionId=_S,
    anomalyType=_S,
    description=_S,
    eventCount=_I,
    windowDurationSeconds=_L,
    severity=_S,
    detectedAt=_T,
    triggeringEventIds=ArrayType(_S),
)

LOG_RECORD = _struct(topic=_S, partition=_I, offset=_L, key=_S, value=_S)

ALERT_HISTORY = _struct(
    event_id=_S,
    region_id=_S,
    event_type=_S,
    status=_S,
    severity=_S,
    event_timestamp=_T,
    received_at=_T,
    kafka_topic=_S,
    kafka_partition=_I,
    kafka_offset=_L,
)

ANOMALY_EVENT = _struct(
    anomaly_id=_S,
    region_id=_S,
    anomaly_type=_S,
    description=_S,
    event_count=_I,
    window_duration_seconds=_L,
    severity=_S,
    detected_at=_T,
    triggering_event_ids=ArrayType(_S),
)

SUBSCRIPTION = _struct(
    id=_L,
    user_id=_S,
    channel=_S,
    recipient_address=_S,
    region_id=_S,
    min_severity=_S,
    active=_B,
    created_at=_T,
)

# Change log of the subscription table.  CREATE carries no id; it gets one from `seq`.
SUBSCRIPTION_CHANGE = _struct(
    seq=_L,
    op=_S,
    id=_L,
    user_id=_S,
    channel=_S,
    recipient_address=_S,
    region_id=_S,
    min_severity=_S,
    active=_B,
)

CANONICAL_REGION = _struct(region_id=_S, display_name=_S, created_at=_T)

REGION_MAPPING = _struct(id=_L, raw_title=_S, region_id=_S, created_at=_T, updated_at=_T)

UNRECOGNIZED_LOCATION = _struct(
    id=_L, raw_title=_S, occurrences_count=_L, first_seen_at=_T, last_seen_at=_T
)

NOTIFICATION_TASK = _struct(
    task_id=_S,
    event_id=_S,
    user_id=_S,
    channel=_S,
    recipient_address=_S,
    region_id=_S,
    message=_S,
    severity=_S,
    created_at=_T,
)

DELIVERY_ATTEMPT = _struct(task_id=_S, channel=_S, attempt_at=_T, ok=_B)
