"""Every operator over the driver's whole tables: (spark, folder) -> DataFrame.

Times leave as text or epoch ms and arrays as scalars, so results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from klaxon.functions import columns as C
from klaxon.operators import delivery, history, matching, regions, spikes, subscriptions
from klaxon.operators.debounce import debounce
from klaxon.plans import adapter as A
from klaxon.session import compact_results, configure, fresh_path
from klaxon.sources import feeds, logs

HOUR = 3_600_000
MINUTE = 60_000
NTFY_SERVER, NTFY_TOPIC = "https://push.example.org/", "all-alerts"
DISCORD_URL, DISCORD_USER = "https://hooks.example.org/default/channel/one", "alert desk"
SPIKE_CONFIGS = (("5m/3/10m", 5 * MINUTE, 3, 10 * MINUTE), ("6h/6/24h", 6 * HOUR, 6, 24 * HOUR))
BETWEEN = (datetime(2024, 1, 5, tzinfo=timezone.utc), datetime(2024, 1, 12, 12, 30, tzinfo=timezone.utc))
REGION = "NATION_3_REGION"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(configure(spark), folder)

    QUERIES[build.__name__] = run
    return run


def micros(c: str):
    return F.date_format(c, A.INSTANT)


# --- sources and sinks ----------------------------------------------------------------


def _stored_snapshots(spark, folder):
    """Polls of 20 alerts each, as stored JSON."""
    poll = F.floor(F.col("id") / 20).cast("long")
    body = F.struct("id", "location_title", "started_at", "alert_type")
    return (
        A.raw_alerts(spark, folder)
        .groupBy(poll.alias("seq"))
        .agg(F.sort_array(F.collect_list(body)).alias("alerts"), F.max("seen_at").alias("_latest"))
        .select(
            F.concat(F.lit("feed-"), (F.col("seq") % 3).cast("string")).alias("feed"),
            "seq",
            F.when(F.col("seq") % 5 == 0, F.lit(" "))
            .otherwise(F.date_format("_latest", "yyyy-MM-dd HH"))
            .alias("last_modified"),
            F.to_json(F.struct("alerts", F.lit("as is").alias("disclaimer"), F.lit(1).alias("extra"))).alias("payload"),
        )
    )


@query
def snapshot_explode(spark, folder):
    return feeds.decode_snapshots(_stored_snapshots(spark, folder)).select("id", "location_title", "alert_type")


@query
def snapshot_change_filter(spark, folder):
    return feeds.drop_unchanged_snapshots(_stored_snapshots(spark, folder)).select("feed", "seq")


def _encoded(spark, folder):
    return logs.encode_alerts(A.with_lineage(A.alerts(spark, folder)))


@query
def alert_log_encode(spark, folder):
    return _encoded(spark, folder).select("key", "value")


@query
def alert_log_decode(spark, folder):
    path = fresh_path(spark, "alert-log")
    logs.write_log_files(_encoded(spark, folder), path, logs.RAW_ALERTS)
    back = logs.decode_alerts(logs.read_log_files(spark, path))
    return back.select(
        "event_id",
        "region_id",
        "event_type",
        "status",
        "severity",
        micros("event_timestamp").alias("seen_at"),
        "topic",
        F.col("partition").alias("log_partition"),
        F.col("offset").alias("log_offset"),
    )


@query
def malformed_quarantine(spark, folder):
    value = (
        F.when(F.col("offset") % 53 == 0, F.expr("left(value, 40)"))
        .when(F.col("offset") % 59 == 0, F.lit(""))
        .when(F.col("offset") % 61 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("value"))
    )
    log = logs.as_log_records(_encoded(spark, folder), logs.RAW_ALERTS).withColumn("value", value)
    return logs.flag_malformed(log).select(F.col("offset").alias("log_offset"), "is_bad")


@query
def anomaly_log_decode(spark, folder):
    path = fresh_path(spark, "anomaly-log")
    logs.write_log_files(logs.encode_anomalies(_anomalies(spark, folder)), path, logs.ANOMALIES)
    back = logs.decode_anomalies(logs.read_log_files(spark, path))
    return back.select(
        "anomaly_id",
        "region_id",
        "description",
        "event_count",
        micros("detected_at").alias("detected_at"),
        F.element_at("triggering_event_ids", 1).alias("event_id"),
    )


@query
def ingest_defaults(spark, folder):
    number = A.number_of()
    pushed = A.alerts(spark, folder).select(
        F.when(number % 10 != 0, F.col("event_id")).alias("event_id"),
        "region_id",
        "event_type",
        F.when(number % 4 != 0, F.lit("ENDED")).alias("status"),
        F.when(number % 3 != 0, F.col("severity")).alias("severity"),
        F.when(number % 7 != 0, F.col("event_timestamp")).alias("event_timestamp"),
    )
    filled = feeds.with_ingest_defaults(pushed, A.as_of())
    return filled.select(
        "event_id", "region_id", "event_type", "status", "severity", micros("event_timestamp").alias("seen_at")
    )


@query
def merge_feeds(spark, folder):
    alerts = A.alerts(spark, folder)
    polled = debounce(alerts.filter(A.number_of() % 2 == 0), 12 * HOUR)
    pushed = alerts.filter(A.number_of() % 2 == 1)
    both = feeds.merge_feeds(
        polled.withColumn("feed", F.lit("polled")), pushed.withColumn("feed", F.lit("pushed"))
    )
    return both.select("event_id", "feed")


@query
def snapshot_to_events(spark, folder):
    return A.alerts(spark, folder).select(
        "event_id", "region_id", "event_type", "status", "severity", micros("event_timestamp").alias("seen_at")
    )


# --- scalars --------------------------------------------------------------------------


@query
def event_type_norm(spark, folder):
    return A.raw_alerts(spark, folder).select("id", C.event_type("alert_type").alias("event_type"))


@query
def severity_rollup(spark, folder):
    kinds = A.raw_alerts(spark, folder).select(C.event_type("alert_type").alias("event_type"))
    return kinds.groupBy("event_type", C.severity_of_type("event_type").alias("severity")).agg(
        F.count("*").alias("alerts")
    )


@query
def severity_weight(spark, folder):
    mixed = F.when(F.col("id") % 3 == 0, F.lower("min_severity")).otherwise(F.col("min_severity"))
    return A.subscriptions(spark, folder).select("id", C.severity_weight(mixed).alias("weight"))


@query
def region_slug(spark, folder):
    c = A.table(spark, folder, "customer")
    title = F.concat(F.lit(" смт. "), "c_name", F.lit(" ("), F.lower("c_mktsegment"), F.lit(") область!"))
    title = (
        F.when(F.col("c_custkey") % 10 == 0, F.lit("!!!"))
        .when(F.col("c_custkey") % 10 == 1, F.concat("c_name", F.lit(" region\t")))
        .otherwise(title)
    )
    return c.select("c_custkey", C.region_slug(title).alias("region_id"))


@query
def ntfy_priority(spark, folder):
    severity = (
        F.when(A.number_of() % 5 == 0, F.lit("low"))
        .when(A.number_of() % 5 == 1, F.lit("High"))
        .when(A.number_of() % 5 == 2, F.lit(None).cast("string"))
        .otherwise(F.col("severity"))
    )
    return A.alerts(spark, folder).select("event_id", C.ntfy_priority(severity).alias("priority"))


@query
def mask_recipient(spark, folder):
    address = F.concat(
        F.lit("https://hooks.example.org/"), "recipient_address", F.lit("/"), F.col("id").cast("string")
    )
    address = F.when(F.col("id") % 9 != 0, address)
    return A.subscriptions(spark, folder).select("id", C.masked(address).alias("shown"))


@query
def parse_started_at(spark, folder):
    started = (
        F.when(F.col("id") % 5 == 0, F.expr("left(started_at, 10)"))
        .when(F.col("id") % 5 == 1, F.lit(" "))
        .when(F.col("id") % 5 == 2, F.concat(F.expr("left(started_at, 19)"), F.lit("+02:00")))
        .when(F.col("id") % 35 == 3, F.lit(None).cast("string"))
        .when(F.col("id") % 35 == 4, F.lit("2024-13-41T25:00:00Z"))
        .otherwise(F.col("started_at"))
    )
    parsed = A.raw_alerts(spark, folder).withColumn("at", C.parse_instant(started, A.as_of()))
    return parsed.select("id", micros("at").alias("started_at"))


# --- joins, windows, gates ------------------------------------------------------------


@query
def normalize_regions(spark, folder):
    raw = A.raw_alerts(spark, folder)
    return regions.normalize_regions(raw, A.mappings(spark, folder), "location_title").select("id", "region_id")


def _tasks(spark, folder, as_of=None):
    compact_results(spark)
    return matching.match_alerts(
        A.alerts(spark, folder), A.subscriptions(spark, folder), A.as_of() if as_of is None else as_of
    )


@query
def match_alerts(spark, folder):
    return _tasks(spark, folder).select("task_id", "event_id", "subscription_id", "channel", "message", "severity")


@query
def sliding_counts(spark, folder):
    return spikes.sliding_counts(A.alerts(spark, folder), 6 * HOUR).select("event_id", "n")


@query
def spike_candidates(spark, folder):
    return spikes.spike_candidates(A.alerts(spark, folder), 6 * HOUR, 6).select("event_id", "n")


def _anomalies(spark, folder, config=SPIKE_CONFIGS[1]):
    _, window, threshold, cooldown = config
    return spikes.detect_spikes(A.alerts(spark, folder), window, threshold, cooldown)


@query
def detect_spikes(spark, folder):
    found = None
    for config in SPIKE_CONFIGS:
        one = _anomalies(spark, folder, config).withColumn("config", F.lit(config[0]))
        found = one if found is None else found.unionByName(one)
    return found.select(
        "config",
        "region_id",
        F.element_at("triggering_event_ids", 1).alias("event_id"),
        F.col("event_count").alias("n"),
        "description",
    )


@query
def debounce_alerts(spark, folder):
    alerts = A.alerts(spark, folder)
    hour = debounce(alerts, HOUR).select(F.lit("1h").alias("ttl"), "event_id")
    return hour.unionByName(debounce(alerts, 12 * HOUR).select(F.lit("12h").alias("ttl"), "event_id"))


@query
def debounce_with_clear(spark, folder):
    alerts = A.alerts(spark, folder)
    ends = A.number_of() % 11 == 0
    return debounce(alerts.filter(~ends), 12 * HOUR, ended=alerts.filter(ends)).select("event_id")


@query
def match_anomalies(spark, folder):
    tasks = matching.match_anomalies(_anomalies(spark, folder), A.subscriptions(spark, folder), A.as_of())
    return tasks.select(F.col("event_id").alias("anomaly_id"), "subscription_id", "message")


@query
def orphan_subscriptions(spark, folder):
    subs = A.subscriptions(spark, folder)
    shifted = subs.withColumn(
        "region_id", F.when(F.col("id") % 6 == 0, F.lower("region_id")).otherwise(F.col("region_id"))
    )
    return matching.orphan_subscriptions(shifted, A.regions(spark, folder)).select("id", "region_id")


# --- delivery -------------------------------------------------------------------------


def _varied_tasks(spark, folder):
    """Tasks with a few null channels and blank or full-URL addresses."""
    n = F.col("subscription_id")
    address = (
        F.when(n % 8 == 0, F.lit(" "))
        .when(n % 8 == 1, F.concat(F.lit("https://push.example.net/"), F.col("recipient_address")))
        .when(n % 8 == 2, F.concat(F.lit("/"), F.col("recipient_address")))
        .otherwise(F.col("recipient_address"))
    )
    return (
        _tasks(spark, folder)
        .withColumn("recipient_address", address)
        .withColumn("channel", F.when(n % 17 != 0, F.col("channel")))
    )


@query
def route_tasks(spark, folder):
    routed = delivery.with_routing_key(_varied_tasks(spark, folder))
    return routed.select("task_id", F.coalesce("routing_key", F.lit("REJECTED")).alias("routing_key"))


@query
def render_discord(spark, folder):
    tasks = _varied_tasks(spark, folder).filter("channel = 'DISCORD'")
    return delivery.render_discord(tasks, DISCORD_URL, DISCORD_USER).select("task_id", "target", "payload")


@query
def render_ntfy(spark, folder):
    tasks = _varied_tasks(spark, folder).filter("channel = 'NTFY'")
    return delivery.render_ntfy(tasks, NTFY_SERVER, NTFY_TOPIC).select(
        "task_id", "target", "title", "priority", "payload"
    )


@query
def outbox_dry_run(spark, folder):
    path = fresh_path(spark, "outbox")
    rows = delivery.outbox(_varied_tasks(spark, folder), NTFY_SERVER, NTFY_TOPIC, None, DISCORD_USER)
    delivery.write_outbox(rows, path)
    return spark.read.parquet(path).select("task_id", "channel", "shown_target", "priority", "status")


@query
def dedup_tasks(spark, folder):
    again = F.explode(F.array(*[F.expr(f"interval {m} minutes") for m in (0, 5, 15, 20)]))
    copies = (
        _tasks(spark, folder, F.col("event_timestamp"))
        .select("task_id", "created_at", again.alias("later"))
        .select("task_id", (F.col("created_at") + F.col("later")).alias("created_at"))
    )
    return delivery.dedup_tasks(copies).select("task_id", F.unix_millis("created_at").alias("ms"))


def _attempts(spark, folder):
    o = A.table(spark, folder, "orders")
    tries = F.explode(F.sequence(F.lit(1), (F.col("o_orderkey") % 4 + 1).cast("int"))).alias("nth")
    return o.select("o_orderkey", "o_orderdate", tries).select(
        F.concat(F.lit("task-"), F.col("o_orderkey").cast("string")).alias("task_id"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("DISCORD")).otherwise(F.lit("NTFY")).alias("channel"),
        (F.col("o_orderdate").cast("timestamp") + F.make_interval(secs=F.col("nth") * F.lit(1.5))).alias("attempt_at"),
        ((F.col("o_orderkey") + F.col("nth")) % 5 == 0).alias("ok"),
    )


@query
def resolve_attempts(spark, folder):
    return delivery.resolve_attempts(_attempts(spark, folder)).select(
        "task_id", "attempts", "state", micros("next_at").alias("next_at"), "dead_letter"
    )


@query
def drop_delivered(spark, folder):
    attempts = _attempts(spark, folder)
    tasks = attempts.groupBy("task_id").agg(F.count("*").alias("attempts"))
    return delivery.drop_delivered(tasks, attempts).select("task_id", "attempts")


# --- discovery and region maintenance -------------------------------------------------


def _unrecognized(spark, folder, when=None):
    raw = A.raw_alerts(spark, folder)
    raw = raw if when is None else raw.filter(when)
    return regions.discover_unrecognized(raw, A.mappings(spark, folder), "location_title", "seen_at")


def _shown(unrecognized):
    return unrecognized.select(
        "raw_title",
        "occurrences_count",
        micros("first_seen_at").alias("first_seen"),
        micros("last_seen_at").alias("last_seen"),
    )


@query
def discover_unrecognized(spark, folder):
    return _shown(_unrecognized(spark, folder))


@query
def merge_unrecognized(spark, folder):
    middle = F.lit("2024-01-15").cast("timestamp")
    stored = _unrecognized(spark, folder, F.col("seen_at") < middle)
    fresh = _unrecognized(spark, folder, F.col("seen_at") >= middle)
    return _shown(regions.merge_unrecognized(stored, fresh))


@query
def review_queue(spark, folder):
    return _shown(regions.review_queue(_unrecognized(spark, folder)))


@query
def purge_mapped_titles(spark, folder):
    mapped = A.mapping_requests(spark, folder)
    return regions.purge_mapped_titles(_unrecognized(spark, folder), mapped).select("raw_title", "occurrences_count")


@query
def validate_regions(spark, folder):
    return regions.validate_regions(A.region_requests(spark, folder)).select(
        "seq", F.coalesce("reason", F.lit("")).alias("reason")
    )


def _tagged(df, status, subject, detail):
    return df.select(
        F.lit(status).alias("status"), F.col(subject).alias("subject"), detail.cast("string").alias("detail")
    )


@query
def add_regions(spark, folder):
    change = regions.add_regions(A.regions(spark, folder), A.region_requests(spark, folder), A.as_of())
    return _tagged(change.regions, "table", "region_id", F.col("display_name")).unionByName(
        _tagged(change.rejected, "rejected", "region_id", F.concat_ws(" ", "seq", "reason"))
    )


def _mapping_rows(change):
    return (
        _tagged(change.mappings, "table", "raw_title", F.col("region_id"))
        .unionByName(_tagged(change.unrecognized, "unrecognized", "raw_title", F.col("occurrences_count")))
        .unionByName(_tagged(change.rejected, "rejected", "raw_title", F.concat_ws(" ", "seq", "reason")))
    )


@query
def add_mappings(spark, folder):
    return _mapping_rows(
        regions.add_mappings(
            A.mappings(spark, folder),
            A.regions(spark, folder),
            _unrecognized(spark, folder),
            A.mapping_requests(spark, folder),
            A.as_of(),
        )
    )


@query
def assign_unrecognized(spark, folder):
    c = A.table(spark, folder, "customer")
    title = F.concat(F.lit("Nation_"), (F.col("c_custkey") % 35).cast("string"))
    region = F.concat(F.lit("nation_"), (F.col("c_custkey") % 30).cast("string"), F.lit("_region"))
    wanted = c.select(
        F.col("c_custkey").alias("seq"), C.content_key(title).alias("id"), region.alias("region_id")
    )
    change = regions.assign_unrecognized(
        A.mappings(spark, folder), A.regions(spark, folder), _unrecognized(spark, folder), wanted, A.as_of()
    )
    return _mapping_rows(change)


def _customer_mappings(spark, folder):
    c = A.table(spark, folder, "customer")
    number = F.col("c_nationkey") + F.col("c_custkey") % 3
    return c.select(
        F.col("c_custkey").alias("id"),
        F.concat("c_mktsegment", (F.col("c_custkey") % 500).cast("string")).alias("raw_title"),
        F.concat(F.lit("NATION_"), number.cast("string"), F.lit("_REGION")).alias("region_id"),
    )


@query
def mapping_fk_check(spark, folder):
    valid, orphans = regions.mapping_fk_check(_customer_mappings(spark, folder), A.regions(spark, folder))
    return valid.select("id", F.lit(True).alias("valid")).unionByName(
        orphans.select("id", F.lit(False).alias("valid"))
    )


@query
def cascade_mappings(spark, folder):
    remaining = A.regions(spark, folder).filter("region_id not in ('NATION_3_REGION', 'NATION_11_REGION')")
    return regions.cascade_mappings(_customer_mappings(spark, folder), remaining).select("id", "region_id")


@query
def load_seed_check(spark, folder):
    seed = A.regions(spark, folder).unionByName(
        A.region_requests(spark, folder).select("region_id", "display_name", A.as_of().alias("created_at"))
    )
    return regions.check_seed(seed, _customer_mappings(spark, folder))


@query
def delete_mappings(spark, folder):
    ids = A.table(spark, folder, "orders").select((F.col("o_custkey") * 3).alias("id"))
    left, missing = regions.delete_mappings(_customer_mappings(spark, folder), ids)
    return left.select(F.lit("table").alias("status"), "id").unionByName(
        missing.select(F.lit("not found").alias("status"), "id")
    )


@query
def list_regions(spark, folder):
    wanted = A.region_requests(spark, folder)
    return regions.list_regions(wanted.withColumn("created_at", A.as_of())).select("region_id", "display_name")


@query
def list_mappings(spark, folder):
    rows = _customer_mappings(spark, folder).select("*", A.as_of().alias("created_at"), A.as_of().alias("updated_at"))
    return regions.list_mappings(rows).select("id", "raw_title", "region_id")


# --- subscriptions --------------------------------------------------------------------


def _rows(subs):
    return subs.select("id", "user_id", "channel", "recipient_address", "region_id", "min_severity", "active")


def _changed(spark, folder, *ops):
    log = A.change_log(spark, folder)
    log = log.filter(F.col("op").isin(*ops)) if ops else log
    return subscriptions.apply_subscription_changes(A.subscriptions(spark, folder), log, A.as_of())


@query
def subs_create(spark, folder):
    return _rows(_changed(spark, folder, "CREATE").subscriptions)


@query
def subs_update(spark, folder):
    return _rows(_changed(spark, folder, "UPDATE").subscriptions)


@query
def subs_delete(spark, folder):
    return _rows(_changed(spark, folder, "DELETE").subscriptions)


@query
def subs_changes(spark, folder):
    return _rows(_changed(spark, folder).subscriptions)


@query
def subs_rejected(spark, folder):
    return _changed(spark, folder).rejected.select("seq", "op", "reason")


def _recipients(spark, folder):
    s = A.table(spark, folder, "supplier")
    return s.select(
        F.concat(F.lit("topic-"), F.col("s_nationkey").cast("string")).alias("recipient_address"),
        F.when(F.col("s_suppkey") % 2 == 0, F.lit("DISCORD")).otherwise(F.lit("NTFY")).alias("channel"),
    )


@query
def deactivate_recipients(spark, folder):
    subs = A.subscriptions(spark, folder)
    return subscriptions.deactivate_recipients(subs, _recipients(spark, folder)).select("id", "active")


@query
def deactivated_regions(spark, folder):
    return subscriptions.deactivated_regions(A.subscriptions(spark, folder), _recipients(spark, folder))


@query
def find_subscriptions(spark, folder):
    subs = A.subscriptions(spark, folder)
    user, region = "Customer#000000007", "NATION_3_REGION"
    searches = {
        "user": dict(user=user),
        "user and active": dict(user=user, active=True),
        "region": dict(region=region),
        "region and inactive": dict(region=region, active=False),
        "region in lower case": dict(region=region.lower()),
        "inactive": dict(user=" ", active=False),
        "all": dict(),
    }
    found = None
    for name, criteria in searches.items():
        one = subscriptions.find_subscriptions(subs, **criteria).select(F.lit(name).alias("search"), "id")
        found = one if found is None else found.unionByName(one)
    return found


@query
def find_by_recipient(spark, folder):
    subs = A.subscriptions(spark, folder)
    every = subscriptions.find_by_recipient(subs, "topic-7", "NTFY")
    on = subscriptions.find_by_recipient(subs, "topic-7", "NTFY", active=True)
    return every.select(F.lit("every").alias("search"), "id").unionByName(
        on.select(F.lit("active").alias("search"), "id")
    )


@query
def find_by_user_region_channel(spark, folder):
    c = A.subscriptions(spark, folder)
    found = subscriptions.find_by_user_region_channel(c, "Customer#000000001", "NATION_19_REGION", "NTFY")
    return found.select("id", "user_id", "region_id", "channel")


@query
def get_subscription(spark, folder):
    return _rows(subscriptions.get_by_id(A.subscriptions(spark, folder), 42))


# --- history --------------------------------------------------------------------------


def _alert_history(spark, folder):
    path = fresh_path(spark, "alert-history")
    history.archive_alerts(A.with_lineage(A.alerts(spark, folder)), path, A.as_of())
    return history.read_alert_history(spark, path)


def _alert_rows(rows):
    return rows.select(
        "event_id",
        "region_id",
        "severity",
        micros("event_timestamp").alias("event_time"),
        "kafka_partition",
        "kafka_offset",
        F.col(history.DAY).cast("string").alias("event_date"),
    )


@query
def archive_alerts(spark, folder):
    return _alert_rows(_alert_history(spark, folder))


@query
def archive_quarantine(spark, folder):
    alerts = A.with_lineage(A.alerts(spark, folder))
    torn = alerts.withColumn("severity", F.when(F.col("offset") % 13 != 0, F.col("severity")))
    path = fresh_path(spark, "alert-history")
    return history.archive_alerts(torn, path, A.as_of()).select("event_id", "region_id")


@query
def alert_history_desc(spark, folder):
    return _alert_rows(history.history_of_region(_alert_history(spark, folder), REGION, "event_timestamp"))


@query
def alert_history_between(spark, folder):
    found = history.history_between(_alert_history(spark, folder), REGION, *BETWEEN, "event_timestamp")
    return _alert_rows(found)


def _anomaly_history(spark, folder):
    path = fresh_path(spark, "anomaly-history")
    history.archive_anomalies(_anomalies(spark, folder), path)
    return history.read_anomaly_history(spark, path)


def _anomaly_rows(rows):
    return rows.select(
        "anomaly_id",
        "region_id",
        "anomaly_type",
        "event_count",
        "window_duration_seconds",
        "severity",
        micros("detected_at").alias("detected"),
        F.element_at("triggering_event_ids", 1).alias("event_id"),
    )


@query
def archive_anomalies(spark, folder):
    return _anomaly_rows(_anomaly_history(spark, folder))


@query
def anomaly_history_desc(spark, folder):
    return _anomaly_rows(history.history_of_region(_anomaly_history(spark, folder), REGION, "detected_at"))


@query
def anomaly_history_between(spark, folder):
    return _anomaly_rows(
        history.history_between(_anomaly_history(spark, folder), REGION, *BETWEEN, "detected_at")
    )
