import random

from klaxon.operators.spikes import detect_spikes, sliding_counts, spike_candidates
from tests.plain import counts, spikes


def alerts(spark, rows):
    """rows: (region, ms, id)"""
    return spark.createDataFrame(rows, "region_id string, ms long, event_id string").selectExpr(
        "region_id", "event_id", "timestamp_millis(ms) as event_timestamp"
    )


def random_rows(seed, n=600, span=4000, keys=("a", "b", None)):
    rng = random.Random(seed)
    rows = [(rng.choice(keys), rng.randrange(span), f"e{rng.randrange(400)}") for _ in range(n)]
    return rows + rows[:50]


def found(df):
    return sorted((r.region_id, r.ms, r.event_id, r.n) for r in df.collect())


def test_sliding_counts_equal_loop(spark):
    for seed, window in ((1, 0), (2, 100), (3, 5000)):
        rows = random_rows(seed)
        assert found(sliding_counts(alerts(spark, rows), window)) == counts(rows, window)


def test_oversized_ties_are_split(spark):
    rng = random.Random(9)
    rows = [("hot", 1000, f"id-{rng.randrange(10**9)}") for _ in range(700)] + random_rows(4, 200)
    whole = sliding_counts(alerts(spark, rows), 300)
    split = sliding_counts(alerts(spark, rows), 300, tie_rows=50, tie_shares=10)
    assert found(split) == found(whole) == counts(rows, 300)


def test_window_across_slots(spark):
    hour = 3_600_000
    rows = [("a", i * 600_000, f"e{i:03d}") for i in range(60)] + [("a", 0, "z")]
    for window in (hour, 6 * hour, 30 * hour):
        assert found(sliding_counts(alerts(spark, rows), window)) == counts(rows, window)


def test_spikes_equal_loop(spark):
    for seed, window, threshold, cooldown in ((1, 50, 3, 100), (2, 300, 4, 777), (3, 20, 1, 0), (4, 4000, 30, 10)):
        rows = random_rows(seed)
        got = detect_spikes(alerts(spark, rows), window, threshold, cooldown).selectExpr(
            "region_id", "unix_millis(detected_at) ms", "triggering_event_ids[0] event_id", "event_count n"
        )
        assert found(got) == spikes(rows, window, threshold, cooldown)
        kept = spike_candidates(alerts(spark, rows), window, threshold)
        assert found(kept) == [r for r in counts(rows, window) if r[3] >= threshold]


def test_documented_cases(spark):
    rows = [("KYIV_REGION", 1000 * i, f"e{i}") for i in range(4)]
    out = detect_spikes(alerts(spark, rows)).collect()
    assert len(out) == 1
    (one,) = out
    assert one.event_count == 3 and one.severity == "CRITICAL" and one.triggering_event_ids == ["e2"]
    assert one.description == (
        "Rapid-fire alert spike detected in KYIV_REGION: 3 events within 300 seconds (threshold: 3)"
    )
    assert detect_spikes(alerts(spark, rows[:2])).count() == 0
    assert detect_spikes(alerts(spark, rows), enabled=False).count() == 0
    assert detect_spikes(alerts(spark, rows), threshold=0).count() == 1
