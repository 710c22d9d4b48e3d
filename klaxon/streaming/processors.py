"""Keyed state for streams: the TTL gate and the spike detector.

Both run on event time.  Rows of one micro-batch are taken in time order; a row that comes
in a later micro-batch than a newer row of its key is judged when it arrives.  State is
freed by timers once the watermark is past the point where it could matter.

Before the shuffle to the keys, each map task folds its rows: the gate keeps one row per
(key, ms), the detector a count and the few smallest ids per (region, ms).  A hot key thus
costs its distinct milliseconds, not its rows.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from klaxon.operators.gate import _Groups

_LONGS = ArrayType(LongType())


def first_per_instant(batches: Iterator[pa.RecordBatch], keys: list[str], at: str, ties: list[str]):
    """Keep one row per (keys, at), the first by `ties`."""
    for batch in batches:
        if batch.num_rows:
            ordered = _sorted(batch, [*keys, at, *ties])
            yield ordered.take(pa.array(_Groups(ordered, [*keys, at]).begin))


def counted_per_instant(batches: Iterator[pa.RecordBatch], keep: int):
    """(region_id, ms) with the number of rows and the `keep` smallest ids."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ordered = _sorted(batch, ["region_id", "ms", "event_id"])
        groups = _Groups(ordered, ["region_id", "ms"])
        ids = ordered.column("event_id")
        smallest = [ids.slice(b, min(e - b, keep)).to_pylist() for b, e in zip(groups.begin, groups.end)]
        heads = ordered.select(["region_id", "ms"]).take(pa.array(groups.begin))
        yield pa.RecordBatch.from_arrays(
            [*heads.columns, pa.array(groups.end - groups.begin, pa.int64()), pa.array(smallest, pa.list_(pa.string()))],
            names=["region_id", "ms", "rows", "ids"],
        )


def _sorted(batch: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    return batch.take(pc.sort_indices(batch, sort_keys=[(n, "ascending") for n in names]))


class GateProcessor(StatefulProcessor):
    """First row of a key passes; the key is free again `hold_ms` after it.

    Emits the rows that pass, and rows older than the watermark with `late` set: the lock
    they would have met may be gone, so they are neither passed nor lost.
    """

    def __init__(self, at: str, ties: list[str], hold_ms: int):
        self.at, self.ties, self.hold = at, ties, hold_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.lock = handle.getValueState("lock", StructType([StructField("free_at", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        free_at = self.lock.get()[0] if self.lock.exists() else None
        before, out = free_at, []
        for row in sorted(rows, key=lambda r: (r[self.at], *(r[t] for t in self.ties))):
            late = row[self.at] < watermark
            if late or free_at is None or row[self.at] >= free_at:
                out.append(Row(**row.asDict(), late=late))
                free_at = free_at if late else row[self.at] + self.hold
        if free_at != before:
            self.lock.update((free_at,))
            self.handle.registerTimer(free_at)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.lock.exists() and self.lock.get()[0] <= timerValues.getCurrentWatermarkInMs():
            self.lock.clear()
        return iter(())

    def close(self) -> None:
        pass


class SpikeProcessor(StatefulProcessor):
    """Sliding count per region and a cooldown, on rows of `counted_per_instant`."""

    def __init__(self, window_ms: int, threshold: int, cooldown_ms: int, delay_ms: int):
        self.window, self.threshold, self.cooldown, self.delay = window_ms, threshold, cooldown_ms, delay_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", StructType([StructField("ms", _LONGS), StructField("rows", _LONGS)]))
        self.fired = handle.getValueState("fired", StructType([StructField("ms", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        times, counts = (list(v) for v in self.live.get()) if self.live.exists() else ([], [])
        last = self.fired.get()[0] if self.fired.exists() else None
        fresh: dict[int, tuple[int, list[str]]] = {}
        for row in rows:
            n, ids = fresh.get(row.ms, (0, []))
            fresh[row.ms] = (n + row.rows, sorted([*ids, *row.ids])[: self.threshold])

        # Running totals of what is stored; arrivals of this batch are added as they pass.
        stored = [0, *itertools.accumulate(counts)]
        arrived_ms: list[int] = []
        arrived = [0]
        found = []
        for ms in sorted(fresh):
            n, ids = fresh[ms]
            before = (
                stored[bisect_right(times, ms)]
                - stored[bisect_left(times, ms - self.window)]
                + arrived[-1]
                - arrived[bisect_left(arrived_ms, ms - self.window)]
            )
            arrived_ms.append(ms)
            arrived.append(arrived[-1] + n)
            nth = max(1, self.threshold - before)
            if n >= nth and (last is None or ms > last + self.cooldown):
                last = ms
                found.append(Row(region_id=key[0], ms=ms, event_id=ids[nth - 1], n=before + nth))

        merged = dict(zip(times, counts))
        for ms, (n, _) in fresh.items():
            merged[ms] = merged.get(ms, 0) + n
        newest = max(merged)
        kept = sorted(ms for ms in merged if ms >= newest - self.window - self.delay)
        self.live.update((kept, [merged[ms] for ms in kept]))
        if found:
            self.fired.update((last,))
            self.handle.registerTimer(last + self.cooldown + 1)
        self.handle.registerTimer(newest + self.window + self.delay + 1)
        return iter(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        if self.live.exists() and self.live.get()[0][-1] + self.window < now:
            self.live.clear()
        if self.fired.exists() and self.fired.get()[0] + self.cooldown < now:
            self.fired.clear()
        return iter(())

    def close(self) -> None:
        pass
