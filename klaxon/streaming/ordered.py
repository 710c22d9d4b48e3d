"""Streams judged in event-time order: rows wait in time slots until the watermark has passed them.

The operators of `stateful.py` judge a row when it arrives.  Those here hold it in keyed state, in
slots of event time, and release a slot when the watermark reaches its end: what comes out is what
the batch operators give, however a feed is shuffled within the watermark, one slot and the delay
later.  A row for a slot that has been released is *late*: it is emitted with `late` set, neither
judged nor lost.

State is written slot by slot, never as a whole, and handled as Arrow or numpy arrays.  Before the
shuffle to the keys each map task folds its rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType, TimestampType

from klaxon.operators import spikes
from klaxon.operators.debounce import DEBOUNCE_TTL_MS, KEYS
from klaxon.streaming.processors import first_per_instant
from klaxon.streaming.stateful import DELAY_MS

SLOT_MS = 60_000
# Poll numbers per entry of state where polls wait.
POLLS_PER_BLOCK = 128


def pack(frame: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(parts: Sequence[bytes]) -> pd.DataFrame:
    tables = [pa.ipc.open_stream(part).read_all() for part in parts]
    return pa.concat_tables(tables, promote_options="default").to_pandas()


def slot_of(ms: pd.Series, width: int) -> pd.Series:
    return ms - ms % width


# -- the gate --------------------------------------------------------------------------------


def passing(ms: np.ndarray, marks: np.ndarray, hold: int, last: int | None, free: int):
    """(places of the rows that pass, last pass, when its lock ends).

    ms: distinct instants in order; marks: instants in order that free the key, before its rows
    of that instant.  `last` is the last pass before these (None: never), its lock ends at `free`.
    """
    found, i = [], 0
    while i < len(ms):
        if last is not None:
            k = np.searchsorted(marks, last, "right")
            free = min(free, int(marks[k])) if k < len(marks) else free
            i = max(i, int(np.searchsorted(ms, free)))
            if i >= len(ms):
                break
        found.append(i)
        last, free = int(ms[i]), int(ms[i]) + hold
        i += 1
    if last is not None:
        k = np.searchsorted(marks, last, "right")
        free = min(free, int(marks[k])) if k < len(marks) else free
    return found, last, free


class OrderedGate(StatefulProcessor):
    """The TTL gate of one key over rows and end markers (`ended`), slot by slot."""

    def __init__(self, at: str, ties: list[str], hold_ms: int, slot_ms: int, columns: list[str]):
        self.at, self.ties, self.hold, self.width, self.columns = at, ties, hold_ms, slot_ms, columns

    def init(self, handle) -> None:
        self.handle = handle
        self.lock = handle.getValueState("lock", "last long, free_at long")
        self.slots = handle.getMapState("slots", "slot long", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        frame = pd.concat(list(rows), ignore_index=True)
        slot = slot_of(frame[self.at], self.width)
        late = slot + self.width <= now
        if late.any():
            yield frame[late].assign(late=True)[self.columns]
        for start, part in frame[~late].groupby(slot[~late]):
            start = int(start)
            if self.slots.containsKey((start,)):
                part = pd.concat([unpack([self.slots.getValue((start,))[0]]), part], ignore_index=True)
                # One row of each instant is enough: the first by the ties.
                part = part.sort_values([self.at, "ended", *self.ties]).drop_duplicates([self.at, "ended"])
            else:
                self.handle.registerTimer(start + self.width)
            self.slots.updateValue((start,), (pack(part),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        starts = sorted(s for (s,) in self.slots.keys())
        due = [s for s in starts if s + self.width <= now]
        last, free = self.lock.get() if self.lock.exists() else (None, 0)
        if due:
            frame = unpack([self.slots.getValue((s,))[0] for s in due])
            frame = frame.sort_values([self.at, *self.ties]).drop_duplicates([self.at, "ended"])
            mark = frame["ended"].to_numpy(bool)
            alerts = frame[~mark]
            ms, marks = alerts[self.at].to_numpy(np.int64), frame[self.at].to_numpy(np.int64)[mark]
            found, last, free = passing(ms, marks, self.hold, last, free)
            for s in due:
                self.slots.removeKey((s,))
            if last is not None:
                self.lock.update((last, free))
                self.handle.registerTimer(max(free, now + 1))
            if found:
                yield alerts.iloc[found].assign(late=False)[self.columns]
        elif last is not None and free <= now and not starts:
            self.lock.clear()

    def close(self) -> None:
        pass


def ordered_gate_stream(
    rows: DataFrame,
    keys: Sequence[str],
    time: str,
    ttl_ms: int,
    ties: Sequence[str] = (),
    inclusive: bool = True,
    ended: DataFrame | None = None,
    delay_ms: int = DELAY_MS,
    slot_ms: int = SLOT_MS,
) -> DataFrame:
    """Streaming ``ttl_gate`` in order of event time, with `late` and `ended`.

    `ended` (keys, `time`) is a second stream: from such an instant on the key is free again,
    before the rows of that instant.  Late rows of both come out; `ended` tells the markers.
    The column names ended, late and at_ms are taken.
    """
    keys, ties = list(keys), list(ties)
    marked = rows.withColumn("ended", F.lit(False))
    if ended is not None:
        marks = ended.select(*keys, time).withColumn("ended", F.lit(True))
        marked = marked.unionByName(marks, allowMissingColumns=True)
    for name in [*keys, time]:
        marked = marked.filter(F.col(name).isNotNull())
    timed = marked.withColumn("at_ms", F.unix_millis(time))
    # The fold comes after the watermark and leaves its mark off the column: late rows reach the state.
    thin = timed.withWatermark(time, f"{delay_ms} milliseconds").mapInArrow(lambda b: first_per_instant(b, [*keys, "ended"], "at_ms", ties), timed.schema)
    shape = StructType([*timed.schema.fields, StructField("late", BooleanType())])
    gate = OrderedGate("at_ms", ties, ttl_ms if inclusive else ttl_ms + 1, slot_ms, shape.names)
    judged = thin.groupBy(*keys).transformWithStateInPandas(gate, shape, "Append", "EventTime")
    return judged.drop("at_ms")


def ordered_debounce_stream(
    alerts: DataFrame,
    ttl_ms: int = DEBOUNCE_TTL_MS,
    ended: DataFrame | None = None,
    delay_ms: int = DELAY_MS,
    slot_ms: int = SLOT_MS,
) -> DataFrame:
    """Streaming ``debounce`` with its end markers: alerts to publish and late rows, by `late` and `ended`."""
    return ordered_gate_stream(
        alerts, KEYS, "event_timestamp", ttl_ms, ["event_id"], ended=ended, delay_ms=delay_ms, slot_ms=slot_ms
    )


# -- snapshots -------------------------------------------------------------------------------


class ChangedPolls(StatefulProcessor):
    """Polls of one feed in the order of their numbers; drops one whose version is the last known.

    A poll goes on at once if it is the successor of the last one.  Else it waits: for its
    predecessor, or until the watermark has passed it.  Those that wait lie in state as blocks of
    POLLS_PER_BLOCK numbers; one that goes on at once is never written there.
    """

    def __init__(self, seq: str, version: str, columns: list[str]):
        self.seq, self.version, self.columns = seq, version, columns

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seq long, version string")
        # Numbers and times apart from the polls: what goes on is found without reading those.
        self.places = handle.getMapState("places", "block long", "seqs binary, at_ms binary")
        self.polls = handle.getMapState("polls", "block long", "polls binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        done = self.last.get()[0] if self.last.exists() else None
        late = frame[self.seq] <= done if done is not None else pd.Series(False, frame.index)
        if late.any():
            yield frame[late].assign(late=True)[self.columns]
        yield from self.released(frame[~late], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.released(None, timerValues.getCurrentWatermarkInMs())

    def released(self, fresh: pd.DataFrame | None, now: int) -> Iterator[pd.DataFrame]:
        held = {int(b): [np.frombuffer(v, np.int64) for v in value] for (b,), value in self.places.iterator()}
        parts = {}
        if fresh is not None and len(fresh):
            parts = {int(b): part for b, part in fresh.groupby(fresh[self.seq] // POLLS_PER_BLOCK)}
            seqs, at = fresh[self.seq].to_numpy(np.int64), fresh["at_ms"].to_numpy(np.int64)
        else:
            seqs = at = np.empty(0, np.int64)
        seqs = np.concatenate([*(h[0] for h in held.values()), seqs])
        at = np.concatenate([*(h[1] for h in held.values()), at])
        if not len(seqs):
            return
        last, known = self.last.get() if self.last.exists() else (None, None)
        seqs, at = newest(seqs, at)
        many = going_on(seqs, at, last, now)
        upto = int(seqs[many - 1]) if many else None
        for block in sorted({*held, *parts}):
            part = parts.get(block)
            if block in held:
                if part is None and (upto is None or held[block][0][0] > upto):
                    continue
                before = unpack([self.polls.getValue((block,))[0]])
                part = before if part is None else pd.concat([before, part], ignore_index=True)
            goes = part[self.seq] <= upto if upto is not None else pd.Series(False, part.index)
            self.hold(block, part[~goes], block in held)
            if goes.any():
                kept, known = changed(part[goes], self.seq, self.version, known)
                if len(kept):
                    yield kept.assign(late=False)[self.columns]
        if many:
            self.last.update((upto, known))
        if many < len(seqs):
            # The next poll that the watermark passes takes all before it along and sets the next timer.
            self.handle.registerTimer(max(int(at[many:].min()), now) + 1)

    def hold(self, block: int, part: pd.DataFrame, was_there: bool) -> None:
        if len(part):
            seqs, at = newest(part[self.seq].to_numpy(np.int64), part["at_ms"].to_numpy(np.int64))
            self.places.updateValue((block,), (seqs.tobytes(), at.tobytes()))
            self.polls.updateValue((block,), (pack(part),))
        elif was_there:
            self.places.removeKey((block,))
            self.polls.removeKey((block,))

    def close(self) -> None:
        pass


def newest(seqs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order, each with its greatest time."""
    order = np.lexsort((at, seqs))
    seqs, at = seqs[order], at[order]
    final = np.append(seqs[1:] != seqs[:-1], True)
    return seqs[final], at[final]


def going_on(seqs: np.ndarray, at: np.ndarray, last: int | None, now: int) -> int:
    """How many of the waiting polls go on: all up to the newest that the watermark has passed, gaps
    or not, and from there (or from the last one) on as long as the numbers are consecutive."""
    passed = np.flatnonzero(at < now)
    many = int(passed[-1]) + 1 if len(passed) else 0
    before = int(seqs[many - 1]) if many else last
    if before is None:
        return many
    gaps = np.flatnonzero(np.diff(np.concatenate([[before], seqs[many:]])) != 1)
    return many + (int(gaps[0]) if len(gaps) else len(seqs) - many)


def changed(polls: pd.DataFrame, seq: str, version: str, known: str | None) -> tuple[pd.DataFrame, str | None]:
    """(polls that are blank or unlike the last known version before their number, the last known version)."""
    polls = polls.sort_values(seq, kind="stable")
    given = polls[version].astype(object)
    blank = given.isna() | (given.fillna("").str.strip() == "")
    # What each number leaves known, its largest version, null where all are blank; before the first there is `known`.
    marked = pd.DataFrame({"seq": polls[seq], "version": given.where(~blank, "")})
    left = marked.sort_values(["seq", "version"]).drop_duplicates("seq", keep="last").set_index("seq")["version"]
    left = left.where(left != "", None)
    after = pd.Series([known, *left], dtype=object).ffill()
    before = pd.Series(after.to_numpy()[:-1], index=left.index).reindex(polls[seq]).to_numpy()
    kept = blank.to_numpy() | pd.isna(before) | (given.to_numpy() != before)
    end = after.iloc[-1]
    return polls[kept], None if pd.isna(end) else end


def changed_snapshots_stream(
    polls: DataFrame,
    time: str,
    feed: str = "feed",
    seq: str = "seq",
    version: str = "last_modified",
    delay_ms: int = DELAY_MS,
) -> DataFrame:
    """Streaming ``drop_unchanged_snapshots``: whole polls with `late`.

    Poll numbers of a feed are consecutive; one that is missing holds up those after it until the
    watermark on `time` has passed them.  A poll that comes after its successors went on is late.
    The column names late and at_ms are taken.
    """
    named = polls.filter(F.col(feed).isNotNull() & F.col(seq).isNotNull() & F.col(time).isNotNull())
    timed = named.withColumn("at_ms", F.unix_millis(time)).withColumn(seq, F.col(seq).cast("long"))
    thin = timed.withWatermark(time, f"{delay_ms} milliseconds").mapInArrow(lambda b: b, timed.schema)
    shape = StructType([*timed.schema.fields, StructField("late", BooleanType())])
    filtered = thin.groupBy(feed).transformWithStateInPandas(
        ChangedPolls(seq, version, shape.names), shape, "Append", "EventTime"
    )
    return filtered.drop("at_ms")


# -- spikes ----------------------------------------------------------------------------------

COUNTED = StructType(
    [
        StructField("region_id", StringType()),
        StructField("ms", LongType()),
        StructField("event_id", StringType()),
        StructField("rows", LongType()),
        StructField("late", BooleanType()),
        StructField("at", TimestampType()),
    ]
)
FOUND = StructType([*COUNTED.fields[:3], StructField("n", LongType()), StructField("late", BooleanType())])


class SlotCounter(StatefulProcessor):
    """Rows of one (region, slot): repeats of an id at one ms fall together when the slot is released.

    Emits for each ms its smallest ids, each with the number of distinct ids of that ms.
    """

    def __init__(self, slot_ms: int, keep: int):
        self.width, self.keep = slot_ms, keep

    def init(self, handle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        region, slot = key
        now = timerValues.getCurrentWatermarkInMs()
        frame = pd.concat(list(rows), ignore_index=True)[["ms", "event_id"]].drop_duplicates()
        if slot + self.width <= now:
            yield self.shaped(region, frame.assign(rows=1), True, now)
            return
        if not self.parts.exists():
            self.handle.registerTimer(slot + self.width)
        self.parts.appendValue((pack(frame),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        frame = unpack([part for (part,) in self.parts.get()]).drop_duplicates().sort_values(["ms", "event_id"])
        frame["rows"] = frame.groupby("ms")["event_id"].transform("size")
        first = frame[frame.groupby("ms").cumcount() < self.keep]
        self.parts.clear()
        yield self.shaped(key[0], first, False, timerValues.getCurrentWatermarkInMs())

    @staticmethod
    def shaped(region: str, frame: pd.DataFrame, late: bool, now: int) -> pd.DataFrame:
        # What leaves with an event time up to the watermark would be taken for late by the next step.
        at = pd.Timestamp(max(now, 0) + 1, unit="ms")
        return frame.assign(region_id=region, late=late, at=at)[COUNTED.names]

    def close(self) -> None:
        pass


class SlotSpikes(StatefulProcessor):
    """Sliding count and cooldown of one region over released slots, which come in order.

    The window lies in state as slots of its own width, so a micro-batch writes the newest only.
    """

    def __init__(self, window_ms: int, threshold: int, cooldown_ms: int, slot_ms: int):
        self.window, self.threshold, self.cooldown, self.behind = window_ms, threshold, cooldown_ms, slot_ms
        self.width = max(1000, window_ms // 32)

    def init(self, handle) -> None:
        self.handle = handle
        self.live = handle.getMapState("live", "slot long", "ms binary, rows binary")
        self.fired = handle.getValueState("fired", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        late = frame["late"].to_numpy(bool)
        if late.any():
            yield frame[late].assign(n=0)[FOUND.names]
        fresh = frame[~late].sort_values(["ms", "event_id"], kind="stable")
        if not len(fresh):
            return
        ms, first = np.unique(fresh["ms"].to_numpy(np.int64), return_index=True)
        many = fresh["rows"].to_numpy(np.int64)[first]
        starts = sorted(s for (s,) in self.live.keys())
        kept = [s for s in starts if s + self.width > ms[0] - self.window]
        held = [self.live.getValue((s,)) for s in kept]
        old_ms = np.concatenate([np.frombuffer(h[0], np.int64) for h in held] or [np.empty(0, np.int64)])
        old_many = np.concatenate([np.frombuffer(h[1], np.int64) for h in held] or [np.empty(0, np.int64)])
        all_ms, all_many = np.concatenate([old_ms, ms]), np.concatenate([old_many, many])
        so_far = np.concatenate([[0], np.cumsum(all_many)])
        before = so_far[len(old_ms) : len(old_ms) + len(ms)] - so_far[np.searchsorted(all_ms, ms - self.window)]
        nth = np.maximum(1, self.threshold - before)
        last = self.fired.get()[0] if self.fired.exists() else None
        ids = fresh["event_id"].to_numpy(object)
        found, ready = [], np.flatnonzero(many >= nth)
        i = 0
        while i < len(ready):
            if last is not None:
                i = max(i, int(np.searchsorted(ms[ready], last + self.cooldown, "right")))
                if i >= len(ready):
                    break
            k = ready[i]
            last = int(ms[k])
            found.append((key[0], last, ids[first[k] + nth[k] - 1], int(before[k] + nth[k]), False))
            i += 1
        self.store(starts, kept, all_ms, all_many, ms)
        if found:
            self.fired.update((last,))
            yield pd.DataFrame(found, columns=FOUND.names)
        self.handle.registerTimer(max(int(ms[-1]), last or 0) + self.window + self.cooldown + self.behind + 1)

    def store(self, starts, kept, all_ms, all_many, ms) -> None:
        """Write the slots that got rows, drop those that no later window reaches."""
        for s in starts:
            if s + self.width <= ms[-1] - self.window:
                self.live.removeKey((s,))
        slot = all_ms - all_ms % self.width
        for s in np.unique(slot[slot >= ms[0] - ms[0] % self.width]).tolist():
            if s + self.width > ms[-1] - self.window:
                own = slot == s
                self.live.updateValue((s,), (all_ms[own].tobytes(), all_many[own].tobytes()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A slot that the watermark has not passed may begin before it by the slot's length.
        now = timerValues.getCurrentWatermarkInMs() - self.behind
        for s in sorted(s for (s,) in self.live.keys()):
            if s + self.width + self.window < now:
                self.live.removeKey((s,))
        if self.fired.exists() and self.fired.get()[0] + self.cooldown < now:
            self.fired.clear()
        return iter(())

    def close(self) -> None:
        pass


def _distinct_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            yield from table.group_by(table.column_names).aggregate([]).select(table.column_names).to_batches()


def ordered_spikes_stream(
    alerts: DataFrame,
    window_ms: int = spikes.WINDOW_MS,
    threshold: int = spikes.THRESHOLD,
    cooldown_ms: int = spikes.COOLDOWN_MS,
    delay_ms: int = DELAY_MS,
    slot_ms: int = SLOT_MS,
) -> DataFrame:
    """Streaming ``detect_spikes`` in order of event time: region_id, ms, event_id, n, late.

    Rows are first brought together by (region, slot), so a hot region is as many tasks as it has
    slots at work; one row per ms and a few ids go on to the region.  Late rows have n = 0.
    """
    threshold = threshold if threshold > 0 else spikes.THRESHOLD
    ms = F.unix_millis("event_timestamp")
    members = alerts.filter(F.col("region_id").isNotNull() & F.col("event_timestamp").isNotNull()).select(
        "region_id", (ms - F.pmod(ms, F.lit(slot_ms))).alias("slot"), ms.alias("ms"), "event_id", "event_timestamp"
    )
    # The fold comes after the watermark and leaves its mark off the column: late rows reach the state.
    timed = members.withWatermark("event_timestamp", f"{delay_ms} milliseconds")
    thin = timed.mapInArrow(_distinct_members, members.schema)
    counted = thin.groupBy("region_id", "slot").transformWithStateInPandas(
        SlotCounter(slot_ms, threshold), COUNTED, "Append", "EventTime", eventTimeColumnName="at"
    )
    return counted.groupBy("region_id").transformWithStateInPandas(
        SlotSpikes(window_ms, threshold, cooldown_ms, slot_ms), FOUND, "Append", "EventTime"
    )


def split_spikes(found: DataFrame, window_ms: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(anomaly events, late rows) of `ordered_spikes_stream`, or of one of its micro-batches."""
    at = F.timestamp_millis("ms")
    fired = found.filter(~F.col("late")).select("region_id", "event_id", "n", at.alias("detected_at"))
    late = found.filter("late").select("region_id", "event_id", at.alias("event_timestamp"))
    return spikes.to_anomalies(fired, window_ms, threshold), late
