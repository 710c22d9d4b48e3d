"""The ordered snapshot filter on state kept in a dictionary: what it writes, and the answers of a plain loop."""

import random

import pandas as pd

from klaxon.streaming import ordered


class Held(dict):
    """A value or map state that counts its writes."""

    writes = 0

    def exists(self):
        return bool(self)

    def get(self):
        return dict.__getitem__(self, None)

    def update(self, value):
        self[None] = value

    def iterator(self):
        return iter(list(self.items()))

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self.writes += 1
        self[key] = value

    def removeKey(self, key):
        del self[key]


class Handle:
    def __init__(self):
        self.maps, self.timers, self.asked = [], set(), 0

    def getValueState(self, name, schema):
        return Held()

    def getMapState(self, name, key, value):
        self.maps.append(Held())
        return self.maps[-1]

    def registerTimer(self, at):
        self.asked += 1
        self.timers.add(at)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


COLUMNS = ["seq", "at_ms", "last_modified", "payload", "late"]


def started():
    filtering, handle = ordered.ChangedPolls("seq", "last_modified", COLUMNS), Handle()
    filtering.init(handle)
    return filtering, handle


def frame(rows):
    return pd.DataFrame(rows, columns=COLUMNS[:-1])


def fed(filtering, handle, batches):
    """(seq, payload, late) of what comes out; a batch is (watermark, rows), and due timers come after its rows."""
    found = []
    for now, rows in batches:
        outs = list(filtering.handleInputRows(("f",), iter([frame(rows)]), Clock(now))) if rows else []
        for at in sorted(t for t in handle.timers if t <= now):
            handle.timers.discard(at)
            outs += filtering.handleExpiredTimer(("f",), Clock(now), None)
        found += [(r.seq, r.payload, r.late) for out in outs for r in out.itertuples()]
    return found


def plain(batches):
    waiting, last, known, found = {}, None, None, []
    for now, rows in batches:
        for seq, at, version, payload in rows:
            if last is not None and seq <= last:
                found.append((seq, payload, True))
            else:
                waiting.setdefault(seq, []).append((at, version, payload))
        passed = max((s for s, polls in waiting.items() if max(p[0] for p in polls) < now), default=None)
        for seq in sorted(waiting):
            if not (last is not None and seq == last + 1) and (passed is None or seq > passed):
                break
            polls, before = waiting.pop(seq), known
            for _, version, payload in polls:
                blank = version is None or not version.strip()
                if blank or before is None or version != before:
                    found.append((seq, payload, False))
            known = max((v for _, v, _ in polls if v is not None and v.strip()), default=known)
            last = seq
    return found


def test_answers_of_a_plain_loop(monkeypatch):
    monkeypatch.setattr(ordered, "POLLS_PER_BLOCK", 4)
    rng = random.Random(5)
    for _ in range(150):
        rows = [
            (seq, seq * 10, rng.choice([None, "", " ", "a", "b", "b", "c"]), f"{seq}/{copy}")
            for seq in rng.sample(range(-3, 60), rng.randrange(1, 55))
            for copy in range(rng.choice([1, 1, 1, 2]))
        ]
        rows.sort(key=lambda r: r[1] + rng.randrange(150))
        batches, low = [], 0
        while rows:
            many = rng.randrange(0, 12)
            batches.append((low, rows[:many]))
            low, rows = max([low, *(r[1] - 60 for r in rows[:many])]), rows[many:]
        batches += [(low, []), (10_000, [])]
        assert sorted(fed(*started(), batches)) == sorted(plain(batches))


def test_polls_that_go_on_at_once_are_not_written():
    """State was written, read and given a timer once per poll."""
    filtering, handle = started()
    rows = [(seq, seq * 10, f"v{seq // 3}", "p") for seq in range(2000)]
    found = fed(filtering, handle, [(100, rows[:5]), (100, rows[5:])])
    assert len(found) == 667 and not any(handle.maps)
    assert sum(m.writes for m in handle.maps) + handle.asked < 10


def test_polls_that_wait_share_entries():
    filtering, handle = started()
    rows = [(seq, seq * 10, f"v{seq}", "p") for seq in range(2000)]
    assert fed(filtering, handle, [(0, rows)]) == []
    assert sum(m.writes for m in handle.maps) <= 2 * (2000 // ordered.POLLS_PER_BLOCK + 1)
    assert len(fed(filtering, handle, [(100_000, [])])) == 2000 and not any(handle.maps)
