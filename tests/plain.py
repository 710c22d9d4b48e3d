"""Plain sequential loops the operators are compared with."""

from bisect import bisect_left


def gate(rows, ttl, inclusive=True, resets=()):
    """rows: (key, ms, tie); resets: (key, ms).  Returns the rows that pass."""
    freed = {}
    for key, ms in resets:
        freed.setdefault(key, []).append(ms)
    for marks in freed.values():
        marks.sort()
    last, out = {}, []
    for key, ms, tie in sorted(set(rows), key=lambda r: (r[1], r[2])):
        if key is None or ms is None:
            continue
        before = last.get(key)
        marks = freed.get(key, [])
        was_reset = before is not None and any(before < m <= ms for m in marks)
        waited = None if before is None else ms - before
        if before is None or was_reset or waited > ttl or (inclusive and waited == ttl):
            last[key] = ms
            out.append((key, ms, tie))
    return sorted(out)


def counts(rows, window):
    """rows: (key, ms, id).  Returns (key, ms, id, n)."""
    seen, out = {}, []
    for key, ms, name in sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[1], r[2])):
        line = seen.setdefault(key, [])
        line.append(ms)
        out.append((key, ms, name, len(line) - bisect_left(line, ms - window)))
    return sorted(out)


def spikes(rows, window, threshold, cooldown):
    locked, out = {}, []
    for key, ms, name, n in sorted(counts(rows, window), key=lambda r: (r[1], r[2])):
        if n >= threshold and (key not in locked or ms - locked[key] > cooldown):
            locked[key] = ms
            out.append((key, ms, name, n))
    return sorted(out)
