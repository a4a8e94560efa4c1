"""Stateful jobs per key that take late rows in their place and forget what no row can change any more.

Each holds a key's recent rows in order.  Rows may come as late as the watermark allows; what the late row changes is
corrected by a pair of output rows, ``sign`` -1 for what was said before and +1 for what holds now (:func:`settled` adds them
up), or said only when the watermark has passed.  What is older than the watermark is cut down to what later rows still
need, and timers on event time clear keys that fall silent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def settled(rows: DataFrame) -> DataFrame:
    """What holds after all corrections of ``rows(..., sign)``."""
    keys = [c for c in rows.columns if c not in ("sign", "batch")]
    return rows.groupBy(*keys).agg(F.sum("sign").alias("_n")).where("_n > 0").drop("_n")


def _set_timer(handle: StatefulProcessorHandle, at_us: int) -> None:
    """One timer per key: at ``at_us``, or just after where that is a broken millisecond."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(at_us // 1_000 + 1)


class Changes(StatefulProcessor):
    """Rows whose value differs from the one before in time by the share ``noise``.

    State: the key's rows from the last one before the watermark on.  A late row takes its place among them, so it gets its
    own change and its successor's is corrected.
    """

    def __init__(self, keys: list[str], noise: float):
        self.keys, self.noise = keys, noise

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "us bigint, event_id bigint, value double")

    def _found(self, rows: list[tuple]) -> dict[int, tuple[float, float]]:
        pairs = ((a[2], b[2], b[1]) for a, b in zip(rows, rows[1:]))
        return {i: (x, y) for x, y, i in pairs if x is not None and y is not None and x != 0 and abs(y - x) / abs(x) >= self.noise}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = [tuple(r) for r in self.rows.get()]
        new = [(int(u), int(i), None if pd.isna(v) else float(v)) for part in rows for u, i, v in zip(part["us"], part["event_id"], part["value"])]
        merged = sorted(held + new, key=lambda r: r[:2])
        old, now = self._found(held), self._found(merged)
        out = [(i, *old[i], -1) for i in old if now.get(i) != old[i]] + [(i, *now[i], 1) for i in now if old.get(i) != now[i]]
        self._keep(merged, timerValues)
        if out:
            yield pd.DataFrame([(*key, *r) for r in out], columns=[*self.keys, "event_id", "before", "after", "sign"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self._keep([tuple(r) for r in self.rows.get()], timerValues)
        return iter([])

    def _keep(self, rows: list[tuple], timers) -> None:
        """From the last row before the watermark on; a timer calls again when the watermark has passed the newest row."""
        passed = timers.getCurrentWatermarkInMs() * 1_000
        first = max((k for k, r in enumerate(rows) if r[0] < passed), default=0)
        self.rows.put(rows[first:])
        if len(rows) - first > 1:
            _set_timer(self.handle, rows[-1][0])

    def close(self) -> None:
        pass


def value_changes(stream: DataFrame, keys: list[str], value: str, noise: float, late: str) -> DataFrame:
    """``keys, event_id, before, after, sign`` of ``stream(keys, ts, event_id, value)``; see :class:`Changes` and :func:`settled`.

    Values that are null or follow a null or zero are no change.  Rows later than ``late`` are dropped by the watermark.
    """
    rows = stream.withWatermark("ts", late).select(*keys, "ts", "event_id", F.col(value).cast("double").alias("value"), F.unix_micros("ts").alias("us"))
    out = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys) + ", event_id long, before double, after double, sign int"
    return rows.groupBy(*keys).transformWithStateInPandas(Changes(keys, noise), out, "append", "eventTime")


class Replays(StatefulProcessor):
    """The first use of any of a family's tokens within ``life`` of that token's last use.

    State: a map from token to its uses, and the revocation that was said last.  A late use can only move that to an earlier
    time.  A token leaves ``life`` after its last use, and all of a family's leave when the watermark has passed its revocation;
    of that a mark stays until ``life`` after it.
    """

    def __init__(self, life_us: int):
        self.life = life_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.uses = handle.getMapState("uses", "token bigint", "us array<bigint>, id array<bigint>")
        self.revoked = handle.getValueState("revoked", "us bigint, id bigint, token bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        said = tuple(self.revoked.get()) if self.revoked.exists() else None
        new: dict[int, list[tuple[int, int]]] = {}
        for part in rows:
            for token, us, i in zip(part["token"], part["us"], part["event_id"]):
                if said is None or (int(us), int(i)) < said[:2]:  # what comes after a revocation changes nothing
                    new.setdefault(int(token), []).append((int(us), int(i)))
        best = said
        for token, more in new.items():
            held = self.uses.getValue((token,)) if self.uses.containsKey((token,)) else ((), ())
            uses = sorted([*zip(held[0], held[1]), *more])
            again = next(((*b, token) for a, b in zip(uses, uses[1:]) if b[0] - a[0] <= self.life), None)
            best = min(filter(None, (best, again)), default=None)
            self.uses.updateValue((token,), ([u for u, _ in uses], [i for _, i in uses]))
        if best != said:
            self.revoked.update(best)
            out = [(key[0], r[2], r[0], sign) for r, sign in ((said, -1), (best, 1)) if r]
            yield pd.DataFrame(out, columns=["family", "token", "us", "sign"])
        self._forget(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self._forget(timerValues)
        return iter([])

    def _forget(self, timers) -> None:
        passed = timers.getCurrentWatermarkInMs() * 1_000
        said = tuple(self.revoked.get()) if self.revoked.exists() else None
        due = []
        if said and said[0] < passed:
            self.uses.clear()
            if said[0] + self.life < passed:
                self.revoked.clear()
                said = None
        for (token,), (us, ids) in list(self.uses.iterator()):
            first = max((k for k, u in enumerate(us) if u < passed), default=0)
            if us[-1] + self.life < passed:
                self.uses.removeKey((token,))
                continue
            if first:
                self.uses.updateValue((token,), (list(us[first:]), list(ids[first:])))
            due.append(us[-1] + self.life)
        if said:
            due.append(said[0] if said[0] >= passed else said[0] + self.life)
        if due:
            _set_timer(self.handle, min(due))

    def close(self) -> None:
        pass


def revoked_families(stream: DataFrame, life: str, late: str) -> DataFrame:
    """``family, token, us, sign``: when a family of ``stream(family, token, ts, event_id)`` is revoked; see :class:`Replays`.

    ``us`` are microseconds of event time.  ``life`` is an interval such as ``30 days``; after it a family starts anew.
    """
    rows = stream.withWatermark("ts", late).select("family", "token", "ts", "event_id", F.unix_micros("ts").alias("us"))
    return rows.groupBy("family").transformWithStateInPandas(Replays(_micros(life)), "family long, token long, us long, sign int", "append", "eventTime")


class StuckJobs(StatefulProcessor):
    """Starts that nothing follows within a time, said when the watermark has passed it.

    State: the job's rows that are not settled, and how often it was started.  A finish, or ``silence`` without a row, ends the
    count; then nothing of the job is left.
    """

    def __init__(self, patience_us: int, silence_us: int, attempts: int):
        self.patience, self.silence, self.attempts = patience_us, silence_us, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "us bigint, event_id bigint, start boolean")
        self.count = handle.getValueState("count", "tries int, us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = [(int(u), int(i), k == "start") for part in rows for u, i, k in zip(part["us"], part["event_id"], part["kind"])]
        yield from self._settle(key, [tuple(r) for r in self.rows.get()] + new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        yield from self._settle(key, [tuple(r) for r in self.rows.get()], timerValues)

    def _settle(self, key, rows: list[tuple], timers) -> Iterator[pd.DataFrame]:
        passed = timers.getCurrentWatermarkInMs() * 1_000
        rows.sort()
        tries, last = self.count.get() if self.count.exists() else (0, None)
        out, k = [], 0
        while k < len(rows) and rows[k][0] + self.patience < passed:  # all rows up to the end of its patience are here
            us, _, start = rows[k]
            if last is not None and us - last > self.silence:
                tries = 0
            tries = tries + 1 if start else 0
            last = us if start else None
            if start and (k + 1 == len(rows) or rows[k + 1][0] > us + self.patience):
                out.append((key[0], us, tries, "fail" if tries >= self.attempts else "requeue"))
            k += 1
        left = rows[k:]
        if last is not None and not left and last + self.silence < passed:
            last = None
        self.rows.put(left) if left else self.rows.clear()
        self.count.update((tries, last)) if last is not None else self.count.clear()
        if left or last is not None:
            _set_timer(self.handle, left[0][0] + self.patience if left else last + self.silence)
        if out:
            yield pd.DataFrame(out, columns=["job_id", "us", "attempts", "action"])

    def close(self) -> None:
        pass


def stuck_jobs(stream: DataFrame, minutes: int = 45, attempts: int = 3, silence: str = "7 days", late: str = "1 minute") -> DataFrame:
    """``job_id, us, attempts, action``: starts of ``stream(job_id, ts, event_id, kind)`` that nothing of the job follows within ``minutes``.

    ``kind`` is ``start`` or ``finish``, ``us`` the start's event time in microseconds.  The job is to be queued again, or failed
    after ``attempts`` starts since it finished last or was silent for ``silence``.
    """
    rows = stream.withWatermark("ts", late).select("job_id", "ts", "event_id", "kind", F.unix_micros("ts").alias("us"))
    processor = StuckJobs(minutes * 60_000_000, _micros(silence), attempts)
    return rows.groupBy("job_id").transformWithStateInPandas(processor, "job_id long, us long, attempts int, action string", "append", "eventTime")


def _micros(interval: str) -> int:
    return pd.Timedelta(interval).value // 1_000
