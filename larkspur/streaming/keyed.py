"""Keyed state with timers: rows on their way through admission, and releases that close a while after they open."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from larkspur.session import travels

# The states, and each event with the states it may come in and the state it leads to.
STATES = ("pending", "queued", "processing", "settled", "quarantined", "absent")
EVENTS = {
    "dispatch": (("pending", "absent"), "queued"),
    "lease": (("pending", "queued"), "processing"),
    "settle": (("processing",), "settled"),
    "retry": (("processing",), "queued"),
    "quarantine": (("processing",), "quarantined"),
    "reclaim-lease": (("processing",), "queued"),
    "reopen": (("quarantined", "settled"), "queued"),
    "mark-absent": (STATES, "absent"),
    "reappear": (("absent",), "queued"),
}
# Attempts before quarantine, delays after the first and second failure, and a lease's time, in milliseconds.
ATTEMPTS, DELAYS_MS, LEASE_MS = 3, (60_000, 300_000), 120_000

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """State with timers needs the RocksDB store; streams started within have it, the session's setting comes back after."""
    was = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, was) if was else spark.conf.unset(PROVIDER)


class Row:
    """One row's state, and what an event at some time (milliseconds) makes of it."""

    def __init__(self, state: str = "pending", attempts: int = 0, retry_at: int = 0, lease_until: int = 0, last_at: int = -(1 << 62), last_id: int = -(1 << 62)):
        self.state, self.attempts, self.retry_at, self.lease_until, self.last_at, self.last_id = state, attempts, retry_at, lease_until, last_at, last_id

    def all(self) -> tuple:
        return self.state, self.attempts, self.retry_at, self.lease_until, self.last_at, self.last_id

    def expire(self, now: int, upto: tuple[int, int] | None = None) -> tuple | None:
        """The reclaim of a lease that ended by `now`, at its end."""
        if self.state != "processing" or not self.lease_until or self.lease_until > now:
            return None
        at, self.state, self.lease_until = self.lease_until, "queued", 0
        return at, None, "reclaim-lease", "processing", "queued", None, self.attempts

    def take(self, at: int, event_id: int, event: str, delays: tuple[int, ...], lease: int) -> tuple:
        """at, id, event, from, to (the same state if refused), reason of a refusal, attempts."""
        was, reason = self.state, None
        allowed, to = EVENTS.get(event, ((), was))
        if (at, event_id) <= (self.last_at, self.last_id):
            reason = "late"
        elif was not in allowed:
            reason = f"illegal-transition:{was}->{event}"
        elif event == "lease" and at < self.retry_at:
            reason = "retry-not-due"
        else:
            if event == "lease":
                self.lease_until = at + lease
            else:
                self.lease_until = 0
            if event == "retry":
                self.attempts += 1
                if self.attempts > len(delays):
                    to, self.retry_at = "quarantined", 0
                else:
                    self.retry_at = at + delays[self.attempts - 1]
            elif event in ("settle", "reopen", "reappear", "mark-absent", "dispatch"):
                self.attempts, self.retry_at = 0, 0
            self.state = to
        if reason != "late":
            self.last_at, self.last_id = at, event_id
        return at, event_id, event, was, self.state, reason, self.attempts


class Admission(StatefulProcessor):
    """Follow each key's row; a lease that nobody ends is reclaimed by its timer, or before the event that finds it ended."""

    def __init__(self, key: str, delays: tuple[int, ...], lease: int):
        self.key, self.delays, self.lease = key, delays, lease

    def init(self, handle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", "state string, attempts int, retry_at long, lease_until long, last_at long, last_id long")

    def _told(self, key: tuple, moves: list[tuple]) -> Iterator[pd.DataFrame]:
        if moves:
            out = pd.DataFrame(moves, columns=["at", "event_id", "event", "was", "state", "reason", "attempts"]).astype({"event_id": "Int64"})
            out.insert(0, self.key, key[0])
            yield out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        row = Row(*self.row.get()) if self.row.exists() else Row()
        # Events of a key in one micro-batch are put in order; the trigger's size bounds them.
        events = sorted((int(a), int(i), e) for pdf in rows for a, i, e in zip(pdf["at"], pdf["event_id"], pdf["event"], strict=True))
        moves = []
        for at, event_id, event in events:
            if ended := row.expire(at):
                moves.append(ended)
            moves.append(row.take(at, event_id, event, self.delays, self.lease))
        self.row.update(row.all())
        if row.lease_until:
            self.handle.registerTimer(row.lease_until)
        yield from self._told(key, moves)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.row.exists():
            row = Row(*self.row.get())
            if ended := row.expire(expiredTimerInfo.getExpiryTimeInMs()):
                self.row.update(row.all())
                yield from self._told(key, [ended])

    def close(self) -> None:
        pass


def admission(stream: DataFrame, key: str, late: str = "0 seconds", delays: tuple[int, ...] = DELAYS_MS, lease: int = LEASE_MS) -> DataFrame:
    """Every event's move: key, at, event_id, event, was, state, reason (null unless refused), attempts.

    The stream has the key (a long), ts, event_id and event. Six states and nine events, as EVENTS says; what it
    doesn't allow is refused as illegal. A lease ends after `lease` milliseconds: the row is queued again, which
    comes out as a reclaim-lease of its own. A retry raises the attempts and sets when the next lease may be,
    and beyond `delays` quarantines instead. Settled, reopened, returned and absent rows begin anew. Events are
    taken by time, then id; one that isn't behind its key's last is late and changes nothing.
    """
    travels(__name__)
    seen = stream.select(F.col(key).cast("long").alias(key), "ts", "event_id", "event").withColumn("at", F.unix_millis("ts")).withWatermark("ts", late)
    return seen.groupBy(key).transformWithStateInPandas(Admission(key, tuple(delays), lease), f"{key} long, at long, event_id long, event string, was string, state string, reason string, attempts int", "append", "eventTime")


class Release(StatefulProcessor):
    """Hold a key's events until the watermark says that a window's are all there; then they are a release."""

    def __init__(self, key: str, window: int):
        self.key, self.window = key, window

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, event_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # One call to the store for all of a key's events, and one timer: the first is due before the others.
        events = [e for pdf in rows for e in zip(pdf["at"].tolist(), pdf["event_id"].tolist(), strict=True)]
        if events:
            self.held.appendList(events)
            self.handle.registerTimer(min(events)[0] + self.window)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        out, left = [], []
        for at, event_id in sorted({(int(a), int(i)) for a, i in self.held.get()}):
            if out and at < out[-1][1]:
                out[-1][2].append(event_id)
            elif at + self.window <= passed:
                out.append((at, at + self.window, [event_id]))
            else:
                left.append((at, event_id))
        # A window isn't through if one that opens later than the watermark allows could still take its events: none can, as they are in order.
        if left:
            self.held.put(left)
            self.handle.registerTimer(left[0][0] + self.window)
        else:
            self.held.clear()
        if out:
            yield pd.DataFrame({self.key: key[0], "opened_at": [o for o, _, _ in out], "flush_at": [f for _, f, _ in out], "members": [sorted(m) for _, _, m in out], "release_id": [release_id(key[0], o, m) for o, _, m in out]})

    def close(self) -> None:
        pass


def release_id(key: object, opened_at: int, members: list[int]) -> str:
    """20 characters for an opened window and its members, whatever their order."""
    return hashlib.sha256(f"release-v1|{key}|{opened_at}|{','.join(map(str, sorted(members)))}".encode()).hexdigest()[:20]


def first_event_windows(stream: DataFrame, key: str, window: int, late: str) -> DataFrame:
    """Releases of each key: key, opened_at, flush_at (milliseconds), members (ids in order), release_id.

    A window opens with the first event that no window holds and closes `window` milliseconds later; an event at
    its end opens the next one. A release comes out once the watermark (the latest time less `late`) has passed its
    end, so events may come in any order within `late`; those that come later are dropped. Windows still open come
    out later or never. Repeated events count once.
    """
    if window < 1:
        raise ValueError("a window lasts a millisecond at least")
    travels(__name__)
    seen = stream.select(F.col(key).cast("long").alias(key), "ts", "event_id").withColumn("at", F.unix_millis("ts")).withWatermark("ts", late)
    return seen.groupBy(key).transformWithStateInPandas(Release(key, window), f"{key} long, opened_at long, flush_at long, members array<long>, release_id string", "append", "eventTime")
