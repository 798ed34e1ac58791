"""Time-bound state: results that expire and rolling rates.

Both exist as a batch job and as a stream with arbitrary state and event-time
timers, and give the same rows.  A stream holds a request back until the
watermark has passed its second, then treats the seconds in order, so the
order in which rows arrive within the allowed lateness does not matter; rows
later than the watermark are dropped by Spark.  State is per key and goes
when its timer fires: an idle key holds none.

Time counts in whole seconds; requests of one key and second are one entry
with a count, combined before any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EXPIRY_SCHEMA = "key string, second long, requests long, stored_at long, scored boolean"
RATE_SCHEMA = "key string, second long, n long"


def per_second(requests: DataFrame, key: Column, ts: str) -> DataFrame:
    """(key, second, requests), combined map-side."""
    return requests.groupBy(key.cast("string").alias("key"), second_of(requests, ts).alias("second")).agg(
        F.count(F.lit(1)).alias("requests"))


def second_of(df: DataFrame, ts: str) -> Column:
    """Whole seconds since 1970; a time without zone counts as UTC."""
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col(ts))
    else:
        micros = F.unix_micros(ts)
    return F.floor(micros / 1_000_000)


# ---------------------------------------------------------------------------
# A stored result expires ``ttl`` seconds after it was stored
# ---------------------------------------------------------------------------

def expiry(requests: DataFrame, key: Column, ts: str, ttl: int) -> DataFrame:
    """X2 (batch): for each key and second with requests, whether the page is
    scored then (nothing stored, or what was stored has expired) or the
    result of ``stored_at`` is served.

    A result's time of storage depends on the one before it, so a key's
    seconds are walked in order: keys are dealt by hash, sorted, and folded
    while they stream through a task that holds one number.  A key has one
    row a second at most, however many requests it gets.
    """
    rows = per_second(requests, key, ts)
    names = ["key", "second", "requests"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, stored = object(), None
        for b in batches:
            at, scored = [], []
            for k, second in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != last:
                    last, stored = k, None
                new = stored is None or second >= stored + ttl
                stored = second if new else stored
                at.append(stored)
                scored.append(new)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64()), pa.array(scored, pa.bool_())],
                                             names + ["stored_at", "scored"])

    dealt = rows.repartition("key").sortWithinPartitions("key", "second").select(*names)
    return dealt.mapInArrow(fold, EXPIRY_SCHEMA)


class ExpiringResult(StatefulProcessor):
    """X2 (stream): per key the time of storage and the seconds that wait for
    the watermark; timers wake the key for both."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("stored", "at long")
        self.waiting = handle.getMapState("waiting", "second long", "requests long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        _wait(self, rows)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        stored = self.stored.get()[0] if self.stored.exists() else None
        for second, n in _due(self.waiting, now):
            new = stored is None or second >= stored + self.ttl
            stored = second if new else stored
            yield Row(key=key[0], second=second, requests=n, stored_at=stored, scored=new)
        if stored is not None and now >= stored + self.ttl and not _any(self.waiting):
            self.stored.clear()
        elif stored is not None:
            self.stored.update((stored,))
            self.handle.registerTimer((stored + self.ttl) * 1000)

    def close(self) -> None:
        pass


def expiry_stream(requests: DataFrame, key: Column, ts: str, ttl: int, lateness: str) -> DataFrame:
    """:func:`expiry` over a stream; a second's row is emitted once the
    watermark has passed it."""
    return _keyed(requests, key, ts, lateness).transformWithState(ExpiringResult(ttl), EXPIRY_SCHEMA, "Append", "EventTime")


# ---------------------------------------------------------------------------
# Requests in the ``width`` seconds that end with each request
# ---------------------------------------------------------------------------

def rolling_rate(requests: DataFrame, key: Column, ts: str, width: int, limit: int = 0) -> DataFrame:
    """X3 (batch): (key, second, n) where more than ``limit`` requests of the
    key lie in the ``width`` seconds up to and with that second.

    A range frame over event time.  A key's seconds are cut into stretches of
    ``width``; each second also travels to the next stretch, so a frame never
    needs a third one and a key with very many requests is many groups.
    """
    rows = per_second(requests, key, ts)
    part = F.floor(F.col("second") / width)
    both = rows.select("*", F.explode(F.array(F.struct(part.alias("part"), F.lit(True).alias("own")),
                                              F.struct((part + 1).alias("part"), F.lit(False).alias("own")))).alias("p"))
    w = Window.partitionBy("key", "p.part").orderBy("second").rangeBetween(-(width - 1), 0)
    counted = both.select("key", "second", "p.own", F.sum("requests").over(w).alias("n"))
    return counted.where(F.col("own") & (F.col("n") > limit)).select("key", "second", "n")


class RollingRate(StatefulProcessor):
    """X3 (stream): per key the seconds of the last ``width`` and those that
    wait for the watermark."""

    def __init__(self, width: int, limit: int):
        self.width, self.limit = width, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getMapState("recent", "second long", "requests long")
        self.waiting = handle.getMapState("waiting", "second long", "requests long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        _wait(self, rows)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        recent = {k[0]: v[0] for k, v in self.recent.iterator()} if self.recent.exists() else {}
        for second, n in _due(self.waiting, now):
            recent[second] = n
            self.recent.updateValue((second,), (n,))
            total = sum(c for s, c in recent.items() if second - self.width < s <= second)
            if total > self.limit:
                yield Row(key=key[0], second=second, n=total)
        for second in [s for s in recent if s <= now - self.width]:
            self.recent.removeKey((second,))
            del recent[second]
        if recent:
            self.handle.registerTimer((max(recent) + self.width) * 1000)

    def close(self) -> None:
        pass


def rolling_rate_stream(requests: DataFrame, key: Column, ts: str, width: int, lateness: str, limit: int = 0) -> DataFrame:
    """:func:`rolling_rate` over a stream."""
    return _keyed(requests, key, ts, lateness).transformWithState(RollingRate(width, limit), RATE_SCHEMA, "Append", "EventTime")


# ---------------------------------------------------------------------------

def _keyed(requests: DataFrame, key: Column, ts: str, lateness: str):
    rows = requests.withWatermark(ts, lateness).select(
        key.cast("string").alias("key"), F.col(ts), second_of(requests, ts).alias("second"))
    return rows.groupBy("key")


def _wait(p, rows) -> None:
    """Count the rows under their seconds; a timer wakes the key when the
    watermark has passed a second's end."""
    counts: dict[int, int] = {}
    for r in rows:
        counts[r.second] = counts.get(r.second, 0) + 1
    for second, n in counts.items():
        before = p.waiting.getValue((second,))[0] if p.waiting.containsKey((second,)) else 0
        p.waiting.updateValue((second,), (before + n,))
        p.handle.registerTimer((second + 1) * 1000)


def _any(state) -> bool:
    return state.exists() and next(iter(state.keys()), None) is not None


def _due(state, now: int) -> list[tuple[int, int]]:
    """The waiting seconds that have ended by ``now``, in order; they go."""
    due = sorted((k[0], v[0]) for k, v in state.iterator() if k[0] < now) if state.exists() else []
    for second, _ in due:
        state.removeKey((second,))
    return due
