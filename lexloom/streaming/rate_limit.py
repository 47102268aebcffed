"""Sliding-log rate limits: a client's request passes while fewer than `most` passed within the window before it.

Rejected requests leave no trace, so whether one passes depends on those before it, one by one.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
WINDOW_SECONDS, MOST = 60.0, 30


def admit(log: deque, at: float, window: float, most: int) -> tuple[bool, float]:
    """(passes, seconds until the next may pass); the log of passed requests is brought up to date."""
    if most <= 0:
        return True, 0.0
    while log and at - log[0] > window:
        log.popleft()
    if len(log) >= most:
        return False, window - (at - log[0])
    log.append(at)
    return True, 0.0


def replay(requests: DataFrame, key: str = "user_id", ts: str = "ts", tie: str = "event_id", window: float = WINDOW_SECONDS, most: int = MOST) -> DataFrame:
    """key, tie, accepted, retry_after of past requests.

    Requests are sorted by client and time inside partitions and streamed through, so a client with very many requests
    needs no more memory than its log of `most` entries.
    """
    seconds = (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("at")
    rows = requests.select(key, tie, seconds).repartition(key).sortWithinPartitions(key, "at", tie)
    kinds = f"{key} {requests.schema[key].dataType.simpleString()}, {tie} {requests.schema[tie].dataType.simpleString()}, accepted boolean, retry_after double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, log = object(), deque()
        for pdf in batches:
            passed, wait = [], []
            for k, at in zip(pdf[key], pdf["at"], strict=True):
                if k != client:
                    client, log = k, deque()
                ok, seconds = admit(log, at, window, most)
                passed.append(ok)
                wait.append(round(seconds, 6))
            yield pdf[[key, tie]].assign(accepted=passed, retry_after=wait)

    return rows.mapInPandas(run, kinds)


def limit(requests: DataFrame, key: str = "user_id", ts: str = "ts", tie: str = "event_id", window: float = WINDOW_SECONDS, most: int = MOST, late: str = "1 minute") -> DataFrame:
    """The same over a stream; a client idle for the window and the watermark's delay is forgotten.

    Within a micro-batch a client's requests are taken in the order of their times.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = f"{key} {requests.schema[key].dataType.simpleString()}, {tie} {requests.schema[tie].dataType.simpleString()}, accepted boolean, retry_after double"

    def run(keys, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        log = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(frames)).assign(__at=lambda d: d[ts].astype("datetime64[us]").astype("int64") / 1e6).sort_values(["__at", tie])
        results = [admit(log, at, window, most) for at in rows["__at"]]
        state.update((list(log),))
        last = int(rows["__at"].max() * 1000) + int(window * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: keys[0], tie: rows[tie], "accepted": [r[0] for r in results], "retry_after": [round(r[1], 6) for r in results]})

    watched = requests.select(key, tie, F.col(ts).cast("timestamp").alias(ts)).withWatermark(ts, late)
    return watched.groupBy(key).applyInPandasWithState(run, kinds, "log array<double>", "append", GroupStateTimeout.EventTimeTimeout)


#: How often idle clients are swept, in seconds of the clock.
SWEEP_SECONDS = 60.0


def swept_limit(requests: DataFrame, key: str = "user_id", ts: str = "ts", tie: str = "event_id", window: float = WINDOW_SECONDS, most: int = MOST, sweep: float = SWEEP_SECONDS) -> DataFrame:
    """The same over a stream by the clock: every `sweep` seconds a client's log is brought up to date, and a client whose
    log is empty is forgotten, whether or not further requests come.

    A client that is forgotten gives a row without event and answer.  Needs a state store that keeps timers (RocksDB).
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    kinds = f"{key} {requests.schema[key].dataType.simpleString()}, {tie} {requests.schema[tie].dataType.simpleString()}, accepted boolean, retry_after double"
    columns = [key, tie, "accepted", "retry_after"]

    class Limiter(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.log = handle.getValueState("log", "log array<double>")

        def _held(self) -> deque:
            return deque(self.log.get()[0]) if self.log.exists() else deque()

        def handleInputRows(self, key, rows, timerValues):
            known = self.log.exists()
            log = self._held()
            frame = pd.concat(list(rows)).assign(at=lambda d: d[ts].astype("datetime64[us]").astype("int64") / 1e6).sort_values(["at", tie])
            results = [admit(log, at, window, most) for at in frame["at"]]
            self.log.update((list(log),))
            if not known:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(sweep * 1000))
            yield pd.DataFrame({columns[0]: key[0], tie: frame[tie], "accepted": [r[0] for r in results], "retry_after": [round(r[1], 6) for r in results]}, columns=columns)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            now = timerValues.getCurrentProcessingTimeInMs()
            log = deque(x for x in self._held() if now / 1000 - x <= window)
            if log:
                self.log.update((list(log),))
                self.handle.registerTimer(now + int(sweep * 1000))
            else:
                self.log.clear()
                yield pd.DataFrame([(key[0], None, None, None)], columns=columns)

        def close(self) -> None:
            pass

    rows = requests.select(key, tie, F.col(ts).cast("timestamp").alias(ts))
    return rows.groupBy(key).transformWithStateInPandas(Limiter(), kinds, "append", "processingTime")
