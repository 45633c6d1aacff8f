"""Consent and task loops as streams: one state a device or run, events taken in the order of their time.

Events may come late, twice or out of order. They wait in their key's state until the watermark has passed them, then a
timer takes them in order of time, so that the outcome is that of the batch rules (``operators.guards``), however
they arrived; what comes later than the watermark allows is dropped. A key's state goes when nothing is pending. The state
lives in the state store, so a restart from the checkpoint goes on where the last batch ended. The store has to be
RocksDB's (``use_rocksdb``). Repeated events (one ``event_id``) count once. A key with a null id is a key like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from veilframe.operators.guards import CONSENT_MS, MOST_STEPS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CONSENTS = "device_id string, request_id string, asked_ms long, settled_ms long, outcome string"
RUNS = "run_id string, steps long, stop string, ended_ms long"
#: A run that takes no step for so long is done.
IDLE_MS = 600_000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _InOrder(StatefulProcessor):
    """Events wait until the watermark has passed them. ``take`` handles one, ``due`` says until when a key can lie still."""

    event = ""  # fields behind at_ms
    kept = ""  # the key's own state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at_ms long, {self.event}")
        self.now = handle.getValueState("now", self.kept)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = ["at_ms", *[f.split()[0] for f in self.event.split(", ")]]
        for pdf in rows:
            for row in pdf[names].itertuples(index=False):
                plain = tuple(None if pd.isna(x) else x.item() if hasattr(x, "item") else x for x in row)
                self.waiting.appendValue(plain)
                self.handle.registerTimer(int(plain[0]))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)  # nothing before the watermark can still come
        waiting = self.ordered(list(self.waiting.get())) if self.waiting.exists() else []
        ready, later = [e for e in waiting if e[0] <= upto], [e for e in waiting if e[0] > upto]
        self.waiting.put(later) if later else self.waiting.clear()
        state, out = (self.now.get() if self.now.exists() else None), []
        for e in ready:
            state, made = self.still(key[0], state, e[0])
            out += made
            state, made = self.take(key[0], state, e)
            out += made
        state, made = self.still(key[0], state, upto)
        out += made
        if state is None:
            self.now.clear()
        else:
            self.now.update(state)
            self.handle.registerTimer(int(self.due(state)) + 1)
        yield pd.DataFrame(out, columns=self.columns) if out else pd.DataFrame()

    def close(self) -> None:
        pass


class ConsentGate(_InOrder):
    """One request of a device is pending at a time: a newer one, or a cancellation, makes it stale, an answer settles it, else it times out."""

    event, kept = "event_id string, kind string, request_id string, approved boolean", "request_id string, asked_ms long"
    columns = ["device_id", "request_id", "asked_ms", "settled_ms", "outcome"]

    def __init__(self, limit_ms: int = CONSENT_MS):
        self.limit = limit_ms

    @staticmethod
    def ordered(events):
        """By time; at one time an answer to an older request comes before a newer request, and that one before its own answer, a refusal first."""
        asked = {(e[0], e[3]) for e in events if e[2] == "ask"}
        rank = lambda e: 1 if e[2] != "answer" else 2 if (e[0], e[3]) in asked else 0
        return sorted(events, key=lambda e: (e[0], rank(e), e[3] or "", bool(e[4]), e[1] or ""))

    def due(self, state):
        return state[1] + self.limit

    def still(self, key, state, at):
        """The state before an event at ``at``, after a request has timed out."""
        if state is None or at <= self.due(state):
            return state, []
        return None, [(key, *state, self.due(state), "timed-out")]

    def take(self, key, state, e):
        at, _, kind, request, approved = e
        if kind == "answer":
            if state is None or state[0] != request:
                return state, []  # of a request that is no longer pending
            return None, [(key, *state, at, "approved" if approved else "declined")]
        ended = [] if state is None else [(key, *state, at, "stale")]
        return ((request, at) if kind == "ask" else None), ended


class TaskLoop(_InOrder):
    """A run's steps until it ends: after a final one, before one that repeats the last, at ``most`` steps, or when none follow."""

    event, kept = "event_id string, step long, signature string, final boolean", "steps long, signature string, last_ms long, ended boolean"
    columns = ["run_id", "steps", "stop", "ended_ms"]

    def __init__(self, most: int = MOST_STEPS, idle_ms: int = IDLE_MS):
        self.most, self.idle = most, idle_ms

    @staticmethod
    def ordered(events):
        return sorted(events, key=lambda e: (e[0], -1 if e[2] is None else e[2], e[1] or ""))

    def due(self, state):
        return state[2] + self.idle

    def still(self, key, state, at):
        if state is None or at <= self.due(state):
            return state, []
        return None, [] if state[3] else [(key, state[0], "done", state[2])]

    def take(self, key, state, e):
        at, _, _, signature, final = e
        steps, last, _, ended = state or (0, None, at, False)
        if ended:
            return (steps, last, at, True), []  # steps after the end don't count; the state goes when they cease
        if state is not None and signature is not None and signature == last:
            return (steps, last, at, True), [(key, steps, "repeat", at)]
        steps += 1
        stop = "final" if final else "most steps" if steps >= self.most else None
        return (steps, signature, at, stop is not None), [(key, steps, stop, at)] if stop else []


def _run(events: DataFrame, key: str, processor: _InOrder, schema: str, late: str) -> DataFrame:
    timed = events.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    rows = timed.withColumn("at_ms", F.unix_millis("at"))
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def consent_stream(events: DataFrame, late: str = "1 minute", limit_ms: int = CONSENT_MS) -> DataFrame:
    """(device_id, request_id, asked_ms, settled_ms, outcome) of a stream of (device_id, at, event_id, kind: ask, answer or cancel, request_id, approved)."""
    return _run(events, "device_id", ConsentGate(limit_ms), CONSENTS, late)


def run_stream(steps: DataFrame, late: str = "1 minute", most: int = MOST_STEPS, idle_ms: int = IDLE_MS) -> DataFrame:
    """(run_id, steps, stop, ended_ms) of a stream of (run_id, at, event_id, step, signature, final)."""
    return _run(steps, "run_id", TaskLoop(most, idle_ms), RUNS, late)
