"""State with timers: monitors of runs, and the latest value by order of sources. State comes and goes with a key's rows, so a key costs no calls of its own to the
state store."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "step long, at double, best double, stale long, stopped_at long, reason string, elapsed double"


class RunMonitor:
    """Follows the evaluations (at, value) of a run, numbered as they come. A value improves only if it is below the best by more than ``min_delta``;
    staleness counts evaluations after ``from_step`` (before that, only part of the model is trained), and ``patience`` of them stop the run. Time between
    evaluations adds up to the time spent, but for gaps of more than ``silence`` seconds, when the run was down; so a budget goes on
    where it was after a restart of the run, and of the stream, as it is state. A run that is silent for so long ends when the watermark shows it, and goes on if rows come all the same."""

    def __init__(self, min_delta: float, patience: int, from_step: int, budget: float, silence: float):
        self.min_delta, self.patience, self.from_step, self.budget, self.silence = min_delta, patience, from_step, budget, silence

    def _row(self, key: tuple, state: tuple) -> pd.DataFrame:
        step, _, best, stale, stopped, reason, elapsed = state
        return pd.DataFrame({"run": [key[0]], "step": [step], "best": [best], "stale": [stale], "stopped_at": [stopped], "reason": [reason], "elapsed": [elapsed]})

    def update(self, key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        step, at, best, stale, stopped, reason, elapsed = state.get if state.exists else (0, None, float("inf"), 0, -1, "", 0.0)
        if state.hasTimedOut:
            kept = (step, at, best, stale, stopped, "silence", elapsed)
            state.update(kept)
            yield self._row(key, kept)
            return
        moments, ids, values = (np.concatenate(x) for x in zip(*[(p["at"].to_numpy(), p["id"].to_numpy(), p["value"].to_numpy()) for p in parts], strict=True))
        order = np.lexsort((ids, moments))
        for now, value in zip(moments[order].tolist(), values[order].tolist(), strict=True):
            if stopped >= 0:
                break
            step, reason = step + 1, ""
            gap = 0.0 if at is None else now - at
            at, elapsed = now, elapsed + (gap if gap <= self.silence else 0.0)
            if value < best - self.min_delta:
                best, stale = float(value), 0
            elif step > self.from_step:
                stale += 1
            if stale >= self.patience or elapsed >= self.budget:
                stopped, reason = step, "early_stopping" if stale >= self.patience else "wall_time_limit"
        kept = (step, at, best, stale, stopped, reason, elapsed)
        state.update(kept)
        if stopped < 0:
            state.setTimeoutTimestamp(max(int((at + self.silence) * 1000), state.getCurrentWatermarkMs() + 1))
        yield self._row(key, kept)


class FirstSource:
    """Keeps the last value of every source and gives that of the first source, in a fixed order, that has one, whenever it changes."""

    def __init__(self, sources: tuple[str, ...]):
        self.sources = sources
        self.state = ", ".join(["given string, given_value double", *[f"id{i} long, value{i} double" for i in range(len(sources))]])

    def update(self, key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        given, last = (None, None), {}
        if state.exists:
            now = tuple(state.get)
            given, last = now[:2], {s: now[2 + 2 * i : 4 + 2 * i] for i, s in enumerate(self.sources) if now[2 + 2 * i] is not None}
        for part in parts:
            newest = {}
            for source, number, value in zip(part["source"].tolist(), part["id"].tolist(), part["value"].tolist(), strict=True):
                if source not in newest or number >= newest[source][0]:
                    newest[source] = (number, value)
            for source, seen in newest.items():
                if source not in last or last[source][0] < seen[0]:
                    last[source] = seen
        found = next(((s, float(last[s][1])) for s in self.sources if s in last), None)
        changed = found is not None and found != given
        state.update((*(found or given), *[x for s in self.sources for x in last.get(s, (None, None))]))
        if changed:
            yield pd.DataFrame({"key": [key[0]], "source": [found[0]], "value": [found[1]]})


def monitored(rows: DataFrame, late: str, min_delta: float, patience: int, from_step: int, budget: float, silence: float) -> DataFrame:
    """run, step, best, stale, stopped_at (-1: not), reason and elapsed of every run that a trigger brings rows or silence for (update mode), from a stream
    (run, id, ts, value); evaluations of a trigger are taken by time and id."""
    rows.sparkSession.conf.set(PROVIDER, ROCKS)
    timed = rows.withWatermark("ts", late).selectExpr("run", "id", "ts", "unix_micros(ts) / 1e6 AS at", "value")
    kind = rows.schema["run"].dataType.simpleString()
    monitor = RunMonitor(min_delta, patience, from_step, budget, silence)
    out = f"run {kind}, step long, best double, stale long, stopped_at long, reason string, elapsed double"
    return timed.groupBy("run").applyInPandasWithState(monitor.update, out, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def first_source(rows: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """key, source and value as FirstSource gives them, from a stream (key, id, source, value); other sources are left out."""
    rows.sparkSession.conf.set(PROVIDER, ROCKS)
    kind = rows.schema["key"].dataType.simpleString()
    known = rows.where(rows["source"].isin(*sources))
    chosen = FirstSource(sources)
    return known.groupBy("key").applyInPandasWithState(chosen.update, f"key {kind}, source string, value double", chosen.state, "update", GroupStateTimeout.NoTimeout)
