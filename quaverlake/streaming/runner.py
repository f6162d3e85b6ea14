"""Runs a machine over a stream or a table; both give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .machines import Machine


def _plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    return v.item() if hasattr(v, "item") else v


def _rows(machine: Machine, part: pd.DataFrame) -> Iterator[tuple]:
    first = machine.reads[0]
    part = part.sort_values([first, *[c for c in machine.reads[1:]]], kind="stable")
    for row in part[list(machine.reads)].itertuples(index=False, name=None):
        yield tuple(map(_plain, row))


def _columns(machine: Machine, key: str) -> list[str]:
    return [key, *[f.strip().split(" ")[0] for f in machine.gives.split(",")]]


def over_table(df: DataFrame, machine: Machine, key: str) -> DataFrame:
    """The machine over all samples of each key, in the order of its columns, nulls last.

    Keys are shuffled and sorted by Spark; a task then reads its rows once and holds one key's state, never a key's rows.
    """
    kind, names = df.schema[key].dataType.simpleString(), [key, *machine.reads]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun, own, state = False, None, ()
        for batch in batches:
            out = []
            for row in batch[names].itertuples(index=False, name=None):
                k, *sample = map(_plain, row)
                if not begun or k != own:
                    out += [(own, *m) for m in machine.finish(state)] if begun else []
                    begun, own, state = True, k, machine.start()
                state, more = machine.step(state, tuple(sample))
                out += [(k, *m) for m in more]
            yield pd.DataFrame(out, columns=_columns(machine, key))
        if begun:
            yield pd.DataFrame([(own, *m) for m in machine.finish(state)], columns=_columns(machine, key))

    rows = df.select(*names).repartition(key).sortWithinPartitions(*map(F.asc_nulls_last, names))
    return rows.mapInPandas(run, f"{key} {kind}, {machine.gives}")


def over_stream(df: DataFrame, machine: Machine, key: str, forget_ms: int = 3_600_000) -> DataFrame:
    """The machine over a stream. Keys without a sample for `forget_ms` are finished and start anew.

    Samples of a key must arrive in order, or together in one micro-batch; then how a stream is
    cut into micro-batches changes nothing.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(own: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = machine.finish(tuple(state.get))
            state.remove()
            yield pd.DataFrame([(own[0], *m) for m in last], columns=_columns(machine, key))
            return
        now = tuple(state.get) if state.exists else machine.start()
        part, out = pd.concat(list(parts)), []
        for row in _rows(machine, part):
            now, more = machine.step(now, row)
            out += [(own[0], *m) for m in more]
        state.update(now)
        state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame(out, columns=_columns(machine, key))

    keyed = df.select(key, *machine.reads).groupBy(key)
    return keyed.applyInPandasWithState(run, f"{key} {kind}, {machine.gives}", machine.state, "append", GroupStateTimeout.ProcessingTimeTimeout)


def rescan_on(trigger: DataFrame, rescan: Callable[[DataFrame, int], None], every: str = "60 seconds", checkpoint: str | None = None):
    """Starts a query that calls rescan(batch, number) at each trigger, for an index that follows its folders."""
    writer = trigger.writeStream.foreachBatch(rescan).trigger(processingTime=every)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


class _Ordered(StatefulProcessor):
    """Holds a key's samples until the watermark has passed them, then hands them to a machine in the order that a table has."""

    def __init__(self, machine: Machine, columns: list[str], held: str, forget_ms: int):
        self.machine, self.columns, self.held, self.forget_ms = machine, columns, held, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.held)
        self.state = handle.getValueState("state", self.machine.state)
        self.last = handle.getValueState("last", "t long")

    def _timer(self, at: int) -> None:
        if at not in set(self.handle.listTimers()):
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        new = [tuple(map(_plain, r)) for part in rows for r in part[list(self.machine.reads)].itertuples(index=False, name=None)]
        new = [r for r in new if r[0] is not None and r[0] >= passed]  # what is later than the watermark allows is left out
        if new:
            self.waiting.appendList(new)
            self._timer(min(r[0] for r in new))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, out = timerValues.getCurrentWatermarkInMs(), []
        waiting = [tuple(map(_plain, r)) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in waiting if r[0] < passed), key=lambda r: [(v is None, v) for v in r])
        rest = [r for r in waiting if r[0] >= passed]
        now = tuple(map(_plain, self.state.get())) if self.state.exists() else None
        last = self.last.get()[0] if self.last.exists() else None
        for row in ready:
            if now is not None and last is not None and row[0] - last > self.forget_ms:
                out += self.machine.finish(now)
                now = None
            now, more = self.machine.step(self.machine.start() if now is None else now, row)
            out += more
            last = row[0]
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if now is not None and not rest and last + self.forget_ms < passed:
            out += self.machine.finish(now)
            self.state.clear(), self.last.clear()
        elif now is not None:
            self.state.update(now), self.last.update((last,))
            self._timer(min(r[0] for r in rest) if rest else last + self.forget_ms)
        elif rest:
            self._timer(min(r[0] for r in rest))
        if out:
            yield pd.DataFrame([(key[0], *m) for m in out], columns=self.columns)

    def close(self) -> None:
        pass


def over_late_stream(df: DataFrame, machine: Machine, key: str, delay: str = "10 seconds", forget_ms: int = 3_600_000) -> DataFrame:
    """The machine over a stream whose samples come in any order, up to `delay` late by their `t` in ms.

    A sample waits in the key's state until the watermark has passed it; then all such samples go to the machine in the order
    of over_table(), so however a stream is cut and shuffled within the delay, it gives the rows of the table. Later samples and
    those without a time are left out. A key that has had no sample for `forget_ms` of event time is finished and starts anew.
    Needs a state store with column families (RocksDB).
    """
    kind = df.schema[key].dataType.simpleString()
    at = machine.reads[0]
    held = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in machine.reads)
    gives = f"{key} {kind}, {machine.gives}"
    rows = df.select(key, *machine.reads, F.timestamp_millis(F.col(at).cast("long")).alias("event_time")).withWatermark("event_time", delay)
    ordered = _Ordered(machine, _columns(machine, key), held, forget_ms)
    return rows.groupBy(key).transformWithStateInPandas(ordered, outputStructType=_parsed(df, gives), outputMode="append", timeMode="eventTime")


def _parsed(df: DataFrame, schema: str):
    return df.sparkSession.createDataFrame([], schema).schema
