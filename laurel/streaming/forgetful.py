"""Keyed machines as streams that wait for late rows and forget: `transformWithStateInPandas` with a watermark and event-time timers.

Rows wait in the state of their key until the watermark has passed them and are then answered in order of time, so rows that come late, but before
the watermark, change nothing in the answers: they are those of the batch. A key's machine is dropped by a timer once forgetting it changes no later answer.
Needs the RocksDB state store, which `session` sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor


class Waiting(StatefulProcessor):
    """The machine of one key and the rows that wait for it. A machine says its state (`kept`, `restored`), how long after a row it may be idle in microseconds (`horizon`), and whether it is (`idle`)."""

    def __init__(self, make, inputs: list[str], ident: str, names: list[str], columns: list[str], schema: str, state: int):
        self.make, self.inputs, self.ident, self.names, self.columns, self.schema, self.numbers = make, inputs, ident, names, columns, schema, state

    def init(self, handle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", ", ".join(f"s{k} double" for k in range(self.numbers)))
        self.rows = handle.getListState("rows", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            self.rows.appendList([tuple(r) for r in pdf[self.columns].astype(object).itertuples(index=False, name=None)])
            for ms in {int(us) // 1000 + 1 for us in pdf["us"]}:
                self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = pd.DataFrame(list(self.rows.get()) if self.rows.exists() else [], columns=self.columns)
        due = waiting["us"].astype("int64") <= passed
        now = waiting[due].sort_values(["us", self.ident])
        rest = waiting[~due]
        if len(now):
            self.rows.clear()
            if len(rest):
                self.rows.put([tuple(r) for r in rest.itertuples(index=False, name=None)])
            machine = self.make().restored(tuple(self.machine.get())) if self.machine.exists() else self.make()
            said = [machine.answer(*given) for given in zip(*(now[c].tolist() for c in self.inputs), strict=True)]
            self.machine.update(machine.kept())
            # where it has nothing to forget yet, the timer looks again
            self.handle.registerTimer(int(now["us"].iloc[-1] + machine.horizon()) // 1000 + 1)
            yield pd.DataFrame({c: now[c].tolist() for c in self.names[:-1]} | {self.names[-1]: said})
        elif not len(rest) and self.machine.exists() and self.make().restored(tuple(self.machine.get())).idle(passed):
            self.machine.clear()

    def close(self) -> None:
        pass


def answered(rows: DataFrame, delay: str, key: str, inputs: list[str], make, ident: str, out: str, state: int) -> DataFrame:
    """Answers of a stream (key, ident, us, ts, inputs) whose rows come at most `delay` late; state is the count of a machine's numbers."""
    names = [x.split()[0] for x in out.split(", ")]
    columns = list(dict.fromkeys([*names[:-1], ident, "us", *inputs]))
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    processor = Waiting(make, inputs, ident, names, columns, schema, state)
    return rows.withWatermark("ts", delay).groupBy(key).transformWithStateInPandas(processor, out, "append", "eventTime")
