"""The kernels of ``quern.operators.filters`` on streams: state by key, rows in event-time order.

Rows wait until the watermark has passed them, are then put in order and run through the kernel, whose state stays in the
state store. A key has one timer, at its earliest waiting row, so its waiting rows are read once a batch. Rows later than the
watermark are dropped by Spark before they come here.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.filters import Kernel

#: The state store that state by key needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class KernelProcessor(StatefulProcessor):
    def __init__(self, kernel: Kernel, key: str, time: str, tie: str, inputs: Sequence[str]) -> None:
        self.kernel, self.key, self.time, self.tie, self.columns = kernel, key, time, tie, list(inputs)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "v array<double>")
        self.waiting = handle.getListState("waiting", "t timestamp, i long, x array<double>")
        self.timer = handle.getValueState("timer", "at long")

    def wake(self, at: int) -> None:
        """Let the key's timer ring at ``at`` milliseconds, unless it rings before."""
        if self.timer.exists():
            set_to = self.timer.get()[0]
            if set_to <= at:
                return
            self.handle.deleteTimer(set_to)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        first = None
        for table in rows:
            new = [(t.to_pydatetime(), int(i), [float(v) for v in x]) for t, i, *x in table[[self.time, self.tie, *self.columns]].itertuples(index=False)]
            self.waiting.appendList(new)
            first = min([table[self.time].min(), *([] if first is None else [first])])
        if first is not None:
            self.wake(int(first.timestamp() * 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        mark = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1]))
        due = [r for r in rows if pd.Timestamp(r[0]).tz_localize(None) <= mark]
        later = rows[len(due) :]
        self.timer.clear()
        if later:
            self.wake(int(pd.Timestamp(later[0][0]).timestamp() * 1000))
        if due:
            state = list(self.state.get()[0]) if self.state.exists() else None
            state, out = self.kernel.run([list(r[2]) for r in due], state)
            self.state.update((state,))
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
            yield pd.DataFrame({self.key: [key[0]] * len(due), self.time: [r[0] for r in due], self.tie: [r[1] for r in due]} | {o: [y[k] for y in out] for k, o in enumerate(self.kernel.outputs)})


def filtered(stream: DataFrame, kernel: Kernel, key: str, time: str, tie: str, inputs: Sequence[str], delay: str = "0 seconds") -> DataFrame:
    """(key, time, tie, the kernel's outputs) of a stream; ``time`` is a timestamp, rows at one time come in the order of ``tie``."""
    types = dict(stream.dtypes)
    schema = ", ".join([f"`{key}` {types[key]}", f"`{time}` timestamp", f"`{tie}` long", *(f"{o} double" for o in kernel.outputs)])
    return stream.withWatermark(time, delay).groupBy(key).transformWithStateInPandas(KernelProcessor(kernel, key, time, tie, inputs), outputStructType=schema, outputMode="Append", timeMode="EventTime")
