"""Alerts on trust balances, as the ledger comes in: when a matter's balance crosses between green, yellow and red, and
when it has stood in yellow for so many days without a deposit that mends it.

State is a row for each matter: balance, status, since when, and whether it was reminded. A reminder is due when later
rows of the matter show it, or else when the watermark passes it (an event-time timer). Rows of a batch are taken in
the order of time and id; rows that come in a later batch count from when they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "matter_id long, at timestamp, kind string, before string, after string"


def status(cents: int, floor: int) -> str:
    return "red" if cents < 0 else "yellow" if cents < floor else "green"


class Alerts(StatefulProcessor):
    """Rows: matter_id, id, ts (milliseconds), cents (signed), floor (cents below which a balance is yellow)."""

    def __init__(self, days: int) -> None:
        self.wait = days * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "cents long, status string, since long, reminded boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        cents, now, since, reminded = self.state.get() or (0, "", 0, False)
        out, due = [], since + self.wait if now == "yellow" and not reminded else None
        columns = zip(*([x[c].to_numpy() for c in ("ts", "id", "cents", "floor")] for x in rows), strict=True)
        ts, ids, amounts, floors = (np.concatenate(c) for c in columns)
        order = np.lexsort((ids, ts))
        for at, amount, floor in zip(ts[order].tolist(), amounts[order].tolist(), floors[order].tolist(), strict=True):
            if now == "yellow" and not reminded and since + self.wait <= at:
                out.append((key[0], since + self.wait, "still yellow", "yellow", "yellow"))
                reminded = True
            cents += int(amount)
            new = status(cents, int(floor))
            if new != now:
                out.append((key[0], int(at), "crossed", now, new))
                now, since, reminded = new, int(at), False
        self.state.update((cents, now, since, reminded))
        wanted = since + self.wait if now == "yellow" and not reminded else None
        if due != wanted:
            if due is not None:
                self.handle.deleteTimer(due)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        if out:  # most batches of most matters tell nothing, and a frame costs more than their rows
            yield _frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        cents, now, since, reminded = self.state.get()
        if now == "yellow" and not reminded:
            self.state.update((cents, now, since, True))
            yield _frame([(key[0], since + self.wait, "still yellow", "yellow", "yellow")])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    matter, at, kind, before, after = zip(*rows, strict=True)
    return pd.DataFrame({"matter_id": np.array(matter, np.int64), "at": np.array(at, "datetime64[ms]").astype("datetime64[ns]"), "kind": kind, "before": before, "after": after})


def alerts(ledger: DataFrame, matters: DataFrame, days: int = 30, late: str = "0 seconds") -> DataFrame:
    """matter_id, at, kind, before, after from a ledger stream (id, matter_id, time, transaction_type, amount) and the
    matters. The session's state store must be the one named by PROVIDER."""
    floors = matters.selectExpr("id AS matter_id", "CAST(retainer_amount * refresh_trigger_pct * 100 AS BIGINT) AS floor")
    rows = ledger.withWatermark("time", late).join(floors, "matter_id")
    signed = "CAST(CASE WHEN transaction_type = 'deposit' THEN amount ELSE -amount END * 100 AS BIGINT) AS cents"
    keyed = rows.selectExpr("matter_id", "id", "time", "unix_millis(time) AS ts", signed, "floor").groupBy("matter_id")
    return keyed.transformWithStateInPandas(Alerts(days), OUT, "Append", "EventTime")
