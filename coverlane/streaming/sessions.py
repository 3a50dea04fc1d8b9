"""The fixed-lifetime session as a stateful stream: one login time per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from coverlane.operators.sessions import STEP_COLUMNS, advance

STATE = "t bigint, seq bigint"


class SessionProcessor(StatefulProcessor):
    """Same rules as the batch fold. Rows of one batch are put in order first, so batches
    must arrive in order of time; ``maxFilesPerTrigger`` bounds what one key brings."""

    def __init__(self, key: str, ttl: float) -> None:
        self.key, self.ttl_micros = key, round(ttl * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.login = handle.getValueState("login", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["t", "seq"])
        login = tuple(self.login.get()) if self.login.exists() else None
        marks = []
        for row in zip(*(batch[c].tolist() for c in STEP_COLUMNS)):
            mark, _, login = advance(login, row, self.ttl_micros)
            marks.append(mark)
        if login is None:
            self.login.clear()
        else:
            self.login.update(login)
        yield pd.DataFrame({self.key: key[0], "t": batch["t"], "seq": batch["seq"], "phase": marks})

    def close(self) -> None:
        pass


def session_stream(steps: DataFrame, key: str, ttl: float) -> DataFrame:
    """Streamed rows with their phase. Needs the RocksDB state store provider."""
    kind = steps.schema[key].dataType.simpleString()
    return steps.groupBy(key).transformWithStateInPandas(
        statefulProcessor=SessionProcessor(key, ttl), outputStructType=f"{key} {kind}, t bigint, seq bigint, phase string",
        outputMode="append", timeMode="none")
