"""The adaptive coefficient folded over a stream of updates, by run."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor


class Coefficient(StatefulProcessor):
    """Keeps one number for each run: the coefficient so far."""

    def __init__(self, start: float, target: float, horizon: float, batch: float):
        self.start, self.target, self.rate = start, target, batch / horizon

    def init(self, handle) -> None:
        self.state = handle.getValueState("coefficient", "value double")

    def handleInputRows(self, key, rows, timerValues):
        now = self.state.get()[0] if self.state.exists() else self.start
        updates = pd.concat(list(rows)).sort_values("step", kind="stable")
        share = updates["kl"].to_numpy(dtype=float, na_value=np.nan) / self.target - 1
        factor = np.where(np.isnan(share), 1.0, 1 + np.clip(share, -0.2, 0.2) * self.rate)
        after = now * np.cumprod(factor)
        self.state.update((float(after[-1]),))
        yield pd.DataFrame({"run": key[0], "step": updates["step"].to_numpy(), "coefficient": after})

    def close(self) -> None:
        pass


def streaming_coefficient(updates: DataFrame, start: float, target: float, horizon: float, batch: float) -> DataFrame:
    """run, step and the coefficient after it, of a stream of (run, step, kl) with a string run and a long step.

    Rows of one trigger are taken by step; a row of an earlier step that comes with a later trigger multiplies what
    there is then, so a run's last coefficient doesn't depend on how its rows were dealt over triggers.  A null kl changes
    nothing.  Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    by = updates.select("run", "step", "kl").groupBy("run")
    return by.transformWithStateInPandas(Coefficient(start, target, horizon, batch), "run string, step long, coefficient double", "Append", "None")
