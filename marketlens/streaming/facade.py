"""Streaming forms of the state rules: an addition, the rules themselves are batch rules.

Probe flips keep the last status per service; alert notices keep the last time
of sending per alert and stay silent for 24 hours. What a key's state can no
longer change, or is older than the caller wants to remember, falls when the
watermark has passed it, so the number of states follows the keys of late, not
all keys ever seen. Retention is a watermark on the event time, so rows later
than the kept days are dropped as late.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_HOUR_MS = 3_600_000


def _micros(at: pd.Series) -> np.ndarray:
    return at.to_numpy().astype("datetime64[us]").astype(np.int64)


def _until(state: GroupState, ms: float) -> None:
    """The state falls when the watermark passes this time."""
    state.setTimeoutTimestamp(int(max(ms, state.getCurrentWatermarkMs() + 1)))


def probe_flips(probes: DataFrame, late: str = "1 hour", forget_hours: int = 30 * 24) -> DataFrame:
    """Streaming probes (service, id, at, status) to the probes at which a service came up.

    A service that was not heard of for ``forget_hours`` is new again: its next
    probe that is up is a flip. Rows later than ``late`` are dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            return state.remove()
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        at, status = _micros(rows["at"]), rows["status"].to_numpy(object)
        last, when = state.get if state.exists else (None, at[0])
        forgotten = np.diff(at, prepend=when) > forget_hours * _HOUR_MS * 1000  # whether or not its state has fallen yet
        flips = (status == "up") & ((np.array([last, *status[:-1]], object) != "up") | forgotten)
        state.update((status[-1], int(at[-1])))
        _until(state, at[-1] / 1000 + forget_hours * _HOUR_MS)
        yield rows[flips][["service", "id", "at"]]

    keyed = probes.withWatermark("at", late).groupBy("service")
    return keyed.applyInPandasWithState(step, "service long, id long, at timestamp", "status string, at long", "append", GroupStateTimeout.EventTimeTimeout)


def alert_notices(hits: DataFrame, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """Streaming hits (product_id, subscriber, at, price) to notices: of an alert the first, and each next one more than ``hours`` after the notice before.

    Rows later than ``late`` are dropped; a state falls when its silence is over.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            return state.remove()
        rows = pd.concat(list(batches)).sort_values("at")
        at = _micros(rows["at"])
        silence, sent = hours * _HOUR_MS * 1000, []
        i = int(np.searchsorted(at, state.get[0] + silence, side="right")) if state.exists else 0
        while i < len(at):  # from notice to notice
            sent.append(i)
            i = int(np.searchsorted(at, at[i] + silence, side="right"))
        last = int(at[sent[-1]]) if sent else state.get[0]
        state.update((last,))
        _until(state, (last + silence) / 1000)
        yield rows.iloc[sent][["product_id", "subscriber", "at", "price"]]

    keyed = hits.withWatermark("at", late).groupBy("product_id", "subscriber")
    return keyed.applyInPandasWithState(step, "product_id long, subscriber long, at timestamp, price double", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def daily_minimum(observations: DataFrame, days: int = 90) -> DataFrame:
    """Streaming observations (product_id, store_id, at, price) to lowest prices per day, late rows beyond `days` dropped."""
    return observations.withWatermark("at", f"{days} days").groupBy(F.window("at", "1 day"), "product_id", "store_id").agg(F.min("price").alias("price"))
