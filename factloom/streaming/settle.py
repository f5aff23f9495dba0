"""Settling, as a stream: an item goes on once its mark has stayed the same for long enough.

Each sighting of an item carries a mark (a fingerprint with the rules' hash). State is kept
by key: the mark, since when it stands, and when it was last seen. A new mark starts
the wait again, which no session window does, so this is a stateful operator with an event-time timer;
state of an item is dropped once it has gone on or hasn't been seen for ``forget_seconds``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "key string, mark string, since timestamp, settled timestamp"
STATE = "mark string, since double, seen double, gone boolean"


def settle(sightings: DataFrame, settle_seconds: float, forget_seconds: float = 3600.0) -> DataFrame:
    """(key, mark, since, settled) once for each mark that stands for ``settle_seconds`` between two sightings.

    ``sightings``: a stream of (key string, ts timestamp, mark string) with a watermark on ts. Sightings
    that come in one batch are taken in the order of ts; those older than the state's last are passed over.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        mark, since, seen, gone = state.get if state.exists else (None, 0.0, float("-inf"), False)
        rows = pd.concat(list(frames)).sort_values(["ts", "mark"])
        out = []
        for ts, new in zip(rows["ts"], rows["mark"]):
            now = ts.timestamp()
            if now < seen:
                continue
            if new != mark:
                mark, since, gone = new, now, False
            elif not gone and now - since >= settle_seconds:
                gone = True
                out.append((key[0], mark, pd.Timestamp(since, unit="s"), pd.Timestamp(now, unit="s")))
            seen = now
        state.update((mark, since, seen, gone))
        state.setTimeoutTimestamp(max(int((seen + forget_seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "mark", "since", "settled"])

    return sightings.groupBy("key").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
