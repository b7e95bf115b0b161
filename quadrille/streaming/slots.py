"""Tile slots as keyed streaming state: requests start generations, payloads land only in the one they belong to."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "set_id bigint, tile bigint, seq bigint, what string, state string, generation bigint, bytes bigint"
STATE = "state string, generation bigint, bytes bigint, last_touched bigint"


def run_slots(events: DataFrame, grace: int = 600) -> DataFrame:
    """Slot changes from events (set_id, tile, seq, frame, kind, generation, bytes).

    Kinds: request (starts ``generation`` in an empty slot), payload (lands if its generation is awaited, else is
    dropped), failure, touch (keeps), cancel (empties an awaiting slot), sweep (evicts what nothing touched for over
    ``grace`` frames).
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        what, generation, size, seen = state.get if state.exists else ("NotLoaded", -1, 0, 0)
        out = []
        rows = pd.concat(list(frames)).sort_values("seq")
        for e in rows.itertuples():
            done = None
            if e.kind == "request" and what == "NotLoaded":
                what, generation, done = "InFlight", int(e.generation), "started"
            elif e.kind in ("payload", "failure"):
                if what == "InFlight" and generation == e.generation:
                    what, size, done = ("Ready", int(e.bytes), "landed") if e.kind == "payload" else ("Failed", 0, "failed")
                    seen = int(e.frame)
                else:
                    done = "dropped"
            elif e.kind == "touch":
                seen = int(e.frame)
            elif e.kind == "cancel" and what == "InFlight":
                what, generation, done = "NotLoaded", -1, "cancelled"
            elif e.kind == "sweep" and what == "Ready" and max(0, int(e.frame) - seen) > grace:
                what, size, done = "NotLoaded", 0, "evicted"
            if done:
                out.append((key[0], key[1], int(e.seq), done, what, generation, size))
        state.update((what, generation, size, seen))
        yield pd.DataFrame(out, columns=["set_id", "tile", "seq", "what", "state", "generation", "bytes"])

    return events.groupBy("set_id", "tile").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
