"""The lifecycle fold as a stream: one state a key, events in the order of their arrival batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomlake.session import ship

OUT = "key string, state string, shards long, startup double, shutdowns long, events long"


def advance(state: tuple, kind: str, value: float) -> tuple:
    name, shards, startup, shutdowns, events = state
    if kind == "listener":
        name, shards = "live", int(value)
    elif kind == "ready":
        name, startup = "ready" if name == "live" else name, float(value)
    elif kind == "shutdown" and name in ("live", "ready"):
        name, shutdowns = "draining", shutdowns + 1
    elif kind == "stopped":
        name = "stopped"
    return name, shards, startup, shutdowns, events + 1


def lifecycle_stream(events: DataFrame) -> DataFrame:
    """A row for each key and batch with its state after the events so far.

    events: a stream of key string, seq long, kind string, value double; within a batch they
    are taken in the order of seq.
    """
    ship(events.sparkSession)

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = held.get if held.exists else ("stopped", 0, 0.0, 0, 0)
        batch = pd.concat(frames).sort_values("seq", kind="stable")
        for kind, value in zip(batch["kind"], batch["value"]):
            state = advance(tuple(state), kind, value)
        held.update(tuple(state))
        yield pd.DataFrame([(key[0], *state)], columns=[c.split()[0] for c in OUT.split(", ")])

    schema = "state string, shards long, startup double, shutdowns long, events long"
    return events.groupBy("key").applyInPandasWithState(run, OUT, schema, "update", GroupStateTimeout.NoTimeout)
