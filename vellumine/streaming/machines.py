"""Decisions that hang on a key's earlier ones: balances, token families, sync outcomes.

A machine is a pure step from a state and an event to the next state and an outcome. One
processor keeps the state of every key in Spark's state store, so a stream goes on after a
restart where it stopped, and memory is bounded by one micro-batch of a key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Balance:
    """Credits (positive amounts) are accepted; a debit is only while the balance covers it. Event: amount."""

    start: int = 0

    def step(self, state: dict | None, event: dict) -> tuple[dict, str, dict]:
        balance = self.start if state is None else state["balance"]
        amount = event["amount"]
        if amount is None:
            return {"balance": balance}, "IGNORED", {"balance": balance}
        accepted = balance + amount >= 0 or amount >= 0
        balance += amount if accepted else 0
        return {"balance": balance}, "ACCEPTED" if accepted else "REFUSED", {"balance": balance}


@dataclass(frozen=True)
class TokenFamily:
    """A family's token is exchanged once. One that was exchanged before revokes the family; an unknown one does nothing.

    Event: token (presented; null opens the family) and next (given out in exchange).
    """

    def step(self, state: dict | None, event: dict) -> tuple[dict | None, str, dict]:
        if event["token"] is None:
            if state is not None:
                return state, "EXISTS", {}
            return {"current": event["next"], "used": [], "revoked": False}, "OPENED", {}
        if state is None:
            return None, "UNKNOWN", {}
        if state["revoked"]:
            return state, "REVOKED", {}
        if event["token"] == state["current"]:
            return {"current": event["next"], "used": [*state["used"], event["token"]], "revoked": False}, "ROTATED", {}
        if event["token"] in state["used"]:
            return state | {"revoked": True}, "REUSED", {}
        return state, "UNKNOWN", {}


@dataclass(frozen=True)
class Sync:
    """A record is synced when its digest is new or the last try failed, `tries` times at most for one digest.

    Event: digest, and error (null if the try, should it be made, succeeds). Outcomes: OK, SKIPPED
    (unchanged), FAILED (to be tried again) and GIVEN_UP (no more tries for this digest).
    """

    tries: int = 3

    def step(self, state: dict | None, event: dict) -> tuple[dict, str, dict]:
        same = state is not None and state["digest"] == event["digest"]
        if same and state["status"] == "OK":
            return state, "SKIPPED", {"tries": state["tries"]}
        tries = state["tries"] if same else 0
        if tries >= self.tries:
            return state, "GIVEN_UP", {"tries": tries}
        tries += 1
        status = "OK" if event["error"] is None else "FAILED"
        return {"digest": event["digest"], "status": status, "tries": tries}, status, {"tries": tries}


class _Processor(StatefulProcessor):
    def __init__(self, machine: Any, key: str, columns: list[str], numbers: list[str], ttl_ms: int | None):
        self.machine, self.key, self.columns, self.numbers, self.ttl_ms = machine, key, columns, numbers, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "json string", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        held = self.state.get()
        state = json.loads(held[0]) if held is not None else None
        out = []
        for values in events[[*[f"c{n}" for n in range(len(self.columns))], "at", "id"]].itertuples(index=False, name=None):
            event = {c: None if pd.isna(v) else v.item() if hasattr(v, "item") else v for c, v in zip(self.columns, values)}
            state, outcome, more = self.machine.step(state, event)
            out.append((key[0], values[-2], values[-1], outcome, *[more.get(n) for n in self.numbers]))
        if state is not None:
            self.state.update((json.dumps(state),))
        frame = pd.DataFrame(out, columns=[self.key, "at", "id", "outcome", *self.numbers])
        yield frame.astype({n: "Int64" for n in self.numbers})

    def close(self) -> None:
        pass


def decisions(
    events: DataFrame, machine: Any, key: str, id_col: str, time: Column, columns: list[str], numbers: tuple[str, ...] = (), ttl_ms: int | None = None
) -> DataFrame:
    """key, at (microseconds), id, outcome and the machine's `numbers` of every event of a stream.

    Within a micro-batch a key's events are taken in the order of time and id; batches follow in
    the order they come. Events without a key, an id or a time are nobody's and dropped; ids are numbers. State
    that no event touched for ttl_ms (processing time) is forgotten; such a stream looks for old
    state all the time, so start it by a time trigger, not by availableNow. A key's events go
    through one task, as each decision needs the one before.
    """
    use_store(events.sparkSession)
    own = [F.col(c).alias(f"c{n}") for n, c in enumerate(columns)]  # names of the state's own, so none can clash
    given = events.select(F.col(key).alias("key"), F.unix_micros(time.cast("timestamp")).alias("at"), F.col(id_col).cast("long").alias("id"), *own)
    given = given.where("key is not null and at is not null and id is not null")
    kind = given.schema["key"].dataType.simpleString()
    out = f"{key} {kind}, at long, id long, outcome string" + "".join(f", {n} long" for n in numbers)
    processor = _Processor(machine, key, columns, list(numbers), ttl_ms)
    return given.groupBy("key").transformWithStateInPandas(processor, out, "append", "processingTime" if ttl_ms else "none")


def use_store(spark: SparkSession) -> None:
    """State of this kind needs the RocksDB store; a store that the session names already stays."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
