"""A sliding-window limiter: accepts an event if fewer than `limit` were accepted lately."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accepted(events: DataFrame, key: str, time: str, id_col: str, limit: int, seconds: int) -> DataFrame:
    """key, id and `accepted` of every event, in the order of time and id within a key.

    Each decision hangs on the ones before, so a key's events go through one task in order; the
    state is the last `limit` accepted times, so a key of any size needs bounded memory. Events
    without a key belong to nobody: nothing is decided about them (accepted is null).
    """
    width = seconds * 1_000_000

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: object = None
        last: deque[int] = deque(maxlen=limit)
        for f in frames:
            out = []
            for k, at in zip(f["k"], f["at"]):
                if k != current:
                    current, last = k, deque(maxlen=limit)
                ok = len(last) < limit or last[0] <= at - width
                if ok:
                    last.append(at)
                out.append(ok)
            yield pd.DataFrame({"k": f["k"], "id": f["id"], "accepted": out})

    every = events.select(
        F.col(key).alias("k"), F.col(id_col).alias("id"), F.unix_micros(F.col(time).cast("timestamp")).alias("at")
    )
    rows = every.where("k is not null")
    kinds = {n: t.simpleString() for n, t in ((x.name, x.dataType) for x in rows.schema)}
    in_order = rows.repartition("k").sortWithinPartitions("k", "at", "id")
    out = in_order.mapInPandas(each, f"k {kinds['k']}, id {kinds['id']}, accepted boolean")
    nobody = every.where("k is null").select("k", "id", F.lit(None).cast("boolean").alias("accepted"))
    return out.unionByName(nobody).withColumnsRenamed({"k": key, "id": id_col})
