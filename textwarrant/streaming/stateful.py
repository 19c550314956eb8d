"""Per-key state over time: rate limits, paced slots, remembered results; in batches and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def accepted(times: list[float], recent: list[float], limit: int, window: float) -> tuple[list[bool], list[float]]:
    """Which of ordered hits a limit of so many in a window takes; refused hits don't count. Also the hits to remember."""
    out = []
    for t in times:
        recent = [x for x in recent if t - x <= window]
        out.append(len(recent) < limit)
        if out[-1]:
            recent = [*recent, t]
    return out, recent


def rate_limit(events: DataFrame, key: str, at: str, id_col: str, limit: int = 40, window: float = 60.0) -> DataFrame:
    """(key, id, accepted) of each hit. ``at`` is in seconds. A key's hits are one group: they depend on one another."""
    schema = f"{key} {events.schema[key].dataType.simpleString()}, {id_col} {events.schema[id_col].dataType.simpleString()}, accepted boolean"

    def of(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([at, id_col])
        return group[[key, id_col]].assign(accepted=accepted(group[at].tolist(), [], limit, window)[0])

    return events.select(key, id_col, at).groupBy(key).applyInPandas(of, schema)


class RateLimiter(StatefulProcessor):
    """The same for a stream whose batches come in the order of time."""

    def __init__(self, limit: int, window: float, at: str, id_col: str) -> None:
        self.limit, self.window, self.at, self.id_col = limit, window, at, id_col

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values([self.at, self.id_col])
        held = [r[0] for r in self.recent.get()]
        taken, held = accepted(batch[self.at].tolist(), held, self.limit, self.window)
        self.recent.put([(t,) for t in held])
        yield pd.DataFrame({"key": [key[0]] * len(batch), "id": batch[self.id_col].tolist(), "accepted": taken})

    def close(self) -> None:
        pass


def stream_rate_limit(events: DataFrame, key: str, at: str, id_col: str, limit: int = 40, window: float = 60.0) -> DataFrame:
    """``rate_limit`` of a streaming table: (key, id, accepted)."""
    rows = events.select(key, id_col, at)
    schema = f"key {events.schema[key].dataType.simpleString()}, id {events.schema[id_col].dataType.simpleString()}, accepted boolean"
    return rows.groupBy(key).transformWithStateInPandas(RateLimiter(limit, window, at, id_col), schema, "Append", "None")


def paced_slots(events: DataFrame, key: str, at: str, id_col: str, per_minute: Column) -> DataFrame:
    """(key, id, slot): when each call may go, one every 60 / per_minute seconds.

    A slot is the later of the call's time and the one before plus the gap c; over
    a key's calls in order that is i * c + max over j up to i of (t_j - j * c).
    """
    order = Window.partitionBy(key).orderBy(at, id_col)
    gap = F.lit(60.0) / per_minute
    rows = events.select(key, id_col, at, gap.alias("gap"), (F.row_number().over(order) - 1).alias("i"))
    ahead = F.max(F.col(at) - F.col("i") * F.col("gap")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(key, id_col, F.round(F.col("i") * F.col("gap") + ahead, 6).alias("slot"))


def remembered(events: DataFrame, key: str, at: str, id_col: str, item: str, ttl: float, most: int, refresh: bool = True) -> DataFrame:
    """(key, id, hit): whether a result was still remembered; each key has a memory of its own.

    A result is good for ``ttl`` seconds; of more than ``most`` the one used (or,
    without ``refresh``, stored) longest ago goes. A miss stores its result.
    """
    schema = f"{key} {events.schema[key].dataType.simpleString()}, {id_col} {events.schema[id_col].dataType.simpleString()}, hit boolean"

    def of(group: pd.DataFrame) -> pd.DataFrame:
        group, memory, hits = group.sort_values([at, id_col]), {}, []
        for what, t in zip(group[item], group[at], strict=True):
            hit = what in memory and t - memory[what] < ttl
            if hit and refresh:
                memory[what] = memory.pop(what)
            elif not hit:
                memory[what] = t  # a result stored again keeps its turn
                if len(memory) > most:
                    del memory[next(iter(memory))]
            hits.append(hit)
        return group[[key, id_col]].assign(hit=hits)

    return events.select(key, id_col, at, item).groupBy(key).applyInPandas(of, schema)


def anchored_refresh(events: DataFrame, key: str, at: str, id_col: str, keep: float = 300.0) -> DataFrame:
    """(key, id, hit): a single value kept for ``keep`` seconds from when it was last made."""
    return remembered(events.withColumn("_one", F.lit(1)), key, at, id_col, "_one", keep, 1)
