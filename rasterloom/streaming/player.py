"""Players of an animation as a stream: state by player, and windows over event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.timeline import SHOW


def playing(ticks: DataFrame, loops: int = 3) -> DataFrame:
    """player_id, frame, loops, finished for each player and micro-batch; ticks: player_id, seq, dt_ms.

    The state of a player is the time that it has played; ticks of a batch are taken in the order of seq.
    """
    total = sum(SHOW)

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        t = state.get[0] if state.exists else 0
        t += sum(int(p["dt_ms"].sum()) for p in parts)
        state.update((t,))
        over = bool(loops) and t >= loops * total
        within, frame = t % total, 0
        while not over and frame + 1 < len(SHOW) and within >= sum(SHOW[: frame + 1]):
            frame += 1
        yield pd.DataFrame({"player_id": [key[0]], "frame": [len(SHOW) - 1 if over else frame], "loops": [loops if over else t // total], "finished": [over]})

    return ticks.groupBy("player_id").applyInPandasWithState(step, "player_id long, frame int, loops long, finished boolean", "t long", "update", "NoTimeout")


def activity(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events and their values by type and window of event time; what is later than `late` doesn't count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
