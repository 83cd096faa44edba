"""Players that tick, pause, play, seek and reset: one machine for streams and tables, with loop and finish events.

Rows are player_id, seq, kind and value; kind is tick (value: milliseconds), pause, play, seek_frame, seek_time or reset, and
rows of other kinds change nothing.  Each row gives one row: what shows after it, and what happened in it.  In a
stream the state of a player is kept between micro-batches; in a table a player's rows are read in order, batch by batch, with
its state alone in memory.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.timeline import SHOW
from ..sources.tables import table


class Player(NamedTuple):
    """Milliseconds since the animation's start (over its end only after a seek), loops done, and whether it has ended or plays."""

    at: int = 0
    loops: int = 0
    finished: bool = False
    playing: bool = True


SHOWN = "player_id long, seq long, frame int, loops long, finished boolean, playing boolean, looped long, ended boolean"


class Machine:
    """An animation of frames with these delays (10 where none is given), shown `loops` times (0: without end)."""

    def __init__(self, delays: tuple[int, ...] = SHOW, loops: int = 3):
        self.starts = list(accumulate((d if d > 0 else 10 for d in delays), initial=0))
        self.total, self.loops = self.starts.pop(), loops

    def frame(self, at: int) -> int:
        return bisect_right(self.starts, at) - 1

    def after(self, p: Player, kind: str, value: int | None) -> tuple[Player, int, bool]:
        """The player after a row, how many loops ended in it, and whether the whole did."""
        value = int(value or 0)
        if kind == "tick":
            if value <= 0 or p.finished or not p.playing:
                return p, 0, False
            around, left = divmod(p.at + value, self.total)
            most = max(1, self.loops - p.loops)
            if self.loops and around >= most:
                return Player(self.starts[-1], p.loops + most, True, False), most, True
            return p._replace(at=left, loops=p.loops + around), around, False
        if kind in ("pause", "play"):
            return p._replace(playing=kind == "play"), 0, False
        if kind == "seek_frame":
            return p._replace(at=self.starts[min(max(value, 0), len(self.starts) - 1)], finished=False), 0, False
        if kind == "seek_time":
            return p._replace(at=max(value, 0), finished=False), 0, False
        return (Player() if kind == "reset" else p), 0, False

    def shown(self, row: tuple, p: Player, looped: int, ended: bool) -> tuple:
        at = min(p.at, self.total - 1) if self.loops else p.at % self.total  # over the end only after a seek
        return (*row, self.frame(at), p.loops, p.finished, p.playing, looped, ended)


def rows_of(part: pd.DataFrame) -> Iterator[tuple]:
    return zip(part["player_id"].tolist(), part["seq"].tolist(), part["kind"].tolist(), part["value"].tolist())


def frame_of(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SHOWN.split(", ")])


def controlled(controls: DataFrame, machine: Machine) -> DataFrame:
    """SHOWN for each row of a table, by player and in the order of seq."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, player = object(), Player()
        for part in parts:
            out = []
            for id_, seq, kind, value in rows_of(part):
                if id_ != own:
                    own, player = id_, Player()
                player, looped, ended = machine.after(player, kind, None if pd.isna(value) else value)
                out.append(machine.shown((id_, seq), player, looped, ended))
            yield frame_of(out)

    rows = controls.select(F.col("player_id").cast("long"), F.col("seq").cast("long"), "kind", F.col("value").cast("long"))
    return rows.repartition("player_id").sortWithinPartitions("player_id", "seq").mapInPandas(run, SHOWN)


def controlled_stream(controls: DataFrame, machine: Machine) -> DataFrame:
    """SHOWN for each row of a stream; rows of one micro-batch are taken in the order of seq."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        player, out = Player(*state.get) if state.exists else Player(), []
        for id_, seq, kind, value in sorted((r for part in parts for r in rows_of(part)), key=lambda r: r[1]):
            player, looped, ended = machine.after(player, kind, None if pd.isna(value) else value)
            out.append(machine.shown((id_, seq), player, looped, ended))
        state.update(tuple(player))
        yield frame_of(out)

    rows = controls.select(F.col("player_id").cast("long"), F.col("seq").cast("long"), "kind", F.col("value").cast("long"))
    return rows.groupBy("player_id").applyInPandasWithState(step, SHOWN, "at long, loops long, finished boolean, playing boolean", "append", "NoTimeout")


def event_controls(s, d) -> DataFrame:
    """Controls from events: about half are ticks."""
    k = F.col("event_id") % 11
    kind = F.when(k == 0, "seek_frame").when(k == 1, "seek_time").when(k == 2, "pause").when(k == 3, "play").when(F.col("event_id") % 44 == 4, "reset").otherwise("tick")
    value = F.when(k == 0, F.col("event_id") % 6).when(k == 1, F.col("event_id") % 500).otherwise((F.col("event_id") % 7 + 1) * 30)
    return table(s, d, "events").select(F.col("user_id").alias("player_id"), F.col("event_id").alias("seq"), kind.alias("kind"), value.alias("value"))


_STARTS = [sum(SHOW[:i]) for i in range(len(SHOW))]
_TOTAL = sum(SHOW)
_AT = "CASE " + " ".join(f"WHEN {{v}} >= {v} THEN {i}" for i, v in reversed(list(enumerate(_STARTS)))) + " END"
_GO = "k = 'tick' AND NOT finished AND playing"
_END = f"{_GO} AND (at_ms + v) // {_TOTAL} >= greatest(1, 3 - loops)"
_CONTROLS = f"""WITH RECURSIVE c AS (SELECT user_id AS player_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
  CASE event_id % 11 WHEN 0 THEN 'seek_frame' WHEN 1 THEN 'seek_time' WHEN 2 THEN 'pause' WHEN 3 THEN 'play' ELSE CASE WHEN event_id % 44 = 4 THEN 'reset' ELSE 'tick' END END AS k,
  CASE event_id % 11 WHEN 0 THEN event_id % 6 WHEN 1 THEN event_id % 500 ELSE (event_id % 7 + 1) * 30 END AS v FROM events),
s AS (SELECT DISTINCT player_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS at_ms, CAST(0 AS BIGINT) AS loops, false AS finished, true AS playing, CAST(0 AS BIGINT) AS looped, false AS ended, CAST(0 AS BIGINT) AS seq FROM c
UNION ALL SELECT player_id, n + 1, CASE WHEN {_END} THEN {_STARTS[-1]} WHEN {_GO} THEN (at_ms + v) % {_TOTAL} WHEN k = 'seek_frame' THEN [{', '.join(map(str, _STARTS))}][least(v, {len(SHOW) - 1}) + 1] WHEN k = 'seek_time' THEN v WHEN k = 'reset' THEN 0 ELSE at_ms END,
  CASE WHEN {_END} THEN loops + greatest(1, 3 - loops) WHEN {_GO} THEN loops + (at_ms + v) // {_TOTAL} WHEN k = 'reset' THEN 0 ELSE loops END,
  CASE WHEN {_END} THEN true WHEN k IN ('seek_frame', 'seek_time', 'reset') THEN false ELSE finished END, CASE WHEN {_END} OR k = 'pause' THEN false WHEN k IN ('play', 'reset') THEN true ELSE playing END,
  CASE WHEN {_END} THEN greatest(1, 3 - loops) WHEN {_GO} THEN (at_ms + v) // {_TOTAL} ELSE 0 END, {_END}, c_seq
FROM (SELECT s.*, c.k, c.v, c.seq AS c_seq FROM s JOIN c ON c.player_id = s.player_id AND c.n = s.n + 1))
SELECT player_id, seq, CAST({_AT.format(v=f'least(at_ms, {_TOTAL - 1})')} AS INTEGER) AS frame, loops, finished, playing, looped, ended FROM s WHERE n > 0"""

OPS = {"player_controls": (lambda s, d: controlled(event_controls(s, d), Machine()), _CONTROLS)}
