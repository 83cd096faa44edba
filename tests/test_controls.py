"""Players against a machine that goes frame by frame, and streams against tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rasterloom.streaming.controls import Machine, Player, controlled, controlled_stream
from rasterloom.streaming.player import activity


class Slow:
    """One frame after the other."""

    def __init__(self, delays, loops):
        self.delays, self.limit = [d if d > 0 else 10 for d in delays], loops
        self.reset()

    def reset(self):
        self.frame = self.within = self.loops = 0
        self.finished, self.playing = False, True

    def row(self, kind, value):
        looped, ended = 0, False
        if kind == "tick" and value > 0 and self.playing and not self.finished:
            self.within += value
            while not self.finished and self.within >= self.delays[self.frame]:
                self.within -= self.delays[self.frame]
                self.frame += 1
                if self.frame == len(self.delays):
                    self.loops, looped = self.loops + 1, looped + 1
                    self.frame = 0
                    if self.limit and self.loops >= self.limit:
                        self.frame, self.finished, self.playing, ended = len(self.delays) - 1, True, False, True
        elif kind in ("play", "pause"):
            self.playing = kind == "play"
        elif kind == "seek_frame":
            self.frame, self.within, self.finished = min(value, len(self.delays) - 1), 0, False
        elif kind == "seek_time":
            value, total = max(0, value), sum(self.delays)
            at, self.frame = value % total if not self.limit else min(value, total - 1), 0
            while at >= sum(self.delays[: self.frame + 1]):
                self.frame += 1
            self.within, self.finished = value - sum(self.delays[: self.frame]), False
        elif kind == "reset":
            self.reset()
        return self.frame, self.loops, self.finished, self.playing, looped, ended


def controls(seed, players=5, rows=120):
    rng = random.Random(seed)
    kinds = ["tick"] * 6 + ["pause", "play", "play", "seek_frame", "seek_time", "reset", "unknown"]
    return [(p, s, rng.choice(kinds), rng.choice([0, 15, 40, 77, 300, 1500, -4])) for p in range(players) for s in range(rows)]


@pytest.mark.parametrize("loops", [0, 1, 4])
def test_frame_by_frame(loops):
    delays = (30, 0, 75)
    for seed in range(20):
        fast, slow, player = Machine(delays, loops), Slow(delays, loops), Player()
        for _, _, kind, value in controls(seed, 1):
            value = abs(value) if kind == "seek_frame" else value
            player, looped, ended = fast.after(player, kind, value)
            got = fast.shown((), player, looped, ended)
            want = slow.row(kind, value)
            assert got == want


def test_tables_and_streams_agree(spark, tmp_path):
    rows = controls(3)
    frame = spark.createDataFrame(rows, "player_id int, seq int, kind string, value int")
    machine = Machine((30, 10, 75), 2)
    table = {(r.player_id, r.seq): tuple(r) for r in controlled(frame.orderBy(F.rand(1)), machine).collect()}
    assert len(table) == len(rows)
    for part in range(3):  # three micro-batches, one after the other
        frame.filter((F.col("seq") >= part * 40) & (F.col("seq") < part * 40 + 40)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/rows")
        if part == 0:
            stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/rows")
            query = controlled_stream(stream, machine).writeStream.format("memory").queryName("rl_controls").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
        query.processAllAvailable()
    query.stop()
    assert {(r.player_id, r.seq): tuple(r) for r in spark.sql("SELECT * FROM rl_controls").collect()} == table


def test_null_values_and_no_rows(spark):
    schema = "player_id long, seq long, kind string, value long"
    assert controlled(spark.createDataFrame([], schema), Machine()).collect() == []
    rows = spark.createDataFrame([(1, 0, "tick", None), (1, 1, None, 5), (1, 2, "seek_frame", None)], schema)
    assert [r.frame for r in controlled(rows, Machine()).collect()] == [0, 0, 0]


def test_activity_counts_windows_of_a_table(spark):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:00:00", "a", 4.0), ("2024-01-01 00:10:00", "b", 8.0)], "t string, event_type string, value double")
    got = activity(rows.select(F.to_timestamp("t").alias("ts"), "event_type", "value")).collect()
    assert sorted((r.window.start.hour, r.event_type, r.n, r.value) for r in got) == [(0, "a", 2, 3.0), (0, "b", 1, 8.0), (1, "a", 1, 4.0)]
