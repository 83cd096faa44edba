"""Animations: frames with delays, their times, players, trees of layers.

conversations stand for animations (a turn is a frame whose delay follows from its text), events for the ticks of
players, nation and region for a small tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from .graphs import walked


def in_order():
    return Window.partitionBy("anim_id").orderBy("frame_no")


def lasting(delay: Column) -> Column:
    """Delays of nothing or less count as 10 ms."""
    return F.when(delay <= 0, 10).otherwise(delay)


def frames(s, d) -> DataFrame:
    """anim_id, frame_no, delay_ms; turns with the same number are one frame."""
    turns = table(s, d, "conversations").groupBy(F.col("conv_id").alias("anim_id"), F.col("turn").alias("frame_no"))
    return turns.agg((F.max(F.length(F.coalesce("text", F.lit("")))) % 20 * 10).cast("long").alias("delay_ms"))


def timed(df: DataFrame) -> DataFrame:
    """With the start of each frame and the end of the animation."""
    long = df.withColumn("delay_ms", lasting(F.col("delay_ms")).cast("long"))
    before = in_order().rowsBetween(Window.unboundedPreceding, -1)
    return long.withColumn("start_ms", F.coalesce(F.sum("delay_ms").over(before), F.lit(0))).withColumn("total_ms", F.sum("delay_ms").over(Window.partitionBy("anim_id")))


def at_time(df: DataFrame, at: int, endless: bool = True) -> DataFrame:
    """The frame that shows at a time: times go round if endless, else the last frame stays."""
    t = F.pmod(F.lit(at), F.col("total_ms")) if endless else F.least(F.lit(at), F.col("total_ms") - 1)
    return timed(df).filter((t >= F.col("start_ms")) & (t < F.col("start_ms") + F.col("delay_ms"))).select("anim_id", "frame_no")


def reversed_frames(df: DataFrame) -> DataFrame:
    back = Window.partitionBy("anim_id").orderBy(F.desc("frame_no"))
    return df.withColumn("frame_no", (F.row_number().over(back) - 1).cast("long"))


def scaled(df: DataFrame, factor: float) -> DataFrame:
    """Delays times the factor: over 1 is slower."""
    return df.withColumn("delay_ms", F.greatest(F.lit(1), F.floor(lasting(F.col("delay_ms")) * factor)).cast("long"))


def part(df: DataFrame, first: int, last: int) -> DataFrame:
    """Frames first up to last, exclusive, numbered anew."""
    place = (F.row_number().over(in_order()) - 1).cast("long")
    return df.withColumn("place", place).filter((F.col("place") >= first) & (F.col("place") < last)).select("anim_id", (F.col("place") - first).alias("frame_no"), "delay_ms")


#: Delays of the animation that players show.
SHOW = (50, 75, 120, 30)


def advanced(ticks: DataFrame, loops: int = 3) -> DataFrame:
    """Of players (player_id, seq, dt_ms): frame, loops done and whether finished after each tick.

    A player that has shown the animation `loops` times stays on the last frame; 0 is endless.
    """
    total, starts = sum(SHOW), [sum(SHOW[:i]) for i in range(len(SHOW))]
    run = ticks.withColumn("t", F.sum("dt_ms").over(Window.partitionBy("player_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    done = F.floor(F.col("t") / total)
    over = F.lit(bool(loops)) & (done >= loops)
    within = F.col("t") % total
    frame = F.lit(0)
    for i, start in enumerate(starts):
        frame = F.when(within >= start, i).otherwise(frame)
    return run.select("player_id", "seq", F.when(over, len(SHOW) - 1).otherwise(frame).cast("int").alias("frame"), F.when(over, loops).otherwise(done).cast("long").alias("loops"), over.alias("finished"))


def ticks(s, d) -> DataFrame:
    return table(s, d, "events").select(F.col("user_id").alias("player_id"), F.col("event_id").alias("seq"), ((F.col("event_id") % 7 + 1) * 30).alias("dt_ms"))


def tree(s, d) -> DataFrame:
    """id, parent: a root, the regions and the nations."""
    nations = table(s, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"), (F.col("n_regionkey") + 10).cast("long").alias("parent"))
    regions = table(s, d, "region").select((F.col("r_regionkey") + 10).cast("long").alias("id"), F.lit(1).cast("long").alias("parent"))
    return regions.union(nations).union(s.sql("SELECT 1L AS id, CAST(NULL AS BIGINT) AS parent"))


_FRAMES = "WITH fr AS (SELECT conv_id AS anim_id, turn AS frame_no, CAST(max(length(coalesce(text, ''))) % 20 * 10 AS BIGINT) AS delay_ms FROM conversations GROUP BY ALL), lo AS (SELECT anim_id, frame_no, CASE WHEN delay_ms <= 0 THEN 10 ELSE delay_ms END AS delay_ms FROM fr), ti AS (SELECT *, CAST(sum(delay_ms) OVER (PARTITION BY anim_id ORDER BY frame_no) - delay_ms AS BIGINT) AS start_ms, CAST(sum(delay_ms) OVER (PARTITION BY anim_id) AS BIGINT) AS total_ms FROM lo)"
_TREE = "WITH RECURSIVE nd AS (SELECT 1 AS id, NULL AS parent UNION ALL SELECT r_regionkey + 10, 1 FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey + 10 FROM nation), w AS (SELECT id, 0 AS depth, lpad(CAST(id AS VARCHAR), 19, '0') AS path FROM nd WHERE parent IS NULL UNION ALL SELECT nd.id, depth + 1, path || '/' || lpad(CAST(nd.id AS VARCHAR), 19, '0') FROM nd JOIN w ON nd.parent = w.id) SELECT CAST(id AS BIGINT) AS id, depth, path FROM w"
_STARTS = [sum(SHOW[:i]) for i in range(len(SHOW))]
_FRAME = "CASE " + " ".join(f"WHEN t % {sum(SHOW)} >= {_STARTS[i]} THEN {i}" for i in reversed(range(len(SHOW)))) + " END"
_PLAY = f"WITH r AS (SELECT user_id AS player_id, event_id AS seq, sum((event_id % 7 + 1) * 30) OVER (PARTITION BY user_id ORDER BY event_id) AS t FROM events) SELECT player_id, seq, CAST(CASE WHEN t >= {3 * sum(SHOW)} THEN {len(SHOW) - 1} ELSE {_FRAME} END AS INTEGER) AS frame, CAST(least(3, t // {sum(SHOW)}) AS BIGINT) AS loops, t >= {3 * sum(SHOW)} AS finished FROM r"

OPS = {
    "frame_times": (lambda s, d: timed(frames(s, d)), _FRAMES + " SELECT * FROM ti"),
    "frame_at_time": (lambda s, d: at_time(frames(s, d), 777), _FRAMES + " SELECT anim_id, frame_no FROM ti WHERE 777 % total_ms >= start_ms AND 777 % total_ms < start_ms + delay_ms"),
    "frame_at_time_once": (lambda s, d: at_time(frames(s, d), 777, False), _FRAMES + " SELECT anim_id, frame_no FROM ti WHERE least(777, total_ms - 1) >= start_ms AND least(777, total_ms - 1) < start_ms + delay_ms"),
    "frames_reversed": (lambda s, d: reversed_frames(frames(s, d)), _FRAMES + " SELECT anim_id, row_number() OVER (PARTITION BY anim_id ORDER BY frame_no DESC) - 1 AS frame_no, delay_ms FROM fr"),
    "frames_scaled": (lambda s, d: scaled(frames(s, d), 1.5), _FRAMES + " SELECT anim_id, frame_no, CAST(greatest(1, floor(delay_ms * 1.5)) AS BIGINT) AS delay_ms FROM lo"),
    "frames_part": (lambda s, d: part(frames(s, d), 1, 4), _FRAMES + ", pl AS (SELECT *, row_number() OVER (PARTITION BY anim_id ORDER BY frame_no) - 1 AS place FROM fr) SELECT anim_id, place - 1 AS frame_no, delay_ms FROM pl WHERE place >= 1 AND place < 4"),
    "player_advance": (lambda s, d: advanced(ticks(s, d)), _PLAY),
    "tree_walk": (lambda s, d: walked(tree(s, d)), _TREE),
    "priority_order": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderkey")).alias("turn")),
        "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS INTEGER) AS turn FROM orders"),
}
