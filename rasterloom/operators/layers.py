"""Edits of animations and of layer trees, bounds of subtrees, order of graphs, rows without partners.

Edits number siblings or frames anew by a window over their parent, so any number of trees is edited at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from .graphs import levels, spread_up
from .timeline import _FRAMES, frames, lasting

FRAME = ["anim_id", "frame_no", "delay_ms"]


def renumbered(df: DataFrame, *order: str) -> DataFrame:
    """Frames numbered from 0 in this order."""
    place = F.row_number().over(Window.partitionBy("anim_id").orderBy(*order)) - 1
    return df.withColumn("frame_no", place.cast("long")).select(*FRAME)


def inserted(df: DataFrame, at: int, delay_ms: int) -> DataFrame:
    """A frame before place `at` of every animation; places beyond the ends count as the ends."""
    rows = renumbered(df, "frame_no").withColumn("late", F.lit(1))
    count = rows.groupBy("anim_id").agg(F.count("*").alias("n"))
    new = count.select("anim_id", F.least(F.lit(max(at, 0)).cast("long"), F.col("n")).alias("frame_no"), lasting(F.lit(delay_ms)).cast("long").alias("delay_ms"), F.lit(0).alias("late"))
    return renumbered(rows.unionByName(new), "frame_no", "late")


def removed(df: DataFrame, at: int) -> DataFrame:
    return renumbered(renumbered(df, "frame_no").filter(F.col("frame_no") != at), "frame_no")


def replaced(df: DataFrame, at: int, delay_ms: int) -> DataFrame:
    return renumbered(df, "frame_no").withColumn("delay_ms", F.when(F.col("frame_no") == at, lasting(F.lit(delay_ms)).cast("long")).otherwise(F.col("delay_ms")))


def appended(df: DataFrame, other: DataFrame) -> DataFrame:
    """The frames of other after those of df, by animation."""
    return renumbered(df.withColumn("late", F.lit(0)).unionByName(other.withColumn("late", F.lit(1))), "late", "frame_no")


def uniform(df: DataFrame, delay_ms: int) -> DataFrame:
    return df.withColumn("delay_ms", lasting(F.lit(delay_ms)).cast("long"))


def seek(df: DataFrame, frame_no: int) -> DataFrame:
    """Where playing is after a jump to a frame: the frame (the last if there are fewer) and its start."""
    rows = renumbered(df, "frame_no").withColumn("delay_ms", lasting(F.col("delay_ms")).cast("long"))
    start = F.coalesce(F.sum("delay_ms").over(Window.partitionBy("anim_id").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.max("frame_no").over(Window.partitionBy("anim_id"))
    return rows.select("anim_id", "frame_no", start.alias("time_ms"), last.alias("last")).filter(F.col("frame_no") == F.least(F.lit(frame_no), F.col("last"))).drop("last")


# A layer: id, parent (null: the root), z (its place among its siblings), and a rectangle x, y, w, h (w = 0: empty).

def layers(s, d) -> DataFrame:
    """Suppliers as layers under the layers of their nations, these under regions; rectangles follow from the keys."""
    rect = lambda k: [(k * 7 % 90).alias("x"), (k * 11 % 70).alias("y"), (k % 13 * 3).alias("w"), (k % 5 * 4 + 1).alias("h")]
    part = lambda df, k, parent: df.select(k.alias("id"), parent.alias("parent"), *rect(k))
    sup, nat, reg = table(s, d, "supplier"), table(s, d, "nation"), table(s, d, "region")
    every = (
        part(sup, F.col("s_suppkey").cast("long") + 1000, F.col("s_nationkey").cast("long") + 100)
        .union(part(nat, F.col("n_nationkey").cast("long") + 100, F.col("n_regionkey").cast("long") + 10))
        .union(part(reg, F.col("r_regionkey").cast("long") + 10, F.lit(None).cast("long")))
    )
    return in_place(every, "id")


def in_place(df: DataFrame, *order) -> DataFrame:
    return df.withColumn("z", (F.row_number().over(Window.partitionBy("parent").orderBy(*order)) - 1).cast("int"))


def without_child(df: DataFrame, at: int) -> DataFrame:
    """Every parent without its child at this place."""
    return in_place(df.filter((F.col("z") != at) | F.col("parent").isNull()), "z")


def child_moved(df: DataFrame, source: int, target: int) -> DataFrame:
    """Every parent with its child at place `source` moved to place `target`; parents without such places stay."""
    count = F.count("*").over(Window.partitionBy("parent"))
    n = df.withColumn("n", count)
    own = F.when(F.col("z") == source, target * 2 + (1 if target > source else -1)).otherwise(F.col("z") * 2)
    ok = F.col("parent").isNotNull() & (F.col("n") > max(source, target))
    return in_place(n.withColumn("to", F.when(ok, own).otherwise(F.col("z") * 2)), "to").drop("n", "to")


def tree_bounds(df: DataFrame) -> DataFrame:
    """For every layer the bounds of what it and its descendants show, however deep; empty rectangles don't count; null if none does."""
    shown = F.col("w") > 0
    boxes = df.select("id", *[F.when(shown, v).alias(k) for k, v in (("x0", F.col("x")), ("y0", F.col("y")), ("x1", F.col("x") + F.col("w")), ("y1", F.col("y") + F.col("h")))])
    return spread_up(boxes, df, bounds())


def bounds() -> list[Column]:
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]


def duplicated(df: DataFrame, offset: int) -> DataFrame:
    """Copies of all layers with ids `offset` higher, as trees of their own."""
    return df.withColumn("id", F.col("id") + offset).withColumn("parent", F.col("parent") + offset)


def merged_down(df: DataFrame, at: int) -> DataFrame:
    """Every parent with its child at place `at` merged into the one below: the rectangle that holds both.

    A layer that shows nothing only goes; place 0 has nothing below it, and is an error.
    """
    if at < 1:
        raise ValueError("the lowest layer has none below it")
    siblings = Window.partitionBy("parent").orderBy("z")
    far = {"fx": F.col("x") + F.col("w"), "fy": F.col("y") + F.col("h")}
    wide = df.withColumns(far)
    above = {f"a_{c}": F.lead(c).over(siblings) for c in ("x", "y", "w", "fx", "fy", "z")}
    seen = wide.withColumns(above)
    into = F.col("parent").isNotNull() & (F.col("a_z") == at) & (F.col("a_w") > 0)
    empty = F.col("w") == 0
    low = lambda c: F.when(into, F.when(empty, F.col(f"a_{c}")).otherwise(F.least(c, f"a_{c}"))).otherwise(F.col(c))
    high = lambda c: F.when(into, F.when(empty, F.col(f"a_{c}")).otherwise(F.greatest(c, f"a_{c}"))).otherwise(F.col(c))
    merged = seen.select("id", "parent", "z", low("x").alias("x"), low("y").alias("y"), high("fx").alias("fx"), high("fy").alias("fy"))
    left = merged.filter((F.col("z") != at) | F.col("parent").isNull())
    return in_place(left.withColumn("w", F.col("fx") - F.col("x")).withColumn("h", F.col("fy") - F.col("y")).drop("fx", "fy"), "z")


def parts_graph(s, d) -> tuple[DataFrame, DataFrame]:
    """Nations depend on their regions, suppliers on nations and on the supplier of half their key."""
    sup, nat = table(s, d, "supplier"), table(s, d, "nation")
    key = F.col("s_suppkey").cast("long")
    edges = (
        nat.select((F.col("n_regionkey") + 10).cast("long").alias("a"), (F.col("n_nationkey") + 100).cast("long").alias("b"))
        .union(sup.select((F.col("s_nationkey") + 100).cast("long"), key + 1000))
        .union(sup.filter("s_suppkey >= 4096").select(F.floor(key / 4096) + 1000, key + 1000))
    )
    return edges, edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()


_PLACED = _FRAMES + ", pl AS (SELECT anim_id, row_number() OVER (PARTITION BY anim_id ORDER BY frame_no) - 1 AS frame_no, delay_ms FROM fr), ct AS (SELECT anim_id, count(*) AS n FROM pl GROUP BY anim_id)"
_RECT = "{k} * 7 % 90 AS x, {k} * 11 % 70 AS y, {k} % 13 * 3 AS w, {k} % 5 * 4 + 1 AS h"
_LAYERS = ("WITH RECURSIVE l0 AS (SELECT s_suppkey + 1000 AS id, s_nationkey + 100 AS parent FROM supplier UNION ALL SELECT n_nationkey + 100, n_regionkey + 10 FROM nation UNION ALL SELECT r_regionkey + 10, NULL FROM region), "
           f"l AS (SELECT CAST(id AS BIGINT) AS id, CAST(parent AS BIGINT) AS parent, {_RECT.format(k='id')}, CAST(row_number() OVER (PARTITION BY parent ORDER BY id) - 1 AS INTEGER) AS z FROM l0)")
_Z = "CAST(row_number() OVER (PARTITION BY parent ORDER BY {o}) - 1 AS INTEGER) AS z"
_UP = _LAYERS + ", w AS (SELECT id AS top, id FROM l UNION ALL SELECT w.top, l.id FROM w JOIN l ON l.parent = w.id) SELECT top AS id, min(x) AS x0, min(y) AS y0, max(x + l.w) AS x1, max(y + h) AS y1 FROM (SELECT w.top, l.x, l.y, l.w, l.h FROM w JOIN l ON l.id = w.id AND l.w > 0) AS l GROUP BY top"
_UP = _UP.replace("SELECT top AS id, min(x)", ", b AS (SELECT top AS id, min(x)").replace("GROUP BY top", "GROUP BY top) SELECT l.id, x0, y0, x1, y1 FROM l LEFT JOIN b USING (id)")
_MERGED = (_LAYERS + ", m AS (SELECT p.id, p.parent, p.z, CASE WHEN q.w > 0 THEN CASE WHEN p.w = 0 THEN q.x ELSE least(p.x, q.x) END ELSE p.x END AS x, CASE WHEN q.w > 0 THEN CASE WHEN p.w = 0 THEN q.y ELSE least(p.y, q.y) END ELSE p.y END AS y, "
           "CASE WHEN q.w > 0 THEN CASE WHEN p.w = 0 THEN q.x + q.w ELSE greatest(p.x + p.w, q.x + q.w) END ELSE p.x + p.w END AS fx, CASE WHEN q.w > 0 THEN CASE WHEN p.w = 0 THEN q.y + q.h ELSE greatest(p.y + p.h, q.y + q.h) END ELSE p.y + p.h END AS fy "
           "FROM l p LEFT JOIN l q ON q.parent = p.parent AND q.z = p.z + 1 AND q.z = 2 WHERE p.z <> 2 OR p.parent IS NULL) "
           f"SELECT id, parent, x, y, fx - x AS w, fy - y AS h, {_Z.format(o='z')} FROM m")
_MOVED = _LAYERS + ", n AS (SELECT *, count(*) OVER (PARTITION BY parent) AS n FROM l) SELECT id, parent, x, y, w, h, " + _Z.format(o="CASE WHEN parent IS NULL OR n <= 3 THEN z WHEN z = 1 THEN 3.5 ELSE z END") + " FROM n"
_LEVELS = ("WITH RECURSIVE e AS (SELECT n_regionkey + 10 AS a, n_nationkey + 100 AS b FROM nation UNION ALL SELECT s_nationkey + 100, s_suppkey + 1000 FROM supplier UNION ALL SELECT s_suppkey // 4096 + 1000, s_suppkey + 1000 FROM supplier WHERE s_suppkey >= 4096), "
           "n AS (SELECT a AS id FROM e UNION SELECT b FROM e), w AS (SELECT id, 0 AS level FROM n UNION SELECT e.b, w.level + 1 FROM w JOIN e ON e.a = w.id) SELECT CAST(id AS BIGINT) AS id, max(level) AS level FROM w GROUP BY id")

OPS = {
    "frame_inserted": (lambda s, d: inserted(frames(s, d), 2, 0), _PLACED + ", al AS (SELECT *, 1 AS late FROM pl UNION ALL SELECT anim_id, least(2, n), 10, 0 FROM ct) SELECT anim_id, row_number() OVER (PARTITION BY anim_id ORDER BY frame_no, late) - 1 AS frame_no, delay_ms FROM al"),
    "frame_removed": (lambda s, d: removed(frames(s, d), 1), _PLACED + " SELECT anim_id, row_number() OVER (PARTITION BY anim_id ORDER BY frame_no) - 1 AS frame_no, delay_ms FROM pl WHERE frame_no <> 1"),
    "frame_replaced": (lambda s, d: replaced(frames(s, d), 1, 55), _PLACED + " SELECT anim_id, frame_no, CASE WHEN frame_no = 1 THEN 55 ELSE delay_ms END AS delay_ms FROM pl"),
    "frames_appended": (lambda s, d: appended(frames(s, d), frames(s, d)), _PLACED + ", al AS (SELECT *, 0 AS late FROM pl UNION ALL SELECT *, 1 FROM pl) SELECT anim_id, row_number() OVER (PARTITION BY anim_id ORDER BY late, frame_no) - 1 AS frame_no, delay_ms FROM al"),
    "frames_uniform": (lambda s, d: uniform(frames(s, d), -5), _FRAMES + " SELECT anim_id, frame_no, CAST(10 AS BIGINT) AS delay_ms FROM fr"),
    "frame_sought": (lambda s, d: seek(frames(s, d), 3), _PLACED + ", st AS (SELECT anim_id, frame_no, CAST(sum(CASE WHEN delay_ms <= 0 THEN 10 ELSE delay_ms END) OVER (PARTITION BY anim_id ORDER BY frame_no) - CASE WHEN delay_ms <= 0 THEN 10 ELSE delay_ms END AS BIGINT) AS time_ms FROM pl) SELECT st.* FROM st JOIN ct USING (anim_id) WHERE frame_no = least(3, n - 1)"),
    "layers": (layers, _LAYERS + " SELECT * FROM l"),
    "layer_removed": (lambda s, d: without_child(layers(s, d), 1), _LAYERS + f" SELECT id, parent, x, y, w, h, {_Z.format(o='z')} FROM l WHERE z <> 1 OR parent IS NULL"),
    "layer_moved": (lambda s, d: child_moved(layers(s, d), 1, 3), _MOVED),
    "layer_bounds": (lambda s, d: tree_bounds(layers(s, d)), _UP),
    "layers_duplicated": (lambda s, d: duplicated(layers(s, d), 10**6), _LAYERS + " SELECT id + 1000000 AS id, parent + 1000000 AS parent, x, y, w, h, z FROM l"),
    "layer_merged_down": (lambda s, d: merged_down(layers(s, d), 2), _MERGED),
    "graph_levels": (lambda s, d: levels(*parts_graph(s, d)), _LEVELS),
    "references_missing": (
        lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left_anti").select("doc_id"),
        "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)"),
    "references_present": (
        lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left_semi").select("doc_id"),
        "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"),
}
