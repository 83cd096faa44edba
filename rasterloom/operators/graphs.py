"""Graphs and trees in rounds: order in which all inputs come first, levels, bounds of subtrees, walks.

A round is a join with the last round's new rows and a combined group-by; its result is written, so plans don't grow,
and rounds end by themselves when nothing new is found.  There are as many rounds as the graph is deep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.kept import kept
from ..sources.tables import table

#: Edges of what is left of a graph with a cycle, of which the driver takes at most so many to name one.
TOLD = 10_000


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with its places 0, 1, 2, ... in an order over all rows: parts are sorted, counted, and moved on by the counts before them."""
    parts = kept(df.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_own")))
    counts = parts.groupBy("_part").agg(F.min("_own").alias("first"), F.count("*").alias("n")).orderBy("_part").collect()
    before, moves = 0, []
    for part, first, n in counts:  # one row for each part
        moves.append((part, before - first))
        before += n
    shift = F.broadcast(df.sparkSession.createDataFrame(moves, "_part int, _move long"))
    return parts.join(shift, "_part").withColumn(name, F.col("_own") + F.col("_move")).drop("_part", "_own", "_move")


class Cycle(ValueError):
    """A graph has no order; `nodes` are those of a cycle, or some that can't be reached without one."""

    def __init__(self, nodes: list):
        super().__init__("the graph contains a cycle: " + " -> ".join(map(str, nodes)))
        self.nodes = nodes


def cycle_among(edges: DataFrame) -> list:
    """The nodes of a cycle, from edges (a, b) in which every b has an a."""
    found = edges.limit(TOLD).collect()
    before: dict = {}
    for a, b in sorted(found):
        before.setdefault(b, a)
    node, path = min(before), []
    while node in before and node not in path:
        path.append(node)
        node = before[node]
    return [*path[path.index(node) :], node][::-1] if node in path else path


def ordered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, level, place: an order in which each node comes after all nodes with an edge to it.

    nodes: id, seq (how nodes follow one another where nothing else decides); edges: a, b (a before b).  The order is that of
    a queue into which nodes without inputs go by id, and each other node when the last of its inputs leaves it, by seq
    among those that leave with it.  Repeated edges count once, edges of unknown nodes not at all.  A graph
    with a cycle is an error that names one.
    """
    known = nodes.select("id")
    inner = kept(edges.select("a", "b").distinct().join(known.withColumnRenamed("id", "a"), "a", "left_semi").join(known.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b"))
    inputs = inner.groupBy(F.col("b").alias("id")).agg(F.count("*").alias("missing"))
    waiting = kept(nodes.select("id", "seq").join(inputs, "id", "left").select("id", "seq", F.coalesce("missing", F.lit(0)).alias("missing"), F.lit(-1).cast("long").alias("last")))
    wave = numbered(waiting.filter("missing = 0").select("id", F.lit(0).alias("level")), "place", "id")
    waiting, done, level, total = waiting.filter("missing > 0"), wave, 0, 0
    while n := wave.count():
        total, level = total + n, level + 1
        gone = inner.join(wave.select(F.col("id").alias("a"), "place"), "a").groupBy(F.col("b").alias("id")).agg(F.count("*").alias("came"), F.max("place").alias("at"))
        waiting = kept(waiting.join(gone, "id", "left").select(
            "id", "seq", (F.col("missing") - F.coalesce("came", F.lit(0))).alias("missing"), F.greatest("last", F.coalesce("at", F.lit(-1))).alias("last")))
        ready = numbered(waiting.filter("missing = 0").select("id", F.lit(level).alias("level"), "last", "seq"), "place", "last", "seq", "id")
        wave = ready.select("id", "level", (F.col("place") + total).alias("place"))
        waiting = waiting.filter("missing > 0")
        done = done.unionByName(wave)
    left = waiting.select("id")
    if not left.isEmpty():
        raise Cycle(cycle_among(inner.join(left.withColumnRenamed("id", "a"), "a", "left_semi").join(left.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")))
    return done


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id and level of each node of a graph (a before b): 0 without inputs, else one more than the highest of these."""
    return ordered(nodes.select("id", F.col("id").alias("seq")), edges).select("id", "level")


def spread_up(found: DataFrame, parents: DataFrame, aggregates: list[Column]) -> DataFrame:
    """The aggregates of each node's and all its descendants' columns in `found` (id and others); parents: id, parent.

    Each round sends what the last one brought one step up, combined on the way.  A node among its own ancestors is an error.
    """
    up = parents.filter("parent IS NOT NULL").select(F.col("id").alias("child"), "parent")
    most = parents.count()
    total = wave = kept(found)
    for _ in range(most):
        moved = wave.join(up, wave["id"] == up["child"]).drop("id", "child").withColumnRenamed("parent", "id")
        wave = kept(moved.groupBy("id").agg(*aggregates))
        if wave.isEmpty():
            return total.groupBy("id").agg(*aggregates)
        total = total.unionByName(wave.select(total.columns))
    if most:
        raise Cycle([r[0] for r in wave.select("id").orderBy("id").limit(10).collect()])
    return total.groupBy("id").agg(*aggregates)


def walked(nodes: DataFrame) -> DataFrame:
    """id, depth and path of each node (id, parent) under a root; ids aren't negative.

    The path names the nodes from the root on, each with 19 digits, so sorting by it walks the tree depth first.
    """
    own = F.lpad(F.col("id").cast("string"), 19, "0")
    wave = kept(nodes.filter("parent IS NULL").select("id", F.lit(0).alias("depth"), own.alias("path")))
    found = wave
    while not wave.isEmpty():
        above = wave.select(F.col("id").alias("parent"), (F.col("depth") + 1).alias("depth"), "path")
        wave = kept(nodes.join(above, "parent").select("id", "depth", F.concat("path", F.lit("/"), own).alias("path")))
        found = found.unionByName(wave)
    return found


def trade_graph(s, d) -> tuple[DataFrame, DataFrame]:
    """Regions, their nations, suppliers (of their nation and the next one) and customers (of their nation and a supplier)."""
    long = lambda c, more: (F.col(c).cast("long") + more) if isinstance(c, str) else c.cast("long") + more
    nat, sup, cus = table(s, d, "nation"), table(s, d, "supplier"), table(s, d, "customer")
    reg = table(s, d, "region").select(long("r_regionkey", 10).alias("id"))
    edges = (
        nat.select(long("n_regionkey", 10).alias("a"), long("n_nationkey", 100).alias("b"))
        .union(sup.select(long("s_nationkey", 100), long("s_suppkey", 10**6)))
        .union(sup.select(long((F.col("s_nationkey") + 1) % 25, 100), long("s_suppkey", 10**6)))
        .union(cus.select(long("c_nationkey", 100), long("c_custkey", 10**9)))
        .union(cus.select(long(F.col("c_custkey") % 10, 10**6), long("c_custkey", 10**9)))
    )
    ids = reg.union(nat.select(long("n_nationkey", 100))).union(sup.select(long("s_suppkey", 10**6))).union(cus.select(long("c_custkey", 10**9)))
    return ids.select("id", (F.col("id") * 7919 % 10007).alias("seq")), edges


_GRAPH = """WITH e AS (SELECT n_regionkey + 10 AS a, n_nationkey + 100 AS b FROM nation UNION SELECT s_nationkey + 100, s_suppkey + 1000000 FROM supplier UNION SELECT (s_nationkey + 1) % 25 + 100, s_suppkey + 1000000 FROM supplier
UNION SELECT c_nationkey + 100, c_custkey + 1000000000 FROM customer UNION SELECT c_custkey % 10 + 1000000, c_custkey + 1000000000 FROM customer),
l0 AS (SELECT r_regionkey + 10 AS id, row_number() OVER (ORDER BY r_regionkey) - 1 AS place FROM region)"""


def _wave(n: int) -> str:
    low, high = {1: (100, 10**6), 2: (10**6, 10**9), 3: (10**9, 10**12)}[n]
    before = " UNION ALL ".join(f"SELECT id, place FROM l{k}" for k in range(n))
    count = " + ".join(f"(SELECT count(*) FROM l{k})" for k in range(n))
    return f", l{n} AS (SELECT b AS id, {count} + row_number() OVER (ORDER BY max(place), b * 7919 % 10007, b) - 1 AS place FROM e JOIN ({before}) q ON q.id = a WHERE b >= {low} AND b < {high} GROUP BY b)"


_ORDER = _GRAPH + "".join(map(_wave, (1, 2, 3))) + " " + " UNION ALL ".join(f"SELECT CAST(id AS BIGINT) AS id, {k} AS level, CAST(place AS BIGINT) AS place FROM l{k}" for k in range(4))

OPS = {"graph_order": (lambda s, d: ordered(*trade_graph(s, d)), _ORDER)}
