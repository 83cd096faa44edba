"""Shards of near-equal bytes by k-d tree partitioning over the documents' metadata.

Documents become points of three dimensions that follow from their text alone: size in bytes, the checksum, and
bytes for each character.  A node of the tree that stands for n shards is split along its widest dimension
(measured against the whole table) where the weights below reach floor(n / 2) / n of the node's bytes, until
every node is one shard.  Equal texts are one point, so they stay together, unless their bytes alone exceed a
shard's share: then they are cut into several points by their doc_id.  There are fewer such texts than shards.

The median of a node isn't found by bringing it together: along each dimension points have a place on a line of
63 bits (the dimension first, a hash after it, so that places differ), and two rounds of weighted histograms
over all nodes of a level narrow each cut down.  A histogram has a fixed number of bins for each node, so what
comes to the driver is bounded by the number of shards.  Row numbers within a shard are made of counts for small
buckets and row numbers within those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import keep, table

OVERHEAD = 16
BINS = 1024
PLACES = 3
#: Bits of a place on a dimension's line: the dimension's own value, then a hash.
VALUE_BITS, HASH_BITS = 24, 38


def places(size: Column, crc: Column, chars: Column, tie: Column) -> list[Column]:
    low = tie.bitwiseAND((1 << HASH_BITS) - 1)
    wide = [F.log2(size + 1.0) / 48, crc / float(1 << 32), F.when(chars > 0, (size - OVERHEAD) / chars / 4).otherwise(0.0)]
    return [F.shiftleft(F.least(F.greatest(w, F.lit(0.0)) * (1 << VALUE_BITS), F.lit((1 << VALUE_BITS) - 1.0)).cast("long"), HASH_BITS).bitwiseOR(low) for w in wide]


class Node:
    """A node: the shards it stands for, and once split its dimension, cut and two parts."""

    def __init__(self, first: int, n: int):
        self.first, self.n, self.cut = first, n, None

    def column(self, of) -> Column:
        if self.cut is None:
            return F.lit(of(self))
        return F.when(F.col(f"p{self.axis}") < self.cut, self.left.column(of)).otherwise(self.right.column(of))

    def leaves(self) -> list["Node"]:
        return [self] if self.cut is None else self.left.leaves() + self.right.leaves()


def grow(points: DataFrame, shards: int) -> Node:
    """The tree over points (p0, p1, p2: places, w: bytes)."""
    root, spans = Node(0, shards), None
    while todo := [x for x in root.leaves() if x.n > 1]:
        node = root.column(lambda x: x.first)
        ranges = points.groupBy(node.alias("node")).agg(
            F.sum("w").alias("w"), *[f(f"p{d}").alias(f"{k}{d}") for d in range(PLACES) for k, f in (("lo", F.min), ("hi", F.max))]
        )
        found = {r["node"]: r for r in ranges.collect()}  # a row for each node, at most as many as shards
        if spans is None:
            r = found.get(0)
            spans = [max(1, r[f"hi{d}"] - r[f"lo{d}"]) if r else 1 for d in range(PLACES)]
        search = {}
        for x in todo:
            r = found.get(x.first)
            x.axis = max(range(PLACES), key=lambda d: (r[f"hi{d}"] - r[f"lo{d}"]) / spans[d]) if r else 0
            if r is None:
                search[x.first] = (0, 1, 0, 0)
            else:  # lowest place, width of a bin, bytes below the lowest place, bytes wanted
                lo, hi = r[f"lo{x.axis}"], r[f"hi{x.axis}"] + 1
                search[x.first] = (lo, -(-(hi - lo) // BINS), 0, r["w"] * (x.n // 2) / x.n)
        cuts = narrow(points, root, todo, search)
        for x in todo:
            x.left, x.right = Node(x.first, x.n // 2), Node(x.first + x.n // 2, x.n - x.n // 2)
            x.cut = cuts[x.first]
    return root


def narrow(points: DataFrame, root: Node, todo: list[Node], search: dict, rounds: int = 3) -> dict[int, int]:
    """Where to cut each node: the place whose weight below is nearest to what is wanted, by finer and finer bins.

    search: of each node the lowest place, the width of a bin, the bytes below and the bytes wanted.
    """
    spark, axes = points.sparkSession, {x.first: x.axis for x in todo}
    placed = points.select(root.column(lambda x: x.first).alias("node"), F.array(*[f"p{d}" for d in range(PLACES)]).alias("places"), "w")
    cuts = {}
    for last in [False] * (rounds - 1) + [True]:
        # a row for each node, at most as many as shards: broadcast
        lines = spark.createDataFrame([(n, axes[n], lo, step) for n, (lo, step, _, _) in search.items()], "node int, axis int, low long, width long")
        bins = placed.join(F.broadcast(lines), "node").withColumn("bin", F.expr("(get(places, axis) - low) div width"))
        rows = bins.filter((F.col("bin") >= 0) & (F.col("bin") < BINS)).groupBy("node", "bin").agg(F.sum("w").alias("w")).collect()
        of = {n: sorted((r["bin"], r["w"]) for r in rows if r["node"] == n) for n in search}  # at most BINS for each node
        for n, (lo, step, below, wanted) in search.items():
            for b, w in of[n]:
                if below + w > wanted:
                    break
                below += w
            else:
                b, w = (of[n][-1][0] + 1, 0) if of[n] else (0, 0)
            if last or step == 1:  # the bin goes to the side that comes nearer
                cuts[n] = lo + b * step if wanted - below <= below + w - wanted else lo + (b + 1) * step
            search[n] = (lo + b * step, max(1, -(-step // BINS)), below, wanted)
    return cuts


def shard(docs: DataFrame, shards: int = 40, bucket_rows: int = 10_000) -> DataFrame:
    """A row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the bytes of the text and 16; a null text has none, and the checksum of no bytes.  Null doc_ids and
    repeated rows get a place each; other columns are not read; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = keep(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.length(text).alias("chars"), F.xxhash64(text).alias("hash"),
    ))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count("*").alias("n")).first()
    share = max(1, total["size"] // shards)
    same = ["size", "text_crc32", "chars", "hash"]
    groups = rows.groupBy(*same).agg(F.sum("size").alias("w"))
    # texts that alone exceed a shard: fewer than there are shards, so broadcast
    large = F.broadcast(groups.filter(F.col("w") > share).select(*same, F.ceil(4 * F.col("w") / share).cast("int").alias("cuts")))
    parted = rows.join(large, same, "left").withColumn(
        "part", F.when(F.col("cuts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("cuts")).cast("int")))
    placed = parted.withColumns({f"p{d}": c for d, c in enumerate(
        places(F.col("size"), F.col("text_crc32"), F.col("chars"), F.xxhash64("hash", "part")))})
    axes = [f"p{d}" for d in range(PLACES)]
    points = keep(placed.groupBy(*axes).agg(F.sum("size").alias("w")))
    root = grow(points, shards)
    # buckets of a shard follow from the doc_id's hash; their number from that of all rows
    buckets = max(1, total["n"] // (shards * bucket_rows))
    dealt = keep(placed.select(
        "doc_id", "size", "text_crc32", root.column(lambda x: x.first).cast("int").alias("shard"),
        F.pmod(F.xxhash64("doc_id", "hash"), F.lit(buckets)).cast("int").alias("bucket"),
    ))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    return (
        dealt.withColumn("row", F.row_number().over(order) - 1)
        .join(offsets, ["shard", "bucket"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("offset") + F.col("row")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
