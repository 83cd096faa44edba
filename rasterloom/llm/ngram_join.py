"""Jaccard join of documents on word n-grams, by prefix trees over globally ordered sets, and its components.

Sets.  A document's n-grams are hashed to 64 bits.  Equal sets are one class from the start, so copies cost a row
each.  All sets are ordered alike, rare n-grams first: by how often an n-gram can occur at most, then by how rare its
words are on average, then by hash.  At most, it occurs as often as its bucket of n-grams or the rarest of its words;
both are counted over all documents in tables of fixed size.  Buckets of n-grams fill as the corpus grows and tell
less and less of rare ones; there are far fewer words, so that the words decide.

Candidates.  Two sets of similarity t, the larger of b n-grams, differ in at most 2 b (1 - t) / (1 + t) n-grams.  So
if n-grams are dealt to more parts than that by their hash, the two sets have all n-grams of one part in common.
Sizes are split into classes of a ratio 1 / t, each with a number of parts of its own; a set is cut into the parts of
the one or two classes in which the larger set of a pair can be.  What a set has in a part is a key of 64 bits, and
sets meet by equal keys: a few n-grams at once, so that sets that only share frequent n-grams don't meet however
large the corpus grows.  Parts with less than two n-grams are weak.  There are `slack` parts more than needed, so that
sets with no more than `slack` weak parts needn't look at those, and only sets with more of them do.

That is by_parts, for n-grams of a few words, which texts without any relation share.  Otherwise the keys of a set are
its first n - ceil(t n) + 1 n-grams, one of which linked sets share, with their places: if the first n-gram that two
sets share stands at place i of one and j of the other, they share at most the smaller of n - i and m - j.

Keys that one class of equal sets alone has are dropped.  In place of all pairs of a key's classes, each is first
compared with one of them only, that in which the n-gram comes first or the smallest; that joins groups of near copies into components with no more comparisons
than rows.  Only keys whose classes still lie in different components are looked at again: the classes outside of the
key's largest component search prefix trees of all its classes, in blocks of bounded size, and only pairs that the
bounds admit leave a task.  So no link between components is missed; links within one add nothing.

Trees.  A PrefixTree stores sets, or as much of them as is known, in a trie with a run of keys on each edge.  A
search goes down from the root and carries the overlap so far, which all sets of a subtree share; a subtree is
left as soon as that overlap and the smaller remaining length can't reach what its smallest set needs.  Across
components, trees hold the first n - ceil(t n) + 1 n-grams of each set, or the TAIL n-grams that follow the shared
one; pairs are verified in trees of whole sets.  Sets that very many others are compared with are given to several tasks, by a hash of the others.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import groupby
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, keep, lean, table
from .components import components

#: Counters of a table that orders n-grams, as a power of two, and of one row of it.
BUCKET_BITS, ROW_BITS = 22, 16
PARTS = 1 << (BUCKET_BITS - ROW_BITS)
#: Bits of a key below those of its place in the order.
HASH_BITS = 52
IN_GROUP = 256
#: Classes in a tree of candidates, and the keys of each that follow a shared n-gram in it.
IN_TREE, TAIL = 1024, 8

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(text: bytes | None) -> np.ndarray:
    """Hashes of a text's words [^\\x20\\x09-\\x0D]+ in UTF-8, A-Z in lower case.  bytes.split() cuts at just these bytes."""
    return np.array([*map(xxhash.xxh3_64_intdigest, (text or b"").translate(_LOWER).split())], np.uint64)


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """The hashes of n-grams of words in their order; of all words, if there are fewer; none without words."""
    size = min(n, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    out = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        out = (out ^ words[i : len(words) - size + 1 + i]) * _M1
        out ^= out >> np.uint64(29)
    out *= _M2
    return out ^ (out >> np.uint64(32))


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def ordered(text: bytes | None, n: int, levels: np.ndarray) -> np.ndarray:
    """A text's set in global order: keys with their place in the order in the high bits and the hash below."""
    words = word_hashes(text)
    hashes, size = ngrams(words, n), min(n, len(words))
    if not size:
        return hashes
    of_words = levels[1][bucket(words)].astype(np.uint16)
    spans = [of_words[i : len(hashes) + i] for i in range(size)]
    most = np.minimum.reduce([levels[0][bucket(hashes)], *spans]) >> 2
    rarity = np.minimum(sum(spans) // (2 * size), 63)
    place = (most << 6 | rarity).astype(np.uint64)
    return np.unique((place << np.uint64(HASH_BITS)) | (hashes & np.uint64((1 << HASH_BITS) - 1)))


def frequency_levels(docs: DataFrame, n: int) -> np.ndarray:
    """How often the n-grams and words of each bucket occur in all documents, as four times the logarithm to base 2: two tables of 4 MB, whatever the input."""

    def rows(parts: dict[int, bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(parts.keys(), pa.int32()), pa.array(parts.values(), pa.binary())], ["part", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BUCKET_BITS), np.int32)  # of one task
        for batch in batches:
            for text in batch.column(0):
                words = word_hashes(text.as_py())
                np.add.at(counts[0], bucket(ngrams(words, n)), 1)
                np.add.at(counts[1], bucket(words), 1)
        yield rows({i: zlib.compress(part.tobytes(), 1) for i, part in enumerate(counts.reshape(2 * PARTS, -1)) if part.any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(blob), np.int32).astype(np.int64)
        yield rows({i: np.round(4 * np.log2(np.maximum(c, 1))).astype(np.uint8).tobytes() for i, c in sums.items()})

    sums = docs.select(F.col("text").cast("binary")).mapInArrow(lean(count), "part int, counts binary").repartition("part").mapInArrow(lean(add), "part int, counts binary")
    levels = np.zeros((2 * PARTS, 1 << ROW_BITS), np.uint8)
    for row in sums.collect():  # 128 rows of 64 KB
        levels[row["part"]] = np.frombuffer(row["counts"], np.uint8)
    return levels.reshape(2, -1)


class Parts:
    """Cuts sets into parts, so that two sets that reach the threshold share the key of one."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.largest = [0]  # largest size of each class of sizes

    def class_of(self, size: int) -> int:
        while self.largest[-1] < size:
            self.largest.append(max(self.largest[-1] + 1, int((self.largest[-1] + 1) / self.threshold + 1e-9)))
        return bisect_left(self.largest, size)

    def keys(self, ngrams: np.ndarray) -> np.ndarray:
        """The keys of a set of distinct n-grams.  Sets that can only be linked with equal ones have none."""
        n, out = len(ngrams), [np.zeros(0, np.uint64)]
        if not n:
            return out[0]
        mixed = ngrams * _M1
        mixed ^= mixed >> np.uint64(32)
        mixed *= _M2
        mixed ^= mixed >> np.uint64(29)
        for c in range(self.class_of(n), self.class_of(int(n / self.threshold + 1e-9)) + 1):
            differ = int(2 * self.largest[c] * (1 - self.threshold) / (1 + self.threshold) + 1e-9)
            if not differ:
                continue
            slack = differ // 16 + 1
            count = differ + slack + 1
            part = (mixed % np.uint64(count)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            held = np.bincount(part, minlength=count)
            sums = np.zeros(count, np.uint64)
            full = np.flatnonzero(held)
            starts = np.concatenate(([0], np.cumsum(held)))[full]
            sums[full] = np.add.reduceat(mixed[order] * _M1, starts)
            key = (sums ^ (np.arange(count, dtype=np.uint64) + (np.uint64(c + 1) << np.uint64(32)))) * _M2
            key ^= key >> np.uint64(31)
            strong = held > 1
            out.append(key * _M1 if count - np.count_nonzero(strong) > slack else (key * _M1)[strong])
        return np.concatenate(out)


def head(keys: np.ndarray, threshold: float) -> np.ndarray:
    """The first keys of a set in global order, one of which every set linked with it has among its own."""
    return keys[: len(keys) - ceil(threshold * len(keys) - 1e-9) + 1 if len(keys) else 0]


def sets(docs: DataFrame, n: int, threshold: float, levels, by_parts: bool) -> DataFrame:
    """doc_id, size, print (of the whole set, 128 bits), keys by which it meets others: those of its parts, or its first n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, cut = levels.value, Parts(threshold)
        for batch in batches:
            size, prints, met = [], [], []
            for text in batch.column(1):
                keys = ordered(text.as_py(), n, order)
                size.append(len(keys))
                prints.append(xxhash.xxh3_128_digest(keys.tobytes()))
                met.append((cut.keys(keys) if by_parts else head(keys, threshold)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(prints, pa.binary()), pa.array(met, pa.list_(pa.int64()))],
                ["doc_id", "size", "print", "keys"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(lean(run), "doc_id long, size long, print binary, keys array<long>")


def heads(texts: DataFrame, n: int, threshold: float, levels) -> DataFrame:
    """Of texts (doc_id, z): rep, tail (the first keys of the set, one of which every set linked with it has)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, unpack = levels.value, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            first = [head(ordered(unpack(z.as_py()), n, order), threshold).view(np.int64) for z in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(first, pa.list_(pa.int64()))], ["rep", "tail"],
            )

    return texts.mapInArrow(lean(run), "rep long, tail array<long>")


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, z: the compressed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            z = [squeeze(t.as_py() or b"") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())], ["doc_id", "z"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(lean(run), "doc_id long, z binary")


class Stored(NamedTuple):
    """A set in a tree: its size, and its keys in global order as far as they are known.

    `span` is how many keys the set has from the first of `keys` on; keys before it are taken not to be shared.
    """

    id: int
    keys: np.ndarray
    size: int
    span: int


class Node(NamedTuple):
    start: int  # depth at which the edge to the node begins
    end: int
    of: np.ndarray  # keys of one of its sets
    leaves: list[Stored]
    below: list["Node"]
    least: int  # smallest and largest size, and longest span, of the sets at and below the node
    most: int
    span: int


class PrefixTree:
    def __init__(self, sets: list[Stored], threshold: float):
        self.threshold = threshold
        ordered_sets = sorted(sets, key=lambda s: s.keys.astype(">u8").tobytes())
        self.root = self.grown(ordered_sets) if sets else None

    def grown(self, sets: list[Stored]) -> Node:
        """The tree of sets in order, built from its leaves up without recursion."""
        todo, done = [(0, len(sets), 0, None)], {}
        opened = []
        while todo:
            first, last, depth, parent = todo.pop()
            a, b = sets[first].keys, sets[last - 1].keys
            k = min(len(a), len(b))
            differ = np.flatnonzero(a[depth:k] != b[depth:k])
            end = depth + int(differ[0]) if len(differ) else k
            number = len(opened)
            i = first
            while i < last and len(sets[i].keys) == end:
                i += 1
            opened.append((first, i, last, depth, end, parent))
            while i < last:
                key, j = sets[i].keys[end], i + 1
                while j < last and sets[j].keys[end] == key:
                    j += 1
                todo.append((i, j, end, number))
                i = j
        for number in range(len(opened) - 1, -1, -1):
            first, leaves, last, depth, end, parent = opened[number]
            inside = sets[first:last]
            node = Node(
                depth, end, sets[first].keys, sets[first:leaves], done.pop(number, []),
                min(s.size for s in inside), max(s.size for s in inside), max(s.span for s in inside),
            )
            if parent is None:
                return node
            done.setdefault(parent, []).append(node)

    def need(self, n: int, m: int) -> int:
        return ceil(self.threshold / (1 + self.threshold) * (n + m) - 1e-9)

    def search(self, left: Stored) -> list[int]:
        """The stored sets that can reach the threshold with left; with all keys known on both sides, those that do."""
        found, keys, n = [], left.keys, left.size
        smallest, largest = ceil(self.threshold * n - 1e-9), int(n / self.threshold + 1e-9)
        todo = [(self.root, 0)] if self.root else []
        while todo:
            node, overlap = todo.pop()
            if node.most < smallest or node.least > largest:
                continue
            need, k, step = self.need(n, max(node.least, smallest)), node.start, 64
            while k < node.end:
                at = int(np.searchsorted(keys, node.of[k]))
                if overlap + min(node.span - k, left.span - at) < need or at == len(keys):
                    break
                part = node.of[k : min(k + step, node.end)]
                part = part[: int(np.searchsorted(part, keys[-1], side="right"))]
                places = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
                overlap += int(np.count_nonzero(keys[places] == part))
                k += len(part)
                step *= 2
            if k < node.end:
                if overlap + min(node.span - k, left.span - at) < need:
                    continue
                # left's known keys end before this one: what is below is judged by lengths alone
                rest, inside = left.span - len(keys), [node]
                while inside:
                    x = inside.pop()
                    inside += x.below
                    found += [s.id for s in x.leaves if overlap + min(s.span - k, rest) >= self.need(n, s.size)]
                continue
            for s in node.leaves:
                known = int(np.searchsorted(keys, s.keys[-1], side="right")) if len(s.keys) else 0
                if overlap + min(s.span - k, left.span - known) >= self.need(n, s.size):
                    found.append(s.id)
            todo += [(x, overlap) for x in node.below]
        return found


def verified(pairs: DataFrame, texts: DataFrame, n: int, threshold: float, levels) -> DataFrame:
    """Of pairs (a, b) of classes those that reach the threshold: a, b.  texts: doc_id, z."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / IN_GROUP).cast("int").alias("groups"))
    dealt = pairs.join(counts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int")).select("a", "b", "part")
    right = dealt.join(texts, dealt.b == texts.doc_id).select("a", "part", F.lit(1).alias("side"), "b", "z")
    left = dealt.select("a", "part").distinct().join(texts, F.col("a") == texts.doc_id).select("a", "part", F.lit(0).alias("side"), F.col("a").alias("b"), "z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, unpack = levels.value, zstandard.ZstdDecompressor().decompress
        group, lefts, others = None, [], []

        def links():
            tree = PrefixTree([Stored(b, keys, len(keys), len(keys)) for b, keys in others], threshold)
            out = sorted({(group[0], o) for x in lefts for o in tree.search(Stored(group[0], x, len(x), len(x)))})
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for a, part, side, b, z in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4)):
                if (a, part) != group:
                    yield links()
                    group, lefts, others = (a, part), [], []
                keys = ordered(unpack(z.as_py()), n, order)
                if side:
                    others.append((b, keys))
                else:
                    lefts.append(keys)
        yield links()

    both = left.unionByName(right).repartition("a", "part").sortWithinPartitions("a", "part", "side")
    return both.mapInArrow(lean(run), "a long, b long")


def reach(a_size, a_pos, b_size, b_pos, threshold: float):
    """Whether two sets whose first shared key stands at these places can reach the threshold (Columns)."""
    both, n, m = F.least(a_size - a_pos, b_size - b_pos), F.least(a_size, b_size), F.greatest(a_size, b_size)
    return (both >= F.lit(threshold / (1 + threshold)) * (a_size + b_size) - 1e-9) & (n >= F.lit(threshold) * m - 1e-9)


def across(members: DataFrame, tails: Callable[[DataFrame], DataFrame], found: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of classes in different components that share a key, as far as the bounds admit them.

    members: rep, size, pos, key; found: node, component; tails adds to rows `tail`, what a tree stores of the set from
    pos on.  Of a key's classes those outside of its largest component (the others need no comparison with one
    another) search trees of all of them.  Trees have about IN_TREE classes; a search is dealt to all trees of its
    key, and the searches of a tree to several tasks.
    """
    held = members.join(found, members.rep == found.node, "left").withColumn("component", F.coalesce("component", "rep")).drop("node")
    # the largest set that can be linked with this one, if the key is the first that they share
    held = held.withColumn("far", F.floor((F.col("size") - F.col("pos")) * ((1 + threshold) / threshold) - F.col("size") + 1e-6))
    counted = held.groupBy("key", "component").agg(F.count("*").alias("n"), F.min("size").alias("lo"), F.max("size").alias("up"), F.max("far").alias("far"))
    main = counted.groupBy("key").agg(F.max(F.struct("n", "component", "lo", "up", "far")).alias("main"), F.sum("n").alias("all"), F.count("*").alias("parts")).filter("parts > 1")
    rest = counted.join(main.hint("merge"), "key").filter(F.col("component") != F.col("main.component"))
    mixed = rest.groupBy("key").agg(
        F.first("main").alias("m"), F.struct(F.min("lo").alias("lo"), F.max("up").alias("up"), F.max("far").alias("far")).alias("o"),
        F.ceil(F.first("all") / IN_TREE).cast("int").alias("trees"), F.ceil(F.sum("n") / (8 * IN_TREE)).cast("int").alias("searches"), (F.count("*") > 1).alias("several"),
    )
    # rows that the sizes and places of no class in another component fit take no part
    fits = lambda o: (o["lo"] <= F.col("far")) & (F.col("size") <= o["far"]) & (o["lo"] * threshold <= F.col("size") + 1e-6) & (o["up"] >= F.col("size") * threshold - 1e-6)
    m, o = F.col("m"), F.col("o")
    needed = F.when(F.col("component") == m["component"], fits(o)).otherwise(fits(m) | (F.col("several") & fits(o)))
    rows = keep(held.join(mixed.hint("merge"), "key").filter(needed).select("key", "rep", "size", "pos", "component", m["component"].alias("main"), "trees", "searches"))
    tailed = tails(rows)
    tree, search = F.pmod(F.xxhash64("rep"), F.col("trees")).cast("int"), F.pmod(F.xxhash64("rep"), F.col("searches")).cast("int")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    columns = ["key", "tree", "search", "side", "rep", "size", "pos", "component", "tail"]
    stored = tailed.withColumn("tree", tree).withColumn("search", F.explode(each("searches"))).withColumn("side", F.lit(0)).select(*columns)
    searching = (
        tailed.filter("component <> main").withColumn("tree", F.explode(each("trees"))).withColumn("search", search)
        .withColumn("side", F.lit(1)).select(*columns)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, trees, stored_sets, component = None, None, [], {}
        for batch in batches:
            out, tail = set(), batch.column(8)
            starts, flat = tail.offsets.to_pylist(), tail.values.to_numpy(zero_copy_only=False).view(np.uint64)
            tails_of = [flat[i:j] for i, j in zip(starts, starts[1:])]
            for key, t, s, side, rep, size, pos, own, tail in zip(*(c.to_pylist() for c in batch.columns[:8]), tails_of):
                if (key, t, s) != group:
                    group, trees, stored_sets, component = (key, t, s), None, [], {}
                one = Stored(rep, tail.copy(), size, size - pos)
                if not side:
                    stored_sets.append(one)
                    component[rep] = own
                    continue
                if trees is None:  # rows of side 0 come first
                    by_size = lambda x: x.size
                    trees = [PrefixTree(list(g), threshold) for _, g in groupby(sorted(stored_sets, key=by_size), by_size)]
                out.update((min(rep, other), max(rep, other)) for x in trees for other in x.search(one) if component[other] != own)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in sorted(out)], pa.int64()) for i in (0, 1)], ["a", "b"])

    both = stored.unionByName(searching).repartition("key", "tree", "search").sortWithinPartitions("key", "tree", "search", "side")
    return both.mapInArrow(lean(run), "a long, b long").distinct()


def groups(docs: DataFrame, n: int = 5, threshold: float = 0.8, by_parts: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Null and empty texts, and texts of blanks, have no n-grams and are alone; a row without doc_id has no
    component_id and links nothing; rows that share a doc_id are judged by their own texts; other columns are not
    read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    named = docs.filter("doc_id IS NOT NULL")
    levels = spark.sparkContext.broadcast(frequency_levels(named, n))
    whole = keep(sets(docs, n, threshold, levels, by_parts))
    # a class is represented by its smallest document, and brings that one's keys along: keys are shuffled once
    first = F.min(F.struct("doc_id", "size", "keys")).alias("m")
    classes = keep(whole.filter("size > 0 AND doc_id IS NOT NULL").groupBy("print").agg(first).select("print", F.col("m.doc_id").alias("rep"), "m.size", "m.keys"))
    every = keep(whole.drop("keys"))
    forget(whole)
    # the class in which the n-gram comes first is the hub of all that have it; the smallest class, of those with a part.
    # what is joined here grows with the input, so it is never broadcast
    if by_parts:
        keys = classes.select("rep", "size", F.lit(0).alias("pos"), F.explode("keys").alias("key"))
        hubs = keys.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).filter("hub < last").drop("last")
        members = keep(keys.join(hubs.hint("merge"), "key"))
        near = members.filter("hub <> rep").withColumnRenamed("hub", "a")
    else:
        keys = classes.select("rep", "size", F.posexplode("keys").alias("pos", "key"))
        hubs = keys.groupBy("key").agg(F.min(F.struct("pos", "rep", "size")).alias("hub"), F.count("*").alias("n")).filter("n > 1").drop("n")
        members = keep(keys.join(hubs.hint("merge"), "key"))
        fits = reach(F.col("hub.size"), F.col("hub.pos"), F.col("size"), F.col("pos"), threshold)
        near = members.filter((F.col("hub.rep") != F.col("rep")) & fits).withColumn("a", F.col("hub.rep"))
    stars = keep(near.select("a", F.col("rep").alias("b")).distinct())
    texts = keep(packed(named).join(members.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"))
    links = keep(verified(stars, texts, n, threshold, levels))
    found = keep(components(links))

    def tails(rows: DataFrame) -> DataFrame:
        if not by_parts:
            return rows.join(classes.select("rep", "keys").hint("merge"), "rep").withColumn("tail", F.slice("keys", F.col("pos") + 1, TAIL))
        reps = rows.select(F.col("rep").alias("doc_id")).distinct()
        return rows.join(keep(heads(texts.join(reps.hint("merge"), "doc_id", "left_semi"), n, threshold, levels)).hint("merge"), "rep")

    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = across(members, tails, found, threshold).join(tried, ["a", "b"], "left_anti")
    more = keep(verified(keep(pairs), texts, n, threshold, levels))
    final = found if more.isEmpty() else keep(components(links.union(more)))
    of_class = classes.select("print", "rep").join(final, F.col("rep") == final.node, "left").select("print", F.coalesce("component", "rep").alias("component_id"))
    return (
        every.join(of_class, "print", "left")
        .select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"))
    )


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, threshold=0.9, by_parts=True)
