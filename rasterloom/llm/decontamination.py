"""Benchmark passages in documents: spaced seeds find places, aligned windows with substitutions verify them.

A window of `window` words of a benchmark item counts as leaked if a document has it with at most
`substitutions` of the words replaced.  A mask is a set of places relative to a word; the hash of the words there
ignores all places in between.  The masks are chosen so that whichever words of a window are replaced, one mask
at one place misses them all (tests try every way), so the search loses nothing.  Hashes of the documents meet
those of the benchmark in a join; each hit fixes how the two texts lie against one another, and only there the
words are compared.

The benchmark's side is broadcast while its words are counted to be at most `most_words`; beyond that the hashes
are joined by a shuffle, whose skewed keys adaptive execution splits.  Texts aren't shuffled for the search.  They
are read again to be verified, with the hits (documents and places) broadcast while these are counted to be at
most `most_hits`; beyond that, the texts are shuffled once to meet them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, table
from .quality_rules import let

WINDOW, SUBSTITUTIONS = 13, 2
#: The places of each mask.  Every window of 13 with two replaced words has one of them unhurt.
MASKS = ((0, 1, 4, 5, 6, 7), (0, 1, 2, 4, 6, 7))
#: Items shorter than a window are matched whole, without substitutions, from this many words on.
LEAST = 8


def normal_words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.array_remove(F.split(spaced, " "), "")


def word_hashes(text: Column) -> Column:
    return F.transform(normal_words(text), lambda w: F.xxhash64(w))


def seeds(words: Column, masks) -> Column:
    """Of an array of word hashes: array of (seed hash, place), for every mask at every place."""
    none = F.array().cast("array<struct<seed:bigint,place:int>>")

    def of(n: int, mask: tuple) -> Column:
        last = F.size(words) - F.lit(mask[-1] + 1)
        seed = lambda i: F.xxhash64(F.lit(n), *[F.get(words, i + k) for k in mask])
        found = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(seed(i).alias("seed"), i.alias("place")))
        return F.when(last >= 0, found).otherwise(none)

    return F.concat(*[of(n, mask) for n, mask in enumerate(masks)])


def leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, substitutions: int = SUBSTITUTIONS, masks=MASKS,
    most_words: int = 500_000, most_hits: int = 1_000_000,
) -> DataFrame:
    """A row for each document and item of which it holds a window: doc_id, item_id, first_word, last_word, n_equal.

    first_word and last_word are where leaked windows begin and end, in words (runs of letters and digits) of the
    document; n_equal counts the equal words in the best place.  Null and empty texts hold nothing; items of under
    eight words or without an id are never found; documents with null ids are kept under null; repeated rows give one result; other
    columns are not read.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text")).alias("item")).filter(F.size("item") >= LEAST)
    size = items.agg(F.coalesce(F.sum(F.size("item")), F.lit(0)).alias("n")).first()["n"]
    small = F.broadcast if size <= most_words else (lambda df: df)
    wanted = small(
        items.select("item_id", F.explode(seeds(F.col("item"), masks)).alias("s"))
        .select("item_id", F.col("s.seed").alias("seed"), F.col("s.place").alias("item_place")).distinct()
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("doc_text"))
    # a text that two rows of one doc_id hold differently is told apart by its hash
    hits = (
        texts.withColumn("words", word_hashes(F.col("doc_text")))
        .select("doc_id", F.xxhash64("doc_text").alias("doc_hash"), F.explode(seeds(F.col("words"), masks)).alias("s"))
        .select("doc_id", "doc_hash", F.col("s.seed").alias("seed"), F.col("s.place").alias("place"))
        .join(wanted, "seed")
        .select("doc_id", "doc_hash", "item_id", (F.col("place") - F.col("item_place")).alias("shift"))
        .distinct()
    )
    # few documents hold a seed: broadcast what they are while it is counted to be small, else join by a shuffle
    hits = keep(hits)
    few = F.broadcast if hits.count() <= most_hits else (lambda df: df)
    places = few(hits.groupBy(F.col("doc_id").alias("hit_id"), "doc_hash").agg(F.collect_list(F.struct("item_id", "shift")).alias("hits")))
    both = texts.withColumn("own_hash", F.xxhash64("doc_text")).join(
        places, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("own_hash") == F.col("doc_hash"))
    )
    sides = (
        both.select("doc_id", word_hashes(F.col("doc_text")).alias("words"), F.explode("hits").alias("hit"))
        .select("doc_id", "words", F.col("hit.item_id").alias("item_id"), F.col("hit.shift").alias("shift")).join(small(items), "item_id")
    )
    length = F.size(F.col("item"))
    equal = F.transform(F.col("item"), lambda w, i: F.when(
        (i + F.col("shift") >= 0) & (F.get(F.col("words"), F.greatest(i + F.col("shift"), F.lit(0))) == w), 1).otherwise(0))
    most = F.least(length, F.lit(window))
    allowed = F.when(length >= window, substitutions).otherwise(0)

    def good(e: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), length - most), lambda s: F.aggregate(F.slice(e, s + 1, most), F.lit(0), lambda a, x: a + x) >= most - allowed)

    return (
        sides.withColumn("equal", equal)
        .withColumn("windows", let(F.col("equal"), good))
        .filter(F.size("windows") > 0)
        .groupBy("doc_id", "item_id")
        .agg(
            F.min(F.greatest(F.array_min("windows") + F.col("shift"), F.lit(0))).cast("long").alias("first_word"),
            F.max(F.least(F.array_max("windows") + F.col("shift") + most, F.size("words")) - 1).cast("long").alias("last_word"),
            F.max(F.aggregate("equal", F.lit(0), lambda a, x: a + x)).cast("long").alias("n_equal"),
        )
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Windows with at most 2 of 13 words replaced hold a run of at least 4 equal words: candidates by runs of four.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark),
dg AS (SELECT doc_id, i, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 4)),
bg AS (SELECT item_id, i, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 2)) AS i FROM b WHERE len(w) >= 8)),
c AS (SELECT DISTINCT dg.doc_id, bg.item_id, dg.i - bg.i AS shift FROM dg JOIN bg USING (g)),
v AS (SELECT c.*, b.w AS item, len(d.w) AS nd, least(len(b.w), 13) AS n, list_transform(range(1, len(b.w) + 1), lambda k: CASE WHEN k + shift >= 1 AND k + shift <= len(d.w) AND d.w[k + shift] = b.w[k] THEN 1 ELSE 0 END) AS e
      FROM c JOIN d USING (doc_id) JOIN b USING (item_id)),
s AS (SELECT *, list_filter(range(0, len(item) - n + 1), lambda p: list_sum(e[p+1:p+n]) >= n - CASE WHEN len(item) >= 13 THEN 2 ELSE 0 END) AS p FROM v)
SELECT doc_id, item_id, CAST(min(greatest(list_min(p) + shift, 0)) AS BIGINT) AS first_word, CAST(max(least(list_max(p) + shift + n, nd) - 1) AS BIGINT) AS last_word,
       CAST(max(list_sum(e)) AS BIGINT) AS n_equal
FROM s WHERE len(p) > 0 GROUP BY doc_id, item_id
"""
