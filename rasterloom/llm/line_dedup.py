"""Repeated runs of lines across documents: prefix doubling names runs, and later copies are deleted.

The corpus is read as sequences of line identities.  Prefix doubling names the runs of 1, 2, 4, ... lines that
begin at each line: two runs of 2k lines have the same name if their halves have, and the name of a class is the
place of its earliest member, so names are exact.  The members of a class are the suffixes of one interval of the
suffix array whose common prefix has that many lines; classes of one member leave the intervals, and with them
the tables.  A run of any length is then named by two overlapping runs of a power of two.

Runs below `min_words` words have a criterion of their own, by lines: a line of `short_words` words or more, or one
that has `short_copies` copies or more, goes where it stands again, alone or not.  A run with so many copies has
lines with as many, so no longer runs need be named for it.  op7_line_dedup is without it (its SQL fixes the
bound); op7_short_runs and the pipeline have it.

A run counts if it has `min_words` words.  All lines of maximal repeated runs are those of repeated runs that are
no longer than needed from their first line on, or back from their last line; each line with a word in it has at
least one word, so these have at most `min_words` lines, and the number of doublings is fixed, not set by the
data.  Only the lines of repeated classes take part in any step after the first.  Every grouping is a groupBy
(combined before it is shuffled) and a join back, never a window over a class.  Classes with more than 1/PARTS of
all lines, which can't be more than PARTS, are joined back in parts, so a line or a run that a third of all
documents share meets in no one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST_ID, keep, table
from .quality_rules import BLANKS, let

DOC = ["doc", "text_hash"]
#: What makes a short line one to delete.
SHORT = {"short_words": 5, "short_copies": 10}
#: Classes of more members than this share of all lines, and than PART, are joined back in parts.
PARTS, PART = 256, 1000


def lines_of(docs: DataFrame) -> DataFrame:
    """A row for each line with a word: doc, text_hash, seq (among those), pos (among all), a, b (identity), n_words."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    placed = F.transform(F.split(whole, "\n"), lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    some = F.filter(placed, lambda x: F.length(F.translate(x["s"], BLANKS, "")) > 0)
    spaced = lambda c: F.trim(F.translate(c, "\t\n\x0b\x0c\r", "     "))
    return (
        docs.select(
            F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64("text").alias("text_hash"),
            F.posexplode(some).alias("seq", "line"),
        )
        .select(
            *DOC, "seq", F.col("line.i").alias("pos"),
            F.xxhash64(F.lit(1), "line.s").alias("a"), F.xxhash64(F.lit(2), "line.s").alias("b"),
            F.size(F.array_remove(F.split(spaced(F.col("line.s")), " "), "")).alias("n_words"),
        )
    )


def place() -> Column:
    return F.struct("doc", "seq", "text_hash")


def classes(rows: DataFrame, key: list[str]) -> DataFrame:
    """The keys that two places or more have, with the earliest as their name."""
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(place()).alias("name")).filter("n > 1")


def joined_back(rows: DataFrame, classes: DataFrame, key: list[str], most: int) -> DataFrame:
    """rows with the columns of their class (but n), without rows of no class; a class with n > most in parts of about most.

    As n > most can hold for few classes only (see PARTS), these are broadcast to deal their rows.
    """
    often = classes.filter(F.col("n") > most).select(*key, F.ceil(F.col("n") / most).alias("parts"))
    dealt = rows.join(F.broadcast(often), key, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(*DOC, "seq"), F.col("parts")), F.lit(0))).drop("parts")
    each = classes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / most) - 1)))
    return dealt.join(each, [*key, "part"]).drop("part")


def minimal_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """Of unbroken repeated lines, the shortest runs of min_words words from each line on and back: doc, text_hash, seq, size."""
    row = lines.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("seq", "n_words"))).alias("rows"))

    def shortest(rows: Column, i: Column, back: bool) -> Column:
        near = F.reverse(F.slice(rows, F.greatest(i - (min_words - 2), F.lit(1)), F.least(i + 1, F.lit(min_words)))) if back else F.slice(rows, i + 1, min_words)
        first = F.get(rows, i)["seq"]
        begin = F.struct(F.lit(0).alias("words"), F.lit(0).alias("size"))

        def step(a: Column, x: Column) -> Column:
            follows = (F.abs(x["seq"] - first) == a["size"]) & (a["words"] < min_words)
            return F.when(follows, F.struct((a["words"] + x["n_words"]).alias("words"), (a["size"] + 1).alias("size"))).otherwise(a)

        found = F.aggregate(near, begin, step)
        start = first - found["size"] + 1 if back else first
        return F.when(found["words"] >= min_words, F.struct(start.alias("seq"), found["size"].alias("size")))

    each = lambda back: F.transform(F.col("rows"), lambda x, i: shortest(F.col("rows"), i, back))
    runs = F.array_compact(F.array_distinct(F.concat(each(False), each(True))))
    return row.select(*DOC, F.explode(runs).alias("run")).select(*DOC, "run.seq", "run.size")


def repeated_lines(docs: DataFrame, min_words: int = 25, short_words: int | None = None, short_copies: int | None = None) -> DataFrame:
    """doc, text_hash, deleted: the places of lines to delete, ascending, of the documents that have any.

    doc is the doc_id (LAST_ID for null).  A line is deleted if it lies in a run of lines with min_words words or
    more (blank lines don't count) that also stands earlier: in a document with a smaller doc_id, or further up
    in the same text; and if it stands earlier by itself and has short_words words or more, or short_copies copies
    or more in all (None: not for this).  Null and empty texts have no lines; a repeated row counts once; other columns aren't read.
    """
    every = keep(lines_of(docs).distinct())
    most = max(PART, every.count() // PARTS)
    lines = keep(joined_back(every, classes(every, ["a", "b"]), ["a", "b"], most).select(*DOC, "seq", "pos", "n_words", "name", "n"))
    level, levels = lines.select(*DOC, "seq", "name"), []
    doublings = max(0, (min_words - 1).bit_length())
    for k in range(doublings + 1):
        levels.append(level.withColumn("level", F.lit(k)))
        if k < doublings:
            after = level.select(*DOC, (F.col("seq") - (1 << k)).alias("seq"), F.col("name").alias("next"))
            pairs = level.join(after, [*DOC, "seq"])
            named = pairs.groupBy("name", "next").agg(F.count("*").alias("n"), F.min(place()).alias("first")).filter("n > 1")
            level = keep(joined_back(pairs, named, ["name", "next"], most).select(*DOC, "seq", F.col("first").alias("name")))
    names = reduce(DataFrame.unionByName, levels)
    runs = minimal_runs(lines, min_words).withColumn("level", F.floor(F.log2(F.col("size"))).cast("int"))
    ends = names.select(*DOC, F.col("seq").alias("last_seq"), "level", F.col("name").alias("tail"))
    named = keep(
        runs.join(names, [*DOC, "seq", "level"])
        .withColumn("last_seq", (F.col("seq") + F.col("size") - F.pow(F.lit(2), F.col("level"))).cast("int"))
        .join(ends, [*DOC, "last_seq", "level"])
        .select(*DOC, "seq", "size", F.col("name").alias("head"), "tail")
    )
    first = named.groupBy("size", "head", "tail").agg(F.count("*").alias("n"), F.min(place()).alias("first")).filter("n > 1")
    later = joined_back(named, first, ["size", "head", "tail"], most).filter(F.col("first") != place())
    gone = later.select(*DOC, F.explode(F.sequence(F.col("seq"), F.col("seq") + F.col("size") - 1)).alias("seq"))
    if short_words is not None or short_copies is not None:
        often = F.lit(False)
        if short_words is not None:
            often |= F.col("n_words") >= short_words
        if short_copies is not None:
            often |= F.col("n") >= short_copies
        gone = gone.unionByName(lines.filter((F.col("name") != place()) & often).select(*DOC, "seq"))
    gone = gone.distinct()
    return gone.join(lines, [*DOC, "seq"]).groupBy(*DOC).agg(F.sort_array(F.collect_list("pos")).alias("deleted"))


def without_lines(docs: DataFrame, deleted: DataFrame, count: str = "d_n_deleted") -> DataFrame:
    """docs with the deleted lines taken out of text, and how many (0 where none) in a column named `count`.

    Other columns stay, whatever their names; one that is named as `count` is an error.
    """
    if count.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs has a column {count}: name another for the number of deleted lines")
    known = deleted.select(F.col("doc").alias("of"), "text_hash", "deleted")
    whole = docs.select(F.struct(*docs.columns).alias("whole"))
    text = F.col("whole.text")
    rest = let(F.split(text, "\n"), lambda lines: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("deleted")), lambda i: F.get(lines, i)), "\n"))
    return (
        whole.join(known, (F.coalesce(F.col("whole.doc_id").cast("long"), F.lit(LAST_ID)) == F.col("of")) & (F.xxhash64(text) == F.col("text_hash")), "left")
        .select(
            *[F.when(F.col("deleted").isNull(), text).otherwise(rest).alias(c) if c.lower() == "text" else F.col("whole")[c].alias(c) for c in docs.columns],
            F.coalesce(F.size("deleted"), F.lit(0)).cast("long").alias(count),
        )
    )


def left_of(docs: DataFrame, deleted: DataFrame) -> DataFrame:
    return without_lines(docs, deleted).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("d_n_deleted").alias("n_deleted"),
        F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines deleted, and the digest of the text that is left (null: empty)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return left_of(docs, repeated_lines(docs))


def op7_short_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op7_line_dedup, with the criterion for short runs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return left_of(docs, repeated_lines(docs, **SHORT))


OP7_SQL = r"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
l AS (SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS pos FROM t),
w AS (SELECT *, len(list_filter(string_split(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    '), ' '), lambda x: x <> '')) AS nw FROM l),
d AS (SELECT doc_id, list(line ORDER BY pos) AS ls, list(nw ORDER BY pos) AS ns, list(pos ORDER BY pos) AS ps FROM w WHERE nw > 0 GROUP BY doc_id),
i AS (SELECT doc_id, ls, ns, ps, unnest(range(1, len(ls) + 1)) AS i FROM d),
r AS (SELECT doc_id, ls, ps, i,
        list_filter(range(1, 26), lambda m: i + m - 1 <= len(ls) AND list_sum(ns[i:i + m - 1]) >= 25)[1] AS f,
        list_filter(range(1, 26), lambda m: i - m + 1 >= 1 AND list_sum(ns[i - m + 1:i]) >= 25)[1] AS b FROM i),
u AS (SELECT doc_id, i AS st, f AS m, ls, ps FROM r WHERE f IS NOT NULL UNION ALL SELECT doc_id, i - b + 1, b, ls, ps FROM r WHERE b IS NOT NULL),
k AS (SELECT doc_id, st, m, ps, array_to_string(ls[st:st + m - 1], chr(10)) AS run FROM u),
e AS (SELECT run, min((doc_id, st)) AS first FROM k GROUP BY run),
g AS (SELECT DISTINCT k.doc_id, unnest(k.ps[k.st:k.st + k.m - 1]) AS pos FROM k JOIN e USING (run) WHERE (k.doc_id, k.st) > e.first),
h AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text FROM l ANTI JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT t.doc_id, coalesce(h.n, 0) AS n_deleted, sha256(coalesce(o.text, '')) AS kept_sha256
FROM t LEFT JOIN h USING (doc_id) LEFT JOIN o USING (doc_id)
"""

#: As OP7_SQL, with the lines that the criterion for short runs deletes.
OP7_SHORT_SQL = OP7_SQL.replace(
    "\nh AS (",
    "\nc AS (SELECT line, min((doc_id, pos)) AS first, count(*) AS n FROM w WHERE nw > 0 GROUP BY line),"
    "\ns AS (SELECT doc_id, pos FROM g UNION SELECT w.doc_id, w.pos FROM w JOIN c USING (line)"
    " WHERE nw > 0 AND (w.doc_id, w.pos) > c.first AND (nw >= 5 OR n >= 10)),\nh AS (",
).replace("FROM g GROUP BY", "FROM s GROUP BY").replace("FROM l ANTI JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos", "FROM l ANTI JOIN s ON l.doc_id = s.doc_id AND l.pos = s.pos")
