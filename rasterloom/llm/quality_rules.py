"""Quality of documents by weak supervision: rules vote or abstain, and a latent-class model weighs the votes.

Each rule says good (1), bad (-1) or nothing (0) about a document from counts over its whole text.  The votes of
all documents come down to counts of vote patterns, at most 3 ** rules of them however large the corpus, and
expectation-maximisation over that table estimates how often each rule says what about good and bad documents.
A document's verdict is its posterior probability of being good, not a conjunction of rules.

Everything is built-in functions: texts are mapped where they are read (no shuffle of texts), only the pattern
counts are shuffled, and the iterations are one expression over the pattern table in one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, table, words_of

BLANKS = " \t\n\x0b\x0c\r"
#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words that stand in a window of eight words found twice or more in the text, the first included."""
    size = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), size - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(found: Column) -> Column:
        placed = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(placed, lambda p: F.filter(p, lambda x, i: F.coalesce(
            (F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"]), F.get(p, i - 1)["h"] == x["h"],
            F.get(p, i + 1)["h"] == x["h"], F.lit(False))))
        places = F.sort_array(F.transform(again, lambda x: x["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        step = lambda a, i: F.struct(
            (a["n"] + (i + WINDOW) - F.greatest(i, a["end"])).cast("long").alias("n"), (i + WINDOW).alias("end"))
        return F.aggregate(places, start, step)["n"]

    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(size < WINDOW, F.lit(0).cast("long")).otherwise(counted)


def count_of(text: Column, characters: str) -> Column:
    """How many characters of the text are among these."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with what the rules look at, in columns named q_*; a null text counts as an empty one."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda s: F.length(F.translate(s, BLANKS, "")) > 0)
    return (
        docs.withColumn("q_words", words_of(F.col(text)))
        .withColumns({
            "q_n_words": F.size("q_words").cast("long"),
            "q_word_chars": F.length(F.translate(whole, BLANKS, "")).cast("long"),
            "q_n_symbols": count_of(whole, SYMBOLS),
            "q_n_dup_lines": let(lines, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long"),
            "q_n_lines": F.size(lines).cast("long"),
            "q_n_repeat_words": repeat_words(F.col("q_words")),
            "q_n_capitals": count_of(whole, CAPITALS),
            "q_n_shouts": count_of(whole, "!"),
        })
        .drop("q_words")
    )


def votes() -> list[Column]:
    """The rules.  Each votes by two bounds on a ratio, and abstains between them or where there's nothing to go by."""

    def ratio(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))

    def low(value: Column, good: float, bad: float) -> Column:
        return F.when(value <= good, 1).when(value > bad, -1).otherwise(0)

    mean = ratio("q_word_chars", "q_n_words")
    return [
        F.when(F.col("q_n_words") >= 50, 1).when(F.col("q_n_words") < 20, -1).otherwise(0),
        F.when(mean.between(3, 10), 1).when((mean < 2.5) | (mean > 14), -1).otherwise(0),
        low(ratio("q_n_symbols", "q_n_words"), 0.02, 0.1),
        low(ratio("q_n_dup_lines", "q_n_lines"), 0.1, 0.5),
        low(ratio("q_n_repeat_words", "q_n_words"), 0.05, 0.3),
        low(ratio("q_n_capitals", "q_word_chars"), 0.15, 0.3),
        low(ratio("q_n_shouts", "q_n_words"), 0.02, 0.2),
    ]


def posteriors(patterns: DataFrame, rules: int, rounds: int = 30, sure: float = 10.0) -> DataFrame:
    """Posterior probability of good for each vote pattern, by expectation-maximisation over their counts.

    patterns: (pattern: array of votes, n: documents with it).  The model is that of latent classes: votes are
    independent given the class, and each class has its own chances of bad, none and good from each rule.  Without
    more, the two classes may settle on any two clusters of patterns; so the chances are maximum a posteriori ones,
    and the first guess counts as much as `sure` times all documents for the good class, once for the bad one.  All
    rows come together in one array, of at most 3 ** rules entries.  Sums run in the order of the patterns, so
    that the result is always the same.
    """
    kinds = (-1, 0, 1)
    cells = [(r, k) for r in range(rules) for k in kinds]
    at = {c: i for i, c in enumerate(cells)}
    # chances under bad and good to begin with: a rule seldom calls a good document bad
    guess = {-1: (0.15, 0.0005), 0: (0.1, 0.06), 1: (0.75, 0.9395)}
    begin = F.struct(
        F.lit(0.85).alias("good"),
        F.array(*[F.lit(guess[k][0]) for _, k in cells]).alias("if_bad"),
        F.array(*[F.lit(guess[k][1]) for _, k in cells]).alias("if_good"),
    )

    def posterior(model: Column, votes: Column) -> Column:
        # the cell of rule r and vote v is 3 r + v + 1
        odds = F.aggregate(
            F.sequence(F.lit(0), F.lit(rules - 1)), F.log(model["good"]) - F.log(F.lit(1.0) - model["good"]),
            lambda a, r: a + F.log(F.get(model["if_good"], r * 3 + F.get(votes, r) + 1))
            - F.log(F.get(model["if_bad"], r * 3 + F.get(votes, r) + 1)),
        )
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))

    def step(model: Column, rows: Column) -> Column:
        zero = F.array_repeat(F.lit(0.0), len(cells))
        weighed = F.transform(rows, lambda p: F.struct(
            p["pattern"].alias("v"), (p["n"] * posterior(model, p["pattern"])).alias("g"), p["n"].cast("double").alias("n")))
        sums = F.aggregate(
            weighed,
            F.struct(zero.alias("bad"), zero.alias("good"), F.lit(0.0).alias("g"), F.lit(0.0).alias("n")),
            lambda a, p: F.struct(
                F.transform(a["bad"], lambda s, i: s + F.when(F.get(p["v"], (i / 3).cast("int")) == i % 3 - 1, p["n"] - p["g"]).otherwise(0.0)).alias("bad"),
                F.transform(a["good"], lambda s, i: s + F.when(F.get(p["v"], (i / 3).cast("int")) == i % 3 - 1, p["g"]).otherwise(0.0)).alias("good"),
                (a["g"] + p["g"]).alias("g"), (a["n"] + p["n"]).alias("n"),
            ),
        )
        return let(sums, lambda s: F.struct(
            ((s["g"] + 1.0) / (s["n"] + 2.0)).alias("good"),
            F.transform(s["bad"], lambda x, i: (x + s["n"] * F.get(begin["if_bad"], i)) / (s["n"] - s["g"] + s["n"])).alias("if_bad"),
            F.transform(s["good"], lambda x, i: (x + sure * s["n"] * F.get(begin["if_good"], i)) / (s["g"] + sure * s["n"])).alias("if_good"),
        ))

    rows = patterns.agg(F.sort_array(F.collect_list(F.struct("pattern", "n"))).alias("rows"))
    model = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begin, lambda m, _: step(m, F.col("rows")))
    fitted = rows.withColumn("model", model)
    each = fitted.select(F.explode("rows").alias("row"), "model")
    return each.select(F.col("row.pattern").alias("pattern"), posterior(F.col("model"), F.col("row.pattern")).alias("posterior"))


def judged(docs: DataFrame, text: str = "text", drop_text: bool = False, least: float = 0.5) -> DataFrame:
    """docs with their counts, q_base_failed, q_posterior and q_kept; all added columns are named q_*.

    Null and empty texts have no words and fail; repeated rows are judged alike and counted each; an empty table
    gives no rows; columns of docs that are named as an added one are replaced (put columns that must stay in a
    struct, as the pipeline does).  What was counted is written to
    the shared folder once (without the text if drop_text), so texts are gone through once.
    """
    counted = counts(docs, text)
    found = keep(
        (counted.drop(text) if drop_text else counted)
        .withColumn("q_pattern", F.array(*[v.cast("int") for v in votes()]))
        .withColumn("q_base_failed", (F.col("q_n_words") < 20) | (100 * F.col("q_n_repeat_words") > 30 * F.col("q_n_words")))
    )
    patterns = found.groupBy(F.col("q_pattern").alias("pattern")).agg(F.count("*").alias("n"))
    # at most 3 ** 7 rows: broadcast
    known = posteriors(patterns, len(votes())).select(F.col("pattern").alias("q_known"), F.col("posterior").alias("q_posterior"))
    return (
        found.join(F.broadcast(known), F.col("q_pattern") == F.col("q_known")).drop("q_known")
        .withColumn("q_kept", ~F.col("q_base_failed") & (F.col("q_posterior") >= least))
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"]
    return judged(docs, drop_text=True).select("doc_id", *[F.col(f"q_{n}").alias(n) for n in names])
