"""License notices in texts: exact seeds locate candidates, bounded-error matching verifies them.

A notice that may hold k edits is cut into k + 1 pieces; any occurrence within k edits holds one piece unchanged
(pigeonhole).  Pieces are found by plain substring search over the normalised text (words in lower case, one
space apart), and only around them the regex library looks for the notice with at most k errors.  Digits of a
notice stay exact, for a version isn't a spelling mistake, and notices under ten characters allow no edits.

No shuffle: texts are mapped where they are read.
"""

from __future__ import annotations

from bisect import bisect_left
from typing import NamedTuple

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_row, table

#: Phrases of whole words, and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notices that are searched for with edits, the base ones included.
NOTICES = BASE | {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution": "cc-by",
    "all rights reserved": "all-rights-reserved",
}

#: Letters A-Z to a-z; digits, a-z and bytes of other scripts stay; all else is a space.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def normalise(text: str | None, size: int = 1 << 20) -> bytes:
    """The words of a text in UTF-8, A-Z in lower case, one space apart."""
    spaced, parts, at = (text or "").encode().translate(_WORD_BYTES), [], 0
    while at < len(spaced):
        end = spaced.find(b" ", at + size)
        end = len(spaced) if end < 0 else end
        if words := spaced[at:end].split():
            parts.append(b" ".join(words))
        at = end
    return b" ".join(parts)


class Span(NamedTuple):
    label: str
    first_word: int
    n_words: int
    edits: int


class Scanner:
    def __init__(self, notices: dict[str, str] = NOTICES, per_edit: int = 10, most: int = 3):
        self.notices = [(p.encode(), label, min(most, len(p) // per_edit)) for p, label in notices.items()]

    def ready(self) -> "Scanner":
        self.rules = []
        for phrase, label, k in self.notices:
            step = -(-len(phrase) // (k + 1))
            seeds = [(at, phrase[at : at + step]) for at in range(0, len(phrase), step)]
            parts = [
                b"(?:%s){e<=%d}" % (regex.escape(part), k) if k and not part.isdigit() else regex.escape(part)
                for part in regex.split(rb"(\d+)", phrase) if part
            ]
            self.rules.append((phrase, label, k, seeds, regex.compile(b"(?b)(?<![^ ])" + b"".join(parts) + b"(?![^ ])")))
        return self

    def spans(self, words: bytes) -> list[Span]:
        """All notices in normalised text, exact places of overlapping ones included, in order of their labels."""
        found = []
        for phrase, label, k, seeds, pattern in self.rules:
            windows: dict[int, int] = {}
            for offset, seed in seeds:
                at = words.find(seed)
                while at >= 0:
                    # whole words, so that what stands around a notice doesn't count as an edit
                    start = words.rfind(b" ", 0, max(0, at - offset - k)) + 1
                    end = words.find(b" ", min(len(words), at - offset + len(phrase) + k))
                    windows[start] = max(windows.get(start, 0), len(words) if end < 0 else end)
                    at = words.find(seed, at + 1)
            places: dict[int, tuple[int, int]] = {}
            for start, end in windows.items():  # none is longer than its notice, two words and some edits
                for m in matches(pattern, words, start, end):
                    size, edits = m.end() - m.start(), sum(m.fuzzy_counts)
                    if m[0].count(b" ") == phrase.count(b" ") or edits:
                        places[m.start()] = min(places.get(m.start(), (size, edits)), (size, edits), key=lambda p: (p[1], p[0]))
            found += best(label, places, words)
        return found


def best(label: str, places: dict[int, tuple[int, int]], words: bytes) -> list[Span]:
    """Spans at places (size, edits): all exact ones, and of overlapping others those with the fewest edits."""
    starts, longest = sorted(places), max((size for size, _ in places.values()), default=0)
    out, counted, spaces = [], 0, 0
    for at in starts:
        size, edits = places[at]
        spaces += words.count(b" ", counted, at)
        counted = at
        if edits:
            near = starts[bisect_left(starts, at - longest) : bisect_left(starts, at + size)]
            if any(at < b + places[b][0] and (places[b][1], b) < (edits, at) for b in near):
                continue  # the same notice with fewer edits
        out.append((edits, at, Span(label, spaces, words.count(b" ", at, at + size) + 1, edits)))
    return [span for _, _, span in sorted(out)]


def matches(pattern, words: bytes, start: int, end: int):
    """The best match between two places, and those of what stands before it and of what begins after its first word."""
    parts = [(start, end)]
    while parts:
        start, end = parts.pop()
        if m := pattern.search(words, start, end):
            yield m
            if m.start() > start:
                parts.append((start, m.start() - 1))
            if after := words.find(b" ", m.start() + 1, end) + 1:
                parts.append((after, end))


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text", notices: dict[str, str] = NOTICES) -> DataFrame:
    """A row for each document: id, n_words and the notices found, with label, first word, words and edits.

    Null and empty texts have no words and no notices; repeated rows and null ids give a row each; other columns
    are not read.
    """
    scanner = Scanner(notices)

    def make():
        spans = scanner.ready().spans

        def row(doc_id, text):
            words = normalise(text)
            return doc_id, words.count(b" ") + bool(words), [s._asdict() for s in spans(words)]

        return row

    return per_row(
        docs.select(F.col(id_column).cast("long"), F.col(text)), make,
        "doc_id long, n_words long, spans array<struct<label: string, first_word: int, n_words: int, edits: int>>",
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures come from the spans without edits of the base notices; the score is that of the best span.

    The score of a span is 1 - edits / characters of its notice (1 for an exact one); 0 where there is none.
    """
    sizes = F.create_map(*[F.lit(x) for p, label in NOTICES.items() for x in (label, float(len(p)))])
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda s: s.label))), ",")
    base = F.filter("spans", lambda s: s.label.isin(*BASE.values()) & (s.edits == 0))
    first = F.transform("base", lambda s: s.first_word.cast("long"))
    score = F.transform("spans", lambda s: F.lit(1.0) - s.edits / F.element_at(sizes, s.label))
    return (
        scan(table(spark, sf_dir, "documents"))
        .withColumn("base", base)
        .select(
            "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
            F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"),
            labels(F.col("base")).alias("base_labels"), labels(F.col("spans")).alias("labels"),
            F.greatest(F.lit(0.0), F.coalesce(F.array_max(score), F.lit(0.0))).alias("score"), "spans",
        )
    )
