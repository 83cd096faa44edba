"""Removal of words that stand in a window of words which a document with a smaller id holds too.

Super-k-mers.  The m-word strings of a window are ordered by a hash; the least (leftmost of equals) is the window's
minimiser.  Windows that follow one another and share a minimiser travel together, as one string of their words: about
half a window of windows in one and a half windows of words.  Equal windows have equal minimisers, so they meet in the
minimiser's bucket, where sorting tells exactly which are equal: first whole strings, then, where documents share
a minimiser but not the string, all windows by names for runs of 1, 2, 4, ... words.

Frequent strings.  Minimisers that occur often would fill their buckets.  A first pass finds the m-word strings that
make up a fixed share of all places (so there are few, however large the corpus), and these come after all others in the
order: a window takes one only if it has no other.  Such windows lie whole in passages that many documents share, so
their strings are equal, and a task sends each of them once, with its smallest document; windows that reach out of a
shared passage have minimisers of their own.

Where a string stands more than once in what a task reads, only the places in the smallest document stay open; the
others are to be removed, whatever the bucket finds.  Places to remove go to their documents by id and text, so not even
rows that share an id meet in one task.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST_ID, keep, table

_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_Q_BACK = pow(_Q, -1, 1 << 64)
_BYTES = np.frombuffer(hashlib.shake_256(b"words").digest(256 * 8), np.uint64) | np.uint64(1)

#: A row is a super-k-mer at a place: document, hash of its text, first word, windows, and string (-1: to be removed).
ROWS = {"doc": np.int64, "text": np.int64, "at": np.int64, "n": np.int32, "string": np.int64}
Rows = dict[str, np.ndarray]


class Shape(NamedTuple):
    """Words in a window and in a minimiser, and sizes that change the work but not its result."""

    window: int = 50
    m: int = 8
    #: Bytes of text that are cut together, and bytes of text for each bucket.
    batch: int = 1 << 22
    bucket: int = 1 << 23
    #: A string of m words is frequent if it makes up one place in `share`, and stands `least` times in a batch.
    share: int = 1 << 14
    least: int = 16
    #: Bytes of frequent strings that a task holds back.
    held: int = 1 << 26

    @property
    def reach(self) -> int:
        """Strings of m words in a window; also the most windows of a super-k-mer."""
        return self.window - self.m + 1


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Cut(NamedTuple):
    """Some texts end to end, their words joined by single spaces."""

    data: bytes
    starts: np.ndarray  # of words
    ends: np.ndarray
    until: np.ndarray  # for each word, the first word of the next text
    owner: np.ndarray  # for each word, its text
    grams: np.ndarray  # hashes of the m words from each word on


def cut(texts: list[bytes], shape: Shape) -> Cut:
    words = [t.split() for t in texts]  # at \x20 and \x09-\x0D
    data = b" ".join([b" ".join(w) for w in words if w])
    sizes = np.array([len(w) for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    until = np.repeat(np.cumsum(sizes), sizes)
    if not data:
        none = np.zeros(0, np.int64)
        return Cut(data, none, none, until, owner, np.zeros(0, np.uint64))
    raw = np.frombuffer(data, np.uint8)
    spaces = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate([[0], spaces + 1]), np.append(spaces, len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * powers(_Q, len(raw)), out=total[1:])
    h = mixed((total[ends] - total[starts]) * powers(_Q_BACK, len(raw))[starts] + (ends - starts).astype(np.uint64))
    grams, size, base = h, 1, 1
    for bit in bin(shape.m)[3:]:  # the hash of `size` words, doubled, and one word more where m's next bit is set
        grams = grams[:-size] * np.uint64(pow(_P, size, 1 << 64)) + grams[size:]
        size *= 2
        if bit == "1":
            grams = grams[: len(h) - size] * np.uint64(_P) + h[size : size + len(grams)]
            size += 1
    return Cut(data, starts, ends, until, owner, mixed(grams))


def super_kmers(c: Cut, shape: Shape, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First words, numbers of windows, minimisers, and whether these are frequent."""
    often = np.isin(c.grams, frequent)
    low = (c.grams >> np.uint64(1)) | (often.astype(np.uint64) << np.uint64(63))
    off, size = np.zeros(len(low), np.int64), 1
    while size < shape.reach and len(low):
        by = min(size, shape.reach - size)
        later = low[by:] < low[:-by]
        off = np.where(later, off[by:] + by, off[:-by])
        low = np.where(later, low[by:], low[:-by])
        size += by
    places = np.flatnonzero(np.arange(len(low)) + shape.window <= c.until[: len(low)])
    chosen = places + off[places]
    new = np.ones(len(places), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (places[1:] != places[:-1] + 1)
    at = np.flatnonzero(new)
    return places[at], np.diff(np.append(at, len(places))), c.grams[chosen[at]], often[chosen[at]]


def batches_of(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """Documents, hashes, first words and words of texts, in parts of about shape.batch bytes; longer texts overlap by a window less a word."""
    rows, held = [], 0
    for batch in batches:
        for doc, text, data in zip(*(batch.column(i) for i in range(3))):
            data = data.as_py() or b""
            parts = [(0, data)]
            if len(data) > shape.batch:
                words = data.split()
                step = max(shape.window, shape.batch * len(words) // len(data))
                parts = [(at, b" ".join(words[at : at + step + shape.window - 1])) for at in range(0, max(1, len(words) - shape.window + 1), step)]
            for at, part in parts:
                if rows and held + len(part) > shape.batch:
                    yield columns(rows)
                    rows, held = [], 0
                rows.append((doc.as_py(), text.as_py(), at, part))
                held += len(part)
    if rows:
        yield columns(rows)


def columns(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    doc, text, at, data = zip(*rows)
    return np.array(doc, np.int64), np.array(text, np.int64), np.array(at, np.int64), list(data)


def frequent_grams(texts: DataFrame, shape: Shape) -> np.ndarray:
    """Hashes of strings of m words that make up at least about one place in shape.share; so there are less than that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = defaultdict(int), 0
        for _, _, _, data in batches_of(batches, shape):
            grams = cut(data, shape).grams
            total += len(grams)
            known, times = np.unique(grams, return_counts=True)
            often = times >= max(shape.least, len(grams) // shape.share)
            for g, n in zip(known[often].tolist(), times[often].tolist()):
                found[g] += n
        keys = pa.array([None, *(g - (1 << 63) for g in found)], pa.int64())
        yield pa.RecordBatch.from_arrays([keys, pa.array([total, *found.values()], pa.int64())], ["gram", "n"])

    sums = keep(texts.select("doc", "text", "data").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    total = sums.filter("gram IS NULL").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    often = sums.filter(F.col("gram").isNotNull() & (F.col("n") * shape.share > total)).select("gram").collect()
    return np.sort(np.array([r[0] + (1 << 63) for r in often], np.uint64))


def pick(rows: Rows, which: np.ndarray) -> Rows:
    return {name: column[which] for name, column in rows.items()}


def joined(parts: list[Rows]) -> Rows:
    return {name: np.concatenate([p[name] for p in parts] or [np.zeros(0, kind)]).astype(kind) for name, kind in ROWS.items()}


def pack(rows: Rows, strings: list[bytes] = (), keys: np.ndarray = np.zeros(0, np.uint32)) -> bytes:
    """Rows, their strings and the strings' minimisers as one compressed block; numbers column by column, and byte by byte of a column."""
    order = np.lexsort((rows["at"], rows["text"], rows["doc"]))
    parts = [np.array([len(order), len(strings)], np.int64).tobytes(), np.array([len(s) for s in strings], np.int32).tobytes(), keys.astype(np.uint32).tobytes()]
    for name, kind in ROWS.items():
        column = rows[name][order].astype(kind)
        if kind is np.int64:
            column = np.diff(column, prepend=np.int64(0))
        parts.append(column.view(np.uint8).reshape(len(order), -1).T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join([*parts, *strings]))


def unpack(blocks: list[bytes]) -> tuple[Rows, list[bytes], np.ndarray]:
    """Rows, strings and 32 bits of their minimisers of all blocks; a row's string is its place in the list."""
    parts, strings, keys = [], [], [np.zeros(0, np.uint32)]
    for block in blocks:
        raw = zstandard.ZstdDecompressor().decompress(block)
        n, m = np.frombuffer(raw, np.int64, 2).tolist()
        sizes, at = np.frombuffer(raw, np.int32, m, 16), 16 + 8 * m
        keys.append(np.frombuffer(raw, np.uint32, m, 16 + 4 * m))
        rows = {}
        for name, kind in ROWS.items():
            width = np.dtype(kind).itemsize
            planes = np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n)
            column = np.ascontiguousarray(planes.T).view(kind).reshape(n)
            rows[name] = np.cumsum(column) if kind is np.int64 else column
            at += width * n
        rows["string"] = np.where(rows["string"] < 0, -1, rows["string"] + len(strings))
        ends = at + np.cumsum(sizes)
        strings += [raw[a:b] for a, b in zip([at, *ends.tolist()], ends.tolist())]
        parts.append(rows)
    return joined(parts), strings, np.concatenate(keys)


def combined(rows: Rows, strings: list[bytes]) -> tuple[Rows, list[bytes], np.ndarray, np.ndarray]:
    """Rows with the strings that differ; of a string, only its rows in the smallest document keep it.

    Returns rows, strings, the place of each of these in the list given, and each one's smallest document.
    """
    known: dict[bytes, int] = {}
    of = np.array([known.setdefault(s, len(known)) for s in strings], np.int64)
    first = np.zeros(len(known), np.int64)
    first[of[::-1]] = np.arange(len(of))[::-1]
    least = np.full(len(known), LAST_ID, np.int64)
    open_ = rows["string"] >= 0
    string = np.where(open_, of[rows["string"]] if len(of) else -1, -1)
    np.minimum.at(least, string[open_], rows["doc"][open_])
    gone = open_ & (rows["doc"] > least[string] if len(least) else False)
    return rows | {"string": np.where(gone, -1, string)}, list(known), first, least


class Frequent:
    """Strings with frequent minimisers that a task has met, each with its rows in the smallest document so far."""

    def __init__(self):
        self.rows, self.strings, self.keys, self.size = joined([]), [], np.zeros(0, np.uint64), 0

    def add(self, rows: Rows, strings: list[bytes], keys: np.ndarray) -> Rows:
        """Take rows and strings in; the rows that are to be removed come out."""
        rows = rows | {"string": rows["string"] + len(self.strings)}
        both, self.strings, first, _ = combined(joined([self.rows, rows]), [*self.strings, *strings])
        self.keys = np.concatenate([self.keys, keys])[first]
        gone = both["string"] < 0
        self.rows = pick(both, ~gone)
        self.size = sum(map(len, self.strings)) + 40 * len(self.rows["at"])
        return pick(both, gone)


def pieces(texts: DataFrame, buckets: int, shape: Shape, frequent: np.ndarray) -> DataFrame:
    """bucket, block: the super-k-mers of all texts, dealt by minimiser."""

    def dealt(rows: Rows, strings: list[bytes], keys: np.ndarray) -> pa.RecordBatch:
        """Strings go to their minimisers' buckets with their rows; rows to remove go along with any."""
        bucket = (mixed(keys) % np.uint64(buckets)).astype(np.int64)
        gone = rows["string"] < 0
        of_row = np.where(gone, rows["doc"] % buckets, bucket[rows["string"]] if len(bucket) else 0)
        order, by_string = np.argsort(of_row, kind="stable"), np.argsort(bucket, kind="stable")
        renamed = np.zeros(len(bucket), np.int64)
        out = []
        for b in np.unique(of_row).tolist():
            mine = order[slice(*np.searchsorted(of_row[order], [b, b + 1]))]
            its = by_string[slice(*np.searchsorted(bucket[by_string], [b, b + 1]))]
            renamed[its] = np.arange(len(its))
            part = pick(rows, mine)
            part["string"] = np.where(part["string"] < 0, -1, renamed[part["string"]] if len(renamed) else -1)
            out.append((b, pack(part, [strings[i] for i in its.tolist()], keys[its])))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary())], ["bucket", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Frequent()
        for doc, text, at, data in batches_of(batches, shape):
            c = cut(data, shape)
            first, n, key, often = super_kmers(c, shape, frequent)
            begin, end = c.starts[first].tolist(), c.ends[first + n + shape.window - 2].tolist()
            strings = [c.data[a:b] for a, b in zip(begin, end)]
            owner = c.owner[first]
            opening = np.searchsorted(c.owner, owner)  # the first word of the text
            rows = {"doc": doc[owner], "text": text[owner], "at": at[owner] + first - opening, "n": n, "string": np.arange(len(first))}
            there = np.flatnonzero(often)
            gone = held.add(pick(rows, there) | {"string": np.arange(len(there))}, [strings[i] for i in there.tolist()], key[there])
            rest = np.flatnonzero(~often)
            rows, strings, of, _ = combined(pick(rows, rest) | {"string": np.arange(len(rest))}, [strings[i] for i in rest.tolist()])
            yield dealt(joined([rows, gone]), strings, key[rest][of])
            if held.size > shape.held:
                yield dealt(held.rows, held.strings, held.keys)
                held = Frequent()
        yield dealt(held.rows, held.strings, held.keys)

    return texts.select("doc", "text", "data").mapInArrow(run, "bucket int, block binary")


def equal_windows(strings: list[bytes], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of the strings: its string, its place in it, and a number that just equal windows share."""
    number = defaultdict(count().__next__)
    words = [[number[w] for w in s.split(b" ")] for s in strings]
    sizes = np.array([len(w) for w in words], np.int64)
    name = np.array([w for s in words for w in s], np.int64)
    n, size = len(name), 1
    while size < shape.window:  # names of runs of `size` words, from each word on
        by = min(size, shape.window - size)
        pair = name[:-by] * (n + 1) + name[by:]
        name, size = np.unique(pair, return_inverse=True)[1], size + by
    windows = sizes - shape.window + 1
    string = np.repeat(np.arange(len(strings)), windows)
    base = np.repeat(np.cumsum(sizes) - sizes, windows)
    place = np.arange(len(string)) - np.repeat(np.cumsum(windows) - windows, windows)
    return string, place, name[base + place]


def shared(keys: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Strings whose minimiser strings of other documents have too."""
    _, key = np.unique(keys, return_inverse=True)
    low, high = np.full(len(keys), LAST_ID, np.int64), np.full(len(keys), -LAST_ID - 1, np.int64)
    np.minimum.at(low, key, least)
    np.maximum.at(high, key, least)
    return low[key] < high[key]


def doc_bucket(rows: Rows, buckets: int) -> np.ndarray:
    return (mixed(rows["doc"].astype(np.uint64) ^ mixed(rows["text"].astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)


def to_remove(pieces: DataFrame, buckets: int, shape: Shape) -> DataFrame:
    """bucket (of documents), block: windows that a smaller document has too."""

    def one(group: pa.Table) -> pa.Table:
        rows, strings, keys = unpack(group["block"].to_pylist())
        rows, strings, first, least = combined(rows, strings)
        gone, rows = pick(rows, rows["string"] < 0), pick(rows, rows["string"] >= 0)
        found = [gone]
        chosen = np.flatnonzero(shared(keys[first], least))
        if len(chosen):
            string, place, name = equal_windows([strings[i] for i in chosen.tolist()], shape)
            string = chosen[string]
            earliest = np.full(name.max() + 1, LAST_ID, np.int64)
            np.minimum.at(earliest, name, least[string])
            late = least[string] > earliest[name]
            string, place = string[late], place[late]
            # windows in a row of one string as one, for each of the string's rows
            new = np.ones(len(string), bool)
            new[1:] = (string[1:] != string[:-1]) | (place[1:] != place[:-1] + 1)
            at = np.flatnonzero(new)
            string, place, n = string[at], place[at], np.diff(np.append(at, len(string)))
            order = np.argsort(rows["string"], kind="stable")
            lo, hi = (np.searchsorted(rows["string"][order], string, side) for side in ("left", "right"))
            times = hi - lo
            which = order[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - lo, times)]
            part = pick(rows, which)
            found.append(part | {"at": part["at"] + np.repeat(place, times), "n": np.repeat(n, times), "string": np.full(len(which), -1)})
        gone = joined(found)
        bucket = doc_bucket(gone, buckets)
        out = [(b, pack(pick(gone, bucket == b))) for b in np.unique(bucket).tolist()]
        return pa.table([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary())], ["bucket", "block"])

    return pieces.groupBy("bucket").applyInArrow(one, "bucket int, block binary")


def packed_texts(texts: DataFrame, buckets: int) -> DataFrame:
    """bucket, doc, text, none, z: texts dealt by document and text, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            rows = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(("doc", "text"))}
            z = [squeeze(t.as_py() or b"") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_bucket(rows, buckets), pa.int32()), batch.column(0), batch.column(1), batch.column(3), pa.array(z, pa.binary())],
                ["bucket", "doc", "text", "none", "z"])

    return texts.mapInArrow(run, "bucket int, doc long, text long, none boolean, z binary")


def spans_of(at: np.ndarray, n: np.ndarray, shape: Shape) -> list[tuple[int, int]]:
    """First and last + 1 of the maximal runs of words that windows cover."""
    order = np.argsort(at, kind="stable")
    first, last = at[order], np.maximum.accumulate((at + n + shape.window - 1)[order])
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > last[:-1]
    cuts = np.flatnonzero(new)
    return list(zip(first[cuts].tolist(), last[np.append(cuts[1:], len(last)) - 1].tolist()))


def removals(docs: DataFrame, shape: Shape = Shape(), with_text: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_words, n_removed, kept_sha256, spans (first word, last + 1) of what goes.

    With with_text also kept, the words that are left, joined by single spaces.  A null text has no words, and texts of
    fewer words than a window lose nothing; a null doc_id comes after all others (with 2^63 - 1, should that occur); rows
    that share a doc_id take nothing from one another, and equal rows give equal results; other columns are not read; an
    empty table gives no rows.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(8, size // shape.bucket)
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text"),
        F.col("text").cast("binary").alias("data"), F.col("doc_id").isNull().alias("none"))
    gone = to_remove(pieces(texts, buckets, shape, frequent_grams(texts, shape)), buckets, shape)

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, _, _ = unpack(right["block"].to_pylist())
        rows = pick(rows, np.lexsort((rows["text"], rows["doc"])))
        new = np.ones(len(rows["at"]), bool)
        new[1:] = (rows["doc"][1:] != rows["doc"][:-1]) | (rows["text"][1:] != rows["text"][:-1])
        cuts = np.flatnonzero(new).tolist()
        mine = {(int(rows["doc"][a]), int(rows["text"][a])): spans_of(rows["at"][a:b], rows["n"][a:b], shape) for a, b in zip(cuts, [*cuts[1:], len(new)])}
        out = []
        for doc, text, none, z in zip(*(left[c].to_pylist() for c in ("doc", "text", "none", "z"))):
            words, at, kept = zstandard.ZstdDecompressor().decompress(z).split(), 0, []
            spans = mine.get((doc, text), [])
            for a, b in spans:
                kept += words[at:a]
                at = b
            kept += words[at:]
            data = b" ".join(kept)
            out.append((
                None if none else doc, len(words), len(words) - len(kept), hashlib.sha256(data).hexdigest(),
                [{"first": a, "end": b} for a, b in spans], *([data] if with_text else []),
            ))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])), pa.binary()]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept"][: 6 if with_text else 5]
        return pa.table([pa.array([r[i] for r in out], kinds[i]) for i in range(len(names))], names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first: long, end: long>>"
    both = packed_texts(texts, buckets).groupBy("bucket").cogroup(gone.groupBy("bucket"))
    return both.applyInArrow(one, schema + (", kept binary" if with_text else ""))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents")).drop("spans")


OP12_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, pos, array_to_string(w[pos + 1 : pos + 50], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS pos FROM d WHERE len(w) >= 50)),
f AS (SELECT g, min(doc_id) AS first FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, pos FROM s JOIN f USING (g) WHERE doc_id > first),
c AS (SELECT doc_id, list(DISTINCT pos + i) AS gone FROM r, unnest(range(1, 51)) AS u(i) GROUP BY doc_id),
k AS (SELECT doc_id, w, gone, list_select(w, list_filter(range(1, len(w) + 1), lambda i: gone IS NULL OR NOT list_contains(gone, i))) AS kept FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
