"""Removal of byte strings that a document with a smaller id holds too, over column-wise sorted suffixes.

Which suffixes have to be compared.  The 50 bytes from each place on are a window, and each window is filed under
its anchor: of the 16-byte strings in it the one with the smallest hash, the leftmost of equals.  Equal windows
have equal anchors at equal distances, so each anchor's documents can be treated by themselves, and windows in a
row that share one anchor travel as one segment, as one row for about 17 bytes of text.  An anchor that one
document alone has is done with.  A segment that stands, letter for letter, in a document with a smaller id is
removed as a whole.  What is left are anchors with different surroundings: where repeated passages begin and end.

Column-wise construction.  The segments of an anchor are laid over one another at the anchor.  From the last
column to the first, each round inserts one symbol of each segment: the order of all suffixes of the segments is
updated by a stable sort on the new symbol alone, and the common prefixes of neighbours from the old ones (one
more than the smallest between them if the symbols agree, nothing otherwise).  Where neighbours share 50 bytes,
their windows are equal, and the interval's smallest document keeps its bytes.  The columns lie in one external
file, written once and read column by column; a round holds one column, the order and the common prefixes.  The
number of rounds is that of the columns, at most 84, however long the texts are.  (Inserting a symbol of each
whole document in each round would take as many rounds over all data as the longest document has bytes.)

Shuffles.  Rows go to buckets by anchor, or by document, as compressed columns; the number of buckets follows
from the bytes of the input, so a bucket stays small.  Copies are combined before the shuffle: of equal segments
in a batch of texts, only the smallest document's go on.  An anchor with very many different surroundings is cut
into its windows, which are dealt by the hash of all their 50 bytes.  Texts are shuffled compressed.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST_ID, keep, table

WINDOW, ANCHOR = 50, 16
REACH = WINDOW - ANCHOR + 1  # anchors in a window; also the most windows of a segment
COLUMNS = REACH - 1 + WINDOW
#: Bytes of text that are cut into segments together, bytes of text for each bucket, surroundings of one anchor.
BATCH, BUCKET, WIDE = 1 << 22, 1 << 22, 4096
KEY_BITS = 40

_P = 0x9E3779B97F4A7C15
_Q = 0xD6E8FEB86659FD93
_Q_BACK = pow(_Q, -1, 1 << 64)
_BYTES = np.frombuffer(hashlib.shake_256(b"bytes").digest(256 * 8), np.uint64) | np.uint64(1)
FIELDS = {"key": np.uint64, "seg": np.uint64, "doc": np.int64, "text": np.uint32, "at": np.int64, "n": np.uint8, "off": np.uint8, "state": np.uint8}
#: States of a segment: to be compared, to be removed, to be compared window by window.
OPEN, GONE, BY_WINDOW = 0, 1, 2


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of texts laid end to end (ends: of each window's text, exclusive, by place).

    Returns first places, numbers of windows, distances of the anchor, hashes of anchors and of whole segments.
    """
    n = len(data)
    if n < WINDOW:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    value = _BYTES[data]
    h, step, p = value, 1, _P
    while step < ANCHOR:
        h = h[:-step] * np.uint64(p) + h[step:]
        p, step = p * p % (1 << 64), step * 2
    h = mixed(h)
    low, off, size = h, np.zeros(len(h), np.uint8), 1
    while size < REACH:
        by = min(size, REACH - size)
        later = low[by:] < low[:-by]
        off = np.where(later, off[by:] + np.uint8(by), off[:-by])
        low = np.where(later, low[by:], low[:-by])
        size += by
    places = np.flatnonzero(np.arange(len(low)) + WINDOW <= ends[: len(low)])
    anchors = places + off[places]
    new = np.ones(len(places), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (places[1:] != places[:-1] + 1) | (ends[places[1:]] != ends[places[:-1]])
    at = np.flatnonzero(new)
    first, count, anchor = places[at], np.diff(np.append(at, len(places))), anchors[at]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value * powers(_Q, n), out=total[1:])
    whole = (total[first + count + WINDOW - 1] - total[first]) * powers(_Q_BACK, n)[first]
    whole = mixed(whole ^ ((anchor - first).astype(np.uint64) << np.uint64(56)) ^ (count.astype(np.uint64) << np.uint64(48)))
    return first, count, anchor - first, h[anchor], whole


def pack(rows: dict[str, np.ndarray]) -> bytes:
    """Rows as one compressed block: column by column, and byte by byte of a column."""
    n = len(rows["at"])
    parts = [np.int64(n).tobytes()]
    for name, kind in FIELDS.items():
        column = np.ascontiguousarray(rows[name].astype(kind))
        if name in ("doc", "at"):
            column = np.diff(column, prepend=np.int64(0))
        planes = column.view(np.uint8).reshape(n, -1).T
        parts.append(planes[:5].tobytes() if name == "key" else planes.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blocks: list[bytes]) -> dict[str, np.ndarray]:
    columns = {name: [] for name in FIELDS}
    for block in blocks:
        raw = zstandard.ZstdDecompressor().decompress(block)
        n, at = int(np.frombuffer(raw, np.int64, 1)[0]), 8
        for name, kind in FIELDS.items():
            width = 5 if name == "key" else np.dtype(kind).itemsize
            planes = np.zeros((np.dtype(kind).itemsize, n), np.uint8)
            planes[:width] = np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n)
            column = np.ascontiguousarray(planes.T).view(kind).reshape(n)
            columns[name].append(np.cumsum(column) if name in ("doc", "at") else column)
            at += width * n
    return {name: np.concatenate(c) if c else np.zeros(0, FIELDS[name]) for name, c in columns.items()}


def pick(rows: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {name: column[which] for name, column in rows.items()}


def dealt(rows: dict[str, np.ndarray], bucket: np.ndarray) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        yield int(bucket[order[a]]), pick(rows, order[a:b])


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where a run of rows with equal columns begins."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def spread(starts: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(values, np.diff(np.append(starts, n)))


def batch_rows(texts: list[tuple[int, int, bytes]]) -> dict[str, np.ndarray]:
    """Segments of some texts (doc, hash, bytes); of equal segments those beyond the smallest document are gone."""
    parts = []
    for group in batches_of(texts):
        data = np.frombuffer(b"".join(t[3] for t in group), np.uint8)
        lens = np.array([len(t[3]) for t in group], np.int64)
        begin = np.cumsum(lens) - lens
        which = np.repeat(np.arange(len(group)), lens)
        first, n, off, key, seg = segments(data, (begin + lens)[which])
        owner = which[first] if len(first) else np.zeros(0, np.int64)
        base = np.array([t[2] for t in group], np.int64) - begin
        parts.append({
            "key": key & np.uint64((1 << KEY_BITS) - 1), "seg": seg, "doc": np.array([t[0] for t in group], np.int64)[owner],
            "text": np.array([t[1] for t in group], np.uint32)[owner], "at": first + base[owner], "n": n, "off": off,
            "state": np.zeros(len(first), np.uint8), "hash": key,
        })
    rows = {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}
    rows = pick(rows, np.lexsort((rows["at"], rows["doc"], rows["seg"], rows["key"])))
    if n := len(rows["at"]):
        same = starts_of(rows["key"], rows["seg"])
        rows["state"] = np.where(rows["doc"] > spread(same, rows["doc"][same], n), GONE, OPEN).astype(np.uint8)
    return rows


def batches_of(texts: list[tuple[int, int, bytes]], size: int = BATCH) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Texts in parts of at most `size` windows: (doc, hash, place of the part, bytes); windows are never cut."""
    group, held = [], 0
    for doc, text, data in texts:
        for at in range(0, max(1, len(data) - WINDOW + 1), size):
            part = data[at : at + size + WINDOW - 1]
            if group and held + len(part) > size:
                yield group
                group, held = [], 0
            group.append((doc, text, at, part))
            held += len(part)
    yield group


def cut(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, rows: the segments of all texts, dealt by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(texts):
            rows = batch_rows(texts)
            bucket = (rows.pop("hash") >> np.uint64(KEY_BITS)) % np.uint64(buckets)
            order = np.lexsort((rows["at"], rows["doc"], bucket))
            found = [(b, pack(r)) for b, r in dealt(pick(rows, order), bucket[order].astype(np.int64))]
            return block(["bucket", "rows"], [pa.int32(), pa.binary()], found)

        texts, held = [], 0
        for batch in batches:
            for doc, text, data in zip(batch.column(0), batch.column(1), batch.column(2)):
                data = data.as_py()
                if data and len(data) >= WINDOW:
                    texts.append((doc.as_py(), text.as_py() & 0xFFFFFFFF, data))
                    held += len(data)
                if held >= BATCH:
                    yield out(texts)
                    texts, held = [], 0
        if texts:
            yield out(texts)

    return docs.mapInArrow(run, "bucket int, rows binary")


def block(names: list[str], types: list, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(doc.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def shared(pieces: DataFrame, buckets: int) -> DataFrame:
    """bucket (of documents), rows: of segments whose anchor two documents have, those to remove or compare."""

    def one(group: pa.Table) -> pa.Table:
        rows = unpack(group["rows"].to_pylist())
        passed = pick(rows, rows["state"] == GONE)
        rows = pick(rows, rows["state"] == OPEN)
        if n := len(rows["at"]):
            rows = pick(rows, np.lexsort((rows["at"], rows["doc"], rows["seg"], rows["key"])))
            keys = starts_of(rows["key"])
            same = starts_of(rows["key"], rows["seg"])
            kinds = np.add.reduceat(np.isin(np.arange(n), same, assume_unique=True).astype(np.int64), keys)
            several = np.minimum.reduceat(rows["doc"], keys) < np.maximum.reduceat(rows["doc"], keys)
            gone = rows["doc"] > spread(same, rows["doc"][same], n)
            compare = spread(keys, several & (kinds > 1), n)
            wide = spread(keys, kinds > WIDE, n)
            rows["state"] = np.where(gone, GONE, np.where(wide, BY_WINDOW, OPEN)).astype(np.uint8)
            rows = pick(rows, gone | compare)
        rows = {name: np.concatenate([rows[name], passed[name]]) for name in FIELDS}
        rows["seg"] = np.zeros(len(rows["at"]), np.uint64)
        bucket = doc_bucket(rows["doc"], buckets)
        order = np.lexsort((rows["at"], rows["doc"], bucket))
        found = [(b, pack(r)) for b, r in dealt(pick(rows, order), bucket[order])]
        return pa.Table.from_batches([block(["bucket", "rows"], [pa.int32(), pa.binary()], found)])

    return pieces.groupBy("bucket").applyInArrow(one, "bucket int, rows binary")


def packed_texts(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, doc, text_hash, z: texts dealt by document, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            z = [squeeze(t.as_py() or b"") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_bucket(doc, buckets), pa.int32()), batch.column(0), batch.column(1), pa.array(z, pa.binary())], ["bucket", "doc", "text_hash", "z"]
            )

    return docs.mapInArrow(run, "bucket int, doc long, text_hash long, z binary")


def by_text(rows: dict[str, np.ndarray]) -> dict[tuple[int, int], dict[str, np.ndarray]]:
    if not len(rows["at"]):
        return {}
    rows = pick(rows, np.lexsort((rows["at"], rows["text"], rows["doc"])))
    cuts = starts_of(rows["doc"], rows["text"])
    return {(int(rows["doc"][a]), int(rows["text"][a])): pick(rows, slice(a, b)) for a, b in zip(cuts, [*cuts[1:], len(rows["at"])])}


def surroundings(texts: DataFrame, found: DataFrame, buckets: int) -> DataFrame:
    """bucket (of anchors), rows, data: segments to compare, with their bytes."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = unpack(right["rows"].to_pylist())
        wanted = by_text(pick(rows, rows["state"] != GONE))
        out: list[tuple] = []
        for doc, text, z in zip(left["doc"].to_pylist(), left["text_hash"].to_pylist(), left["z"].to_pylist()):
            mine = wanted.pop((doc, text & 0xFFFFFFFF), None)  # of repeated rows, one stands for all
            if mine is None:
                continue
            data = zstandard.ZstdDecompressor().decompress(z)
            for key, at, n, off, state in zip(*(mine[c].tolist() for c in ("key", "at", "n", "off", "state"))):
                if state == BY_WINDOW:
                    for i in range(at, at + n):
                        window = data[i : i + WINDOW]
                        out.append((xxhash.xxh3_64_intdigest(window) >> 24, doc, text & 0xFFFFFFFF, i, 1, 0, window))
                else:
                    out.append((key, doc, text & 0xFFFFFFFF, at, n, off, data[at : at + n + WINDOW - 1]))
        if not out:
            return pa.Table.from_batches([block(["bucket", "rows", "data"], [pa.int32(), pa.binary(), pa.binary()], [])])
        rows = {name: np.array([r[i] for r in out], FIELDS[name]) for i, name in enumerate(("key", "doc", "text", "at", "n", "off"))}
        rows |= {"seg": np.zeros(len(out), np.uint64), "state": np.zeros(len(out), np.uint8), "row": np.arange(len(out))}
        bucket = (mixed(rows["key"]) % np.uint64(buckets)).astype(np.int64)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        blocks = [(b, pack(r), squeeze(b"".join(out[i][6] for i in r["row"]))) for b, r in dealt(rows, bucket)]
        return pa.Table.from_batches([block(["bucket", "rows", "data"], [pa.int32(), pa.binary(), pa.binary()], blocks)])

    pairs = texts.groupBy("bucket").cogroup(found.groupBy("bucket"))
    return pairs.applyInArrow(one, "bucket int, rows binary, data binary")


def equal_windows(key: np.ndarray, doc: np.ndarray, n: np.ndarray, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that a smaller document has under the same key, as (row, window) pairs.

    data: the bytes of all segments, end to end.  This is the column-wise construction.
    """
    m = len(key)
    start, size = REACH - 1 - off.astype(np.int64), n.astype(np.int64) + WINDOW - 1
    base = np.cumsum(size) - size - start
    _, group = np.unique(key, return_inverse=True)
    group = group.astype(np.int64)
    hits = []
    with tempfile.TemporaryFile() as columns:
        for j in range(COLUMNS):
            there = (j >= start) & (j < start + size)
            column = np.zeros(m, np.uint16)
            column[there] = data[base[there] + j].astype(np.uint16) + 1
            columns.write(column.tobytes())
        order = np.argsort(group, kind="stable")
        common = np.zeros(m + 1, np.int64)  # of a suffix and the one before it in the order
        for j in range(COLUMNS - 1, -1, -1):
            columns.seek(j * m * 2)
            symbol = np.frombuffer(columns.read(m * 2), np.uint16).astype(np.int64)
            sort_by = (group << 9 | symbol)[order]
            move = np.argsort(sort_by, kind="stable")
            sorted_by = sort_by[move]
            agree = np.zeros(m, bool)
            agree[1:] = (sorted_by[1:] == sorted_by[:-1]) & (sorted_by[1:] & 511 > 0)
            order = order[move]
            fresh = np.zeros(m + 1, np.int64)
            if agree.any():
                at = np.flatnonzero(agree)
                bounds = np.empty(2 * len(at), np.int64)
                bounds[::2], bounds[1::2] = move[at - 1] + 1, move[at] + 1
                fresh[at] = np.minimum.reduceat(common, bounds)[::2] + 1
            common = fresh
            # intervals of suffixes that share a window
            inside = common[:m] >= WINDOW
            if inside.any():
                cuts = np.flatnonzero(~inside)
                least = spread(cuts, np.minimum.reduceat(doc[order], cuts), m)
                late = order[doc[order] > least]
                hits.append((late, np.full(len(late), j) - start[late]))
    if not hits:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


def compared(pieces: DataFrame, buckets: int) -> DataFrame:
    """bucket (of documents), rows: windows to remove."""

    def one(group: pa.Table) -> pa.Table:
        rows = unpack(group["rows"].to_pylist())
        data = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(d) for d in group["data"].to_pylist()), np.uint8)
        row, window = equal_windows(rows["key"], rows["doc"], rows["n"], rows["off"], data)
        gone = pick(rows, row)
        gone["at"] = gone["at"] + window
        gone["n"], gone["state"] = np.ones(len(row), np.uint8), np.full(len(row), GONE, np.uint8)
        bucket = doc_bucket(gone["doc"], buckets)
        order = np.lexsort((gone["at"], gone["doc"], bucket))
        found = [(b, pack(r)) for b, r in dealt(pick(gone, order), bucket[order])]
        return pa.Table.from_batches([block(["bucket", "rows"], [pa.int32(), pa.binary()], found)])

    return pieces.groupBy("bucket").applyInArrow(one, "bucket int, rows binary")


def removed_runs(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of the maximal runs of bytes that windows cover."""
    order = np.argsort(at, kind="stable")
    first, last = at[order], np.maximum.accumulate((at + n + WINDOW - 1)[order])
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > last[:-1]
    cuts = np.flatnonzero(new)
    return first[cuts], last[np.append(cuts[1:], len(last)) - 1]


def removals(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (first byte, last + 1) of what goes.

    With with_text also kept, the bytes that are left.  Null texts count as empty, texts under 50 bytes lose
    nothing; a null doc_id comes after all others; rows that share a doc_id take nothing from one another, and
    equal rows give equal results; other columns are not read; an empty table gives no rows.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(8, size // BUCKET)
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"),
        F.col("text").cast("binary").alias("data"),
    )
    texts = packed_texts(rows, buckets)
    found = keep(shared(cut(rows, buckets), buckets))
    windows = compared(surroundings(texts, found, buckets), buckets)
    gone = found.unionByName(windows)

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        all_rows = unpack(right["rows"].to_pylist())
        mine = by_text(pick(all_rows, all_rows["state"] == GONE))
        out = []
        for doc, text, z in zip(left["doc"].to_pylist(), left["text_hash"].to_pylist(), left["z"].to_pylist()):
            data = zstandard.ZstdDecompressor().decompress(z)
            r = mine.get((doc, text & 0xFFFFFFFF))
            runs = list(zip(*(x.tolist() for x in removed_runs(r["at"], r["n"].astype(np.int64))))) if r else []
            at, kept = 0, []
            for a, b in runs:
                kept.append(data[at:a])
                at = b
            kept = b"".join([*kept, data[at:]])
            out.append((
                None if doc == LAST_ID else doc, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(),
                [{"first": a, "end": b} for a, b in runs], *([kept] if with_text else []),
            ))
        spans = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), spans, *([pa.binary()] if with_text else [])]
        return pa.Table.from_batches([block(["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: len(types)], types, out)])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first: long, end: long>>"
    return texts.groupBy("bucket").cogroup(gone.groupBy("bucket")).applyInArrow(one, schema + (", kept binary" if with_text else ""))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents")).drop("spans")


OP1_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS s FROM d WHERE len(h) >= 100)),
f AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, s FROM w JOIN f USING (g) WHERE doc_id > first),
p AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM r),
i AS (SELECT doc_id, s, sum(CASE WHEN before IS NULL OR s > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM p),
m AS (SELECT doc_id, k, min(s) AS a, max(s) + 50 AS b FROM i GROUP BY doc_id, k),
n AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 0) AS fr FROM m),
t AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * fr + 1, 2 * (a - fr)), '' ORDER BY k) AS kept, max(b) AS last FROM n JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
