"""GIF files as rows of frames, read and written inside Arrow tasks, and animations rendered frame by frame.

A file is a row with its bytes, a frame a row with its place, its colour numbers (one byte a sample) and the same as
r, g, b, a bytes.  Files are decoded one by one, so nothing is shuffled.  Rendering deals the rows of a canvas out: each
frame sends its samples of one canvas row to that row, where all frames meet in order.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import images

FRAME = (
    "frame_no int, canvas_width int, canvas_height int, background int, left int, top int, width int, height int, "
    "delay int, disposal int, transparent int, interlaced boolean, numbers binary, rgba binary"
)
#: The largest side that is read; first row and step of the four passes of interlaced frames.
MOST_SIDE = 1024
PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))


class Frame(NamedTuple):
    left: int
    top: int
    width: int
    height: int
    delay: int
    disposal: int
    transparent: int | None
    interlaced: bool
    palette: bytes | None  # of its own, r, g, b for each colour
    numbers: bytes


class Gif(NamedTuple):
    width: int
    height: int
    palette: bytes | None
    background: int  # a colour number
    frames: list[Frame]


def interlaced_rows(height: int) -> np.ndarray:
    """The rows of an interlaced frame in the order in which they are stored."""
    return np.concatenate([np.arange(first, height, step) for first, step in PASSES])


def blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """The sub-blocks from a place on, joined, and the place after them; a cut file ends where it ends."""
    parts = []
    while at < len(data) and (size := data[at]):
        parts.append(data[at + 1 : at + 1 + size])
        at += 1 + size
    return b"".join(parts), at + 1


def unpacked(data: bytes, least: int, n: int) -> bytes | None:
    """n colour numbers from variable-width codes; zeros where codes end early, None for codes that can't be right."""
    if not 2 <= least <= 8:
        return None
    clear = 1 << least
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    known, width, before = list(roots), least + 1, None
    held = bits = size = 0
    out = []
    for byte in data:
        held |= byte << bits
        bits += 8
        while bits >= width:
            code, held, bits = held & ((1 << width) - 1), held >> width, bits - width
            if code == clear:
                known, width, before = list(roots), least + 1, None
                continue
            if code == clear + 1:
                return b"".join(out).ljust(n, b"\0")
            if code > len(known) or (code == len(known) and before is None):
                return None
            run = known[code] if code < len(known) else before + before[:1]
            if before is not None and len(known) < 4096:
                known.append(before + run[:1])
                if len(known) == 1 << width and width < 12:
                    width += 1
            out.append(run)
            size += len(run)
            if size > n:
                return None
            before = run
    return b"".join(out).ljust(n, b"\0")


def packed(numbers: bytes, least: int) -> bytes:
    """Colour numbers as variable-width codes; the table is cleared whenever it is full."""
    clear = 1 << least
    held = bits = 0
    out = bytearray()

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held |= code << bits
        bits += width
        while bits >= 8:
            out.append(held & 255)
            held >>= 8
            bits -= 8

    at, width = 0, least + 1
    while True:
        put(clear, width)
        known, width, reader = {bytes([i]): i for i in range(clear)}, least + 1, clear + 2  # reader: the size of its table
        after = clear + 2
        first = True
        while at < len(numbers) and after < 4096:
            end = at + 1
            while end < len(numbers) and numbers[at : end + 1] in known:
                end += 1
            put(known[numbers[at:end]], width)
            known[numbers[at : end + 1]] = after
            after += 1
            if not first and reader < 4096:
                reader += 1
                if reader == 1 << width and width < 12:
                    width += 1
            first, at = False, end
        if at >= len(numbers):
            break
    put(clear + 1, width)
    put(0, 7)
    return bytes(out)


def parsed(data: bytes) -> Gif | None:
    """A file's palette and frames; None if it can't be read."""
    try:
        return _parsed(data)
    except (IndexError, struct.error):  # cut within a header
        return None


def _parsed(data: bytes) -> Gif | None:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        return None
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    if not (0 < width <= MOST_SIDE and 0 < height <= MOST_SIDE):
        return None
    at = 13

    def colours(flags: int) -> bytes | None:
        nonlocal at
        if not flags & 0x80:
            return None
        size = 3 << (flags & 7) + 1
        if at + size > len(data):
            raise IndexError
        at += size
        return data[at - size : at]

    palette, frames, control = colours(flags), [], (0, 0, None)
    while at < len(data) and data[at] != 0x3B:
        kind, at = data[at], at + 1
        if kind == 0x21:
            if data[at] == 0xF9:
                size, bits, delay, number, end = struct.unpack_from("<BBHBB", data, at + 1)
                if size != 4 or end:
                    return None
                control, at = (delay, bits >> 2 & 7, number if bits & 1 else None), at + 7
            else:
                _, at = blocks(data, at + 1)
                if at > len(data):
                    return None
        elif kind == 0x2C:
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at)
            at += 9
            own = colours(flags)
            codes, end = blocks(data, at + 1)
            numbers = unpacked(codes, data[at], w * h) if 0 < w <= MOST_SIDE and 0 < h <= MOST_SIDE else None
            if numbers is None:
                return None
            if flags & 0x40:
                rows = np.frombuffer(numbers, np.uint8).reshape(h, w)
                straight = np.zeros_like(rows)
                straight[interlaced_rows(h)] = rows
                numbers = straight.tobytes()
            frames.append(Frame(left, top, w, h, *control, bool(flags & 0x40), own, numbers))
            at, control = end, (0, 0, None)
        else:
            return None
    return Gif(width, height, palette, background, frames)


def written(gif: Gif) -> bytes:
    """The bytes of a file; palettes hold 2, 4, ... or 256 colours."""
    bits = lambda palette: (len(palette) // 3).bit_length() - 2
    flags = 0x80 | bits(gif.palette) if gif.palette else 0
    out = [b"GIF89a", struct.pack("<HHBBB", gif.width, gif.height, flags, gif.background, 0), gif.palette or b""]
    for f in gif.frames:
        clear = f.transparent is not None
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, f.disposal << 2 | clear, f.delay, f.transparent or 0, 0))
        flags = (0x80 | bits(f.palette) if f.palette else 0) | (0x40 if f.interlaced else 0)
        out += [b"\x2c", struct.pack("<HHHHB", f.left, f.top, f.width, f.height, flags), f.palette or b""]
        numbers = f.numbers
        if f.interlaced:
            numbers = np.frombuffer(numbers, np.uint8).reshape(f.height, f.width)[interlaced_rows(f.height)].tobytes()
        least = max(2, bits(f.palette or gif.palette or bytes(768)) + 1)
        codes = packed(numbers, least)
        out.append(bytes([least]))
        out += [bytes([len(codes[i : i + 255])]) + codes[i : i + 255] for i in range(0, len(codes), 255)]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def coloured(numbers: bytes, palette: bytes | None, transparent: int | None) -> bytes:
    """r, g, b, a of colour numbers: black for those that the palette lacks, nothing for the transparent one."""
    table = np.zeros((256, 4), np.uint8)
    table[:, 3] = 255
    if palette:
        table[: len(palette) // 3, :3] = np.frombuffer(palette, np.uint8).reshape(-1, 3)
    if transparent is not None:
        table[transparent] = 0
    return table[np.frombuffer(numbers, np.uint8)].tobytes()


def frames(files: DataFrame, key: str, data: str = "data") -> DataFrame:
    """key and FRAME: a row for each frame of each file; one with nulls for a file that can't be read or has no frame."""
    kind = dict(files.dtypes)[key]
    names = [key, *(c.split()[0] for c in FRAME.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                gif = parsed(batch.column(1)[k].as_py() or b"")
                rows = []
                for i, f in enumerate(gif.frames if gif else []):
                    base = gif.palette[gif.background * 3 : gif.background * 3 + 3] if gif.palette else b""
                    ground = int.from_bytes(base, "big") if len(base) == 3 else None
                    rows.append((i, gif.width, gif.height, ground, *f[:8], f.numbers, coloured(f.numbers, f.palette or gif.palette, f.transparent)))
                rows = rows or [(None,) * (len(names) - 1)]
                kinds = [pa.int32()] * 11 + [pa.bool_(), pa.binary(), pa.binary()]
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * len(rows))), *columns], names)

    return files.select(key, data).mapInArrow(run, f"`{key}` {kind}, {FRAME}")


def rendered(shots: DataFrame, key: str, cleared: int | None = 0, mix: bool = False, blank_first: bool = False) -> DataFrame:
    """key, frame_no, y, rgba: the rows of the canvas as it shows after each frame, from rows of `key` and FRAME.

    Before the first frame the canvas is `background` (r, g, b in one number, without transparency; null: nothing).  A frame
    replaces what its opaque samples cover, or lies over it by its alpha in whole numbers (mix).  When the next one comes,
    disposal 2 clears the frame's rectangle to `cleared` (0: nothing; None: the background), disposal 3 brings back
    the canvas from before the frame.  blank_first shows the first frame without its own samples, as some
    decoders do.
    """
    row = F.explode(F.sequence(F.lit(0), F.col("canvas_height") - 1))
    inside = (F.col("y") >= F.col("top")) & (F.col("y") < F.col("top") + F.col("height"))
    own = F.expr("substring(rgba, (y - top) * width * 4 + 1, width * 4)")
    kind = dict(shots.dtypes)[key]
    strips = shots.filter("frame_no IS NOT NULL").select(key, "frame_no", "canvas_width", "background", "left", "disposal", "top", "width", "height", "rgba", row.alias("y"))
    strips = strips.select(key, "y", "frame_no", "canvas_width", "background", "left", "disposal", F.when(inside, own).otherwise(F.lit(b"")).alias("strip"))

    def fold(group: pa.Table) -> pa.Table:
        group = group.sort_by("frame_no")
        width, ground = group["canvas_width"][0].as_py(), group["background"][0].as_py()
        base = np.zeros((width, 4), np.int64)
        if ground is not None:
            base[:] = [ground >> 16, ground >> 8 & 255, ground & 255, 255]
        empty = base[:1] if cleared is None else np.array([[cleared >> 24, cleared >> 16 & 255, cleared >> 8 & 255, cleared & 255]])
        canvas, out = base.copy(), []
        for k, (left, disposal, strip) in enumerate(zip(*(group[c].to_pylist() for c in ("left", "disposal", "strip")))):
            samples = np.frombuffer(strip, np.uint8).reshape(-1, 4).astype(np.int64)
            a, b = min(max(left, 0), width), min(max(left + len(samples), 0), width)
            samples = samples[a - left : b - left]
            before = canvas.copy()
            canvas[a:b] = over(canvas[a:b], samples) if mix else np.where(samples[:, 3:] > 0, samples, canvas[a:b])
            out.append((before if blank_first and k == 0 else canvas).astype(np.uint8).tobytes())
            if disposal == 2:
                canvas[a:b] = empty
            elif disposal == 3:
                canvas = before
        return pa.table([group[key], group["frame_no"], group["y"], pa.array(out, pa.binary())], [key, "frame_no", "y", "rgba"])

    return strips.groupBy(key, "y").applyInArrow(fold, f"`{key}` {kind}, frame_no int, y int, rgba binary")


def over(below: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Samples r, g, b, a over others, in whole numbers."""
    share = above[:, 3:]
    out = (above * share + below * (255 - share) + 127) // 255
    out[:, 3] = np.minimum(255, above[:, 3] + (below[:, 3] * (255 - above[:, 3]) + 127) // 255)
    return out


def samples(rows: DataFrame, *keep: str, data: str, channels: str) -> DataFrame:
    """The columns `keep`, i (place) and a number for each of `channels`, for each sample of a binary column."""
    n = len(channels)
    digits = F.expr(f"transform(sequence(0, cast(length({data}) / {n} as int) - 1), i -> substring({data}, i * {n} + 1, {n}))")
    spread = rows.filter(F.length(data) > 0).select(*keep, F.posexplode(digits).alias("i", "s"))
    part = lambda k: F.conv(F.hex(F.substring("s", k + 1, 1)), 16, 10).cast("int")
    return spread.select(*keep, "i", *[part(k).alias(c) for k, c in enumerate(channels)])


#: The files of the queries: canvases of 12 x 10 with the images of four rows of the table, one on the other.
WIDTH, HEIGHT, SIDE, GROUP = 12, 10, 8, 4
PALETTE = bytes(c for i in range(256) for c in (i, 255 - i, i * 7 % 256))
OWN = bytes(c for i in range(256) for c in (i * 3 % 256, i, i ^ 85))


def made(s, d) -> DataFrame:
    """gif_id, data: the files, with every disposal, interlaced frames, palettes of their own and transparent numbers."""
    four = images(s, d).groupBy(F.floor(F.col("image_id") / GROUP).alias("gif_id")).agg(F.sort_array(F.collect_list(F.struct("image_id", "v"))).alias("l"))
    small = four.select("gif_id", F.transform("l", lambda x: x["image_id"]).alias("ids"), F.flatten(F.transform("l", lambda x: x["v"])).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                shots = []
                for j, i in enumerate(ids):
                    numbers = bytes(v[j * SIDE * SIDE : (j + 1) * SIDE * SIDE])
                    shots.append(Frame(i % 7, i % 5, SIDE, SIDE, 10 * j, i // 3 % 4, numbers[0] if i % 2 else None, i % 3 == 0, OWN if i % 4 == 2 else None, numbers))
                out.append(written(Gif(WIDTH, HEIGHT, PALETTE, ids[0] % 256, shots)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["gif_id", "data"])

    return small.mapInArrow(run, "gif_id long, data binary")


def shown(s, d, **how) -> DataFrame:
    canvas = samples(rendered(frames(made(s, d), "gif_id"), "gif_id", **how), "gif_id", "frame_no", "y", data="rgba", channels="rgba")
    return canvas.withColumnRenamed("i", "x")


_MADE = f"""WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda q: CAST(greatest(0, least(255, floor(CAST(q AS DOUBLE) * 255 + 128))) AS INTEGER)) AS v FROM embeddings),
fr AS (SELECT id // {GROUP} AS gif_id, CAST(row_number() OVER (PARTITION BY id // {GROUP} ORDER BY id) - 1 AS INTEGER) AS frame_no, id, v, CAST(id % 7 AS INTEGER) AS l, CAST(id % 5 AS INTEGER) AS t,
  CAST(id // 3 % 4 AS INTEGER) AS disposal, CASE WHEN id % 2 = 1 THEN v[1] END AS transparent, min(id) OVER (PARTITION BY id // {GROUP}) AS base FROM e),
sm AS (SELECT fr.*, i, v[i + 1] AS k FROM fr, unnest(range({SIDE * SIDE})) AS u(i)),
co AS (SELECT *, CASE WHEN id % 4 = 2 THEN k * 3 % 256 ELSE k END AS r, CASE WHEN id % 4 = 2 THEN k ELSE 255 - k END AS g, CASE WHEN id % 4 = 2 THEN xor(k, 85) ELSE k * 7 % 256 END AS b FROM sm)"""
_CANVAS = _MADE + f""", ca AS (SELECT gif_id, frame_no, l, t, disposal, base % 256 AS ground, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM fr, unnest(range({WIDTH})) AS a(x), unnest(range({HEIGHT})) AS b(y)),
dr AS (SELECT ca.*, CASE WHEN i IS NOT NULL AND k IS DISTINCT FROM transparent THEN [r, g, b, 255] END AS own,
  CASE WHEN ca.disposal = 3 THEN NULL WHEN ca.disposal = 2 AND i IS NOT NULL THEN [0, 0, 0, 0] WHEN i IS NOT NULL AND k IS DISTINCT FROM transparent THEN [r, g, b, 255] END AS stays
  FROM ca LEFT JOIN co ON co.gif_id = ca.gif_id AND co.frame_no = ca.frame_no AND ca.x - ca.l = i % {SIDE} AND ca.y - ca.t = i // {SIDE} AND ca.x >= ca.l AND ca.x < ca.l + {SIDE}),
st AS (SELECT *, coalesce(last_value(stays IGNORE NULLS) OVER (PARTITION BY gif_id, x, y ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), [ground, 255 - ground, ground * 7 % 256, 255]) AS under FROM dr),
sh AS (SELECT gif_id, frame_no, x, y, {{c}} AS c FROM st) SELECT gif_id, frame_no, y, x, CAST(c[1] AS INTEGER) AS r, CAST(c[2] AS INTEGER) AS g, CAST(c[3] AS INTEGER) AS b, CAST(c[4] AS INTEGER) AS a FROM sh"""

OPS = {
    "gif_frames": (
        lambda s, d: samples(frames(made(s, d), "gif_id"), "gif_id", "frame_no", "left", "top", "delay", "disposal", "transparent", "interlaced", data="numbers", channels="k"),
        _MADE + ' SELECT gif_id, frame_no, l AS "left", t AS top, 10 * frame_no AS delay, disposal, transparent, id % 3 = 0 AS interlaced, CAST(i AS INTEGER) AS i, k FROM sm'),
    "gif_colours": (
        lambda s, d: samples(frames(made(s, d), "gif_id"), "gif_id", "frame_no", data="rgba", channels="rgba"),
        _MADE + ", o AS (SELECT *, k IS DISTINCT FROM transparent AS seen FROM co) SELECT gif_id, frame_no, CAST(i AS INTEGER) AS i, CASE WHEN seen THEN r ELSE 0 END AS r, CASE WHEN seen THEN g ELSE 0 END AS g, CASE WHEN seen THEN b ELSE 0 END AS b, CASE WHEN seen THEN 255 ELSE 0 END AS a FROM o"),
    "gif_canvases": (shown, _CANVAS.format(c="coalesce(own, under)")),
    "gif_canvases_blank_first": (lambda s, d: shown(s, d, blank_first=True), _CANVAS.format(c="CASE WHEN frame_no = 0 THEN under ELSE coalesce(own, under) END")),
}
