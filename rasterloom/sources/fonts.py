"""Bitmap fonts: PSF2 and BDF files as rows of glyphs, read inside Arrow tasks, file by file."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import images

GLYPH = "codepoint int, width int, height int, advance int, bearing_x int, bearing_y int, ascent int, descent int, line_height int, bitmap binary"
#: The marks of PSF2 files.
PSF2_MAGIC, PSF2_UNICODE = 0x864AB572, 1


def alphas(rows: np.ndarray, width: int) -> bytes:
    """Rows of bits, the highest first and padded to bytes, as an alpha of 0 or 255 for each sample."""
    bits = np.unpackbits(rows, axis=1)[:, :width]
    return (np.pad(bits, ((0, 0), (0, width - bits.shape[1]))) * 255).astype(np.uint8).tobytes()


def psf2(data: bytes) -> list[tuple] | None:
    """Glyphs of a PSF2 file: a code point is the glyph's number, and those of its table of sequences, too."""
    if len(data) < 32:
        return None
    magic, _, header, flags, count, size, height, width = struct.unpack_from("<8I", data)
    if magic != PSF2_MAGIC or not (width and height and count and size) or header < 32 or header + count * size > len(data) or size < -(-width // 8) * height:
        return None
    bits = np.frombuffer(data, np.uint8, count * size, header).reshape(count, size)[:, : -(-width // 8) * height]
    maps = [alphas(b.reshape(height, -1), width) for b in bits]
    found = dict(enumerate(maps))
    if flags & PSF2_UNICODE:
        for k, entry in enumerate(data[header + count * size :].split(b"\xff")[:count]):
            for c in entry.split(b"\xfe")[0].decode("utf-8", "ignore"):  # sequences of several code points follow 0xFE
                if ord(c) not in (0, k):
                    found[ord(c)] = maps[k]
    return [(c, width, height, width, 0, height, height, 0, height, m) for c, m in found.items()]


def number(text: str) -> int:
    try:
        return int(text)
    except ValueError:
        return 0


def bdf(data: bytes) -> list[tuple] | None:
    """Glyphs of a BDF file; characters without a code point go, and missing rows of a bitmap are empty."""
    lines = data.decode("latin-1").splitlines()
    if not lines or not lines[0].startswith("STARTFONT"):
        return None
    box, ascent, descent, height, found, glyph, rows = [0, 0, 0, 0], 0, 0, 0, {}, None, None
    for line in lines:
        word, _, rest = line.strip("\r").partition(" ")
        args = [number(p) for p in rest.split()]
        if word == "FONTBOUNDINGBOX" and len(args) >= 4:
            box, ascent, descent, height = args[:4], args[1] + args[3], args[3], args[1]
        elif word == "FONT_ASCENT":
            ascent = number(rest)
        elif word == "FONT_DESCENT":
            descent = -number(rest)
        elif word == "STARTCHAR":
            glyph, rows = {"code": -1, "advance": box[0], "box": box}, None
        elif glyph is None:
            if word == "ENDFONT":
                break
        elif word == "ENCODING":
            glyph["code"] = number(rest.strip())
        elif word == "DWIDTH" and args:
            glyph["advance"] = args[0]
        elif word == "BBX" and len(args) >= 4:
            glyph["box"] = args[:4]
        elif word == "BITMAP":
            rows = []
        elif word == "ENDCHAR":
            w, h, x, y = glyph["box"]
            if glyph["code"] >= 0 and w >= 0 and h >= 0:
                bits = np.zeros((h, -(-w // 8)), np.uint8)
                for k, hexed in enumerate((rows or [])[:h]):
                    part = bytes.fromhex(hexed[: len(hexed) // 2 * 2])[: bits.shape[1]] if all(c in "0123456789abcdefABCDEF" for c in hexed) else b""
                    bits[k, : len(part)] = list(part)
                found[glyph["code"]] = (w, h, glyph["advance"], x, y + h, alphas(bits, w))
            glyph = None
        elif rows is not None:
            rows.append(line.strip())
    return [(c, *g[:5], ascent, descent, height, g[5]) for c, g in found.items()]


def glyphs(files: DataFrame, key: str, read: Callable[[bytes], list[tuple] | None], data: str = "data") -> DataFrame:
    """key and GLYPH: a row for each glyph of each file; one with nulls for a file that can't be read or has none."""
    kind = dict(files.dtypes)[key]
    names = [key, *(c.split()[0] for c in GLYPH.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = read(batch.column(1)[k].as_py() or b"") or [(None,) * (len(names) - 1)]
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), [pa.int32()] * 9 + [pa.binary()])]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * len(rows))), *columns], names)

    return files.select(key, data).mapInArrow(run, f"`{key}` {kind}, {GLYPH}")


#: The fonts of the queries: as many images of the table as glyphs; BDF glyphs begin at the space.
PSF2_GLYPHS, BDF_GLYPHS, SPACE = 128, 224, 32


def _files(s, d, n: int, write: Callable[[list[int], np.ndarray], bytes], font: int | None = None) -> DataFrame:
    """Samples travel as one bit each; with `font`, the images of that font alone are read."""
    some = images(s, d)
    if font is not None:
        some = some.filter(F.col("image_id").between(font * n, font * n + n - 1))
    bits = F.aggregate("v", F.lit(0).cast("long"), lambda a, v: F.shiftleft(a, 1).bitwiseOR((v >= 128).cast("long")))
    of = some.groupBy(F.floor(F.col("image_id") / n).alias("font_id")).agg(F.sort_array(F.collect_list(F.struct("image_id", bits.alias("bits")))).alias("l"))
    flat = of.select("font_id", F.transform("l", lambda x: x["image_id"]).alias("ids"), F.transform("l", lambda x: x["bits"]).alias("bits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [write(ids.as_py(), np.array(b.as_py(), ">i8").view(np.uint8).reshape(-1, 8)) for ids, b in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["font_id", "data"])

    return flat.mapInArrow(run, "font_id long, data binary")


def psf2_files(s, d) -> DataFrame:
    """font_id, data: the images in black and white as glyphs; the first 26 are Cyrillic letters, too."""

    def write(ids: list[int], bits: np.ndarray) -> bytes:
        table = b"".join((chr(0x430 + k).encode() + b"\xfeab" if k < 26 else b"") + b"\xff" for k in range(len(ids)))
        return struct.pack("<8I", PSF2_MAGIC, 0, 32, PSF2_UNICODE, len(ids), 8, 8, 8) + bits.tobytes() + table

    return _files(s, d, PSF2_GLYPHS, write)


def bdf_files(s, d, font: int | None = None) -> DataFrame:
    """font_id, data: the left parts of the images as glyphs of different widths, from the space on; all fonts, or one."""

    def write(ids: list[int], bits: np.ndarray) -> bytes:
        out = ["STARTFONT 2.1", "FONT made", "FONTBOUNDINGBOX 8 10 0 -2", f"CHARS {len(ids)}"]
        for k, (i, rows) in enumerate(zip(ids, bits)):
            w = 3 + i % 6
            out += [f"STARTCHAR c{k}", f"ENCODING {SPACE + k}", f"DWIDTH {w + 1 + i % 2} 0", f"BBX {w} 8 {i % 2} {-(i % 3)}", "BITMAP", *(f"{b:02X}" for b in rows), "ENDCHAR"]
        return "\n".join([*out, "ENDFONT", ""]).encode()

    return _files(s, d, BDF_GLYPHS, write, font)
