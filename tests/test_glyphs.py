"""Font files that are cut or damaged, and texts measured and broken by plain loops."""

from __future__ import annotations

import os
import random
import struct

import numpy as np
import pytest

from rasterloom.operators.glyphs import Face, atlas, broken, codes_of, drawn, extents, laid_out
from rasterloom.sources import fonts

BDF = b"""STARTFONT 2.1
FONTBOUNDINGBOX 4 6 0 -1
STARTCHAR A
ENCODING 65
DWIDTH 5 0
BBX 3 2 1 0
BITMAP
A0
4
ENDCHAR
STARTCHAR none
ENCODING -1
BITMAP
FF
ENDCHAR
STARTCHAR wide\r
ENCODING 66
BBX 10 2 0 -1
BITMAP
FFC0
ENDCHAR
ENDFONT
STARTCHAR after
ENCODING 67
ENDCHAR
"""


def test_bdf():
    rows = {r[0]: r[1:] for r in fonts.bdf(BDF)}
    assert set(rows) == {65, 66}
    assert rows[65] == (3, 2, 5, 1, 2, 5, -1, 6, bytes([255, 0, 255, 0, 0, 0]))
    assert rows[66][:5] == (10, 2, 4, 0, 1) and rows[66][8] == bytes([255] * 10 + [0] * 10)  # the second row is missing
    assert fonts.bdf(b"") is None and fonts.bdf(b"PLAIN") is None and fonts.bdf(b"STARTFONT 2.1") == []


def test_psf2():
    bits = bytes([0b10000001, 0b10000000, 0, 0, 255, 255, 1, 0])
    head = lambda **k: struct.pack("<8I", *({"magic": fonts.PSF2_MAGIC, "v": 0, "header": 32, "flags": 1, "count": 2, "size": 4, "h": 2, "w": 9} | k).values())
    rows = {r[0]: r for r in fonts.psf2(head() + bits + "é\xfeab".encode("latin-1")[:0] + "é".encode() + b"\xfeab\xff" + b"B\xff")}
    assert set(rows) == {0, 1, ord("é"), ord("B")}
    assert rows[0][-1] == bytes([255, 0, 0, 0, 0, 0, 0, 255, 255] + [0] * 9) == rows[ord("é")][-1]
    assert len(fonts.psf2(head(flags=0) + bits)) == 2
    for bad in (b"", head()[:31], head() + bits[:-1], head(magic=1) + bits, head(w=0) + bits, head(header=8) + bits, head(size=3) + bits, head(count=2**31) + bits):
        assert fonts.psf2(bad) is None
    rng = np.random.default_rng(0)
    for _ in range(300):
        broken_file = bytearray(head() + bits + b"a\xff")
        broken_file[int(rng.integers(0, len(broken_file)))] = int(rng.integers(0, 256))
        fonts.psf2(bytes(broken_file))


FACE = Face([32, 63, 97, 98, 99], [3, 9, 5, 6, 7], 10, [(97, 98, -2), (98, 32, 1), (99, 99, -1)])


def pen(text):
    """The step to each character and its advance, one by one."""
    advance, before, out = dict(zip(FACE.codes.tolist(), FACE.advances.tolist())), None, []
    kern = {(97, 98): -2, (98, 32): 1, (99, 99): -1}
    for c in map(ord, text):
        if c in (10, 13):
            out.append((0, 0))
            before = None
            continue
        out.append((kern.get((before, c), 0), advance.get(c, 9)))
        before = c
    return out


def measure(text):
    return max((sum(k + a for k, a in pen(line)) for line in text.split("\n")), default=0)


def lines_of(text, most, by_word):
    out, at = [], 0
    for paragraph in text.split("\n"):
        steps = pen(paragraph)
        starts, ends, x = [], [], 0
        for k, a in steps:
            starts.append(x + k)
            x += k + a
            ends.append(x)
        units, i = [], 0
        while i < len(paragraph):
            if paragraph[i] in " \t\r":
                i += 1
                continue
            j = i + 1
            while by_word and j < len(paragraph) and paragraph[j] not in " \t\r":
                j += 1
            units.append((i, j))
            i = j
        if not units:
            out.append((at, at, 0, 0))
        while units:
            n = 1
            while n < len(units) and ends[units[n][1] - 1] - starts[units[0][0]] <= most:
                n += 1
            a, b = units[0][0], units[n - 1][1]
            words = len([w for w in paragraph[a:b].replace("\t", " ").replace("\r", " ").split(" ") if w])
            out.append((at + a, at + b, words, ends[b - 1] - starts[a]))
            units = units[n:]
        at += len(paragraph) + 1
    return out


@pytest.mark.parametrize("by_word", [True, False])
def test_texts_are_broken_as_one_by_one(by_word):
    rng = random.Random(2)
    for _ in range(150):
        text = "".join(rng.choice("aabbcc ? \t\n\ré") for _ in range(rng.randint(0, 90)))
        for most in (0, 20, 57):
            assert broken(codes_of(text), FACE, most, by_word) == lines_of(text, most, by_word)


def test_extents_and_rows_without_text(spark):
    rows = [(1, "ab abc\nccc\rb"), (2, ""), (3, None), (4, "\n\n"), (5, "é𝕏")]
    got = {r.k: (r.text_width, r.text_height) for r in extents(spark.createDataFrame(rows, "k int, t string"), "k", "t", FACE).collect()}
    assert got == {k: (measure(t or ""), 10 * ((t or "").count("\n") + 1) if t else 0) for k, t in rows}


def test_alignment(spark):
    frame = spark.createDataFrame([(1, "a b c a b c\na"), (2, None), (3, "")], "k int, t string")
    by = {align: sorted(map(tuple, laid_out(frame, "k", "t", FACE, 31, align).collect())) for align in ("left", "right", "center", "justify")}
    shape = [(r[0], r[1], *r[2:6]) for r in by["left"]]
    assert [(s[0], s[1]) for s in shape] == [(1, 0), (1, 1), (1, 2), (3, 0)]
    for r in by["right"]:
        assert r[6] + r[5] == 31
    for r in by["center"]:
        assert r[6] == (31 - r[5]) // 2
    first, second = by["justify"][:2]
    assert first[5] + first[7] * (first[4] - 1) + first[8] == 31 and second[7:] == (0, 0)  # a paragraph's last line stays
    with pytest.raises(ValueError):
        laid_out(frame, "k", "t", FACE, 31, "middle")


def test_fonts_of_too_many_kinds_are_refused(spark):
    font = spark.createDataFrame([(65, 5, 10), (65, 6, 10)], "codepoint int, advance int, line_height int")
    with pytest.raises(ValueError):
        Face.of(font)
    assert extents(spark.createDataFrame([(1, "abc")], "k int, t string"), "k", "t", Face.of(font.limit(0))).collect() == [(1, 0, 0)]


def test_drawing_and_atlas(spark):
    files = spark.createDataFrame([(7, BDF), (8, None)], "font_id int, data binary")
    font = fonts.glyphs(files, "font_id", fonts.bdf)
    assert font.filter("font_id = 8").collect()[0].codepoint is None
    face = Face.of(font.filter("font_id = 7"))
    dots = drawn(spark.createDataFrame([(1, "AA\nA"), (2, "z"), (3, None)], "k int, t string"), "k", "t", font.filter("font_id = 7"), face).collect()
    assert sorted((r.k, r.x, r.y) for r in dots) == [(1, 1, 3), (1, 1, 9), (1, 3, 3), (1, 3, 9), (1, 6, 3), (1, 8, 3)]
    grid = {(r.x, r.y): r.v for r in atlas(font).collect()}
    assert grid[0, 0] == grid[2, 0] == 255 and grid[1, 0] == 0 and grid[11, 0] == 255 and (10, 0) not in grid


def test_many_texts_are_drawn_where_they_lie(spark):
    font = fonts.glyphs(spark.createDataFrame([(7, BDF)], "font_id int, data binary"), "font_id", fonts.bdf)
    rows = {r.codepoint: r for r in font.collect()}
    face, rng = Face.of(font, spark.createDataFrame([(65, 66, -3), (66, 66, -9)], "left int, right int, kern int")), random.Random(6)
    texts = [(k, "".join(rng.choice("AB\nz\r") for _ in range(rng.choice([0, 3, 40, 400])))) for k in range(150)] + [(150, "AB" * 5000), (151, None)]
    found = drawn(spark.createDataFrame(texts, "k int, t string").coalesce(1), "k", "t", font, face)
    want = {}
    for k, text in texts:
        pen = line = 0
        for before, c in zip(" " + (text or ""), text or ""):
            if c == "\n":
                pen, line = 0, line + 1
            elif g := rows.get(ord(c)):
                pen += {"AB": -3, "BB": -9}.get(before + c, 0)
                for i, v in enumerate(g.bitmap):
                    if v:
                        at = k, pen + g.bearing_x + i % g.width, line * g.line_height + g.ascent + i // g.width - g.bearing_y
                        want[at] = max(v, want.get(at, 0))
                pen += g.advance
    assert {(r.k, r.x, r.y): r.alpha for r in found.collect()} == want and found.count() == len(want)
    assert "Exchange" not in found._jdf.queryExecution().toString()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_one_font_reads_its_own_images(spark):
    every = {r.font_id: bytes(r.data) for r in fonts.bdf_files(spark, "/root/testdata/sf0.01").collect()}
    one = fonts.bdf_files(spark, "/root/testdata/sf0.01", 0)
    assert {r.font_id: bytes(r.data) for r in one.collect()} == {0: every[0]}
    assert f"LessThanOrEqual(vec_id,{fonts.BDF_GLYPHS - 1})" in one._jdf.queryExecution().toString()


def test_lines_take_no_search_of_an_array_each(monkeypatch):
    calls, own = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda *a, **b: calls.append(1) or own(*a, **b))
    assert len(broken(codes_of("ab ab\n" * 1000), Face([97, 98], [5, 5], 9), 12, True)) == 2001 and len(calls) < 10
