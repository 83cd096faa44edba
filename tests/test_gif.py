"""GIF files: codes, cut and damaged files, and rendering against a plain fold."""

from __future__ import annotations

import numpy as np
import pytest

from rasterloom.sources import gif


@pytest.mark.parametrize("least, n, kinds", [(2, 1, 1), (2, 500, 4), (4, 3000, 16), (8, 40000, 256), (8, 9000, 2), (8, 300000, 7)])
def test_codes_come_back(least, n, kinds):
    data = np.random.default_rng(n).integers(0, kinds, n).astype(np.uint8).tobytes()
    assert gif.unpacked(gif.packed(data, least), least, n) == data


def test_codes_that_end_early_or_can_not_be_right():
    data = bytes(range(200)) * 3
    codes = gif.packed(data, 8)
    half = gif.unpacked(codes[: len(codes) // 2], 8, len(data))
    known = len(half.rstrip(b"\0"))
    assert 0 < known < len(data) and half[:known] == data[:known] and len(half) == len(data)
    assert gif.unpacked(codes, 8, len(data) - 1) is None  # more samples than the frame has
    assert gif.unpacked(b"\xff\xff\xff", 8, 10) is None  # a code that no table holds
    assert gif.unpacked(codes, 9, len(data)) is None and gif.unpacked(codes, 1, len(data)) is None
    assert gif.unpacked(b"", 8, 3) == b"\0\0\0"


def picture(**change) -> gif.Gif:
    shot = gif.Frame(1, 2, 5, 9, 7, 1, 3, True, None, bytes(range(45)))
    return gif.Gif(20, 12, bytes(range(192)), 1, [shot._replace(**change), shot])


def test_files_come_back_and_cut_files_end_as_they_should():
    for change in ({}, {"interlaced": False}, {"transparent": None, "palette": bytes(384)}, {"disposal": 3, "delay": 65535}):
        whole = picture(**change)
        assert gif.parsed(gif.written(whole)) == whole
    data = gif.written(picture())
    results = [gif.parsed(data[:n]) for n in range(len(data))]
    for n, got in enumerate(results):  # never an error; frames only as far as they go
        assert got is None or len(got.frames) <= 2
    assert results[12] is None and gif.parsed(data[:-1]) == picture()
    more = b"\x21\xfe\x03abc\x00\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"  # a comment, and how often to loop
    odd = data[: 13 + 192] + more + data[13 + 192 :]
    assert gif.parsed(odd) == picture()
    assert gif.parsed(b"GIF88a" + data[6:]) is None and gif.parsed(data[:-1] + b"\x99") is None
    assert gif.parsed(data[:6] + b"\xff\xff" + data[8:]) is None  # too wide


def test_damaged_bytes_never_raise():
    data, rng = gif.written(picture()), np.random.default_rng(0)
    for _ in range(400):
        broken = bytearray(data)
        for at in rng.integers(0, len(data), 3):
            broken[at] = int(rng.integers(0, 256))
        gif.parsed(bytes(broken))


def test_files_that_can_not_be_read_are_null_rows(spark):
    files = spark.createDataFrame([(1, gif.written(picture())), (2, b"GIF89a"), (3, None), (4, gif.written(picture()._replace(frames=[])))], "k long, data binary")
    rows = gif.frames(files, "k").collect()
    assert sorted((r.k, r.frame_no) for r in rows if r.k == 1) == [(1, 0), (1, 1)]
    assert [(r.k, r.frame_no, r.rgba) for r in rows if r.k > 1] == [(2, None, None), (3, None, None), (4, None, None)]
    assert gif.rendered(gif.frames(files, "k"), "k").select("k").distinct().collect() == [(1,)]


def plain(shots, width, height, ground, cleared, mix):
    canvas = [[ground] * width for _ in range(height)]
    out = []
    for left, top, w, h, disposal, px in shots:
        before = [row[:] for row in canvas]
        for y in range(h):
            for x in range(w):
                at, to = px[y][x], (left + x, top + y)
                if not (0 <= to[0] < width and 0 <= to[1] < height):
                    continue
                under, a = canvas[to[1]][to[0]], at[3]
                if mix:
                    mixed = [(at[c] * a + under[c] * (255 - a) + 127) // 255 for c in range(3)]
                    canvas[to[1]][to[0]] = (*mixed, min(255, a + (under[3] * (255 - a) + 127) // 255))
                elif a:
                    canvas[to[1]][to[0]] = at
        out.append([row[:] for row in canvas])
        if disposal == 2:
            for y in range(max(0, top), min(height, top + h)):
                for x in range(max(0, left), min(width, left + w)):
                    canvas[y][x] = ground if cleared is None else cleared
        elif disposal == 3:
            canvas = before
    return out


@pytest.mark.parametrize("mix, cleared", [(False, 0), (True, None), (True, 0)])
def test_rendering_against_a_plain_fold(spark, mix, cleared):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for k in range(5):
        shots = []
        for j in range(6):
            w, h = (int(v) for v in rng.integers(1, 9, 2))
            px = [[(*map(int, rng.integers(0, 256, 3)), int(rng.choice([0, 100, 255]))) for _ in range(w)] for _ in range(h)]
            left, top, disposal = int(rng.integers(-4, 9)), int(rng.integers(-4, 7)), int(rng.integers(0, 5))
            shots.append((left, top, w, h, disposal, px))
            rows.append((k, j, 9, 7, 0x102030, left, top, w, h, disposal, bytes(v for line in px for p in line for v in p)))
        want[k] = plain(shots, 9, 7, (16, 32, 48, 255), None if cleared is None else (0, 0, 0, 0), mix)
    schema = "anim long, frame_no int, canvas_width int, canvas_height int, background int, left int, top int, width int, height int, disposal int, rgba binary"
    got = gif.rendered(spark.createDataFrame(rows, schema), "anim", cleared, mix).collect()
    assert len(got) == 5 * 6 * 7
    for r in got:
        assert list(map(tuple, np.frombuffer(r.rgba, np.uint8).reshape(-1, 4).tolist())) == want[r.anim][r.frame_no][r.y]
