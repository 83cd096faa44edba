"""Layer trees against a recursive model in plain Python."""

from __future__ import annotations

import random
from math import cos, floor, radians, sin

from rasterloom.operators import compositor as c

SCHEMA = (
    "doc long, id int, parent int, z int, kind string, mode string, opacity double, visible boolean, left int, top int, width int, height int, "
    "px array<struct<r: int, g: int, b: int, a: int>>, mask array<int>, brightness double, contrast double, saturation double, hue double, gamma double, exposure double"
)


def byte(v):
    return floor(round(min(1, max(0, v)) * 255 + 0.5, 6))


def over(mode, p, q, opacity):
    at, ab = q[3] / 255 * opacity, p[3] / 255
    if at <= 0:
        return p
    ao = at + ab * (1 - at)
    mixed = {"multiply": lambda b, t: b * t, "screen": lambda b, t: 1 - (1 - b) * (1 - t), "difference": lambda b, t: abs(b - t)}.get(mode, lambda b, t: t)
    return (*[byte((at * mixed(p[k] / 255, q[k] / 255) + ab * p[k] / 255 * (1 - at)) / ao) for k in range(3)], byte(ao))


def adjusted(p, share, how):
    if not p[3]:
        return p
    e = [((v / 255 * 2 ** how["exposure"] + how["brightness"]) - 0.5) * (1 + how["contrast"]) + 0.5 for v in p[:3]]
    gray = sum(w * v for w, v in zip(c.WEIGHTS, e))
    e = [gray + (v - gray) * (1 + how["saturation"]) for v in e]
    co, si = cos(radians(how["hue"])), sin(radians(how["hue"]))
    e = [sum((w + co * a + si * b) * v for w, a, b, v in zip(c.WEIGHTS, c.TURN_COS[i], c.TURN_SIN[i], e)) for i in range(3)]
    return (*[byte(o / 255 + (min(1, max(0, v)) ** (1 / how["gamma"]) - o / 255) * share) for o, v in zip(p[:3], e)], p[3])


def model(rows, parent, w, h):
    canvas = [[(0, 0, 0, 0)] * w for _ in range(h)]
    for row in sorted((r for r in rows if r["parent"] == parent and r["visible"]), key=lambda r: (r["z"], r["id"])):
        inner = model(rows, row["id"], w, h) if row["kind"] == "group" else None
        for y in range(h):
            for x in range(w):
                p = canvas[y][x]
                if inner:
                    canvas[y][x] = over(row["mode"], p, inner[y][x], row["opacity"])
                    continue
                if row["width"] is None:
                    i, share = None, 255
                else:
                    u, v = x - row["left"], y - row["top"]
                    if not (0 <= u < row["width"] and 0 <= v < row["height"]):
                        continue
                    i = v * row["width"] + u
                    share = 255 if row["mask"] is None else row["mask"][i] if i < len(row["mask"]) else 0
                if row["kind"] == "adjustment":
                    how = {k: row[k] if row[k] is not None else c.ADJUSTMENTS[k] for k in c.ADJUSTMENTS}
                    canvas[y][x] = adjusted(p, share / 255 * row["opacity"], how)
                else:
                    q = row["px"][i]
                    canvas[y][x] = over(row["mode"], p, (*q[:3], (q[3] * share + 127) // 255), row["opacity"])
    return canvas


def layer(rng, doc, id_, parent, kind, **change):
    w, h = rng.randint(1, 6), rng.randint(1, 5)
    row = {
        "doc": doc, "id": id_, "parent": parent, "z": rng.randint(0, 2), "kind": kind, "mode": rng.choice(["normal", "multiply", "screen", "difference", None]), "opacity": rng.choice([0.0, 0.3, 1.0]),
        "visible": rng.random() < 0.85, "left": rng.randint(-3, 5), "top": rng.randint(-3, 5), "width": w, "height": h, "px": None, "mask": None} | dict.fromkeys(c.ADJUSTMENTS)
    if kind == "pixel":
        row["px"] = [tuple(rng.choice([0, 255, rng.randint(0, 255)]) for _ in "rgba") for _ in range(w * h)]
    if rng.random() < 0.4 and kind != "group":
        row["mask"] = [rng.randint(0, 255) for _ in range(w * h - rng.randint(0, 1))]
    if kind == "adjustment":
        row |= {"brightness": rng.uniform(-0.3, 0.3), "contrast": rng.uniform(-0.5, 0.5), "saturation": rng.uniform(-1, 1), "hue": rng.uniform(-180, 180), "gamma": rng.uniform(0.5, 2), "exposure": rng.uniform(-1, 1)}
        if rng.random() < 0.5:
            row |= {"width": None, "left": None, "top": None, "height": None, "mask": None}
    if kind == "group":
        row |= {"width": None, "height": None, "left": None, "top": None}
    return row | change


def test_trees_against_a_recursive_model(spark):
    rng = random.Random(3)
    rows = []
    for doc in range(6):
        groups = [None]
        for id_ in range(1, 16):
            kind = rng.choice(["pixel", "pixel", "group", "adjustment"])
            rows.append(layer(rng, doc, id_, rng.choice(groups[-3:]), kind))
            if kind == "group":
                groups.append(id_)
    rows.append(layer(rng, 6, 1, None, "pixel", visible=False))  # nothing shows
    rows.append(layer(rng, 7, 1, 99, "pixel", visible=True))  # its group is missing
    chain = [layer(rng, 8, k, k - 1 or None, "group", visible=True, opacity=1.0) for k in range(1, 8)]
    rows += [*chain, layer(rng, 8, 20, 7, "pixel", visible=True, opacity=1.0)]  # deep
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    got = {(r.doc, r.y): [tuple(p) for p in r.strip] for r in c.composite(frame, 7, 6).collect()}
    part = {(r.doc, r.y): [tuple(p) for p in r.strip] for r in c.composite(frame, 7, 6, (2, 1, 4, 3)).collect()}
    assert len(got) == 9 * 6 and len(part) == 9 * 3
    for doc in range(9):
        want = model([r for r in rows if r["doc"] == doc], None, 7, 6)
        for y in range(6):
            near = [abs(a - b) for p, q in zip(got[doc, y], want[y]) for a, b in zip(p, q)]
            assert max(near) == 0, (doc, y)
            if 1 <= y < 4:
                assert part[doc, y] == got[doc, y][2:6]


def test_flattened_and_merged(spark):
    rng = random.Random(9)
    rows = []
    for doc in range(5):
        rows.append(layer(rng, doc, 1, None, "group", visible=True))
        for id_ in range(2, 7):
            rows.append(layer(rng, doc, id_, 1, rng.choice(["pixel", "pixel", "pixel", "adjustment", "group"]), z=id_))
    rows += [layer(rng, 9, 1, None, "group", left=4, top=-2, visible=True), layer(rng, 9, 2, 1, "pixel", visible=False)]
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    got = {}
    for r in c.flattened(frame).filter("parent = 1").collect():
        got.setdefault(r.doc, {})[r.y] = (r.left, [tuple(p) for p in r.strip])
    for doc in (*range(5), 9):
        shown = sorted((r for r in rows if r["doc"] == doc and r["parent"] == 1 and r["kind"] == "pixel" and r["visible"]), key=lambda r: r["z"])
        if not shown:
            assert got[doc] == ({-2: (4, [(0, 0, 0, 0)])} if doc == 9 else {0: (0, [(0, 0, 0, 0)])})
            continue
        x0, y0 = min(r["left"] for r in shown), min(r["top"] for r in shown)
        w, h = max(r["left"] + r["width"] for r in shown) - x0, max(r["top"] + r["height"] for r in shown) - y0
        moved = [r | {"left": r["left"] - x0, "top": r["top"] - y0} for r in shown]
        want = model(moved, 1, w, h)
        assert got[doc] == {y0 + y: (x0, want[y]) for y in range(h)}
    merged = c.merged_down(frame, 2).collect()
    for doc in range(5):
        pair = sorted((r for r in rows if r["doc"] == doc and r["parent"] == 1), key=lambda r: r["z"])[1:3]
        mine = {r.y: (r.left, [tuple(p) for p in r.strip]) for r in merged if r.doc == doc}
        if pair[1]["kind"] != "pixel":
            assert not mine
            continue
        pair = [pair[0] | {"mode": "normal", "opacity": 1.0, "mask": None}, pair[1]]
        pair = [r | {"visible": True} for r in pair if r["kind"] == "pixel"]
        x0, y0 = min(r["left"] for r in pair), min(r["top"] for r in pair)
        w, h = max(r["left"] + r["width"] for r in pair) - x0, max(r["top"] + r["height"] for r in pair) - y0
        want = model([r | {"left": r["left"] - x0, "top": r["top"] - y0} for r in pair], 1, w, h)
        assert mine == {y0 + y: (x0, want[y]) for y in range(h)}


def test_one_layer_in_a_region(spark):
    rng = random.Random(1)
    row = layer(rng, 0, 1, None, "pixel", mode="normal", opacity=1.0, visible=True, left=1, top=1, width=2, height=2, px=[(k, k, k, 255) for k in range(4)], mask=None)
    frame = spark.createDataFrame([tuple(row.values())], SCHEMA)
    got = {r.y: [p.r if p.a else None for p in r.strip] for r in c.composite(frame, 4, 4, (2, 0, 2, 3)).collect()}
    assert got == {0: [None, None], 1: [1, None], 2: [3, None]}
