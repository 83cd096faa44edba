"""Operators whose steps depend on one another, image by image: error diffusion, seams, components.

They run as Arrow batches of whole images; images are rows, so nothing is shuffled for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..oracle import PX
from ..sources.tables import images, stacks
from .neighbourhood import as_pixels
from .scenes import without_seams


def per_stack(df: DataFrame, of) -> DataFrame:
    """of(stack) for stacks (image, y, x) of samples of one size: image_id, width, height, v."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for w, h, some in stacks(parts):
            out = of(np.stack(some["v"].to_list()).reshape(len(some), h, w).astype(np.int64)).astype(np.int32)
            yield pd.DataFrame({"image_id": some["image_id"].to_list(), "width": out.shape[2], "height": out.shape[1], "v": list(out.reshape(len(out), -1))})

    return df.select("image_id", "width", "height", "v").mapInPandas(run, "image_id long, width int, height int, v array<int>")


def all_diffused(stack: np.ndarray, level: float = 128) -> np.ndarray:
    """Black and white by error diffusion in raster order: 7, 3, 5 and 1 sixteenths to right, lower left, below, lower right."""
    n, h, w = stack.shape
    rest = np.zeros((n, h + 1, w + 2), np.float32)
    rest[:, :h, 1 : w + 1] = stack
    out = np.zeros(stack.shape, np.int64)
    for y in range(h):
        for x in range(w):
            old = rest[:, y, x + 1]
            out[:, y, x] = chosen = np.where(old >= level, 255, 0)
            error = old - chosen.astype(np.float32)
            for dx, dy, share in ((1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)):
                rest[:, y + dy, x + 1 + dx] += error * np.float32(share / 16)
    return out


def diffused(v: np.ndarray, level: float = 128) -> np.ndarray:
    return all_diffused(v[None], level)[0]


def all_carved(stack: np.ndarray, seams: int = 2) -> np.ndarray:
    """Narrower by seams of least energy, as for colours."""
    return without_seams(stack[..., None].astype(np.float32), seams)[..., 0]


def carved(v: np.ndarray, seams: int = 2) -> np.ndarray:
    return all_carved(v[None], seams)[0]


def labelled(v: np.ndarray, level: int = 128) -> np.ndarray:
    """Components of 8-connected samples of at least `level`, numbered from 1 in raster order; 0 is background.

    Each sample points to the least place known of its component.  A round hooks the places that neighbours point to onto
    the smaller one of them and then follows all pointers to their ends, so rounds grow with the logarithm of the samples.
    """
    h, w = v.shape
    some = v >= level
    place = np.arange(v.size).reshape(h, w)
    pairs = []
    for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
        one, two = (slice(0, h - dy), slice(max(0, -dx), w - max(0, dx))), (slice(dy, h), slice(max(0, dx), w - max(0, -dx)))
        both = some[one] & some[two]
        pairs.append((place[one][both], place[two][both]))
    a, b = (np.concatenate(side) for side in zip(*pairs))
    least = np.arange(v.size)
    while len(a):
        low, high = np.minimum(least[a], least[b]), np.maximum(least[a], least[b])
        apart = low < high
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(least, high[apart], low[apart])
        while (least[least] != least).any():
            least = least[least]
    ends = least.reshape(h, w)
    return np.where(some, np.searchsorted(np.unique(ends[some]), ends) + 1, 0)


def all_labelled(stack: np.ndarray) -> np.ndarray:
    return np.stack([labelled(v) for v in stack])


_LABELS = PX.replace("WITH ", "WITH RECURSIVE ", 1) + """, fg AS (SELECT image_id, x, y, y * 8 + x AS p FROM gr WHERE v >= 128),
re AS (SELECT image_id, x, y, p, p AS root FROM fg UNION SELECT n.image_id, n.x, n.y, n.p, re.root FROM re JOIN fg n ON n.image_id = re.image_id AND abs(n.x - re.x) <= 1 AND abs(n.y - re.y) <= 1 AND n.p > re.root),
le AS (SELECT image_id, p, min(root) AS root FROM re GROUP BY ALL), nu AS (SELECT image_id, p, dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS k FROM le)
SELECT gr.image_id, gr.x, gr.y, CAST(coalesce(k, 0) AS INTEGER) AS v FROM gr LEFT JOIN nu ON nu.image_id = gr.image_id AND nu.p = gr.y * 8 + gr.x"""

OPS = {
    "error_diffusion": (lambda s, d: as_pixels(per_stack(images(s, d), all_diffused)), None),
    "seam_carve": (lambda s, d: as_pixels(per_stack(images(s, d), all_carved)), None),
    "component_labels": (lambda s, d: as_pixels(per_stack(images(s, d), all_labelled)), _LABELS),
}
