"""SQL for the image relations that the comparison queries begin with."""

PX = """WITH e AS (SELECT vec_id AS image_id, list_transform(embedding, lambda q: CAST(greatest(0, least(255, floor(CAST(q AS DOUBLE) * 255 + 128))) AS INTEGER)) AS v FROM embeddings),
n AS (SELECT image_id, v, unnest(range(64)) AS i FROM e),
px AS (SELECT image_id, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, v[i + 1] AS r, v[(i + 21) % 64 + 1] AS g, v[(i + 42) % 64 + 1] AS b, CAST(i * 37 % 256 AS INTEGER) AS a FROM n),
gr AS (SELECT image_id, x, y, r AS v FROM px)"""


#: Colour images of 32 x 24 of twelve images each, a row for each sample of each channel.
QUILTS = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda q: CAST(greatest(0, least(255, floor(CAST(q AS DOUBLE) * 255 + 128))) AS INTEGER)) AS v FROM embeddings),
o AS (SELECT vec_id // 12 AS image_id, v, row_number() OVER (PARTITION BY vec_id // 12 ORDER BY vec_id) - 1 AS k FROM e),
fl AS (SELECT image_id, k * 64 + i AS p, v[i + 1] AS v FROM o, unnest(range(64)) AS u(i)),
ch AS (SELECT unnest(['r', 'g', 'b']) AS channel, unnest([0, 256, 512]) AS move),
gr AS (SELECT im.image_id, channel, CAST(p % 32 AS INTEGER) AS x, CAST(p // 32 AS INTEGER) AS y, coalesce(fl.v, 0) AS v FROM (SELECT DISTINCT image_id FROM o) im, ch, unnest(range(768)) AS g(p) LEFT JOIN fl ON fl.image_id = im.image_id AND fl.p = (g.p + move) % 768)""".replace("CAST(p % 32", "CAST(g.p % 32").replace("CAST(p // 32", "CAST(g.p // 32")


def f(value) -> str:
    return f"CAST({value} AS FLOAT)"


def byte(value: str) -> str:
    return f"CAST(trunc(greatest({f(0)}, least({f(255)}, {value}))) AS INTEGER)"


LUMA = f"({f(0.299)} * {f('r')} + {f(0.587)} * {f('g')} + {f(0.114)} * {f('b')})"


def pick(columns: str, source: str = "px", more: str = "") -> str:
    return f"{PX}{more} SELECT {columns} FROM {source}"


def channels(of, keep: str = "a") -> str:
    """image_id, x, y and of(channel) for r, g and b."""
    return pick(", ".join(["image_id", "x", "y", *[f"{of(c)} AS {c}" for c in "rgb"], *([keep] if keep else [])]))
