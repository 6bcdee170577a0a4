"""The codec's relations as DuckDB SQL, built from common table expressions and written apart from the DataFrame code."""

from __future__ import annotations

#: Small block, macro block and spread of the qualities used here, apart from the library's own.
SIZES = {0: (4, 8, 64), 20: (3, 6, 64), 40: (2, 4, 64), 60: (1, 3, 64), 70: (1, 3, 35), 80: (1, 2, 64), 100: (1, 2, 8)}
SYNTHETIC = "SELECT 0::BIGINT AS img_id, x::INT AS x, y::INT AS y, (xor(17 * x, 31 * y) & 255)::INT AS r, ((43 * x + 13 * y) & 255)::INT AS g, (xor(7 * x, 11 * y) & 255)::INT AS b FROM range({w}) t(x), range({h}) u(y)"
SMOOTH = "SELECT 0::BIGINT AS img_id, x::INT AS x, y::INT AS y, ((2 * x + y) & 255)::INT AS r, ((x + 2 * y) & 255)::INT AS g, ((x + y) & 255)::INT AS b FROM range({w}) t(x), range({h}) u(y)"
EVENTS = "SELECT 0::BIGINT AS img_id, (event_id % 100)::INT AS x, (event_id // 100)::INT AS y, (floor(value)::BIGINT & 255)::INT AS r, (user_id & 255)::INT AS g, (second(ts) & 255)::INT AS b FROM events"
EMBEDDINGS = "SELECT 0::BIGINT AS img_id, (i - 1)::INT AS x, vec_id::INT AS y, floor((embedding[i]::DOUBLE + 1) * 127.5)::INT AS v FROM embeddings, range(1, 65) t(i)"
DOCUMENTS = "SELECT doc_id AS img_id, (i % 32)::INT AS x, (i // 32)::INT AS y, (CASE WHEN i < length(text) THEN unicode(substr(text, i + 1, 1)) & 255 ELSE 0 END)::INT AS v FROM (SELECT doc_id, text, unnest(range((length(text) + 31) // 32 * 32)) AS i FROM documents)"
GRAY_DOCUMENTS = f"SELECT img_id, x, y, v AS r, v AS g, v AS b FROM ({DOCUMENTS})"

PLANES = """px AS ({px}), planes AS (
  SELECT img_id, 0 AS ch, x, y, (77 * r + 150 * g + 29 * b) >> 8 AS v FROM px {chroma})"""
CHROMA = """UNION ALL SELECT img_id, 1, x, y, ((-43 * r - 85 * g + 128 * b) >> 8) + 128 FROM px
  UNION ALL SELECT img_id, 2, x, y, ((128 * r - 107 * g - 21 * b) >> 8) + 128 FROM px"""


def planes(px: str, bw: bool = False) -> str:
    return PLANES.format(px=px, chroma="" if bw else CHROMA)


def blocks(px: str, quality: int, bw: bool = False) -> str:
    """CTEs up to ``cells`` (a row a pixel, with its block) and ``blocks`` (a row a block)."""
    s, m, spread = SIZES[quality]
    half = m // 2
    quad = f"CASE WHEN is_macro = 1 AND {m} IN (6, 8) THEN (y % {m}) // {half} * 2 + (x % {m}) // {half} ELSE 0 END"
    key = "img_id, ch, region, gy, gx, sy, sx"
    return f"""WITH {planes(px, bw)},
size AS (SELECT img_id AS z, (max(x) + 1) // {s} * {s} AS w4, (max(y) + 1) // {s} * {s} AS h4 FROM px GROUP BY img_id),
a AS (SELECT p.*, CASE WHEN y >= h4 // {m} * {m} THEN 2 WHEN x >= w4 // {m} * {m} THEN 1 ELSE 0 END AS region
  FROM planes p JOIN size ON img_id = z WHERE x < w4 AND y < h4),
b AS (SELECT *, CASE WHEN region = 0 THEN y // {m} ELSE y // {s} END AS gy, CASE WHEN region = 0 THEN x // {m} ELSE x // {s} END AS gx FROM a),
c AS (SELECT *, CASE WHEN region = 0 AND max(v) OVER k - min(v) OVER k < {spread} THEN 1 ELSE 0 END AS is_macro
  FROM b WINDOW k AS (PARTITION BY img_id, ch, region, gy, gx)),
d AS (SELECT *, CASE WHEN region = 0 AND is_macro = 0 THEN (y % {m}) // {s} ELSE 0 END AS sy, CASE WHEN region = 0 AND is_macro = 0 THEN (x % {m}) // {s} ELSE 0 END AS sx FROM c),
e AS (SELECT *, sum(v) OVER k // count(*) OVER k AS thr, {quad} AS quad FROM d WINDOW k AS (PARTITION BY {key})),
f AS (SELECT {key}, any_value(is_macro) AS is_macro, min(x) AS x0, min(y) AS y0, round(sqrt(count(*)))::INT AS side, any_value(thr) AS thr,
    sum(v) FILTER (v >= thr) // count(*) FILTER (v >= thr) AS hi, sum(v) FILTER (v < thr) // nullif(count(*) FILTER (v < thr), 0) AS lo,
    string_agg(CASE WHEN v >= thr THEN '1' ELSE '0' END, '' ORDER BY quad, y, x) AS mask FROM e GROUP BY {key}),
blocks AS (SELECT {key}, x0::INT AS x0, y0::INT AS y0, side, is_macro::INT AS is_macro, (lo IS NOT NULL AND lo <> hi)::INT AS is_pattern,
    (CASE WHEN lo IS NOT NULL AND lo <> hi THEN hi ELSE thr END)::INT AS fg, (CASE WHEN lo <> hi THEN lo END)::INT AS bg, CASE WHEN lo <> hi THEN mask END AS bits,
    (row_number() OVER (PARTITION BY img_id, ch ORDER BY region, gy, gx, sy, sx) - 1)::INT AS seq FROM f),
cells AS (SELECT e.*, fg, bg, is_pattern FROM e JOIN blocks USING ({key})),
back AS (SELECT img_id, ch, x, y, (CASE WHEN is_pattern = 1 AND v < thr THEN bg ELSE fg END)::INT AS v FROM cells)"""


def packed(bits: str) -> str:
    """(img_id, ch, hex) of (img_id, ch, pos, bit)."""
    return f"""SELECT img_id, ch, string_agg(printf('%02X', v), '' ORDER BY i) AS hex FROM (
  SELECT img_id, ch, pos // 8 AS i, sum(bit << (7 - pos % 8)::INT)::INT AS v FROM ({bits}) GROUP BY img_id, ch, pos // 8) GROUP BY img_id, ch"""


def joined(values: str) -> str:
    return f"SELECT img_id, ch, string_agg(printf('%02X', v), '' ORDER BY i) AS hex FROM ({values}) GROUP BY img_id, ch"


BITS = {
    "size": "SELECT img_id, ch, row_number() OVER (PARTITION BY img_id, ch ORDER BY gy, gx) - 1 AS pos, is_macro AS bit FROM blocks WHERE region = 0 AND sy = 0 AND sx = 0",
    "type": "SELECT img_id, ch, seq AS pos, is_pattern AS bit FROM blocks",
    "pattern": "SELECT img_id, ch, ahead + k - 1 AS pos, substr(bits, k::INT, 1)::INT AS bit FROM (SELECT *, sum(side * side) OVER (PARTITION BY img_id, ch ORDER BY seq) - side * side AS ahead, unnest(range(1, side * side + 1)) AS k FROM blocks WHERE is_pattern = 1)",
}
DELTAS = {
    "fg": "SELECT img_id, ch, seq AS i, ((fg - coalesce(lag(fg) OVER (PARTITION BY img_id, ch ORDER BY seq), 0)) & 255)::INT AS v FROM blocks",
    "bg": "SELECT img_id, ch, (row_number() OVER (PARTITION BY img_id, ch ORDER BY seq) - 1)::INT AS i, ((bg - coalesce(lag(bg) OVER (PARTITION BY img_id, ch ORDER BY seq), 0)) & 255)::INT AS v FROM blocks WHERE is_pattern = 1",
}


def segments(px: str, quality: int, bw: bool = False) -> str:
    """CTEs up to ``segs``."""
    streams = {**{n: packed(q) for n, q in BITS.items()}, **{n: joined(q) for n, q in DELTAS.items()}}
    ctes = ",\n".join(f"s_{n} AS ({q})" for n, q in streams.items())
    cols = ", ".join(f"coalesce(s_{n}.hex, '') AS {n}_hex" for n in streams)
    joins = " ".join(f"LEFT JOIN s_{n} ON n.img_id = s_{n}.img_id AND n.ch = s_{n}.ch" for n in streams)
    body = " || ".join(f"printf('%08X', length({n}_hex) // 2) || {n}_hex" for n in streams)
    return f"""{blocks(px, quality, bw)}, {ctes},
n AS (SELECT img_id, ch, count(*) AS block_count FROM blocks GROUP BY img_id, ch),
segs AS (SELECT *, printf('%08X', block_count) || {body} AS segment_hex FROM (SELECT n.img_id, n.ch, block_count, {cols} FROM n {joins}))"""


def payload(px: str, quality: int, bw: bool = False) -> str:
    s, m, _ = SIZES[quality]
    return f"""{segments(px, quality, bw)},
pay AS (SELECT segs.img_id, any_value(w)::INT AS w, any_value(h)::INT AS h, '424142450A{s:04X}{m:04X}{1 if bw else 7:02X}' || printf('%08X%08X', any_value(w), any_value(h)) || string_agg(segment_hex, '' ORDER BY ch) AS payload_hex
  FROM segs JOIN (SELECT img_id, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY img_id) z ON z.img_id = segs.img_id GROUP BY segs.img_id)"""


def clamp(e: str) -> str:
    return f"greatest(0, least(255, {e}))"


def pixels(channels: tuple[int, ...] = (0, 1, 2), filled: str = "filled", rgb: str = "rgb") -> str:
    """CTEs ``filled`` and ``rgb`` after ``back``: decoded pixels over the whole grid."""
    u = "(u - 128)" if 1 in channels else "0"
    v = "(v - 128)" if 2 in channels else "0"
    return f"""{filled} AS (SELECT p.img_id, p.x, p.y, coalesce(max(v) FILTER (ch = 0), 0) AS yy, coalesce(max(v) FILTER (ch = 1), 128) AS u, coalesce(max(v) FILTER (ch = 2), 128) AS v
  FROM px p LEFT JOIN back USING (img_id, x, y) GROUP BY p.img_id, p.x, p.y),
{rgb} AS (SELECT img_id, x, y, {clamp(f"yy + ((91881 * {v}) >> 16)")}::INT AS r, {clamp(f"yy - ((22554 * {u} + 46802 * {v}) >> 16)")}::INT AS g, {clamp(f"yy + ((116130 * {u}) >> 16)")}::INT AS b FROM {filled})"""


def luma(p: str = "") -> str:
    return f"((299 * {p}r + 587 * {p}g + 114 * {p}b) // 1000)"


def deblock(source: str, small: int, axis: str, name: str) -> str:
    """CTE ``name``: pairs across grid lines by lag and lead along ``axis``."""
    o = "y" if axis == "x" else "x"
    w = f"WINDOW k AS (PARTITION BY img_id, {o} ORDER BY {axis})"
    pick = lambda c: f"CASE WHEN NOT wide THEN {c} WHEN {axis} % {small} = 0 AND {axis} > 0 AND abs({luma()} - lag({luma()}) OVER k) <= 10 THEN (lag({c}) OVER k + {c}) // 2 WHEN {axis} % {small} = {small - 1} AND abs({luma()} - lead({luma()}) OVER k) <= 10 THEN ({c} + lead({c}) OVER k) // 2 ELSE {c} END AS {c}"
    return f"{name} AS (SELECT img_id, x, y, {', '.join(map(pick, 'rgb'))} FROM (SELECT *, max(x) OVER (PARTITION BY img_id) + 1 >= {2 * small} AND max(y) OVER (PARTITION BY img_id) + 1 >= {2 * small} AS wide FROM {source}) {w})"


def junctions(source: str, small: int, name: str) -> str:
    """CTE ``name``: the junction blend, by joins for each corner and each step of the four runs. Pictures of fewer than two blocks stay."""
    radius = min(small, 3)
    corners, names = [], {"nw": (-1, -1), "ne": (0, -1), "sw": (-1, 0), "se": (0, 0)}
    for n, (dx, dy) in names.items():
        corners.append(f"JOIN {source} {n} ON {n}.img_id = j.img_id AND {n}.x = j.x + {dx} AND {n}.y = j.y + {dy}")
    cols = ", ".join(f"{n}.{c} AS {c}_{n}" for n in names for c in "rgb") + ", " + ", ".join(f"{luma(n + '.')} AS l_{n}" for n in names)

    def run(letter: str, a: str, b: str, a_at: str, b_at: str) -> str:
        # the run ends before the first step whose pixel is missing or unlike
        return f"""run{letter} AS (SELECT img_id AS ri, x AS rx, y AS ry, coalesce(min(i) FILTER (NOT ok) - 1, {radius}) AS {letter} FROM (
  SELECT q.img_id, q.x, q.y, i, coalesce(abs({luma('pa.')} - {a}) <= 8 AND abs({luma('pb.')} - {b}) <= 8, false) AS ok FROM corners q CROSS JOIN range(1, {radius + 1}) t(i)
  LEFT JOIN {source} pa ON pa.img_id = q.img_id AND {a_at} LEFT JOIN {source} pb ON pb.img_id = q.img_id AND {b_at}) GROUP BY img_id, x, y)"""

    left = run("L", "l_nw", "l_sw", "pa.x = q.x - i AND pa.y = q.y - 1", "pb.x = q.x - i AND pb.y = q.y")
    right = run("R", "l_ne", "l_se", "pa.x = q.x - 1 + i AND pa.y = q.y - 1", "pb.x = q.x - 1 + i AND pb.y = q.y")
    up = run("U", "l_nw", "l_ne", "pa.x = q.x - 1 AND pa.y = q.y - i", "pb.x = q.x AND pb.y = q.y - i")
    down = run("D", "l_sw", "l_se", "pa.x = q.x - 1 AND pa.y = q.y - 1 + i", "pb.x = q.x AND pb.y = q.y - 1 + i")
    lerp = lambda a, b, t: f"floor(({a})::DOUBLE * (1 - {t}) + ({b})::DOUBLE * {t} + 0.5)::INT"
    blend = ", ".join(f"{lerp(lerp(f'{c}_nw', f'{c}_ne', 'across'), lerp(f'{c}_sw', f'{c}_se', 'across'), 'down')} AS {c}" for c in "rgb")
    runs = " ".join(f"JOIN run{n} ON run{n}.ri = q.img_id AND run{n}.rx = q.x AND run{n}.ry = q.y" for n in "LRUD")
    return f"""big AS (SELECT img_id AS big_id FROM {source} GROUP BY img_id HAVING max(x) + 1 >= {2 * small} AND max(y) + 1 >= {2 * small}),
corners AS (SELECT * FROM (SELECT j.img_id, j.x, j.y, {cols} FROM (SELECT img_id, x, y FROM {source} JOIN big ON img_id = big_id WHERE x > 0 AND y > 0 AND x % {small} = 0 AND y % {small} = 0) j {' '.join(corners)})
  WHERE greatest(l_nw, l_ne, l_sw, l_se) - least(l_nw, l_ne, l_sw, l_se) <= 32),
{left}, {right}, {up}, {down},
rects AS (SELECT q.*, L, R, U, D FROM corners q {runs}),
drawn AS (SELECT img_id, px_ AS x, py_ AS y, jx, jy, {blend} FROM (
  SELECT *, (px_ - (jx - L))::DOUBLE / (L + R - 1) AS across, (py_ - (jy - U))::DOUBLE / (U + D - 1) AS down FROM (
    SELECT *, x AS jx, y AS jy, unnest(range(x - L, x + R)) AS px_ FROM rects) CROSS JOIN LATERAL (SELECT unnest(range(jy - U, jy + D)) AS py_))),
last AS (SELECT * FROM drawn QUALIFY row_number() OVER (PARTITION BY img_id, x, y ORDER BY jy DESC, jx DESC) = 1),
{name} AS (SELECT s.img_id, s.x, s.y, coalesce(l.r, s.r)::INT AS r, coalesce(l.g, s.g)::INT AS g, coalesce(l.b, s.b)::INT AS b FROM {source} s LEFT JOIN last l ON l.img_id = s.img_id AND l.x = s.x AND l.y = s.y)"""
