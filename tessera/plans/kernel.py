"""The codec on one image as numpy arrays, for the Arrow path: no pixel ever is a row.

The coefficients of colours and luma are fixed values of the format, as in ``functions.color``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from tessera.functions.presets import preset
from tessera.operators.decode import MAX_MACRO, MAX_PIXELS, STREAMS
from tessera.operators.postfilter import FLAT, JUNCTION_SPREAD, RUN, SIMILAR
from tessera.operators.streams import MAGIC

Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # is_pattern, fg, bg, bits


class CodecError(ValueError):
    pass


#: Values of a plane that are handled at once: an image costs some bytes a pixel for itself and its streams, none for arithmetic.
STRIP = 1 << 18


def strips(h: int, w: int, side: int = 1) -> Iterator[tuple[slice, slice]]:
    """Parts of (h, w) in raster order of its blocks of ``side``, whole blocks of about STRIP values."""
    lines = max(1, STRIP // max(1, w * side)) * side
    width = max(w, 1) if lines > side else max(1, STRIP // (side * side)) * side
    for y in range(0, h, lines):
        for x in range(0, w, width):
            yield slice(y, min(y + lines, h)), slice(x, min(x + width, w))


def planes(rgb: np.ndarray, bw: bool = False) -> list[np.ndarray]:
    """rgb: (h, w, 3) bytes. Planes are bytes."""
    h, w = rgb.shape[:2]
    out = [np.empty((h, w), dtype=np.uint8) for _ in range(1 if bw else 3)]
    for at in strips(h, w):
        r, g, b = (rgb[at][..., i].astype(np.int32) for i in range(3))
        out[0][at] = (77 * r + 150 * g + 29 * b) >> 8
        if not bw:
            out[1][at], out[2][at] = ((-43 * r - 85 * g + 128 * b) >> 8) + 128, ((128 * r - 107 * g - 21 * b) >> 8) + 128
    return out


def to_rgb(chans: dict[int, np.ndarray]) -> np.ndarray:
    y = chans[0].astype(np.int32)
    u = chans[1].astype(np.int32) - 128 if 1 in chans else 0
    v = chans[2].astype(np.int32) - 128 if 2 in chans else 0
    rgb = np.stack([y + ((91881 * v) >> 16), y - ((22554 * u + 46802 * v) >> 16), y + ((116130 * u) >> 16)], axis=-1)
    return np.clip(rgb, 0, 255).astype(np.uint8)


def layout(w: int, h: int, small: int, macro: int) -> tuple[int, int, int, int]:
    w4, h4 = w // small * small, h // small * small
    return w4, h4, w4 // macro * macro, h4 // macro * macro


def tiles(v: np.ndarray, side: int) -> np.ndarray:
    """Blocks in raster order, a column of values each: what is done to all blocks runs along memory."""
    h, w = v.shape
    return v.reshape(h // side, side, w // side, side).transpose(1, 3, 0, 2).reshape(side * side, -1)


@lru_cache
def mask_order(side: int) -> np.ndarray:
    """Raster index of each stored mask bit: by quadrant for sides 6 and 8."""
    raster = np.arange(side * side).reshape(side, side)
    if side not in (6, 8):
        return raster.ravel()
    half = side // 2
    return raster.reshape(2, half, 2, half).swapaxes(1, 2).ravel()


def fit(values: np.ndarray) -> Block:
    """bits has a column of stored mask bits for each block that has a mask."""
    n, blocks = values.shape
    if n == 1:
        return np.zeros(blocks, dtype=bool), values[0], values[0], np.zeros((1, 0), dtype=bool)
    total = values.sum(axis=0, dtype=np.int32)
    thr = total // n
    mask = values >= thr.astype(values.dtype)
    ones = mask.sum(axis=0, dtype=np.int32)
    high = np.where(mask, values, 0).sum(axis=0, dtype=np.int32)
    fg, bg = high // np.maximum(ones, 1), (total - high) // np.maximum(n - ones, 1)
    pattern = (ones < n) & (fg != bg)
    return pattern, np.where(pattern, fg, thr), bg, mask[:, pattern][mask_order(int(n**0.5))]


def _places(big: np.ndarray, each: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First sequence number of whole macros, numbers of the small blocks of the others, and how many there are."""
    count = np.where(big, 1, each)
    first = np.cumsum(count) - count
    return first[big], (first[~big][:, None] + np.arange(each)).ravel(), int(count.sum())


class Bits:
    """Bits packed as they come; the last byte is padded with zeros."""

    def __init__(self) -> None:
        self.packed, self.rest = [], np.zeros(0, dtype=bool)

    def add(self, bits: np.ndarray) -> None:
        bits = np.concatenate([self.rest, bits]) if len(self.rest) else bits
        whole = len(bits) // 8 * 8
        self.packed.append(np.packbits(bits[:whole]))
        self.rest = bits[whole:].copy()

    def done(self) -> np.ndarray:
        return np.concatenate([*self.packed, np.packbits(self.rest)])


def encode_plane(v: np.ndarray, small: int, macro: int, spread: int) -> dict[str, np.ndarray | int]:
    """The streams of a plane of bytes; blocks come strip by strip, in the order of the streams."""
    h, w = v.shape
    w4, h4, fw, fh = layout(w, h, small, macro)
    each = (macro // small) ** 2
    sizes, types, masks = Bits(), Bits(), Bits()
    levels, seconds = [np.zeros(0, dtype=np.uint8)], [np.zeros(0, dtype=np.uint8)]

    def add(n: int, parts: list[tuple[np.ndarray, Block, int]]) -> None:
        pattern, fg, bg, area = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.int64)
        for at, (p, f, b, _), side in parts:
            pattern[at], fg[at], bg[at], area[at] = p, f, b, side * side
        used = np.where(pattern, area, 0)
        start = np.cumsum(used) - used
        stored = np.zeros(int(used.sum()), dtype=bool)
        for at, (p, _, _, bits), side in parts:
            if bits.size:
                stored[start[at[p]][None, :] + np.arange(side * side)[:, None]] = bits
        types.add(pattern)
        masks.add(stored)
        levels.append(fg)
        seconds.append(bg[pattern])

    for at in strips(fh, fw, macro):
        whole = tiles(v[:fh, :fw][at].astype(np.int16), macro)
        big = whole.max(axis=0) - whole.min(axis=0) < spread
        sizes.add(big)
        at_big, at_small, n = _places(big, each)
        add(n, [(at_big, fit(whole[:, big]), macro), (at_small, fit(tiles_of(whole[:, ~big], macro, small)), small)])
    for area in (v[:fh, fw:w4], v[fh:h4, :w4]):
        for at in strips(*area.shape, small):
            values = tiles(area[at].astype(np.int16), small)
            add(values.shape[1], [(np.arange(values.shape[1]), fit(values), small)])
    fg = np.concatenate(levels)
    return {"count": len(fg), "size": sizes.done(), "type": types.done(), "pattern": masks.done(), "fg": deltas(fg), "bg": deltas(np.concatenate(seconds))}


def tiles_of(whole: np.ndarray, macro: int, small: int) -> np.ndarray:
    """The small blocks of macro blocks, those of a macro block side by side."""
    k = macro // small
    return whole.reshape(k, small, k, small, -1).transpose(1, 3, 4, 0, 2).reshape(small * small, -1)


def deltas(v: np.ndarray) -> np.ndarray:
    return np.diff(v, prepend=v.dtype.type(0)).astype(np.uint8) if len(v) else np.zeros(0, dtype=np.uint8)


def undelta(b: np.ndarray) -> np.ndarray:
    return np.cumsum(b, dtype=np.uint8)  # sums mod 256


def encode(chans: list[np.ndarray], quality: int) -> bytes:
    """The payload of one image from its planes (one: grayscale)."""
    small, macro, spread = preset(quality)
    h, w = chans[0].shape
    if w < small or h < small:
        raise CodecError("image smaller than a block")
    out = [bytes.fromhex(MAGIC), struct.pack(">HHBII", small, macro, 1 if len(chans) == 1 else 7, w, h)]
    for v in chans:
        s = encode_plane(v, small, macro, spread)
        out.append(struct.pack(">I", s["count"]))
        for name in STREAMS:
            out += [struct.pack(">I", len(s[name])), s[name].data]
    return b"".join(out)


def split(payload: bytes) -> tuple[dict[str, int], dict[int, dict]]:
    """Header fields and the streams of each stored channel; raises CodecError."""
    magic = bytes.fromhex(MAGIC)
    if len(payload) < len(magic):
        raise CodecError("too short")
    if payload[:5] != magic:
        raise CodecError("bad magic")
    if len(payload) < 18:
        raise CodecError("truncated header")
    small, macro, mask, w, h = struct.unpack(">HHBII", payload[5:18])
    for bad, message in (
        (not small or not macro, "zero block size"), (not mask & 1, "no luma channel"), (not small or macro < small or macro % max(small, 1), "macro not a multiple of small"),
        (macro > MAX_MACRO, "macro too large"), (not w or not h, "empty image"), (w * h > MAX_PIXELS, "image too large"),
    ):
        if bad:
            raise CodecError(message)
    at, chans = 18, {}

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(payload):
            raise CodecError("truncated segment")
        at += n
        return payload[at - n : at]

    for ch in range(3):
        if mask >> ch & 1:
            s: dict = {"count": struct.unpack(">I", take(4))[0]}
            for name in STREAMS:
                s[name] = np.frombuffer(take(struct.unpack(">I", take(4))[0]), dtype=np.uint8)
            chans[ch] = s
    return {"small": small, "macro": macro, "mask": mask, "w": w, "h": h}, chans


def verify(s: dict, head: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Which macro blocks are whole and which blocks have a mask, of streams that fit each other; raises CodecError."""
    small, macro = head["small"], head["macro"]
    w4, h4, fw, fh = layout(head["w"], head["h"], small, macro)
    n_macros = fw // macro * (fh // macro)
    if len(s["fg"]) < s["count"]:
        raise CodecError("levels shorter than the block count")
    if len(s["bg"]) > s["count"]:
        raise CodecError("more second levels than blocks")
    if len(s["size"]) * 8 < n_macros:
        raise CodecError("size stream too short")
    big = np.unpackbits(s["size"])[:n_macros].astype(bool)
    each = (macro // small) ** 2
    n = int(big.sum()) + int((~big).sum()) * each + (w4 - fw) // small * (fh // small) + w4 // small * ((h4 - fh) // small)
    if n != s["count"]:
        raise CodecError("block count mismatch")
    if len(s["type"]) * 8 < n:
        raise CodecError("type stream too short")
    pattern = np.unpackbits(s["type"])[:n].astype(bool)
    if pattern.sum() != len(s["bg"]):
        raise CodecError("second level count mismatch")
    at_big, _, _ = _places(big, each)
    used = np.where(pattern, small * small, 0)
    used[at_big] = np.where(pattern[at_big], macro * macro, 0)
    if len(s["pattern"]) * 8 < used.sum():
        raise CodecError("pattern stream too short")
    return big, pattern


def decode_plane(s: dict, head: dict[str, int], fill: int) -> np.ndarray:
    small, macro, w, h = head["small"], head["macro"], head["w"], head["h"]
    w4, h4, fw, fh = layout(w, h, small, macro)
    each, n_macros = (macro // small) ** 2, fw // macro * (fh // macro)
    n_right, n_bottom = (w4 - fw) // small * (fh // small), w4 // small * ((h4 - fh) // small)
    big, pattern = verify(s, head)
    at_big, at_small, _ = _places(big, each)
    n = len(pattern)
    side = np.full(n, small)
    side[at_big] = macro
    used = np.where(pattern, side * side, 0)
    start = np.cumsum(used) - used
    masks = np.unpackbits(s["pattern"]).view(bool)
    fg = undelta(s["fg"][:n])
    bg = fg.copy()
    bg[pattern] = undelta(s["bg"])

    def draw(at: np.ndarray, width: int) -> np.ndarray:
        out = np.repeat(fg[at][None, :], width * width, axis=0)
        p = np.flatnonzero(pattern[at])
        if len(p):
            bits = masks[start[at[p]][None, :] + np.arange(width * width)[:, None]]
            out[mask_order(width)[:, None], p[None, :]] = np.where(bits, fg[at[p]], bg[at[p]])
        return out

    def laid(blocks: np.ndarray, ah: int, aw: int, width: int) -> np.ndarray:
        return blocks.reshape(width, width, ah // width, aw // width).transpose(2, 0, 3, 1).reshape(ah, aw)

    v = np.full((h, w), fill, dtype=np.uint8)
    if n_macros:
        whole = np.zeros((macro * macro, n_macros), dtype=np.uint8)
        whole[:, big] = draw(at_big, macro)
        k = macro // small
        whole[:, ~big] = draw(at_small, small).reshape(small, small, -1, k, k).transpose(3, 0, 4, 1, 2).reshape(macro * macro, -1)
        v[:fh, :fw] = laid(whole, fh, fw, macro)
    at = n - n_right - n_bottom
    for count, area in ((n_right, v[:fh, fw:w4]), (n_bottom, v[fh:h4, :w4])):
        if count:
            area[:] = laid(draw(np.arange(at, at + count), small), *area.shape, small)
        at += count
    return v


def decode(payload: bytes, postfilter: bool = False) -> np.ndarray:
    """(h, w, 3) bytes; bytes after the last segment are ignored."""
    head, chans = split(payload)
    rgb = to_rgb({ch: decode_plane(s, head, 128 if ch else 0) for ch, s in chans.items()})
    return deblocked(rgb, head["small"]) if postfilter else rgb


def luma(px: np.ndarray) -> np.ndarray:
    """Of RGB or gray pixels (y, x, channel)."""
    if px.shape[-1] == 1:
        return px[..., 0]
    c = px.astype(np.int64)
    return (299 * c[..., 0] + 587 * c[..., 1] + 114 * c[..., 2]) // 1000


def deblocked(px: np.ndarray, small: int, heights: np.ndarray | None = None) -> np.ndarray:
    """Post-filter of (y, x, channel) bytes: RGB, or one channel where all are the same.

    ``heights``: of the pictures of one width that stand below each other in ``px``; none touches another. By default there is one.
    """
    h, w = px.shape[:2]
    heights = np.array([h]) if heights is None else heights
    wide = (heights >= 2 * small) & (w >= 2 * small)
    if small <= 1 or not wide.any():
        return px
    if not wide.all():
        out, rows = px.copy(), np.repeat(wide, heights)
        out[rows] = deblocked(px[rows], small, heights[wide])
        return out
    # lines of the grid, none along a picture's edge, and the picture's first row and end for each of them
    n = (heights - 1) // small
    top = np.repeat(np.cumsum(heights) - heights, n)
    lines = top + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1) * small
    out = px.astype(np.int64)
    for v, at in ((out, np.arange(small, w, small)), (out.swapaxes(0, 1), lines)):
        a, b = v[:, at - 1], v[:, at]
        near = (np.abs(luma(a) - luma(b)) <= FLAT)[..., None]
        mean = (a + b) // 2
        v[:, at - 1], v[:, at] = np.where(near, mean, a), np.where(near, mean, b)
    return _junctions(out, small, lines, top, top + np.repeat(heights, n)).astype(np.uint8)


def _junctions(img: np.ndarray, small: int, lines: np.ndarray, top: np.ndarray, end: np.ndarray) -> np.ndarray:
    """lines: rows of the grid, of a picture from row ``top`` to before row ``end``."""
    h, w = img.shape[:2]
    light, out, radius = luma(img), img.copy(), min(small, RUN)
    across = np.arange(small, w, small)
    ys, xs = np.repeat(lines, len(across)), np.tile(across, len(lines))
    low, high = np.repeat(top, len(across)), np.repeat(end, len(across))
    c = np.stack([light[ys - 1, xs - 1], light[ys - 1, xs], light[ys, xs - 1], light[ys, xs]])
    soft = c.max(axis=0) - c.min(axis=0) <= JUNCTION_SPREAD
    ys, xs, low, high = ys[soft], xs[soft], low[soft], high[soft]

    def run(steps) -> np.ndarray:
        n, going = np.zeros(len(ys), dtype=np.int64), np.ones(len(ys), dtype=bool)
        for i in range(1, radius + 1):
            for (y, x), (cy, cx) in steps(i):
                inside = (y >= low) & (y < high) & (x >= 0) & (x < w)
                y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
                going = going & inside & (np.abs(light[y, x] - light[cy, cx]) <= SIMILAR)
            n += going
        return n

    left = run(lambda i: (((ys - 1, xs - i), (ys - 1, xs - 1)), ((ys, xs - i), (ys, xs - 1))))
    right = run(lambda i: (((ys - 1, xs - 1 + i), (ys - 1, xs)), ((ys, xs - 1 + i), (ys, xs))))
    up = run(lambda i: (((ys - i, xs - 1), (ys - 1, xs - 1)), ((ys - i, xs), (ys - 1, xs))))
    down = run(lambda i: (((ys - 1 + i, xs - 1), (ys, xs - 1)), ((ys - 1 + i, xs), (ys, xs))))
    # of overlapping rectangles the last point's in scan order stays; at one offset, points touch different pixels
    owner = np.full((h, w), -1, dtype=np.int32)
    number = np.arange(len(ys), dtype=np.int32)
    for dy in range(-radius, radius):
        for dx in range(-radius, radius):
            k = np.flatnonzero((-up <= dy) & (dy < down) & (-left <= dx) & (dx < right))
            py, px = ys[k] + dy, xs[k] + dx
            owner[py, px] = np.maximum(owner[py, px], number[k])
    py, px = np.nonzero(owner >= 0)
    k = owner[py, px]
    y, x = ys[k], xs[k]
    s = ((px - (x - left[k])) / (left[k] + right[k] - 1))[:, None]
    t = ((py - (y - up[k])) / (up[k] + down[k] - 1))[:, None]
    upper = np.floor(img[y - 1, x - 1] * (1 - s) + img[y - 1, x] * s + 0.5)
    bottom = np.floor(img[y, x - 1] * (1 - s) + img[y, x] * s + 0.5)
    out[py, px] = np.floor(upper * (1 - t) + bottom * t + 0.5)
    return out
