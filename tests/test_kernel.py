"""The Arrow kernel against FIXTURES.md and the format's laws."""

import hashlib
import re
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions.presets import preset
from tessera.plans import codec
from tessera.plans import kernel as K


def picture(name: str, w: int, h: int) -> np.ndarray:
    x, y = np.meshgrid(np.arange(w), np.arange(h))
    if name == "synthetic":
        return np.stack([(17 * x ^ 31 * y) & 255, (43 * x + 13 * y) & 255, (7 * x ^ 11 * y) & 255], -1)
    return np.stack([(2 * x + y) & 255, (x + 2 * y) & 255, (x + y) & 255], -1)


ROWS = re.findall(r"\| (synthetic|smooth) \| (\d+)x(\d+) \| (\d+) \|[^|]*\|[^|]*\| (\d+) \| (\w+) \| (\w+) \| (\w+) \|", (Path(__file__).parents[1] / "FIXTURES.md").read_text())


def md5(b: bytes) -> str:
    return hashlib.md5(b).hexdigest()[:12]


@pytest.mark.parametrize("row", ROWS, ids=lambda r: "-".join(r[:4]))
def test_fixture(row):
    name, w, h, q, size, payload, rgb, filtered = row
    p = K.encode(K.planes(picture(name, int(w), int(h))), int(q))
    assert (len(p), md5(p), md5(K.decode(p).tobytes()), md5(K.decode(p, True).tobytes())) == (int(size), payload, rgb, filtered)


def test_grayscale_fixture():
    p = K.encode(K.planes(picture("synthetic", 64, 48), bw=True), 70)
    out = K.decode(p)
    assert (len(p), md5(p), md5(out.tobytes())) == (3540, "8734654d23e8", "00294faf8b2e")
    assert (out[..., 0] == out[..., 1]).all() and (out[..., 1] == out[..., 2]).all()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.integers(0, 100), st.integers(0, 2**32 - 1))
def test_laws(w, h, q, seed):
    img = np.random.default_rng(seed).integers(0, 256, (h, w, 3))
    small, macro, spread = preset(q)
    if w < small or h < small:
        with pytest.raises(K.CodecError):
            K.encode(K.planes(img), q)
        return
    planes = K.planes(img)
    p = K.encode(planes, q)
    head, chans = K.split(p)
    assert len(p) == 18 + sum(24 + sum(len(s[n]) for n in ("size", "type", "pattern", "fg", "bg")) for s in chans.values())
    out = K.decode(p)
    assert out.shape == img.shape
    w4, h4, fw, fh = K.layout(w, h, small, macro)
    assert not out[h4:].any() and not out[:, w4:].any()
    if small == 1:
        y = K.decode_plane(chans[0], head, 0)
        assert (y[:, fw:w4] == planes[0][:, fw:w4]).all() and (y[fh:] == planes[0][fh:]).all()
        assert (K.decode(p, True) == out).all()


@given(st.binary(max_size=300))
def test_delta_roundtrip(b):
    v = np.frombuffer(b, dtype=np.uint8).astype(np.int64)
    assert (K.undelta(K.deltas(v)) == v).all()


GOOD = K.encode(K.planes(picture("synthetic", 16, 12)), 40)


@pytest.mark.parametrize(
    ("payload", "message"),
    [
        (b"BA", "too short"), (b"XXXXX" + GOOD[5:], "bad magic"), (GOOD[:12], "truncated header"), (GOOD[:5] + b"\0\0" + GOOD[7:], "zero block size"), (GOOD[:9] + b"\6" + GOOD[10:], "no luma"),
        (GOOD[:5] + b"\0\3\0\4" + GOOD[9:], "multiple"), (GOOD[:5] + b"\0\2\0\x10" + GOOD[9:], "macro too large"), (GOOD[:-3], "truncated segment"), (GOOD[:10] + b"\0\0\0\0" + GOOD[14:], "empty"),
        (GOOD[:10] + b"\xff\xff\xff\xff" + GOOD[14:], "too large"), (GOOD[:18] + b"\0\0\0\1" + GOOD[22:], "second levels|mismatch"), (GOOD[:10] + b"\0\0\0\x40" + GOOD[14:], "short|mismatch"),
    ],
)
def test_corrupt(payload, message):
    with pytest.raises(K.CodecError, match=message):
        K.decode(payload)


def test_trailing_bytes_and_frames():
    assert (K.decode(GOOD + b"more") == K.decode(GOOD)).all()
    assert codec.decompress(codec.compress(b"ab") + codec.compress(b"cd")) == b"abcd"
    with pytest.raises(K.CodecError):
        codec.decompress(b"")


def test_strips_give_the_same_payload(monkeypatch):
    """Wherever a plane is cut, its streams go on: bits cross bytes, and strips end between and inside rows of blocks."""
    rng = np.random.default_rng(2)
    for w, h in ((1, 1), (4, 4), (9, 5), (33, 50), (70, 8), (8, 61)):
        img = (rng.integers(0, 80, (h, w, 3)) + np.arange(w)[None, :, None]).astype(np.uint8)
        wide = np.concatenate([rng.integers(0, 65536, (h, w, 4))]).astype(">u2").tobytes()
        for q in range(0, 101, 10):
            if min(w, h) < preset(q)[0]:
                continue
            monkeypatch.setattr(K, "STRIP", 1 << 18)
            want = K.encode(K.planes(img), q), K.encode(codec.planes_of(wide, w, h, "rgba16", False), q)
            for strip in (1, 50, 300):
                monkeypatch.setattr(K, "STRIP", strip)
                assert (K.encode(K.planes(img), q), K.encode(codec.planes_of(wide, w, h, "rgba16", False), q)) == want


@pytest.mark.parametrize("q", [20, 40, 60, 80])
def test_memory_of_a_long_image(q):
    """Beside its data, an image costs its planes and two copies of its streams."""
    import tracemalloc

    n = 2_000_000
    data = np.random.default_rng(0).integers(0, 256, 3 * n, dtype=np.uint8).tobytes()
    K.encode(K.planes(np.zeros((8, 8, 3), dtype=np.uint8)), q)
    tracemalloc.start()
    p = K.encode(codec.planes_of(data, 100, n // 100, "rgb", False), q)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3 * n + 2 * len(p) + (12 << 20)
