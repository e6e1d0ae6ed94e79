"""Half-precision bit rules and decoded-image kernels."""

import struct
import zlib

import numpy as np

from framelake.functions import halfprec as hp
from framelake.functions import images as im


def test_half_bits_truncate_and_edges():
    x = np.array([1.0, -2.5, 65520.0, 1e-8, np.nan, np.inf, 1.0 + 2 ** -10, 1.0 + 2 ** -11, 1e6], dtype=np.float32)
    h = hp.to_half_bits_np(x)
    assert h[0] == 0x3C00 and h[1] == 0xC100
    assert h[2] == 0x7BFF                       # truncation, not rounding up to infinity
    assert h[3] == 0 and h[5] == 0x7C00 and (h[4] & 0x7C00) == 0x7C00 and (h[4] & 0x3FF)
    assert h[6] == 0x3C01 and h[7] == 0x3C00    # 1 + 2^-11 truncates to 1.0
    assert h[8] == 0x7C00                       # overflow -> infinity
    back = hp.from_half_bits_np(np.array([0x0001], dtype=np.uint16))
    assert back[0] == np.float32(2 ** -24)      # IEEE subnormal
    s, nb, nc = hp.sanitize_half_np(np.array([0x7C00, 0x5640, 0x3C00], dtype=np.uint16))  # inf, 100, 1
    assert nb == 1 and nc == 1 and list(s) == [0, hp.to_half_bits_np(np.array([50.0], np.float32))[0], 0x3C00]


def png_bytes(rgb: np.ndarray) -> bytes:
    h, w, _ = rgb.shape
    raw = b"".join(b"\x00" + rgb[y].tobytes() for y in range(h))

    def chunk(t, d):
        return struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d) & 0xFFFFFFFF)
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_source_and_preprocess(spark, tmp_path):
    vid = tmp_path / "clip7"
    vid.mkdir()
    for i in range(3):
        a = np.zeros((16, 16, 3), dtype=np.uint8)
        a[4:12, 4:12] = (255, 0, 0)            # red square (RGB)
        (vid / f"frame_{i}.png").write_bytes(png_bytes(a))
    (vid / "frame_9.png").write_bytes(b"not a png")
    f = im.read_frames(spark, str(tmp_path / "*" / "*.png"))
    rows = f.orderBy("frame_idx").collect()
    assert [r.frame_idx for r in rows] == [0, 1, 2] and rows[0].video_id == "clip7"
    arr = im.to_array(16, 16, 3, rows[0].image.data)
    assert tuple(arr[8, 8]) == (0, 0, 255)     # Spark gives BGR
    p = im.preprocess_images(f, 8, 8).collect()[0]
    assert p.out_height == 8 and p.content_ok and p.edge_density > 0


def test_canny_and_resize():
    g = np.zeros((20, 20))
    g[5:15, 5:15] = 200
    e = im.canny_edges(g)
    assert e.sum() > 0 and not e[10, 10] and not e[0, 0]
    a = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    assert im.resize_bilinear(a, 2, 2) is a
    assert im.resize_bilinear(a, 4, 4).shape == (4, 4, 3)
