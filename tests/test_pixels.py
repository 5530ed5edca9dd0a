import math
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from granary.functions import pixels as P


def png(x):
    """An RGB picture as PNG bytes."""
    h, w, _ = x.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in x)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def plain_green(x):
    """Pixel by pixel, from red, green and blue; reciprocals rounded to 1/4096 as 8-bit pictures have them."""
    hits = 0
    for r, g, b in x.reshape(-1, 3).astype(int).tolist():
        v, low = max(r, g, b), min(r, g, b)
        d = v - low
        s = (d * round(255 * 4096 / v) + 2048) >> 12 if v else 0
        h = 0
        if d:
            turn = g - b if v == r else b - r + 2 * d if v == g else r - g + 4 * d
            h = (turn * round(30 * 4096 / d) + 2048) >> 12
            h += 180 if h < 0 else 0
        hits += 35 <= h <= 85 and s > 50 and v > 30
    return hits / (x.shape[0] * x.shape[1])


def plain_dhash(x):
    grey = [[(19595 * int(r) + 38470 * int(g) + 7471 * int(b) + 32768) >> 16 for r, g, b in row] for row in x]

    def shrink(line, new):
        old, out = len(line), []
        scale = max(1.0, old / new)
        for k in range(new):
            c = (k + 0.5) * old / new
            low, high = max(0, int(c - 3 * scale + 0.5)), min(old, int(c + 3 * scale + 0.5))
            sinc = lambda t: 1.0 if t == 0 else math.sin(math.pi * t) / (math.pi * t)
            w = [sinc((i + 0.5 - c) / scale) * sinc((i + 0.5 - c) / scale / 3) if abs((i + 0.5 - c) / scale) < 3 else 0.0 for i in range(low, high)]
            out.append(min(255, max(0, math.floor(sum(a * v for a, v in zip(w, line[low:high], strict=True)) / sum(w) + 0.5))))
        return out

    rows = [shrink(row, 9) for row in grey]
    cols = [shrink([row[c] for row in rows], 8) for c in range(9)]
    return int("".join("1" if cols[c + 1][r] > cols[c][r] else "0" for r in range(8) for c in range(8)), 2)


def test_pictures_from_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    smooth = np.stack([np.add.outer(np.arange(40) * a, np.arange(56) * b) % 256 for a, b in ((3, 2), (1, 4), (2, 1))], axis=2).astype(np.uint8)
    made = {"noise": rng.integers(0, 256, (37, 53, 3), dtype=np.uint8), "smooth": smooth, "green": np.full((20, 30, 3), (40, 160, 50), np.uint8), "black": np.zeros((9, 9, 3), np.uint8)}
    for name, x in made.items():
        (tmp_path / f"{name}.png").write_bytes(png(x))
    (tmp_path / "broken.png").write_bytes(b"no picture")
    rows = {r.img: r for r in P.curated(P.pictures(spark, str(tmp_path))).withColumn("hash", P.dhash()).collect()}
    assert set(rows) == {*made, "broken"} and rows["broken"].green is None and rows["broken"].hash is None and not rows["broken"].keep
    for name, x in made.items():
        assert rows[name].green == plain_green(x), name
        assert int(rows[name].hash) == plain_dhash(x), name
        assert rows[name].keep == (plain_green(x) >= 0.2)


def test_large_pictures_are_scaled_by_area():
    x = np.random.default_rng(2).integers(0, 256, (30, 44, 3)).astype(float)
    small = P.averaged(x, 10, 11)
    assert np.allclose(small, x.reshape(10, 3, 11, 4, 3).mean(axis=(1, 3)))
    odd = P.averaged(x, 7, 5)
    assert np.allclose(odd.mean(axis=(0, 1)), x.mean(axis=(0, 1)))
    wide = np.zeros((10, 1100, 3), np.uint8)
    wide[:, :550] = (40, 160, 50)[::-1]
    assert abs(P.green_share(wide) - 0.5) < 0.01


def test_odd_pictures(spark):
    rows = [(1, bytes([50, 160, 40]), 1, 1, 3), (2, None, 1, 1, 3), (3, b"ab", 1, 1, 3), (4, b"", 0, 0, 3), (5, bytes([7]), 1, 1, 1), (6, bytes([50, 160, 40, 0]), 1, 1, 4), (7, b"abc", None, 1, 3)]
    df = spark.createDataFrame(rows, "id int, data binary, height int, width int, channels int")
    got = {r.id: (r.g, r.h) for r in df.select("id", P.green_fraction().alias("g"), P.dhash().alias("h")).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 1.0, 2: None, 3: None, 4: None, 5: 0.0, 6: 1.0, 7: None}
    assert P.curated(df.limit(0)).count() == 0 and df.filter(F.col("id") == 1).select(P.dhash().alias("h")).first().h == 0
