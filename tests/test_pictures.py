"""Pixel kernels against a loop over pixels; histograms, numbering and batches against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoreel.functions import pixels as K
from chronoreel.operators import pictures as P
from chronoreel.plans import pictures as plans


def pixel(data, w, h, kind, i, j):
    """Red, green and blue at row j, column i."""
    if kind in ("RGB", "RGBA"):
        n = len(kind)
        return tuple(data[n * (j * w + i) + c] for c in range(3))
    if kind == "BGRA":
        return tuple(data[4 * (j * w + i) + 2 - c] for c in range(3))
    cw, ch = w // 2, h // 2
    ci, cj = min(i // 2, cw - 1), min(j // 2, ch - 1)
    y = data[j * w + i]
    if kind == "NV12":
        u, v = data[w * h + 2 * (cj * cw + ci)], data[w * h + 2 * (cj * cw + ci) + 1]
    else:
        u, v = data[w * h + cj * cw + ci], data[w * h + cw * ch + cj * cw + ci]
    u, v = u - 128, v - 128
    rgb = (298 * (y - 16) + 409 * v + 128) >> 8, (298 * (y - 16) - 100 * u - 208 * v + 128) >> 8, (298 * (y - 16) + 516 * u + 128) >> 8
    return tuple(min(255, max(0, c)) for c in rgb)


def loops(data, w, h, kind):
    return [[pixel(data, w, h, kind, i, j) for i in range(w)] for j in range(h)]


def shrunk(rows, width, height):
    h, w = len(rows), len(rows[0])
    out = []
    for j in range(height):
        line = []
        for i in range(width):
            js = range(j * h // height, max(j * h // height + 1, (j + 1) * h // height))
            cs = range(i * w // width, max(i * w // width + 1, (i + 1) * w // width))
            all_ = [rows[y][x] for y in js for x in cs]
            line.append(tuple((2 * sum(p[c] for p in all_) + len(all_)) // (2 * len(all_)) for c in range(3)))
        out.append(line)
    return out


def as_list(p):
    return [[tuple(x) for x in line] for line in p.tolist()]


@pytest.mark.parametrize("kind", ["RGB", "RGBA", "BGRA", "YUV420P", "NV12"])
def test_kernels(kind):
    r = random.Random(kind)
    for w, h in [(2, 2), (3, 5), (8, 6), (17, 9), (40, 31)]:
        data = bytes(r.choice((0, 255, r.randrange(256))) for _ in range(4 * w * h + 3))
        p = K.picture(data, w, h, kind)
        want = loops(data, w, h, kind)
        assert as_list(p) == want
        for width, height in [(1, 1), (w, h), (2 * w + 1, 3), (5, 2 * h)]:
            assert as_list(K.mean_scaled(p, width, height)) == shrunk(want, width, height)
            assert as_list(K.nearest(p, width, height)) == [[want[j * h // height][i * w // width] for i in range(width)] for j in range(height)]
        counts = [0] * 48
        for line in K.nearest(p, 64, 64).tolist():
            for x in line:
                for c in range(3):
                    counts[16 * c + x[c] // 16] += 1
        assert (K.histogram(p) * 4096).tolist() == counts
        cut = K.cropped(p, 0.25, -0.2, 0.5, 0.9)
        left, top, right, bottom = int(0.25 * w), int(-0.2 * h), int(0.25 * w) + int(0.5 * w), int(-0.2 * h) + int(0.9 * h)
        part = [line[left:right] for line in want[max(0, top) : bottom]]
        assert (cut is None and not (part and part[0])) or as_list(cut) == part


def test_no_pictures():
    full = bytes(100)
    for bad in [(None, 2, 2, "RGB"), (b"", 1, 1, "RGB"), (full, 0, 2, "RGB"), (full, -1, 2, "RGB"), (full, None, 2, "RGB"), (full, 2, 2, None), (full, 2, 2, "JPEG"), (full, 1, 9, "NV12"), (full, 9, 1, "YUV420P"), (bytes(11), 2, 2, "RGB")]:
        assert K.picture(*bad) is None, bad[1:]
    assert K.fitted(1000, 1, 10, 10) == (10, 1) and K.fitted(4, 3, 8, 8) == (8, 6) and K.fitted(3, 4, 8, 8) == (6, 8)
    p = K.picture(bytes(12), 2, 2, "RGB")
    assert K.scaled_to_fit(p, 0, 5) is p and K.cropped(p, 0.9, 0, 0.05, 1) is None


def test_differences(spark):
    red, blue = b"\xff\x00\x00" * 4, b"\x00\x00\xff" * 4
    rows = [(1, red, 2, 2, "RGB"), (2, red, 2, 2, "RGB"), (3, blue, 2, 2, "RGB"), (4, None, 2, 2, "RGB")]
    h = P.histograms(spark.createDataFrame(rows, "id int, pixels binary, width int, height int, format string").withColumn("Histogram", F.lit("clash")))
    assert h.columns == ["id", "histogram"]
    by = {r.id: r.histogram for r in h.collect()}
    assert by[4] is None and by[1] == by[2] != by[3]
    met = h.alias("a").crossJoin(h.alias("b")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), P.difference(F.col("a.histogram"), F.col("b.histogram")).alias("d"))
    d = {(r.a, r.b): r.d for r in met.collect()}
    # of three channels' sums: alike pictures are at 0, and so are those that share one channel; no picture is at 1
    assert d[1, 2] == 0 and d[1, 3] == 0 and d[1, 4] == d[4, 4] == 1


def test_numbers_without_a_task_a_video(spark):
    rows = [(None if v == 3 else v, i) for v, n in ((1, 700), (2, 5), (3, 40), (4, 1)) for i in range(n)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        df = spark.createDataFrame(rows, "video_id int, frame_id long").repartition(5)
        got = P.numbered(df, "video_id", "frame_id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows) and all(r.position == r.frame_id for r in got)


def test_batches(spark):
    """Windows over a hot video, its rest and a video of one frame, with what is no picture as black."""
    r = random.Random(2)
    rows = [(1, i, bytes(r.randrange(256) for _ in range(3 * 30)), 5, 6, "RGB") for i in range(23)] + [(2, 0, bytes(90), 5, 6, "RGB"), (1, 50, None, 1, 1, "RGB")]
    df = spark.createDataFrame(rows, "video_id int, frame_id long, pixels binary, width int, height int, format string").repartition(4)
    seen = []

    def model(tensor):
        assert tensor.shape == (1, 10, 27, 48, 3) and tensor.dtype == np.float32
        seen.append(1)
        return tensor.sum(axis=(2, 3, 4)) + np.arange(10)

    got = {(x.video_id, x.frame_id): (x.window, x.place, x.n_padded, x.probability) for x in P.batch_probabilities(df, model, window=10).collect()}
    assert len(got) == 25
    for n, (video, frame, data, w, h, kind) in enumerate(sorted(rows, key=lambda x: x[:2])):
        place = n if video == 1 else 0
        total = sum(sum(x) for line in shrunk(loops(data, w, h, kind), 48, 27) for x in line) if data else 0
        assert got[video, frame][:3] == (place // 10, place % 10, {0: 0, 1: 0, 2: 6}[place // 10] if video == 1 else 9)
        assert math.isclose(got[video, frame][3], total + place % 10, rel_tol=1e-6)


def test_regions_of_pages(spark, sf_dir):
    got = {r.frame_id: r for r in plans.picture_regions(spark, sf_dir).collect()}
    x, y, wide, high = plans.BOX
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        data = (page.html or "").encode()
        n = len(data) // 3
        w = max(1, math.isqrt(n))
        h, kind = n // w, ("YUV420P", "NV12", "BGRA", "RGB")[page.page_id % 4]
        h = h * 3 // 4 if kind == "BGRA" else h
        rows = [line[int(x * w) : int(x * w) + int(wide * w)] for line in loops(data, w, h, kind)[int(y * h) : int(y * h) + int(high * h)]]
        width, height = K.fitted(len(rows[0]), len(rows), *plans.FIT)
        flat = bytes(c for line in shrunk(rows, width, height) for p in line for c in p)
        r = got[page.page_id]
        assert (r.width, r.height, r.pixels_md5) == (width, height, hashlib.md5(flat).hexdigest())


def test_probabilities_of_pages(spark, sf_dir):
    got = {(r.video_id, r.frame_id): r.probability for r in plans.frame_probabilities(spark, sf_dir).collect()}
    videos = {}
    for page in sorted(spark.read.parquet(f"{sf_dir}/pages.parquet").collect(), key=lambda p: p.page_id):
        data = (page.html or "").encode()
        w = max(1, math.isqrt(len(data) // 3))
        videos.setdefault(page.page_id % plans.VIDEOS, []).append((page.page_id, shrunk(loops(data, w, len(data) // 3 // w, "RGB"), 48, 27)))
    for video, frames in videos.items():
        for i, (page, rows) in enumerate(frames):
            after = frames[i + 1][1] if i + 1 < len(frames) and (i + 1) % 100 else None
            total = sum(abs(a - (b if after else 0)) for y in range(27) for z in range(48) for a, b in zip(rows[y][z], after[y][z] if after else (0, 0, 0), strict=True))
            want = 0.0 if i % 100 == 99 else total / (27 * 48 * 3) / 255
            assert math.isclose(got[video, page], want, abs_tol=2e-6)
