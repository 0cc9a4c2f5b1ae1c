"""Page images in number: what the queries of pages need to end in time."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from foliospark.operators import images


def _dealt(spark, tmp_path, name, n=400):
    """The query over one file of parts: the same rows as by SQL, and the tasks that made them."""
    import duckdb

    spark.range(n).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    df = entry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(entry.oracle_sql()[name]).fetchall())
    return sum(r.n > 0 for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())


def _seconds(f, *args):
    at = time.perf_counter()
    f(*args)
    return time.perf_counter() - at


def test_crops_are_dealt_to_all_cores(spark, tmp_path):
    assert _dealt(spark, tmp_path, "image_crops") >= 4


def test_large_boxes_and_crops_in_time():
    page = np.full((1500, 1500), 255, dtype=np.uint8)
    page[100:1400, 100:1400] = 0
    boxes = []
    assert _seconds(lambda: boxes.extend(images.text_boxes((page == 0).astype(float), 1500, 1500))) < 1.5
    assert len(boxes) == 1 and boxes[0][1] > 0.99
    # a small crop of a large page costs what it is wide and high
    large = np.full((6000, 6000), 7, dtype=np.uint8)
    assert images.crop(large, [(10, 20), (50, 20), (50, 40), (10, 40)]).tolist() == [[7] * 40] * 20
    assert min(_seconds(images.crop, large, [(10, 20), (50, 20), (50, 40), (10, 40)]) for _ in range(3)) < 0.05


def test_samples_beyond_the_page():
    page = np.array([[10, 20], [30, 40]], dtype=np.uint8)
    y, x = np.array([0.5, -0.5, 1.0, 5.0, -1.0]), np.array([0.5, 0.0, 1.5, 0.0, 0.0])
    assert images.sample(page, y, x, 0.0).tolist() == [25.0, 5.0, 20.0, 0.0, 0.0]
    assert images.sample(page, y[3:], x[3:], 9.0).tolist() == [9.0, 9.0]


def test_pages_that_cannot_be_drawn_give_errors(spark):
    def draw(i):
        return np.zeros((4, 4), dtype=np.uint8) if i else 1 / 0

    rows = images.over_pages(spark.range(2).withColumnRenamed("id", "page_id"), lambda p: (p.size,), "size int", draw=draw).orderBy("page_id").collect()
    assert rows[0].size is None and "ZeroDivision" in rows[0].error and rows[1].size == 16 and rows[1].error is None


def test_components_joined_late():
    # a spiral and a comb: runs that only meet at the end
    comb = np.zeros((41, 81), dtype=bool)
    comb[:, ::2] = True
    comb[-1] = True
    labels, boxes = images.components(comb)
    assert boxes.tolist() == [[0, 0, 41, 81, int(comb.sum())]] and (labels == comb).all()
    comb[-1, 1::2] = False
    assert len(images.components(comb)[1]) == pytest.approx(41)
    assert images.components(np.zeros((3, 0), dtype=bool))[1].shape == (0, 5)


def test_cells_are_dealt_to_all_cores(spark, tmp_path):
    assert _dealt(spark, tmp_path, "image_cells") >= 4


def test_cells_among_short_runs():
    # a table among marks: half a million runs, none of them a rule
    page = np.full((2000, 2000), 255, dtype=np.uint8)
    page[:, ::4] = 0
    page[::2] = 255
    page[500:1502] = page[:, 500:1502] = 255
    for k in range(3):
        page[500 + 500 * k : 502 + 500 * k, 500:1502] = page[500:1502, 500 + 500 * k : 502 + 500 * k] = 0
    assert images.table_cells(page) == [(502, 502, 1000, 1000), (1002, 502, 1500, 1000), (502, 1002, 1000, 1500), (1002, 1002, 1500, 1500)]


def test_thresholds_of_few_values():
    assert images.threshold(np.array([[9, 200], [200, 200]], dtype=np.uint8)) == 9
    assert images.threshold(np.full((3, 3), 77, dtype=np.uint8)) == images.PAPER == images.threshold(np.zeros((0, 3), dtype=np.uint8))
    assert images.threshold(np.array([[0, 10, 250, 255]], dtype=np.uint8)) == 10


def test_signals_are_dealt_to_all_cores(spark, tmp_path):
    assert _dealt(spark, tmp_path, "image_signals") >= 4


def test_skew_is_that_of_exact_variances():
    # equal variances fall to the smaller angle, whatever floats say of them
    from fractions import Fraction

    def shear(ink, tenths):
        y, x = np.nonzero(ink)
        at = np.round(y + (x - ink.shape[1] / 2) * np.tan(np.radians(tenths / 10))).astype(int)
        c = np.bincount(at - at.min())
        return Fraction(int(len(c) * (c * c).sum() - c.sum() ** 2), len(c) ** 2), -abs(tenths)

    rng, pages = np.random.default_rng(5), []
    for k in range(60):
        h, w = rng.integers(2, 140, 2)
        y, x = np.mgrid[:h, :w]
        ink = rng.random((h, w)) < rng.random() if k % 3 else (y + np.rint(x * np.tan(k / 400))).astype(int) % 9 < 4
        if 1 < ink.sum() < ink.size:
            pages.append(ink)
    for ink in pages:
        near = max(range(-60, 61, 10), key=lambda a: shear(ink, a))  # noqa: B023
        assert images.skew(np.where(ink, 20, 230).astype(np.uint8)) == max(range(near - 10, near + 11), key=lambda a: shear(ink, a)) / 10  # noqa: B023
    tie = np.full((20, 4), 255, dtype=np.uint8)
    tie[5:9] = 0  # four columns don't part below 7 degrees
    assert images.skew(tie) == 0.0


def test_signals_of_a_large_page():
    page = np.full((1500, 1100), 255, dtype=np.uint8)
    for y in range(60, 1440, 24):
        for x in range(60, 1040, 14):
            page[y : y + 10, x : x + 8] = 0
    turned = images.deskew(page, -2.5)
    for p in (page, turned):
        assert images.page_signals(p) == (images.noise_sigma(p), images.skew(p), images.glyph_height(p))
    assert images.page_signals(page)[1:] == (0.0, 10.0) and abs(images.skew(turned) - 2.5) <= 0.1
