"""Page images made from the parts' numbers by the executors: what the operators find on them is
known, so SQL can say it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from foliospark.arrow import map_batches
from foliospark.operators import images
from foliospark.session import table

from .registry import query


def _pages(spark, sf_dir, draw):
    """``page_id, height, width, pixels`` of every part."""
    made = lambda i: (a := draw(i), *a.shape)
    return map_batches(
        table(spark, sf_dir, "part").select("p_partkey"),
        lambda: lambda ids: [(i, h, w, a.tobytes()) for i in ids for a, h, w in [made(i)]],
        "page_id bigint, height int, width int, pixels binary",
    )


def _parts(spark, sf_dir):
    """``page_id`` of every part, to draw pages from. The numbers, a few bytes a page, are dealt to
    all cores: a file of parts may be one partition, and pages take long."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id")).repartition(tasks)


def _ruled(i: int) -> np.ndarray:
    rows, cols = 2 + i % 3, 2 + i % 4
    p = np.full((40 + rows * 40, 40 + cols * 50), 255, dtype=np.uint8)
    for k in range(rows + 1):
        p[20 + k * 40 : 22 + k * 40, 20 : 22 + cols * 50] = 0
    for k in range(cols + 1):
        p[20 : 22 + rows * 40, 20 + k * 50 : 22 + k * 50] = 0
    return p


@query("""SELECT p_partkey AS page_id, ((2 + p_partkey % 3) * (2 + p_partkey % 4))::INT AS cells, 22.0::DOUBLE AS left_edge, (20 + 50 * (2 + p_partkey % 4))::DOUBLE AS right_edge, (20 + 40 * (2 + p_partkey % 3))::DOUBLE AS lower_edge FROM part""")
def image_cells(spark, sf_dir):
    """Cells of ruled tables."""
    c = images.cells(_parts(spark, sf_dir), _ruled)
    edge = lambda f, k: f(F.transform("cells", lambda x: x[k]))
    return c.select("page_id", F.size("cells").alias("cells"), edge(F.array_min, "xmin").alias("left_edge"), edge(F.array_max, "xmax").alias("right_edge"), edge(F.array_max, "ymax").alias("lower_edge"))


@query("""SELECT p_partkey AS page_id, round(((p_partkey % 256) / 255.0::DOUBLE - 0.485) / 0.229, 3) AS red, round(((p_partkey % 256) / 255.0::DOUBLE - 0.406) / 0.225, 3) AS blue,
    (32 * ceil((10 + p_partkey % 50) / 32.0))::INT AS height, 64 AS width FROM part""")
def image_tensors(spark, sf_dir):
    """Normalised pages, in a batch with one that is 40 wide and as high as the page."""

    def tensor(page):
        x = images.normalised(page)
        batch, _ = images.padded([x, images.normalised(np.zeros((page.shape[0], 40), dtype=np.uint8))])
        return round(float(x[0, 0, 0]), 3), round(float(x[2, -1, -1]), 3), batch.shape[2], batch.shape[3]

    pages = _pages(spark, sf_dir, lambda i: np.full((10 + i % 50, 30), i % 256, dtype=np.uint8))
    return images.over_pages(pages, tensor, "red double, blue double, height int, width int").drop("error")


@query("""SELECT p_partkey AS page_id, 1 AS boxes, CASE WHEN h / w::DOUBLE >= 1.5 THEN w ELSE h END::INT AS height, CASE WHEN h / w::DOUBLE >= 1.5 THEN h ELSE w END::INT AS width FROM (
    SELECT p_partkey, (20 + p_partkey % 40)::INT AS h, (30 + p_partkey % 7)::INT AS w FROM part)""")
def image_crops(spark, sf_dir):
    """A dark block on paper: found in the map of its ink, and cut out upright."""

    def block(i):
        p = np.full((120, 120), 255, dtype=np.uint8)
        p[20 : 40 + i % 40, 30 : 60 + i % 7] = 0
        return p

    def found(page):
        ink = page == 0
        boxes = images.text_boxes(ink.astype(np.float64), *page.shape)
        y, x = np.flatnonzero(ink.any(axis=1)), np.flatnonzero(ink.any(axis=0))
        t, le, b, r = y[0], x[0], y[-1] + 1, x[-1] + 1
        cut = images.crop(page, np.array([(le, t), (r, t), (r, b), (le, b)]))
        return len(boxes), *cut.shape

    return images.over_pages(_parts(spark, sf_dir), found, "boxes int, height int, width int", draw=block).drop("error")


@query("SELECT p_partkey AS page_id, 0.0::DOUBLE AS skew, CASE WHEN p_partkey % 2 = 0 THEN (6 + p_partkey % 7)::DOUBLE END AS glyph_height FROM part")
def image_signals(spark, sf_dir):
    """Signals of pages of level lines of marks, every other one with too few marks to measure."""

    def marks(i):
        p, size = np.full((120, 200), 255, dtype=np.uint8), 6 + i % 7
        for y in range(10, 100, 22):
            for x in range(10, 190, 14) if i % 2 == 0 else (10, 94, 178):
                p[y : y + size, x : x + 7] = 0
        return p

    return images.signals(_parts(spark, sf_dir), marks).select("page_id", "skew", "glyph_height")
