"""Page layout: validated spans, facing pages, columns, lines, blocks and reading order.

All windows partition by page (or finer), so the whole chain plans one exchange. Only the
clustering of spans into lines depends on what went before and is folded, page by page,
over an array. Spans have ``page_id, ord, text, xmin, ymin, xmax, ymax, confidence`` and
their page's ``width, height, glyph``. Null text and boxes without area are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.arrow import map_batches
from foliospark.functions.chars import strip

#: Proportions of the layout rules (fixed values).
SPREAD, GUTTER_FROM, GUTTER_TO, GUTTER_GAP = 1.1, 0.40, 0.60, 1.5
COLUMN_LEAST, COLUMN_GAP = 35.0, 1.8
LINE_LEAST, LINE_GAP = 8.0, 0.45
BLOCK_LEAST, BLOCK_GAP = 25.0, 2.2
LOW_CONFIDENCE = 0.85


def spans_from(details: DataFrame) -> DataFrame:
    """Detections with ``bbox`` (four numbers) or ``poly`` (four points) as valid spans."""
    of = lambda k, f: F.when(F.size("poly") == 4, f(F.transform("poly", lambda p: p[k]))).when(F.size("bbox") == 4, F.lit(None))
    box = details.withColumn("text", strip(F.col("text")))
    for k, (lo, hi) in enumerate((("xmin", "xmax"), ("ymin", "ymax"))):
        box = box.withColumn(lo, F.coalesce(of(k, F.array_min), F.get("bbox", F.lit(k)))).withColumn(hi, F.coalesce(of(k, F.array_max), F.get("bbox", F.lit(k + 2))))
    return valid_spans(box.drop("bbox", "poly"))


def valid_spans(spans: DataFrame) -> DataFrame:
    return spans.where("text is not null and text <> '' and xmax > xmin and ymax > ymin")


def facing_pages(spans: DataFrame) -> DataFrame:
    """Adds ``side``: 0, or 1 for the right page of a spread. The gutter is the widest gap
    among the spans that reach into the middle, else the middle; an empty side is none."""
    page = Window.partitionBy("page_id")
    mid = (F.col("xmin") < GUTTER_TO * F.col("width")) & (F.col("xmax") > GUTTER_FROM * F.col("width"))
    order = Window.partitionBy("page_id", "_mid").orderBy("xmin", "ord")
    # by page once, which serves every window of the chain
    s = spans.repartition("page_id").withColumn("_mid", mid)
    s = s.withColumn("_next", F.lead("xmin").over(order)).withColumn("_rn", F.row_number().over(order))
    gap = F.when(F.col("_mid") & (F.col("_next") > F.col("xmax")), F.struct((F.col("_next") - F.col("xmax")).alias("gap"), (-F.col("_rn")).alias("first"), ((F.col("_next") + F.col("xmax")) / 2).alias("at")))
    best = F.max(gap).over(page)
    s = s.withColumn("_best", best)
    at = F.when(F.col("_best.gap") > GUTTER_GAP * F.col("glyph"), F.col("_best.at")).otherwise(F.col("width") / 2)
    s = s.withColumn("_side", F.when((F.col("width") > SPREAD * F.col("height")) & ((F.col("xmin") + F.col("xmax")) / 2 >= at), 1).otherwise(0))
    s = s.withColumn("side", F.col("_side") - F.min("_side").over(page))
    return s.drop("_mid", "_next", "_rn", "_best", "_side")


def columns(spans: DataFrame) -> DataFrame:
    """Adds ``col``: a new column begins where the gap to everything left of it is wide."""
    w = Window.partitionBy("page_id", "side").orderBy("xmin", "ord")
    reach = F.max("xmax").over(w.rowsBetween(Window.unboundedPreceding, -1))
    wide = F.greatest(F.lit(COLUMN_LEAST), COLUMN_GAP * F.col("glyph"))
    flagged = spans.withColumn("_new", F.when(F.col("xmin") - reach >= wide, 1).otherwise(0))
    return flagged.withColumn("col", F.sum("_new").over(w).cast("int")).drop("_new")


def cluster_lines(boxes: list[tuple], tolerance: float) -> list[list[int]]:
    """Indices of boxes ``(xmin, ymin, xmax, ymax)`` by line: each joins the first line whose
    box, grown so far, has its middle within ``tolerance``; lines and boxes then in order."""
    lines: list[list] = []  # [ymin, ymax, members]
    for i in sorted(range(len(boxes)), key=lambda k: (boxes[k][1], boxes[k][0])):
        x0, y0, x1, y1 = boxes[i]
        home = next((ln for ln in lines if abs((y0 + y1) / 2 - (ln[0] + ln[1]) / 2) <= tolerance), None)
        if home is None:
            lines.append([y0, y1, [i]])
        else:
            home[0], home[1] = min(home[0], y0), max(home[1], y1)
            home[2].append(i)
    lines.sort(key=lambda ln: ln[0])
    return [sorted(ln[2], key=lambda k: boxes[k][0]) for ln in lines]


def lines(spans: DataFrame) -> DataFrame:
    """Spans of each page, side and column as lines: one row a line, in order."""
    numbers = [F.col(c).cast("double").alias(c) for c in ("xmin", "ymin", "xmax", "ymax", "confidence")]
    item = F.struct("ord", "text", *numbers)
    per = spans.groupBy("page_id", "side", "col").agg(F.array_sort(F.collect_list(item)).alias("spans"), F.first("glyph").cast("double").alias("glyph"))

    def make():
        def run(pages, sides, cols, all_spans, glyphs):
            rows = []
            for p, s, c, own, g in zip(pages, sides, cols, all_spans, glyphs):
                boxes = [(x["xmin"], x["ymin"], x["xmax"], x["ymax"]) for x in own]
                for k, members in enumerate(cluster_lines(boxes, max(LINE_LEAST, LINE_GAP * g))):
                    part = [own[i] for i in members]
                    chars = sum(len(x["text"]) for x in part)
                    conf = sum(x["confidence"] * len(x["text"]) for x in part) / chars if chars else 1.0
                    b = [boxes[i] for i in members]
                    rows.append((p, s, c, k, " ".join(x["text"] for x in part), min(x[0] for x in b), min(x[1] for x in b), max(x[2] for x in b), max(x[3] for x in b), conf, g))
            return rows

        return run

    return map_batches(per, make, "page_id bigint, side int, col int, line int, text string, xmin double, ymin double, xmax double, ymax double, confidence double, glyph double")


def blocks(line_rows: DataFrame) -> DataFrame:
    """Adds ``block``: a new block begins below a gap to the line before."""
    w = Window.partitionBy("page_id", "side", "col").orderBy("line")
    gap = F.col("ymin") - F.lag("ymax").over(w)
    flagged = line_rows.withColumn("_new", F.when(gap > F.greatest(F.lit(BLOCK_LEAST), BLOCK_GAP * F.col("glyph")), 1).otherwise(0))
    return flagged.withColumn("block", F.sum("_new").over(w).cast("int")).drop("_new")


def document_blocks(blocked: DataFrame) -> DataFrame:
    """One row a block, with text, box, mean confidence of its lines and place in reading order."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"])
    b = blocked.groupBy("page_id", "side", "col", "block").agg(
        F.array_join(texts, "\n").alias("text"), F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), F.avg("confidence").alias("confidence")
    )
    w = Window.partitionBy("page_id").orderBy("side", "col", "block")
    return b.withColumn("reading_order", F.row_number().over(w) - 1).withColumn("low_confidence", F.col("confidence") < LOW_CONFIDENCE)


def read_page(spans: DataFrame) -> DataFrame:
    """The whole chain from spans to blocks in reading order."""
    return document_blocks(blocks(lines(columns(facing_pages(valid_spans(spans))))))


# ---- boxes ----


def intersects(a: str, b: str) -> Column:
    """Whether two box structs touch or overlap."""
    c = F.col
    return (c(f"{a}.xmin") <= c(f"{b}.xmax")) & (c(f"{b}.xmin") <= c(f"{a}.xmax")) & (c(f"{a}.ymin") <= c(f"{b}.ymax")) & (c(f"{b}.ymin") <= c(f"{a}.ymax"))


def union(a: str, b: str) -> Column:
    c = F.col
    return F.struct(*[f(c(f"{a}.{k}"), c(f"{b}.{k}")).alias(k) for k, f in (("xmin", F.least), ("ymin", F.least), ("xmax", F.greatest), ("ymax", F.greatest))])


def char_weighted(confidence: Column, text: Column, empty: float) -> Column:
    """Mean confidence by characters; the plain mean where there are none, else ``empty``."""
    n = F.length(text)
    return F.coalesce(F.sum(confidence * n) / F.nullif(F.sum(n), F.lit(0)), F.avg(confidence), F.lit(empty))


# ---- tensors as arrays ----


def resize(height: Column, width: Column, limit: int = 960, kind: str = "max") -> tuple[Column, Column]:
    """Sides scaled to a limit and to multiples of 32, at least 32."""
    side = F.greatest(height, width) if kind == "max" else F.least(height, width)
    far = side > limit if kind == "max" else side < limit
    ratio = F.when(far, F.lit(float(limit)) / side).otherwise(F.lit(1.0))
    return tuple(F.greatest(F.lit(32), F.rint(x * ratio / 32.0).cast("int") * 32) for x in (height, width))  # type: ignore[return-value]


def ctc_decode(ids: Column, probs: Column, alphabet: list[str], blank: int = 0) -> tuple[Column, Column]:
    """Greedy decoding: repeats collapse, blanks go, the rest's mean probability stays."""
    steps = F.transform(ids, lambda x, i: F.struct(x.alias("id"), F.get(probs, i).alias("p"), F.when(i > 0, F.get(ids, i - 1)).alias("before")))
    kept = F.filter(steps, lambda s: (s["id"] != blank) & ~s["id"].eqNullSafe(s["before"]))
    letters = F.array(*map(F.lit, alphabet))
    text = F.array_join(F.transform(kept, lambda s: F.coalesce(F.get(letters, s["id"]), F.lit(""))), "")
    mean = F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, s: a + s["p"]) / F.size(kept)).otherwise(F.lit(0.0))
    return F.trim(text), mean
