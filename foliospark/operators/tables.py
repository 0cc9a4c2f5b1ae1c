"""Tables: spans into cells, cells into grids, grids into Markdown and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.arrow import map_batches
from foliospark.functions.text import escape_html

ROW_LEAST, ROW_SHARE = 8.0, 0.45


def fill_cells(cells: DataFrame, spans: DataFrame) -> DataFrame:
    """Cells with the texts of the spans whose middle lies in them (edges included), in span
    order: a range join that meets page by page."""
    c = cells.select("page_id", "cell", F.struct("xmin", "ymin", "xmax", "ymax").alias("box"))
    s = spans.select("page_id", "ord", "text", ((F.col("xmin") + F.col("xmax")) / 2).alias("cx"), ((F.col("ymin") + F.col("ymax")) / 2).alias("cy"))
    inside = F.col("cx").between(F.col("box.xmin"), F.col("box.xmax")) & F.col("cy").between(F.col("box.ymin"), F.col("box.ymax"))
    hits = c.join(s, "page_id").where(inside).groupBy("page_id", "cell").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("t"))
    return cells.join(hits, ["page_id", "cell"], "left").withColumn("text", F.coalesce(F.array_join(F.transform("t", lambda x: x["text"]), " "), F.lit(""))).drop("t")


def grid_rows(boxes: list[tuple], tolerance: float) -> list[list[int]]:
    """Indices of boxes by row: a row takes what is nearer than ``tolerance`` to its first."""
    rows: list[list[int]] = []
    start = None
    for i in sorted(range(len(boxes)), key=lambda k: (boxes[k][1] + boxes[k][3], k)):
        y = (boxes[i][1] + boxes[i][3]) / 2
        if start is None or abs(y - start) >= tolerance:
            rows.append([])
            start = y
        rows[-1].append(i)
    return [sorted(r, key=lambda k: (boxes[k][0] + boxes[k][2], k)) for r in rows]


def grids(filled: DataFrame) -> DataFrame:
    """``page_id, grid``: the texts of each page's cells by row and column."""
    item = F.struct("cell", "xmin", "ymin", "xmax", "ymax", "text")
    per = filled.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("cells"))

    def make():
        def run(pages, all_cells):
            rows = []
            for p, cells in zip(pages, all_cells):
                boxes = [(c["xmin"], c["ymin"], c["xmax"], c["ymax"]) for c in cells]
                tolerance = max(ROW_LEAST, ROW_SHARE * sum(b[3] - b[1] for b in boxes) / len(boxes))
                rows.append((p, [[cells[i]["text"] for i in r] for r in grid_rows(boxes, tolerance)]))
            return rows

        return run

    return map_batches(per, make, "page_id bigint, grid array<array<string>>")


def to_markdown(grid: Column) -> Column:
    """Rows padded to the widest; the first row is the head."""
    wide = F.array_max(F.transform(grid, lambda r: F.size(r)))
    cell = lambda c: F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    padded = F.transform(grid, lambda r: line(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), wide - F.size(r)))))
    rule = line(F.array_repeat(F.lit("---"), wide))
    out = F.array_join(F.concat(F.slice(padded, 1, 1), F.array(rule), F.slice(padded, F.lit(2), F.greatest(F.size(padded) - 1, F.lit(0)))), "\n")
    return F.when((F.size(grid) > 0) & (F.size(F.get(grid, F.lit(0))) > 0), out).otherwise(F.lit(""))


def to_html(grid: Column) -> Column:
    """Head and body with escaped cells; rows aren't padded."""
    row = lambda r, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit(f"<{tag}>"), escape_html(F.coalesce(c, F.lit(""))), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    head = F.concat(F.lit("<thead>"), row(F.get(grid, F.lit(0)), "th"), F.lit("</thead>"))
    rest = F.transform(F.slice(grid, F.lit(2), F.greatest(F.size(grid) - 1, F.lit(0))), lambda r: row(r, "td"))
    body = F.when(F.size(rest) > 0, F.concat(F.lit("<tbody>"), F.array_join(rest, ""), F.lit("</tbody>"))).otherwise(F.lit(""))
    return F.when(F.size(grid) > 0, F.concat(F.lit("<table>"), head, body, F.lit("</table>"))).otherwise(F.lit(""))
