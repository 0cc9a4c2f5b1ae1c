"""Sinks: documents, pages, layouts and ledgers out of DataFrames, written by the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.chars import strip
from foliospark.functions.text import csv_guard, escape_html, front_matter, reflow, without_images, xml_safe


def markdown(text: Column, metadata: Column) -> Column:
    """Front matter and text, cleaned for readers of XML."""
    return F.concat(front_matter(metadata), F.lit("\n"), xml_safe(text))


def plain(text: Column) -> Column:
    return without_images(xml_safe(text))


def xhtml(pages: DataFrame, title: str = "title") -> DataFrame:
    """``doc, page, title, text`` as one escaped XHTML section a page, blank pages left out."""
    paras = F.filter(F.split(reflow(F.col("text")), "\n\n"), lambda p: p != "")
    body = F.array_join(F.transform(paras, lambda p: F.concat(F.lit("<p>"), escape_html(p), F.lit("</p>"))), "")
    head = F.concat(F.lit('<section id="page_'), F.col("page").cast("string"), F.lit('"><h2>Page '), F.col("page").cast("string"), F.lit("</h2>"))
    return pages.where(strip(F.col("text")) != "").select("doc", "page", escape_html(F.coalesce(title, F.lit("Untitled"))).alias("title"), F.concat(head, body, F.lit("</section>")).alias("section"))


def chapter_html(title: Column, level: Column, paragraphs: Column) -> Column:
    h = F.least(F.greatest(level, F.lit(2)), F.lit(6)).cast("string")
    return F.concat(F.lit("<h"), h, F.lit(">"), escape_html(title), F.lit("</h"), h, F.lit(">"), F.array_join(F.transform(paragraphs, lambda p: F.concat(F.lit("<p>"), escape_html(p), F.lit("</p>"))), ""))


def write_documents(df: DataFrame, path: str, form: str = "md") -> None:
    """``doc, text`` as text files in a folder for each bucket of documents."""
    df.select(F.pmod(F.xxhash64("doc"), F.lit(256)).alias("bucket"), F.col("text").alias("value")).write.mode("overwrite").partitionBy("bucket").option("lineSep", "\n\x1e\n" if form != "jsonl" else "\n").text(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def layout_json(blocks: DataFrame) -> DataFrame:
    """Each page's blocks as a JSON text in reading order (redact before, not after)."""
    item = F.struct("reading_order", "text", F.struct("xmin", "ymin", "xmax", "ymax").alias("bbox"), "confidence")
    return blocks.groupBy("page_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("json"))


def write_audit_csv(df: DataFrame, path: str) -> None:
    """CSV with headers in which no cell can run as a formula."""
    safe = [csv_guard(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*safe).write.mode("overwrite").option("header", "true").csv(path)


def loader_documents(docs: DataFrame) -> DataFrame:
    """``page_content, metadata`` as retrieval libraries take them."""
    keys = [c for c in docs.columns if c != "text"]
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"`{k}`").cast("string").alias("value")) for k in keys])
    return docs.select(F.col("text").alias("page_content"), F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull())).alias("metadata"))


def text_boxes(pages: DataFrame) -> DataFrame:
    """Boxes of the lines of ``page_id, width, height, text``, spread evenly over the page, with
    the font size that fits, for pages without geometry."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), strip), lambda x: x != "")
    p = pages.withColumn("l", lines).withColumn("n", F.size("l"))
    p = p.select("page_id", "width", "height", "n", F.posexplode("l").alias("k", "line"))
    step = F.col("height") / (F.col("n") + 2)
    box = p.withColumn("xmin", F.col("width") * 0.05).withColumn("xmax", F.col("width") * 0.95).withColumn("ymin", step * (F.col("k") + 1)).withColumn("ymax", step * (F.col("k") + 2))
    size = F.least(F.greatest(F.least((F.col("ymax") - F.col("ymin")) * 0.8, (F.col("xmax") - F.col("xmin")) * 1.05 / (F.length("line") * 0.5)), F.lit(4.0)), F.lit(96.0))
    return box.select("page_id", F.col("k").alias("ord"), "line", "xmin", "ymin", "xmax", "ymax", size.alias("font_size"), (F.col("ymax") - 0.15 * (F.col("ymax") - F.col("ymin"))).alias("baseline"))


#: Parts of a job whose page hashes are put in order and hashed by themselves.
MANIFEST_PART = 1000


def manifest(pages: DataFrame) -> DataFrame:
    """One row a job of ``job_id, page, route, confidence, text``: counts, mean confidence and
    a digest that changes with any page, its number or its place. Pages are hashed, the
    hashes of ``MANIFEST_PART`` page numbers are put in order and hashed, and so are those of
    the parts: of a job of any size a task holds one part. Rows that are there twice count twice."""
    h = F.sha2(F.concat_ws("\x1f", F.col("page").cast("string"), F.coalesce("route", F.lit("")), F.coalesce("text", F.lit("\\0"))), 256)
    rows = pages.select("job_id", F.floor(F.coalesce("page", F.lit(-1)) / MANIFEST_PART).alias("part"), F.coalesce("page", F.lit(-1)).alias("page"), "route", "confidence", h.alias("h"))
    ordered = lambda key: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "h"))), lambda x: x["h"]), "\n"), 256)
    native = F.col("route") == "native"
    parts = rows.groupBy("job_id", "part").agg(
        F.count("*").alias("n"), F.count_if(native).alias("native"), F.count_if(~native).alias("ocr"), F.sum("confidence").alias("s"), F.count("confidence").alias("c"), ordered("page").alias("h")
    )
    return parts.groupBy("job_id").agg(
        F.sum("n").alias("pages"), F.sum("native").alias("native_pages"), F.sum("ocr").alias("ocr_pages"), F.round(F.sum("s") / F.nullif(F.sum("c"), F.lit(0)) + F.lit(1e-9), 4).alias("mean_confidence"), ordered("part").alias("digest")
    )


def best_boxes(modelled: DataFrame, detected: DataFrame, raw: DataFrame) -> DataFrame:
    """Text boxes of each page from the best there is: lines of the page model (``page_id, ord,
    line, xmin, ymin, xmax, ymax``), else detections (``page_id, ord, line, coords`` of four or
    eight numbers), else raw lines spread over the page (``page_id, width, height, text``)."""
    box = ["page_id", "ord", "line", "xmin", "ymin", "xmax", "ymax"]
    c = F.col("coords")
    odd, even = F.filter(c, lambda _, i: i % 2 == 0), F.filter(c, lambda _, i: i % 2 == 1)
    flat = detected.where(F.size("coords").isin(4, 8)).select("page_id", "ord", "line", *[f(x).alias(n) for n, f, x in (("xmin", F.array_min, odd), ("ymin", F.array_min, even), ("xmax", F.array_max, odd), ("ymax", F.array_max, even))])
    spread = text_boxes(raw).select(*box)
    filled = lambda df: df.where(strip(F.coalesce("line", F.lit(""))) != "").select(*box)
    a, b = filled(modelled), filled(flat)
    b = b.join(a.select("page_id").distinct(), "page_id", "left_anti")
    have = a.select("page_id").unionByName(b.select("page_id")).distinct()
    tagged = lambda df, name: df.withColumn("origin", F.lit(name))
    return tagged(a, "model").unionByName(tagged(b, "detections")).unionByName(tagged(spread.join(have, "page_id", "left_anti"), "lines"))


#: What a drawing of a page shows at most, and the colours of its parts (fixed values).
SVG_BOXES = 500
COLOURS = {"title": "#b45309", "section_header": "#7c3aed", "table": "#047857", "footnote": "#64748b"}


def layout_svg(blocks: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """``page_id, svg``: the boxes of each page's blocks in reading order, clamped to the page,
    with their escaped beginnings; the feature shows the first ``SVG_BOXES`` of a page."""
    n = lambda c: F.regexp_replace(F.round(c.cast("double"), 2).cast("string"), r"\.0$", "")
    at = lambda c, most: F.greatest(F.lit(0.0), F.least(c.cast("double"), most.cast("double")))
    w, h = F.col(width), F.col(height)
    x, y = at(F.col("xmin"), w), at(F.col("ymin"), h)
    colour = F.lit("#2563eb")
    for kind, c in COLOURS.items():
        colour = F.when(F.col("kind") == kind, c).otherwise(colour)
    label = escape_html(F.substring(F.regexp_replace(xml_safe(F.col("text")), r"\s+", " "), 1, 40))
    rect = F.concat(
        F.lit('<rect x="'), n(x), F.lit('" y="'), n(y), F.lit('" width="'), n(at(F.col("xmax"), w) - x), F.lit('" height="'), n(at(F.col("ymax"), h) - y), F.lit('" fill="none" stroke="'), colour,
        F.lit('"/><text x="'), n(x), F.lit('" y="'), n(y), F.lit('">'), label, F.lit("</text>"),
    )
    per = blocks.select("page_id", w.alias("w"), h.alias("h"), F.struct("reading_order", rect.alias("r")).alias("item")).groupBy("page_id").agg(F.max("w").alias("w"), F.max("h").alias("h"), F.array_sort(F.collect_list("item")).alias("items"))
    body = F.array_join(F.transform(F.slice("items", 1, SVG_BOXES), lambda i: i["r"]), "")
    return per.select("page_id", F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 '), n(F.col("w")), F.lit(" "), n(F.col("h")), F.lit('">'), body, F.lit("</svg>")).alias("svg"))


def save_scorecard(card: DataFrame, path: str, name: str) -> None:
    """A scorecard as JSON under its name; saving it again replaces it."""
    card.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/name={name}")


def load_scorecard(spark, path: str, name: str) -> DataFrame:
    schema = "pages bigint, mean_cer double, mean_wer double, mean_tau double, facts bigint, fact_rate double"
    return spark.read.schema(schema).json(f"{path.rstrip('/')}/name={name}")
