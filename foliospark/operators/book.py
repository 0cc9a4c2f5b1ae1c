"""Books: running heads, contents, footnotes, chunks and windows of pages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window

from foliospark.functions.chars import strip

from .ledger import running_total

#: Forms of headings and footnotes, and the margins of a page (fixed values).
CHAPTER = r"(?i)^(CHAPTER|PART|BOOK|SECTION|MODULE|ACT|UNIT)\s+([0-9IVXLCDM]+|[A-Z]+)\b"
NUMBERED = r"^([0-9]+\.[0-9]+(\.[0-9]+)*)\s+(.*)"
FOOTNOTE = r"^(\*|\x{2020}|\[\^?[0-9]+\]|[0-9]+\.|\([0-9]+\))\s+"
MARGIN, FOOT_ZONE, HEADING_CHARS = 0.08, 0.85, 80


def strip_headers(blocks: DataFrame) -> DataFrame:
    """Blocks (``doc, page, seq, text, y, height, kind``) without headers and footers: texts
    in a margin that, without digits, stand there twice or more in the document, and blocks
    that are marked as such. Documents of one page stay whole. Repeats are counted by an
    aggregate and joined back, so a document of any size spreads."""
    zone = F.when(F.col("y") <= F.col("height") * MARGIN, "top").when(F.col("y") >= F.col("height") * (1 - MARGIN), "bottom")
    b = blocks.withColumn("zone", zone).withColumn("clean", F.when(F.col("zone").isNotNull(), strip(F.regexp_replace("text", "[0-9]+", ""))))
    often = b.where("zone is not null and clean <> ''").groupBy("doc", "zone", "clean").agg(F.count("*").alias("times")).where("times >= 2")
    pages = blocks.groupBy("doc", "page").agg(F.lit(1)).groupBy("doc").agg(F.count("*").alias("pages"))
    j = b.join(often, ["doc", "zone", "clean"], "left").join(pages, "doc", "left")
    marked = ((F.col("zone") == "top") & (F.col("kind") == "header")) | ((F.col("zone") == "bottom") & (F.col("kind") == "footer"))
    furniture = (F.col("pages") >= 2) & F.coalesce(F.col("times").isNotNull() | marked, F.lit(False))
    return j.where(~furniture).select(*blocks.columns)


def heading_level(first_line: Column, kind: Column) -> Column:
    """2 for numbered sections, 1 for chapters, null for text; short typed headings count."""
    short = F.length(first_line) < HEADING_CHARS
    return F.when(first_line.rlike(NUMBERED) | ((kind == "section_header") & short), 2).when(first_line.rlike(CHAPTER) | ((kind == "title") & short), 1)


def contents(blocks: DataFrame) -> DataFrame:
    """Table of contents of blocks ``doc, seq, page, text, kind``: ``level``, ``title`` and the
    ``parent``, the last chapter before. Only headings reach the window."""
    first = strip(F.split(strip(F.col("text")), "\n", 2)[0])
    h = blocks.withColumn("title", first).withColumn("level", heading_level(F.col("title"), F.coalesce("kind", F.lit("")))).where("level is not null and title <> ''")
    w = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.when(F.col("level") == 2, F.last(F.when(F.col("level") == 1, F.col("seq")), True).over(w))
    return h.select("doc", "seq", "page", "level", "title", parent.alias("parent"))


def footnotes(blocks: DataFrame) -> DataFrame:
    """Adds ``is_footnote``: a marked text at the foot of a page of two blocks or more."""
    n = F.count("*").over(Window.partitionBy("doc", "page"))
    low = (F.col("ymin") >= F.col("height") * FOOT_ZONE) | (F.col("ymax") >= F.col("height") * FOOT_ZONE)
    return blocks.withColumn("is_footnote", (n >= 2) & low & F.coalesce(strip(F.col("text")).rlike(FOOTNOTE), F.lit(False)))


def footnote_links(blocks: DataFrame) -> DataFrame:
    """Footnotes with their ``mark`` and the ``anchor``, the last block before them on the page
    that isn't a footnote and holds the mark; null where none does."""
    f = footnotes(blocks).withColumn("mark", F.regexp_extract(strip(F.col("text")), FOOTNOTE, 1))
    notes = f.where("is_footnote").select("doc", "page", F.col("seq").alias("note"), "mark", F.col("text").alias("note_text"))
    body = f.where("not is_footnote").select("doc", "page", "seq", "text")
    hits = notes.join(body, ["doc", "page"]).where((F.col("seq") < F.col("note")) & F.contains("text", F.regexp_replace("mark", r"\.$", "")))
    anchors = hits.groupBy("doc", "page", "note").agg(F.max("seq").alias("anchor"))
    return notes.join(anchors, ["doc", "page", "note"], "left")


def sections(paragraphs: DataFrame) -> DataFrame:
    """``doc, seq, page, text, level, kind, title`` with ``section``, the headings so far in the
    document, and ``path``: the document's title, its last chapter and the heading itself, as
    far as there are any. Headings are counted by thousands of paragraphs first; only headings
    reach a window of the document. Blank texts are left out."""
    p = paragraphs.where(strip(F.col("text")) != "").withColumn("_h", F.col("level").isNotNull().cast("int"))
    numbered = running_total(p, F.floor(F.col("seq") / 1000), ["seq"], "_h", ["doc"], "section").drop("_h").withColumn("section", F.col("section").cast("int"))
    heads, own = numbered.where("level is not null"), strip(F.col("text"))
    chapter = F.last(F.when(F.col("level") == 1, own), True).over(Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    paths = heads.select("doc", "section", F.array_compact(F.array("title", chapter, F.when(F.col("level") > 1, own))).alias("path"))
    top = F.array_compact(F.array("title"))
    return numbered.join(paths, ["doc", "section"], "left").withColumn("path", F.coalesce("path", F.when(F.size(top) > 0, top).otherwise(F.array(F.lit("General")))))


class Packer:
    """Greedy chunks of a section, row by row: a heading opens the first; a chunk ends with the
    text that brings it to the limit. Headings themselves aren't measured against it."""

    def __init__(self, limit: int):
        self.limit, self.key, self.chunk = limit, None, 0
        self.texts: list[str] = []
        self.pages: list[int] = []
        self.kinds: list[str] = []
        self.path: list[str] = []
        self.words = 0

    def close(self) -> list[tuple]:
        if not self.texts:
            return []
        self.chunk += 1
        row = (*self.key, self.chunk, self.path, sorted(set(self.kinds)), "\n\n".join(self.texts), max(1, self.words * 4 // 3), min(self.pages), max(self.pages))
        self.texts, self.pages, self.kinds, self.words = [], [], [], 0
        return [row]

    def add(self, key: tuple, page: int, text: str, heading: bool, kind: str, path: list[str]) -> list[tuple]:
        out = []
        if key != self.key:
            out = self.close() if self.key is not None else []
            self.key, self.chunk = key, 0
        self.path = path
        text = f"### {text}" if heading else text
        self.texts.append(text)
        self.pages.append(page)
        self.kinds.append(kind)
        self.words += len(text.split())
        return out + self.close() if not heading and self.words * 4 // 3 >= self.limit else out


CHUNKS = "doc bigint, section int, chunk int, path array<string>, kinds array<string>, content string, tokens int, page_start int, page_end int"


def chunks(paragraphs: DataFrame, limit: int = 512) -> DataFrame:
    """Chunks of ``doc, seq, page, text, level, kind, title`` by section, with their heading path,
    the kinds of their paragraphs, and the pages of their own texts. Sections are packed by
    themselves; their rows stream through in order, so a task holds one open chunk, however
    long a section is."""
    cols = ["doc", "section", F.coalesce("page", F.lit(0)).alias("page"), strip(F.col("text")).alias("text"), F.col("level").isNotNull().alias("heading"), F.coalesce("kind", F.lit("text")).alias("kind"), "path"]
    near = sections(paragraphs).repartition("doc", "section").sortWithinPartitions("doc", "section", "seq").select(*cols)
    out = _parse_datatype_string(CHUNKS)

    def run(batches):
        arrow, packer = to_arrow_schema(out), Packer(limit)
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
        for b in batches:
            rows = [r for d, s, *rest in zip(*[c.to_pylist() for c in b.columns]) for r in packer.add((d, s), *rest)]
            if rows:
                yield table(rows)
        if rows := packer.close():
            yield table(rows)

    packed = near.mapInArrow(run, out)
    return packed.withColumn("chunk_id", F.substring(F.sha2(F.concat_ws(":", F.col("doc").cast("string"), F.col("section").cast("string"), F.col("chunk").cast("string"), "content"), 256), 1, 8))


def page_windows(pages: DataFrame, size: int = 50) -> DataFrame:
    """``doc, page, text`` as windows of ``size`` pages, each one text in page order."""
    w = F.floor((F.col("page") - 1) / size).cast("int")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"])
    return pages.withColumn("window", w).groupBy("doc", "window").agg(F.count("*").alias("pages"), F.array_join(texts, "\n\n--- Page Break ---\n\n").alias("text"))
