"""Sources: files into rows. Every reader is a DataFrame over ``binaryFile`` or ``text``, so a
directory of any size is listed and read by the executors."""

from __future__ import annotations

import re
import zipfile
from io import BytesIO
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.arrow import map_batches
from foliospark.functions.text import normal_space
from foliospark.operators.cache import content_hash
from foliospark.operators.ledger import row_numbers

MAX_BYTES = 200 * 1024 * 1024
#: First bytes of the file types that are taken in, in hexadecimal (fixed values).
MAGIC = {
    "pdf": "25504446", "png": "89504E470D0A1A0A", "jpg": "FFD8FF", "jpeg": "FFD8FF", "tif": "49492A00|4D4D002A", "tiff": "49492A00|4D4D002A",
    "bmp": "424D", "webp": "52494646", "pptx": "504B0304", "docx": "504B0304",
}
IMAGES = ("png", "jpg", "jpeg", "bmp", "tiff", "tif")


def ingest(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``path, suffix, length, sha256, reject``: null in ``reject`` where a file is taken, else
    the first rule that it breaks (suffix, size, content). Files without bytes have no row: the
    listing of the source leaves them out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known = F.create_map(*[x for k, v in MAGIC.items() for x in (F.lit(k), F.lit(v))])
    # by the listing alone first: the filter on the length reaches the source, which reads no larger file
    listed = files.select("path", suffix.alias("suffix"), "length")
    early = F.when(known[F.col("suffix")].isNull(), "suffix").when(F.col("length") > max_bytes, "size")
    out = listed.select("path", "suffix", "length", F.lit(None).cast("string").alias("sha256"), early.alias("reject")).where("reject is not null")
    head = F.hex(F.substring("content", 1, 16))
    fits = F.exists(F.split(known[suffix], r"\|"), lambda m: F.startswith(head, m))
    read = files.where((F.col("length") <= max_bytes) & known[suffix].isNotNull())
    return out.unionByName(read.select("path", suffix.alias("suffix"), "length", content_hash(F.col("content")).alias("sha256"), F.when(~fits, "content").alias("reject")))


def image_pages(spark: SparkSession, path: str) -> DataFrame:
    """Images of a directory tree as pages: number within their directory by file name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(IMAGES) + "}").load(path)
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    rows = files.select(folder.alias("folder"), "path", "length")
    # counted by the beginnings of file names, so that a flat folder isn't one task
    begins = F.substring(F.regexp_extract("path", r"([^/]*)$", 1), 1, 4)
    return row_numbers(rows, ["folder"], begins, ["path"], "page").withColumn("page", F.col("page").cast("int"))


def gold_texts(spark: SparkSession, path: str) -> DataFrame:
    """``file, label, para_no, text`` of known texts: ``[PAGE label]`` lines open a page, blank
    lines part paragraphs. Files are read whole, one row each."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    parts = F.split("value", r"(?m)^\[PAGE\s+", -1)
    pages = files.select("file", F.posexplode(parts).alias("n", "part")).where("n > 0")
    pages = pages.select("file", F.trim(F.regexp_extract("part", r"^([^\]\n]*)\]", 1)).alias("label"), F.regexp_replace("part", r"^[^\]\n]*\]", "").alias("body"))
    paras = pages.select("file", "label", F.filter(F.transform(F.split("body", r"\n[ \t]*\n", -1), normal_space), lambda p: p != "").alias("p"))
    return paras.select("file", "label", F.posexplode("p").alias("k", "text")).select("file", "label", (F.col("k") + 1).alias("para_no"), "text")


_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def _text(body: ET.Element) -> str:
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in body.iter(f"{_A}p"))


def slide_text(data: bytes) -> list[tuple[int, str]]:
    """(number, text) of each slide: heading, shapes, table rows and notes."""
    out = []
    with zipfile.ZipFile(BytesIO(data)) as z:
        names = set(z.namelist())
        numbers = sorted(int(m[1]) for n in names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for k in numbers:
            root = ET.fromstring(z.read(f"ppt/slides/slide{k}.xml"))
            parts = [f"## Slide {k}"]
            for e in root.iter():
                if e.tag.endswith("}txBody") and _text(e).strip() and not e.tag.startswith(_A):
                    parts.append(_text(e))
                elif e.tag == f"{_A}tr":
                    parts.append("| " + " | ".join(_text(c) for c in e.findall(f"{_A}tc")) + " |")
            notes = f"ppt/notesSlides/notesSlide{k}.xml"
            if notes in names and (said := _text(ET.fromstring(z.read(notes))).strip()):
                parts.append(f"> **Notes:** {said}")
            out.append((k, "\n".join(parts)))
    return out


def slides(spark: SparkSession, path: str) -> DataFrame:
    """``path, slide, text, error`` of presentations. A file that can't be read gives one row
    with its error and no invented text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pptx").load(path).select("path", "content")

    def make():
        def run(paths, contents):
            rows = []
            for p, c in zip(paths, contents):
                try:
                    rows += [(p, k, t, None) for k, t in slide_text(c)]
                except (zipfile.BadZipFile, ET.ParseError, KeyError) as e:
                    rows.append((p, None, None, f"{type(e).__name__}: {e}"))
            return rows

        return run

    return map_batches(files, make, "path string, slide int, text string, error string")


def disk_usage(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes by directory, from file metadata only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.groupBy(F.regexp_replace("path", r"/[^/]*$", "").alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def facts(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, fact_no, type, first, second, most`` of fact files named ``<page>.facts.yaml``:
    lists of flat mappings, of which only ``type``, ``text``, ``first``, ``second``,
    ``max_occurrences``, ``row_text`` and ``cell_text`` are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.facts.yaml").load(path)
    lines = files.select(F.regexp_extract("path", r"([^/]+)\.facts\.yaml$", 1).alias("page_id"), F.posexplode(F.split(F.decode("content", "UTF-8"), "\r?\n")).alias("n", "line"))
    # a fact begins at a dash; its keys follow on lines of their own
    pair = r"^\s*(-\s+)?(type|text|first|second|max_occurrences|row_text|cell_text)\s*:\s*(.*?)\s*$"
    keyed = lines.select("page_id", "n", F.regexp_extract("line", r"^\s*(-)\s", 1).alias("dash"), F.regexp_extract("line", pair, 2).alias("k"), F.regexp_extract("line", pair, 3).alias("v"))
    plain = F.regexp_replace(F.regexp_replace("v", r"\s+#.*$", ""), r"^(['\"])(.*)\1$", "$2")
    files_rows = keyed.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("n", "dash", "k", plain.alias("v")))).alias("x"))

    def make():
        def run(pages, rows):
            out = []
            for p, own in zip(pages, rows):
                found: list[dict] = []
                for r in own:
                    if r["dash"]:
                        found.append({})
                    if r["k"] and found:
                        found[-1][r["k"]] = r["v"]
                for k, f in enumerate([f for f in found if f.get("type")], 1):
                    most = f.get("max_occurrences")
                    out.append((p, k, f["type"], f.get("text") or f.get("first") or f.get("cell_text"), f.get("second") or f.get("row_text"), int(most) if most and most.isdigit() else None))
            return out

        return run

    return map_batches(files_rows, make, "page_id string, fact_no int, type string, first string, second string, most int")
