"""Layout, books, tables and evaluation. Layouts are derived from order lines by integer
arithmetic that Spark and SQL share, as the tables hold no page geometry."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.functions import chars, text
from foliospark.operators import book, evaluation, layout, ledger, tables
from foliospark.session import table

from .registry import query

_S = chars.SPACE
_STRIP = lambda c: f"regexp_replace({c}, '^[{_S}]+|[{_S}]+$', '', 'g')"

#: Every order is a page, every line of it a span.
_SPANS = """
    SELECT l_orderkey AS page_id,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS ord,
      l_returnflag || l_linestatus AS text, 1.0 - l_discount AS confidence,
      CAST((l_partkey * 37 + l_linenumber * 211) % 1500 AS DOUBLE) AS xmin, CAST((l_suppkey * 53 + l_linenumber * 97) % 950 AS DOUBLE) AS ymin,
      CAST((l_partkey * 37 + l_linenumber * 211) % 1500 + 60 + (l_partkey % 7) * 40 AS DOUBLE) AS xmax,
      CAST((l_suppkey * 53 + l_linenumber * 97) % 950 + 14 + (l_suppkey % 3) * 4 AS DOUBLE) AS ymax,
      CASE WHEN l_orderkey % 2 = 0 THEN 1600.0 ELSE 900.0 END AS width, 1000.0 AS height, 18.0 AS glyph FROM lineitem"""

_SIDES = f"""
    WITH s AS (SELECT *, xmin < 0.6 * width AND xmax > 0.4 * width AS mid FROM ({_SPANS})),
    g AS (SELECT *, lead(xmin) OVER (PARTITION BY page_id, mid ORDER BY xmin, ord) AS nx, row_number() OVER (PARTITION BY page_id, mid ORDER BY xmin, ord) AS rn FROM s),
    b AS (SELECT page_id, max(nx - xmax) AS gap, arg_max((nx + xmax) / 2, (nx - xmax, -rn)) AS split FROM g WHERE mid AND nx > xmax GROUP BY 1),
    h AS (SELECT s.*, CASE WHEN width > 1.1 * height AND (xmin + xmax) / 2 >= CASE WHEN gap > 1.5 * glyph THEN split ELSE width / 2 END THEN 1 ELSE 0 END AS raw
          FROM s LEFT JOIN b ON s.page_id = b.page_id)
    SELECT * EXCLUDE (mid, raw), raw - min(raw) OVER (PARTITION BY page_id) AS side FROM h"""


def _spans(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("foliospark_lineitem")
    return spark.sql(_SPANS.replace("FROM lineitem", "FROM foliospark_lineitem"))


@query(f"SELECT page_id, ord, side::INT AS side FROM ({_SIDES})")
def layout_spread(spark, sf_dir):
    return layout.facing_pages(_spans(spark, sf_dir)).select("page_id", "ord", "side")


@query(f"""SELECT page_id, ord, side::INT AS side, sum(new) OVER (PARTITION BY page_id, side ORDER BY xmin, ord)::INT AS col FROM (
    SELECT *, CASE WHEN xmin - max(xmax) OVER (PARTITION BY page_id, side ORDER BY xmin, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= greatest(35.0, 1.8 * glyph) THEN 1 ELSE 0 END AS new FROM ({_SIDES}))""")
def layout_columns(spark, sf_dir):
    return layout.columns(layout.facing_pages(_spans(spark, sf_dir))).select("page_id", "ord", "side", "col")


@query(f"""SELECT page_id, ord, sum(new) OVER (PARTITION BY page_id ORDER BY line)::INT AS block FROM (
    SELECT *, CASE WHEN ymin - lag(ymax) OVER (PARTITION BY page_id ORDER BY line) > greatest(25.0, 2.2 * glyph) THEN 1 ELSE 0 END AS new FROM (
      SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ymin, ord) AS line FROM ({_SPANS})))""")
def layout_blocks(spark, sf_dir):
    s = _spans(spark, sf_dir).withColumn("line", F.row_number().over(Window.partitionBy("page_id").orderBy("ymin", "ord")))
    one = s.withColumn("side", F.lit(0)).withColumn("col", F.lit(0))
    return layout.blocks(one).select("page_id", "ord", "block")


@query()
def layout_lines(spark, sf_dir):
    """Spans of each column clustered into lines (a fold; tested against brute force)."""
    return layout.lines(layout.columns(layout.facing_pages(layout.valid_spans(_spans(spark, sf_dir)))))


@query()
def reading_order(spark, sf_dir):
    """The whole chain: blocks of every page in reading order."""
    return layout.read_page(_spans(spark, sf_dir))


@query(f"SELECT page_id, round(sum(confidence * length(text)) / sum(length(text)) + 1e-9, 6) AS confidence, min(xmin) AS xmin, max(xmax) AS xmax FROM ({_SPANS}) GROUP BY 1")
def span_confidence(spark, sf_dir):
    s = _spans(spark, sf_dir).groupBy("page_id").agg(layout.char_weighted(F.col("confidence"), F.col("text"), 0.0).alias("c"), F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"))
    return s.select("page_id", ledger.rounded(F.col("c"), 6).alias("confidence"), "xmin", "xmax")


@query("""SELECT p_partkey, greatest(32, (round_even(h * r / 32.0, 0)::INT) * 32) AS h, greatest(32, (round_even(w * r / 32.0, 0)::INT) * 32) AS w FROM (
    SELECT *, CASE WHEN greatest(h, w) > 960 THEN 960.0::DOUBLE / greatest(h, w) ELSE 1.0 END AS r FROM (SELECT p_partkey, (p_partkey * 37) % 2400 + 20 AS h, (p_partkey * 91) % 1800 + 15 AS w FROM part))""")
def detection_resize(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") * 37) % 2400 + 20).alias("h"), ((F.col("p_partkey") * 91) % 1800 + 15).alias("w"))
    h, w = layout.resize(F.col("h"), F.col("w"))
    return p.select("p_partkey", h.alias("h"), w.alias("w"))


@query("""WITH i AS (SELECT p_partkey, k, ((p_partkey * 7 + k // 2) % 5)::INT AS id, (50 + (p_partkey + k) % 50) / 100.0::DOUBLE AS p FROM part, (SELECT unnest(range(24)) AS k)),
    b AS (SELECT *, lag(id) OVER (PARTITION BY p_partkey ORDER BY k) AS before FROM i)
    SELECT p_partkey, trim(string_agg(CASE id WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' WHEN 4 THEN ' ' ELSE '' END, '' ORDER BY k)) AS text, round(avg(p), 6) AS confidence
    FROM b WHERE id <> 0 AND id IS DISTINCT FROM before GROUP BY 1""")
def ctc_decode(spark, sf_dir):
    """Greedy decoding of made-up predictions."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: ((F.col("p_partkey") * 7 + F.floor(i / 2)) % 5).cast("int"))
    probs = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: (F.lit(50) + (F.col("p_partkey") + i) % 50) / 100.0)
    t, c = layout.ctc_decode(ids, probs, ["", "a", "b", "c", " "])
    return table(spark, sf_dir, "part").select("p_partkey", t.alias("text"), F.round(c, 6).alias("confidence"))


# ---- tables ----

_CELLS = """SELECT page_id, i * 4 + j AS cell, CAST(j * 400 AS DOUBLE) AS xmin, CAST(i * 250 AS DOUBLE) AS ymin, CAST(j * 400 + 400 AS DOUBLE) AS xmax, CAST(i * 250 + 250 AS DOUBLE) AS ymax"""


def _cells(spark, spans):
    pages = spans.select("page_id").distinct().select("page_id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    pages = pages.selectExpr("page_id", "CAST(k DIV 4 AS INT) AS i", "k % 4 AS j")
    return pages.selectExpr("page_id", "i * 4 + j AS cell", "CAST(j * 400 AS DOUBLE) AS xmin", "CAST(i * 250 AS DOUBLE) AS ymin", "CAST(j * 400 + 400 AS DOUBLE) AS xmax", "CAST(i * 250 + 250 AS DOUBLE) AS ymax")


@query(f"""WITH s AS ({_SPANS}), c AS ({_CELLS} FROM (SELECT DISTINCT page_id FROM s), (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j))
    SELECT c.page_id, c.cell::INT AS cell, coalesce(string_agg(s.text, ' ' ORDER BY s.ord), '') AS text FROM c LEFT JOIN s ON c.page_id = s.page_id
      AND (s.xmin + s.xmax) / 2 BETWEEN c.xmin AND c.xmax AND (s.ymin + s.ymax) / 2 BETWEEN c.ymin AND c.ymax GROUP BY 1, 2""")
def table_cells(spark, sf_dir):
    s = _spans(spark, sf_dir)
    return tables.fill_cells(_cells(spark, s), s).select("page_id", "cell", "text")


@query(f"""WITH s AS ({_SPANS}), c AS ({_CELLS}, i, j FROM (SELECT DISTINCT page_id FROM s), (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j)),
    t AS (SELECT c.page_id, c.i, c.j, coalesce(string_agg(s.text, ' ' ORDER BY s.ord), '') AS text FROM c LEFT JOIN s ON c.page_id = s.page_id
      AND (s.xmin + s.xmax) / 2 BETWEEN c.xmin AND c.xmax AND (s.ymin + s.ymax) / 2 BETWEEN c.ymin AND c.ymax GROUP BY 1, 2, 3)
    SELECT page_id, string_agg(r, chr(10) ORDER BY i) AS grid FROM (SELECT page_id, i, string_agg(text, '|' ORDER BY j) AS r FROM t GROUP BY 1, 2) GROUP BY 1""")
def table_grids(spark, sf_dir):
    """Filled cells as grids by row and column."""
    s = _spans(spark, sf_dir)
    g = tables.grids(tables.fill_cells(_cells(spark, s), s))
    return g.select("page_id", F.array_join(F.transform("grid", lambda r: F.array_join(r, "|")), "\n").alias("grid"))


_ROW = "['item' || l_linenumber, replace(l_returnflag, 'R', 'R<' || chr(10) || '&'), l_quantity::INT::VARCHAR]"


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, 'item' || l_linenumber AS a, CASE WHEN l_returnflag = 'R' THEN 'R<' || chr(10) || '&' ELSE l_returnflag END AS b, l_quantity::INT::VARCHAR AS c FROM lineitem),
    r AS (SELECT l_orderkey,
      string_agg('| ' || a || ' | ' || replace(b, chr(10), ' ') || ' | ' || c || ' |', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS m,
      string_agg('<tr><td>' || a || '</td><td>' || replace(replace(b, '&', '&amp;'), '<', '&lt;') || '</td><td>' || c || '</td></tr>', '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS h FROM o GROUP BY 1)
    SELECT l_orderkey, '| Item | Flag | Quantity |' || chr(10) || '| --- | --- | --- |' || chr(10) || m AS markdown,
      '<table><thead><tr><th>Item</th><th>Flag</th><th>Quantity</th></tr></thead><tbody>' || h || '</tbody></table>' AS html FROM r""")
def table_render(spark, sf_dir):
    flag = F.when(F.col("l_returnflag") == "R", F.lit("R<\n&")).otherwise(F.col("l_returnflag"))
    row = F.array(F.concat(F.lit("item"), F.col("l_linenumber").cast("string")), flag, F.col("l_quantity").cast("int").cast("string"))
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", row.alias("r"))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("x"))
    grid = F.concat(F.array(F.array(F.lit("Item"), F.lit("Flag"), F.lit("Quantity"))), F.transform("x", lambda x: x["r"]))
    return g.select("l_orderkey", tables.to_markdown(grid).alias("markdown"), tables.to_html(grid).alias("html"))


# ---- books ----

_LINES = f"""SELECT id, job_id AS doc, page_number AS page, x AS text, k AS seq, (k - 0.5) * 1000.0 / n AS y FROM (
    SELECT id, job_id, page_number, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS k, len(l) AS n FROM (
      SELECT id, job_id, page_number, list_filter(string_split(extracted_text, chr(10)), lambda x: {_STRIP('x')} <> '') AS l FROM ocr_results WHERE job_id IS NOT NULL AND page_number IS NOT NULL AND extracted_text IS NOT NULL))"""


def _lines(spark, sf_dir):
    """Non-blank lines of the pages as blocks, spread evenly over a height of 1000."""
    r = table(spark, sf_dir, "ocr_results").where("job_id is not null and page_number is not null and extracted_text is not null")
    r = r.select("id", F.col("job_id").alias("doc"), F.col("page_number").alias("page"), F.filter(F.split("extracted_text", "\n", -1), lambda x: x.rlike(f"[^{_S}]")).alias("l"))
    r = r.select("id", "doc", "page", F.size("l").alias("n"), F.posexplode("l").alias("p", "text"))
    return r.select("id", "doc", "page", "text", (F.col("p") + 1).alias("seq"), ((F.col("p") + 0.5) * 1000.0 / F.col("n")).alias("y"), F.lit(1000.0).alias("height"), F.lit("text").alias("kind"))


@query(f"""WITH b AS (SELECT *, CASE WHEN y <= 80.0 THEN 'top' WHEN y >= 920.0 THEN 'bottom' END AS zone, {_STRIP(f"regexp_replace({_STRIP('text')}, '[0-9]+', '', 'g')")} AS clean FROM ({_LINES})),
    o AS (SELECT doc, zone, clean FROM b WHERE zone IS NOT NULL AND clean <> '' GROUP BY 1, 2, 3 HAVING count(*) >= 2),
    p AS (SELECT doc, count(DISTINCT page) AS pages FROM b GROUP BY 1)
    SELECT b.id, count(*) AS kept, md5(string_agg(text, chr(10) ORDER BY seq)) AS digest FROM b JOIN p ON b.doc = p.doc LEFT JOIN o ON b.doc = o.doc AND b.zone = o.zone AND b.clean = o.clean
    WHERE NOT (pages >= 2 AND o.doc IS NOT NULL) GROUP BY 1""")
def strip_headers(spark, sf_dir):
    kept = book.strip_headers(_lines(spark, sf_dir))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n")
    return kept.groupBy("id").agg(F.count("*").alias("kept"), F.md5(body).alias("digest"))


@query(f"""SELECT id, seq::INT AS seq, text FROM (SELECT *, count(*) OVER (PARTITION BY doc, page) AS n FROM ({_LINES}))
    WHERE n >= 2 AND y >= 850.0 AND regexp_matches({_STRIP('text')}, '{book.FOOTNOTE}')""")
def footnotes(spark, sf_dir):
    b = _lines(spark, sf_dir).withColumn("ymin", F.col("y")).withColumn("ymax", F.col("y"))
    return book.footnotes(b).where("is_footnote").select("id", "seq", "text")


_KIND = "CASE WHEN is_heading AND heading_level = 1 THEN 'title' WHEN is_heading THEN 'section_header' ELSE 'text' END"


def _paragraphs(spark, sf_dir):
    b = table(spark, sf_dir, "book_paragraphs").where("job_id is not null and text is not null")
    kind = F.when(F.col("is_heading") & (F.col("heading_level") == 1), "title").when(F.col("is_heading"), "section_header").otherwise("text")
    return b.select(F.col("job_id").alias("doc"), F.coalesce("chapter_number", F.lit(0)).cast("int").alias("chapter"), F.col("para_id").alias("seq"), F.coalesce("chapter_number", F.lit(0)).cast("int").alias("page"), "text", kind.alias("kind"))


@query(f"""WITH h AS (SELECT doc, seq, page, title, CASE WHEN regexp_matches(title, '{book.NUMBERED}') OR (kind = 'section_header' AND length(title) < 80) THEN 2
        WHEN regexp_matches(title, '{book.CHAPTER}') OR (kind = 'title' AND length(title) < 80) THEN 1 END AS level FROM (
      SELECT job_id AS doc, para_id AS seq, coalesce(chapter_number, 0)::INT AS page, {_KIND} AS kind, {_STRIP(f"string_split({_STRIP('text')}, chr(10))[1]")} AS title
      FROM book_paragraphs WHERE job_id IS NOT NULL AND text IS NOT NULL))
    SELECT doc, seq, page, level, title, CASE WHEN level = 2 THEN last_value(CASE WHEN level = 1 THEN seq END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent
    FROM h WHERE level IS NOT NULL AND title <> ''""")
def toc_outline(spark, sf_dir):
    return book.contents(_paragraphs(spark, sf_dir))


def _levelled(spark, sf_dir):
    level = F.when(F.col("kind") == "title", 1).when(F.col("kind") == "section_header", 2)
    names = table(spark, sf_dir, "ocr_jobs").select(F.col("id").alias("doc"), F.regexp_extract("filename", r"([^/]*)$", 1).alias("title"))
    return _paragraphs(spark, sf_dir).withColumn("level", level).join(names, "doc", "left")


@query()
def semantic_chunks(spark, sf_dir):
    """Chunks of every book by section (a fold; tested against brute force)."""
    return book.chunks(_levelled(spark, sf_dir))


@query(f"""WITH p AS (SELECT job_id AS doc, para_id AS seq, {_STRIP('text')} AS t, CASE WHEN is_heading AND heading_level = 1 THEN 1 WHEN is_heading THEN 2 END AS level, regexp_extract(filename, '([^/]*)$', 1) AS title
      FROM book_paragraphs LEFT JOIN ocr_jobs ON job_id = id WHERE job_id IS NOT NULL AND {_STRIP('text')} <> ''),
    n AS (SELECT *, sum((level IS NOT NULL)::INT) OVER w AS section, last_value(CASE WHEN level = 1 THEN t END IGNORE NULLS) OVER w AS h1 FROM p WINDOW w AS (PARTITION BY doc ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT doc, section::INT AS section, count(*) AS paragraphs, coalesce(max(CASE WHEN level IS NOT NULL THEN concat_ws(' > ', title, h1, CASE WHEN level = 2 THEN t END) END), max(coalesce(title, 'General'))) AS path FROM n GROUP BY 1, 2""")
def chunk_sections(spark, sf_dir):
    """Sections with their heading paths."""
    s = book.sections(_levelled(spark, sf_dir))
    return s.groupBy("doc", "section").agg(F.count("*").alias("paragraphs"), F.max(F.array_join("path", " > ")).alias("path"))


@query(f"""WITH b AS (SELECT *, count(*) OVER (PARTITION BY doc, page) AS n, regexp_matches({_STRIP('text')}, '{book.FOOTNOTE}') AS m FROM (SELECT id, doc, page, text, seq, y FROM ({_LINES}))),
    f AS (SELECT *, n >= 2 AND y >= 850.0 AND m AS note FROM b),
    k AS (SELECT id, seq, regexp_extract({_STRIP('text')}, '{book.FOOTNOTE}', 1) AS mark FROM f WHERE note)
    SELECT k.id, k.seq::INT AS note, k.mark, coalesce(max(t.seq), -1)::INT AS anchor FROM k LEFT JOIN f t ON t.id = k.id AND NOT t.note AND t.seq < k.seq AND contains(t.text, regexp_replace(k.mark, '\\.$', '')) GROUP BY 1, 2, 3""")
def footnote_links(spark, sf_dir):
    """Footnotes of every saved page with the line that holds their mark."""
    b = _lines(spark, sf_dir)
    n = F.count("*").over(Window.partitionBy("doc", "page"))
    pages = b.withColumn("many", n >= 2).withColumn("ymin", F.when(F.col("many"), F.col("y")).otherwise(F.lit(0.0))).withColumn("ymax", F.col("ymin"))
    links = book.footnote_links(pages.select(F.col("id").alias("doc"), F.col("page"), "seq", "text", "ymin", "ymax", "height"))
    return links.select(F.col("doc").alias("id"), F.col("note").cast("int").alias("note"), "mark", F.coalesce("anchor", F.lit(-1)).cast("int").alias("anchor"))


@query("""SELECT job_id AS doc, ((page_number - 1) // 50)::INT AS "window", count(*) AS pages, md5(string_agg(extracted_text, chr(10) || chr(10) || '--- Page Break ---' || chr(10) || chr(10) ORDER BY page_number)) AS digest
    FROM (SELECT * FROM ocr_results WHERE job_id IS NOT NULL AND page_number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_id, page_number ORDER BY created_at DESC NULLS LAST, id DESC) = 1)
    WHERE extracted_text IS NOT NULL GROUP BY 1, 2""")
def page_windows(spark, sf_dir):
    p = ledger.latest_pages(table(spark, sf_dir, "ocr_results")).where("extracted_text is not null")
    w = book.page_windows(p.select(F.col("job_id").alias("doc"), F.col("page_number").alias("page"), F.col("extracted_text").alias("text")))
    return w.select("doc", "window", "pages", F.md5("text").alias("digest"))


# ---- evaluation ----

_PLAIN = "regexp_replace(text, '[^ -~]', '?', 'g')"


@query(f"""SELECT item_id, round(levenshtein(g, h)::DOUBLE / length(g), 6) AS cer FROM (SELECT item_id, {_STRIP(f"regexp_replace(g, '[{_S}]+', ' ', 'g')")} AS g, {_STRIP(f"regexp_replace(replace(replace(g, 'e', 'c'), 'th', 'tb'), '[{_S}]+', ' ', 'g')")} AS h
    FROM (SELECT item_id, {_PLAIN} AS g FROM eval_items))""")
def cer_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "eval_items").select("item_id", F.regexp_replace("text", "[^ -~]", "?").alias("g"))
    return e.select("item_id", F.round(evaluation.cer(F.col("g"), F.replace(F.replace("g", F.lit("e"), F.lit("c")), F.lit("th"), F.lit("tb"))), 6).alias("cer"))


def _known_pages(spark, sf_dir):
    """The last save of the pages that have known text: others don't reach the aggregate."""
    keys = table(spark, sf_dir, "gold").where("page_id is not null").select(F.split("page_id", "/").alias("k"))
    keys = keys.select(F.expr("try_cast(k[0] as bigint)").alias("job_id"), F.expr("try_cast(k[1] as int)").alias("page_number")).distinct()
    results = table(spark, sf_dir, "ocr_results").join(keys, ["job_id", "page_number"], "left_semi")
    p = ledger.latest_pages(results)
    return p.select(F.concat_ws("/", F.col("job_id").cast("string"), F.col("page_number").cast("string")).alias("page_id"), F.col("extracted_text").alias("got"), F.col("confidence_score").alias("confidence"))


def _gold_pairs(spark, sf_dir):
    return evaluation.gold_pages(table(spark, sf_dir, "gold")).join(_known_pages(spark, sf_dir), "page_id")


@query()
def gold_scores(spark, sf_dir):
    """CER, WER and order of every page with known text."""
    return evaluation.page_scores(_gold_pairs(spark, sf_dir))


_FLAT = lambda c: _STRIP(f"regexp_replace(regexp_replace({c}, '[{_S}]+', ' ', 'g'), '[^ -~]', '?', 'g')")
#: Pairs of known and saved text, in ASCII: levenshtein counts bytes in SQL.
_PAIRS = f"""SELECT g.page_id, {_FLAT('gold')} AS g, {_FLAT("coalesce(got, '')")} AS h FROM (
      SELECT page_id, string_agg(text, chr(10) || chr(10) ORDER BY para_no, text) AS gold FROM gold WHERE text IS NOT NULL AND page_id IS NOT NULL GROUP BY 1) g
    JOIN (SELECT job_id || '/' || page_number AS page_id, extracted_text AS got FROM ocr_results WHERE job_id IS NOT NULL AND page_number IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY job_id, page_number ORDER BY created_at DESC NULLS LAST, id DESC) = 1) h ON g.page_id = h.page_id"""


def _ascii_pairs(spark, sf_dir):
    flat = lambda c: chars.strip(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{_S}]+", " "), "[^ -~]", "?"))
    return _gold_pairs(spark, sf_dir).select("page_id", flat(F.col("gold")).alias("gold"), flat(F.col("got")).alias("got"), "confidence")


def _facts(pairs):
    """Whether the page holds the beginning, the end and twice the first word of its known text."""
    g = pairs.select("page_id", "got", F.substring("gold", 1, 20).alias("x"), F.expr("right(gold, 20)").alias("y"))
    rows = F.array(*[F.struct(F.lit(k).alias("fact_no"), F.lit(t).alias("type"), F.col(a).alias("first"), F.col(b).alias("second"), F.lit(0).alias("most")) for k, t, a, b in ((1, "contains", "x", "y"), (2, "ordered_before", "x", "y"), (3, "table_cell", "x", "y"))])
    return evaluation.fact_checks(g.select("page_id", F.explode(rows).alias("r")).select("page_id", "r.*"), pairs)


_FACTS = """SELECT page_id, (contains(t, a))::INT + (instr(t, a) > 0 AND instr(t, b) > 0 AND instr(t, a) < instr(t, b))::INT + (contains(t, a) AND contains(t, b))::INT AS passed FROM (
      SELECT page_id, lower(h) AS t, lower(trim(left(g, 20))) AS a, lower(trim(right(g, 20))) AS b FROM pairs)"""


@query(f"""WITH pairs AS ({_PAIRS}) SELECT count(*) AS pages, round(avg(CASE WHEN length(g) = 0 THEN (length(h) > 0)::INT ELSE levenshtein(g, h)::DOUBLE / length(g) END) + 1e-9, 4) AS mean_cer,
    3 * count(*) AS facts, round(sum(passed)::DOUBLE / (3 * count(*)) + 1e-9, 4) AS fact_rate FROM pairs JOIN ({_FACTS}) USING (page_id)""")
def scorecard(spark, sf_dir):
    """Means over all pages with known text. (WER and order have no SQL twin: see ``gold_scores``.)"""
    pairs = _ascii_pairs(spark, sf_dir)
    return evaluation.scorecard(evaluation.page_scores(pairs, _facts(pairs))).select("pages", "mean_cer", "facts", "fact_rate")


@query(f"""WITH pairs AS ({_PAIRS}), after AS (SELECT page_id, g, {_STRIP("replace(h, ' the ', ' ')")} AS h FROM pairs),
    a AS (SELECT count(*) AS n, round(avg(CASE WHEN length(g) = 0 THEN (length(h) > 0)::INT ELSE levenshtein(g, h)::DOUBLE / length(g) END) + 1e-9, 4) AS c, (SELECT round(sum(passed)::DOUBLE / (3 * count(*)) + 1e-9, 4) FROM ({_FACTS})) AS f FROM pairs),
    b AS (SELECT count(*) AS n, round(avg(CASE WHEN length(g) = 0 THEN (length(h) > 0)::INT ELSE levenshtein(g, h)::DOUBLE / length(g) END) + 1e-9, 4) AS c, (SELECT round(sum(passed)::DOUBLE / (3 * count(*)) + 1e-9, 4) FROM ({_FACTS.replace('FROM pairs', 'FROM after')})) AS f FROM after)
    SELECT a.n = b.n AS comparable, false AS passed, a.c AS baseline_cer, b.c AS candidate_cer, a.f AS baseline_facts, b.f AS candidate_facts FROM a, b""")
def regression_gate(spark, sf_dir):
    """A candidate that lost a frequent word against the text as saved: the gate must close."""
    pairs = _ascii_pairs(spark, sf_dir)
    after = pairs.withColumn("got", chars.strip(F.replace("got", F.lit(" the "), F.lit(" "))))
    card = lambda p: evaluation.scorecard(evaluation.page_scores(p, _facts(p)))
    return evaluation.gate(card(pairs), card(after))


@query(f"""WITH h AS (SELECT job_id || '/' || page_number AS page_id, extracted_text AS got FROM ocr_results WHERE job_id IS NOT NULL AND page_number IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY job_id, page_number ORDER BY created_at DESC NULLS LAST, id DESC) = 1),
    f AS (SELECT page_id, para_no, text, lead(text) OVER (PARTITION BY page_id ORDER BY para_no) AS nxt FROM gold WHERE page_id IS NOT NULL AND text IS NOT NULL),
    n AS (SELECT page_id, para_no, CASE para_no % 3 WHEN 0 THEN 'contains' WHEN 1 THEN 'ordered_before' ELSE 'absent' END AS type,
      {_STRIP(f"regexp_replace(lower(text), '[{_S}]+', ' ', 'g')")} AS a, {_STRIP(f"regexp_replace(lower(coalesce(nxt, '')), '[{_S}]+', ' ', 'g')")} AS b FROM f),
    j AS (SELECT n.*, {_STRIP(f"regexp_replace(lower(coalesce(got, '')), '[{_S}]+', ' ', 'g')")} AS t FROM n LEFT JOIN h ON n.page_id = h.page_id)
    SELECT page_id, para_no AS fact_no, type, CASE type WHEN 'contains' THEN contains(t, a) WHEN 'ordered_before' THEN instr(t, a) > 0 AND instr(t, b) > 0 AND instr(t, a) < instr(t, b)
      ELSE (length(t) - length(replace(t, a, '')))::DOUBLE / nullif(length(a), 0) <= 0 END AS passed FROM j""")
def fact_checks(spark, sf_dir):
    g = table(spark, sf_dir, "gold").where("page_id is not null and text is not null")
    kind = F.when(F.col("para_no") % 3 == 0, "contains").when(F.col("para_no") % 3 == 1, "ordered_before").otherwise("absent")
    f = g.select("page_id", F.col("para_no").alias("fact_no"), kind.alias("type"), F.col("text").alias("first"), F.lead("text").over(Window.partitionBy("page_id").orderBy("para_no")).alias("second"), F.lit(0).alias("most"))
    return evaluation.fact_checks(f, _known_pages(spark, sf_dir))


_TEDS_BY_PAGE = "SELECT l_orderkey % 100 AS page_id, l_orderkey // 100 AS ord FROM lineitem GROUP BY ALL"


@query(f"SELECT count(*) AS tables, 1.0::DOUBLE AS mean_similarity, 1.0::DOUBLE AS mean_structure FROM ({_TEDS_BY_PAGE})")
def teds_batch(spark, sf_dir):
    """Tables of both sides paired on their page; against themselves all are alike."""
    t = table_render(spark, sf_dir).selectExpr("l_orderkey % 100 AS page_id", "l_orderkey div 100 AS ord", "html")
    return evaluation.table_summary(evaluation.table_scores(evaluation.table_pairs(t, t)))


@query()
def teds(spark, sf_dir):
    """Similarity of each order's table with one that lacks its last cell's digits."""
    t = table_render(spark, sf_dir)
    return evaluation.table_scores(t.select(F.col("l_orderkey").alias("key"), F.col("html").alias("gold"), F.regexp_replace("html", r"[0-9]</td></tr></tbody>", "</td></tr></tbody>").alias("got")))
