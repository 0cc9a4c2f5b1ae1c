"""Documents as files: Word, EPUB and PDF written and read back, as bytes in a column.

Each maker takes one document; :func:`packed` runs it over a table, document by document on
the executors. Nothing but the standard library is needed: the first two are zip archives of
XML, and of PDF only text, fonts and the page tree are written or understood.
"""

from __future__ import annotations

import re
import zipfile
import zlib
from collections.abc import Callable
from html import escape
from io import BytesIO
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame

from foliospark.arrow import map_batches

#: What XML can't hold.
_NOT_XML = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd]")
#: Lines of Markdown that part into cells, and the rule below a table's head (fixed values).
_ROW, _RULE = re.compile(r"^\s*\|(.*)\|\s*$"), re.compile(r"^\s*\|[ :|-]+\|\s*$")
_HEADING, _BREAK = re.compile(r"^(#{1,3}) (.*)$"), re.compile(r"^---\s*$")

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_STAMP = (1980, 1, 1, 0, 0, 0)


def _zip(files: list[tuple[str, str]], stored: int = 0) -> bytes:
    """An archive with the first ``stored`` files uncompressed; equal contents give equal bytes."""
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, (name, text) in enumerate(files):
            info = zipfile.ZipInfo(name, _STAMP)
            info.compress_type = zipfile.ZIP_STORED if k < stored else zipfile.ZIP_DEFLATED
            z.writestr(info, text.encode("utf-8"))
    return out.getvalue()


def _clean(text: str) -> str:
    return _NOT_XML.sub("", text)


def docx(title: str, text: str) -> bytes:
    """A Word document of Markdown-like lines: headings of three levels, tables, page breaks."""

    def para(content: str, style: str = "") -> str:
        look = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f'<w:p>{look}<w:r><w:t xml:space="preserve">{escape(content)}</w:t></w:r></w:p>'

    body, rows = [], []

    def close() -> None:
        if rows:
            wide = max(map(len, rows))
            cells = "".join("<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in [*r, *[""] * (wide - len(r))]) + "</w:tr>" for r in rows)
            body.append(f'<w:tbl><w:tblPr><w:tblStyle w:val="TableGrid"/></w:tblPr><w:tblGrid>{"<w:gridCol/>" * wide}</w:tblGrid>{cells}</w:tbl>')
            rows.clear()

    for line in _clean(text).split("\n"):
        if _RULE.match(line):
            continue
        if m := _ROW.match(line):
            rows.append([c.strip() for c in m[1].split("|")])
            continue
        close()
        if m := _HEADING.match(line):
            body.append(para(m[2], f"Heading{len(m[1])}"))
        elif _BREAK.match(line):
            body.append('<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
        else:
            body.append(para(line))
    close()
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    package = "http://schemas.openxmlformats.org/package/2006"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kinds = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
    return _zip([
        ("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{kinds}"/><Override PartName="/docProps/core.xml" ContentType="application/vnd.openxmlformats-package.core-properties+xml"/></Types>'),
        ("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="word/document.xml"/><Relationship Id="r2" Type="{package}/relationships/metadata/core-properties" Target="docProps/core.xml"/></Relationships>'),
        ("docProps/core.xml", f'{head}<cp:coreProperties xmlns:cp="{package}/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(_clean(title))}</dc:title></cp:coreProperties>'),
        ("word/document.xml", f'{head}<w:document xmlns:w="{_W}"><w:body>{"".join(body)}<w:sectPr/></w:body></w:document>'),
    ])


def docx_text(data: bytes) -> str:
    """The lines of a Word document: paragraphs, table rows with bars, ``---`` for page breaks."""
    tag = lambda n: f"{{{_W}}}{n}"
    text = lambda e: "".join(t.text or "" for t in e.iter(tag("t")))
    with zipfile.ZipFile(BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(tag("body"))
    out = []
    for e in body if body is not None else ():
        if e.tag == tag("tbl"):
            out += ["| " + " | ".join(text(c) for c in r.findall(tag("tc"))) + " |" for r in e.findall(tag("tr"))]
        elif e.tag == tag("p"):
            style = e.find(f"{tag('pPr')}/{tag('pStyle')}")
            level = re.fullmatch(r"Heading([1-9])", style.get(tag("val"), "")) if style is not None else None
            broken = any(b.get(tag("type")) == "page" for b in e.iter(tag("br")))
            out.append("---" if broken else "#" * int(level[1]) + " " + text(e) if level else text(e))
    return "\n".join(out)


def epub(title: str, chapters: list[tuple[str, str]]) -> bytes:
    """An EPUB of (title, text) chapters: blank lines part paragraphs, everything is escaped."""
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    title = escape(_clean(title) or "Untitled")

    def page(name: str, text: str) -> str:
        paras = "".join(f"<p>{escape(' '.join(p.split()))}</p>" for p in re.split(r"\n[ \t]*\n", _clean(text)) if p.strip())
        return f'{head}<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{escape(_clean(name))}</title></head><body><h2>{escape(_clean(name))}</h2>{paras}</body></html>'

    ids = [f"c{k + 1}" for k in range(len(chapters))]
    items = "".join(f'<item id="{i}" href="{i}.xhtml" media-type="application/xhtml+xml"/>' for i in ids)
    links = "".join(f'<li><a href="{i}.xhtml">{escape(_clean(n))}</a></li>' for i, (n, _) in zip(ids, chapters))
    return _zip([
        ("mimetype", "application/epub+zip"),
        ("META-INF/container.xml", f'{head}<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'),
        ("OEBPS/book.opf", f'{head}<package version="3.0" unique-identifier="id" xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{zlib.crc32(title.encode()):08x}</dc:identifier><dc:title>{title}</dc:title><dc:language>en</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{"".join(f'<itemref idref="{i}"/>' for i in ids)}</spine></package>'),
        ("OEBPS/nav.xhtml", f'{head}<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{title}</title></head><body><nav epub:type="toc"><ol>{links}</ol></nav></body></html>'),
        *[(f"OEBPS/{i}.xhtml", page(n, t)) for i, (n, t) in zip(ids, chapters)],
    ], stored=1)


def epub_chapters(data: bytes) -> list[tuple[str, str]]:
    """(title, text) of the chapters in spine order."""
    with zipfile.ZipFile(BytesIO(data)) as z:
        opf = ET.fromstring(z.read("OEBPS/book.opf"))
        ns = "{http://www.idpf.org/2007/opf}"
        href = {e.get("id"): e.get("href") for e in opf.iter(f"{ns}item")}
        out = []
        for ref in opf.iter(f"{ns}itemref"):
            page = ET.fromstring(z.read(f"OEBPS/{href[ref.get('idref')]}"))
            x = "{http://www.w3.org/1999/xhtml}"
            name = next((e.text or "" for e in page.iter(f"{x}h2")), "")
            out.append((name, "\n\n".join(e.text or "" for e in page.iter(f"{x}p"))))
    return out


def searchable_pdf(pages: list[tuple[float, float, list[tuple[str, float, float, float]]]]) -> bytes:
    """A PDF of (width, height, boxes) pages with invisible text: each box is (text, left, baseline
    from the top, font size). Signs outside Windows-1252 become question marks."""
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    kids = []
    for width, height, boxes in pages:
        ops = [b"BT 3 Tr"]
        for text, left, baseline, size in boxes:
            raw = text.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b" ")
            ops.append(f"/F1 {size:.2f} Tf 1 0 0 1 {left:.2f} {height - baseline:.2f} Tm (".encode() + raw + b") Tj")
        stream = zlib.compress(b"\n".join([*ops, b"ET"]))
        n = len(objects) + 1
        kids.append(n)
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {width:g} {height:g}] /Resources << /Font << /F1 3 0 R >> >> /Contents {n + 1} 0 R >>".encode())
        objects.append(f"<< /Length {len(stream)} /Filter /FlateDecode >>\nstream\n".encode() + stream + b"\nendstream")
    objects[1] = f"<< /Type /Pages /Kids [{' '.join(f'{k} 0 R' for k in kids)}] /Count {len(kids)} >>".encode()
    out, at = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"), []
    for k, o in enumerate(objects, 1):
        at.append(len(out))
        out += f"{k} 0 obj\n".encode() + o + b"\nendobj\n"
    start = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{x:010d} 00000 n \n".encode() for x in at)
    return bytes(out + f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode())


class Pdf:
    """The page tree and plain text of a PDF. Object streams are opened; encrypted files raise."""

    _OBJ = re.compile(rb"(?:^|[\r\n\s])(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
    _REF = re.compile(rb"(\d+)\s+\d+\s+R")

    def __init__(self, data: bytes):
        if not data.startswith(b"%PDF"):
            raise ValueError("no PDF")
        self.objects: dict[int, bytes] = {}
        for m in self._OBJ.finditer(data):
            self.objects[int(m[1])] = m[3]
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm", body) and (raw := self.stream(body)) is not None:
                n, first = (int(re.search(rb"/" + k + rb"\s+(\d+)", body)[1]) for k in (b"N", b"First"))
                heads = list(map(int, raw[:first].split()[: 2 * n]))
                for i in range(0, len(heads), 2):
                    end = heads[i + 3] if i + 3 < len(heads) else len(raw) - first
                    self.objects.setdefault(heads[i], raw[first + heads[i + 1] : first + end])
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ValueError("encrypted PDF")
        self.pages = [o for o in self._ordered() or sorted(k for k, b in self.objects.items() if re.search(rb"/Type\s*/Page\b", b))]

    def _ordered(self) -> list[int]:
        roots = [b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)]
        found = re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", roots[-1]) if roots else None
        out, open_, seen = [], [int(found[1])] if found else [], set()
        while open_:
            k = open_.pop()
            body = self.objects.get(k, b"")
            if k in seen:
                continue
            seen.add(k)
            kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
            if kids:
                open_ += reversed([int(x) for x in self._REF.findall(kids[1])])
            elif re.search(rb"/Type\s*/Page\b", body):
                out.append(k)
        return out

    def stream(self, body: bytes) -> bytes | None:
        m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
        if not m:
            return None
        if b"/FlateDecode" not in body[: m.start()]:
            return m[1]
        try:
            return zlib.decompressobj().decompress(m[1])
        except zlib.error:
            return None

    def page_text(self, k: int) -> str:
        """Text of the ``k``-th page from 0: strings in drawing order, a new line where the text
        moves down, as Windows-1252."""
        body = self.objects[self.pages[k]]
        found = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", body, re.S)
        parts = [self.stream(self.objects.get(int(x), b"")) or b"" for x in self._REF.findall(found[1])] if found else []
        lines: list[str] = [""]
        last = None
        for m in _PDF_TOKEN.finditer(b"\n".join(parts)):
            if m["move"] is not None:
                y = float(m["move"].split()[-1])
                if m["kind"] == b"Tm":
                    new, last = last is not None and y != last, y
                else:
                    new = y != 0
                if new and lines[-1]:
                    lines.append("")
            elif m["next"] is not None:
                lines.append("")
            elif m["array"] is not None:
                # a wide step back between strings stands for a blank
                for x in _PDF_PART.finditer(m["array"]):
                    lines[-1] += _pdf_string(x["s"]) if x["s"] is not None else " " if float(x["n"]) < -200 else ""
            else:
                lines[-1] += _pdf_string(m["string"])
        return "\n".join(x for x in lines if x)


_STRING = rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>"
_NUM = rb"[-+]?[0-9]*\.?[0-9]+"
_PDF_TOKEN = re.compile(
    rb"(?P<move>(?:" + _NUM + rb"\s+){5}" + _NUM + rb"\s+(?=Tm\b)|" + _NUM + rb"\s+" + _NUM + rb"\s+(?=T[dD]\b))(?P<kind>T[mdD])"
    rb"|(?P<next>T\*)|\[(?P<array>(?:" + _STRING + rb"|[^\]()<>])*)\]\s*TJ|(?P<string>" + _STRING + rb")\s*(?:Tj|'|\")", re.S,
)
_PDF_PART = re.compile(rb"(?P<s>" + _STRING + rb")|(?P<n>" + _NUM + rb")", re.S)
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(s: bytes) -> str:
    if s[:1] == b"<":
        raw = bytes.fromhex((h := re.sub(rb"\s", b"", s[1:-1]).decode()) + "0" * (len(h) % 2))
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPED.get(m[1], b"" if m[1].endswith(b"\n") else m[1]), s[1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def page_count(suffix: str, data: bytes) -> int | None:
    """Pages of a file by its suffix: of a PDF or a presentation what it holds, one of an image,
    null of anything else and of what can't be read."""
    suffix = suffix.lower().lstrip(".")
    try:
        if suffix == "pdf":
            return len(Pdf(data).pages)
        if suffix == "pptx":
            with zipfile.ZipFile(BytesIO(data)) as z:
                return sum(bool(re.fullmatch(r"ppt/slides/slide\d+\.xml", n)) for n in z.namelist())
    except (ValueError, zipfile.BadZipFile):
        return None
    return 1 if suffix in ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp") else None


def packed(docs: DataFrame, key: str, kind: str, columns: str, make: Callable[..., bytes]) -> DataFrame:
    """``key, data``: one file for each row, made from the named columns."""
    names = columns.split()
    return map_batches(docs.select(key, *names), lambda: lambda ids, *cols: [(i, make(*row)) for i, *row in zip(ids, *cols)], f"{key} {kind}, data binary")


def native_pages(files: DataFrame) -> DataFrame:
    """``path, page, text, error`` of ``path, content``: the native text of every page of PDF files
    (quality and routing are :func:`foliospark.functions.text.quality`). A file that can't be read
    gives one row with its error."""

    def make():
        def run(paths, contents):
            rows = []
            for p, c in zip(paths, contents):
                try:
                    pdf = Pdf(c)
                    rows += [(p, k + 1, pdf.page_text(k), None) for k in range(len(pdf.pages))]
                except Exception as e:  # a file must not end the job
                    rows.append((p, None, None, f"{type(e).__name__}: {e}"))
            return rows

        return run

    return map_batches(files.select("path", "content"), make, "path string, page int, text string, error string")


def page_ranges(files: DataFrame, size: int = 10) -> DataFrame:
    """``path, first, last`` for batches of ``size`` pages of ``path, pages``."""
    from pyspark.sql import functions as F

    starts = F.explode(F.sequence(F.lit(1), F.col("pages"), F.lit(size)))
    return files.where("pages >= 1").select("path", "pages", starts.alias("first")).select("path", "first", F.least(F.col("first") + size - 1, "pages").alias("last"))
