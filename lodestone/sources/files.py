"""File sources: type detection, validation, DOCX and HTML parsing into elements, JSON lines with comments."""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators import lineage
from lodestone.operators.chunker import ELEMENTS

# Limits of an upload.
MAX_ZIP_ENTRIES, MAX_UNPACKED = 2_000, 200 * 1024 * 1024
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_folder(spark: SparkSession, path: str, suffixes: str = "{pdf,docx}") -> DataFrame:
    """path, length, modificationTime, content of files by suffix."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffixes}").option("recursiveFileLookup", "true").load(path)


def detect_type(file_name: Column, mime: Column) -> Column:
    """pdf or docx by extension first, MIME type second; null for anything else."""
    suffix = F.lower(F.regexp_extract(file_name, r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(suffix.isin("pdf", "docx"), suffix)
        .when(mime == "application/pdf", F.lit("pdf"))
        .when(mime == "application/vnd.openxmlformats-officedocument.wordprocessingml.document", F.lit("docx"))
    )


def file_problem(doc_type: str | None, data: bytes) -> str | None:
    """Why a file is refused, or None."""
    if not data:
        return "empty file"
    if doc_type == "pdf":
        return None if b"%PDF-" in data[:1024] else "not a PDF file"
    if doc_type == "docx":
        if not data.startswith(b"PK\x03\x04"):
            return "not a DOCX file"
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                entries = z.infolist()
        except (zipfile.BadZipFile, ValueError):
            return "damaged DOCX file"
        if "word/document.xml" not in {e.filename for e in entries}:
            return "not a DOCX file"
        if len(entries) > MAX_ZIP_ENTRIES or sum(e.file_size for e in entries) > MAX_UNPACKED:
            return "archive too large"
        return None
    return "unsupported type"


@F.pandas_udf(T.StringType())
def check_file(doc_type: pd.Series, content: pd.Series) -> pd.Series:
    return pd.Series([file_problem(t, c) for t, c in zip(doc_type, content, strict=True)])


def element(kind: str, text: str, level: int = 0, page: int | None = None) -> dict:
    return {"kind": kind, "text": text.replace("\x00", ""), "level": level, "page": page}


def grid_to_markdown(rows: list[list[str]]) -> str:
    """A Markdown table: rows padded to one width, pipes escaped, line ends as spaces; a blank first row gives the header col1, col2, ..."""
    width = max((len(r) for r in rows), default=0)
    if not rows:
        return ""
    cell = lambda c: (c or "").replace("|", "\\|").replace("\n", " ").strip()
    grid = [[cell(c) for c in [*r, *[""] * (width - len(r))]] for r in rows]
    if not any(grid[0]):
        grid.insert(0, [f"col{i}" for i in range(1, width + 1)])
    line = lambda r: f"| {' | '.join(r)} |"
    return "\n".join([line(grid[0]), line(["---"] * width), *map(line, grid[1:])])


def style_element(name: str, text: str) -> dict:
    """An element by its style's name: the title is level 1, so a heading of level n is n + 1."""
    low = name.strip().lower()
    head = re.match(r"heading\s+(\d)", low)
    if head:
        return element("heading", text, int(head[1]) + 1)
    if low in ("title", "subtitle"):
        return element("heading", text, 1 if low == "title" else 2)
    return element("list" if low.startswith("list") else "paragraph", text)


def docx_elements(data: bytes) -> list[dict]:
    """Paragraphs, headings (by style name), list items and tables of the body, in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        styles = ElementTree.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in z.namelist() else []
    names = {}
    for style in styles:
        name = style.find(f"{_W}name")
        if style.tag == f"{_W}style" and name is not None:
            names[style.get(f"{_W}styleId")] = name.get(f"{_W}val", "")
    text = lambda node: "".join(t.text or "" if t.tag == f"{_W}t" else "\n" for t in node.iter() if t.tag in (f"{_W}t", f"{_W}br"))
    out = []
    for node in body if body is not None else []:
        if node.tag == f"{_W}tbl":
            # a cell's paragraphs are its lines
            grid = [["\n".join(text(p) for p in c.findall(f"{_W}p")) for c in row.findall(f"{_W}tc")] for row in node.findall(f"{_W}tr")]
            if grid:
                out.append(element("table", grid_to_markdown(grid)))
        elif node.tag == f"{_W}p" and text(node).strip():
            style = node.find(f"{_W}pPr/{_W}pStyle")
            key = style.get(f"{_W}val", "") if style is not None else ""
            # without a style table, ids such as Heading2 stand for names
            out.append(style_element(names.get(key, re.sub(r"(?i)^(heading)(\d)", r"\1 \2", key)), text(node).strip()))
    return out


#: Parsers by document type.
PARSERS = {"docx": docx_elements}


def parse_file(files: DataFrame) -> DataFrame:
    """elements and problem of files (doc_type, content): refused, unreadable and unsupported files give a problem and no elements."""

    @F.pandas_udf(f"elements {ELEMENTS}, problem string")
    def parse(doc_type: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = []
        for kind, data in zip(doc_type, content, strict=True):
            data = None if data is None else bytes(data)
            problem = file_problem(kind, data)
            if problem is None and kind not in PARSERS:
                problem = f"no parser for {kind}"
            try:
                rows.append((None if problem else PARSERS[kind](data), problem))
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError):
                rows.append((None, "the file could not be read"))
        return pd.DataFrame(rows, columns=["elements", "problem"])

    return files.withColumn("_p", parse("doc_type", "content")).select(*files.columns, "_p.elements", "_p.problem")


class _Html(HTMLParser):
    """Blocks of a page: headings, paragraphs, list items, tables, preformatted text; scripts and navigation are left out."""

    BLOCKS = {"p": "paragraph", "li": "list", "pre": "code", "blockquote": "paragraph", "div": "paragraph", "td": "cell", "th": "cell", **{f"h{i}": "heading" for i in range(1, 7)}}
    SKIP = {"script", "style", "nav", "template", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.skip, self.open, self.text, self.grid = 0, None, [], None

    def flush(self) -> None:
        text = "".join(self.text)
        text = text.strip("\n") if self.open == "pre" else " ".join(text.split())
        kind = self.BLOCKS.get(self.open, "paragraph")
        if text.strip():
            if kind == "cell" and self.grid:
                self.grid[-1].append(text)
            elif kind != "cell":
                self.out.append(element(kind, text, int(self.open[1]) if kind == "heading" else 0))
        self.text, self.open = [], None

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        elif tag == "table":
            self.flush()
            self.grid = []
        elif tag == "tr" and self.grid is not None:
            self.grid.append([])
        elif tag == "br":
            self.text.append("\n")
        elif tag in self.BLOCKS:
            self.flush()
            self.open = tag

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "table" and self.grid is not None:
            self.flush()
            if any(self.grid):
                self.out.append(element("table", grid_to_markdown([r for r in self.grid if r])))
            self.grid = None
        elif tag in self.BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def html_elements(html: str | None) -> list[dict]:
    parser = _Html()
    parser.feed(re.sub(r"(?is)<head\b.*?</head>", "", html or ""))
    parser.close()
    parser.flush()
    return parser.out


def parse_docx(files: DataFrame) -> DataFrame:
    """elements of DOCX files in `content`; null where the file can't be read."""

    @F.pandas_udf(ELEMENTS)
    def parse(content: pd.Series) -> pd.Series:
        out = []
        for data in content:
            try:
                out.append(docx_elements(bytes(data)))
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError):
                out.append(None)
        return pd.Series(out)

    return files.withColumn("elements", parse("content"))


def parse_html(pages: DataFrame) -> DataFrame:
    """elements of pages in `html`."""
    lineage.small_batches(pages.sparkSession)

    @F.pandas_udf(ELEMENTS)
    def parse(html: pd.Series) -> pd.Series:
        return pd.Series([html_elements(h) for h in html])

    return pages.withColumn("elements", parse("html"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines and lines that begin with // are left out; a broken line fails the read."""
    lines = spark.read.text(path).where(~F.trim("value").startswith("//") & (F.trim("value") != ""))
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def latest_file(spark: SparkSession, path: str) -> DataFrame:
    """The path of the newest file that matches."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def write_results(rows: DataFrame, path: str) -> None:
    """JSON results, one object a line."""
    rows.write.mode("overwrite").json(path)


def repeated_edges(lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Running headers and footers: doc_id, folded line, from rows (doc_id, page, line_no, text).

    The first and last line of each page, digits folded, of 90 characters at most, count when a document of four pages or more
    has them max(3, 60 % of its pages) times. pages: doc_id, pages, as pages without lines count too; else the last page with a line.
    """
    ends = lines.groupBy("doc_id", "page").agg(F.min_by("text", "line_no").alias("a"), F.max_by("text", "line_no").alias("b"), F.count("*").alias("n"))
    if pages is None:
        pages = lines.groupBy("doc_id").agg(F.max("page").cast("long").alias("pages"))
    both = F.when(F.col("n") > 1, F.array("a", "b")).otherwise(F.array("a"))
    folded = ends.select("doc_id", F.explode(both).alias("t")).select("doc_id", F.trim(F.regexp_replace("t", r"\d+", "#")).alias("line")).where(F.length("line").between(1, 90))
    counts = folded.groupBy("doc_id", "line").agg(F.count("*").alias("n")).join(pages.where("pages >= 4").select("doc_id", "pages"), "doc_id")
    return counts.where(F.col("n") >= F.greatest(F.lit(3).cast("long"), F.floor(F.col("pages") * 0.6)))


# Bullets, numbered headings and ends of sentences in line text.
BULLET = r"(?i)^\s*(?:[•▪◦·\-*]|\(?[a-z0-9]{1,3}[.)])\s+"
NUMBERED = r"^\s*\d+(?:\.\d+)*\.?\s+\S"
SENTENCE_END = r"[.!?;:]\s*$"


def is_heading(body: Column) -> Column:
    """Of a line (text, size, bold): larger than the body, or bold and short; no bullet or full sentence unless it is a numbered heading."""
    text = F.trim("text")
    plain = text.rlike(NUMBERED) | (~text.rlike(BULLET) & ~text.rlike(SENTENCE_END))
    return (F.length(text).between(1, 130)) & plain & ((F.col("size") >= body * 1.12) | (F.col("bold") & (F.col("size") >= body * 0.97) & (F.length(text) <= 90)))


def reading_order(boxes: DataFrame, ties: list[str] | None = None) -> DataFrame:
    """Adds `position` to boxes (doc_id, page, page_width, x0, y0, x1): down the page, or down the left column first.

    A page has two columns where it has eight boxes or more, none reaches across the middle (4 % either side), and a
    quarter of them, three at least, stand on either side.
    """
    mid, slack = F.col("page_width") / 2, F.col("page_width") * 0.04
    of_page = boxes.groupBy("doc_id", "page").agg(
        F.count("*").alias("_n"),
        F.count_if((F.col("x0") < mid - slack) & (F.col("x1") > mid + slack)).alias("_across"),
        F.count_if(F.col("x1") <= mid).alias("_left"),
        F.count_if((F.col("x1") > mid) & (F.col("x0") >= mid)).alias("_right"),
    )
    two = (F.col("_n") >= 8) & (F.col("_across") == 0) & (F.least("_left", "_right") >= F.greatest(F.lit(3.0), F.col("_n") * 0.25))
    placed = boxes.join(of_page, ["doc_id", "page"])
    # of two columns, boxes that end at the middle are left and those that begin there right; others belong to neither
    placed = placed.where(~two | (F.col("x1") <= mid) | (F.col("x0") >= mid)).withColumn("_column", F.when(two & (F.col("x1") > mid), 1).otherwise(0))
    w = Window.partitionBy("doc_id", "page").orderBy("_column", F.bround("y0", 1), "x0", *(ties or []))
    return placed.withColumn("position", F.row_number().over(w)).select(*boxes.columns, "position")


def joined_paragraphs(lines: DataFrame) -> DataFrame:
    """doc_id, page, block, text: consecutive body lines of a page (doc_id, page, position, text, is_body) as paragraphs.

    A line that ends in a hyphen loses it and is joined to the next without a space. A page's lines are one bounded group.
    """
    w = Window.partitionBy("doc_id", "page").orderBy("position")
    numbered = lines.withColumn("block", F.sum(F.when(F.col("is_body"), 0).otherwise(1)).over(w)).where("is_body")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"])

    def add(text: Column, line: Column) -> Column:
        joined = F.when(text.endswith("-"), F.concat(F.left(text, F.length(text) - 1), F.ltrim(line)))
        return joined.when(text != "", F.concat(text, F.lit(" "), F.trim(line))).otherwise(F.trim(line))

    out = numbered.groupBy("doc_id", "page", "block").agg(F.aggregate(listed, F.lit(""), add).alias("text"))
    return out.where(F.trim("text") != "")


def body_size(lines: DataFrame) -> DataFrame:
    """doc_id, size: the font size with the most characters (the smaller on ties)."""
    by = lines.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("chars"))
    return by.groupBy("doc_id").agg(F.max_by("size", F.struct("chars", -F.col("size"))).alias("size"))


def heading_levels(headings: DataFrame) -> DataFrame:
    """doc_id, size, level: the largest size is level 1, at most 6."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("size"))
    return headings.select("doc_id", "size").distinct().withColumn("level", F.least(F.dense_rank().over(w), F.lit(6)))
