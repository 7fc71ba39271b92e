"""Documents in: formats, binary scans, HTML and Markdown parsing, stored runs."""

from __future__ import annotations

import html.parser
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Media types and endings of supported formats.
MEDIA_TYPES = {
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "text/html": "html",
    "text/markdown": "md",
}
ENDINGS = {"pdf": "pdf", "docx": "docx", "pptx": "pptx", "html": "html", "htm": "html", "md": "md", "markdown": "md"}
#: Formats that are parsed here; others need a provider.
PARSED = ("html", "md")
ITEMS = "doc_id string, pos int, self_ref string, label string, layer string, level int, text string, page_no int"


def document_format(stated: Column, name: Column) -> Column:
    """By media type, then by bare ending, then by the name's ending; null if none is supported."""
    lower = F.lower(F.trim(stated))
    media = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    ending = F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv])
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)\z", 1))
    return F.coalesce(media[lower], ending[F.regexp_replace(lower, r"\A\.", "")], ending[suffix])


def scan(spark: SparkSession, path: str, glob: str | None = None, max_mb: int = 50) -> DataFrame:
    """(doc_id, name, format, content, problem): files as they are; oversize, empty and unsupported ones keep a problem and no content."""
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return admit(files.withColumn("name", F.regexp_extract("path", r"([^/]*)\z", 1)).withColumn("stated", F.lit("")), max_mb)


def decode(requests: DataFrame, max_mb: int = 50) -> DataFrame:
    """Requests (name, stated, body in base64) to documents like ``scan``'s."""
    too_big = F.length("body") * 3 / 4 > max_mb * (1 << 20)
    rows = requests.withColumn("content", F.when(~too_big, F.try_to_binary("body", F.lit("base64")))).withColumn("length", F.when(too_big, F.length("body") * 3 / 4).otherwise(F.octet_length("content")))
    return admit(rows, max_mb)


def admit(files: DataFrame, max_mb: int) -> DataFrame:
    kind = document_format(F.col("stated"), F.col("name"))
    problem = (
        F.when(F.col("length") > max_mb * (1 << 20), "too large").when(F.col("content").isNull(), "not base64").when(F.col("length") == 0, "empty").when(kind.isNull(), "unsupported format")
    )
    return files.select(F.sha2("content", 256).alias("doc_id"), "name", kind.alias("format"), F.when(problem.isNull(), F.col("content")).alias("content"), problem.alias("problem"))


class _Items(html.parser.HTMLParser):
    """Headings, paragraphs, list items, table cells and images in order."""

    BLOCKS = {"p": "paragraph", "li": "list_item", "caption": "caption", "figcaption": "caption", "div": "text", "td": "cell", "th": "cell"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, int | None, str]] = []
        self.text: list[str] = []
        self.open: tuple[str, int | None] = ("text", None)
        self.skip = 0

    def flush(self):
        text = re.sub(r"\s+", " ", "".join(self.text)).strip()
        if text:
            self.rows.append((*self.open, text))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.open = ("section_header", int(tag[1]))
        elif tag in self.BLOCKS:
            self.flush()
            self.open = (self.BLOCKS[tag], None)
        elif tag == "img":
            self.flush()
            self.rows.append(("picture", None, dict(attrs).get("alt") or ""))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif re.fullmatch("h[1-6]", tag) or tag in self.BLOCKS:
            self.flush()
            self.open = ("text", None)

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def html_items(text: str) -> list[tuple[str, int | None, str]]:
    parser = _Items()
    parser.feed(text)
    parser.close()
    parser.flush()
    return parser.rows


def markdown_items(text: str) -> list[tuple[str, int | None, str]]:
    rows: list[tuple[str, int | None, str]] = []
    for block in re.split(r"\n\s*\n", text):
        paragraph: list[str] = []
        for line in block.split("\n"):
            if m := re.match(r"(#{1,6})\s+(.*\S)", line):
                if paragraph:
                    rows.append(("paragraph", None, " ".join(paragraph)))
                    paragraph = []
                rows.append(("section_header", len(m[1]), m[2]))
            elif m := re.match(r"\s*[-*+]\s+(.*\S)", line):
                rows.append(("list_item", None, m[1]))
            elif line.strip():
                paragraph.append(line.strip())
        if paragraph:
            rows.append(("paragraph", None, " ".join(paragraph)))
    return rows


def items(docs: DataFrame) -> DataFrame:
    """Items of parsed formats, in Arrow batches; documents of other formats give none and need a provider."""

    def run(batches):
        for pdf in batches:
            out = []
            for doc, kind, content in zip(pdf["doc_id"], pdf["format"], pdf["content"]):
                text = bytes(content).decode("utf-8", "replace")
                found = html_items(text) if kind == "html" else markdown_items(text)
                out += [(doc, i, f"#/items/{i}", label, "BODY", level, body, 1) for i, (label, level, body) in enumerate(found)]
            yield pd.DataFrame(out, columns=["doc_id", "pos", "self_ref", "label", "layer", "level", "text", "page_no"]).astype({"level": "Int32"})

    return docs.filter(F.col("format").isin(*PARSED) & F.col("content").isNotNull()).select("doc_id", "format", "content").mapInPandas(run, ITEMS)


def runs(spark: SparkSession, root: str) -> DataFrame:
    """(run, modified, files) of folders that hold result files, newest first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root).select("path", "modificationTime")
    parts = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+\z", 1).alias("run"), F.regexp_extract("path", r"([^/]+)\z", 1).alias("file"), "modificationTime")
    known = parts.filter(F.col("file").isin("document.json", "chunks.json", "graph.json", "meta.json", "response.json", "summary.json"))
    return known.groupBy("run").agg(F.max("modificationTime").alias("modified"), F.array_sort(F.collect_set("file")).alias("files")).orderBy(F.desc("modified"), "run")
