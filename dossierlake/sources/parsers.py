"""Office and PDF files to paragraphs and pages, one file per row, inside the tasks."""

from __future__ import annotations

from collections.abc import Iterator
import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from dossierlake.functions import labels as L
from dossierlake.functions.text import clean_text
from dossierlake.functions.headings import Groups
from dossierlake.lexicons.fixed_values import CHAPTER_SYNONYMS
from dossierlake.operators import ingest as IN

# XML names of the office formats and the signature of an encrypted file.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SLIDES = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
COMPOUND_FILE = b"\xd0\xcf\x11\xe0"
PARSED = (
    "file_path string, paragraphs array<struct<text:string,heading:boolean>>, "
    "pages array<struct<page_no:int,text:string,section_title:string>>, error string"
)


def _docx(content: bytes) -> tuple[list, list]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml"))
    rows = []
    for paragraph in body.iter(f"{WORD}p"):
        style = paragraph.find(f"{WORD}pPr/{WORD}pStyle")
        name = (style.get(f"{WORD}val") or "") if style is not None else ""
        text = "".join(t.text or "" for t in paragraph.iter(f"{WORD}t"))
        rows.append({"text": text, "heading": name.lower().startswith("heading")})
    return rows, []


def _pptx(content: bytes) -> tuple[list, list]:
    if content.startswith(COMPOUND_FILE):
        raise ValueError("password protected")
    pages = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = {n.lower() for n in archive.namelist()}
        if names & {"encryptioninfo", "encryptedpackage"}:
            raise ValueError("password protected")
        slides = sorted(
            (n for n in archive.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)),
            key=lambda n: int(re.search(r"\d+", n).group()),
        )
        for number, name in enumerate(slides, start=1):
            root = ElementTree.fromstring(archive.read(name))
            shapes = []
            for shape in root.iter(f"{SLIDES}sp"):
                lines = ["".join(t.text or "" for t in p.iter(f"{DRAWING}t")) for p in shape.iter(f"{DRAWING}p")]
                if any(line.strip() for line in lines):
                    shapes.append("\n".join(lines).strip())
            if shapes:
                pages.append({"page_no": number, "text": "\n".join(shapes), "section_title": shapes[0]})
    return [], pages


def _pdf(content: bytes) -> tuple[list, list]:
    try:
        import fitz
    except ImportError as exc:
        raise NotImplementedError("no PDF library installed") from exc
    with fitz.open(stream=content, filetype="pdf") as document:
        if document.needs_pass:
            raise ValueError("password protected")
        texts = [page.get_text("text") for page in document]
    return [], [{"page_no": i, "text": t, "section_title": ""} for i, t in enumerate(texts, start=1) if t.strip()]


READERS = {"docx": _docx, "pptx": _pptx, "pdf": _pdf}


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Dispatch by suffix; a file that cannot be read becomes a row with its error."""
    for batch in batches:
        rows = []
        for path, content in zip(batch["file_path"], batch["content"]):
            reader = READERS.get(path.rsplit(".", 1)[-1].lower())
            try:
                if reader is None:
                    raise NotImplementedError("unsupported parser")
                paragraphs, pages = reader(bytes(content))
                rows.append((path, paragraphs, pages, None))
            except Exception as exc:  # one broken file must not end the job
                rows.append((path, [], [], f"{type(exc).__name__}: {exc}"[-800:]))
        yield pd.DataFrame(rows, columns=["file_path", "paragraphs", "pages", "error"])


def parse_files(files: DataFrame) -> DataFrame:
    """(file_path, paragraphs, pages, error) of scanned files with content."""
    return files.select("file_path", "content").mapInPandas(_parse_batches, PARSED)


def units_of_files(parsed: DataFrame, groups: Groups = CHAPTER_SYNONYMS) -> DataFrame:
    """Paragraph files are bundled, page files keep their pages; headings are carried over both."""
    rows = parsed.filter(F.col("error").isNull())
    cleaned = F.filter(
        F.transform("paragraphs", lambda p: F.struct(clean_text(p["text"]).alias("text"), p["heading"].alias("heading"))),
        lambda p: p["text"] != "",
    )
    bundled = IN.with_units(rows.withColumn("paragraphs", cleaned))
    pages = F.filter(
        F.transform(
            "pages",
            lambda p: F.struct(
                p["page_no"].alias("page_no"), clean_text(p["text"]).alias("text"),
                clean_text(p["section_title"]).alias("section_title"),
            ),
        ),
        lambda p: p["text"] != "",
    )
    both = bundled.withColumn("units", F.when(F.size("pages") > 0, pages).otherwise(F.col("units"))).withColumn(
        "paged", F.size("pages") > 0
    )
    units = IN.with_headings(both.drop("pages", "error"), groups)
    page = F.col("page_no").cast("string")
    label = F.when(F.col("paged"), L.display_page(F.col("unit_text"), page)).otherwise(page)
    return units.withColumn("display_page", label).drop("paged")
