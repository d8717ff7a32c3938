"""Text documents from files: plain text, Markdown and CSV as text, PDF with its library, DOCX by its XML."""

from __future__ import annotations

import io
import os
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vsearch.runtime import ship
from vsearch.types import SourceError

# Fixed: the namespace of word-processing documents.
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Suffix to format.
FORMATS = {"txt": "text", "md": "text", "markdown": "text", "csv": "text", "pdf": "pdf", "docx": "docx"}


def decode_text(content: bytes) -> str:
    """UTF-8, or Latin-1 where that fails."""
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def decode_pdf(content: bytes) -> str:
    """Pages that aren't blank, with an empty line between them."""
    try:
        import fitz
    except ImportError as e:
        raise SourceError("reading PDF needs the package pymupdf") from e
    try:
        with fitz.open(stream=content, filetype="pdf") as doc:
            return "\n\n".join(t for t in (page.get_text() for page in doc) if t.strip())
    except Exception as e:
        raise SourceError(f"not a readable PDF: {e}") from e


def decode_docx(content: bytes) -> str:
    """Stripped paragraphs of the body that aren't empty, a line each; tables are left out."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, OSError, zlib.error) as e:
        raise SourceError(f"not a readable DOCX: {e}") from e
    if body is None:
        raise SourceError("not a readable DOCX: it has no body")
    written = {f"{_WORD}t": lambda x: x.text or "", f"{_WORD}tab": lambda x: "\t", f"{_WORD}br": lambda x: "\n", f"{_WORD}cr": lambda x: "\n"}
    paragraphs = ("".join(written[x.tag](x) for run in p.iter(f"{_WORD}r") for x in run if x.tag in written).strip() for p in body.findall(f"{_WORD}p"))
    return "\n".join(p for p in paragraphs if p)


DECODERS = {"text": decode_text, "pdf": decode_pdf, "docx": decode_docx}


def _suffix(path: str) -> str:
    return os.path.splitext(path)[1].lstrip(".").lower()


def parse_file(path: str) -> str:
    """The text of one local file, by its suffix."""
    kind = FORMATS.get(_suffix(path))
    if not os.path.isfile(path):
        raise SourceError(f"no such file: {path}")
    if kind is None:
        raise SourceError(f"unknown format: {path}")
    with open(path, "rb") as f:
        return DECODERS[kind](f.read())


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts, errors = [], []
        for path, content in zip(b["path"], b["content"]):
            try:
                texts.append(DECODERS[FORMATS[_suffix(path)]](bytes(content)))
                errors.append(None)
            except SourceError as e:
                texts.append(None)
                errors.append(str(e))
        yield pd.DataFrame({"path": b["path"], "text": texts, "error": errors})


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error) of every file of a known format at or below ``path``; text is NULL where error tells why.

    Files are read and decoded by the executors.
    """
    ship(spark)
    known = "|".join(FORMATS)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").filter(F.lower("path").rlike(rf"\.({known})$"))
    return files.mapInPandas(_decode, "path string, text string, error string")
