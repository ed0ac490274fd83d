"""Documents from files and into files: text, word-processor documents, zip batches; format by extension.

Readers give (path, ext, text, error): a file that cannot be read gets an error and a null text, and the others go on.
Files beyond MAX_BYTES and of other extensions are refused the same way. Text is UTF-8 with replacements and ``\\n`` breaks.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 16 * 1024 * 1024
EXTENSIONS = ("txt", "docx", "pdf")
SCHEMA = "path string, ext string, text string, error string"
WORDS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BREAKS = str.maketrans({c: "\n" for c in "\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"})


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def plain(data: bytes) -> str:
    return data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n").translate(BREAKS)


def docx_paragraphs(data: bytes) -> list[str]:
    """Texts of the body's own paragraphs; tables, headers and footers are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORDS}body")
    kinds = {f"{WORDS}t": lambda e: e.text or "", f"{WORDS}tab": lambda e: "\t", f"{WORDS}br": lambda e: "\n"}
    return ["".join(kinds[e.tag](e) for e in p.iter() if e.tag in kinds) for p in body.findall(f"{WORDS}p")]


def pdf_text(data: bytes) -> str:
    """Needs an optional library; without it a PDF is an unreadable file."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("no PDF reader is installed") from e
    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)


def read_one(path: str, data: bytes) -> tuple[str, str, str | None, str | None]:
    ext = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    try:
        if ext not in EXTENSIONS:
            raise ValueError(f"unsupported file type {ext!r}")
        if len(data) > MAX_BYTES:
            raise ValueError(f"more than {MAX_BYTES} bytes")
        text = plain(data) if ext == "txt" else "\n".join(docx_paragraphs(data)) if ext == "docx" else pdf_text(data)
        if not text.strip():
            raise ValueError("no text")
        return path, ext, text, None
    except Exception as e:  # whatever is wrong with one file is its row's error
        return path, ext, None, str(e) or type(e).__name__


def _frames(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["path", "ext", "text", "error"])


def parsed(files: DataFrame) -> DataFrame:
    """SCHEMA rows of a table (path, content)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _frames([read_one(p, bytes(c)) for p, c in zip(b["path"], b["content"], strict=True)])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def unzipped(files: DataFrame) -> DataFrame:
    """SCHEMA rows of the documents in zip files (path, content); hidden resource entries and other types are passed over."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, c in zip(b["path"], b["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(c))) as z:
                        names = [n for n in z.namelist() if n.rsplit(".", 1)[-1].lower() in EXTENSIONS and not n.startswith("__MACOSX")]
                        rows += [read_one(f"{p}!{n}", z.read(n)) for n in names]
                except zipfile.BadZipFile as e:
                    rows.append((p, "zip", None, str(e)))
            yield _frames(rows)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """All files below a path."""
    return parsed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def read_zips(spark: SparkSession, path: str) -> DataFrame:
    """The documents within the zip files below a path."""
    return unzipped(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path))


def as_zip(names: Column, contents: Column) -> Column:
    """Binary column of zip files from arrays of names and contents."""

    def run(many: pd.Series, data: pd.Series) -> pd.Series:
        def one(entries, bodies) -> bytes:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for n, c in zip(entries, bodies, strict=True):
                    z.writestr(zipfile.ZipInfo(n), bytes(c))
            return out.getvalue()

        return pd.Series([one(n, c) for n, c in zip(many, data, strict=True)])

    return F.pandas_udf(run, "binary")(names, contents)


def docx_bytes(text: str) -> bytes:
    """A word-processor document with a paragraph for each line."""
    escape = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;"})
    paras = "".join(f'<w:p><w:r><w:t xml:space="preserve">{line.translate(escape)}</w:t></w:r></w:p>' for line in text.split("\n"))
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<w:document xmlns:w="{WORDS[1:-1]}"><w:body>{paras}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def as_docx(texts: Column) -> Column:
    """Binary column of word-processor documents, for a sink that stores files."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: docx_bytes(t or ""))

    return F.pandas_udf(run, "binary")(texts)


def write_text(df: DataFrame, path: str, column: str = "text") -> None:
    """One line-separated text data set."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
