"""Reading documents of several formats into (document_id, path, file_type, text), and writing tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits of uploads, in bytes, and types by extension.
MAX_DOCUMENT, MAX_IMAGE = 25 * 1024 * 1024, 10 * 1024 * 1024
TYPES = {
    "txt": "text", "md": "text", "csv": "csv", "pdf": "pdf", "docx": "docx", "xlsx": "excel", "xls": "excel",
    "jpg": "image", "jpeg": "image", "png": "image", "gif": "image", "webp": "image", "bmp": "image", "tif": "image", "tiff": "image",
}
MIME_TYPES = {
    "text/plain": "text", "text/csv": "csv", "application/csv": "csv", "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "excel", "application/vnd.ms-excel": "excel",
}


def file_type(path: Column, mime: Column) -> Column:
    """By extension, else by MIME type without its parameters: its own name where it is none of the
    known ones, unknown where there is none."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    kind = F.lower(F.trim(F.substring_index(F.coalesce(mime, F.lit("")), ";", 1)))
    known = lambda key, names: F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key)
    by_mime = F.when(kind.startswith("image/"), "image").when(kind == "", "unknown").otherwise(kind)
    return F.coalesce(known(ext, TYPES), known(kind, MIME_TYPES), by_mime)


def object_name(key: Column) -> Column:
    """The file name of `tenant/number_name`."""
    return F.regexp_replace(F.element_at(F.split(key, "/"), -1), r"^[^_]*_", "")


def csv_text(raw: str) -> str:
    """Rows as cells joined by bars; blank cells and rows go; ragged rows and stray quotes are taken as they come."""
    import csv

    rows = ([c.strip() for c in r if c.strip()] for r in csv.reader(io.StringIO(raw), skipinitialspace=True))
    return "\n".join(" | ".join(r) for r in rows if r)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_text(data: bytes) -> str:
    """Body, headers, footers and notes of a word document."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        parts = [n for k in ("document", "header", "footer", "footnotes", "endnotes") for n in sorted(names) if n.startswith(f"word/{k}") and n.endswith(".xml")]
        lines = []
        for part in parts:
            for p in ElementTree.fromstring(z.read(part)).iter(f"{_W}p"):
                text = "".join({f"{_W}t": e.text or "", f"{_W}tab": "\t", f"{_W}br": "\n"}.get(e.tag, "") for e in p.iter())
                lines.append(text.strip())
        return "\n".join(x for x in lines if x)


def xlsx_rows(data: bytes) -> list[tuple[str, int, list[str]]]:
    """(sheet, row number, cells) of all sheets, shared and inline strings resolved; empty rows go."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        titles = [s.get("name", "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
        out = []
        sheets = sorted((n for n in names if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))
        for title, name in zip(titles, sheets):
            for row in ElementTree.fromstring(z.read(name)).iter(f"{_S}row"):
                cells: dict[int, str] = {}
                for c in row.iter(f"{_S}c"):
                    letters = "".join(x for x in c.get("r", "A") if x.isalpha())
                    at = 0
                    for x in letters:
                        at = at * 26 + ord(x) - 64
                    v = c.find(f"{_S}v")
                    text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if v is None else v.text or ""
                    cells[at] = shared[int(text)] if c.get("t") == "s" and text else text
                if any(x.strip() for x in cells.values()):
                    out.append((title, int(row.get("r", "0")), [cells.get(i, "").strip() for i in range(1, max(cells) + 1)]))
        return out


def xlsx_text(data: bytes) -> str:
    """Sheets as the lines that tabular answers read."""
    lines = ["Documento tipo: Excel"]
    by_sheet: dict[str, list] = {}
    for sheet, number, cells in xlsx_rows(data):
        by_sheet.setdefault(sheet, []).append((number, cells))
    for sheet, rows in by_sheet.items():
        (_, header), *body = rows
        lines += [f"Hoja: {sheet}", "Columnas: " + " | ".join(header), f"Total de filas de datos: {len(body)}"]
        lines += [f"Fila {n}: " + ", ".join(f"{h} = {v}" for h, v in zip(header, cells) if v) for n, cells in body]
    return "\n".join(lines)


def read_documents(spark: SparkSession, path: str, mimes: DataFrame | None = None) -> DataFrame:
    """All files under `path`: path, file_type, sha256, size, text, status. Files over the limits, of
    unknown types, or broken get a status and no text; PDF and image text comes from elsewhere.
    `mimes` (file, mime), as uploads told them by file name, decides where an extension doesn't."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    mime = F.lit("")
    if mimes is not None:
        told = mimes.groupBy("file").agg(F.min("mime").alias("mime"))
        files = files.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(told, "file", "left")
        mime = F.col("mime")
    typed = files.select("path", "length", F.sha2("content", 256).alias("sha256"), file_type(F.col("path"), mime).alias("file_type"), "content")
    limit = F.when(F.col("file_type") == "image", MAX_IMAGE).otherwise(MAX_DOCUMENT)
    typed = typed.withColumn("content", F.when(F.col("length") <= limit, F.col("content")))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = {"text": lambda d: d.decode("utf-8", "replace"), "csv": lambda d: csv_text(d.decode("utf-8", "replace")), "docx": docx_text, "excel": xlsx_text}
        for b in batches:
            texts, states = [], []
            for kind, data in zip(b["file_type"], b["content"]):
                text, state = None, "too_large" if data is None else "unsupported_format"
                if data is not None and kind in kinds:
                    try:
                        text = kinds[kind](bytes(data))
                        state = "parsed" if text.strip() else "no_text"
                    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError):
                        state = "failed_parse"
                texts.append(text)
                states.append(state)
            yield b.drop(columns="content").assign(text=texts, status=states)

    return typed.mapInPandas(parse, "path string, length long, sha256 string, file_type string, text string, status string")


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Append to a table of Parquet files, in folders by tenant if asked."""
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)
