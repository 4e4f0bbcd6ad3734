"""Spreadsheets as chunks of text, and what such chunks say of their sheet."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx


def head_lines(name: Column, headers: Column, n_rows: Column, detected: Column) -> Column:
    """The lines that each chunk of a sheet begins with."""
    columns = F.concat(F.lit("Columnas: "), F.array_join(headers, ", "))
    return F.concat_ws("\n", F.lit("Documento tipo: Excel"), F.concat(F.lit("Hoja: "), name), columns, F.format_string("Total de columnas: %d", F.size(headers)), F.format_string("Total de filas de datos: %d", n_rows), F.concat(F.lit("Encabezados detectados: "), F.when(detected, "si").otherwise("no")))


def sheet_chunks(sheets: DataFrame, rows: DataFrame, size: int = lx.CHUNK_SIZE) -> DataFrame:
    """document_id, sheet, chunk_index, content.

    `sheets`: document_id, sheet, headers, detected. `rows`: document_id, sheet,
    number, line. As many rows go to a chunk as fit in `size` characters with the
    sheet's lines before them, one at least; a sheet without rows is one chunk. The
    fold is per sheet, which the format bounds to 2^20 rows.
    """
    counts = rows.groupBy("document_id", "sheet").agg(F.count("*").alias("n"))
    both = sheets.join(counts, ["document_id", "sheet"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    both = both.select("document_id", "sheet", head_lines(F.col("sheet"), F.col("headers"), F.col("n"), F.col("detected")).alias("head"))
    lined = both.join(rows.select("document_id", "sheet", "number", "line"), ["document_id", "sheet"], "left")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf["head"].iloc[0]
        own = pdf[pdf["number"].notna()].sort_values("number")
        blocks: list[list[tuple[int, str]]] = []
        length = 0
        for number, line in zip(own["number"].astype("int64"), own["line"]):
            first = blocks[-1][0][0] if blocks else number
            title = len(f"\nBloque de filas: {first}-{number}")
            if blocks and len(head) + title + length + 1 + len(line) <= size:
                blocks[-1].append((number, line))
                length += 1 + len(line)
            else:
                blocks.append([(number, line)])
                length = 1 + len(line)
        texts = ["\n".join([head, f"Bloque de filas: {b[0][0]}-{b[-1][0]}", *(x for _, x in b if x)]) for b in blocks] or [head]
        return pd.DataFrame({"document_id": pdf["document_id"].iloc[0], "sheet": pdf["sheet"].iloc[0], "chunk_index": range(len(texts)), "content": texts})

    kind = rows.schema["document_id"].dataType.simpleString()
    return lined.groupBy("document_id", "sheet").applyInPandas(fold, f"document_id {kind}, sheet string, chunk_index int, content string")


def overviews(chunks: DataFrame) -> DataFrame:
    """document_id, columns, rows: what the first lines of each kind say, null if there is none."""
    lines = chunks.select("document_id", "chunk_index", F.posexplode(F.split("content", "\n")).alias("at", "raw")).withColumn("line", F.trim("raw"))
    place = F.struct("chunk_index", "at")

    def first(prefix: str) -> Column:
        mine = F.col("line").startswith(prefix)
        return F.min_by(F.when(mine, F.trim(F.substring("line", len(prefix) + 1, 1 << 30))), F.when(mine, place))

    return lines.groupBy("document_id").agg(first("Columnas:").alias("columns"), first("Total de filas de datos:").alias("rows"))


def numeric_field(rows: DataFrame, columns: list[str], question: str) -> str:
    """The field that is asked for: a column that the question names, else a usual one, that
    holds a number in any row of `rows` (pairs); one aggregation tells of all."""
    from ..functions.intent import norm

    asked = [c for c in map(norm, columns) if c and c in question]
    wanted = list(dict.fromkeys([*asked, *lx.NUMERIC_FIELDS]))
    held = rows.agg(*[F.max(tx.locale_number(F.try_element_at("pairs", F.lit(c))).isNotNull()).alias(f"c{i}") for i, c in enumerate(wanted)]).first()
    return next((c for c, ok in zip(wanted, held) if ok), "")
