"""Spreadsheet text: rows written as lines, parsed back, and answered from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def column_letters(n: Column) -> Column:
    """1 is A, 26 Z, 27 AA, and so on, up to 12 letters; numbers below 1 have none."""
    start = F.struct(n.cast("long").alias("left"), F.lit("").alias("text"))

    def step(x: Column, _: Column) -> Column:
        last = F.chr(65 + (x["left"] - 1) % 26)
        return F.when(x["left"] > 0, F.struct(F.floor((x["left"] - 1) / 26).alias("left"), F.concat(last, x["text"]).alias("text"))).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(12)), start, step, lambda x: x["text"])


def two_places(x: Column) -> Column:
    """A number with two decimals. Rounding alone loses the sign of what becomes zero, which `%.2f` writes."""
    size = F.format_string("%.2f", F.abs(F.round(x, 2)))
    return F.when(x.cast("string").startswith("-"), F.concat(F.lit("-"), size)).otherwise(size)


def row_line(number: Column, headers: list[str], values: list[Column]) -> Column:
    """`Fila n: h = v, ...` without blank values."""
    pairs = [F.when(F.trim(v.cast("string")) != "", F.concat(F.lit(f"{h} = "), v.cast("string"))) for h, v in zip(headers, values)]
    return F.concat(F.lit("Fila "), number.cast("string"), F.lit(": "), F.concat_ws(", ", *pairs))


def parse_rows(lines: DataFrame) -> DataFrame:
    """With `row` and `pairs` for each `Fila n:` line of `content`; other lines go."""
    found = lines.filter(F.col("content").rlike(r"^\s*Fila [0-9]+:"))
    row = F.regexp_extract("content", r"^\s*Fila ([0-9]+):", 1).cast("long")
    body = F.regexp_replace("content", r"^\s*Fila [0-9]+:", "")
    return tx.once(found, row=row, pairs=tx.row_pairs(body))


def field(name: str) -> Column:
    """The value of the field that `name` equals, or else the longest one that holds it or lies in it."""
    pairs = F.map_entries(F.col("pairs"))
    near = F.filter(pairs, lambda e: e["key"].contains(name) | F.lit(name).contains(e["key"]))
    best = F.array_max(F.transform(near, lambda e: F.struct((e["key"] == name).alias("same"), F.length(e["key"]).alias("n"), e["key"].alias("k"), e["value"].alias("v"))))
    return best["v"]


def label() -> Column:
    """Who a row is about: the usual fields, or else the first value that is no number, by key."""
    names = [F.try_element_at("pairs", F.lit(k)) for k in ("cliente", "nombre", "persona", "usuario")]
    other = F.array_min(F.transform(F.filter(F.map_entries("pairs"), lambda e: tx.locale_number(e["value"]).isNull()), lambda e: F.struct(e["key"], e["value"])))
    return F.coalesce(*names, other["value"])


def numeric_summary(rows: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, least and greatest of a field with the rows that have them; the first row wins ties."""
    v = tx.once(rows, value=tx.locale_number(field(name))).filter("value is not null")
    return v.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        F.round(F.avg("value"), 6).alias("mean"),
        F.min(F.struct("value", "row")).alias("low"),
        F.max(F.struct(F.col("value"), (-F.col("row")).alias("neg"))).alias("high"),
    ).select(*(by or []), "n", "mean", F.col("low.value").alias("least"), F.col("low.row").alias("least_row"), F.col("high.value").alias("greatest"), (-F.col("high.neg")).alias("greatest_row"))


def above(rows: DataFrame, name: str, threshold: float) -> DataFrame:
    return tx.once(rows, value=tx.locale_number(field(name))).filter(F.col("value") > threshold)


def row_count(lines: DataFrame) -> DataFrame:
    """A document's declared total, or else how many row lines it has."""
    total = F.regexp_extract("content", r"Total de filas de datos: *([0-9]+)", 1).try_cast("long")
    return lines.groupBy("document_id").agg(F.coalesce(F.min(total), F.count_if(F.col("content").rlike(r"^\s*Fila [0-9]+:"))).alias("rows"))


def header_is_first(first: Column, second: Column) -> Column:
    """Whether row 1 is a header: distinct texts without numbers, and row 2 has a number or is no header."""
    def texts(cells: Column) -> Column:
        return F.filter(F.transform(cells, lambda x: F.trim(x)), lambda c: c != "")

    def header(cells: Column) -> Column:
        t = texts(cells)
        return (F.size(t) > 0) & (F.size(F.array_distinct(F.transform(t, tx.norm))) == F.size(t)) & ~F.exists(t, lambda c: tx.locale_number(c).isNotNull())

    data = F.exists(texts(second), lambda c: tx.locale_number(c).isNotNull())
    return header(first) & (data | ~header(second))
