"""Titled sections of documents: a title holds until the next, tiny sections join, a dozen remain."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import display as dp
from ..functions import text as tx

#: Fixed value: how titles that are made, not found, begin.
PART = "Parte "


def title_of(content: Column) -> Column:
    """The first line that is a heading, without dashes around it, a closing colon and doubled spaces; null without one."""
    lines = F.transform(F.split(F.regexp_replace(content, "\r\n", "\n"), "\n"), lambda x: F.trim(x))
    line = F.get(F.filter(lines, dp.summary_heading), 0)
    bare = F.regexp_replace(F.regexp_replace(line, "^[- ]+|[- ]+$", ""), ":$", "")
    return F.nullif(F.trim(F.regexp_replace(bare, r"\s+", " ")), F.lit(""))


def titled(chunks: DataFrame, gap: int = 2) -> DataFrame:
    """With `section`, numbered from 1 in each document, and `title`, null where none was found.

    A section begins with a document, after more than `gap` missing indexes, or at a title that
    differs, normalised, from the title in force. Only running windows over a document's chunks
    are used, so none is held whole; chunks without an index come first. Chunks are in order of
    chunk_index, then chunk_id.
    """
    order = Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id")
    found = tx.once(chunks, __title=title_of(F.col("content")))
    found = found.withColumns({"__key": tx.norm(F.col("__title")), "__row": F.row_number().over(order), "__before": F.lag("chunk_index").over(order)})
    found = found.withColumn("__cut", (F.col("__row") == 1) | F.coalesce(F.col("chunk_index") - F.col("__before") > gap, F.lit(False)))
    # The title in force is the last one found, or none since the last cut.
    told = F.when(F.col("__title").isNotNull(), F.struct(F.col("__key").alias("k"))).when(F.col("__cut"), F.struct(F.lit(None).cast("string").alias("k")))
    force = F.last(told, True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("__cut") | (F.col("__title").isNotNull() & ~F.col("__key").eqNullSafe(force["k"]))
    found = found.withColumn("__new", new).withColumn("section", F.sum(F.col("__new").cast("int")).over(order).cast("int"))
    title = F.last(F.when(F.col("__new"), F.struct(F.col("__title").alias("t"))), True).over(order)
    return found.withColumn("title", title["t"]).drop("__title", "__key", "__row", "__before", "__cut", "__new")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sections in order (…, fresh, near, big, made) -> the same with `part`; what is carried is three values."""
    part, big, made = 0, False, False
    for b in batches:
        parts = []
        for fresh, near, own_big, own_made in zip(*(b.column(c).to_pylist() for c in ("fresh", "near", "big", "made"))):
            if not fresh and near and (made or own_made) and not (big and own_big):
                big = True
            else:
                part, big, made = 1 if fresh else part + 1, own_big, own_made
            parts.append(part)
        yield b.append_column("part", pa.array(parts, pa.int32()))


def _made(title: Column) -> Column:
    return title.startswith(PART)


def summary_sections(chunks: DataFrame, gap: int = 2, most: int = 12) -> DataFrame:
    """document_id, place, title, chunks, first, last, line: at most `most` sections of each document.

    A section without a title is called after its number. Of neighbours without a missing index
    between them, of which one has such a name and one is a single chunk, the second joins
    the first. What then exceeds `most` is joined in runs of equal length, under the first found title.
    """
    s = titled(chunks, gap).groupBy("document_id", "section").agg(F.max("title").alias("found"), F.count("*").alias("chunks"), F.min("chunk_index").alias("first"), F.max("chunk_index").alias("last"))
    by_doc = Window.partitionBy("document_id").orderBy("section")
    s = s.withColumn("title", F.coalesce("found", F.concat(F.lit(PART), F.col("section").cast("string"))))
    s = s.withColumns({"fresh": F.col("section") == 1, "near": F.coalesce(F.col("first") - F.lag("last").over(by_doc) <= 1, F.lit(True)), "big": F.col("chunks") > 1, "made": _made(F.col("title"))}).drop("found")
    s = s.repartition("document_id").sortWithinPartitions("document_id", "section")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in s.schema.fields) + ", part int"
    at = F.struct("section")
    m = s.mapInArrow(_merged, schema).groupBy("document_id", "part").agg(F.min_by("title", at).alias("title"), F.sum("chunks").alias("chunks"), F.min("first").alias("first"), F.max("last").alias("last"))
    size = F.ceil(F.max("part").over(Window.partitionBy("document_id")) / most)
    m = m.withColumn("place", (F.floor((F.col("part") - 1) / size) + 1).cast("int"))
    best = F.coalesce(F.min_by(F.when(~_made(F.col("title")), F.col("title")), F.struct(_made(F.col("title")), "part")), F.min_by("title", "part"))
    out = m.groupBy("document_id", "place").agg(best.alias("title"), F.sum("chunks").alias("chunks"), F.min("first").alias("first"), F.max("last").alias("last"))
    head = F.concat(F.col("place").cast("string"), F.lit(". "), F.col("title"), F.lit(" (chunks: "), F.col("chunks").cast("string"))
    span = F.when(F.col("first") >= 0, F.concat(F.lit(", rango: "), F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string")))
    return out.withColumn("line", F.concat(head, F.coalesce(span, F.lit("")), F.lit(")")))


def sample(chunks: DataFrame) -> DataFrame:
    """The first, middle and last chunk of each document, each once, by chunk_index, then chunk_id."""
    n = F.count("*").over(Window.partitionBy("document_id"))
    at = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id")) - 1
    c = chunks.withColumns({"__n": n, "__at": at})
    return c.filter((F.col("__at") == 0) | (F.col("__at") == F.floor(F.col("__n") / 2)) | (F.col("__at") == F.col("__n") - 1)).drop("__n", "__at")
