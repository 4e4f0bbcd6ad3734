"""The first characters of an ordered concatenation, without gathering what lies behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Chunks of neighbouring indexes whose lengths are added up first.
BLOCK = 256


def head_of_concatenation(chunks: DataFrame, line: Column, limit: int, *, by: str = "document_id", order: str = "chunk_index", separator: str = "\n") -> DataFrame:
    """`by`, text: the first `limit` characters of each group's lines in order, joined by `separator`.

    Lengths come first: those of blocks are summed, and running sums of blocks tell which begin
    within the limit. Only rows of these meet, and of them only those that begin within it,
    so a group of any number of chunks costs `limit` characters and one block. Lines of equal order
    go by their text; null lines are left out.
    """
    rows = chunks.select(F.col(by).alias("of"), F.col(order).alias("at"), line.alias("line")).filter(F.col("line").isNotNull())
    rows = rows.withColumn("block", F.floor(F.col("at") / BLOCK)).withColumn("size", F.length("line") + F.length(F.lit(separator)))
    before = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = rows.groupBy("of", "block").agg(F.sum("size").alias("size"))
    blocks = blocks.withColumn("start", before(Window.partitionBy("of").orderBy("block"))).filter(F.col("start") <= limit).drop("size")
    own = rows.join(blocks, ["of", "block"]).withColumn("from", F.col("start") + before(Window.partitionBy("of", "block").orderBy("at", "line")))
    # One that begins right behind the limit tells that a separator is the last character.
    own = own.filter(F.col("from") <= limit).select("of", F.struct("at", F.substring(F.col("line"), F.lit(1), F.least(F.length("line"), F.lit(limit))).alias("line")).alias("x"))
    parts = own.groupBy("of").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return parts.select(F.col("of").alias(by), F.substring(F.array_join("x.line", separator), 1, limit).alias("text"))
