"""Choosing chunks by document quotas, coverage, priorities and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def _doc():
    return Window.partitionBy("document_id")



def quota(chunks: DataFrame, limit: int, order: list) -> DataFrame:
    """Up to limit div documents (1 at least) chunks of each document first, then the rest in order."""
    docs = chunks.agg(F.greatest(F.lit(1), F.expr(f"{limit} div greatest(1, count(distinct document_id))")).alias("each"))
    found = chunks.withColumn("own", F.row_number().over(_doc().orderBy(*order)))
    # A document never gives more than the limit, so the sort sees few rows of each.
    found = found.filter(F.col("own") <= limit).crossJoin(F.broadcast(docs))
    over = F.col("own") > F.col("each")
    return found.orderBy(over, *order).limit(limit).drop("own", "each")


def coverage(chunks: DataFrame, least: int = 2, limit: int = 20) -> DataFrame:
    """The best `least` chunks of each document, then the best of all, up to `limit`."""
    order = [F.desc("score"), F.asc("chunk_index"), F.asc("chunk_id")]
    found = chunks.withColumn("own", F.row_number().over(_doc().orderBy(*order))).filter(F.col("own") <= limit)
    first = F.col("own") <= least
    return found.orderBy((~first).asc(), F.when(first, F.col("document_id")), F.when(first, F.col("own")), *order, "document_id").limit(limit).drop("own")


def limit_documents(chunks: DataFrame, order: list, documents: int = 5, limit: int = 20) -> DataFrame:
    """Chunks of the first documents as they appear: the first of each, then the others document by document."""
    found = chunks.filter(F.trim("document_id") != "").withColumn("own", F.row_number().over(_doc().orderBy(*order))).filter(F.col("own") <= limit)
    first = found.filter("own = 1").orderBy(*order).limit(documents)
    place = first.select(F.col("document_id").alias("d"), F.row_number().over(Window.orderBy(*order)).alias("place"))
    kept = found.join(F.broadcast(place), F.col("document_id") == F.col("d"))
    return kept.orderBy((F.col("own") > 1).asc(), "place", "own").limit(limit).drop("own", "d", "place")


def union_by_priority(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Both sets; of rows of one key the one of `first` stays."""
    both = first.withColumn("priority", F.lit(0)).unionByName(second.withColumn("priority", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("priority"))
    return both.withColumn("rank", rank).filter("rank = 1").drop("rank")


def last_turns(turns: DataFrame, user: list[str], order: list[str], n: int = 5) -> DataFrame:
    """Each user's newest `n` turns, newest first."""
    rank = F.row_number().over(Window.partitionBy(*user).orderBy(*[F.desc(c) for c in order]))
    return turns.withColumn("age", rank).filter(F.col("age") <= n)


def without_repeats(lines: DataFrame, by: str, order: str, key: Column) -> DataFrame:
    """Without lines whose key equals the line before's."""
    before = F.lag("__key").over(Window.partitionBy(by).orderBy(order))
    return lines.withColumn("__key", key).withColumn("__before", before).filter(F.col("__before").isNull() | (F.col("__key") != F.col("__before"))).drop("__key", "__before")


def window_of_share(chunks: DataFrame, share: float = 0.2) -> DataFrame:
    """The last `share` of each document's chunks, one at least."""
    n, at = F.count("*").over(_doc()), F.row_number().over(_doc().orderBy("chunk_index", "chunk_id"))
    return chunks.withColumn("__n", n).withColumn("__at", at).filter(F.col("__at") > F.col("__n") - F.greatest(F.lit(1), F.floor(F.col("__n") * share))).drop("__n", "__at")


def thirds(chunks: DataFrame) -> DataFrame:
    """With `part` 0 to 2: where in its document a chunk lies."""
    n, at = F.count("*").over(_doc()), F.row_number().over(_doc().orderBy("chunk_index", "chunk_id")) - 1
    size = F.greatest(F.lit(1), F.ceil(n / 3))
    return chunks.withColumn("part", F.least(F.lit(2), F.floor(at / size)).cast("int"))


def numbered(chunks: DataFrame, order: list[str]) -> DataFrame:
    return chunks.withColumn("chunk_index", (F.row_number().over(_doc().orderBy(*order)) - 1).cast("int"))


def nearest_anchor(chunks: DataFrame, is_anchor: Column) -> DataFrame:
    """With `distance` to the nearest chunk of the document that is an anchor; null without one."""
    place = F.when(is_anchor, F.col("chunk_index"))
    before = F.last(place, True).over(_doc().orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(place, True).over(_doc().orderBy("chunk_index").rowsBetween(0, Window.unboundedFollowing))
    return chunks.withColumn("distance", F.least(F.col("chunk_index") - before, after - F.col("chunk_index")))
