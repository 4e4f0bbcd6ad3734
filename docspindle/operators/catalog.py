"""Documents, collections, tags, favourites and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .concat import head_of_concatenation


def display_name(original: Column, logical: Column, stored: Column) -> Column:
    blank = F.lit("")
    return F.coalesce(F.nullif(original, blank), F.nullif(logical, blank), F.nullif(stored, blank), F.lit("Documento cargado"))


def collection_documents(documents: DataFrame, collections: DataFrame, tenant: str, collection: str) -> DataFrame:
    """Documents of one collection of one tenant; the other side of the join is one row."""
    one = collections.filter((F.col("tenant_id") == tenant) & (F.col("collection_id") == collection))
    return documents.join(one.select("tenant_id", "collection_id", "name"), ["tenant_id", "collection_id"])


def collection_counts(collections: DataFrame, documents: DataFrame) -> DataFrame:
    """All collections with how many documents each has; documents are counted before the join."""
    n = documents.groupBy("tenant_id", "collection_id").agg(F.count("document_id").alias("documents"))
    return collections.join(n, ["tenant_id", "collection_id"], "left").withColumn("documents", F.coalesce("documents", F.lit(0)))


def documents_by_tag(documents: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    return documents.join(tags.filter(F.col("tag") == tag).select("document_id", "tag"), "document_id")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """`table` with `rows` added; a row replaces those of its key."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def insert_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.unionByName(rows.join(table.select(*keys), keys, "left_anti").dropDuplicates(keys))


def delete_keys(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def intersect_ids(*sets: DataFrame, key: str = "document_id") -> DataFrame:
    """Rows of the first whose id all the others have."""
    first, *rest = sets
    for s in rest:
        first = first.join(s.select(key), key, "left_semi")
    return first


def history(logs: DataFrame, user: str, limit: int = 20) -> DataFrame:
    return logs.filter(F.col("user_id") == user).orderBy(F.desc("created_at"), F.desc("log_id")).limit(min(limit, 20))


def first_chunk(chunks: DataFrame) -> DataFrame:
    """Each document's first chunk that isn't blank: an aggregation, no sort of documents."""
    row = F.struct("chunk_index", "content")
    return chunks.filter(F.trim("content") != "").groupBy("document_id").agg(F.min(row).alias("x")).select("document_id", "x.*")


def document_text(chunks: DataFrame, limit: int) -> DataFrame:
    """Each document's chunks in order, joined by lines, up to `limit` characters."""
    return head_of_concatenation(chunks.filter(F.trim("content") != ""), F.trim("content"), limit)


def newest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", rank).filter("rank = 1").drop("rank")


def effective_time(uploaded: Column, created: Column, otherwise: Column) -> Column:
    """When a document counts as uploaded: `otherwise` is the caller's clock, so that reruns agree."""
    return F.coalesce(uploaded, created, otherwise)
