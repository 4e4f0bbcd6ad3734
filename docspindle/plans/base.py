"""The model's tables made from the test tables, in DataFrame and SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx

#: Queries ask for these; the texts hold them.
QUERY = "thble thing attion"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """document_id, tenant_id, collection_id, text."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.col("lang").alias("tenant_id"), F.col("source").alias("collection_id"), "text")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of every text is a chunk."""
    lines = docs(spark, sf).select("document_id", "tenant_id", "collection_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    return lines.withColumn("chunk_id", F.concat_ws("-", "document_id", "chunk_index"))


DOCS = "SELECT doc_id AS document_id, lang AS tenant_id, source AS collection_id, text FROM documents"
CHUNKS = """SELECT *, CAST(document_id AS VARCHAR) || '-' || CAST(chunk_index AS VARCHAR) AS chunk_id FROM (
  SELECT document_id, tenant_id, collection_id, CAST(i - 1 AS INTEGER) AS chunk_index, parts[i] AS content FROM (
    SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (
      SELECT doc_id AS document_id, lang AS tenant_id, source AS collection_id, string_split(text, chr(10)) AS parts FROM documents)))"""


def quoted(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


def sql_norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(strip_accents(lower(trim({x}))),'\p{{Mn}}+','','g'),'[^\p{{L}}\p{{N}}]+',' ','g'))"


def sql_tokens(n: str) -> str:
    return f"list_filter(string_split({n}, ' '), lambda w: w <> '')"


def sql_terms(n: str) -> str:
    """Distinct terms; their order is not kept."""
    return f"list_distinct(list_filter(string_split({n}, ' '), lambda w: len(w) >= 2 AND w NOT IN ({quoted(lx.STOP_WORDS)})))"


def sql_whole(words: str, term: str) -> str:
    return f"len(list_filter({words}, lambda w: w = '{term}'))"


def sql_any(n: str, parts) -> str:
    return "(" + " OR ".join(f"contains({n}, '{p}')" for p in parts) + ")"


#: Chunks with normalised text and words.
PREPARED = f"SELECT *, {sql_tokens('norm')} AS words FROM (SELECT *, {sql_norm('content')} AS norm FROM ({CHUNKS}))"
