"""Searches that read a stored index of lines as chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.intent import intent
from ..operators.index import ChunkIndex, batch_search
from ..sources.folders import work_folder
from .base import PREPARED, QUERY, chunks, sql_norm, sql_terms, table
from .retrieval import PLAIN
from .retrieval import QUERIES as SCANS

#: The indexes that this process has made, by session and folder of tables.
_MADE: dict[tuple[str, str], ChunkIndex] = {}


def index(s, sf) -> ChunkIndex:
    """The index of all lines, made once; the lines of odd documents are added in a second batch."""
    key = (s.sparkContext.applicationId, sf)
    if key not in _MADE:
        c = chunks(s, sf)
        made = ChunkIndex(s, work_folder(s, "index"), 16)
        made.add(c.filter("document_id % 2 = 0")).add(c.filter("document_id % 2 <> 0"))
        _MADE[key] = made
    return _MADE[key]


def indexed_search(s, sf):
    return index(s, sf).global_search(QUERY, 20).select("chunk_id", "score")


def indexed_phrase(s, sf):
    return index(s, sf).phrase_matches("Thing attion").select("chunk_id")


def indexed_keywords(s, sf):
    return index(s, sf).keyword_scores(intent(PLAIN)).select("chunk_id", F.round("score", 6).alias("score"))


def indexed_relaxed(s, sf):
    return index(s, sf).relaxed_scores(intent(PLAIN)).select("chunk_id", F.round("score", 6).alias("score"))


def batched_search(s, sf):
    """The five lines with most terms of each turn of the users, counted in blocks of all lines."""
    t = table(s, sf, "conversations").filter("role = 'user'")
    asked = t.select(F.concat_ws("-", "conv_id", "turn").alias("question"), tx.terms(tx.norm(F.col("text"))).alias("terms"))
    made = index(s, sf)
    return batch_search(asked, made.words("norm"), made.table("chunks"), n=made.count()).select("question", "rank", "chunk_id", "score")


_TERMS = [w for w in QUERY.lower().split() if len(w) >= 4]
_SCORE = " + ".join(f"CASE WHEN content ILIKE '%{t}%' THEN 1.0 ELSE 0.0 END" for t in _TERMS)

BATCHED_SQL = f"""
WITH q AS (SELECT DISTINCT question, unnest(t) AS word FROM (SELECT conv_id || '-' || turn AS question, {sql_terms(sql_norm("text"))} AS t FROM conversations WHERE role = 'user')),
c AS (SELECT document_id, chunk_index, chunk_id, unnest(list_distinct(words)) AS word FROM ({PREPARED})),
s AS (SELECT question, document_id, chunk_index, chunk_id, count(*) AS score FROM q JOIN c USING (word) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, document_id, chunk_index, chunk_id) AS rank FROM s)
SELECT question, CAST(rank AS INTEGER) AS rank, chunk_id, score FROM r WHERE rank <= 5
"""

QUERIES = {
    "indexed_search": (indexed_search, f"SELECT chunk_id, score FROM (SELECT *, CAST({_SCORE} AS DOUBLE) AS score FROM ({PREPARED})) WHERE score > 0 ORDER BY score DESC, document_id, chunk_index, chunk_id LIMIT 20"),
    "indexed_phrase": (indexed_phrase, SCANS["phrase_filter"][1]),
    "indexed_keywords": (indexed_keywords, SCANS["keyword_scores"][1]),
    "indexed_relaxed": (indexed_relaxed, SCANS["relaxed_scores"][1]),
    "batch_search": (batched_search, BATCHED_SQL),
}
