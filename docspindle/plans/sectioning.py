"""Titled sections and samples of documents, over all lines of all texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display as dp
from ..operators import sections
from .base import CHUNKS, chunks, sql_norm


def _titled(s, sf):
    """Every fifth line follows a title, three kinds of them in turn; every seventh index is followed by a gap."""
    c, i = chunks(s, sf), F.col("chunk_index")
    kinds = F.when(i % 15 == 0, F.concat(F.lit("2.1  Tema "), F.expr("chunk_index div 30"))).when(i % 15 == 5, F.lit("- DATOS GENERALES")).when(i % 15 == 10, F.lit("Anexo final:"))
    c = c.withColumn("content", F.concat(F.coalesce(F.concat(kinds, F.lit("\n")), F.lit("")), "content"))
    return c.withColumn("chunk_index", (i + 3 * F.expr("chunk_index div 7")).cast("int"))


def summary_sections(s, sf):
    return sections.summary_sections(_titled(s, sf)).select("document_id", "place", "title", "chunks", "first", "last", "line")


def sampled_chunks(s, sf):
    return sections.sample(chunks(s, sf)).select("document_id", "chunk_id")


_LINE = "trim(l)"
_UPPER = f"len(regexp_replace({_LINE}, '[^\\p{{Lu}}]', '', 'g')) >= 0.8 * greatest(len(regexp_replace({_LINE}, '[^\\p{{L}}]', '', 'g')), 1)"
_N = f"len(list_filter(regexp_split_to_array({_LINE}, '\\s+'), lambda w: w <> ''))"
_HEADING = f"len({_LINE}) BETWEEN 1 AND 90 AND (regexp_matches({_LINE}, '{dp.ROMAN}') OR regexp_matches({_LINE}, '{dp.NUMERIC}') OR (ends_with({_LINE}, ':') AND len({_LINE}) <= 70 AND {_N} <= 8) OR ({_N} BETWEEN 2 AND 10 AND {_UPPER}))"

SECTIONS_SQL = rf"""
WITH RECURSIVE c AS (SELECT document_id, chunk_id, chunk_index + 3 * (chunk_index // 7) AS chunk_index,
    CASE chunk_index % 15 WHEN 0 THEN '2.1  Tema ' || chunk_index // 30 || chr(10) WHEN 5 THEN '- DATOS GENERALES' || chr(10) WHEN 10 THEN 'Anexo final:' || chr(10) ELSE '' END || content AS content FROM ({CHUNKS})),
h AS (SELECT *, list_filter(string_split(content, chr(10)), lambda l: {_HEADING})[1] AS line FROM c),
t AS (SELECT *, {sql_norm('title')} AS key FROM (SELECT *, nullif(trim(regexp_replace(regexp_replace(regexp_replace(trim(line), '^[- ]+|[- ]+$', '', 'g'), ':$', ''), '\s+', ' ', 'g')), '') AS title FROM h)),
b AS (SELECT *, coalesce(chunk_index - lag(chunk_index) OVER w > 2, true) AS cut FROM t WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index, chunk_id)),
r AS (SELECT *, sum(CAST(cut AS INTEGER)) OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) AS run FROM b),
f AS (SELECT *, last_value(key IGNORE NULLS) OVER (PARTITION BY document_id, run ORDER BY chunk_index, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS force FROM r),
n AS (SELECT *, cut OR (title IS NOT NULL AND key IS DISTINCT FROM force) AS new FROM f),
g AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) AS section FROM n),
s AS (SELECT document_id, CAST(section AS INTEGER) AS section, coalesce(max(title) FILTER (new), 'Parte ' || CAST(section AS INTEGER)) AS title, count(*) AS chunks, min(chunk_index) AS first, max(chunk_index) AS last FROM g GROUP BY document_id, section),
m AS (SELECT document_id, section, 1 AS part, chunks > 1 AS big, starts_with(title, 'Parte ') AS made, last FROM s WHERE section = 1
  UNION ALL SELECT document_id, section, part + CAST(NOT joins AS INTEGER), joins OR own_big, CASE WHEN joins THEN made ELSE own_made END, own_last FROM (
    SELECT s.document_id, s.section, m.part, m.made, s.chunks > 1 AS own_big, starts_with(s.title, 'Parte ') AS own_made, s.last AS own_last,
      s.first - m.last <= 1 AND (m.made OR starts_with(s.title, 'Parte ')) AND NOT (m.big AND s.chunks > 1) AS joins FROM m JOIN s ON s.document_id = m.document_id AND s.section = m.section + 1)),
p AS (SELECT s.document_id, part, arg_min(title, s.section) AS title, sum(chunks) AS chunks, min(s.first) AS first, max(s.last) AS last FROM s JOIN m ON s.document_id = m.document_id AND s.section = m.section GROUP BY ALL),
k AS (SELECT *, CAST((part - 1) // CAST(ceil(max(part) OVER (PARTITION BY document_id) / 12.0) AS INTEGER) + 1 AS INTEGER) AS place FROM p),
o AS (SELECT document_id, place, coalesce(arg_min(title, part) FILTER (NOT starts_with(title, 'Parte ')), arg_min(title, part)) AS title, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(min(first) AS INTEGER) AS first, CAST(max(last) AS INTEGER) AS last FROM k GROUP BY ALL)
SELECT *, place || '. ' || title || ' (chunks: ' || chunks || ', rango: ' || first || '-' || last || ')' AS line FROM o
"""

QUERIES = {
    "summary_sections": (summary_sections, SECTIONS_SQL),
    "sampled_chunks": (sampled_chunks, f"SELECT document_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) - 1 AS a, count(*) OVER (PARTITION BY document_id) AS n FROM ({CHUNKS})) WHERE a IN (0, n // 2, n - 1)"),
}
