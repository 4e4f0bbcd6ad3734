"""Relations between the documents of a collection, technical actions and command lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display as dp
from ..functions import lexicon as lx
from ..operators import relations as rel
from .base import DOCS, docs, quoted, sql_any, sql_norm

#: Lines for every eighth document each, for texts hold no words of the rules.
SPICE = ["Columnas: a | b", "un pipeline", "docker run x", "exoplanetas", "el algoritmo", "la rueda", "", "analisis"]
COMMAND = "\n- `curl -X POST http://h/"


def _spiced(s, sf):
    pick = F.element_at(F.array(*map(F.lit, SPICE)), (F.col("document_id") % len(SPICE) + 1).cast("int"))
    return docs(s, sf).withColumn("text", F.concat("text", F.lit("\n"), pick))


def document_profiles(s, sf):
    return rel.relation_profiles(_spiced(s, sf)).select("document_id", "type", "purpose", "topic", "area")


def document_relations(s, sf):
    """The documents of each collection, and pairs of neighbours by id."""
    p = rel.relation_profiles(_spiced(s, sf).withColumn("pair", F.concat(F.lit("p"), F.floor(F.col("document_id") / 2).cast("string"))))
    return rel.relations(p.select(F.explode(F.array("collection_id", "pair")).alias("of"), "type", "purpose", "topic", "area"), ["of"])


def technical_actions(s, sf):
    return _spiced(s, sf).select("document_id", F.array_join(rel.technical_actions(F.col("text")), "; ").alias("actions"))


def command_lines(s, sf):
    t = _spiced(s, sf).withColumn("text", F.concat("text", F.lit(COMMAND), "collection_id", F.lit("`\nGit  pull, x"), F.lit(COMMAND), "collection_id"))
    return rel.command_lines(t)


_SPICED = f"SELECT document_id, collection_id, text || chr(10) || [{quoted(SPICE)}][document_id % {len(SPICE)} + 1] AS text FROM ({DOCS})"
_NORM = f"SELECT *, document_id % {len(SPICE)} = 0 AS sheet, {sql_norm('text')} AS n FROM ({_SPICED})"


def _case(rules: dict, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {sql_any('n', v)} THEN '{k}'" for k, v in rules.items()) + f" ELSE {default} END"


_TECHNICAL = sql_any("(' ' || n || ' ')", [f" {w} " for w in lx.TECHNICAL_WORDS] + lx.TECHNICAL_PARTS)
PROFILES_SQL = f"""SELECT document_id, CASE WHEN sheet THEN 'data' WHEN {_TECHNICAL} THEN 'technical' ELSE 'narrative' END AS type,
  CASE WHEN sheet THEN 'datos' ELSE {_case(dp.PURPOSES, "'análisis'")} END AS purpose, {_case(lx.TOPICS, "CASE WHEN sheet THEN 'datos tabulares' ELSE '' END")} AS topic,
  {_case(lx.AREAS, "CASE WHEN sheet THEN 'los datos tabulares' ELSE 'su área especializada' END")} AS area FROM ({_NORM})"""


def _first(rules: list, default: str) -> str:
    return "CASE " + " ".join(f"WHEN list_has_all({c}, [{quoted(both)}]) THEN '{said}'" for c, both, said in rules) + f" ELSE {default} END"


RELATIONS_SQL = f"""
WITH p AS (SELECT *, unnest([collection_id, 'p' || (document_id // 2)]) AS of FROM ({PROFILES_SQL}) JOIN (SELECT document_id, collection_id FROM ({DOCS})) USING (document_id)),
g AS (SELECT of, count(*) AS documents, list(DISTINCT type) AS types, list(DISTINCT purpose) AS purposes, list_sort(list(DISTINCT area)) AS areas,
  count(DISTINCT topic) FILTER (topic <> '') > 1 AND NOT bool_or(type = 'data') AS apart FROM p GROUP BY of HAVING count(*) > 1)
SELECT of, documents, 'La relación entre ' || CASE WHEN documents > 2 THEN 'ellos' ELSE 'ambos' END || CASE WHEN apart THEN '{lx.DISTINCT_TOPICS}' || CASE len(areas)
    WHEN 1 THEN 'ambos desde ' || areas[1] WHEN 2 THEN 'uno desde ' || areas[1] || ' y otro desde ' || areas[2]
    ELSE 'cada uno desde áreas como ' || array_to_string(areas[:-2], ', ') || ' y ' || areas[-1] END
  ELSE ' radica en que ' || {_first(lx.RELATIONS, f"CASE WHEN len(purposes) = 1 THEN '{lx.ONE_PURPOSE[0]}' || purposes[1] || '{lx.ONE_PURPOSE[1]}' ELSE '{lx.RELATED}' END")} END || '.' AS relation,
  CASE WHEN list_has_all(types, ['data', 'narrative']) THEN '{lx.MIXED_CONCLUSION}' WHEN apart THEN '{lx.DISTINCT_CONCLUSION}'
    ELSE 'En conjunto, estos documentos permiten ' || {_first(lx.COMBINED_USES, f"'{lx.COMBINED_USE}'")} || '.' END AS conclusion,
  {_first(lx.COMPARISONS, f"'{lx.COMPARISON}'")} AS comparison, {_first(lx.VERDICTS, f"'{lx.VERDICT}'")} AS verdict FROM g
"""
_FOUND = ", ".join(f"CASE WHEN {sql_any('n', v)} THEN '{k}' END" for k, v in lx.ACTIONS.items())

QUERIES = {
    "document_profiles": (document_profiles, PROFILES_SQL),
    "document_relations": (document_relations, RELATIONS_SQL),
    "technical_actions": (technical_actions, f"SELECT document_id, coalesce(nullif(array_to_string(list_filter([{_FOUND}], lambda x: x IS NOT NULL), '; '), ''), '{lx.NO_ACTION}') AS actions FROM ({_NORM})"),
    "command_lines": (command_lines, f"""SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY k) AS INTEGER) AS place, command FROM (
      SELECT document_id, 1 AS k, 'docker run x' AS command FROM ({_SPICED}) WHERE document_id % {len(SPICE)} = 2
      UNION ALL SELECT document_id, 2, 'curl -X POST http://h/' || collection_id FROM ({DOCS}) UNION ALL SELECT document_id, 3, 'Git  pull, x' FROM ({DOCS}))"""),
}
