"""Kinds of questions, topics that documents hold, dates and grounded answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import questions as qs
from ..functions import text as tx
from ..operators import extract as ex
from ..operators import reports
from .answers import _I, _FACT, _SCORE, _by_doc
from .base import CHUNKS, DOCS, chunks, docs, quoted, sql_any, sql_norm, sql_tokens, table

TOPIC = "Háblame sobre thineations en el documento"
_PHRASES = list(dict.fromkeys(p for group in [*lx.QUESTION_INTENTS.values(), *lx.QUESTION_TRAITS.values()] for p in group))


def _turns(s, sf):
    """Turns, to each of which a phrase is added by number, for they have none of their own."""
    phrase = F.element_at(F.array(*map(F.lit, _PHRASES)), ((F.col("conv_id") + F.col("turn")) % len(_PHRASES) + 1).cast("int"))
    return tx.once(table(s, sf, "conversations").withColumn("q", F.concat_ws(" ", "text", phrase)), norm=tx.norm(F.col("q")))


def question_traits(s, sf):
    return _turns(s, sf).select("conv_id", "turn", *[c.alias(n) for n, c in qs.trait_columns(F.col("norm")).items()])


def question_intents(s, sf):
    return _turns(s, sf).select("conv_id", "turn", qs.intent_column(F.col("norm")).alias("intent"))


def supported_topics(s, sf):
    return reports.topic_support(chunks(s, sf), TOPIC)


def date_answers(s, sf):
    """Each text with a date after it that the text's number gives."""
    dated = _by_doc(s, sf).withColumn("content", F.concat("content", F.lit("\nEl "), (F.col("document_id") % 28 + 1).cast("string"), F.lit(" de mayo de 2021 thing")))
    return ex.spans(dated, _I, ex.DATE, 0.0).select("document_id", "score", F.col("at").alias("sentence_no"), "span")


#: What answers add to a text, by its number.
_ADDED = [*lx.SUSPICIOUS[:2], lx.UNGROUNDED[0], lx.TEMPLATES[0], lx.DENIALS[0], "zzzzzza zzzzzzb zzzzzzc zzzzzzd zzzzzze zzzzzzf", ""]


def grounding_reasons(s, sf):
    """Each text's name and an addition as an answer, on the text as its context."""
    d = docs(s, sf)
    added = F.element_at(F.array(*map(F.lit, _ADDED)), (F.col("document_id") % len(_ADDED) + 1).cast("int"))
    answers = d.select("document_id", F.concat(F.when(F.col("document_id") % 2 == 0, "Resumen ").otherwise(""), added).alias("answer"), F.col("collection_id").alias("name"))
    found = reports.grounding_reasons(answers, d.select("document_id", F.col("text").alias("context")))
    return found.select("document_id", F.array_join("reasons", ",").alias("reasons"))


_TURNS = f"SELECT conv_id, turn, {sql_norm('q')} AS n FROM (SELECT *, text || ' ' || list_extract([{quoted(_PHRASES)}], CAST((conv_id + turn) % {len(_PHRASES)} + 1 AS INTEGER)) AS q FROM conversations)"
_TRAITS = {n: sql_any("n", p) for n, p in lx.QUESTION_TRAITS.items()}
_TRAITS["several"] = f"({_TRAITS['several']} OR {_TRAITS['overview']} OR {_TRAITS['cross_document']})"
_WORDS = sql_tokens(sql_norm("content"))
_HELD = " AND ".join(f"bool_or(list_has_any({_WORDS}, [{quoted(qs.topic_forms(w))}]))" for w in qs.asked_topic(TOPIC))
_DATED = rf"""SELECT document_id, CAST(i - 1 AS INTEGER) AS sentence_no, parts[i] AS sentence, {sql_norm('parts[i]')} AS norm, {sql_tokens(sql_norm('parts[i]'))} AS words FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (
  SELECT document_id, list_filter(list_transform(regexp_split_to_array(text || chr(10) || 'El ' || (document_id % 28 + 1) || ' de mayo de 2021 thing', '[\n.?!;]'), lambda x: trim(x, ' ')), lambda x: x <> '') AS parts FROM ({DOCS}))) WHERE {sql_norm('parts[i]')} <> ''"""


def _alone(phrases) -> str:
    return "(" + " OR ".join(f"(contains(a, '{p}') AND NOT contains(c, '{p}'))" for p in phrases) + ")"


_REASONS = {
    "unsupported_content": _alone(lx.SUSPICIOUS),
    "unsupported_topics": "CASE WHEN len(k) < 8 THEN len(m) >= 5 ELSE len(m) >= 6 AND len(m) * 100 // len(k) >= 38 END",
    "unsupported_generic_phrase": _alone(lx.UNGROUNDED),
    "template_answer": _alone(lx.TEMPLATES),
    "possible_contradiction": f"{sql_any('a', lx.DENIALS)} AND size >= {lx.DENIED_WORDS}",
    "too_short_for_summary": f"{sql_any('a', lx.SUMMARY_SIGNS)} AND size >= {lx.SUMMARISED_WORDS} AND len({sql_tokens('a')}) < {lx.SHORT_SUMMARY}",
}
_GROUNDED = f"""WITH x AS (SELECT document_id, {sql_norm(f"CASE WHEN document_id % 2 = 0 THEN 'Resumen ' ELSE '' END || list_extract([{quoted(_ADDED)}], CAST(document_id % {len(_ADDED)} + 1 AS INTEGER))")} AS a, {sql_norm("coalesce(text, '')")} AS c, {sql_norm('collection_id')} AS name FROM ({DOCS})),
  y AS (SELECT *, len({sql_tokens('c')}) AS size, list_filter(list_distinct({sql_tokens('a')}), lambda w: len(w) >= 6 AND w NOT IN ({quoted([*lx.ASK_STOP_WORDS, *lx.GROUNDING_STOP_WORDS])}) AND NOT starts_with(w, 'document') AND NOT contains(name, w)) AS k FROM x),
  z AS (SELECT *, list_filter(k, lambda w: NOT contains(c, w)) AS m FROM y)
  SELECT document_id, CASE WHEN a = '' THEN 'empty_answer' WHEN c = '' THEN 'empty_context' ELSE concat_ws(',', {", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in _REASONS.items())}) END AS reasons FROM z"""

QUERIES = {
    "question_traits": (question_traits, f"SELECT conv_id, turn, {', '.join(f'{t} AS {n}' for n, t in _TRAITS.items())} FROM ({_TURNS})"),
    "question_intents": (question_intents, f"SELECT conv_id, turn, CASE {' '.join(f'''WHEN {sql_any('n', p)} THEN '{n}' ''' for n, p in lx.QUESTION_INTENTS.items())} ELSE 'general' END AS intent FROM ({_TURNS})"),
    "supported_topics": (supported_topics, f"SELECT document_id, {_HELD} AS supported FROM ({CHUNKS}) GROUP BY document_id"),
    "date_answers": (date_answers, f"SELECT document_id, score, sentence_no, regexp_extract(norm, '{ex.DATE}') AS span FROM (SELECT *, {_SCORE} + CASE WHEN {_FACT} THEN 3.0::DOUBLE ELSE 0 END AS score FROM ({_DATED}) WHERE regexp_matches(norm, '{ex.DATE}') AND NOT contains(sentence, '¿')) QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY score DESC, sentence_no) = 1"),
    "grounding_reasons": (grounding_reasons, _GROUNDED),
}
