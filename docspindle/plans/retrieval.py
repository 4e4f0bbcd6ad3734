"""Search queries over lines as chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..functions.intent import global_terms, intent, topic
from ..operators import search as se
from .base import CHUNKS, PREPARED, QUERY, chunks, docs, sql_any, sql_norm, sql_whole, table

TOPIC = "sobre thing"
#: A question without a topic, for scores of other chunks.
PLAIN = "thble thing attion"
#: One that names an entity.
NAMED = "quien lidero el descubrimiento de la thineation thineation"
#: One whose matches pass the thresholds of hybrid search.
SHORT = "thing"


def global_search(s, sf):
    d = docs(s, sf).select("document_id", F.lit(0).alias("chunk_index"), F.col("document_id").cast("string").alias("chunk_id"), F.col("text").alias("content"))
    return se.global_search(d, QUERY).select("document_id", "score")


def scoped_search(s, sf):
    return se.scoped_search(chunks(s, sf).filter("collection_id = 'src5'"), TOPIC, 20).select("chunk_id", "topic_count", F.round("score", 6).alias("score"))


def scoped_fallback(s, sf):
    return se.scoped_search(chunks(s, sf).filter("collection_id = 'src5'"), "xyzzyq", 3).select("chunk_id", F.round("score", 6).alias("score"))


def topic_matches(s, sf):
    return se.text_matches(chunks(s, sf), TOPIC).select("chunk_id", "topic_count", F.round("score", 6).alias("score"))


def summary_direct(s, sf):
    c = chunks(s, sf).filter("collection_id = 'src6'").withColumn("created_at", F.col("document_id"))
    return se.summary_chunks(c, 30).select("chunk_id")


def keyword_scores(s, sf):
    c = se.prepared(chunks(s, sf))
    return tx.once(c, score=F.round(se.keyword_score(intent(PLAIN)), 6)).filter("score > 0").select("chunk_id", "score")


def relaxed_scores(s, sf):
    c = se.prepared(chunks(s, sf))
    return tx.once(c, score=F.round(se.relaxed_score(intent(PLAIN)), 6)).filter("score > 0").select("chunk_id", "score")


def entity_boosts(s, sf):
    c = se.prepared(chunks(s, sf))
    return c.withColumn("boost", F.round(se.entity_boost(intent(PLAIN)), 6)).filter("boost > 0").select("chunk_id", "boost")


def question_boosts(s, sf):
    c = se.prepared(chunks(s, sf))
    return c.withColumn("boost", F.round(se.question_boost(intent("fecha thing tabla")), 6)).filter("boost > 0").select("chunk_id", "boost")


def length_penalties(s, sf):
    c = se.prepared(chunks(s, sf))
    i = intent(PLAIN)
    return c.select("chunk_id", se.length_penalty(i, F.lit(0.5)).alias("penalty"), se.section_penalty(PLAIN).alias("section"), se.focus_penalty(i, topic(PLAIN)).alias("focus"))


def overlap_scores(s, sf):
    c = se.prepared(chunks(s, sf))
    return tx.once(c, score=F.round(se.overlap_score(intent(PLAIN)), 6)).filter("score > 0").select("chunk_id", "score")


def named_boosts(s, sf):
    """What an entity adds to each score, and which chunks it singles out."""
    i = intent(NAMED)
    c = se.prepared(chunks(s, sf)).withColumn("boost", F.round(se.entity_boost(i), 6)).filter("boost > 0")
    score, focus = F.round(se.overlap_score(i), 6).alias("score"), se.focus_penalty(i, topic(PLAIN)).alias("focus")
    return c.select("chunk_id", "boost", F.round(se.question_boost(i), 6).alias("asked"), score, focus, se.exact_intent(i).alias("exact"))


def named_matches(s, sf):
    return se.relaxed_scores(chunks(s, sf), NAMED).select("chunk_id", F.round("score", 6).alias("score"))


def _embedded(s, sf):
    v = table(s, sf, "embeddings").select(F.col("vec_id").alias("document_id"), "embedding")
    return chunks(s, sf).join(v, "document_id")


VECTOR = [1.0 if i % 2 else -0.5 for i in range(64)]


def hybrid_scores(s, sf):
    return se.hybrid_scores(_embedded(s, sf), SHORT, VECTOR).select("chunk_id", F.round("score", 6).alias("score"))


def hybrid_search(s, sf):
    return se.hybrid_search(_embedded(s, sf), SHORT, VECTOR, 5).select("chunk_id", F.round("score", 6).alias("score"), "place")


def structure_search(s, sf):
    return se.structure_search(chunks(s, sf), 6).select("chunk_id", F.round("score", 6).alias("score"))


def near_copy_lines(s, sf):
    """Of each document's lines, those that are no near copies of ones before."""
    c = chunks(s, sf).select("document_id", "chunk_index", tx.norm(F.col("content")).alias("norm"))
    return se.drop_near_copies(c, ["chunk_index"], ["document_id"]).select("document_id", "chunk_index")


def section_scores(s, sf):
    return se.section_scores(chunks(s, sf), "thing").select("chunk_id", F.round("score", 6).alias("score"))


def section_search(s, sf):
    return se.section_search(chunks(s, sf), "thing", 4).select("chunk_id", F.round("score", 6).alias("score"))


def context_by_hits(s, sf):
    words = [t for t in global_terms(QUERY) if len(t) >= 3]
    n = tx.norm(F.col("content"))
    hits = tx.total([F.when(n.contains(w), 1.0).otherwise(0.0) for w in words]).cast("int")
    return chunks(s, sf).withColumn("hits", hits).orderBy(F.desc("hits"), "document_id", "chunk_index").limit(20).select("chunk_id", "hits")


def entity_first(s, sf):
    n = tx.norm(F.col("content"))
    c = chunks(s, sf).withColumn("hit", n.contains("thble"))
    return c.orderBy(F.desc("hit"), "document_id", "chunk_index").limit(25).select("chunk_id", "hit")


def snippets(s, sf):
    d = docs(s, sf).select("document_id", F.col("text").alias("content"))
    return se.with_snippets(d, PLAIN).select("document_id", F.length("snippet").alias("n"), F.md5("snippet").alias("snippet"))


def phrase_filter(s, sf):
    from ..functions.intent import phrase_terms

    hit = tx.any_of([F.col("content").ilike(f"%{t}%") for t in phrase_terms("Thing attion")])
    return chunks(s, sf).filter(hit).select("chunk_id")


_HITS = " + ".join(f"CASE WHEN text ILIKE '%{w}%' THEN 1.0::DOUBLE ELSE 0 END" for w in global_terms(QUERY))
_T = topic(TOPIC)
_TC = "(" + " + ".join(sql_whole("words", v) for v in _T.variants) + ")"
_TDEF = sql_any("norm", [v + x for v in _T.variants for x in lx.TOPIC_DEFINITION_AFTER] + [x + v + " " for v in _T.variants for x in lx.TOPIC_DEFINITION_BEFORE])
_TS = f"1.0::DOUBLE + CASE WHEN {_TC} = 0 THEN 0.0 ELSE 1.2 + least({_TC} * 0.16::DOUBLE, 0.8) + CASE WHEN {_TDEF} THEN 0.45::DOUBLE ELSE 0 END END"


def _matches(where: str) -> str:
    return f"""WITH p AS (SELECT * FROM ({PREPARED}) WHERE {where}), t AS (SELECT *, {_TC} AS tc FROM p), m AS (SELECT max(tc) AS most FROM t)
      SELECT chunk_id, document_id, chunk_index, CAST(tc AS INTEGER) AS topic_count, round({_TS}, 6) AS score FROM t, m WHERE (most = 0 OR tc > 0) AND contains(norm, 'thing')"""


def _fuzzy(words: str, term: str) -> str:
    k = 2 if len(term) >= 9 else 1
    return "0" if len(term) < 5 else f"len(list_filter({words}, lambda w: len(w) >= 5 AND abs(len(w) - {len(term)}) <= {k} AND levenshtein(w, '{term}') <= {k}))"


def _partial(words: str, term: str) -> str:
    return f"len(list_filter({words}, lambda x: starts_with(x, '{term[: min(len(term) - 1, 7)]}') OR contains(x, '{term}') OR (len(x) >= 5 AND contains('{term}', x)))) > 0"


class Scores:
    """The SQL of each score of one query."""

    def __init__(self, query: str):
        i = intent(query)
        n, first = len(i.terms), i.terms[0]
        defined = sql_any("norm", [t + x for t in i.terms for x in lx.DEFINITION_AFTER] + [x + t for t in i.terms for x in lx.DEFINITION_BEFORE])
        whole = {t: sql_whole("words", t) for t in i.terms}
        near = {t: _fuzzy("words", t) for t in i.terms}
        hits = {t: f"CASE WHEN {whole[t]} > 0 THEN {whole[t]} WHEN contains(norm, '{t}') THEN 0 ELSE {near[t] if t == first else '0'} END" for t in i.terms}
        bonus = " + ".join(f"CASE WHEN {whole[t]} > 0 THEN 0.0::DOUBLE WHEN contains(norm, '{t}') THEN 0.08 {f'WHEN {near[t]} > 0 THEN 0.22' if t == first else ''} ELSE 0 END" for t in i.terms)
        m = " + ".join(f"CASE WHEN ({h}) > 0 THEN 1 ELSE 0 END" for h in hits.values())
        total = " + ".join(f"({h})" for h in hits.values())
        self.keyword = f"""CASE WHEN ({m}) = 0 THEN 0.0 ELSE CASE WHEN contains(norm, '{i.normalised}') THEN 0.85::DOUBLE ELSE 0 END + {bonus}
          + ({m}) / {n}.0::DOUBLE * 0.5 + least(({total}) * 0.04::DOUBLE, 0.2) + least(({hits[first]}) * 0.06::DOUBLE, 0.18)
          + CASE WHEN {defined} THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN ({m}) >= 2 THEN 0.12::DOUBLE ELSE 0 END END"""
        steps = {t: f"CASE WHEN {whole[t]} > 0 THEN 0.34::DOUBLE WHEN contains(norm, '{t}') THEN 0.18 " + (f"WHEN {near[t]} > 0 THEN 0.26 WHEN {_partial('words', t)} THEN 0.12 " if t == first else "") + "ELSE 0 END" for t in i.terms}
        rm = " + ".join(f"CASE WHEN ({x}) > 0 THEN 1 ELSE 0 END" for x in steps.values())
        self.relaxed = f"CASE WHEN ({rm}) = 0 THEN 0.0 ELSE CASE WHEN contains(norm, '{i.normalised}') THEN 0.55::DOUBLE ELSE 0 END + {' + '.join(f'({x})' for x in steps.values())} + ({rm}) / {n}.0::DOUBLE * 0.18 + CASE WHEN {defined} THEN 0.12::DOUBLE ELSE 0 END END"
        phrase = f"CASE WHEN contains(norm, '{i.phrase}') THEN {{}}::DOUBLE ELSE {{}} END" if i.phrase else "{1}::DOUBLE"
        named = f"CASE WHEN contains(norm, '{i.entity}') THEN {{}}::DOUBLE ELSE {{}} END" if i.filters_entity else "{1}::DOUBLE"
        self.named = named
        self.entity = named.format("1.6", "0.0") + " + " + phrase.format("1.0", "0.0") + " + " + " + ".join(f"CASE WHEN {sql_whole('words', t)} > 0 THEN 0.18::DOUBLE WHEN {_fuzzy('words', t)} > 0 THEN 0.06 ELSE 0 END" for t in i.main_terms)
        self.focus = named.format("1.0", "0.72") if i.filters_entity else phrase.format("1.0", "0.25") if i.phrase else "1.0::DOUBLE"
        over = [f"CASE WHEN {sql_whole('words', t)} > 0 THEN 1.0::DOUBLE WHEN {_fuzzy('words', t)} > 0 THEN 0.7 WHEN {_partial('words', t)} THEN 0.45 ELSE 0 END" for t in i.main_terms]
        oh = " + ".join(f"CASE WHEN ({x}) > 0 THEN 1.0::DOUBLE ELSE 0 END" for x in over)
        self.overlap = f"CASE WHEN ({oh}) = 0 THEN 0.0 ELSE {' + '.join(f'({x})' for x in over)} + ({oh}) / {len(i.main_terms)} + {phrase.format('0.6', '0.0')} + {named.format('0.8', '0.0')} END"
        self.exact = f"contains(norm, '{i.normalised}')"
        firsts = ", ".join(f"nullif(strpos(norm, '{t}'), 0)" for t in i.terms)
        self.at = f"(coalesce(nullif(strpos(norm, '{i.normalised}'), 0), least({firsts}), 0) - 1)"

    def length(self, score: str) -> str:
        return f"""CASE WHEN len(content) <= 700 OR {self.exact} OR {score} >= 0.85 THEN 1.0::DOUBLE
          WHEN len(content) > 1800 THEN CASE WHEN {self.at} > 1200 AND {score} < 0.9 THEN 0.42 ELSE 0.62 END
          WHEN len(content) > 1200 THEN CASE WHEN {self.at} > 800 AND {score} < 0.9 THEN 0.55 ELSE 0.74 END
          ELSE CASE WHEN {self.at} > 600 AND {score} < 0.7 THEN 0.72 ELSE 0.86 END END"""


QUESTION = (
    "CASE WHEN len(list_filter(words, lambda w: regexp_matches(w, '^[0-9]{4}$'))) > 0 THEN 0.25::DOUBLE ELSE 0 END + "
    f"CASE WHEN {sql_any('norm', lx.FACT_VERBS)} THEN 0.18::DOUBLE ELSE 0 END + " + " + ".join(f"CASE WHEN contains(norm, '{t}') THEN 0.16::DOUBLE ELSE 0 END" for t in lx.TABULAR_CONTENT)
)
SECTION = f"CASE WHEN {sql_any('norm', lx.GENERIC_SECTIONS)} THEN 0.18::DOUBLE ELSE 1.0 END"
P, S, N = Scores(PLAIN), Scores(SHORT), Scores(NAMED)
_FACTS = QUESTION.rsplit(" + CASE WHEN contains(norm, 'hoja')", 1)[0]
_ASKED = f"({N.named.format('0.35', '0.0')} + {_FACTS})"
_V = "[" + ", ".join(str(x) for x in VECTOR) + "]::DOUBLE[]"
HYBRID = f"""WITH p AS (SELECT c.*, e.embedding FROM ({PREPARED}) c JOIN embeddings e ON e.vec_id = c.document_id), t AS (SELECT *, {S.keyword} AS ts FROM p),
  f AS (SELECT *, (list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_V}) * 0.4 + ts * 0.6 + {S.entity}) * ({S.length('ts')}) * ({SECTION}) * ({S.focus}) AS s FROM t WHERE ts >= {lx.MIN_TEXT})
  SELECT chunk_id, round(s, 6) AS score FROM f WHERE s >= {lx.MIN_PRECISION}"""
_SNIP = f"""WITH a AS (SELECT doc_id AS document_id, trim(text, ' ') AS content, {sql_norm('text')} AS norm FROM documents),
  b AS (SELECT *, len(content) AS n, greatest({P.at}, 0) AS p FROM a), c AS (SELECT *, greatest(0, least(greatest(p - 300, 0), n - 900)) AS s FROM b),
  d AS (SELECT document_id, CASE WHEN n <= 900 THEN content ELSE CASE WHEN s > 0 THEN '...' ELSE '' END || trim(substr(content, s + 1, 900), ' ') || CASE WHEN s + 900 < n THEN '...' ELSE '' END END AS x FROM c)
  SELECT document_id, len(x) AS n, md5(x) AS snippet FROM d"""
_CN = sql_norm("content")
_SECTION = f"""CASE WHEN {sql_whole('words', 'thing')} > 0 THEN 3.6::DOUBLE WHEN {_fuzzy('words', 'thing')} > 0 THEN 1.5 + CASE WHEN contains(norm, 'thing') THEN 1.8::DOUBLE ELSE 0 END
  WHEN {_partial('words', 'thing')} THEN 1.3 + CASE WHEN contains(norm, 'thing') THEN 1.8::DOUBLE ELSE 0 END ELSE 0 END"""
_SECTIONS = f"""WITH p AS (SELECT *, {_SECTION} AS direct FROM ({PREPARED})), a AS (SELECT *, CASE WHEN direct > 0 THEN chunk_index END AS anchor FROM p),
  n AS (SELECT *, least(chunk_index - max(anchor) OVER (PARTITION BY document_id ORDER BY chunk_index), min(anchor) OVER (PARTITION BY document_id ORDER BY chunk_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - chunk_index) AS gap FROM a)
  SELECT chunk_id, round(direct * 3 + CASE gap WHEN 0 THEN 1.2::DOUBLE WHEN 1 THEN 0.8 WHEN 2 THEN 0.35 ELSE 0 END, 6) AS score FROM n WHERE direct > 0 OR gap <= 2"""
QUERIES = {
    "global_search": (global_search, f"SELECT * FROM (SELECT doc_id AS document_id, {_HITS} AS score FROM documents) WHERE score > 0 ORDER BY score DESC, document_id LIMIT 20"),
    "scoped_search": (scoped_search, f"SELECT chunk_id, topic_count, score FROM ({_matches(chr(99) + 'ollection_id = ' + chr(39) + 'src5' + chr(39))}) ORDER BY topic_count DESC, score DESC, document_id, chunk_index LIMIT 20"),
    "scoped_fallback": (scoped_fallback, f"SELECT chunk_id, 1.0::DOUBLE AS score FROM ({CHUNKS}) WHERE collection_id = 'src5' ORDER BY document_id, chunk_index LIMIT 3"),
    "topic_matches": (topic_matches, f"SELECT chunk_id, topic_count, score FROM ({_matches('true')})"),
    "summary_direct": (summary_direct, f"SELECT chunk_id FROM ({CHUNKS}) WHERE collection_id = 'src6' ORDER BY document_id DESC, chunk_index LIMIT 30"),
    "keyword_scores": (keyword_scores, f"SELECT chunk_id, score FROM (SELECT chunk_id, round({P.keyword}, 6) AS score FROM ({PREPARED})) WHERE score > 0"),
    "relaxed_scores": (relaxed_scores, f"SELECT chunk_id, score FROM (SELECT chunk_id, round({P.relaxed}, 6) AS score FROM ({PREPARED})) WHERE score > 0"),
    "entity_boosts": (entity_boosts, f"SELECT chunk_id, boost FROM (SELECT chunk_id, round({P.entity}, 6) AS boost FROM ({PREPARED})) WHERE boost > 0"),
    "named_boosts": (named_boosts, f"SELECT chunk_id, round(b, 6) AS boost, round({_ASKED}, 6) AS asked, round({N.overlap}, 6) AS score, {N.focus} AS focus, {N.named.format('1', '0')} = 1 AS exact FROM (SELECT *, {N.entity} AS b FROM ({PREPARED})) WHERE round(b, 6) > 0"),
    "named_matches": (named_matches, f"SELECT chunk_id, round(r, 6) AS score FROM (SELECT *, {N.relaxed} + {N.named.format('0.45', '0.0')} + {N.entity} + {_ASKED} AS r FROM ({PREPARED})) WHERE r >= 0.08"),
    "question_boosts": (question_boosts, f"SELECT chunk_id, boost FROM (SELECT chunk_id, round({QUESTION}, 6) AS boost FROM ({PREPARED})) WHERE boost > 0"),
    "score_penalties": (length_penalties, f"SELECT chunk_id, {P.length('0.5')} AS penalty, {SECTION} AS section, {P.focus} AS focus FROM ({PREPARED})"),
    "overlap_scores": (overlap_scores, f"SELECT chunk_id, score FROM (SELECT chunk_id, round({P.overlap}, 6) AS score FROM ({PREPARED})) WHERE score > 0"),
    "hybrid_scores": (hybrid_scores, HYBRID),
    "hybrid_search": (hybrid_search, None),
    "structure_search": (structure_search, None),
    "near_copy_lines": (near_copy_lines, None),
    "section_scores": (section_scores, _SECTIONS),
    "section_search": (section_search, None),
    "context_by_hits": (context_by_hits, f"SELECT chunk_id, hits FROM (SELECT *, {' + '.join(f'CASE WHEN contains({_CN}, {chr(39)}{w}{chr(39)}) THEN 1 ELSE 0 END' for w in global_terms(QUERY))} AS hits FROM ({CHUNKS})) ORDER BY hits DESC, document_id, chunk_index LIMIT 20"),
    "entity_first": (entity_first, f"SELECT chunk_id, hit FROM (SELECT *, contains({_CN}, 'thble') AS hit FROM ({CHUNKS})) ORDER BY hit DESC, document_id, chunk_index LIMIT 25"),
    "snippets": (snippets, _SNIP),
    "phrase_filter": (phrase_filter, f"SELECT chunk_id FROM ({CHUNKS}) WHERE content ILIKE '%thing%' OR content ILIKE '%attion%'"),
}
