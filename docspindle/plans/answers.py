"""Answers from tables and sentences, sections, profiles and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..functions.intent import intent
from ..operators import chunker as ch
from ..operators import extract as ex
from ..operators import reports as rp
from ..operators import tabular as tb
from .base import CHUNKS, DOCS, chunks, docs, quoted, sql_any, sql_norm, sql_terms, sql_tokens, sql_whole, table

ASK = "thing attion"
_I = intent(ASK)


def customer_lines(s, sf):
    """Customers as spreadsheet lines: a sheet for each market segment."""
    c = table(s, sf, "customer")
    value = tb.two_places(F.col("c_acctbal"))
    line = tb.row_line(F.col("c_custkey"), ["Cliente", "Saldo", "Segmento"], [F.col("c_name"), value, F.col("c_mktsegment")])
    return c.select(F.col("c_mktsegment").alias("document_id"), line.alias("content"))


def parsed_rows(s, sf):
    r = tb.parse_rows(customer_lines(s, sf))
    return r.select("document_id", "row", tb.label().alias("label"), F.try_element_at("pairs", F.lit("saldo")).alias("saldo"), F.size("pairs").alias("n"))


def table_summary(s, sf):
    return tb.numeric_summary(tb.parse_rows(customer_lines(s, sf)), "saldo", ["document_id"])


def table_filter(s, sf):
    return tb.above(tb.parse_rows(customer_lines(s, sf)), "saldo", 9000.0).select("document_id", "row", "value")


def table_rows(s, sf):
    return tb.row_count(customer_lines(s, sf))


def field_values(s, sf):
    return tb.parse_rows(customer_lines(s, sf)).select("row", tb.field("segmento del cliente").alias("value"))


def column_names(s, sf):
    return table(s, sf, "part").select("p_partkey", tb.column_letters(F.col("p_partkey")).alias("letters"))


def headers(s, sf):
    c = table(s, sf, "customer")
    first = F.array(F.lit("Cliente"), F.lit("Saldo"), F.when(F.col("c_custkey") % 2 == 0, F.lit("12")).otherwise(F.lit("Segmento")))
    second = F.array(F.col("c_name"), F.format_string("%.2f", F.round("c_acctbal", 2)), F.col("c_mktsegment"))
    return c.select("c_custkey", tb.header_is_first(first, second).alias("header"))


def _by_doc(s, sf):
    return docs(s, sf).select("document_id", F.lit(0).alias("chunk_index"), F.col("text").alias("content"))


def definition_answers(s, sf):
    return ex.definitions(_by_doc(s, sf), _I).select("document_id", "score", F.col("at").alias("sentence_no"))


def person_answers(s, sf):
    return ex.people(_by_doc(s, sf), _I).select("document_id", "score", F.col("at").alias("sentence_no"))


def date_answers(s, sf):
    return ex.spans(_by_doc(s, sf), _I, ex.QUANTITY, 0.0).select("document_id", "score", F.col("at").alias("sentence_no"), "span")


def comparisons(s, sf):
    return ex.compare(_by_doc(s, sf), "thing", "attion").select("document_id", F.md5("answer").alias("answer"), "together")


def useful_points(s, sf):
    return ex.useful_points(_by_doc(s, sf), 5).select("document_id", F.col("at").alias("sentence_no"), "place")


def term_ranking(s, sf):
    return ex.term_ranking(ex.sentence_rows(_by_doc(s, sf)), 5).select("document_id", "term", "count", "rank")


def grounding(s, sf):
    """Each text as an answer, on the text that follows it as its context."""
    d = docs(s, sf)
    a = d.select("document_id", F.col("text").alias("answer"))
    c = d.select((F.col("document_id") - 1).alias("document_id"), F.col("text").alias("context"))
    return ex.grounding(a, c)


def citations(s, sf):
    d = docs(s, sf).select(F.concat_ws("-", "tenant_id", "collection_id").alias("answer_id"), "document_id")
    return ex.lettered(d, ["document_id"]).select("answer_id", "document_id", "mark")


def profiles(s, sf):
    return rp.profiles(docs(s, sf)).select("document_id", "kind", "credentials", "quality", "readable")


def overview(s, sf):
    p = rp.profiles(docs(s, sf)).join(docs(s, sf).select("document_id", "collection_id"), "document_id")
    return rp.overview(p, "collection_id")


def contexts(s, sf):
    return rp.context(chunks(s, sf), 18000).select("document_id", F.md5("context").alias("context"))


def text_chunks(s, sf):
    c = ch.chunks_of(docs(s, sf))
    return c.groupBy("document_id").agg(F.count("*").alias("chunks"), F.max(F.length("content")).alias("longest"))


def section_groups(s, sf):
    c = ch.sections(chunks(s, sf).select("document_id", "chunk_index", "content"))
    return ch.compact(c).select("document_id", "chunk_index", "section", "part")


def key_points(s, sf):
    return ch.key_points(ex.sentence_rows(_by_doc(s, sf)).filter(F.size("words") >= 5))


def _pages(s, sf):
    """Lines of texts as rows of pages of ten, each with a running head."""
    c = chunks(s, sf).select("document_id", F.expr("chunk_index div 10").alias("page"), ((F.col("chunk_index") % 10 + 1) * 12).alias("position"), F.col("content").alias("text"))
    heads = c.select("document_id", "page").distinct().select("document_id", "page", F.lit(0).alias("position"), F.concat(F.lit("Informe "), F.col("document_id").cast("string"), F.lit(" página "), (F.col("page") + 1).cast("string")).alias("text"))
    return c.unionByName(heads)


def page_edges(s, sf):
    return ch.repeated_edges(_pages(s, sf))


def page_rows(s, sf):
    return ch.without_edges(_pages(s, sf)).groupBy("document_id").agg(F.count("*").alias("rows"))


def page_gaps(s, sf):
    return ch.paragraph_gaps(_pages(s, sf))


def page_paragraphs(s, sf):
    """Lines as rows of pages of ten, with a wider gap after every third and a hyphen after every fourth."""
    at = F.col("chunk_index")
    rows = chunks(s, sf).select("document_id", F.expr("chunk_index div 10").alias("page"), (at * 12 + F.floor(at / 3) * 15).alias("position"), F.concat(F.trim("content"), F.when((at % 4 == 0) & (F.trim("content") != ""), "-").otherwise("")).alias("text"))
    return ch.page_blocks(rows).select("document_id", "page", "block", F.md5(F.regexp_replace("text", r"[^\p{L}\p{N}]", "")).alias("letters"))


_SEN = f"""SELECT document_id, i - 1 AS sentence_no, s[i] AS sentence, {sql_norm('s[i]')} AS norm FROM (SELECT document_id, s, unnest(range(1, len(s) + 1)) AS i FROM (
  SELECT document_id, list_filter(list_transform(regexp_split_to_array(text, '[\\n.?!;]'), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM ({DOCS})))"""
_SENT = f"SELECT *, {sql_tokens('norm')} AS words FROM ({_SEN}) WHERE norm <> ''"
_SCORE = " + ".join(f"CASE WHEN {sql_whole('words', t)} > 0 THEN 1.0::DOUBLE ELSE 0 END" for t in _I.main_terms) + f" + CASE WHEN contains(norm, '{_I.phrase}') THEN 3.0::DOUBLE ELSE 0 END"
_DEF = sql_any("norm", [t + x for t in _I.terms for x in lx.DEFINITION_AFTER] + [x + t for t in _I.terms for x in lx.DEFINITION_BEFORE])


def _best(score: str, least: float, where: str = "true", more: str = "") -> str:
    return f"SELECT document_id, score, sentence_no {more} FROM (SELECT *, {score} AS score FROM ({_SENT}) WHERE {where}) WHERE score >= {least} QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY score DESC, sentence_no) = 1"


_LINES = "SELECT c_mktsegment AS document_id, c_custkey AS row, c_name, round(c_acctbal, 2) AS v, c_mktsegment FROM customer"
_PAGES = f"""SELECT document_id, chunk_index // 10 AS page, (chunk_index % 10 + 1) * 12 AS position, content AS text FROM ({CHUNKS})
  UNION ALL SELECT DISTINCT document_id, chunk_index // 10, 0, 'Informe ' || document_id || ' página ' || (chunk_index // 10 + 1) FROM ({CHUNKS})"""
_KEY = f"regexp_replace({sql_norm('text')}, '[0-9]+', '#', 'g')"
_EDGES = f"""SELECT document_id, key, pages FROM (
  SELECT document_id, key, count(DISTINCT page) AS pages FROM (
    SELECT *, {_KEY} AS key, row_number() OVER (PARTITION BY document_id, page ORDER BY position) AS a, row_number() OVER (PARTITION BY document_id, page ORDER BY position DESC) AS z FROM ({_PAGES}))
  WHERE (a <= 2 OR z <= 2) AND key <> '' GROUP BY ALL) JOIN (SELECT document_id, count(DISTINCT page) AS n FROM ({_PAGES}) GROUP BY ALL) USING (document_id)
  WHERE pages >= CASE WHEN n >= 4 THEN CAST(ceil(n / 2) AS BIGINT) ELSE 2 END"""
_LT = "list_filter(" + sql_terms("{n}") + ", lambda w: len(w) >= 5)"
_GROUND = f"""WITH l AS (SELECT document_id, {_LT.format(n=sql_norm('text'))} AS x FROM ({DOCS})),
  a AS (SELECT l.document_id, l.x, c.x AS y FROM l JOIN l AS c ON c.document_id = l.document_id + 1),
  b AS (SELECT document_id, len(x) AS n, len(list_filter(x, lambda w: NOT list_contains(y, w))) AS m FROM a)
  SELECT document_id, n AS n_terms, m AS n_missing, CASE WHEN n < 8 THEN m >= 5 ELSE m >= 6 AND m / n >= 0.38 END AS unsupported FROM b"""


def _profile_sql() -> str:
    from .text import QUALITY_SQL, QUERIES

    quality = QUALITY_SQL.replace("trim(text)", "trim(left(text, 6000))")
    kind = QUERIES["content_types"][1].replace("left(text, 12000)", "text")
    return f"SELECT document_id, kind, credentials, quality, quality >= 45 AS readable FROM ({kind}) JOIN ({QUERIES['credential_hints'][1]}) USING (document_id) JOIN ({quality}) USING (document_id)"


def _section_sql() -> str:
    from .text import SHAPES_SQL

    return f"""WITH h AS (SELECT c.document_id, c.chunk_index, s.heading FROM ({CHUNKS}) c JOIN ({SHAPES_SQL}) s USING (chunk_id)),
      n AS (SELECT *, CASE WHEN lag(chunk_index) OVER w IS NULL OR heading OR chunk_index - lag(chunk_index) OVER w > 2 THEN 1 ELSE 0 END AS new FROM h WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index)),
      g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY document_id ORDER BY chunk_index) AS INTEGER) AS section FROM n)
      SELECT document_id, chunk_index, section, CAST((section - 1) // CAST(ceil(max(section) OVER (PARTITION BY document_id) / 12) AS BIGINT) + 1 AS INTEGER) AS part FROM g"""


def _paragraph_sql() -> str:
    """Blocks by letters alone, for joining rows moves only blanks and hyphens. The rows' shapes are
    those of the lines, whose hyphens end no heading word and no bullet."""
    from .text import SHAPES_SQL

    rows = f"SELECT document_id, chunk_index // 10 AS page, chunk_index, chunk_index * 12 + chunk_index // 3 * 15 AS position, trim(content, ' ') || CASE WHEN chunk_index % 4 = 0 AND trim(content, ' ') <> '' THEN '-' ELSE '' END AS content, chunk_id FROM ({CHUNKS})"
    shapes = SHAPES_SQL.replace(f"FROM ({CHUNKS})", f"FROM ({rows})")
    return rf"""WITH r AS (SELECT *, position - lag(position) OVER w AS gap FROM ({rows}) WINDOW w AS (PARTITION BY document_id, page ORDER BY position)),
      m AS (SELECT document_id, page, coalesce(list_sort(list(gap) FILTER (gap > 0))[CAST(count(*) FILTER (gap > 0) // 2 + 1 AS INTEGER)], 12) AS mid FROM r GROUP BY ALL),
      k AS (SELECT r.*, s.heading, s.bullet, gap >= greatest(18, floor(mid * 1.8)) AS wide FROM r JOIN m USING (document_id, page) JOIN ({shapes}) s USING (chunk_id) WHERE regexp_replace(r.content, '^\s+|\s+$', '', 'g') <> ''),
      n AS (SELECT *, CASE WHEN lag(content) OVER w IS NULL OR heading OR bullet OR wide OR ends_with(lag(content) OVER w, ':') THEN 1 ELSE 0 END AS new FROM k WINDOW w AS (PARTITION BY document_id, page ORDER BY position)),
      b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY document_id, page ORDER BY position) AS INTEGER) AS block FROM n)
      SELECT document_id, page, block, md5(regexp_replace(string_agg(content, '' ORDER BY position), '[^\p{{L}}\p{{N}}]', '', 'g')) AS letters FROM b GROUP BY document_id, page, block"""


_FACT = sql_any("norm", lx.FACT_VERBS)
QUERIES = {
    "parsed_rows": (parsed_rows, f"SELECT document_id, row, c_name AS label, printf('%.2f', v) AS saldo, 3 AS n FROM ({_LINES})"),
    "table_summary": (table_summary, f"""SELECT document_id, count(*) AS n, round(avg(v), 6) AS mean, min(v) AS least, arg_min(row, (v, row)) AS least_row, max(v) AS greatest, arg_max(row, (v, -row)) AS greatest_row FROM ({_LINES}) GROUP BY document_id"""),
    "table_filter": (table_filter, f"SELECT document_id, row, v AS value FROM ({_LINES}) WHERE v > 9000"),
    "table_rows": (table_rows, f"SELECT document_id, count(*) AS rows FROM ({_LINES}) GROUP BY document_id"),
    "field_values": (field_values, f"SELECT row, c_mktsegment AS value FROM ({_LINES})"),
    "column_letters": (column_names, """SELECT p_partkey, CASE WHEN p_partkey < 1 THEN '' WHEN p_partkey <= 26 THEN chr(CAST(64 + p_partkey AS INTEGER)) WHEN p_partkey <= 702 THEN chr(CAST(65 + (p_partkey - 27) // 26 AS INTEGER)) || chr(CAST(65 + (p_partkey - 27) % 26 AS INTEGER))
      WHEN p_partkey > 18278 THEN chr(CAST(65 + (p_partkey - 18279) // 17576 AS INTEGER)) || chr(CAST(65 + (p_partkey - 18279) // 676 % 26 AS INTEGER)) || chr(CAST(65 + (p_partkey - 18279) // 26 % 26 AS INTEGER)) || chr(CAST(65 + (p_partkey - 18279) % 26 AS INTEGER))
      ELSE chr(CAST(65 + (p_partkey - 703) // 676 AS INTEGER)) || chr(CAST(65 + (p_partkey - 703) // 26 % 26 AS INTEGER)) || chr(CAST(65 + (p_partkey - 703) % 26 AS INTEGER)) END AS letters FROM part"""),
    "header_rows": (headers, "SELECT c_custkey, c_custkey % 2 <> 0 AS header FROM customer"),
    "definition_answers": (definition_answers, _best(f"{_SCORE} + CASE WHEN {_DEF} THEN 2.0::DOUBLE ELSE 0 END", 2.0)),
    "person_answers": (person_answers, _best(f"{_SCORE} + CASE WHEN regexp_matches(sentence, '{ex.PERSON}') THEN 3.0::DOUBLE ELSE 0 END + CASE WHEN {sql_any('norm', ['dirigido', 'responsable', 'autor', 'nombre'])} THEN 1.0::DOUBLE ELSE 0 END", 3.0)),
    "quantity_answers": (date_answers, _best(f"{_SCORE} + CASE WHEN {_FACT} THEN 3.0::DOUBLE ELSE 0 END", 0.0, f"regexp_matches(norm, '{ex.QUANTITY}') AND NOT contains(sentence, '¿')", f", regexp_extract(norm, '{ex.QUANTITY}') AS span")),
    "comparison_answers": (comparisons, f"""SELECT document_id, md5(coalesce(ab, concat_ws(' | ', a, b))) AS answer, ab IS NOT NULL AS together FROM (
      SELECT document_id, arg_min(sentence, sentence_no) FILTER (contains(norm, 'thing') AND contains(norm, 'attion')) AS ab, arg_min(sentence, sentence_no) FILTER (contains(norm, 'thing')) AS a, arg_min(sentence, sentence_no) FILTER (contains(norm, 'attion')) AS b
      FROM ({_SENT}) WHERE contains(norm, 'thing') OR contains(norm, 'attion') GROUP BY document_id)"""),
    "useful_points": (useful_points, f"""SELECT document_id, sentence_no, row_number() OVER (PARTITION BY document_id ORDER BY sentence_no) AS place FROM (
      SELECT document_id, min(sentence_no) AS sentence_no FROM ({_SENT}) WHERE len(words) >= 5 AND len(regexp_replace(sentence, '[^\\p{{L}}]', '', 'g')) * 2 >= len(sentence) AND len(sentence) <= 220 GROUP BY document_id, norm) QUALIFY place <= 5"""),
    "term_ranking": (term_ranking, f"""SELECT document_id, term, count, row_number() OVER (PARTITION BY document_id ORDER BY count DESC, strlen(term) DESC, term) AS rank FROM (
      SELECT document_id, term, count(*) AS count FROM (SELECT document_id, unnest(words) AS term FROM ({_SENT})) WHERE len(term) >= 4 AND term NOT IN ({quoted(lx.STOP_WORDS)}) GROUP BY ALL) QUALIFY rank <= 5"""),
    "grounding": (grounding, _GROUND),
    "citations": (citations, f"SELECT answer_id, document_id, chr(CAST(64 + p AS INTEGER)) AS mark FROM (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY document_id) AS p FROM (SELECT DISTINCT tenant_id || '-' || collection_id AS answer_id, document_id FROM ({DOCS}))) WHERE p <= 26"),
    "profiles": (profiles, _profile_sql()),
    "overview": (overview, f"SELECT collection_id, string_agg(DISTINCT kind, ', ' ORDER BY kind) AS kinds, count(*) AS documents, count(*) FILTER (readable) AS readable FROM ({_profile_sql()}) JOIN (SELECT document_id, collection_id FROM ({DOCS})) USING (document_id) GROUP BY collection_id"),
    "contexts": (contexts, f"SELECT document_id, md5(left(string_agg('[' || chunk_index || '] ' || trim(content, ' '), chr(10) ORDER BY chunk_index), 18000)) AS context FROM ({CHUNKS}) WHERE trim(content, ' ') <> '' GROUP BY document_id"),
    "text_chunks": (text_chunks, None),
    "section_groups": (section_groups, _section_sql()),
    "key_points": (key_points, None),
    "page_edges": (page_edges, _EDGES),
    "page_rows": (page_rows, f"SELECT document_id, count(*) AS rows FROM (SELECT p.document_id FROM (SELECT *, {_KEY} AS key FROM ({_PAGES})) p ANTI JOIN ({_EDGES}) e ON p.document_id = e.document_id AND p.key = e.key) GROUP BY document_id"),
    "page_paragraphs": (page_paragraphs, _paragraph_sql()),
    "page_gaps": (page_gaps, f"""SELECT document_id, m AS median_gap, greatest(18.0::DOUBLE, m * 1.8::DOUBLE) AS paragraph_gap FROM (SELECT document_id, coalesce(CAST(list_sort(list(g) FILTER (g IS NOT NULL))[CAST(count(g) // 2 + 1 AS INTEGER)] AS DOUBLE), 12.0::DOUBLE) AS m FROM (
      SELECT document_id, position - lag(position) OVER (PARTITION BY document_id, page ORDER BY position) AS g FROM ({_PAGES})) GROUP BY document_id)"""),
}
