"""Text functions over documents and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display as dp
from ..functions import lexicon as lx
from ..functions import text as tx
from .base import CHUNKS, DOCS, QUERY, chunks, docs, quoted, sql_norm, sql_terms, sql_tokens, sql_whole, table

# Literals that hold one secret each, for texts have none of their shapes.
SECRETS = [
    "OPENAI_API_KEY=sk-abcdefghijklmnopqrstuvwxyz123456", "Authorization: Bearer abcdefghijklmnop1234", "password=supersecret",
    "admin@example.com:secretpass", 'curl -H "Authorization: x" http://localhost', "eyJabcdefghijklm.abcdefghijklmn.opqrstuvwxyzab",
    "a" * 45, "ésk-abcdefghijklmnopqrstuvwxyz",
]
TERM = "thing"
LONG = "onthation"


def text_norm(s, sf):
    return docs(s, sf).select("document_id", F.md5(tx.norm(F.col("text"))).alias("norm"), F.length(tx.norm(F.col("text"))).alias("n"))


#: Letters, and ones with marks of several scripts' hands.
PLAIN_LETTERS, MARKED_LETTERS = "aeioucszthnrld", "ăěįőųčšžțḥňřľď"


def marked_norm(s, sf):
    """Whole texts whose letters got marks, and the Greek and Vietnamese of their sources."""
    t = F.concat(F.translate("text", PLAIN_LETTERS, MARKED_LETTERS), F.lit(" Ελλάδα Ἀθῆναι Tiếng Việt Čeština szőlő țară"))
    return tx.once(docs(s, sf).select("document_id", t.alias("t")), norm=tx.norm(F.col("t"))).select("document_id", F.md5("norm").alias("norm"), F.length("norm").alias("n"))


def text_terms(s, sf):
    t = docs(s, sf).select("document_id", tx.terms(tx.norm(F.col("text"))).alias("t"))
    return t.select("document_id", F.size("t").alias("n"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("terms"))


def term_counts(s, sf):
    w = docs(s, sf).select("document_id", tx.tokens(tx.norm(F.col("text"))).alias("w"))
    return w.select("document_id", F.size("w").alias("words"), tx.whole_count(F.col("w"), TERM).alias("whole"), tx.fuzzy_count(F.col("w"), TERM).alias("near"), tx.fuzzy_count(F.col("w"), LONG).alias("near_long"), tx.partial_match(F.col("w"), LONG).alias("partial"))


def substring_any(s, sf):
    n = docs(s, sf).select("document_id", tx.norm(F.col("text")).alias("n"))
    return n.select("document_id", tx.contains_any(F.col("n"), ["thble", "cionas"]).alias("hit"))


def term_overlap(s, sf):
    q = F.array(*[F.lit(x) for x in "the of thing on at".split()])
    return docs(s, sf).select("document_id", F.round(tx.jaccard(tx.terms(tx.norm(F.col("text"))), q), 9).alias("jaccard"))


def text_quality(s, sf):
    return docs(s, sf).select("document_id", tx.quality(F.col("text")).alias("quality"))


def clean_lines(s, sf):
    return docs(s, sf).select("document_id", F.md5(tx.clean_text(F.col("text"))).alias("clean"))


def _redacted(s, sf):
    """Whole texts with a secret added."""
    pick = F.element_at(F.array(*[F.lit(x) for x in SECRETS]), (F.col("document_id") % len(SECRETS) + 1).cast("int"))
    return tx.once(docs(s, sf), r=tx.redacted(F.concat("text", F.lit("\n"), pick)))


def redaction(s, sf):
    return _redacted(s, sf).select("document_id", F.md5("r.text").alias("text"), F.col("r.n").alias("n"))


def redaction_totals(s, sf):
    return _redacted(s, sf).groupBy("tenant_id").agg(F.sum("r.n").alias("redactions"))


def credential_hints(s, sf):
    return docs(s, sf).select("document_id", tx.has_credentials(F.col("text")).alias("credentials"))


def content_types(s, sf):
    return docs(s, sf).select("document_id", tx.content_type(tx.norm(F.substring("text", 1, 12000))).alias("kind"))


def line_shapes(s, sf):
    c = chunks(s, sf)
    return c.select("chunk_id", tx.bullet(F.col("content")).alias("bullet"), tx.heading(F.col("content")).alias("heading"), F.round(tx.upper_ratio(F.col("content")), 9).alias("upper"))


def sentence_split(s, sf):
    return docs(s, sf).select("document_id", F.size(tx.sentences(F.col("text"))).alias("n"))


def content_hash(s, sf):
    t = F.col("text").cast("binary")
    return docs(s, sf).select("document_id", F.sha2(t, 256).alias("sha256"), F.octet_length("text").alias("size"))


def numbers(s, sf):
    n = table(s, sf, "orders").select("o_orderkey", "o_totalprice")
    shown = n.withColumn("t", F.concat(F.lit("$"), F.regexp_replace(F.format_string("%.2f", "o_totalprice"), r"\.", ",")))
    return shown.select("o_orderkey", F.round(tx.locale_number(F.col("t")), 2).alias("value"))


def summary_headings(s, sf):
    c = chunks(s, sf)
    return c.select("chunk_id", dp.summary_heading(F.col("content")).alias("heading"), dp.noisy_capitals(F.col("content")).alias("noisy"))


def academic_lines(s, sf):
    """Lines, every third with a reference added."""
    c = chunks(s, sf).withColumn("t", F.when(F.col("chunk_index") % 3 == 0, F.concat(F.col("content"), F.lit(", ISBN 99 (2001)"))).otherwise(F.col("content")))
    return c.select("chunk_id", dp.academic_noise(F.col("t")).alias("noise"))


def purposes(s, sf):
    n = tx.norm(F.substring("text", 1, 12000))
    return docs(s, sf).select("document_id", dp.rule_value(n, dp.PURPOSES, "análisis").alias("purpose"))


def visible_answers(s, sf):
    t = F.concat(F.lit("Fila 1: a = b\n\n\n[chunk_id: 3]"), F.col("text"), F.lit("\nHoja: X\nUno.Dos  tres"))
    return docs(s, sf).select("document_id", F.md5(dp.final(t)).alias("final"))


def raw_answers(s, sf):
    return docs(s, sf).select("document_id", dp.raw_text(F.substring("text", 5, 200), F.col("text")).alias("raw"))


def tags(s, sf):
    return docs(s, sf).select("document_id", tx.tag(F.concat(F.lit(" #"), F.col("collection_id"), F.lit(" Uno  Dos "))).alias("tag"))


def previews(s, sf):
    return docs(s, sf).select("document_id", F.left(F.coalesce("text", F.lit("")), F.lit(160)).alias("preview"))


def cosines(s, sf):
    v = table(s, sf, "embeddings")
    q = F.array(*[F.lit(1.0 if i % 2 else -0.5) for i in range(64)])
    return v.select("vec_id", F.round(tx.cosine(F.col("embedding"), q), 9).alias("cosine"))


_W = f"SELECT document_id, {sql_tokens(sql_norm('text'))} AS w FROM ({DOCS})"


def _fuzzy(words: str, term: str) -> str:
    k = 2 if len(term) >= 9 else 1
    return f"len(list_filter({words}, lambda w: len(w) >= 5 AND abs(len(w) - {len(term)}) <= {k} AND levenshtein(w, '{term}') <= {k}))"


def _staged_redact(source: str) -> str:
    """One subquery for each pattern, as each sees what the ones before left."""
    sql = f"SELECT *, 0 AS n FROM ({source})"
    for p in lx.SECRET_PATTERNS:
        q = p.replace("'", "''")
        sql = f"SELECT * REPLACE (regexp_replace(t, '{q}', '{lx.REDACTED}', 'g') AS t, n + len(regexp_extract_all(t, '{q}')) AS n) FROM ({sql})"
    return sql


_PICK = f"list_extract([{quoted(SECRETS)}], CAST(document_id % {len(SECRETS)} + 1 AS INTEGER))"
_BARE = r"""regexp_replace(w, '^[.,;:!?()\[\]{}"'']+|[.,;:!?()\[\]{}"'']+$', '', 'g')"""

QUALITY_SQL = rf"""
WITH a AS (SELECT document_id, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '') AS ws FROM ({DOCS})),
b AS (SELECT document_id, len(ws) AS n, list_transform(ws, lambda w: {_BARE}) AS bare FROM a),
c AS (SELECT document_id, n,
  len(list_filter(bare, lambda w: len(w) >= 3 AND regexp_matches(w, '\p{{L}}'))) AS good,
  len(list_filter(bare, lambda w: len(w) <= 2 AND w = lower(w) AND regexp_matches(w, '\p{{L}}'))) AS short,
  len(list_filter(bare, lambda w: len(w) >= 18 AND w = lower(w) AND regexp_matches(w, '\p{{L}}'))) AS endless,
  array_to_string(bare, '') AS j FROM b),
d AS (SELECT *, len(regexp_replace(j, '[^\p{{L}}]', '', 'g')) AS letters, len(j) AS runes FROM c)
SELECT document_id, CAST(CASE WHEN n = 0 THEN 0 ELSE greatest(0, least(100,
  good * 100 // n - short * 35 // n - endless * 3 - CASE WHEN runes > 0 AND letters * 100 // runes < 55 THEN 15 ELSE 0 END)) END AS INTEGER) AS quality FROM d"""

_STEPS = [
    (r"[\t\f\x0B\p{Zs}]+", " "), (r"^ +| +$", ""), (r"[ \t\n\f\r]+([,.;:!?])", r"\1"), (r"([,.;:!?])([A-Za-zÁÉÍÓÚÑáéíóúñ])", r"\1 \2"),
    (r"\([ \t\n\f\r]+", "("), (r"[ \t\n\f\r]+\)", ")"), (r"[ \t\n\f\r]*([/\\|])[ \t\n\f\r]*", r" \1 "), (r"[ \t\n\f\r]*([=-]{2,})[ \t\n\f\r]*", r" \1 "), (r"[\t\f\x0B\p{Zs}]+", " "),
]
_CLEAN = "x"
for _p, _r in _STEPS:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '{_r}', 'g')"
CLEAN_SQL = f"""SELECT document_id, md5(trim(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim({_CLEAN})), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS clean FROM ({DOCS})"""

_CREDENTIAL = lx.CREDENTIAL_PATTERN.replace("'", "''")
_T = r"trim(content)"
_LW = r"list_filter(regexp_split_to_array(trim(content), '\s+'), lambda w: w <> '')"
SHAPES_SQL = rf"""
WITH a AS (SELECT chunk_id, trim(content) AS t, {_LW} AS ws, content FROM ({CHUNKS})),
b AS (SELECT *, list_transform(ws, lambda w: regexp_replace(w, '^[\[\](){{}}:.\-]+|[\[\](){{}}:.\-]+$', '', 'g')) AS bare,
  regexp_matches(t, '^(?:[-*•·] )|^[)\].]*[+-]?[0-9]{{1,18}}[)\].]*(?:\s|$)|^[A-Za-z]\)(?:\s|$)') AS bullet,
  len(regexp_replace(content, '[^\p{{L}}]', '', 'g')) AS letters, len(regexp_replace(content, '[^\p{{Lu}}]', '', 'g')) AS uppers FROM a),
c AS (SELECT *, len(ws) AS n, len(list_filter(bare, lambda w: w = upper(w) AND regexp_matches(w, '\p{{L}}'))) AS up,
  len(list_filter(bare, lambda w: regexp_matches(w, '^\p{{Lu}}'))) AS title FROM b)
SELECT chunk_id, bullet,
  coalesce(t <> '' AND len(t) <= 120 AND NOT regexp_matches(t, '[.,;]$') AND NOT bullet AND n >= 1 AND n <= 12 AND (
    regexp_matches(regexp_replace(ws[1], '^[.)]+|[.)]+$', '', 'g'), '^[+-]?[0-9]{{1,18}}(?:\.(?:[+-]?[0-9]{{1,18}})?){{0,3}}$') OR up = n OR (n <= 8 AND title >= n - 1)), false) AS heading,
  round(CASE WHEN letters = 0 THEN 0.0 ELSE CAST(uppers AS DOUBLE) / letters END, 9) AS upper FROM c"""

QUERIES = {
    "text_norm": (text_norm, f"SELECT document_id, md5({sql_norm('text')}) AS norm, len({sql_norm('text')}) AS n FROM ({DOCS})"),
    "marked_norm": (marked_norm, f"SELECT document_id, md5(n) AS norm, len(n) AS n FROM (SELECT document_id, {sql_norm(chr(116))} AS n FROM (SELECT document_id, translate(text, '{PLAIN_LETTERS}', '{MARKED_LETTERS}') || ' Ελλάδα Ἀθῆναι Tiếng Việt Čeština szőlő țară' AS t FROM ({DOCS})))"),
    "text_terms": (text_terms, f"SELECT document_id, len(t) AS n, md5(array_to_string(list_sort(t), ' ')) AS terms FROM (SELECT document_id, {sql_terms(sql_norm('text'))} AS t FROM ({DOCS}))"),
    "term_counts": (term_counts, f"""SELECT document_id, len(w) AS words, {sql_whole('w', TERM)} AS whole, {_fuzzy('w', TERM)} AS near, {_fuzzy('w', LONG)} AS near_long,
      len(list_filter(w, lambda x: starts_with(x, '{LONG[:7]}') OR contains(x, '{LONG}') OR (len(x) >= 5 AND contains('{LONG}', x)))) > 0 AS partial FROM ({_W})"""),
    "substring_any": (substring_any, f"SELECT document_id, contains(n, 'thble') OR contains(n, 'cionas') AS hit FROM (SELECT document_id, {sql_norm('text')} AS n FROM ({DOCS}))"),
    "term_overlap": (term_overlap, f"""SELECT document_id, round(CASE WHEN len(t) = 0 THEN 0.0 ELSE CAST(i AS DOUBLE) / (len(t) + 5 - i) END, 9) AS jaccard FROM (
      SELECT document_id, t, len(list_intersect(t, ['the', 'of', 'thing', 'on', 'at'])) AS i FROM (SELECT document_id, {sql_terms(sql_norm('text'))} AS t FROM ({DOCS})))"""),
    "text_quality": (text_quality, QUALITY_SQL),
    "clean_lines": (clean_lines, CLEAN_SQL),
    "redaction": (redaction, f"SELECT document_id, md5(t) AS text, CAST(n AS INTEGER) AS n FROM ({_staged_redact(f'SELECT document_id, text || chr(10) || {_PICK} AS t FROM ({DOCS})')})"),
    "redaction_totals": (redaction_totals, f"SELECT tenant_id, CAST(sum(n) AS BIGINT) AS redactions FROM ({_staged_redact(f'SELECT tenant_id, text || chr(10) || {_PICK} AS t FROM ({DOCS})')}) GROUP BY tenant_id"),
    "credential_hints": (credential_hints, f"SELECT document_id, regexp_matches(text, '{_CREDENTIAL}') OR contains(text, '{lx.REDACTED}') OR contains(n, 'bearer token') OR contains(n, 'authorization bearer') OR contains(n, 'client secret') OR contains(n, 'api key') AS credentials FROM (SELECT *, {sql_norm('text')} AS n FROM ({DOCS}))"),
    "content_types": (content_types, f"""SELECT document_id, CASE WHEN len(list_intersect(w, [{quoted(lx.TECHNICAL_WORDS)}])) > 0 OR {' OR '.join(f"contains(n, '{x}')" for x in lx.TECHNICAL_PARTS)} THEN 'technical'
      WHEN len(list_intersect(w, [{quoted(lx.TABLE_WORDS)}])) > 0 THEN 'table' ELSE 'narrative' END AS kind FROM (SELECT document_id, n, {sql_tokens('n')} AS w FROM (SELECT document_id, {sql_norm('left(text, 12000)')} AS n FROM ({DOCS})))"""),
    "line_shapes": (line_shapes, SHAPES_SQL),
    "sentence_split": (sentence_split, f"SELECT document_id, len(list_filter(string_split(regexp_replace(text, '([.!?;])', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' ) <> '')) AS n FROM ({DOCS})"),
    "content_hash": (content_hash, f"SELECT document_id, sha256(text) AS sha256, strlen(text) AS size FROM ({DOCS})"),
    "locale_numbers": (numbers, "SELECT o_orderkey, round(CAST(replace(printf('%.2f', o_totalprice), ',', '') AS DOUBLE), 2) AS value FROM orders"),
    "summary_headings": (summary_headings, rf"""SELECT chunk_id, t <> '' AND len(t) <= 90 AND (regexp_matches(t, '(?i)^[ivxlcdm]+\s*[.):\-]\s+.+$') OR regexp_matches(t, '^\d+(?:\.\d+){{0,3}}\s*[.):\-]?\s+\S.+$') OR (ends_with(t, ':') AND len(t) <= 70 AND n <= 8) OR (n BETWEEN 2 AND 10 AND l > 0 AND u / l >= 0.8)) AS heading,
      n BETWEEN 2 AND 8 AND l > 0 AND u * 100 // greatest(l, 1) >= 85 AS noisy FROM (SELECT chunk_id, trim(content) AS t, len({_LW}) AS n, len(regexp_replace(content, '[^\p{{L}}]', '', 'g')) AS l, len(regexp_replace(content, '[^\p{{Lu}}]', '', 'g')) AS u FROM ({CHUNKS}))"""),
    "academic_lines": (academic_lines, None),
    "purposes": (purposes, f"SELECT document_id, CASE {' '.join('WHEN ' + ' OR '.join(f"contains(n, '{x}')" for x in xs) + f" THEN '{k}'" for k, xs in dp.PURPOSES.items())} ELSE 'análisis' END AS purpose FROM (SELECT document_id, {sql_norm('left(text, 12000)')} AS n FROM ({DOCS}))"),
    "visible_answers": (visible_answers, None),
    "raw_answers": (raw_answers, None),
    "tag_names": (tags, f"SELECT document_id, lower(collection_id) || '-uno-dos' AS tag FROM ({DOCS})"),
    "previews": (previews, f"SELECT document_id, left(coalesce(text, ''), 160) AS preview FROM ({DOCS})"),
    "cosines": (cosines, "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_transform(range(64), lambda i: CASE WHEN i % 2 = 1 THEN 1.0::DOUBLE ELSE -0.5::DOUBLE END)), 9) AS cosine FROM embeddings"),
}
