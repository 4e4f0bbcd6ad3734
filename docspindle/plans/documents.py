"""Outlines, relevance, sources, sheets and repairs over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display as dp
from ..functions import intent as it
from ..functions import lexicon as lx
from ..functions import scans
from ..functions import text as tx
from ..operators import catalog as cat
from ..operators import reports, search, sheets
from .base import CHUNKS, DOCS, chunks, docs, sql_norm, table

QUESTION = "cual thing attion blehe thble"
#: Joined words, expressions and numbers, for texts have none of them.
SPICE = " . Resumen: laduraciónde seisynueve,tresdosuno chunks recuperados el primer eje. Nuevemeses"


def outlines(s, sf):
    """Every text with a numbered line per language and one repeated."""
    c = chunks(s, sf).withColumn("content", F.concat(F.lit("2.1 "), F.col("tenant_id"), F.lit("\n"), F.col("content"), F.lit("\nIV. Parte de "), F.col("collection_id")))
    return reports.outline(c.select("document_id", "chunk_index", "content")).filter(F.col("line").startswith("- 2.1 ") | F.col("line").startswith("- IV. ")).select("document_id", "line")


def relevances(s, sf):
    r = reports.relevance(chunks(s, sf), QUESTION)
    return r.select("document_id", F.round("relevance", 9).alias("relevance"), "relevant")


def source_names(s, sf):
    d = docs(s, sf).select("document_id", F.concat("collection_id", F.when(F.col("document_id") % 2 == 0, ".XLSX").otherwise(".txt")).alias("name"))
    return reports.named_sources(table(s, sf, "embeddings").select(F.col("vec_id").alias("document_id")), d)


def effective_times(s, sf):
    e = table(s, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("uploaded"), F.when(F.col("event_id") % 2 == 0, F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("created"))
    at = cat.effective_time(F.col("uploaded"), F.col("created"), F.lit("2000-01-01").cast("timestamp"))
    return e.select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm").alias("at"))


def long_paragraphs(s, sf):
    return docs(s, sf).select("document_id", tx.long_paragraph(F.col("text")).alias("long"))


def sheet_like(s, sf):
    c = chunks(s, sf).withColumn("content", F.concat("content", F.when(F.col("chunk_index") == 1, "\n Columnas: a").otherwise(" Columnas: a")))
    return c.select("chunk_id", tx.spreadsheet_like(F.col("content")).alias("sheet"))


def word_windows(s, sf):
    w = docs(s, sf).select("document_id", tx.word_windows(tx.tokens(tx.norm(F.col("text"))), 2, 4).alias("w"))
    return w.select("document_id", F.size("w").alias("n"), F.md5(F.array_join("w", "|")).alias("windows"))


def parted_words(s, sf):
    return docs(s, sf).select("document_id", F.md5(tx.parted(F.concat(F.translate("text", "\t\r\n", "   "), F.lit(SPICE)))).alias("text"))


def clean_sentences(s, sf):
    c = chunks(s, sf).withColumn("content", F.concat(F.lit(".- Resumen: "), "content", F.lit(SPICE)))
    return c.select("chunk_id", tx.clean_sentence(F.col("content")).alias("sentence"))


def without_forbidden(s, sf):
    return docs(s, sf).select("document_id", dp.without_forbidden(F.concat("text", F.lit(SPICE))).alias("t")).select("document_id", F.md5("t").alias("text"))


def document_tasks(s, sf):
    """Tasks of the users' turns, with the words of a task added by number."""
    words = F.array(*[F.lit(x) for x in ["fecha", "contratante", "precio", "debera", "conflicto", "legal", "comparar", "resumen", ""]])
    t = table(s, sf, "conversations").withColumn("q", F.concat_ws(" ", F.element_at(words, (F.col("turn") % 9 + 1).cast("int")), F.col("role")))
    n = tx.once(t, norm=tx.norm(F.col("q")))
    return n.select("conv_id", "turn", dp.rule_value(F.col("norm"), {**lx.DOCUMENT_TASKS, "summary": lx.SUMMARY_WORDS}, "question").alias("task"))


def vector_json(s, sf):
    v = table(s, sf, "embeddings").select("vec_id", F.to_json("embedding").alias("json"))
    back = v.select("vec_id", F.from_json("json", "array<double>").alias("v"))
    return back.select("vec_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def fallback_scores(s, sf):
    found = search.fallback_scores(chunks(s, sf), "thing")
    return found.select("chunk_id", F.round("text_score", 9).alias("text_score"), F.round("score", 9).alias("score"))


def _sheet(s, sf):
    """Each customer segment is a sheet of its customers."""
    c = table(s, sf, "customer").select(F.col("c_nationkey").cast("long").alias("document_id"), F.col("c_mktsegment").alias("sheet"), F.col("c_custkey").cast("long").alias("number"), F.concat(F.lit("Fila "), F.col("c_custkey").cast("string"), F.lit(": Cliente = "), "c_name").alias("line"))
    heads = c.select("document_id", "sheet").distinct().select("*", F.array(F.lit("Cliente"), F.lit("Saldo")).alias("headers"), F.lit(True).alias("detected"))
    return heads, c


def sheet_chunks(s, sf):
    c = sheets.sheet_chunks(*_sheet(s, sf))
    return c.select("document_id", "sheet", "chunk_index", F.length("content").alias("n"), F.md5("content").alias("content"))


def sheet_overviews(s, sf):
    c = sheets.sheet_chunks(*_sheet(s, sf))
    return sheets.overviews(c.select("document_id", F.concat("sheet", F.format_string("%09d", "chunk_index")).alias("chunk_index"), "content"))


def image_texts(s, sf):
    """Every text with a misread word, stray symbols, a broken word and a short line that matters."""
    read = F.concat(F.lit("Ab\n"), "text", F.lit("\n| agua ; los desagiies ~ impor-\ntante\nRatones 3\nxyz"))
    return docs(s, sf).select("document_id", F.md5(scans.image_text(read)).alias("text"))


def scan_numbers(s, sf):
    d = docs(s, sf).select("document_id", scans.numbers(F.concat("text", F.lit(" 12 1.234 +34 600 12 "), F.col("document_id").cast("string"))).alias("x"))
    return d.select("document_id", F.size("x").alias("n"), F.array_join("x", "|").alias("numbers"))


def _replaced(x: str, pairs) -> str:
    for a, b in tx.joined_pairs(pairs):
        x = f"replace({x}, '{a}', '{b}')"
    return x


_TASKS = " ".join("WHEN " + " OR ".join(f"contains(n, '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in {**lx.DOCUMENT_TASKS, "summary": lx.SUMMARY_WORDS}.items())
_TERMS = it.relevance_terms(QUESTION)
_FORBIDDEN = f"text || '{SPICE}'"
for _p in lx.FORBIDDEN:
    _FORBIDDEN = f"regexp_replace({_FORBIDDEN}, '{_p}', '', 'g')"
_SUM = " + ".join(f"max(CASE WHEN contains(n, '{t}') THEN 1 ELSE 0 END)" for t in _TERMS)

#: Extensions and MIME types of uploads, known ones, odd ones and none.
EXTENSIONS = [".txt", ".CSV", ".pdf", ".docx", ".xlsx", ".xls", ".jpg", ".JPEG", ".png", ".gif", ".webp", ".bmp", ".tif", ".tiff", ".bin", ""]
MIMES = ["text/plain; charset=utf-8", "application/csv", " Application/PDF ", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.ms-excel", "image/heic", "application/zip", "", "text/csv"]


def file_types(s, sf):
    """The type of each document's upload: its number tells which extension and MIME type it had."""
    from ..sources.readers import file_type

    d = docs(s, sf)
    pick = lambda xs, by: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(by, F.lit(len(xs))) + 1).cast("int"))
    named = d.select("document_id", F.concat(F.col("collection_id"), F.lit("/file_"), F.col("document_id").cast("string"), pick(EXTENSIONS, F.col("document_id"))).alias("path"), pick(MIMES, F.expr("document_id div 16")).alias("mime"))
    return named.select("document_id", "path", file_type(F.col("path"), F.col("mime")).alias("file_type"))


def _sql_list(xs) -> str:
    return "[" + ", ".join("'" + x + "'" for x in xs) + "]"


FILE_TYPES_SQL = f"""
WITH f AS (SELECT doc_id AS document_id, source || '/file_' || doc_id || {_sql_list(EXTENSIONS)}[doc_id % {len(EXTENSIONS)} + 1] AS path, lower({_sql_list(EXTENSIONS)}[doc_id % {len(EXTENSIONS)} + 1]) AS e, lower(trim(split_part({_sql_list(MIMES)}[doc_id // 16 % {len(MIMES)} + 1], ';', 1))) AS m FROM documents)
SELECT document_id, path, CASE WHEN e = '.txt' THEN 'text' WHEN e = '.csv' THEN 'csv' WHEN e = '.pdf' THEN 'pdf' WHEN e = '.docx' THEN 'docx' WHEN e IN ('.xlsx', '.xls') THEN 'excel'
  WHEN e IN ('.jpg', '.jpeg', '.png', '.gif', '.webp', '.bmp', '.tif', '.tiff') THEN 'image' WHEN m = 'text/plain' THEN 'text' WHEN m IN ('text/csv', 'application/csv') THEN 'csv' WHEN m = 'application/pdf' THEN 'pdf'
  WHEN m LIKE '%wordprocessingml.document' THEN 'docx' WHEN m IN ('application/vnd.openxmlformats-officedocument.spreadsheetml.sheet', 'application/vnd.ms-excel') THEN 'excel' WHEN m LIKE 'image/%' THEN 'image' WHEN m = '' THEN 'unknown' ELSE m END AS file_type
FROM f
"""

QUERIES = {
    "file_types": (file_types, FILE_TYPES_SQL),
    "outline_lines": (outlines, f"SELECT document_id, '- 2.1 ' || tenant_id AS line FROM ({DOCS}) WHERE text IS NOT NULL UNION ALL SELECT document_id, '- IV. Parte de ' || collection_id FROM ({DOCS}) WHERE text IS NOT NULL"),
    "context_relevance": (relevances, f"SELECT document_id, round(({_SUM}) / {len(_TERMS)}.0::DOUBLE, 9) AS relevance, ({_SUM}) / {len(_TERMS)}.0::DOUBLE >= {it.least_relevance(QUESTION)} AS relevant FROM (SELECT document_id, {sql_norm('content')} AS n FROM ({CHUNKS})) GROUP BY document_id"),
    "source_names": (source_names, f"SELECT vec_id AS document_id, name, coalesce(ends_with(name, 'XLSX'), false) AS is_sheet FROM embeddings LEFT JOIN (SELECT document_id, collection_id || CASE WHEN document_id % 2 = 0 THEN '.XLSX' ELSE '.txt' END AS name FROM ({DOCS})) ON document_id = vec_id"),
    "effective_times": (effective_times, "SELECT event_id, strftime(coalesce(CASE WHEN event_id % 3 = 0 THEN ts END, CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 1 HOUR END, TIMESTAMP '2000-01-01'), '%Y-%m-%d %H:%M') AS at FROM events"),
    "long_paragraphs": (long_paragraphs, rf"SELECT document_id, len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: len(list_filter(regexp_split_to_array(p, '\s+'), lambda w: w <> '')) >= 45)) > 0 AS long FROM ({DOCS})"),
    "sheet_like": (sheet_like, f"SELECT chunk_id, chunk_index = 1 OR starts_with(trim(content || ' Columnas: a'), 'Columnas:') AS sheet FROM ({CHUNKS})"),
    "word_windows": (word_windows, f"""SELECT document_id, len(w) AS n, md5(array_to_string(w, '|')) AS windows FROM (SELECT document_id, flatten(list_transform([2, 3, 4], lambda k: list_transform(range(1, len(t) - k + 2), lambda i: array_to_string(t[i:i + k - 1], ' ')))) AS w
      FROM (SELECT document_id, list_filter(string_split({sql_norm('text')}, ' '), lambda w: w <> '') AS t FROM ({DOCS})))"""),
    "parted_words": (parted_words, None),
    "clean_sentences": (clean_sentences, None),
    "without_forbidden": (without_forbidden, rf"SELECT document_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_FORBIDDEN}, '[ \t]{{2,}}', ' ', 'g'), '(?m)^[ \t]+', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text FROM ({DOCS})"),
    "image_texts": (image_texts, None),
    "scan_numbers": (scan_numbers, rf"""SELECT document_id, len(k) AS n, array_to_string(k, '|') AS numbers FROM (SELECT document_id, list_filter(x, lambda v, i: len(regexp_replace(v, '[^0-9]', '', 'g')) >= 3 AND list_position(x, v) = i) AS k FROM (
      SELECT document_id, list_transform(regexp_extract_all(text || ' 12 1.234 +34 600 12 ' || document_id, '{scans.NUMBER}'), lambda v: trim(regexp_replace(v, '[\t\f\x0B\p{{Zs}}]+', ' ', 'g'), ' ')) AS x FROM ({DOCS})))"""),
    "document_tasks": (document_tasks, f"SELECT conv_id, turn, CASE {_TASKS} ELSE 'question' END AS task FROM (SELECT conv_id, turn, trim(list_extract(['fecha', 'contratante', 'precio', 'debera', 'conflicto', 'legal', 'comparar', 'resumen', ''], CAST(turn % 9 + 1 AS INTEGER)) || ' ' || role) AS n FROM conversations)"),
    "vector_json": (vector_json, "SELECT vec_id, len(embedding) AS n, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings"),
    "fallback_scores": (fallback_scores, None),
    "sheet_chunks": (sheet_chunks, None),
    "sheet_overviews": (sheet_overviews, "SELECT c_nationkey AS document_id, 'Cliente, Saldo' AS columns, CAST(arg_min(n, c_mktsegment) AS VARCHAR) AS rows FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) GROUP BY c_nationkey"),
}
