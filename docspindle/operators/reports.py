"""Document profiles and reports over several documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .concat import head_of_concatenation
from pyspark.sql.window import Window

from ..functions import display as dp
from ..functions import lexicon as lx
from ..functions import text as tx
from ..functions.intent import least_relevance, query_type, relevance_terms
from ..functions.questions import asked_topic, topic_forms


def profiles(texts: DataFrame) -> DataFrame:
    """document_id, kind, credentials, quality, readable from (document_id, text)."""
    n = tx.once(texts, norm=tx.norm(F.col("text")), quality=tx.quality(F.substring("text", 1, 6000)))
    return n.select("document_id", tx.content_type(F.col("norm")).alias("kind"), tx.has_credentials(F.col("text"), F.col("norm")).alias("credentials"), "quality", (F.col("quality") >= 45).alias("readable"))


def overview(profiles_: DataFrame, by: str) -> DataFrame:
    """Kinds of each group, distinct and in order, and how many of its documents are readable."""
    return profiles_.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set("kind")), ", ").alias("kinds"), F.count("*").alias("documents"), F.count_if("readable").alias("readable"))


def presentation_rank(kind) -> object:
    return F.when(kind == "narrative", 0).when(kind == "technical", 1).otherwise(2)


def context(chunks: DataFrame, limit: int = 18_000) -> DataFrame:
    """Each document's numbered context block."""
    line = F.concat(F.lit("["), F.col("chunk_index").cast("string"), F.lit("] "), F.trim("content"))
    return head_of_concatenation(chunks.filter(F.trim("content") != ""), line, limit).withColumnRenamed("text", "context")


def outline(chunks: DataFrame, most: int = 12) -> DataFrame:
    """document_id, place, line: the first `most` different lines of a document with a roman or other number before them."""
    lines = chunks.select("document_id", "chunk_index", F.posexplode(F.split(F.regexp_replace("content", "\r\n", "\n"), "\n")).alias("at", "raw"))
    lines = tx.once(lines, line=dp.visible(F.col("raw")))
    lines = tx.once(lines.filter(F.col("line").rlike(dp.ROMAN) | F.col("line").rlike(dp.NUMERIC)), norm=tx.norm(F.col("line"))).filter("norm <> ''")
    # Equal lines meet in an aggregation, so the ranking sees each once.
    first = lines.groupBy("document_id", "norm").agg(F.min(F.struct("chunk_index", "at", "line")).alias("x"))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("x"))
    return first.withColumn("place", place).filter(F.col("place") <= most).select("document_id", "place", F.concat(F.lit("- "), F.col("x.line")).alias("line"))


def relevance(chunks: DataFrame, question: str) -> DataFrame:
    """document_id, relevance, relevant: the share of the question's terms that a document's chunks hold.
    Summaries and structures need none."""
    terms = relevance_terms(question)
    if query_type(question) in ("summary", "structure") or not terms:
        return chunks.select("document_id").distinct().select("document_id", F.lit(1.0).alias("relevance"), F.lit(True).alias("relevant"))
    n = tx.once(chunks, norm=tx.norm(F.col("content")))
    held = n.groupBy("document_id").agg(*[F.max(F.col("norm").contains(t)).cast("int").alias(f"t{i}") for i, t in enumerate(terms)])
    share = sum((F.col(f"t{i}") for i in range(1, len(terms))), F.col("t0")) / F.lit(float(len(terms)))
    return held.select("document_id", share.alias("relevance"), (share >= least_relevance(question)).alias("relevant"))


def named_sources(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """`sources` (document_id, ...) with the name and sheet flag of their documents, spreadsheets last."""
    names = documents.select(F.col("document_id").alias("__of"), "name")
    found = sources.join(names, F.col("document_id") == F.col("__of"), "left").drop("__of")
    return found.withColumn("is_sheet", F.coalesce(F.lower("name").rlike(r"\.(?:xlsx|xls|csv)$"), F.lit(False)))


def topic_support(chunks: DataFrame, question: str) -> DataFrame:
    """document_id, supported: whether a document's chunks hold every word of the topic that the
    question names, in singular or plural; all do if it names none."""
    words = asked_topic(question)
    if not words:
        return chunks.select("document_id").distinct().withColumn("supported", F.lit(True))
    # Chunks that surely hold no form are not normalised; their documents stay.
    some = tx.may_hold(F.col("content"), [f for w in words for f in topic_forms(w)])
    n = tx.once(chunks, words=F.when(some, tx.tokens(tx.norm(F.col("content")))).otherwise(F.array().cast("array<string>")))
    held = n.groupBy("document_id").agg(*[F.bool_or(F.arrays_overlap("words", F.array(*map(F.lit, topic_forms(w))))).alias(f"t{i}") for i, w in enumerate(words)])
    return held.select("document_id", F.forall(F.array(*[f"t{i}" for i in range(len(words))]), lambda x: x).alias("supported"))


def grounding_reasons(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """document_id, reasons: why an answer (document_id, answer, name) is not grounded in its
    context (document_id, context), none if it is. Null texts are blank."""
    def blank(c: str) -> Column:
        return F.trim(F.coalesce(c, F.lit("")))

    both = answers.join(contexts, "document_id").select("document_id", *[tx.norm(blank(c)).alias(c) for c in ("answer", "context", "name")])
    long_words = F.filter(tx.tokens(F.col("answer")), lambda w: (F.length(w) >= 6) & ~w.isin(*lx.ASK_STOP_WORDS, *lx.GROUNDING_STOP_WORDS) & ~w.startswith("document"))
    both = tx.once(both, checked=F.filter(F.array_distinct(long_words), lambda w: ~F.col("name").contains(w)), size=F.size(tx.tokens(F.col("context"))))
    both = tx.once(both, missing=F.size(F.filter("checked", lambda w: ~F.col("context").contains(w))))
    n, m = F.size("checked"), F.col("missing")

    def alone(phrases: list[str]) -> Column:
        return tx.any_of([F.col("answer").contains(p) & ~F.col("context").contains(p) for p in phrases])

    reasons = {
        "unsupported_content": alone(lx.SUSPICIOUS),
        "unsupported_topics": F.when(n < 8, m >= 5).otherwise((m >= 6) & (F.floor(m * 100 / n) >= 38)),
        "unsupported_generic_phrase": alone(lx.UNGROUNDED),
        "template_answer": alone(lx.TEMPLATES),
        "possible_contradiction": tx.contains_any(F.col("answer"), lx.DENIALS) & (F.col("size") >= lx.DENIED_WORDS),
        "too_short_for_summary": tx.contains_any(F.col("answer"), lx.SUMMARY_SIGNS) & (F.col("size") >= lx.SUMMARISED_WORDS) & (F.size(tx.tokens(F.col("answer"))) < lx.SHORT_SUMMARY),
    }
    found = F.array_compact(F.array(*[F.when(test, name) for name, test in reasons.items()]))
    empty = F.when(F.col("answer") == "", F.array(F.lit("empty_answer"))).when(F.col("context") == "", F.array(F.lit("empty_context")))
    return both.select("document_id", F.coalesce(empty, found).alias("reasons"))
