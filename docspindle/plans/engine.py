"""The two entry points of a retrieval service, as plans over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import display as dp
from ..functions import intent as it
from ..functions import questions as qs
from ..functions import text as tx
from ..operators import chunker, extract, reports, search, select, tabular

NOTHING = "No se encontró información suficiente en los documentos."

# Chunks of an answer's context by kind of question, and over several documents.
CONTEXT = {"question": 8, "summary": 30, "section": 10, "structure": 12}
SEVERAL, EACH = 20, 2


@dataclass
class Scope:
    """What a request may see: a tenant, and documents by id, collection, tag or favourite."""

    tenant: str
    ids: tuple[str, ...] = ()
    collection: str = ""
    tag: str = ""
    favorites: bool = False


@dataclass
class Retrieval:
    """`chunks`: tenant_id, document_id, chunk_id, chunk_index, content; `documents`: tenant_id,
    document_id, collection_id, is_favorite; `tags`: document_id, tag. `answer` writes an
    answer from (question, context) where a language model is at hand; without it answers
    are extracts."""

    documents: DataFrame
    chunks: DataFrame
    tags: DataFrame | None = None
    answer: Callable[[str, str], str] | None = None

    def scoped(self, scope: Scope) -> DataFrame:
        """The chunks of a scope; conditions on documents become semi-joins, the tenant a filter of both scans."""
        d = self.documents.filter(F.col("tenant_id") == scope.tenant)
        c = self.chunks.filter(F.col("tenant_id") == scope.tenant)
        if scope.ids:
            c = c.filter(F.col("document_id").isin(*scope.ids))
        if scope.collection:
            d = d.filter(F.col("collection_id") == scope.collection)
        if scope.favorites:
            d = d.filter("is_favorite")
        if scope.tag and self.tags is not None:
            d = d.join(self.tags.filter(F.col("tag") == scope.tag).select("document_id"), "document_id", "left_semi")
        return c.join(d.select("document_id"), "document_id", "left_semi")

    def search(self, query: str, scope: Scope, top_k: int = 0) -> DataFrame:
        """Without ids over all of the tenant's chunks; else by the kind of the query."""
        c = self.scoped(scope)
        kind = it.query_type(query)
        k = it.top_k(top_k, kind, it.precision(query))
        if not scope.ids:
            return search.global_search(c, query, min(k, 20))
        if kind == "summary":
            order = c.withColumn("created_at", F.col("document_id")) if "created_at" not in c.columns else c
            return search.summary_chunks(order, k)
        if kind == "structure":
            return search.structure_search(c, k)
        several = len(scope.ids) > 1
        return search.scoped_search(c, query, k, fallback=min(k, 20) if several else 3)

    def context(self, question: str, scope: Scope) -> DataFrame:
        """The chunks an answer reads: some of each document if there are several, then the best."""
        kind = it.query_type(question)
        found = search.text_matches(self.scoped(scope), question).drop("norm", "words", "topic_count")
        if len(scope.ids) != 1:
            return select.coverage(found, EACH, SEVERAL)
        return found.orderBy(F.desc("score"), "chunk_index", "chunk_id").limit(CONTEXT[kind])

    def ask(self, question: str, scope: Scope) -> dict:
        """answer, sources and kind. Only the context, a bounded number of chunks, comes to the driver.

        A question that names a topic of which the context lacks a word has no answer."""
        kind, i = it.query_type(question), it.intent(question)
        rows = self.context(question, scope).orderBy("document_id", "chunk_index").collect()
        words = {w for r in rows for w in it.norm(r["content"] or "").split()}
        if not rows or not all(words & set(qs.topic_forms(t)) for t in qs.asked_topic(question)):
            return {"answer": NOTHING, "sources": [], "kind": kind}
        spark = self.chunks.sparkSession
        c = spark.createDataFrame([(str(r["document_id"]), int(r["chunk_index"]), str(r["chunk_id"]), r["content"]) for r in rows], "document_id string, chunk_index int, chunk_id string, content string")
        text = "\n\n".join(f"[{r['document_id']}] {r['content']}" for r in rows)
        answer = self.answer(question, text[:18_000]) if self.answer else self.extract(c, i)
        clean = spark.createDataFrame([(answer,)], "a string").select(tx.redact(dp.final(F.col("a")))[0].alias("a")).first()["a"]
        sources = list(dict.fromkeys(str(r["document_id"]) for r in rows))[:26]
        return {"answer": clean, "sources": [{"mark": chr(65 + n), "document_id": d} for n, d in enumerate(sources)], "kind": kind}

    def extract(self, chunks: DataFrame, i: it.Intent) -> str:
        """The first extractor that finds something: tables, comparison, date if one is asked for, definition, person, quantity, points."""
        rows = tabular.parse_rows(chunks.select("document_id", F.explode(F.split("content", "\n")).alias("content")))
        if it.tabular(i.query) and rows.limit(1).count():
            s = tabular.numeric_summary(rows, i.main_terms[-1] if i.main_terms else "valor").first()
            if s["n"]:
                return f"Registros: {s['n']}. Promedio: {s['mean']:g}. Mínimo: {s['least']:g}. Máximo: {s['greatest']:g}."
        ways = [lambda: extract.definitions(chunks, i), lambda: extract.people(chunks, i), lambda: extract.spans(chunks, i, extract.QUANTITY)]
        if it.document_task(i.query) == "dates":
            ways.insert(0, lambda: extract.spans(chunks, i, extract.DATE))
        if " entre " in f" {i.normalised} " and len(i.main_terms) > 1:
            found = extract.compare(chunks, *i.main_terms[-2:]).first()
            if found:
                return found["answer"]
        for way in ways:
            found = way().orderBy(F.desc("score"), "document_id").first()
            if found:
                return found["sentence"]
        points = extract.useful_points(chunks, 5).orderBy("document_id", "place").limit(5).collect()
        return "\n".join(f"- {p['sentence']}" for p in points) or NOTHING

    def summary(self, scope: Scope) -> DataFrame:
        """Key points of each document, from its sentences."""
        return chunker.key_points(extract.sentence_rows(self.scoped(scope)).filter(F.size("words") >= 5))

    def report(self, scope: Scope) -> DataFrame:
        """Kinds and readability of each collection in the scope."""
        c = self.scoped(scope)
        texts = c.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "\n").alias("text"))
        return reports.overview(reports.profiles(texts).join(self.documents.select("document_id", "collection_id"), "document_id"), "collection_id")
