"""Answers taken from sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as lx
from ..functions import text as tx
from ..functions.intent import Intent

# Patterns on normalised text.
DATE = r"\b(?:[0-9]{1,2} de [a-z]+(?: de [0-9]{4})?|[0-9]{1,2}[ /-][0-9]{1,2}[ /-][0-9]{2,4}|[0-9]{4})\b"
QUANTITY = r"\b[0-9]+(?:[.,][0-9]+)?\b"
PERSON = r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+"


#: Where sentences end.
ENDS = r"[\n.?!;]"


def sentence_rows(chunks: DataFrame, holding: list[str] | None = None) -> DataFrame:
    """One row per sentence: its document, place and normalised text. With `holding`, normalised words, those
    that surely hold none of them are left out before they are normalised."""
    cut = chunks.select("document_id", "chunk_index", F.posexplode(tx.sentences(F.col("content"), ENDS)).alias("at", "sentence"))
    if holding is not None:
        cut = cut.filter(tx.may_hold(F.col("sentence"), holding))
    found = tx.once(cut, norm=tx.norm(F.col("sentence"))).filter("norm <> ''")
    return tx.once(found, words=tx.tokens(F.col("norm")))


def score(i: Intent) -> Column:
    """4 for the entity, 3 for the phrase, 1 for each main term."""
    n = F.col("norm")
    s = tx.total([F.when(tx.whole_count(F.col("words"), t) > 0, 1.0).otherwise(0.0) for t in i.main_terms])
    if i.entity:
        s = s + F.when(n.contains(i.entity), 4.0).otherwise(0.0)
    if i.phrase:
        s = s + F.when(n.contains(i.phrase), 3.0).otherwise(0.0)
    return s


def best(sentences: DataFrame, score: Column, least: float) -> DataFrame:
    """Each document's best sentence of `least` or more; the first of equals."""
    scored = sentences.withColumn("score", score).filter(F.col("score") >= least)
    top = F.min(F.struct((-F.col("score")).alias("s"), "chunk_index", "at", "sentence")).alias("x")
    return scored.groupBy("document_id").agg(top).select("document_id", (-F.col("x.s")).alias("score"), "x.chunk_index", "x.at", "x.sentence")


def definitions(chunks: DataFrame, i: Intent) -> DataFrame:
    # Only what holds one of the query's words scores, the first words of its phrases among them.
    s = sentence_rows(chunks, list(dict.fromkeys([*i.terms, *i.main_terms, *i.phrase.split()[:1], *i.entity.split()[:1]])))
    return best(s, score(i) + F.when(tx.definition_like(F.col("norm"), i.terms), 2.0).otherwise(0.0), 2.0)


def people(chunks: DataFrame, i: Intent) -> DataFrame:
    s = sentence_rows(chunks)
    marks = tx.contains_any(F.col("norm"), ["dirigido", "responsable", "autor", "nombre"])
    return best(s, score(i) + F.when(F.col("sentence").rlike(PERSON), 3.0).otherwise(0.0) + F.when(marks, 1.0).otherwise(0.0), 3.0)


def spans(chunks: DataFrame, i: Intent, pattern: str, least: float = 1.0) -> DataFrame:
    """Best sentences that hold the pattern, no question, with what it matches."""
    pattern = tx.ascii_boundary(pattern)
    s = sentence_rows(chunks).filter(F.col("norm").rlike(pattern) & ~F.col("sentence").contains("¿"))
    verbs = tx.contains_any(F.col("norm"), lx.FACT_VERBS)
    found = best(s, score(i) + F.when(verbs, 3.0).otherwise(0.0), least)
    return found.withColumn("span", F.regexp_extract(tx.norm(F.col("sentence")), pattern, 0))


def compare(chunks: DataFrame, a: str, b: str) -> DataFrame:
    """Each document's first sentence with both terms, or else the first of each."""
    s = sentence_rows(chunks)
    has_a, has_b = F.col("norm").contains(a), F.col("norm").contains(b)
    place = F.struct("chunk_index", "at", "sentence")
    firsts = s.filter(has_a | has_b).groupBy("document_id").agg(F.min(F.when(has_a & has_b, place)).alias("both"), F.min(F.when(has_a, place)).alias("a"), F.min(F.when(has_b, place)).alias("b"))
    return firsts.select("document_id", F.coalesce("both.sentence", F.concat_ws(" | ", "a.sentence", "b.sentence")).alias("answer"), F.col("both").isNotNull().alias("together"))


def useful_points(chunks: DataFrame, most: int) -> DataFrame:
    """Distinct sentences of five words or more, half letters or more, 220 characters at most."""
    # A document's first points are among the first of each of its chunks: sentences are read in
    # order, and once a chunk has enough the rest are neither normalised nor shuffled.
    def letters(x: Column) -> Column:
        return F.length(F.regexp_replace(x, r"[^\p{L}]", ""))

    def step(kept: Column, x: Column) -> Column:
        def more(n: Column) -> Column:
            new = (F.size(tx.tokens(n)) >= 5) & ~F.exists(kept, lambda y: y["norm"] == n)
            return F.when(new, F.concat(kept, F.array(F.struct(x["at"].alias("at"), x["sentence"].alias("sentence"), n.alias("norm"))))).otherwise(kept)

        fits = (F.length(x["sentence"]) <= 220) & (letters(x["sentence"]) * 2 >= F.length(x["sentence"]))
        return F.when((F.size(kept) < most) & fits, tx.let(tx.norm(x["sentence"]), more)).otherwise(kept)

    cut = F.transform(tx.sentences(F.col("content"), ENDS), lambda x, i: F.struct(i.alias("at"), x.alias("sentence")))
    none = F.array().cast("array<struct<at:int,sentence:string,norm:string>>")
    ok = tx.once(chunks.select("document_id", "chunk_index", "content"), points=F.aggregate(cut, none, step)).select("document_id", "chunk_index", F.inline("points"))
    place = Window.partitionBy("document_id").orderBy("chunk_index", "at")
    first = ok.groupBy("document_id", "norm").agg(F.min(F.struct("chunk_index", "at", "sentence")).alias("x")).select("document_id", "x.*")
    return first.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= most)


def term_ranking(sentences: DataFrame, most: int = 10) -> DataFrame:
    """Each document's most frequent terms: count, bytes, then the term."""
    # Dealt out by document once, the counts and the ranks stay where the words are.
    t = sentences.select("document_id", F.filter("words", lambda w: (F.length(w) >= 4) & ~w.isin(*lx.STOP_WORDS)).alias("terms"))
    t = t.repartition("document_id").select("document_id", F.explode("terms").alias("term"))
    n = t.groupBy("document_id", "term").count()
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("count"), F.desc(F.octet_length("term")), "term"))
    return n.withColumn("rank", rank).filter(F.col("rank") <= most)


def grounding(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """Which share of an answer's terms of five letters or more its context lacks, and whether that is too much."""
    def long_terms(c: str) -> Column:
        return F.filter(tx.terms(tx.norm(F.col(c))), lambda w: F.length(w) >= 5)

    both = tx.once(answers.join(contexts, "document_id"), checked=long_terms("answer"), known=long_terms("context"))
    both = tx.once(both, missing=F.array_except("checked", "known"))
    n, m = F.size("checked"), F.size("missing")
    bad = F.when(n < 8, m >= 5).otherwise((m >= 6) & (m / n >= 0.38))
    return both.select("document_id", n.alias("n_terms"), m.alias("n_missing"), bad.alias("unsupported"))


def lettered(sources: DataFrame, order: list[str]) -> DataFrame:
    """Up to 26 distinct sources of each answer with letters from A."""
    one = sources.dropDuplicates(["answer_id", "document_id"])
    place = F.row_number().over(Window.partitionBy("answer_id").orderBy(*order))
    return one.withColumn("place", place).filter("place <= 26").withColumn("mark", F.chr(64 + F.col("place")))
