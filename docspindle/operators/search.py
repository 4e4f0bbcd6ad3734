"""Search over chunks: document_id, chunk_index, chunk_id, content (and embedding).

Operators take and return DataFrames; what a query asks is computed once on the
driver and becomes literals, so each search is one scan with a bounded top-k.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as lx
from ..functions import text as tx
from ..functions.intent import Intent, Topic, conceptual, factual, global_terms, intent, norm, precision, tabular, terms, text_terms, topic, weights
from .select import nearest_anchor

POSITION = ("document_id", "chunk_index", "chunk_id")


def _like(text: Column, part: str) -> Column:
    return text.ilike(f"%{part}%")


def global_search(chunks: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Chunks by how many of the query's terms they hold, in any case; at most 100.

    Accents are folded in the query only; % and _ in it are wildcards."""
    words = global_terms(query)
    score = tx.total([F.when(_like(F.col("content"), w), 1.0).otherwise(0.0) for w in words])
    found = chunks.filter(tx.any_of([_like(F.col("content"), w) for w in words]))
    return found.withColumn("score", score).orderBy(F.desc("score"), *POSITION).limit(min(limit, 100))


def prepared(chunks: DataFrame) -> DataFrame:
    """With `norm` and `words`, which all scores read, evaluated once a row; chunks stored
    with both come as they are."""
    if {"norm", "words"} <= set(chunks.columns):
        return chunks
    return tx.once(tx.once(chunks, norm=tx.norm(F.col("content"))), words=tx.tokens(F.col("norm")))


def topic_count(t: Topic) -> Column:
    return tx.total([tx.whole_count(F.col("words"), v) for v in t.variants]).cast("int")


def topic_boost(t: Topic) -> Column:
    if not t.enabled:
        return F.lit(0.0)
    n = topic_count(t)
    defined = tx.any_of([F.col("norm").contains(v + x) for v in t.variants for x in lx.TOPIC_DEFINITION_AFTER] + [F.col("norm").contains(x + v + " ") for v in t.variants for x in lx.TOPIC_DEFINITION_BEFORE])
    return F.when(n == 0, 0.0).otherwise(1.2 + F.least(n * 0.16, F.lit(0.8)) + F.when(defined, 0.45).otherwise(0.0))


def text_matches(chunks: DataFrame, query: str) -> DataFrame:
    """Chunks that hold a term of the query; if any holds the topic, only those."""
    t, words = topic(query), text_terms(query)

    def counted(parts: list[str]) -> DataFrame:
        """Chunks that may hold one of `parts`: others are not normalised."""
        some = chunks if "norm" in chunks.columns else chunks.filter(tx.may_hold(F.col("content"), parts))
        return tx.once(prepared(some), topic_count=topic_count(t) if t.enabled else F.lit(0))

    found = counted(words)
    if t.enabled:
        # One row, whatever the input: whether any chunk holds the topic. The first that does ends each task's search.
        some = counted(list(t.variants)).filter("topic_count > 0").limit(1).agg(F.count("*").alias("any"))
        found = found.crossJoin(F.broadcast(some)).filter((F.col("any") == 0) | (F.col("topic_count") > 0)).drop("any")
    found = found.filter(tx.contains_any(F.col("norm"), words))
    return found.withColumn("score", 1.0 + topic_boost(t))


def scoped_search(chunks: DataFrame, query: str, k: int, *, fallback: int = 3) -> DataFrame:
    """The first matches; without any, the first chunks of the scope at score 1."""
    order = [F.desc("topic_count"), F.desc("score"), *POSITION]
    hits = text_matches(chunks, query).orderBy(*order).limit(k).withColumn("tier", F.lit(0))
    rest = chunks.orderBy(*POSITION).limit(fallback).withColumns({"topic_count": F.lit(0), "score": F.lit(1.0), "tier": F.lit(1)})
    cols = [*POSITION, "content", "topic_count", "score", "tier"]
    return first_tier(hits.select(cols).unionByName(rest.select(cols))).orderBy(*order)


def first_tier(tagged: DataFrame) -> DataFrame:
    """The rows of the lowest `tier` that has any; the union of bounded tiers is small."""
    least = tagged.agg(F.min("tier").alias("least"))
    return tagged.crossJoin(F.broadcast(least)).filter("tier = least").drop("tier", "least")


def summary_chunks(chunks: DataFrame, k: int = 30) -> DataFrame:
    """The first k chunks, 30 at most, newest document first."""
    return chunks.orderBy(F.desc("created_at"), *POSITION).limit(min(k if k > 0 else 30, 30))


def keyword_score(i: Intent) -> Column:
    n, words = F.col("norm"), F.col("words")
    if not i.terms:
        return F.lit(0.0)

    def hits(k: int, t: str) -> Column:
        """How often a term is hit: words are compared where the text holds it, and for the first term where not."""
        near = tx.fuzzy_count(words, t) if k == 0 else F.lit(0)
        return F.when(n.contains(t), tx.whole_count(words, t)).otherwise(near)

    def scored(x: Column) -> Column:
        score, matches, total, main = F.when(n.contains(i.normalised), 0.85).otherwise(0.0), F.lit(0), F.lit(0), F.get(x, F.lit(0))
        for k, t in enumerate(i.terms):
            of, part = F.get(x, F.lit(k)), n.contains(t)
            score = score + F.when(part, F.when(of > 0, 0.0).otherwise(0.08)).when(of > 0, 0.22).otherwise(0.0)
            matches, total = matches + F.when(of > 0, 1).otherwise(0), total + of

        def summed(m: Column) -> Column:
            s = score + m / len(i.terms) * 0.5 + F.least(total * 0.04, F.lit(0.2)) + F.least(main * 0.06, F.lit(0.18))
            s = s + F.when(tx.definition_like(n, i.terms), 0.35).otherwise(0.0) + F.when(m >= 2, 0.12).otherwise(0.0)
            return F.when(m == 0, 0.0).otherwise(s)

        return tx.let(matches, summed)

    return tx.let(F.array(*[hits(k, t) for k, t in enumerate(i.terms)]), scored)


def relaxed_score(i: Intent) -> Column:
    n, words = F.col("norm"), F.col("words")
    if not i.terms:
        return F.lit(0.0)
    score, matches = F.when(n.contains(i.normalised), 0.55).otherwise(0.0), F.lit(0)
    for k, t in enumerate(i.terms):
        step = F.when(tx.whole_count(words, t) > 0, 0.34).when(n.contains(t), 0.18)
        if k == 0:
            step = step.when(tx.fuzzy_count(words, t) > 0, 0.26).when(tx.partial_match(words, t), 0.12)
        step = step.otherwise(0.0)
        score, matches = score + step, matches + F.when(step > 0, 1).otherwise(0)
    score = score + matches / len(i.terms) * 0.18 + F.when(tx.definition_like(n, i.terms), 0.12).otherwise(0.0)
    return F.when(matches == 0, 0.0).otherwise(score)


def entity_boost(i: Intent) -> Column:
    n, words = F.col("norm"), F.col("words")
    boost = F.when(n.contains(i.entity), 1.6).otherwise(0.0) if i.filters_entity else F.lit(0.0)
    if i.phrase:
        boost = boost + F.when(n.contains(i.phrase), 1.0).otherwise(0.0)
    return boost + tx.total([F.when(tx.whole_count(words, t) > 0, 0.18).when(tx.fuzzy_count(words, t) > 0, 0.06).otherwise(0.0) for t in i.main_terms])


def question_boost(i: Intent) -> Column:
    n, words = F.col("norm"), F.col("words")
    if not (factual(i.query) or tabular(i.query)):
        return F.lit(0.0)
    boost = F.when(n.contains(i.entity), 0.35).otherwise(0.0) if i.filters_entity else F.lit(0.0)
    boost = boost + F.when(F.exists(words, lambda w: w.rlike("^[0-9]{4}$")), 0.25).otherwise(0.0) + F.when(tx.contains_any(n, lx.FACT_VERBS), 0.18).otherwise(0.0)
    if tabular(i.query):
        boost = boost + tx.total([F.when(n.contains(t), 0.16).otherwise(0.0) for t in lx.TABULAR_CONTENT])
    return boost


def first_match(i: Intent) -> Column:
    """Where the query or its first term begins in the normalised text, from 0; -1 if nowhere."""
    n = F.col("norm")
    at = [F.nullif(F.locate(t, n), F.lit(0)) for t in i.terms]
    first = at[0] if len(at) == 1 else F.least(*at) if at else F.lit(None).cast("int")
    whole = F.nullif(F.locate(i.normalised, n), F.lit(0)) if i.normalised else F.lit(None).cast("int")
    return F.coalesce(whole, first, F.lit(0)) - 1


def length_penalty(i: Intent, score: Column) -> Column:
    size, at = F.length("content"), first_match(i)
    exact = F.col("norm").contains(i.normalised) if i.normalised else F.lit(False)
    return (
        F.when((size <= 700) | exact | (score >= 0.85), 1.0)
        .when(size > 1800, F.when((at > 1200) & (score < 0.9), 0.42).otherwise(0.62))
        .when(size > 1200, F.when((at > 800) & (score < 0.9), 0.55).otherwise(0.74))
        .otherwise(F.when((at > 600) & (score < 0.7), 0.72).otherwise(0.86))
    )


def section_penalty(query: str) -> Column:
    return F.when(tx.contains_any(F.col("norm"), lx.GENERIC_SECTIONS), 0.18 if conceptual(query) else 0.45).otherwise(1.0)


def focus_penalty(i: Intent, t: Topic) -> Column:
    """What a chunk loses for missing the topic, or else the entity or phrase."""
    n = F.col("norm")
    if t.enabled:
        return F.when(topic_count(t) > 0, 1.0).when(tx.contains_any(n, lx.GENERIC_PROGRAMMING), 0.18).otherwise(0.42)
    if i.filters_entity:
        return F.when(n.contains(i.entity), 1.0).otherwise(0.72)
    return F.when(n.contains(i.phrase), 1.0).otherwise(0.25) if i.phrase else F.lit(1.0)


def exact_intent(i: Intent) -> Column:
    n = F.col("norm")
    if i.filters_entity:
        return n.contains(i.entity)
    words = tx.any_of([tx.whole_count(F.col("words"), t) > 0 for t in i.main_terms])
    return (n.contains(i.phrase) | words) if i.phrase else words


def hybrid_scores(chunks: DataFrame, query: str, vector: list[float]) -> DataFrame:
    """Strict tier: vector and keyword scores by the query's weights, boosts and penalties, above the thresholds."""
    i, t, precise = intent(query), topic(query), precision(query)
    by_vector, by_text = weights(query)
    found = tx.once(prepared(chunks), text_score=keyword_score(i))
    found = found.filter(F.col("text_score") >= lx.MIN_TEXT)
    q = F.array(*[F.lit(float(x)) for x in vector])
    found = tx.once(found, vector_score=tx.cosine(F.col("embedding"), q))
    final = F.col("vector_score") * by_vector + F.col("text_score") * by_text + entity_boost(i) + question_boost(i) + topic_boost(t)
    final = final * length_penalty(i, F.col("text_score")) * section_penalty(query) * focus_penalty(i, t)
    return tx.once(found, score=final).filter(F.col("score") >= (lx.MIN_PRECISION if precise else lx.MIN_FINAL))


def final_order(query: str) -> list[Column]:
    i, t = intent(query), topic(query)
    order = [F.desc(topic_count(t))] if t.enabled else []
    exact = F.col("norm").contains(i.normalised) if i.normalised else F.lit(False)
    return [*order, F.desc(exact_intent(i)), F.desc(exact), F.desc(tx.definition_like(F.col("norm"), i.terms)), tx.contains_any(F.col("norm"), lx.GENERIC_SECTIONS).asc(), F.desc("score"), F.asc("chunk_index"), F.asc("document_id")]


def relaxed_scores(chunks: DataFrame, query: str) -> DataFrame:
    i, t = intent(query), topic(query)
    found = prepared(chunks)
    near = tx.any_of([(tx.whole_count(F.col("words"), x) > 0) | (tx.fuzzy_count(F.col("words"), x) > 0) | tx.partial_match(F.col("words"), x) for x in i.main_terms])
    if not i.filters_entity:
        found = found.filter((F.col("norm").contains(i.phrase) | near) if i.phrase else near)
    score = relaxed_score(i) + (F.when(F.col("norm").contains(i.entity), 0.45).otherwise(0.0) if i.filters_entity else F.lit(0.0))
    score = (score + entity_boost(i) + question_boost(i) + topic_boost(t)) * (focus_penalty(i, t) if t.enabled else F.lit(1.0))
    return tx.once(found, score=score).filter("score >= 0.08")


def overlap_score(i: Intent) -> Column:
    n, words = F.col("norm"), F.col("words")
    if not i.main_terms:
        return F.lit(0.0)
    steps = [F.when(n.contains(t) & (tx.whole_count(words, t) > 0), 1.0).when(tx.fuzzy_count(words, t) > 0, 0.7).when(tx.partial_match(words, t), 0.45).otherwise(0.0) for t in i.main_terms]

    def scored(x: Column) -> Column:
        each = [F.get(x, F.lit(k)) for k in range(len(steps))]
        hits = tx.total([F.when(s > 0, 1.0).otherwise(0.0) for s in each])
        score = tx.total(each) + hits / len(steps)
        if i.phrase:
            score = score + F.when(n.contains(i.phrase), 0.6).otherwise(0.0)
        if i.filters_entity:
            score = score + F.when(n.contains(i.entity), 0.8).otherwise(0.0)
        return F.when(hits == 0, 0.0).otherwise(score)

    # Each term's words are compared once, however often the sums read it.
    return tx.let(F.array(*steps), scored)


def fallback_scores(chunks: DataFrame, query: str) -> DataFrame:
    """Scores by text alone, for chunks without vectors: the thresholds hold before and after penalties."""
    i, t, precise = intent(query), topic(query), precision(query)
    least = lx.MIN_PRECISION if precise else lx.MIN_FINAL
    found = prepared(chunks)
    if precise:
        strong = tx.any_of([tx.whole_count(F.col("words"), x) > 0 for x in i.terms] + [tx.fuzzy_count(F.col("words"), x) > 0 for x in i.main_terms[:1]])
        found = found.filter((F.col("norm") != "") & (F.col("norm").contains(i.normalised) | strong))
    found = tx.once(found, text_score=keyword_score(i) + entity_boost(i) + question_boost(i) + topic_boost(t)).filter(F.col("text_score") >= least)
    score = F.col("text_score") * length_penalty(i, F.col("text_score")) * section_penalty(query) * focus_penalty(i, t)
    return tx.once(found, score=score).filter(F.col("score") >= least)


def hybrid_search(chunks: DataFrame, query: str, vector: list[float], k: int = 3, pool: int = 200) -> DataFrame:
    """Strict results; without any the two best relaxed ones; without any the best by term overlap."""
    by_score = [F.desc("score"), F.asc("chunk_index"), F.asc("document_id")]
    chunks = prepared(chunks)
    overlap = tx.once(chunks, score=overlap_score(intent(query))).filter("score > 0")
    tiers = [(hybrid_scores(chunks, query, vector), final_order(query), k), (relaxed_scores(chunks, query), by_score, 2), (overlap, by_score, k)]
    for found, order, most in tiers:
        kept = first_distinct(found, order, most, pool, [*POSITION, "content", "norm", "score"])
        if kept.limit(1).count():
            break
    return kept.select(*POSITION, "content", "score", F.col("rank").alias("place"))


def first_distinct(found: DataFrame, order: list[Column], k: int, pool: int, cols: list[str]) -> DataFrame:
    """The first `k` rows of `found` that are no near copies of ones before (needs norm);
    `cols` and rank from 1.

    Rounds fold the next `pool` rows that are no near copies of those kept, until `k` are
    kept or no rows remain; each round but the last keeps one at least."""
    kept, rest, schema = [], found, found.select(*cols).schema
    while len(kept) < k:
        best = rest.orderBy(*order).limit(pool).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
        new = drop_near_copies(best.select(*cols, "rank"), ["rank"]).withColumn("__terms", tx.terms(F.col("norm"))).orderBy("rank").limit(k - len(kept)).collect()
        if not new:
            break
        kept += new
        for r in new:
            # Texts without terms are no copies of themselves.
            own = reduce(and_, [F.col(c).eqNullSafe(F.lit(r[c])) for c in POSITION])
            of = F.array(*[F.lit(t) for t in r["__terms"]]).cast("array<string>")
            rest = rest.filter(~own & (tx.jaccard(tx.terms(F.col("norm")), of) < lx.DUPLICATE))
    rows = [(*[r[c] for c in cols], i) for i, r in enumerate(kept, 1)]
    return found.sparkSession.createDataFrame(rows, schema.add("rank", "integer"))


def drop_near_copies(chunks: DataFrame, order: list[str], by: list[str] | None = None, threshold: float = lx.DUPLICATE) -> DataFrame:
    """In order, without chunks whose terms overlap a kept one's by `threshold` or more (needs norm).

    A fold per group of `by`; callers bound its size."""
    row = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in chunks.columns if c not in order], F.col("__terms"), F.size("__terms").alias("__size"))
    grouped = tx.once(chunks, __terms=tx.terms(F.col("norm"))).groupBy(*(by or [])).agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def step(kept: Column, x: Column) -> Column:
        def alike(y: Column) -> Column:
            # No overlap exceeds the smaller set's share of the larger, so most pairs are told by their sizes.
            few, many = F.least(x["__size"], y["__size"]), F.greatest(x["__size"], y["__size"])
            most = F.when(few > 0, few / many).otherwise(0.0)
            return (most >= threshold) & (tx.jaccard(x["__terms"], y["__terms"]) >= threshold)

        copy = F.exists(kept, alike)
        return F.when(copy, kept).otherwise(F.concat(kept, F.array(x)))

    grouped = grouped.select(F.col("rows"), F.slice("rows", 1, 0).alias("none"))
    kept = F.aggregate("rows", F.col("none"), step)
    return grouped.select(F.explode(kept).alias("x")).select(*[F.col(f"x.{c}").alias(c) for c in chunks.columns])


def structure_score(content: Column, headings: Column, index: Column) -> Column:
    """From the content, whether each of its lines is a heading, and its place."""
    size = F.length(content)
    return (
        0.3
        + F.when(F.get(headings, F.lit(0)), 2.4).otherwise(0.0)
        + F.when(F.coalesce(F.get(headings, F.lit(1)), F.lit(False)), 1.1).otherwise(0.0)
        + F.when(content.contains(":"), 0.35).otherwise(0.0)
        + F.when(content.contains("Hoja:") | content.contains("Columnas:"), 1.25).otherwise(0.0)
        + F.when(content.contains("Total de filas de datos:"), 0.75).otherwise(0.0)
        + F.when(content.contains("\n- ") | content.contains("\n•"), 0.4).otherwise(0.0)
        + F.when(index < 8, 0.6).otherwise(0.0)
        + F.when(size < 80, 0.2).when(size <= 550, 0.8).when(size > 900, -0.4).otherwise(0.0)
        + F.size(F.filter(headings, lambda h: h)) * 0.25
    )


def structure_scores(chunks: DataFrame) -> DataFrame:
    """Chunks without noise lines, scored by how much they look like an outline."""
    lines = F.transform(F.split(tx.clean_text(F.col("content")), "\n"), lambda x: F.struct(F.trim(x).alias("line"), tx.norm(F.trim(x)).alias("norm")))
    found = tx.once(chunks, __lines=lines)
    kept = F.filter("__lines", lambda x: (x["norm"] != "") & ~tx.contains_any(x["norm"], lx.STRUCTURE_NOISE))
    found = tx.once(found, __lines=kept)
    # Of equal lines the first.
    first = tx.let(F.col("__lines.norm"), lambda norms: F.filter("__lines", lambda x, i: F.array_position(norms, x["norm"]) == i + 1))
    found = tx.once(found, __lines=first["line"])
    found = tx.once(found, content=F.array_join("__lines", "\n")).filter("content <> ''")
    found = tx.once(found, __headings=F.transform(F.split("content", "\n"), tx.heading))
    found = tx.once(found, score=structure_score(F.col("content"), F.col("__headings"), F.col("chunk_index")))
    return found.filter("score > 0").select(*chunks.columns, "score")


def structure_search(chunks: DataFrame, k: int = 6, pool: int = 200) -> DataFrame:
    found = tx.once(structure_scores(chunks), norm=tx.norm(F.col("content")))
    return first_distinct(found, [F.desc("score"), F.asc("chunk_index"), F.asc("document_id")], k, pool, found.columns).orderBy(*POSITION)


def with_snippets(found: DataFrame, query: str) -> DataFrame:
    i = intent(query)
    return prepared(found).withColumn("snippet", tx.snippet(F.col("content"), F.greatest(first_match(i), F.lit(0)))).drop("norm", "words")


def section_score(term: str) -> Column:
    """How much a chunk is about a section: the phrase, its words exactly, nearly or in part, and their share."""
    q = norm(term)
    n, words, parts = F.col("norm"), F.col("words"), terms(q)
    steps = [F.when(tx.whole_count(words, t) > 0, 0.8).when(tx.fuzzy_count(words, t) > 0, 0.5).when(tx.partial_match(words, t), 0.3).otherwise(0.0) for t in parts]
    hits = tx.total([F.when(s > 0, 1.0).otherwise(0.0) for s in steps])
    return F.when(hits == 0, 0.0).otherwise(tx.total(steps) + hits / max(1, len(parts)) + F.when(n.contains(q), 1.8).otherwise(0.0))


def section_scores(chunks: DataFrame, term: str) -> DataFrame:
    """Chunks about a section and their neighbours: three times the score, and 1.2, 0.8
    or 0.35 for a distance of 0, 1 or 2 to the next chunk about it in the document."""
    found = prepared(chunks).withColumn("direct", section_score(term))
    near = nearest_anchor(found, F.col("direct") > 0)
    by_distance = F.when(F.col("distance") == 0, 1.2).when(F.col("distance") == 1, 0.8).when(F.col("distance") == 2, 0.35).otherwise(0.0)
    return near.withColumn("score", F.col("direct") * 3.0 + by_distance).filter("score > 0")


def section_search(chunks: DataFrame, term: str, k: int = 4, pool: int = 200) -> DataFrame:
    found = section_scores(chunks, term)
    return first_distinct(found, [F.desc("score"), F.asc("chunk_index"), F.asc("document_id")], k, pool, [c for c in found.columns if c != "words"]).orderBy("rank")
