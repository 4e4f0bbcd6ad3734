"""Catalog queries: joins, counts, sets, windows and order over documents and their chunks.

Fixture rules: a document's collection is its source, its tenant its language; a
document with label quality 1 is a favourite, one with toxic 1 has the tag toxic.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import catalog as cat
from ..operators import select as sel
from ..sources.folders import work_folder
from ..sources.keyed import KeyedTable
from .base import CHUNKS, DOCS, chunks, docs, sql_norm, table


def collections(s, sf):
    return docs(s, sf).select("tenant_id", "collection_id").distinct().withColumn("name", F.concat(F.lit("Colección "), F.col("collection_id")))


def favorites(s, sf):
    return table(s, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("document_id"))


def toxic_tags(s, sf):
    return table(s, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("document_id"), F.lit("toxic").alias("tag"))


def display_names(s, sf):
    d = docs(s, sf).withColumn("o", F.when(F.col("document_id") % 3 == 0, "").otherwise(F.concat("collection_id", F.lit(".txt")))).withColumn("l", F.when(F.col("document_id") % 2 == 0, "").otherwise("logico"))
    return d.select("document_id", cat.display_name(F.col("o"), F.col("l"), F.lit(None).cast("string")).alias("name"))


def collection_documents(s, sf):
    return cat.collection_documents(docs(s, sf), collections(s, sf), "en", "src3").select("document_id", "name").orderBy("document_id")


def collection_counts(s, sf):
    more = collections(s, sf).limit(0).unionByName(s.createDataFrame([("en", "vacia", "Colección vacia")], "tenant_id string, collection_id string, name string"))
    return cat.collection_counts(collections(s, sf).unionByName(more), docs(s, sf)).select("tenant_id", "collection_id", "documents")


def tagged_documents(s, sf):
    return cat.documents_by_tag(docs(s, sf), toxic_tags(s, sf), "toxic").select("document_id", "tenant_id", "tag")


def favorite_documents(s, sf):
    return cat.intersect_ids(docs(s, sf), favorites(s, sf)).select("document_id", "tenant_id")


def scope_ids(s, sf):
    """Favourites of a tag of a tenant."""
    return cat.intersect_ids(docs(s, sf).filter("tenant_id = 'en'"), favorites(s, sf), toxic_tags(s, sf)).select("document_id")


def embedded_chunks(s, sf):
    v = table(s, sf, "embeddings").select(F.col("vec_id").alias("document_id"), "label")
    return chunks(s, sf).join(v, "document_id").select("document_id", "chunk_id", "label")


def upserted(s, sf):
    base = docs(s, sf).select("document_id", "collection_id")
    rows = favorites(s, sf).join(base.select("document_id"), "document_id").select("document_id", F.lit("movida").alias("collection_id"))
    return cat.upsert(base, rows, ["document_id"])


def inserted_missing(s, sf):
    base = docs(s, sf).join(favorites(s, sf), "document_id", "left_semi").select("document_id", "collection_id")
    rows = docs(s, sf).select("document_id", F.lit("nueva").alias("collection_id"))
    return cat.insert_missing(base, rows, ["document_id"])


def deleted_tags(s, sf):
    return cat.delete_keys(docs(s, sf).select("document_id"), toxic_tags(s, sf), ["document_id"])


def keyed_merges(s, sf):
    """All documents into a keyed table, favourites moved, toxic ones deleted, missing ones put back, and the first two batches again."""
    base = docs(s, sf).select("document_id", "collection_id")
    moved = favorites(s, sf).join(base.select("document_id"), "document_id").withColumn("collection_id", F.lit("movida"))
    t = KeyedTable(s, work_folder(s, "keyed"), "document_id long, collection_id string", ["document_id"], 16)
    t.merge(base, 0).merge(moved, 1).merge(toxic_tags(s, sf), 2, "delete").merge(base.withColumn("collection_id", F.lit("nueva")), 3, "keep")
    t.merge(base, 0).merge(moved, 1).clean()
    return t.read()


def catalog_totals(s, sf):
    c = chunks(s, sf)
    return c.agg(F.count("*").alias("chunks"), F.count_distinct("document_id").alias("documents"), F.sum(F.length("content")).alias("characters"), (F.expr("sum(length(content)) div count(*)")).alias("mean_length"))


def chunk_counts(s, sf):
    return chunks(s, sf).groupBy("document_id").agg(F.count("*").alias("chunks"), F.count_if(F.trim("content") == "").alias("blank"))


def first_chunks(s, sf):
    return cat.first_chunk(chunks(s, sf)).select("document_id", "chunk_index", F.md5("content").alias("content"))


def document_texts(s, sf):
    return cat.document_text(chunks(s, sf), 6000).select("document_id", F.length("text").alias("n"), F.md5("text").alias("text"))


def collection_languages(s, sf):
    return docs(s, sf).groupBy("collection_id").agg(F.array_join(F.array_sort(F.collect_set("tenant_id")), ",").alias("tenants"), F.count("*").alias("documents"))


def topic_flags(s, sf):
    from pyspark.sql.window import Window

    hit = docs(s, sf).select("document_id", "collection_id", F.col("text").contains("thble").alias("hit"))
    return hit.select("document_id", "hit", F.max("hit").over(Window.partitionBy("collection_id")).alias("found"))


def quota_selection(s, sf):
    return sel.quota(chunks(s, sf), 20, ["document_id", "chunk_index"]).select("document_id", "chunk_index")


def _scored(s, sf):
    return chunks(s, sf).withColumn("score", (F.length("content") % 97).cast("double"))


def coverage_selection(s, sf):
    return sel.coverage(_scored(s, sf), 2, 20).select("document_id", "chunk_index", "score")


def document_limit(s, sf):
    return sel.limit_documents(_scored(s, sf), [F.desc("score"), F.asc("document_id"), F.asc("chunk_index")]).select("document_id", "chunk_index", "score")


def priority_union(s, sf):
    """What holds one word before what holds another."""
    a = chunks(s, sf).filter(F.col("content").contains("thing")).select("document_id", "chunk_index", F.lit(1.0).alias("score"))
    b = chunks(s, sf).filter(F.col("content").contains("the")).select("document_id", "chunk_index", F.lit(0.5).alias("score"))
    return sel.union_by_priority(a, b, ["document_id", "chunk_index"]).select("document_id", "chunk_index", "score", "priority")


def first_of_scope(s, sf):
    return chunks(s, sf).filter("tenant_id = 'fr'").orderBy("document_id", "chunk_index", "chunk_id").limit(30).select("chunk_id")


def newest_documents(s, sf):
    e = table(s, sf, "events").select("user_id", "event_id", "ts", "event_type")
    return cat.newest(e, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


def without_repeated_lines(s, sf):
    c = sel.without_repeats(chunks(s, sf), "document_id", "chunk_index", tx.norm(F.col("content")))
    return c.groupBy("document_id").agg(F.count("*").alias("kept"))


def last_share(s, sf):
    return sel.window_of_share(chunks(s, sf)).select("document_id", "chunk_index")


def document_thirds(s, sf):
    return sel.thirds(chunks(s, sf)).select("document_id", "chunk_index", "part")


def anchor_distance(s, sf):
    return sel.nearest_anchor(chunks(s, sf), F.col("content").contains("thing")).select("chunk_id", F.coalesce(F.col("distance").cast("int"), F.lit(-1)).alias("distance"))


def renumbered(s, sf):
    c = chunks(s, sf).filter(F.trim("content") != "")
    return sel.numbered(c.drop("chunk_index").withColumn("pos", F.substring_index("chunk_id", "-", -1).cast("int")), ["pos"]).select("chunk_id", "chunk_index")


def name_order(s, sf):
    c = collections(s, sf).select("name", "tenant_id")
    return c.orderBy("name", "tenant_id").limit(15)


_COLL = f"SELECT DISTINCT tenant_id, collection_id, 'Colección ' || collection_id AS name FROM ({DOCS})"
_FAV = "SELECT doc_id FROM labels WHERE quality = 1"
_TOX = "SELECT doc_id FROM labels WHERE toxic = 1"
_SC = f"SELECT *, CAST(len(content) % 97 AS DOUBLE) AS score FROM ({CHUNKS})"
_N = sql_norm("content")
QUERIES = {
    "display_names": (display_names, f"SELECT document_id, CASE WHEN document_id % 3 <> 0 THEN collection_id || '.txt' WHEN document_id % 2 <> 0 THEN 'logico' ELSE 'Documento cargado' END AS name FROM ({DOCS})"),
    "collection_documents": (collection_documents, f"SELECT document_id, 'Colección src3' AS name FROM ({DOCS}) WHERE tenant_id = 'en' AND collection_id = 'src3'"),
    "collection_counts": (collection_counts, f"SELECT tenant_id, collection_id, count(*) AS documents FROM ({DOCS}) GROUP BY ALL UNION ALL SELECT 'en', 'vacia', 0"),
    "tagged_documents": (tagged_documents, f"SELECT document_id, tenant_id, 'toxic' AS tag FROM ({DOCS}) WHERE document_id IN ({_TOX})"),
    "favorite_documents": (favorite_documents, f"SELECT document_id, tenant_id FROM ({DOCS}) WHERE document_id IN ({_FAV})"),
    "scope_ids": (scope_ids, f"SELECT document_id FROM ({DOCS}) WHERE tenant_id = 'en' AND document_id IN ({_FAV}) AND document_id IN ({_TOX})"),
    "embedded_chunks": (embedded_chunks, f"SELECT document_id, chunk_id, label FROM ({CHUNKS}) JOIN embeddings ON vec_id = document_id"),
    "upserted_rows": (upserted, f"SELECT document_id, CASE WHEN document_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'movida' ELSE collection_id END AS collection_id FROM ({DOCS})"),
    "inserted_missing": (inserted_missing, f"SELECT document_id, CASE WHEN document_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN collection_id ELSE 'nueva' END AS collection_id FROM ({DOCS})"),
    "deleted_keys": (deleted_tags, f"SELECT document_id FROM ({DOCS}) WHERE document_id NOT IN ({_TOX})"),
    "keyed_merges": (keyed_merges, f"SELECT document_id, CASE WHEN document_id IN ({_TOX}) THEN 'nueva' WHEN document_id IN ({_FAV}) THEN 'movida' ELSE collection_id END AS collection_id FROM ({DOCS})"),
    "catalog_totals": (catalog_totals, f"SELECT count(*) AS chunks, count(DISTINCT document_id) AS documents, CAST(sum(len(content)) AS BIGINT) AS characters, CAST(sum(len(content)) // count(*) AS BIGINT) AS mean_length FROM ({CHUNKS})"),
    "chunk_counts": (chunk_counts, f"SELECT document_id, count(*) AS chunks, count(*) FILTER (trim(content) = '') AS blank FROM ({CHUNKS}) GROUP BY ALL"),
    "first_chunks": (first_chunks, f"SELECT document_id, min(chunk_index) AS chunk_index, md5(arg_min(content, chunk_index)) AS content FROM ({CHUNKS}) WHERE trim(content) <> '' GROUP BY document_id"),
    "document_texts": (document_texts, f"SELECT document_id, len(t) AS n, md5(t) AS text FROM (SELECT document_id, left(string_agg(trim(content), chr(10) ORDER BY chunk_index), 6000) AS t FROM ({CHUNKS}) WHERE trim(content) <> '' GROUP BY document_id)"),
    "collection_languages": (collection_languages, f"SELECT collection_id, string_agg(DISTINCT tenant_id, ',' ORDER BY tenant_id) AS tenants, count(*) AS documents FROM ({DOCS}) GROUP BY collection_id"),
    "topic_flags": (topic_flags, f"SELECT document_id, hit, bool_or(hit) OVER (PARTITION BY collection_id) AS found FROM (SELECT *, contains(text, 'thble') AS hit FROM ({DOCS}))"),
    "quota_selection": (quota_selection, f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS own FROM ({CHUNKS})),
      d AS (SELECT greatest(1, 20 // count(DISTINCT document_id)) AS each FROM c)
      SELECT document_id, chunk_index FROM c, d ORDER BY own > each, document_id, chunk_index LIMIT 20"""),
    "coverage_selection": (coverage_selection, f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, chunk_index, chunk_id) AS own FROM ({_SC}))
      SELECT document_id, chunk_index, score FROM c ORDER BY own > 2, CASE WHEN own <= 2 THEN document_id END, CASE WHEN own <= 2 THEN own END, score DESC, chunk_index, chunk_id, document_id LIMIT 20"""),
    "document_limit": (document_limit, f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, chunk_index) AS own FROM ({_SC})),
      d AS (SELECT document_id, row_number() OVER (ORDER BY score DESC, document_id, chunk_index) AS place FROM c WHERE own = 1 ORDER BY place LIMIT 5)
      SELECT document_id, chunk_index, score FROM c JOIN d USING (document_id) WHERE own <= 20 ORDER BY own > 1, place, own LIMIT 20"""),
    "priority_union": (priority_union, f"SELECT document_id, chunk_index, CASE WHEN contains(content, 'thing') THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS score, CASE WHEN contains(content, 'thing') THEN 0 ELSE 1 END AS priority FROM ({CHUNKS}) WHERE contains(content, 'thing') OR contains(content, 'the')"),
    "first_of_scope": (first_of_scope, f"SELECT chunk_id FROM ({CHUNKS}) WHERE tenant_id = 'fr' ORDER BY document_id, chunk_index LIMIT 30"),
    "newest_rows": (newest_documents, "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "repeated_lines": (without_repeated_lines, f"SELECT document_id, count(*) AS kept FROM (SELECT document_id, n, lag(n) OVER (PARTITION BY document_id ORDER BY chunk_index) AS b FROM (SELECT *, {_N} AS n FROM ({CHUNKS}))) WHERE b IS NULL OR b <> n GROUP BY document_id"),
    "last_share": (last_share, f"SELECT document_id, chunk_index FROM (SELECT *, row_number() OVER w AS a, count(*) OVER (PARTITION BY document_id) AS n FROM ({CHUNKS}) WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index)) WHERE a > n - greatest(1, CAST(floor(n * 0.2) AS BIGINT))"),
    "document_thirds": (document_thirds, f"SELECT document_id, chunk_index, CAST(least(2, (a - 1) // greatest(1, CAST(ceil(n / 3) AS BIGINT))) AS INTEGER) AS part FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS a, count(*) OVER (PARTITION BY document_id) AS n FROM ({CHUNKS}))"),
    "anchor_distance": (anchor_distance, f"""SELECT chunk_id, CAST(coalesce(least(chunk_index - max(a) OVER (PARTITION BY document_id ORDER BY chunk_index), min(a) OVER (PARTITION BY document_id ORDER BY chunk_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - chunk_index), -1) AS INTEGER) AS distance
      FROM (SELECT *, CASE WHEN contains(content, 'thing') THEN chunk_index END AS a FROM ({CHUNKS}))"""),
    "renumbered_chunks": (renumbered, f"SELECT chunk_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) - 1 AS INTEGER) AS chunk_index FROM ({CHUNKS}) WHERE trim(content) <> ''"),
    "collections_by_name": (name_order, f"SELECT name, tenant_id FROM ({_COLL}) ORDER BY name, tenant_id LIMIT 15"),
}
