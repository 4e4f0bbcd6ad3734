"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_tokenizers
from .common import crc_mod, table
from .decontam import benchmark_leaks
from .jaccard import similar_sets
from .lang_id import identify_language
from .lm_score import cross_entropy_difference
from .mixing import mix_sources
from .pii import replace_pii
from .simhash import near_duplicates
from .suffix_dedup import remove_repeats
from .token_count import count_tokens
from .topk import top_products
from .toxicity import score_toxicity
from .whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "similarity")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = identify_language(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


#: Surrogates depend on the session's docspindle.pii.key. This one is for test tables, and no secret.
EXAMPLE_KEY = "docspindle-example-key"


def pii_key(spark: SparkSession) -> str:
    return spark.conf.get("docspindle.pii.key", EXAMPLE_KEY)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), key=pii_key(spark))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "evidence")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_token_counts, op2_topk, op3_mixing, op4_decontamination, op5_simhash, op6_lm_score, op7_language, op8_pii, op9_toxicity, op10_suffix_dedup, op11_jaccard_join, op12_whitening, op13_alignment, pipeline)}


#: Inner products over whole tables, as the query defines them.
OP2_SQL = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


#: The best window of each document and item by weighted shingle similarity, over
#: windows that hold five words of the item in turn (items have more than five).
OP4_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
b AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
ds AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s, len(w) AS size FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM d)),
bs AS (SELECT item_id, i, array_to_string(w[i:i + 4], ' ') AS s, len(w) AS n FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM b)),
h AS (SELECT DISTINCT doc_id, item_id, n, size, ds.i FROM ds JOIN bs USING (s)),
c AS (SELECT DISTINCT doc_id, item_id, n, unnest(range(greatest(1, least(i - n + 5, size - n + 1)), greatest(1, least(i, size - n + 1)) + 1)) AS st FROM h),
x AS (SELECT c.doc_id, item_id, st, n, s, count(*) AS k FROM c JOIN ds ON ds.doc_id = c.doc_id AND ds.i BETWEEN st AND st + n - 5 GROUP BY ALL),
y AS (SELECT item_id, n, s, count(*) AS k FROM bs GROUP BY ALL),
t AS (SELECT doc_id, item_id, st, n, sum(x.k) AS total, sum(least(x.k, coalesce(y.k, 0))) AS shared FROM x LEFT JOIN y USING (item_id, n, s) GROUP BY ALL),
r AS (SELECT doc_id, item_id, shared / (total + n - 4 - shared) AS sim FROM t)
SELECT doc_id, item_id, round(max(sim), 9) AS similarity FROM r WHERE sim >= 0.8 GROUP BY ALL
"""


#: Links between sets of 4-word shingles that meet in one of them, and what they reach.
OP11_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) m ON m.x = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": OP2_SQL, "op4_decontamination": OP4_SQL, "op11_jaccard_join": OP11_SQL}
