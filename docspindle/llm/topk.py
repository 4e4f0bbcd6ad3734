"""Exact top-k inner products by norm buckets with per-bucket pruning."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, small

#: Rows of one block of candidates and of one block of queries.
BLOCK, QUERIES = 8192, 4096
#: Buckets have lengths within this ratio.
RATIO = 1.1
#: From this local cosine threshold on, coordinates prune better than lengths.
COORDINATES_FROM = 0.55
#: How many of a query's largest coordinates are looked at.
FOCUS = 4


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products: through doubles where they hold every sum, else as integers."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if top < 2**53:
        return (q.astype("f8") @ c.astype("f8").T).astype("i8")
    return q @ c.T


def _search(q_ids, q, floor, c_ids, c, k):
    """The k best of this block for each query, nothing below `floor` (which may hold -inf)."""
    q_len, c_len = np.sqrt((q.astype("f8") ** 2).sum(1)), np.sqrt((c.astype("f8") ** 2).sum(1))
    order = np.lexsort((c_ids, -c_len))
    c, c_ids, c_len = c[order], c_ids[order], c_len[order]
    slack = 1e-9
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where((q_len > 0) & (c_len[:1] > 0), floor / (q_len * c_len[0]), np.where(floor > 0, np.inf, -np.inf))
    alive = np.flatnonzero(local <= 1 + slack)
    by_length = alive[local[alive] < COORDINATES_FROM]
    by_coordinate = alive[local[alive] >= COORDINATES_FROM]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(i: int, rows: np.ndarray, scores: np.ndarray) -> None:
        ok = (scores >= floor[i]) & (c_ids[rows] != q_ids[i])
        rows, scores = rows[ok], scores[ok]
        if len(rows) > k:
            cut = np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[scores >= cut], scores[scores >= cut]
        best = np.lexsort((c_ids[rows], -scores))[:k]
        found.append((np.full(len(best), q_ids[i]), c_ids[rows[best]], scores[best]))

    # Lengths: only a prefix of the block, sorted by length, can reach the floor.
    for at in range(0, len(by_length), 256):
        some = by_length[at : at + 256]
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where((floor[some] > 0) & (q_len[some] > 0), floor[some] / q_len[some] * (1 - slack), -1.0)
        reach = np.searchsorted(-c_len, -need, side="right")
        products = _products(q[some], c[: reach.max(initial=0)])
        for row, i, n in zip(products, some, reach):
            keep(i, np.arange(n), row[:n])
    # Coordinates: a vector within angle t of the query lies within t in each coordinate's angle too.
    if len(by_coordinate):
        unit = c / np.maximum(c_len, 1e-300)[:, None]
        for i in by_coordinate:
            t = math.acos(min(1.0, local[i] * (1 - slack)))
            ok = c_len * q_len[i] >= floor[i] * (1 - slack)
            u = q[i] / q_len[i]
            for f in np.argsort(-np.abs(u))[:FOCUS]:
                a = math.acos(max(-1.0, min(1.0, u[f])))
                ok &= (unit[:, f] >= math.cos(min(math.pi, a + t)) - slack) & (unit[:, f] <= math.cos(max(0.0, a - t)) + slack)
            rows = np.flatnonzero(ok)
            keep(i, rows, _products(q[i : i + 1], c[rows])[0])
    if not found:
        return np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, "i8")
    return tuple(np.concatenate(x) for x in zip(*found))


def top_products(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 256.0,
    query_every: int = 50,
    k: int = 5,
    block: int = BLOCK,
    query_block: int = QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest products of each query row.

    Components become floor(scale * x). Queries are the rows whose id is divisible
    by `query_every`; candidates all rows but the query's own id; ties go to the
    smaller id. An empty table gives an empty result; other columns are not read.
    Vectors that are null or hold null or non-finite components, and
    null ids, take no part; repeated ids count once, by their smallest vector;
    vectors are compared with those of their own dimension only.

    Rows fall into buckets of like length, buckets into blocks of bounded size by
    a hash of the id, so a bucket with any share of the rows spreads. A first pass
    over the longest vectors gives each query a floor; a second visits only the
    blocks whose longest vector can reach it. Nothing but counts per bucket comes
    to the driver.
    """
    ok = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ints = (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        .filter(F.col("id").isNotNull() & ok)
        .groupBy("id")
        .agg(F.min("v").alias("v"))
        .withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("long")))
    )
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    ints = ints.select("id", "v", F.size("v").alias("dim"), length.alias("len"))
    ints = ints.withColumn("bucket", F.when(F.col("len") > 0, F.floor(F.log("len") / math.log(RATIO))).otherwise(-1).cast("int"))
    ints = materialise(ints)
    sizes = [(r["dim"], r["bucket"], r["n"], r["longest"]) for r in ints.groupBy("dim", "bucket").agg(F.count("*").alias("n"), F.max("len").alias("longest")).collect()]
    spark = vectors.sparkSession
    # The longest buckets that hold k + 1 rows or more give the floors.
    plan, blocks = [], 0
    for dim in sorted({s[0] for s in sizes}):
        seen = 0
        for _, bucket, n, longest in sorted((s for s in sizes if s[0] == dim), key=lambda s: -s[3]):
            parts = -(-n // block)
            plan.append((dim, bucket, parts, blocks, longest, seen <= k))
            seen, blocks = seen + n, blocks + parts
    layout = spark.createDataFrame(plan, "dim int, bucket int, parts int, first int, longest double, seed boolean")
    located = ints.join(small(layout, len(plan)), ["dim", "bucket"]).withColumn("block", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int"))
    # Each query goes to every block it may have to visit, so queries come in blocks as well.
    n_queries = ints.filter(F.col("id") % query_every == 0).count()
    q_parts = max(1, -(-n_queries // query_block))
    queries = ints.filter(F.col("id") % query_every == 0).select("id", "v", "dim", "len", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(q_parts)).cast("int").alias("part"))
    spread = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("block")

    def visit(who: DataFrame, seeds: bool) -> DataFrame:
        """who: queries with their floor. The best of each visited block."""
        some = layout.filter(F.col("seed") == seeds)
        some = some.select("dim", "longest", spread)
        going = who.join(small(some, blocks), "dim").filter(F.col("len") * F.col("longest") * (1 + 1e-9) >= F.coalesce("floor", F.lit(float("-inf"))))
        going = going.select("block", "part", "id", "v", "floor")
        going = materialise(going)
        # Candidates are copied to the query parts that visit their block, and to no other.
        asked = materialise(going.groupBy("block").agg(F.collect_set("part").alias("asked")).withColumnRenamed("block", "c_block"))
        there = located.filter(F.col("seed") == seeds).join(small(asked), F.col("block") == F.col("c_block"))
        there = there.select("c_block", F.explode("asked").alias("c_part"), F.col("id").alias("c_id"), F.col("v").alias("c_v"))

        def pair(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(c):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
            floor = q["floor"].astype("f8").fillna(-np.inf).to_numpy()
            cols = _search(q["id"].to_numpy(), np.stack(q["v"]).astype("i8"), floor, c["c_id"].to_numpy(), np.stack(c["c_v"]).astype("i8"), k)
            return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols)))

        return going.groupBy("block", "part").cogroup(there.groupBy("c_block", "c_part")).applyInPandas(pair, "query_id long, vec_id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = visit(queries.withColumn("floor", F.lit(None).cast("long")), True)
    first = first.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank")
    first = materialise(first)
    floors = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).filter(F.col("n") >= k).select(F.col("query_id").alias("id"), "floor")
    second = visit(queries.join(floors, "id", "left"), False)
    return (
        first.unionByName(second)
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
