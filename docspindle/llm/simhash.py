"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, small

#: Distinct fingerprints of one bucket that are compared in one task; larger
#: buckets are compared block by block, so no pair is left out.
BLOCK = 2048
#: Tasks that put fingerprints into tables, at least.
TASKS = 64
#: Hashes of one text whose bits are counted at once.
SLICE = 65_536
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def simhash(text: str | None, width: int, seed: int = 42) -> int:
    """64-bit SimHash of the shingles of `width` words of `text`, repeats included.

    A-Z are lower-cased, words are runs other than ASCII white space; a text of
    fewer words is one shingle, a text without words has fingerprint zero.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    n = max(1, len(words) - width + 1)
    votes = np.zeros(64, "i8")
    for at in range(0, n, SLICE):
        to = min(n, at + SLICE)
        starts = [0, *ends[: to - 1]][at:] if at == 0 else ends[at - 1 : to - 1]
        stops = ends[min(width, len(words)) - 1 + at : min(width, len(words)) - 1 + to]
        h = np.array([xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip(starts, stops)], "<u8")
        votes += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, fp (the fingerprint as a signed long) of every row; a narrow pass."""
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((simhash(t.as_py(), width) for t in b.column(1)), "u8", b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view("i8"))], ["id", "fp"])

    return narrow.mapInArrow(run, "id long, fp long")


def covering_masks(radius: int, seed: int = 2016) -> list[int]:
    """2^(radius+1) - 1 masks of 64 bits such that any two words that differ in at
    most `radius` bits agree on all bits of some mask.

    Each bit gets a random nonzero vector of radius+1 binary digits; mask v holds
    the bits whose vector has an odd product with v. At most `radius` differing
    bits span no more than `radius` dimensions, so some v is orthogonal to all.
    """
    rng = random.Random(seed)
    vectors = [rng.randrange(1, 1 << (radius + 1)) for _ in range(64)]
    masks = [sum(1 << i for i, x in enumerate(vectors) if bin(x & v).count("1") % 2) for v in range(1, 1 << (radius + 1))]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (indexes) that join what is linked within `radius` among `fps`, at most one per member."""
    n = len(fps)
    label = np.arange(n)
    unseen = np.ones(n, bool)
    a, b = [], []
    for start in range(n):
        if not unseen[start]:
            continue
        unseen[start] = False
        front = [start]
        while front:
            at = front.pop()
            rest = np.flatnonzero(unseen)
            near = rest[np.bitwise_count(fps[rest] ^ fps[at]) <= radius]
            unseen[near] = False
            label[near] = start
            a += [at] * len(near)
            b += near.tolist()
            front += near.tolist()
    return np.array(a, int), np.array(b, int)


def links(fps: DataFrame, radius: int) -> DataFrame:
    """a, b: links between the distinct longs `fp` of `fps` (with columns fp, node)
    that connect exactly what pairs within `radius` bits connect.

    Each fingerprint meets others in the tables of `covering_masks`. Buckets of
    one are dropped by an aggregation, buckets of two are compared as they are,
    larger ones are dealt in blocks (each pair of blocks is one group of bounded
    size) and give a spanning forest, so links do not grow with the square.
    """
    masks = F.array(*[F.lit(m) for m in covering_masks(radius)])
    # A small file of fingerprints makes many rows: dealt first, so that all tasks take part.
    # Only bucket and fingerprint travel; buckets of two tables that share a hash merely compare more.
    dealt = fps.select("fp").repartition(max(TASKS, fps.count() // 200_000))
    tables = dealt.select("fp", F.posexplode(masks).alias("t", "mask")).select(F.xxhash64("t", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp")
    buckets = tables.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("x"), F.max("fp").alias("y")).filter("n > 1")
    buckets = materialise(buckets)
    pairs = buckets.filter("n = 2").filter(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= radius).select(F.col("x").alias("a"), F.col("y").alias("b"))
    large = materialise(buckets.filter("n > 2").select("key", (1 + F.floor((F.col("n") - 1) / BLOCK)).cast("int").alias("blocks")))
    members = tables.join(small(large), "key")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    members = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("fp", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = np.unique(pdf["fp"].to_numpy().view("u8"))
        a, b = _forest(fp, radius)
        return pd.DataFrame({"a": fp[a].view("i8"), "b": fp[b].view("i8")}, dtype="i8")

    found = members.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")
    found = pairs.unionByName(found).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # Links between fingerprints, then between their nodes.
    for c in "ab":
        found = found.join(fps.select(F.col("fp").alias(c), F.col("node").alias(f"node_{c}")), c)
    return found.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of `edges` (a, b) reaches.

    Alternates large-star and small-star steps: each links a node's neighbours to
    the smallest of them, so hubs are reduced by aggregation, and every component
    ends as a star around its smallest node. Rounds grow with the logarithm of the
    number of nodes. Links stay in tables; a round ends by writing them.
    """
    edges = materialise(edges.filter("a <> b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # Large star: larger neighbours go to the smallest known node.
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of these.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(least, "a")
        small_star = down.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b"))))).select("col.*")
        new = materialise(small_star.filter("a <> b").distinct().select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).select(F.col("b").alias("a"), F.col("a").alias("b")))
        if new.count() == edges.count() and not new.exceptAll(edges).limit(1).count():
            discard(edges)
            return new.select(F.col("b").alias("node"), F.col("a").alias("component"))
        discard(edges)
        edges = new


def with_fingerprints(docs: DataFrame, name: str, *, text_col: str = "text", width: int = 4) -> DataFrame:
    """`docs` and a column `name`, the fingerprint of each row as a signed long."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((simhash(t.as_py(), width) for t in b.column(at)), "u8", b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps.view("i8"))], [*b.schema.names, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(0).cast("long")).schema)


def fingerprint_groups(prints: DataFrame, radius: int = 4) -> DataFrame:
    """fp, group: the smallest fingerprint that each distinct `fp` of `prints` reaches by
    steps of at most `radius` bits."""
    fps = materialise(prints.select("fp").distinct().withColumn("node", F.col("fp")))
    named = components(links(fps, radius)).withColumnRenamed("component", "c")
    return fps.join(named, "node", "left").select("fp", F.coalesce("c", "fp").alias("group"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of `docs`.

    Documents whose fingerprints differ in at most `radius` bits are linked;
    component_id is the smallest id reachable. Null and blank texts have
    fingerprint zero and are linked like any other. Repeated ids keep all rows.
    Rows with a null id get a null component. Exact copies are one fingerprint
    before any comparison, so a group of any size costs one row there.
    """
    prints = materialise(fingerprints(docs, id_col=id_col, text_col=text_col, width=width))
    nodes = materialise(prints.filter("id is not null").groupBy("fp").agg(F.min("id").alias("node")))
    named = components(links(nodes, radius)).withColumnRenamed("component", "c")
    classes = nodes.join(named, "node", "left").select(F.col("fp").alias("class_fp"), F.coalesce("c", "node").alias("component_id"))
    # A wide hot group of copies: the classes side is one row, the other side can be split.
    out = prints.join(classes, F.col("fp") == F.col("class_fp"), "left")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select(F.col("id").alias(id_col), hexed.alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
