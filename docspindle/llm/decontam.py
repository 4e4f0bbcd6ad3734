"""Benchmark decontamination by SimHash of item-sized windows, on DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, materialise, small

#: Fingerprints are cut into so many blocks. An index entry for each block value
#: and each of its one-bit neighbours finds all fingerprints within 2 * BLOCKS - 1
#: bits: were every block off by two bits or more, they would differ in 2 * BLOCKS.
BLOCKS = 8
RADIUS = 2 * BLOCKS - 1


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: str, width: str) -> Column:
    """Hashes of the runs of `width` words; fewer words: none."""
    return F.expr(f"if(size({words}) < {width}, cast(array() as array<bigint>), transform(sequence(0, size({words}) - {width}), i -> xxhash64(slice({words}, i + 1, {width}))))")


def _texts(words: str, width: str) -> Column:
    """Shingles as text; fewer words than `width` are one."""
    return F.expr(f"transform(sequence(0, greatest(size({words}) - {width}, 0)), i -> concat_ws(' ', slice({words}, i + 1, {width})))")


def _numbered(texts: str) -> Column:
    """Repeats with their number among their equals: sets of these count repeats."""
    return F.expr(f"if(size(array_distinct({texts})) = size({texts}), {texts}, transform({texts}, (s, i) -> concat(s, if(array_contains(slice({texts}, 1, i), s), concat(' ', cast(size(filter(slice({texts}, 1, i), x -> x = s)) as string)), ''))))")


def _simhash(hashes: str) -> Column:
    """A bit is 1 if set in over half the hashes. Each of 16 sums counts four bits in lanes
    of 16 bits; more hashes than these hold are counted bit by bit."""
    lanes = f"transform(sequence(0, 15), s -> aggregate({hashes}, 0L, (a, h) -> a + (shiftright(h, s) & 281479271743489L)))"
    bits = f"aggregate(sequence(0, 63), 0L, (a, b) -> if(2 * (shiftright(get(ls, b % 16), 16 * (b div 16)) & 65535L) > n, a | shiftleft(1L, b), a))"
    fast = f"get(transform(array(struct({lanes} as ls, size({hashes}) as n)), x -> {bits.replace('ls', 'x.ls').replace('> n', '> x.n')}), 0)"
    slow = f"aggregate(transform(sequence(0, 63), b -> if(2 * aggregate({hashes}, 0, (a, h) -> a + cast(shiftright(h, b) & 1L as int)) > size({hashes}), shiftleft(1L, b), 0L)), 0L, (a, x) -> a | x)"
    return F.expr(f"if(size({hashes}) < 32768, {fast}, {slow})")


def benchmark_leaks(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 5,
    similarity: float = 0.8,
) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words, distance of the leaks: for each
    document and item whose best window reaches `similarity`, that window.

    Words are lower-cased runs of letters and digits. Windows have the item's
    length. Similarity is the weighted Jaccard index of word shingles, weights
    being how often each occurs; an item of fewer than `width` words is one
    shingle. Items without words, null ids and null texts take no part; repeated
    rows count once; an item never leaks into nothing. Empty tables give an empty
    result; other columns are not read.

    A window of that similarity shares one of any (1 - similarity) of an item's
    shingles plus one, wherever it stands in it. So every window that holds one of
    an item's rarest ones is fingerprinted, at all its places, and no other can be
    similar enough. Fingerprints meet items' by block values; all within 15 bits of
    64 do. Survivors are compared exactly. The rarest shingles are broadcast if
    they are few, which is counted; else shingles are joined in a shuffle.
    """
    own = items.select(F.col(item_col).cast("long").alias("item_id"), words_of(F.col(item_text_col)).alias("item")).filter("item_id is not null and size(item) > 0").distinct()
    own = own.withColumn("k", F.least(F.size("item"), F.lit(width))).withColumn("n", F.size("item"))
    own = materialise(own)
    n_items = own.count()
    posted = own.select("item_id", "n", "k", F.posexplode(_shingles("item", "k")).alias("at", "h"))
    often = F.size(F.collect_set("item_id").over(Window.partitionBy("h")))
    rarest = F.row_number().over(Window.partitionBy("item_id", "n").orderBy("often", "h", "at"))
    total = F.count("*").over(Window.partitionBy("item_id", "n"))
    anchors = posted.withColumn("often", often).withColumn("rank", rarest).withColumn("total", total)
    anchors = anchors.filter(F.col("rank") <= F.floor((1 - similarity) * F.col("total") + 1e-9) + 1).select("k", "h", "n").distinct()
    anchors = materialise(anchors)
    n_anchors = anchors.count()
    widths = sorted(r["k"] for r in anchors.select("k").distinct().collect())  # 1 to `width`

    texts = docs.select(F.col(id_col).cast("long").alias("id"), words_of(F.col(text_col)).alias("words")).filter("id is not null and size(words) > 0")
    # All places of windows that hold the shingle; a text shorter than the item is one window.
    lowest = F.greatest(F.lit(0), F.least(F.col("pos") + F.col("k") - F.col("n"), F.col("size") - F.col("n")))
    highest = F.greatest(F.lit(0), F.least(F.col("pos"), F.col("size") - F.col("n")))
    hits = docs.sparkSession.range(0).selectExpr("id", "0 as size", "0 as pos", "0 as n", "0 as k")
    for k in widths:
        a = anchors.filter(F.col("k") == k).drop("k")
        spread = texts.select("id", F.size("words").alias("size"), F.posexplode(_shingles("words", str(k))).alias("pos", "h"))
        met = spread.join(F.broadcast(a) if n_anchors <= BROADCAST_ROWS else a, "h")
        hits = hits.unionByName(met.select("id", "size", "pos", "n", F.lit(k).alias("k")))
    runs = hits.select("id", "n", "k", F.explode(F.sequence(lowest, highest)).alias("start"))
    starts = materialise(runs.groupBy("id", "n", "k").agg(F.collect_set("start").alias("starts")))
    # Only the texts that were met are split into words again.
    met = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(small(starts), "id")
    met = materialise(met.withColumn("doc", F.xxhash64("text")).dropDuplicates(["id", "doc", "n"]).withColumn("words", words_of(F.col("text"))).drop("text"))
    found = met.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))

    js = F.sequence(F.lit(0), F.lit(BLOCKS - 1))
    block = "cast(shiftright(fp, 8 * j) & 255 as int)"
    windows = found.select("id", "doc", "n", F.explode("starts").alias("start"), "hashes").withColumn("hs", F.slice("hashes", F.col("start") + 1, F.col("n")))
    windows = materialise(windows.withColumn("fp", _simhash("hs")).select("id", "doc", "n", "start", "fp"))
    w = windows.withColumn("j", F.explode(js)).withColumn("v", F.expr(block))
    index = own.withColumn("hs", F.transform("item", lambda w: F.xxhash64(w))).withColumn("fp", _simhash("hs")).select("item_id", "n", "fp")
    flips = F.expr(f"explode(concat(array({block}), transform(sequence(0, 7), b -> {block} ^ shiftleft(1, b))))")
    index = index.withColumn("j", F.explode(js)).select("item_id", "n", F.col("fp").alias("item_fp"), "j", flips.alias("v"))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    near = w.join(small(index, n_items * BLOCKS * 9), ["n", "j", "v"]).withColumn("distance", distance).filter(F.col("distance") <= RADIUS)
    near = near.select("id", "doc", "n", "start", "item_id", "item_fp", "distance").distinct()
    # Items whose ids repeat have several texts: the fingerprint tells which one was met.
    texts_of = own.withColumn("hs", F.transform("item", lambda w: F.xxhash64(w))).select("item_id", "n", "item", _simhash("hs").alias("item_fp"))
    both = near.join(found.select("id", "doc", "n", "k", "words"), ["id", "doc", "n"]).join(small(texts_of, n_items), ["item_id", "n", "item_fp"])
    both = both.select("id", "item_id", "start", "distance", "item", "k", F.slice("words", F.col("start") + 1, F.col("n")).alias("window"))
    # Written, so that Spark doesn't repeat these arrays' expressions in each place that reads them.
    both = materialise(both.withColumn("size", F.size("window")).withColumn("x", _texts("window", "k")).withColumn("y", _texts("item", "k")).drop("window", "item"))
    both = materialise(both.withColumn("x", _numbered("x")).withColumn("y", _numbered("y")))
    sim = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    both = both.withColumn("similarity", sim).filter(F.col("similarity") >= similarity - 1e-12)
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "distance", "start", F.col("size").alias("n"))).alias("b")
    out = both.groupBy("id", "item_id").agg(best)
    return out.select(F.col("id").alias(id_col), "item_id", F.round(-F.col("b.s"), 9).alias("similarity"), F.col("b.start").alias("start_word"), F.col("b.n").alias("n_words"), F.col("b.distance").alias("distance"))
