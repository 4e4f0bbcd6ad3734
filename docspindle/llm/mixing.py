"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialise, ordered_words, small

#: Newton steps, at most. Steps are kept inside a bracket, so a source that does
#: not converge quadratically still halves its bracket.
STEPS = 40
#: A source's expected words may be off by this share of its target.
TOLERANCE = 1e-9
#: Documents of one size and source are ranked in parts of about this many.
PART = 20_000


def source_targets(hist: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target for each source of `hist` (source, size, n).

    Sources by code point, null last, take the weights in turn. Targets share
    `share` times all words, stop at `most` times the source's words, and the
    excess goes to the others by weight: in order of cap over weight, the sources
    that stop are a prefix, found by running sums. One row per source is ordered.
    """
    src = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    src = src.withColumn("weight", weight)
    all_rows = Window.partitionBy()
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    src = src.withColumn("capped_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    src = src.withColumn("weight_left", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    total = F.sum("source_size").over(all_rows)
    # What one unit of weight gets if all sources before this one stop at their cap.
    src = src.withColumn("unit", (share * total - most * F.col("capped_before")) / F.col("weight_left"))
    src = src.withColumn("stops", most * F.col("source_size") <= F.col("unit") * F.col("weight"))
    # The first that doesn't stop, in the order of the sums: ratios may tie.
    src = src.withColumn("order", F.row_number().over(Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())))
    src = src.withColumn("level", F.min_by("unit", F.when(~F.col("stops"), F.col("order"))).over(all_rows))
    target = F.when(F.col("stops"), most * F.col("source_size")).otherwise(F.col("level") * F.col("weight"))
    return src.select("source", "source_size", target.alias("target"))


def _rate(lam: Column, z: Column, most: float) -> Column:
    """The tilted rate exp(lam * z), at most `most`."""
    return F.least(F.lit(most), F.exp(F.least(lam * z, F.lit(60.0))))


def balance(hist: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """source, lam, scale: the dual variables.

    Minimising the relative entropy of document rates to 1, rates being `most` at
    most, under one constraint per source, sum(size * rate) = target, gives rates
    min(most, exp(lam * size)); the convex dual separates by source. Each step
    evaluates its gradient and curvature (of the rates below the bound) by one
    distributed aggregation of the histogram.
    """
    scales = hist.groupBy("source").agg((F.sum(F.col("size") * F.col("size") * F.col("n")) / F.nullif(F.sum(F.col("size") * F.col("n")), F.lit(0))).alias("scale"))
    n = targets.count()
    # Null is a source like any other, so joins are null-safe.
    state = (
        targets.filter((F.col("source_size") > 0) & (F.col("target") < most * F.col("source_size") * (1 - 1e-12)) & (F.col("target") > 0))
        .withColumnRenamed("source", "s")
        .join(small(scales, n), F.col("s").eqNullSafe(F.col("source")))
        .select("s", "target", "scale", F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(False).alias("done"))
    )
    state = materialise(state)
    for _ in range(STEPS):
        h = hist.join(small(state, n), F.col("source").eqNullSafe(F.col("s"))).filter(~F.col("done"))
        z = F.col("size") / F.col("scale")
        rate = _rate(F.col("lam"), z, most)
        words = F.col("size") * F.col("n")
        step = h.groupBy("s").agg(
            F.sum(words * rate).alias("got"),
            F.sum(F.when(rate < most, words * rate * z).otherwise(0.0)).alias("slope"),
        )
        new = state.join(small(step.withColumnRenamed("s", "s2"), n), F.col("s").eqNullSafe(F.col("s2")), "left")
        over = F.col("got") > F.col("target")
        lo = F.when(over, F.col("lo")).otherwise(F.greatest("lo", "lam"))
        hi = F.when(over, F.least("hi", "lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - (F.col("got") - F.col("target")) / F.nullif(F.col("slope"), F.lit(0.0))
        # Outside the bracket, or too far: halve the bracket, or double away from it.
        far = F.when(F.col("nlo").isNotNull() & F.col("nhi").isNotNull(), (F.col("nlo") + F.col("nhi")) / 2).otherwise(
            F.when(F.col("nhi").isNull(), F.col("nlo") + F.greatest(F.abs("nlo"), F.lit(1.0))).otherwise(F.col("nhi") - F.greatest(F.abs("nhi"), F.lit(1.0)))
        )
        inside = F.col("newton").isNotNull() & (F.col("nlo").isNull() | (F.col("newton") > F.col("nlo"))) & (F.col("nhi").isNull() | (F.col("newton") < F.col("nhi"))) & (F.abs(F.col("newton") - F.col("lam")) <= 4 * (1 + F.abs("lam")))
        close = F.col("done") | (F.abs(F.col("got") - F.col("target")) <= TOLERANCE * F.col("target"))
        new = new.withColumns({"nlo": lo, "nhi": hi, "newton": newton}).withColumn("close", close)
        before, state = state, materialise(
            new.select("s", "target", "scale", F.when(F.col("close"), F.col("lam")).when(inside, F.col("newton")).otherwise(far).alias("lam"), F.col("nlo").alias("lo"), F.col("nhi").alias("hi"), F.col("close").alias("done"))
        )
        discard(before)
        if not state.filter(~F.col("done")).limit(1).count():
            break
    # Sums of doubles may differ in their last bits between runs; the rounded value does not.
    return state.select(F.col("s").alias("source"), F.round("lam", 7).alias("lam"), "scale")


def _round_sizes(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies of each size of a source, from long to short; each size takes up
    what those before it were off by."""
    pdf = pdf.sort_values("size", ascending=False)
    off, copies = 0.0, []
    for size, n, rate, most in pdf[["size", "n", "rate", "most"]].itertuples(index=False):
        want = n * rate * size + off
        c = int(min(max(round(want / size), 0), most * n))
        copies.append(c)
        off = want - c * size
    return pdf.assign(copies=copies)[["source", "size", "n", "copies"]]


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of `docs`.

    Each document is taken 0 to `most` whole times; taken = copies * size.

    The words of each source come within about its shortest document of the
    target. Documents without words take 0. Null sources form a source, the last.
    Repeated rows count as documents of their own; which of the documents of one
    size get a further copy depends on a hash of the id alone, so reruns agree.

    Texts never shuffle: words are counted first. Newton's steps run on the
    distinct (source, size) pairs. Ranks are taken within (source, size, part),
    parts being dealt by hash so that a hot source or size spreads.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.size(ordered_words(F.col(text_col))).cast("long").alias("size"))
    sized = materialise(sized)
    hist = materialise(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    targets = materialise(source_targets(hist, tuple(weights), share, most))
    n_sources = targets.count()
    duals = balance(hist, targets, float(most)).withColumnRenamed("source", "s")
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    known = small(t, n_sources)
    cells = (
        hist.filter("size > 0")
        .join(known, F.col("source").eqNullSafe(F.col("t_source")))
        .join(small(duals, n_sources), F.col("source").eqNullSafe(F.col("s")), "left")
        .select(
            "source", "size", "n", F.lit(int(most)).alias("most"),
            F.when(F.col("lam").isNotNull(), _rate(F.col("lam"), F.col("size") / F.col("scale"), float(most)))
            .otherwise(F.when(F.col("target") > 0, F.lit(float(most))).otherwise(F.lit(0.0))).alias("rate"),
        )
    )
    kind = "source string, size long, n long, copies long"
    copies = cells.groupBy("source").applyInPandas(_round_sizes, kind)
    # (source, size, part): how many documents it has, and how many precede it in its cell.
    parts = max(64, sized.count() // PART)
    placed = sized.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    sub = placed.filter("size > 0").groupBy("source", "size", "part").agg(F.count("*").alias("m"))
    up_to = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sub = sub.withColumn("before", F.coalesce(F.sum("m").over(up_to), F.lit(0)))
    c = copies.select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), "n", "copies")
    sub = sub.join(c, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")))
    # Whole rounds for all, then one more for `extra` documents, dealt evenly over the parts.
    extra = F.col("copies") % F.col("n")
    dealt = F.floor(extra * (F.col("before") + F.col("m")) / F.col("n")) - F.floor(extra * F.col("before") / F.col("n"))
    sub = sub.select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), F.col("part").alias("p_part"), F.expr("copies div n").alias("each"), dealt.alias("more"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy(F.xxhash64("id", F.lit(7)), "id"))
    ranked = placed.withColumn("rank", rank)
    out = ranked.join(sub, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")) & (F.col("part") == F.col("p_part")), "left")
    taken = F.coalesce(F.col("size") * (F.col("each") + F.when(F.col("rank") <= F.col("more"), 1).otherwise(0)), F.lit(0))
    return out.join(known, F.col("source").eqNullSafe(F.col("t_source")), "left").select(F.col("id").alias(id_col), "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), taken.cast("long").alias("taken"))
