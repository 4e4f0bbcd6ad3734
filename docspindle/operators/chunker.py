"""Cutting text into chunks, grouping chunks into sections, and points into topics."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as lx
from ..functions import text as tx

_SENTENCE = re.compile(r"(?<=[.!?;])\s*")


def _pack(parts: list[str], size: int, glue: str) -> Iterator[str]:
    held = ""
    for p in parts:
        if held and len(held) + len(glue) + len(p) > size:
            yield held
            held = p
        else:
            held = held + glue + p if held else p
    if held:
        yield held


def _split(text: str, size: int) -> list[str]:
    """Pieces of at most `size` characters: by lines, sentences, words, and at last by characters."""
    if len(text) <= size:
        return [text] if text else []
    for cut, glue in (("\n", "\n"), (None, " "), (" ", " ")):
        parts = [p.strip() for p in (_SENTENCE.split(text) if cut is None else text.split(cut)) if p.strip()]
        if len(parts) > 1:
            return list(_pack([y for x in parts for y in _split(x, size)], size, glue))
    return [text[i : i + size] for i in range(0, len(text), size)]


def pack_blocks(blocks: list[tuple[str, bool]], size: int = lx.CHUNK_SIZE) -> list[str]:
    """(block, heading) packed up to `size` characters; larger blocks are split, headings stand alone."""
    out: list[str] = []
    for alone, run in groupby(blocks, lambda b: b[1]):
        texts = [b for b, _ in run]
        out += texts if alone else _pack([p for b in texts for p in _split(b, size)], size, "\n\n")
    return out


def chunk_text(text: str | None, size: int = lx.CHUNK_SIZE) -> list[str]:
    """Blocks between blank lines, none of them a heading, as `pack_blocks` packs them."""
    return pack_blocks([(b.strip(), False) for b in re.split(r"\n\s*\n", text or "") if b.strip()], size)


def chunks_of(documents: DataFrame, size: int = lx.CHUNK_SIZE) -> DataFrame:
    """document_id, chunk_index, content: a narrow pass over (document_id, text); a block that is a heading is a chunk."""
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")
    blocks = F.transform(parts, lambda b: F.struct(b.alias("text"), tx.heading(b).alias("alone")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cut = b["blocks"].map(lambda x: pack_blocks([(y["text"], y["alone"]) for y in x] if x is not None else [], size))
            out = pd.DataFrame({"document_id": b["document_id"], "content": cut}).explode("content")
            out["chunk_index"] = out.groupby(level=0).cumcount()
            yield out.dropna(subset=["content"])[["document_id", "chunk_index", "content"]]

    kind = documents.schema["document_id"].dataType.simpleString()
    return documents.select("document_id", blocks.alias("blocks")).mapInPandas(run, f"document_id {kind}, chunk_index int, content string")


def sections(chunks: DataFrame, gap: int = 2) -> DataFrame:
    """With `section`: a new one begins with a document, at a heading line, or after a gap of chunks."""
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    first = F.substring_index("content", "\n", 1)
    new = F.lag("chunk_index").over(order).isNull() | tx.heading(first) | (F.col("chunk_index") - F.lag("chunk_index").over(order) > gap)
    return chunks.withColumn("new", new.cast("int")).withColumn("section", F.sum("new").over(order).cast("int")).drop("new")


def compact(sections_: DataFrame, most: int = 12) -> DataFrame:
    """With `part`: neighbouring sections of a document joined so that at most `most` remain."""
    n = F.max("section").over(Window.partitionBy("document_id"))
    size = F.ceil(n / most)
    return sections_.withColumn("part", (F.floor((F.col("section") - 1) / size) + 1).cast("int"))


def largest_groups(texts: list[str], most: int) -> list[dict]:
    """Normalised sentences in order, grouped greedily by two shared terms or more: the first
    sentence's place and the number of members of the largest groups.

    A group is looked up by its terms, not compared with each sentence."""
    holders: dict[str, set[int]] = {}
    groups: list[list[int]] = []
    for place, text in enumerate(texts):
        own = {w for w in text.split(" ") if len(w) >= 4}
        shared: dict[int, int] = {}
        for w in own:
            for g in holders.get(w, ()):
                shared[g] = shared.get(g, 0) + 1
        g = min((g for g, n in shared.items() if n >= 2), default=len(groups))
        if g == len(groups):
            groups.append([place, 0])
        groups[g][1] += 1
        for w in own:
            holders.setdefault(w, set()).add(g)
    best = sorted(range(len(groups)), key=lambda g: (-groups[g][1], g))[:most]
    return [{"first": groups[g][0], "members": groups[g][1]} for g in best]


def key_points(sentences: DataFrame, most: int = 5) -> DataFrame:
    """Sentences of a document grouped greedily by two shared terms or more; its largest groups."""
    @F.pandas_udf("array<struct<first:int,members:int>>")
    def groups(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: largest_groups(list(t), most))

    row = F.struct("chunk_index", "at", "sentence", F.array_join("words", " ").alias("norm"))
    rows = tx.once(sentences.groupBy("document_id").agg(F.collect_list(row).alias("rows")), rows=F.array_sort("rows"))
    best = rows.withColumn("best", groups("rows.norm")).select("document_id", "rows.sentence", F.posexplode("best").alias("k", "of"))
    return best.select("document_id", (F.col("k") + 1).alias("place"), F.get("sentence", F.col("of.first")).alias("sentence"), "of.members")


# Rows of pages: columns document_id, page, position, text.

def repeated_edges(rows: DataFrame) -> DataFrame:
    """Headers and footers: keys of the first and last two rows of pages that two pages or more share, half if there are four or more."""
    page = Window.partitionBy("document_id", "page")
    # Counted from the start and, by the page's size, from the end: one sort.
    edge = rows.withColumn("a", F.row_number().over(page.orderBy("position"))).withColumn("rows", F.count("*").over(page)).filter("a <= 2 or a > rows - 2")
    key = F.regexp_replace(tx.norm(F.col("text")), r"[0-9]+", "#")
    seen = edge.withColumn("key", key).filter("key <> ''").groupBy("document_id", "key").agg(F.count_distinct("page").alias("pages"))
    n = rows.groupBy("document_id").agg(F.count_distinct("page").alias("n"))
    return seen.join(n, "document_id").filter(F.col("pages") >= F.when(F.col("n") >= 4, F.ceil(F.col("n") / 2)).otherwise(2)).select("document_id", "key", "pages")


def without_edges(rows: DataFrame) -> DataFrame:
    key = F.regexp_replace(tx.norm(F.col("text")), r"[0-9]+", "#")
    return rows.withColumn("key", key).join(repeated_edges(rows).select("document_id", "key"), ["document_id", "key"], "left_anti").drop("key")


def paragraph_gaps(rows: DataFrame) -> DataFrame:
    """Each document's upper median gap between rows (12 without any) and the gap that parts paragraphs."""
    before = F.lag("position").over(Window.partitionBy("document_id", "page").orderBy("position"))
    gaps = rows.withColumn("gap", F.col("position") - before)
    g = F.array_sort(F.collect_list("gap"))
    one = gaps.groupBy("document_id").agg(g.alias("g"))
    median = F.when(F.size("g") == 0, F.lit(12)).otherwise(F.try_element_at("g", F.expr("cast(size(g) div 2 + 1 as int)"))).cast("double")
    return one.select("document_id", median.alias("median_gap"), F.greatest(F.lit(18.0), median * 1.8).alias("paragraph_gap"))


def page_blocks(rows: DataFrame) -> DataFrame:
    """document_id, page, block, text: paragraphs of each page from its rows, by position.

    One begins at a heading, a bullet, after a colon, or after a gap of 1.8 times the page's
    upper median gap (12 without any), 18 at least. A hyphen before a lower-case letter joins
    its word; letters and digits of two rows are parted by a space. Blank rows go."""
    page = Window.partitionBy("document_id", "page")
    order = page.orderBy("position", "text")
    gap = F.col("position") - F.lag("position").over(order)
    found = tx.once(rows.withColumn("gap", gap), text=F.regexp_replace("text", r"^\s+|\s+$", ""))
    median = F.coalesce(F.get(F.array_sort(F.collect_list(F.when(F.col("gap") > 0, F.col("gap"))).over(page)), F.floor(F.count_if(F.col("gap") > 0).over(page) / 2).cast("int")), F.lit(12))
    found = found.withColumn("wide", F.col("gap") >= F.greatest(F.lit(18), F.floor(median * 1.8))).filter("text <> ''")
    before, after = F.lag("text").over(order), F.lead("text").over(order)
    new = before.isNull() | tx.heading(F.col("text")) | tx.bullet(F.col("text")) | F.col("wide") | before.endswith(":")
    found = found.withColumns({"new": F.coalesce(new, F.lit(False)).cast("int"), "after": after})
    found = found.withColumn("block", F.sum("new").over(order).cast("int"))
    last = F.lead("block").over(order).isNull() | (F.lead("block").over(order) > F.col("block"))
    joins = F.col("text").endswith("-") & F.col("after").rlike(r"^\p{Ll}")
    spaced = F.col("text").rlike(r"[\p{L}\p{N}]$") & F.col("after").rlike(r"^[\p{L}\p{N}]")
    part = F.when(last, F.col("text")).when(joins, F.regexp_replace("text", " *-$", "")).when(spaced, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("position", F.col("text").alias("of"), F.col("part"))))
    blocks = found.withColumn("part", part).groupBy("document_id", "page", "block").agg(parts.alias("x"))
    return blocks.select("document_id", "page", "block", tx.clean_text(F.array_join("x.part", "")).alias("text"))
