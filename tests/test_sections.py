"""Titled sections against the fold over a document's chunks, and samples."""

import random

import pytest
from pyspark.sql import functions as F

from docspindle.operators import sections


def folded(rows, most=12):
    """(chunk_index, title found) of one document -> (title, chunks, first, last), a chunk and a group at a time."""
    groups = []
    for i, found in rows:
        g = groups[-1] if groups else None
        if g is None or i - g["last"] > 2 or (found and found.lower() != g["title"].lower()):
            groups.append({"title": found or f"Parte {len(groups) + 1}", "n": 1, "first": i, "last": i})
        else:
            g["n"] += 1
            g["last"] = i
    made = lambda g: g["title"].startswith("Parte ")
    merged = []
    for g in groups:
        p = merged[-1] if merged else None
        if p and (made(p) or made(g)) and min(p["n"], g["n"]) < 2 and g["first"] - p["last"] <= 1:
            p["n"] += g["n"]
            p["last"] = g["last"]
        else:
            merged.append(dict(g))
    size = -(-len(merged) // most)
    out = []
    for run in (merged[k : k + size] for k in range(0, len(merged), size)):
        title = next((g["title"] for g in run if not made(g)), run[0]["title"])
        out.append((title, sum(g["n"] for g in run), run[0]["first"], run[-1]["last"]))
    return out


def test_sections_are_those_of_the_fold(spark):
    rng = random.Random(7)
    rows, docs = [], {}
    for d in range(60):
        at, own = 0, []
        for _ in range(rng.choice([1, 2, 5, 20, 150])):
            at += rng.choice([1, 1, 1, 2, 4])
            own.append((at, rng.choice([None, None, None, "UNO DOS", "TRES DOS", "uno dos:", "2.1 Tema", "2.2 Tema"])))
        docs[d] = [(i, t and t.rstrip(":")) for i, t in own]
        rows += [(d, f"{d}-{i}", i, f"texto va.\n{t or 'y sigue'}\nmas texto va.") for i, t in own]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "document_id long, chunk_id string, chunk_index int, content string").withColumn("section", F.lit("other")).repartition(5)
    got = {}
    for r in sections.summary_sections(df.drop("section")).orderBy("document_id", "place").collect():
        got.setdefault(r["document_id"], []).append((r["title"], r["chunks"], r["first"], r["last"]))
    assert got == {d: folded(own) for d, own in docs.items()}
    assert max(len(x) for x in got.values()) == 12


@pytest.mark.parametrize("content, title", [("texto va.\r\n - DATOS  GENERALES -", "DATOS GENERALES"), ("Anexo final:", "Anexo final"), ("IV. Parte", "IV. Parte"), ("una línea va.", None), ("", None), (None, None), ("x" * 91 + ":", None)])
def test_titles(spark, content, title):
    assert spark.range(1).select(sections.title_of(F.lit(content).cast("string")).alias("t")).head()["t"] == title


def test_awkward_chunks(spark):
    """Null texts and indexes, repeated rows and an empty table have a result."""
    schema = "document_id long, chunk_id string, chunk_index int, content string"
    assert sections.summary_sections(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a", None, None), (1, "a", None, None), (1, "b", 0, "UNO DOS"), (None, "c", 0, ""), (2, None, -1, None)]
    got = {(r["document_id"], r["title"], r["chunks"], r["line"]) for r in sections.summary_sections(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, "Parte 1", 3, "1. Parte 1 (chunks: 3, rango: 0-0)"), (None, "Parte 1", 1, "1. Parte 1 (chunks: 1, rango: 0-0)"), (2, "Parte 1", 1, "1. Parte 1 (chunks: 1)")}


@pytest.mark.parametrize("n, kept", [(1, [0]), (2, [0, 1]), (3, [0, 1, 2]), (10, [0, 5, 9])])
def test_sample(spark, n, kept):
    df = spark.range(n).selectExpr("1L document_id", "cast(id as string) chunk_id", "cast(id as int) chunk_index")
    assert sorted(r["chunk_index"] for r in sections.sample(df).collect()) == kept
