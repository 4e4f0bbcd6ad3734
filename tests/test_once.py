"""Expensive steps stand once in a plan, however many expressions read them, and give what they gave."""

import pytest
from pyspark.sql import functions as F

from docspindle.functions import display as dp
from docspindle.functions import text as tx
from docspindle.functions import unicode
from docspindle.operators import extract as ex
from docspindle.operators import tabular as tb
from docspindle.operators.index import ChunkIndex, batch_search


def folds(df):
    """How often the plan translates letters with marks: once for each normalisation that is evaluated."""
    return df._jdf.queryExecution().analyzed().toString().count("translate(")


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(1, "Canción ñandú"), (2, "plain"), (3, ""), (4, None), (5, "ো ෞ 각 é \U0001d15e")], "document_id long, text string")


def test_norm_folds_once(texts):
    n = texts.select("document_id", tx.norm(F.col("text")).alias("n"))
    assert folds(n) == 1
    got = {r["document_id"]: r["n"] for r in n.collect()}
    assert (got[1], got[2], got[3], got[4]) == ("cancion nandu", "plain", "", None)
    marks = {r[0]: r[1] for r in texts.select("document_id", unicode.without_marks(F.col("text"))).collect()}
    assert marks[5] == unicode.bare("ো ෞ 각 é \U0001d15e") and marks[4] is None


def test_rows_normalise_each_key_once(spark):
    lines = spark.createDataFrame([("d", "Fila 1: Año = 1.234,5, AÑO = 7, x = , = y, Clave = a=b"), ("d", "Fila 2: Año = "), ("d", "otra")], "document_id string, content string")
    rows = tb.parse_rows(lines)
    assert folds(rows) == 1
    assert {r["row"]: r["pairs"] for r in rows.collect()} == {1: {"ano": "7", "clave": "a=b"}, 2: {}}
    assert [tuple(r) for r in tb.above(rows, "ano", 5.0).select("row", "value").collect()] == [(1, 7.0)]


def test_overlap_normalises_once(texts):
    q = F.array(F.lit("cancion"), F.lit("x"))
    j = texts.select("document_id", tx.jaccard(tx.terms(tx.norm(F.col("text"))), q).alias("j"))
    assert folds(j) == 1
    got = {r["document_id"]: r["j"] for r in j.collect()}
    assert (got[1], got[2], got[3]) == (pytest.approx(1 / 3), 0.0, 0.0)


def test_answers_normalise_lines_and_blocks_once(spark):
    t = "Uno dos\nuno  dós\ntres\n\nTRES\n\nUNO DOS\ntres\n\n--\n\n--\n\nfin"
    d = spark.createDataFrame([(t,), ("",), (None,)], "text string")
    shown = d.select(dp.final(F.col("text")).alias("t"))
    assert folds(shown) == 2
    assert [r["t"] for r in shown.collect()] == ["Uno dos\ntres\n\nTRES\n\n--\n\n--\n\nfin", "", None]


def test_sentences_normalise_once(texts):
    s = ex.sentence_rows(texts.select("document_id", F.lit(0).alias("chunk_index"), F.col("text").alias("content")))
    pushed = s._jdf.queryExecution().optimizedPlan().toString().count("translate(")
    assert pushed == 1


def test_index_normalises_a_batch_once(spark, tmp_path, monkeypatch):
    seen, write = [], ChunkIndex._append

    def append(self, df, *rest):
        seen.append(folds(df))
        write(self, df, *rest)

    monkeypatch.setattr(ChunkIndex, "_append", append)
    c = spark.createDataFrame([(1, 0, "1-0", "Canción luna"), (1, 1, "1-1", None)], "document_id long, chunk_index int, chunk_id string, content string")
    made = ChunkIndex(spark, str(tmp_path / "i"), 2).add(c).add(c.withColumn("document_id", F.col("document_id") + 1))
    assert seen == [1, 0, 0, 0] * 2
    assert made.table("chunks").count() == 4


@pytest.mark.parametrize(("block", "asked", "share"), [(1 << 17, 200_000, 0.02), (3, 2, 0.0), (5, 1, 1.0)])
def test_batch_search_keeps_pairs_in_tasks(spark, block, asked, share):
    """Chunks that share a word with a question are counted in blocks: no join gives their positions."""
    words = ["a", "b", "c", "d", "e"]
    held = [(i, 0, f"{i}-0", [w for k, w in enumerate(words) if i % (k + 2) == 0]) for i in range(60)]
    chunks = spark.createDataFrame(held, "document_id long, chunk_index int, chunk_id string, words array<string>")
    postings = chunks.select(F.explode("words").alias("word"), "document_id", "chunk_index", "chunk_id")
    asks = [("x", ["a", "b", "zz"]), ("y", ["e"]), ("z", words), ("none", []), ("lost", ["zz"])]
    got = batch_search(spark.createDataFrame(asks, "question string, terms array<string>"), postings, chunks, 3, share=share, least=1, block=block, asked=asked)
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert joins and not any("document_id" in x for x in joins)
    want = []
    for q, terms in asks:
        scored = sorted((-len(set(terms) & set(w)), d) for d, _, _, w in held if set(terms) & set(w))[:3]
        want += [(q, r, d, -s) for r, (s, d) in enumerate(scored, 1)]
    assert sorted((r["question"], r["rank"], r["document_id"], r["score"]) for r in got.collect()) == sorted(want)


def test_batch_search_has_a_task_for_each_block(spark):
    """No two blocks meet in one task by their hashes, and none is dealt out twice."""
    words = [f"w{k}" for k in range(40)]
    chunks = spark.createDataFrame([(i, 0, f"{i}-0", [words[i % 40], words[i * 7 % 40]]) for i in range(400)], "document_id long, chunk_index int, chunk_id string, words array<string>")
    asks = spark.createDataFrame([(f"q{k}", words[k : k + 3]) for k in range(12)], "question string, terms array<string>")
    got = batch_search(asks, chunks.select(F.explode("words").alias("word")), chunks, 2, block=20, asked=6)
    plan = got._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("FlatMapCoGroupsInPandas") :]
    assert below.count("(direct_shuffle_partition_id(task") == 2 and ", 40), REPARTITION_BY_NUM" in below
    assert not any("hashpartitioning(task" in x or "hashpartitioning(block" in x for x in below.splitlines())
    assert {r["question"] for r in got.collect()} == {f"q{k}" for k in range(12)}
    for k in range(9):
        want = sorted((-len({words[i % 40], words[i * 7 % 40]} & set(words[k : k + 3])), i) for i in range(400))[:2]
        assert [(-r["score"], r["document_id"]) for r in got.filter(F.col("question") == f"q{k}").orderBy("rank").collect()] == want
