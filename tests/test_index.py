"""The search index against scans, many questions at once, all letters, first characters, types of uploads."""

import random
import sys
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspindle.functions import text as tx
from docspindle.functions import unicode
from docspindle.functions.intent import intent, norm, phrase_terms
from docspindle.operators import search as se
from docspindle.operators.concat import head_of_concatenation
from docspindle.operators.index import ChunkIndex, _Counter, batch_search
from docspindle.sources.readers import file_type, read_documents

WORDS = "canción CANCIÓN luna lunas aluna lnua cancionero cancoin gobernantes gobernante gobernnates ejecutivos ejecuitvos 100% a_b x.y de la the ñandú supercalifragilisticoespialidoso supercalifragilisticoespialidosas".split()
QUERIES = ["canción de la luna", "gobernantes", "ejecutivos lunas", "100% luna", "a_b x.y", "zzzz", "supercalifragilisticoespialidoso", "el"]


def chunks_of(spark, n, start=0, seed=1):
    rng = random.Random(seed)
    rows = [(d, i, f"{d}-{i}", " ".join(rng.choices(WORDS, k=rng.randint(0, 8)))) for d in range(start, start + n) for i in range(3)]
    rows += [(start, 8, f"{start}-8", None), (start, 9, f"{start}-9", "")]
    return spark.createDataFrame(rows, "document_id long, chunk_index int, chunk_id string, content string")


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """An index of two batches, and the same chunks."""
    a, b = chunks_of(spark, 30), chunks_of(spark, 20, 100, 2)
    index = ChunkIndex(spark, str(tmp_path_factory.mktemp("index") / "i"), 4)
    index.add(a)
    before = index.global_search("luna", 100).count()
    index.add(b)
    return index, a.unionByName(b).cache(), before


def ids(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("query", QUERIES)
def test_index_finds_what_scans_find(made, query):
    index, chunks, _ = made
    cols = ["chunk_id", "content", "score"]
    assert ids(index.global_search(query, 7).select(cols)) == ids(se.global_search(chunks, query, 7).select(cols))
    hit = tx.any_of([F.col("content").ilike(f"%{t}%") for t in phrase_terms(query)])
    assert ids(index.phrase_matches(query).select("chunk_id")) == ids(chunks.filter(hit).select("chunk_id"))
    i, ready = intent(query), se.prepared(chunks)
    for found, score in ((index.keyword_scores(i), se.keyword_score(i)), (index.relaxed_scores(i), se.relaxed_score(i))):
        assert ids(found.select(cols)) == ids(ready.withColumn("score", score).filter("score > 0").select(cols))


def test_added_chunks_are_found(made):
    index, chunks, before = made
    assert 0 < before < index.global_search("luna", 100).count()


def test_words_near(made, spark):
    index, chunks, _ = made
    known = {w for r in chunks.collect() for w in norm(r["content"] or "").split()}
    for term in ("lunas", "gobernantes", "ejecutivos", "supercalifragilisticoespialidoso", "nadaq"):
        words = spark.createDataFrame([(w,) for w in known], "word string")
        want = words.filter((F.length("word") >= 5) & (F.levenshtein("word", F.lit(term), 2 if len(term) >= 9 else 1) >= 0))
        assert ids(index.words_near(term)) == ids(want)


def test_searches_open_only_their_folders(made):
    index, _, _ = made
    plan = index.rows_of("norm", index.words_near("gobernantes"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


@pytest.mark.parametrize("share, least", [(0.02, 1000), (0.1, 0), (0.0, 0)])
def test_batch_search(spark, made, share, least):
    index, chunks, _ = made
    rng = random.Random(4)
    asked = [(f"q{k}", rng.sample([norm(w).split()[0] for w in WORDS], rng.randint(1, 5))) for k in range(30)] + [("none", []), ("unknown", ["zzz"]), ("null", None), ("q0", ["luna"])]
    questions = spark.createDataFrame(asked[:-1], "question string, terms array<string>").withColumn("word", F.lit(1)).withColumn("score", F.lit(1))
    postings = index.table("postings").filter("kind = 'norm'").select("word", "document_id", "chunk_index", "chunk_id")
    got = batch_search(questions, postings, index.table("chunks"), 4, share=share, least=least).collect()
    held = {(r["document_id"], r["chunk_index"], r["chunk_id"]): set(norm(r["content"] or "").split()) for r in chunks.collect()}
    want = []
    for q, terms in asked[:-1]:
        best = sorted((-len(words & set(terms)), at) for at, words in held.items() if terms and words & set(terms))[:4]
        want += [(q, k + 1, *at, -n) for k, (n, at) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert batch_search(questions.limit(0), postings, index.table("chunks")).collect() == []


def test_all_letters_lose_their_marks(spark):
    """Code points that are as old as the unicodedata of version 3.2, one by one and in words (U+1734, a mark in
    the JVM's version, is a letter's part in the later one)."""
    old = [c for c in map(chr, (*range(32, 0xD800), *range(0xE000, sys.maxunicode + 1))) if unicodedata.ucd_3_2_0.category(c) != "Cn" and c != "\u1734"]
    df = spark.createDataFrame([(c,) for c in old], "c string").select("c", unicode.without_marks(F.col("c")).alias("bare"))
    assert [(r["c"], r["bare"]) for r in df.collect() if r["bare"] != unicode.bare(r["c"])] == []
    texts = ["Čeština szőlő țară", "Ἀθῆναι Ελλάδα", "Tiếng Việt", "한국어 가", "ｷﾞ é é", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.norm(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in got] == [None if t is None else norm(t) for t in texts]


def test_head_of_concatenation(spark):
    rng = random.Random(5)
    rows = [(d, rng.randrange(2000), "".join(rng.choices("abc é🙂", k=rng.choice([0, 1, 3, 40])))) for d in range(6) for _ in range(400)]
    rows += [(7, 1, None), (8, 0, "x" * 9), (8, 1, "y"), (8, 2, "z"), (None, 1, "n")]
    df = spark.createDataFrame(rows, "document_id long, chunk_index int, content string").withColumn("at", F.lit(1))
    for limit in (1, 9, 10, 11, 300, 100_000):
        got = {r["document_id"]: r["text"] for r in head_of_concatenation(df, F.col("content"), limit).collect()}
        want = {}
        for d, i, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[0] or 0, r[1], r[2].encode())):
            want.setdefault(d, []).append(t)
        assert {k: v for k, v in got.items() if k is not None} == {k: "\n".join(v)[:limit] for k, v in want.items() if k is not None}


def test_types_of_uploads(spark, tmp_path):
    cases = [("a.XLS", "", "excel"), ("a.gif", "", "image"), ("a.tiff", None, "image"), ("a", "application/vnd.openxmlformats-officedocument.wordprocessingml.document; x", "docx"), ("a.b", "application/csv", "csv"), ("a", "Image/Heic", "image"), ("a", "application/zip", "application/zip"), ("a", None, "unknown"), ("a.pdf", "text/plain", "pdf")]
    df = spark.createDataFrame([(p, m) for p, m, _ in cases], "path string, mime string")
    assert [r[0] for r in df.select(file_type(F.col("path"), F.col("mime"))).collect()] == [k for _, _, k in cases]
    (tmp_path / "note").write_text("hola")
    mimes = spark.createDataFrame([("note", "text/plain")], "file string, mime string")
    assert [(r["file_type"], r["text"]) for r in read_documents(spark, str(tmp_path), mimes).collect()] == [("text", "hola")]
    assert [r["file_type"] for r in read_documents(spark, str(tmp_path)).collect()] == ["unknown"]


def test_index_takes_no_more_disk_than_texts_need(spark, tmp_path):
    """Positions and texts are stored once, lists take two bytes a chunk, and no text is shuffled."""
    rng = random.Random(6)
    syllables = ["an", "ther", "in", "on", "ed", "st", "ble", "ou", "wh", "re", "ea", "ha", "nt"]
    known = ["".join(rng.choices(syllables, k=rng.randint(1, 5))) for _ in range(3000)]
    rows = [(d, i, f"{d}-{i}", " ".join(rng.choices(known, k=40))) for d in range(2000) for i in range(5)]
    chunks = spark.createDataFrame(rows, "document_id long, chunk_index int, chunk_id string, content string")
    ChunkIndex(spark, str(tmp_path / "i"), 4).add(chunks)

    def size(path):
        return sum(f.stat().st_size for f in path.rglob("*.parquet"))

    chunks.write.parquet(str(tmp_path / "texts"))
    assert size(tmp_path / "i") < 2 * size(tmp_path / "texts")


def test_words_of_texts_are_those_of_their_raw_words(spark, tmp_path):
    texts = ["ΟΔΟΣ ΟΔΟΣ.\tİstanbul", " \x1fa\x1cb\x85c d e\vf\fg\r\nh ", "́acento ́ é́x", "각 한국어-가", "-- %% a--b", "", " ", None, "x" * 40 + " L'eau", "ﬁn ǅ ẞ"]
    chunks = spark.createDataFrame([(1, k, f"1-{k}", t) for k, t in enumerate(texts)], "document_id long, chunk_index int, chunk_id string, content string")
    index = ChunkIndex(spark, str(tmp_path / "i"), 2).add(chunks)
    raw = F.filter(F.array_distinct(F.split(F.lower("content"), r"\s+")), lambda w: w != "")
    for kind, words in (("raw", raw), ("norm", F.array_distinct("words"))):
        want = se.prepared(chunks).select("chunk_id", F.explode(words).alias("word"))
        assert ids(index.table("postings").filter(F.col("kind") == kind).select("chunk_id", "word")) == ids(want)
        assert ids(index.words(kind).select("word").distinct()) == ids(want.select("word").distinct())
    assert ids(index.table("chunks").select("chunk_id")) == ids(chunks.select("chunk_id"))


@pytest.mark.parametrize("most", [0, 30, 1000])
def test_words_of_a_block_are_counted_at_once(most):
    """Bits of counters against counts, for no word, few and many, chunks that fill no whole row of bits, ties by place."""
    rng = np.random.default_rng(7)
    n, lists = 333, [np.sort(rng.choice(333, size, replace=False)) for size in (1, 333, 200, 64, 63, *rng.integers(1, 120, 70))]
    counter = _Counter(n, np.concatenate(lists).astype(np.int32), np.append(0, np.cumsum([len(x) for x in lists])), most)
    for size in (0, 1, 2, 3, 4, 7, 8, 31, 33, 64, 75, 2):
        words, score = rng.permutation(len(lists))[:size], np.zeros(n, int)
        for w in words:
            score[lists[w]] += 1
        want = [i for i in np.lexsort((np.arange(n), -score)) if score[i]][:6]
        top, held = counter.best(words, 6)
        assert (top.tolist(), held.tolist()) == (want, score[want].tolist())
