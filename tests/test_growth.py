"""What large tables hold and small ones don't, and steps whose cost must not outgrow the input."""

import random

import __spark_entry__ as entry
import duckdb
from pyspark.sql import functions as F

from docspindle.functions import lexicon as lx
from docspindle.functions import scans
from docspindle.functions import text as tx
from docspindle.functions.intent import intent
from docspindle.operators import chunker as ch
from docspindle.operators import extract as ex
from docspindle.operators import relations as rel
from docspindle.operators import reports
from docspindle.operators import search as se


def analyzed(df):
    return df._jdf.queryExecution().analyzed().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def against_sql(spark, folder, name, tables):
    """Rows of the query and of its SQL, each as sorted texts."""
    db = duckdb.connect()
    for t in tables:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return sorted(map(str, (tuple(r) for r in entry.queries()[name](spark, str(folder)).collect()))), sorted(map(str, db.sql(entry.oracle_sql()[name]).fetchall()))


def test_rows_keep_the_sign_of_zero(spark, tmp_path):
    """Among 900,000 balances some are just below zero."""
    rows = [(i, f"Customer#{i}", x, "FURNITURE") for i, x in enumerate((-0.0, -0.004, 0.0, 0.004, -0.29, 12.5, -999.85))]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got, told = against_sql(spark, tmp_path, "parsed_rows", ["customer"])
    assert got == told and sum("'-0.00'" in x for x in got) == 2


def test_terms_are_dealt_out_once(spark):
    rows = spark.createDataFrame([(1, 0, "Uno dos, thing thing. Cosas; thing cosas? abcd"), (1, 1, "cosas wxyz"), (2, 0, "")], "document_id long, chunk_index int, content string")
    found = ex.term_ranking(ex.sentence_rows(rows), 3)
    assert executed(found).count("Exchange hashpartitioning") == 1
    assert [(r["term"], r["count"]) for r in found.orderBy("rank").collect()] == [("cosas", 3), ("thing", 3), ("abcd", 1)]


ODD = ["", " a", "a ", "a  b", "a ,b", "a,b", "( a )", "a/b|c", "x--y", "x = y", "a\tb", "a\u00a0b", "\u200bab", "plain text, as it is.", "uno (dos) tres", "12 ab cd 3", "¿Qué? ~ sí", "abc...def 'ghi' \"jkl\",",
       "palabra,\u2028", "a b. c", "\u00e1,\u00e9", "-- x", "impor-", "(((ratones)))", "... .,. abc", "a $ b", "#tag +34", None]


def test_plain_lines_stay_without_steps(spark):
    """Lines without anything to change give what all the steps give; words are bared by the line."""
    lines = spark.createDataFrame([(x,) for x in ODD], "x string")
    x = F.col("x")
    words = F.transform(F.split(scans._bare(scans._smooth(x)), r"\s+"), scans._bare)
    slow = F.array_join(F.filter(words, lambda w: (F.length(w) >= 3) | w.rlike("[0-9]")), " ")
    found = lines.select("x", tx.clean_line(x).alias("a"), tx._cleaned(x).alias("b"), scans.clean_line(x).alias("c"), slow.alias("d")).collect()
    assert [(r["x"], r["a"], r["c"]) for r in found] == [(r["x"], r["b"], r["d"]) for r in found]
    assert "transform(split(" not in analyzed(lines.select(scans.clean_line(x)))


CHUNKS = [(1, 0, "sobre thing y más"), (1, 1, "nothing here"), (2, 0, "thíngs"), (2, 1, "otra"), (3, 0, None)]


def lines(spark):
    return spark.createDataFrame(CHUNKS, "document_id long, chunk_index int, content string").withColumn("chunk_id", F.concat_ws("-", "document_id", "chunk_index"))


def test_topic_search_ends_with_the_first_hit(spark):
    found = se.text_matches(lines(spark), "sobre thing")
    assert "Limit" in analyzed(found) and "octet_length" in analyzed(found)
    assert sorted((r["chunk_id"], r["topic_count"]) for r in found.collect()) == [("1-0", 1), ("2-0", 1)]
    assert sorted(r["chunk_id"] for r in se.text_matches(lines(spark).filter("chunk_id = '1-1'"), "sobre thing").collect()) == ["1-1"]


def test_only_likely_chunks_are_normalised_for_topics(spark):
    found = reports.topic_support(lines(spark), "Háblame sobre things en el documento")
    assert "octet_length" in analyzed(found)
    assert {r["document_id"]: r["supported"] for r in found.collect()} == {1: True, 2: True, 3: False}


def test_windows_grow_from_shorter_ones(spark):
    w = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],), (None,)], "w array<string>")
    found = w.select(tx.word_windows(F.col("w"), 2, 4).alias("x"), tx.word_windows(F.col("w"), 1, 2).alias("y"))
    assert "array_join" not in analyzed(found)
    assert [tuple(r) for r in found.collect()] == [(["a b", "b c", "a b c"], ["a", "b", "c", "a b", "b c"]), ([], ["a"]), ([], []), (None, None)]


def test_points_are_cut_before_they_are_dealt_out(spark):
    a, b, c, d = "uno dos tres cuatro cinco", "Uno, dos tres cuatro cinco", "seis siete ocho nueve diez", "once doce trece catorce quince"
    rows = spark.createDataFrame([(1, 1, f"{c}. {d}. {a}"), (1, 0, f"1 2 3 4 5 6. {a}. {b}? corto! {c}"), (2, 0, None), (3, 0, "x" * 230)], "document_id long, chunk_index int, content string")
    found = ex.useful_points(rows, 3)
    assert "posexplode" not in analyzed(found)
    assert [(r["document_id"], r["chunk_index"], r["at"], r["sentence"], r["place"]) for r in found.orderBy("place").collect()] == [(1, 0, 1, a, 1), (1, 0, 4, c, 2), (1, 1, 1, d, 3)]


def test_overlaps_compare_words_once(spark):
    i = intent("thble thing attion")
    found = tx.once(se.prepared(lines(spark)), score=se.overlap_score(i)).filter("score > 0")
    assert optimized(found).count("levenshtein(") == len(i.main_terms)
    assert {r["chunk_id"]: round(r["score"], 6) for r in found.collect()} == {"1-0": 1.333333, "1-1": 0.783333, "2-0": 1.033333}


def test_definitions_normalise_likely_sentences(spark):
    rows = spark.createDataFrame([(1, 0, "nada. Thíng, attion. Thing attion"), (2, 0, "la otra"), (3, 0, None)], "document_id long, chunk_index int, content string")
    found = ex.definitions(rows, intent("thing attion"))
    assert "octet_length" in analyzed(found)
    assert [(r["document_id"], r["at"]) for r in found.collect()] == [(1, 1)]


def test_page_edges_sort_once(spark):
    rows = spark.createDataFrame([(1, p, x, t) for p in (0, 1) for x, t in enumerate(["Head 1", "a", f"m{p}x", "z", "Foot 2"])], "document_id long, page int, position int, text string")
    edges = ch.repeated_edges(rows)
    assert "DESC" not in executed(edges)
    assert sorted(r["key"] for r in edges.collect()) == ["a", "foot #", "head #", "z"]
    assert sorted(r["text"] for r in ch.without_edges(rows).collect()) == ["m0x", "m1x"]


def test_key_points_look_groups_up(spark):
    def by_all_groups(texts, most):
        groups = []
        for place, text in enumerate(texts):
            own = {w for w in text.split(" ") if len(w) >= 4}
            g = next((g for g in groups if len(g[0] & own) >= 2), None)
            if g is None:
                groups.append(g := [set(), place, 0])
            g[0] |= own
            g[2] += 1
        return [{"first": g[1], "members": g[2]} for g in sorted(groups, key=lambda g: (-g[2], g[1]))[:most]]

    rng = random.Random(7)
    for _ in range(50):
        texts = [" ".join(rng.choices([f"w{k:03}" for k in range(12)] + ["abc"], k=rng.randint(1, 4))) for _ in range(30)]
        assert ch.largest_groups(texts, 5) == by_all_groups(texts, 5)
    rows = spark.createDataFrame([(1, 0, "otra cosa aqui. Grandes casas blancas. Blancas y grandes flores")], "document_id long, chunk_index int, content string")
    found = ch.key_points(ex.sentence_rows(rows))
    assert "FlatMapGroups" not in executed(found)
    assert [tuple(r) for r in found.orderBy("place").collect()] == [(1, 1, "Grandes casas blancas", 2), (1, 2, "otra cosa aqui", 1)]


def test_sizes_tell_most_pairs_apart(spark):
    texts = ["uno dos tres", "tres dos uno", "uno dos", "", "", "uno dos tres cuatro cinco seis siete ocho"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "document_id long, chunk_index int, norm string")
    found = se.drop_near_copies(rows, ["chunk_index"], ["document_id"])
    assert "greatest(" in analyzed(found)
    assert sorted(r["chunk_index"] for r in found.collect()) == [0, 2, 3, 4, 5]


def test_keywords_compare_words_once(spark):
    i = intent("things attion")
    found = tx.once(se.prepared(lines(spark)), score=se.keyword_score(i)).filter("score > 0")
    assert optimized(found).count("levenshtein(") == 1
    assert {r["chunk_id"]: round(r["score"], 6) for r in found.collect()} == {"1-0": 0.57, "2-0": 0.35}


def test_actions_normalise_once(spark):
    assert analyzed(lines(spark).select(rel.technical_actions(F.col("content")).alias("a"))).count("translate(") == 1


def test_actions_take_accents_off_few_words(spark):
    """The whole text is not normalised; what is found stays the same."""
    parts = sorted({t for terms in lx.ACTIONS.values() for t in terms})
    assert all(p.isascii() and p.isalnum() for p in parts)
    texts = [
        "TÓKEN", "to\u0301ken", "to\u200dken", "to\u00adken", "tó-ken", "tó ken", "to ken ñ", "to\nkén", "aquí:tokén,más", "TO\u212aEN", "\u1e6boken", "ｔｏｋｅｎ", "gİt", "gıt", "ǵi\u0327t\u0303",
        "subír\u00a0git", "d\u2126ocker dócker", "한국어 jwt́", "ﬁgit ß", "\U0001d400 cu\U0001e944rl cúrl", "ñ", "", " ", None, "tokeñ", "toke ñ", "tenant", "TENANT\tbéarer", "Α\u0345 upload", "ΣΑΣ úpload",
    ]
    texts += ["".join(random.Random(k).choices("giŧtǵíţ\u0301\u0338 \u00a0\n-K", k=9)) for k in range(300)]
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    held = rows.select("text", *[F.struct(tx.norm("text").contains(p).alias("norm"), tx.searched("text").contains(p).alias("searched")).alias(p) for p in parts]).collect()
    assert [(r["text"], p) for r in held for p in parts if r[p]["norm"] != r[p]["searched"]] == []
    assert sum(bool(r["git"]["norm"]) for r in held) > 5 and sum(bool(r["token"]["norm"]) for r in held) > 5
    told = rows.select(rel.technical_actions(F.col("text")).alias("a"))
    assert r"[^\p{L}\p{N}]+" not in analyzed(told)
    assert [tuple(r["a"]) for r in told.collect()] == [
        tuple(a for a, terms in lx.ACTIONS.items() if any(r[t]["norm"] for t in terms)) or (lx.NO_ACTION,) for r in held
    ]
