"""Each stage of the pipeline against a plain version, on its own input."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from docspindle.llm import simhash, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and output of every stage, written and read again; some rows are repeated or null."""
    top = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(None, "no id", "en", "src1", 5), (7001, None, None, None, None), (7002, "", "en", None, 0)], docs.schema)
    docs = docs.unionByName(docs.filter("doc_id < 3")).unionByName(more)
    out = {}
    for name, stage in cp.STAGES:
        got = stage(spark, docs, SF)
        got.write.parquet(str(top / name))
        out[name] = (docs, spark.read.parquet(str(top / name)))
        docs = out[name][1]
    return out


def _ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is None, x))


def test_columns_stay(stages):
    for name, (before, after) in stages.items():
        if name != "mixing":
            assert after.columns == before.columns


def test_toxic_rows_go(spark, stages):
    before, after = stages["toxicity"]
    bad = {r["doc_id"] for r in toxicity.score_toxicity(before, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1").collect()}
    assert _ids(after) == [i for i in _ids(before) if i is None or i not in bad]


def brute_survivors(rows):
    """One row of each group: smallest id (null last), then fingerprint, then columns."""
    fps = sorted({simhash.simhash(r["text"], 4) for r in rows})
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for f in fps:
            for g in fps:
                if (f ^ g).bit_count() <= 4 and label[g] < label[f]:
                    label[f], changed = label[g], True
    signed = lambda f: f - (f >> 63 << 64)
    kept = {}
    for r in rows:
        f = simhash.simhash(r["text"], 4)
        key = (r["doc_id"] is None, r["doc_id"] or 0, signed(f), tuple("" if x is None else "1" + str(x) for x in r))
        if label[f] not in kept or key < kept[label[f]][0]:
            kept[label[f]] = (key, r)
    return sorted((tuple(r) for _, r in kept.values()), key=str)


def test_one_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    assert sorted((tuple(r) for r in after.collect()), key=str) == brute_survivors(before.collect())


def test_rows_of_one_id_are_told_apart(spark):
    words = lambda k, n=80: " ".join(f"{k}{i}" for i in range(n))
    rows = [(1, words("a"), "x"), (1, words("b"), "x"), (1, words("b"), "x"), (2, words("a"), "x"), (3, words("b") + " more", "x"), (3, words("c"), "y"), (None, words("d"), "x"), (None, words("d"), "x"), (None, words("c"), "x"), (4, None, "x"), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = cp.drop_near_duplicates(spark, docs.repartition(3), SF)
    assert got.columns == docs.columns
    got = got.collect()
    assert {(r["doc_id"], (r["text"] or "")[:1]) for r in got} == {(1, "a"), (1, "b"), (3, "c"), (None, "d"), (4, "")} and len(got) == 5
    assert cp.drop_near_duplicates(spark, docs.limit(0), SF).collect() == []


def test_leaks_go(spark, stages):
    before, after = stages["decontamination"]
    items = [" ".join(re.findall(r"\w+", r["text"].lower())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: " ".join(re.findall(r"\w+", (r["text"] or "").lower())) for r in before.collect()}
    leaking = {i for i, t in texts.items() if i is not None and any(f" {x} " in f" {t} " for x in items)}
    assert leaking and leaking.isdisjoint(_ids(after))
    assert len(_ids(after)) >= len(_ids(before)) - len(leaking) - 1


def test_private_data_goes(stages):
    before, after = stages["pii"]
    assert _ids(after) == _ids(before)
    shape = r"[\w.]+@[\w.]+\.\w+|\(\d{3}\) \d{3}-\d{4}|\b\d{16}\b|\b[0-9a-f]{40}\b"
    real = {m for r in before.collect() for m in re.findall(shape, r["text"] or "")}
    left = {m for r in after.collect() for m in re.findall(shape, r["text"] or "")}
    assert real and not real & left and len(left) == len(real)
    assert after.filter("n_chars <> length(text)").count() == 0


def test_mix_follows_what_is_left(stages):
    before, after = stages["mixing"]
    assert _ids(after) == _ids(before)
    off = after.join(before.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.abs(F.sum("taken") - F.first("target")).alias("off"), F.max("size").alias("most"))
    assert off.filter("off > most").count() == 0
