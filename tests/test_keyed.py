"""Tables with keys: replays, batches that died, and a fold in Python."""

import random

import pytest

from docspindle.sources.keyed import KeyedTable, start_merges

SCHEMA = "tenant_id string, name string, n int"


def rows_of(t):
    return sorted(t.read().collect(), key=str)


def test_batches_fold_like_a_dictionary(spark, tmp_path):
    """Updates, inserts of what is missing and deletions, with repeated and null keys and an empty batch."""
    rng, t, want = random.Random(5), KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["tenant_id", "name"], 4), {}
    for how in ["update", "keep", "delete", "update", "delete", "keep", "update"]:
        rows = [(rng.choice(["a", "b", None]), rng.choice([*"uvwxyz", None]), rng.choice([*range(9), None])) for _ in range(rng.choice([0, 8, 12]))]
        t.merge(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as other"), how=how)
        batch = {}
        for a, b, n in rows:  # the greatest of a key, null least
            batch[a, b] = max([x for x in (batch.get((a, b)), n) if x is not None], default=None)
        for k, n in batch.items():
            if how == "delete":
                want.pop(k, None)
            elif how == "update" or k not in want:
                want[k] = n
        assert {(r.tenant_id, r.name): r.n for r in t.read().collect()} == want and t.read().count() == len(want)
    t.clean()
    assert {(r.tenant_id, r.name): r.n for r in t.read().collect()} == want
    some = spark.createDataFrame([(None, None), ("a", "u")], "tenant_id string, name string")
    assert {(r.tenant_id, r.name) for r in t.lookup(some).collect()} == want.keys() & {(None, None), ("a", "u")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["name"], 16)
    t.merge(spark.range(200).selectExpr("'a' tenant_id", "cast(id as string) name", "1 n"))
    t.merge(spark.createDataFrame([("a", "7", 2)], SCHEMA))
    assert len(list((tmp_path / "t/rows/batch=0").glob("__bucket=*"))) == 16
    assert len(list((tmp_path / "t/rows/batch=1").glob("__bucket=*"))) == 1
    assert t.read().count() == 200 and t.read().filter("n = 2").count() == 1
    t.clean()
    assert len(list((tmp_path / "t/rows/batch=0").glob("__bucket=*"))) == 15


def test_replays_change_nothing_and_dead_batches_are_not_seen(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["name"], 4)
    one, two = (spark.createDataFrame(x, SCHEMA) for x in ([("a", "x", 1), ("a", "y", 1)], [("a", "x", 2), ("a", "z", 2)]))
    t.merge(one, 0).merge(two, 1).merge(one, 0)
    assert [(r.name, r.n) for r in rows_of(t)] == [("x", 2), ("y", 1), ("z", 2)]

    def dies(lines):
        raise RuntimeError("lost")

    three = spark.createDataFrame([("a", "y", 3)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(t, "_commit", dies)
        with pytest.raises(RuntimeError):
            t.merge(three, 2)
    assert [(r.name, r.n) for r in rows_of(t)] == [("x", 2), ("y", 1), ("z", 2)]
    t.merge(three, 2)
    assert [(r.name, r.n) for r in rows_of(t)] == [("x", 2), ("y", 3), ("z", 2)]
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["name"], 8).read()


def test_stream_of_merges(spark, tmp_path):
    """The newest of each key, though a second checkpoint brings all micro-batches again."""
    for i in range(3):
        spark.createDataFrame([("a", f"k{j}", i * 10 + j) for j in range(i, i + 3)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["tenant_id", "name"], 4)
    for checkpoint in ("c", "again"):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        start_merges(stream, t, str(tmp_path / checkpoint), newest=("n",)).awaitTermination()
        assert [(r.name, r.n) for r in rows_of(t)] == [("k0", 0), ("k1", 11), ("k2", 22), ("k3", 23), ("k4", 24)]
