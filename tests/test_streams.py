"""Streams with state and by micro-batch, and the page and chunk folds."""

import pytest
from pyspark.sql import functions as F

from docspindle.operators import chunker
from docspindle.streaming import jobs


def test_memory_stream(spark, tmp_path):
    """Three files, a micro-batch each; turns arrive out of order, and one twice."""
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    parts = [[(1, 3, "c"), (2, 0, "x"), (3, None, "no turn")], [(1, 1, "a"), (1, 5, "e"), (1, 4, None)], [(1, 2, "b"), (1, 6, "f"), (1, 7, "g"), (1, 3, "c again")]]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, "conv_id long, turn int, text string").coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        next((tmp_path / f"p{i}").glob("*.parquet")).rename(src / f"{i}.parquet")
    stream = spark.readStream.schema("conv_id long, turn int, text string").option("maxFilesPerTrigger", 1).parquet(str(src))

    def write(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(str(out))

    jobs.memory_stream(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(out)).toPandas()
    newest = {c: g[g["batch"] == g["batch"].max()].sort_values("age") for c, g in got.groupby("conv_id")}
    assert newest[1]["turn"].tolist() == [7, 6, 5, 4, 3] and newest[1]["text"].tolist() == ["g", "f", "e", None, "c again"]
    assert newest[2]["text"].tolist() == ["x"] and 3 not in newest


def test_old_memory_ends(spark, tmp_path):
    """A user's memory goes once the watermark is past its limit; a later turn finds none of it. Until then stream and batch agree."""
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    day = "2024-01-0"
    parts = [
        [("t", "a", f"{day}1 10:00", " hola ", None, ["d1", "d1", "d2"]), ("t", "a", f"{day}1 10:01", "sigue", "si", []), ("t", "b", f"{day}1 10:00", " ", "", None), ("u", "a", f"{day}1 10:00", "x", "", ["d9", None])],
        [("t", "a", f"{day}1 10:00", " hola ", None, ["d1", "d1", "d2"]), ("t", "a", f"{day}1 10:02", "otra", "", None)],
        [("t", "c", f"{day}5 10:00", "lejos", "", None)],
        [("t", "c", f"{day}5 10:01", "lejos", "", ["d7"])],
        [("t", "a", f"{day}5 10:02", "de nuevo", "", None)],
    ]
    kinds = "tenant_id string, user_id string, t string, question string, answer string, document_ids array<string>"
    for i, p in enumerate(parts):
        df = spark.createDataFrame(p, kinds).withColumn("created_at", F.to_timestamp("t")).drop("t")
        df.coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        next((tmp_path / f"p{i}").glob("*.parquet")).rename(src / f"{i}.parquet")
    schema = df.schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))

    def write(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(str(out))

    jobs.user_memory_stream(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    told = {}
    for r in sorted(spark.read.parquet(str(out)).collect(), key=lambda r: r["batch"]):
        told.setdefault((r["tenant_id"], r["user_id"]), []).append((r["turns"], r["document_ids"]))
    assert told["t", "a"] == [(2, ["d1", "d2"]), (3, ["d1", "d2"]), (0, []), (1, [])]
    assert told["u", "a"] == [(1, ["d9"]), (0, [])] and told["t", "c"] == [(1, []), (2, ["d7"])] and ("t", "b") not in told
    batch = {(r["tenant_id"], r["user_id"]): (r["turns"], r["document_ids"]) for r in jobs.user_memory(spark.read.schema(schema).parquet(*(str(src / f"{i}.parquet") for i in (0, 2, 3)))).collect()}
    assert batch == {("t", "a"): (2, ["d1", "d2"]), ("u", "a"): (1, ["d9"]), ("t", "c"): (2, ["d7"])}


def test_job_steps_are_there_once(spark, tmp_path):
    events = [(f"j{i}", f"d{i}") for i in range(5)]
    spark.createDataFrame(events, "job_id string, document_id string").write.parquet(str(tmp_path / "in"))
    texts = spark.createDataFrame([("d0", "hola", "ok"), ("d1", None, "failed_parse"), ("d2", None, "unsupported_format"), ("d3", " ", "ok")], "document_id string, text string, status string")
    for checkpoint in ("c", "again"):  # a batch that is run again replaces itself
        stream = spark.readStream.schema("job_id string, document_id string").parquet(str(tmp_path / "in"))
        jobs.start_jobs(stream, texts, str(tmp_path / "out"), str(tmp_path / checkpoint)).awaitTermination()
    got = sorted((r["job_id"], r["step_id"], r["result"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [
        ("j0", 1, "completed"), ("j0", 2, "completed"), ("j0", 3, "completed"), ("j1", 1, "completed"), ("j1", 2, "failed"), ("j2", 1, "completed"), ("j2", 2, "skipped"),
        ("j3", 1, "completed"), ("j3", 2, "completed"), ("j3", 3, "failed"), ("j4", 1, "completed"),
    ]


def test_events_come_once_and_late_ones_go(spark, tmp_path):
    """`once` within the watermark; a window that is closed takes no late event (lateness is judged by the watermark of the batch before)."""
    src = tmp_path / "in"
    src.mkdir()
    parts = [[("a", "2024-01-01 10:00"), ("a", "2024-01-01 10:05"), ("b", "2024-01-01 10:10")], [("c", "2024-01-05 10:00")], [("e", "2024-01-05 10:00")], [("d", "2024-01-01 10:00"), ("c", "2024-01-05 10:01")]]
    for i, p in enumerate(parts):
        df = spark.createDataFrame(p, "k string, t string").select("k", F.to_timestamp("t").alias("ts"), F.lit("e").alias("event_type"), F.lit(1.0).alias("value"))
        df.coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        next((tmp_path / f"p{i}").glob("*.parquet")).rename(src / f"{i}.parquet")
    schema = "k string, ts timestamp, event_type string, value double"

    def run(df, name):
        df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).outputMode("append").start().awaitTermination()
        return spark.read.parquet(str(tmp_path / name))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    assert sorted(r["k"] for r in run(jobs.once(stream, "ts", ["k"]), "once").collect()) == ["a", "b", "c", "e"]
    assert [(r["n"], str(r["start"])[:10]) for r in run(jobs.tumbling(stream, watermark=True), "windows").collect()] == [(3, "2024-01-01")]


def test_headings_stand_alone(spark):
    df = spark.createDataFrame([(1, "uno dos tres va.\n\n2.1 Introducción\n\ncuatro cinco va.\n\nseis siete va."), (2, None), (3, ""), (4, "TITULO")], "document_id long, text string")
    got = {}
    for r in chunker.chunks_of(df).orderBy("document_id", "chunk_index").collect():
        got.setdefault(r["document_id"], []).append(r["content"])
    assert got == {1: ["uno dos tres va.", "2.1 Introducción", "cuatro cinco va.\n\nseis siete va."], 4: ["TITULO"]}


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(0, "el pro-"), (12, "ceso es largo,"), (24, "y sigue")], ["el proceso es largo, y sigue"]),
        ([(0, "uno va"), (12, "dos va"), (24, "tres va"), (50, "otro va")], ["uno va dos va tres va", "otro va"]),
        ([(0, "lista de cosas:"), (12, "a la vez"), (24, "- punto uno"), (36, "1. Introducción")], ["lista de cosas:", "a la vez", "- punto uno", "1. Introducción"]),
        ([(0, "uno va"), (12, " "), (24, "dos va"), (36, None)], ["uno va dos va"]),
    ],
)
def test_page_blocks(spark, rows, want):
    df = spark.createDataFrame([(1, 1, *r) for r in rows], "document_id long, page int, position int, text string")
    assert [r["text"] for r in chunker.page_blocks(df).orderBy("block").collect()] == want
