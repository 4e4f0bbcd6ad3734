"""Structured Streaming forms; each has a batch form with the same result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators.chunker import chunks_of

EVENT = "job_id string, document_id string, document_version_id string, tenant_id string, object_key string"

# States of a job, in order.
STATES = ["received", "parsed", "chunked", "embedded", "failed_partial", "failed_parse", "unsupported_format"]


def upload_events(raw: DataFrame, column: str = "value") -> DataFrame:
    """Upload events from JSON texts; broken ones have null fields and go."""
    e = raw.select(F.from_json(F.col(column).cast("string"), EVENT).alias("e")).select("e.*")
    name = F.regexp_replace(F.element_at(F.split("object_key", "/"), -1), r"^[^_]*_", "")
    return e.filter("job_id is not null and document_id is not null").withColumn("file_name", name)


def once(events: DataFrame, ts: str, key: list[str], delay: str = "1 hour") -> DataFrame:
    """Each key once; keys are remembered until the watermark passes."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def ingest(documents: DataFrame, size: int = 500) -> DataFrame:
    """clean -> redact -> chunk of (document_id, text): one narrow stage, batch or stream."""
    text, _ = tx.redact(tx.clean_text(F.col("text")))
    return chunks_of(documents.select("document_id", text.alias("text")), size)


def start_ingest(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str):
    """Parquet files that appear in `folder` -> chunks appended under `out`, exactly once."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return ingest(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def latest_state(steps: DataFrame) -> DataFrame:
    """Each job's last step and how many it took: an aggregation, so it also runs as a stream."""
    return steps.groupBy("job_id").agg(F.max(F.struct("ts", "step_id", "state")).alias("x"), F.count("*").alias("steps")).select("job_id", "x.state", "x.ts", "steps")


def final_status(results: DataFrame) -> DataFrame:
    """A job's status from its chunks' embeddings: ok, failed, or none."""
    ok, bad = F.count_if("ok"), F.count_if(~F.col("ok"))
    return results.groupBy("job_id").agg(ok.alias("embedded"), bad.alias("failed")).withColumn("status", F.when(F.col("failed") > 0, "failed_partial").otherwise("embedded"))


def tumbling(events: DataFrame, ts: str = "ts", width: str = "1 day", delay: str = "1 hour", watermark: bool = False) -> DataFrame:
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    e = e.withWatermark(ts, delay) if watermark else e
    return e.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, ts: str = "ts", width: str = "2 days", step: str = "1 day") -> DataFrame:
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return e.groupBy(F.window(ts, width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def user_sessions(events: DataFrame, ts: str = "ts", gap: str = "30 minutes", watermark: str | None = None) -> DataFrame:
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    e = e.withWatermark(ts, watermark) if watermark else e
    return e.groupBy(F.session_window(ts, gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def memory(turns: DataFrame, n: int = 5) -> DataFrame:
    """The newest n turns of each conversation."""
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("age", rank).filter(F.col("age") <= n)


def memory_stream(turns: DataFrame, n: int = 5) -> DataFrame:
    """`memory` of a stream of (conv_id, turn, text): after each micro-batch the newest n turns
    of the conversations in it. The state of a conversation is its newest n turns, whatever
    their order of arrival; a turn that comes again replaces itself, rows without one go."""
    kinds = [turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]

    def keep(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get)) if state.exists else {}
        for p in parts:
            held.update(zip(p["turn"].tolist(), p["text"].tolist()))
            held = {t: held[t] for t in sorted(held, reverse=True)[:n]}
        state.update((list(held), list(held.values())))
        yield pd.DataFrame({"conv_id": key[0], "turn": list(held), "text": list(held.values()), "age": range(1, len(held) + 1)})

    return turns.select("conv_id", "turn", "text").filter("turn is not null").groupBy("conv_id").applyInPandasWithState(
        keep, f"conv_id {kinds[0]}, turn {kinds[1]}, text string, age int", f"turns array<{kinds[1]}>, texts array<string>", "update", GroupStateTimeout.NoTimeout
    )


def remembered(turns: DataFrame) -> DataFrame:
    """Turns (tenant_id, user_id, created_at, question, answer, document_ids) as memory keeps them: trimmed,
    redacted, each document once; turns that hold nothing, or have no time, go."""
    said = [tx.redact(F.trim(F.coalesce(c, F.lit(""))))[0].alias(c) for c in ("question", "answer")]
    ids = F.coalesce(F.array_distinct(F.filter("document_ids", lambda x: x.isNotNull())), F.array().cast("array<string>"))
    t = turns.select("tenant_id", "user_id", "created_at", *said, ids.alias("document_ids"))
    return t.filter("created_at is not null and (question <> '' or answer <> '' or size(document_ids) > 0)")


def user_memory(turns: DataFrame, n: int = 5) -> DataFrame:
    """tenant_id, user_id, turns, document_ids: how many of a user's newest `n` turns there are, and
    the newest of their document sets that isn't empty (empty without one). No more than `n` turns of a user meet."""
    parts = ("created_at", "question", "answer", "document_ids")
    rank = F.row_number().over(Window.partitionBy("tenant_id", "user_id").orderBy(*[F.desc(c) for c in parts]))
    kept = remembered(turns).withColumn("age", rank).filter(F.col("age") <= n)
    newest = F.min_by(F.when(F.size("document_ids") > 0, F.col("document_ids")), F.when(F.size("document_ids") > 0, F.col("age")))
    return kept.groupBy("tenant_id", "user_id").agg(F.count("*").cast("int").alias("turns"), F.coalesce(newest, F.array().cast("array<string>")).alias("document_ids"))


def user_memory_stream(turns: DataFrame, n: int = 5, limit: int = 86400, delay: str = "10 minutes") -> DataFrame:
    """`user_memory` of a stream, after each micro-batch for the users in it. A user whose newest turn
    is `limit` seconds behind the watermark is forgotten, which a row of no turns tells once. Turns later
    than `delay` go; turns may come in any order, and one that comes again replaces itself."""
    t = remembered(turns.withWatermark("created_at", delay)).withColumn("at", F.unix_micros("created_at"))
    kinds = {c: t.schema[c].dataType.simpleString() for c in ("tenant_id", "user_id")}

    def keep(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: list = []
        if state.hasTimedOut:
            state.remove()
        else:
            if state.exists:
                held = [(a, q, s, tuple(d)) for a, q, s, d in zip(*state.get)]
            for p in parts:
                new = zip(p["at"].tolist(), p["question"], p["answer"], (tuple(d) for d in p["document_ids"]))
                held = sorted({*held, *new}, reverse=True)[:n]
            state.update(tuple([list(x) if i == 3 else x for x in c] for i, c in enumerate(zip(*held))))
            state.setTimeoutTimestamp(max(held[0][0] // 1000 + limit * 1000, state.getCurrentWatermarkMs() + 1))
        ids = next((list(x[3]) for x in held if x[3]), [])
        yield pd.DataFrame({"tenant_id": [key[0]], "user_id": [key[1]], "turns": [len(held)], "document_ids": [ids]})

    out = f"tenant_id {kinds['tenant_id']}, user_id {kinds['user_id']}, turns int, document_ids array<string>"
    held = "ats array<bigint>, questions array<string>, answers array<string>, documents array<array<string>>"
    return t.groupBy("tenant_id", "user_id").applyInPandasWithState(keep, out, held, "update", GroupStateTimeout.EventTimeTimeout)


def job_steps(events: DataFrame, texts: DataFrame) -> DataFrame:
    """Steps of each event's job: job_id, step_id, step, result. `texts` has document_id, text
    and status (ok, failed_parse or unsupported_format). A job without a text stays received."""
    found = events.select("job_id", F.col("document_id").alias("__of")).join(texts.select("document_id", "text", "status"), F.col("__of") == F.col("document_id"), "left")
    cut = F.col("status") == "ok"
    parsed = F.when(cut, "completed").when(F.col("status") == "unsupported_format", "skipped").when(F.col("status").isNotNull(), "failed")

    def step(number: int, name: str, result: Column) -> Column:
        return F.when(result.isNotNull(), F.struct(F.lit(number).alias("step_id"), F.lit(name).alias("step"), result.alias("result")))

    chunked = F.when(cut, F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "failed").otherwise("completed"))
    steps = F.array(step(1, "received", F.lit("completed")), step(2, "parsed_document", parsed), step(3, "chunks_created", chunked))
    return found.select("job_id", F.inline(F.array_compact(steps)))


def start_jobs(events: DataFrame, texts: DataFrame, out: str, checkpoint: str):
    """Appends the steps of arriving events under `out`, a folder for each micro-batch, which a
    batch that is run again replaces, so each step is there once."""

    def write(batch: DataFrame, number: int) -> None:
        job_steps(batch, texts).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
