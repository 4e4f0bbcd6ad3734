"""Stream operators in their batch form, over the event and conversation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import catalog as cat
from ..streaming import jobs
from .base import table


def tumbling_windows(s, sf):
    return jobs.tumbling(table(s, sf, "events")).select(F.col("start").cast("string").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding_windows(s, sf):
    return jobs.sliding(table(s, sf, "events")).select(F.col("start").cast("string").alias("start"), "n")


def user_sessions(s, sf):
    return jobs.user_sessions(table(s, sf, "events")).select("user_id", F.col("start").cast("string").alias("start"), "n")


def conversation_memory(s, sf):
    t = jobs.memory(table(s, sf, "conversations"))
    out, n = tx.redact(F.col("text"))
    return t.select("conv_id", "turn", "age", F.md5(out).alias("text"), n.cast("int").alias("redactions"))


def user_memories(s, sf):
    """Events are turns; every third one used documents."""
    ids = F.when(F.col("event_id") % 3 == 0, F.array(*[F.col(c).cast("string") for c in ("event_id", "user_id", "event_id")]))
    t = table(s, sf, "events").select(F.col("event_type").alias("tenant_id"), "user_id", F.col("ts").cast("timestamp").alias("created_at"), F.concat(F.lit(" "), "event_type").alias("question"), F.lit(None).cast("string").alias("answer"), ids.alias("document_ids"))
    return jobs.user_memory(t).select("tenant_id", "user_id", "turns", F.array_join("document_ids", ",").alias("documents"))


def ask_history(s, sf):
    logs = table(s, sf, "conversations").select(F.col("conv_id").cast("string").alias("user_id"), F.col("turn").alias("created_at"), F.col("turn").alias("log_id"), "role")
    return cat.history(logs, "1").select("user_id", "created_at", "role")


def _steps(s, sf):
    """A user's events are the steps of a job."""
    return table(s, sf, "events").select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("step_id"), F.col("event_type").alias("state"))


def job_states(s, sf):
    return jobs.latest_state(_steps(s, sf)).select("job_id", "state", "steps")


def job_status(s, sf):
    r = table(s, sf, "events").select(F.col("user_id").alias("job_id"), (F.col("event_id") % 97 != 0).alias("ok"))
    return jobs.final_status(r)


def upload_events(s, sf):
    e = table(s, sf, "events").select(F.to_json(F.struct(F.col("event_id").cast("string").alias("job_id"), F.col("user_id").cast("string").alias("document_id"), F.lit("v1").alias("document_version_id"), F.col("event_type").alias("tenant_id"), F.concat(F.col("event_type"), F.lit("/"), F.col("event_id").cast("string"), F.lit("_mi_archivo.pdf")).alias("object_key"))).alias("value"))
    return jobs.upload_events(e).select("job_id", "document_id", "tenant_id", "file_name")


def distinct_events(s, sf):
    """Idempotent events: of each user, type and day the first."""
    e = table(s, sf, "events").select("user_id", "event_type", F.to_date("ts").cast("string").alias("day"))
    return e.dropDuplicates()


def ingest_totals(s, sf):
    c = jobs.ingest(table(s, sf, "documents").select(F.col("doc_id").alias("document_id"), "text"))
    return c.groupBy("document_id").agg(F.count("*").alias("chunks"), F.max(F.length("content")).alias("longest"))


QUERIES = {
    "tumbling_windows": (tumbling_windows, "SELECT CAST(time_bucket(INTERVAL 1 DAY, ts) AS VARCHAR) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
    "sliding_windows": (sliding_windows, "SELECT strftime(d - to_days(o::INTEGER), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS d FROM events), (SELECT unnest([0, 1]) AS o) GROUP BY ALL"),
    "user_sessions": (user_sessions, """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM a) SELECT user_id, CAST(min(ts) AS VARCHAR) AS start, count(*) AS n FROM b GROUP BY user_id, g"""),
    "conversation_memory": (conversation_memory, None),
    "user_memories": (user_memories, """SELECT event_type AS tenant_id, user_id, CAST(count(*) AS INTEGER) AS turns, coalesce(arg_min(d, age) FILTER (d <> ''), '') AS documents FROM (
      SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, d DESC) AS age FROM (
        SELECT event_type, user_id, ts, CASE WHEN event_id % 3 <> 0 THEN '' WHEN event_id = user_id THEN event_id::VARCHAR ELSE event_id || ',' || user_id END AS d FROM events)) WHERE age <= 5 GROUP BY ALL"""),
    "ask_history": (ask_history, "SELECT CAST(conv_id AS VARCHAR) AS user_id, turn AS created_at, role FROM conversations WHERE conv_id = 1 ORDER BY turn DESC LIMIT 20"),
    "job_states": (job_states, "SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS steps FROM events GROUP BY user_id"),
    "job_status": (job_status, "SELECT user_id AS job_id, count(*) FILTER (event_id % 97 <> 0) AS embedded, count(*) FILTER (event_id % 97 = 0) AS failed, CASE WHEN count(*) FILTER (event_id % 97 = 0) > 0 THEN 'failed_partial' ELSE 'embedded' END AS status FROM events GROUP BY user_id"),
    "upload_events": (upload_events, "SELECT CAST(event_id AS VARCHAR) AS job_id, CAST(user_id AS VARCHAR) AS document_id, event_type AS tenant_id, 'mi_archivo.pdf' AS file_name FROM events"),
    "distinct_events": (distinct_events, "SELECT DISTINCT user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events"),
    "ingest_totals": (ingest_totals, None),
}
