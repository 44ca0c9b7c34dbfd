"""Feedback, sessions, events and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import feedback as B
from ..operators import sessions as S
from ..streaming import feedback_stream as ST
from .registry import query, table

_YES = "coalesce({0}, false)::INT"
_RATING = "greatest(1, least(5, coalesce(rating, 1)))"
_REWARD = f"round(greatest(0, least(1, coalesce(try_cast(metadata['reward_signal'] AS DOUBLE), 0.4::DOUBLE * ({_RATING} - 1) / 4 + 0.2::DOUBLE * ({_YES.format('was_helpful')} + {_YES.format('was_accurate')} + {_YES.format('was_safe')})))), 4)"
_RESPONSE = "lower(coalesce(nullif(trim(metadata['response_id']), ''), nullif(trim(question_id), '')))"
_BY_RESPONSE = f"""g AS (SELECT {_RESPONSE} AS response_id, count(*) AS n, round(avg({_REWARD}), 4) AS reward_mean, min({_REWARD}) AS reward_min, max({_REWARD}) AS reward_max, round(avg({_RATING}), 4) AS rating_mean, min({_RATING}) AS rating_min, max({_RATING}) AS rating_max,
  round(avg({_YES.format('was_helpful')}), 4) AS helpful_rate, round(avg({_YES.format('was_accurate')}), 4) AS accurate_rate, round(avg({_YES.format('was_safe')}), 4) AS safe_rate, max(received_at) AS last_at FROM user_feedback WHERE {_RESPONSE} IS NOT NULL GROUP BY 1)"""


@query(f"SELECT count(*) AS total, round(coalesce(avg(rating), 0), 6) AS average_rating, round(coalesce(avg({_YES.format('was_helpful')}), 0), 6) AS helpful_rate, round(coalesce(avg({_YES.format('was_accurate')}), 0), 6) AS accurate_rate, round(coalesce(avg({_YES.format('was_safe')}), 0), 6) AS safe_rate, count(CASE WHEN rating <= 2 THEN 1 END) AS low_rated FROM user_feedback")
def feedback_stats(spark: SparkSession, d: str) -> DataFrame:
    return B.statistics(table(spark, d, "user_feedback"))


@query(f"WITH {_BY_RESPONSE} SELECT * FROM g")
def reward_by_response(spark: SparkSession, d: str) -> DataFrame:
    return B.reward_by_response(table(spark, d, "user_feedback"))


@query(f"""WITH {_BY_RESPONSE}, t AS (SELECT * FROM (SELECT lower(nullif(trim(response_id), '')) AS response_id, question, action.pipeline AS pipeline, action.model_choice AS model_choice, retrieval."count" AS retrieval_count, retrieval.top_score AS top_score, outcome.confidence_score AS confidence_score, outcome.latency_ms AS latency_ms, safety.level AS safety_level,
    row_number() OVER (PARTITION BY lower(nullif(trim(response_id), '')) ORDER BY received_at DESC NULLS LAST, ts_iso DESC NULLS LAST) AS k FROM response_trajectory) WHERE k = 1 AND response_id IS NOT NULL)
  SELECT g.*, t.* EXCLUDE (response_id, k), CASE WHEN ('0x' || substr(sha1(response_id), 1, 8))::UBIGINT / 4294967295.0 < 0.9 THEN 'train' ELSE 'val' END AS split FROM g JOIN t USING (response_id)""")
def training_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Feedback joined with the last trajectory of its response, flattened and split."""
    return B.training_rows(table(spark, d, "user_feedback"), table(spark, d, "response_trajectory"))


@query(f"""WITH {_BY_RESPONSE}, t AS (SELECT DISTINCT lower(nullif(trim(response_id), '')) AS response_id FROM response_trajectory)
  SELECT count(*) AS responses, sum(n)::BIGINT AS feedback, count(CASE WHEN t.response_id IS NULL THEN 1 END) AS unmatched, count(CASE WHEN ('0x' || substr(sha1(g.response_id), 1, 8))::UBIGINT / 4294967295.0 < 0.9 THEN 1 END) AS train, round(avg(reward_mean), 6) AS reward FROM g LEFT JOIN t ON g.response_id = t.response_id""")
def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = B.training_rows(table(spark, d, "user_feedback"), table(spark, d, "response_trajectory").withColumn("action", F.struct(F.coalesce("action.pipeline", F.lit("-")).alias("pipeline"), F.col("action.model_choice").alias("model_choice"))), unmatched=True)
    return rows.agg(F.count(F.lit(1)).alias("responses"), F.sum("n").alias("feedback"), F.count_if(F.col("pipeline").isNull()).alias("unmatched"), F.count_if(F.col("split") == "train").alias("train"), F.round(F.avg("reward_mean"), 6).alias("reward"))


@query("""SELECT feedback_id, rating, received_at FROM user_feedback WHERE rating <= 2 ORDER BY received_at DESC, feedback_id LIMIT 100""")
def low_rated(spark: SparkSession, d: str) -> DataFrame:
    """The hundred newest low ratings (a top-k report)."""
    return table(spark, d, "user_feedback").where("rating <= 2").orderBy(F.desc("received_at"), "feedback_id").limit(100).select("feedback_id", "rating", "received_at")


@query("""SELECT feedback_id, max(received_at) AS received_at, count(*) AS versions FROM user_feedback WHERE feedback_id IS NOT NULL GROUP BY feedback_id""")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last line of each feedback id and how many there were."""
    f = table(spark, d, "user_feedback").where("feedback_id is not null")
    return f.groupBy("feedback_id").agg(F.max("received_at").alias("received_at"), F.count(F.lit(1)).alias("versions"))


@query("SELECT feedback_id, question_id, rating FROM user_feedback WHERE rating >= 4 AND was_helpful AND was_accurate")
def export_for_training(spark: SparkSession, d: str) -> DataFrame:
    return B.export_rows(table(spark, d, "user_feedback")).select("feedback_id", "question_id", "rating")


@query("""SELECT date_trunc('day', received_at) AS day, count(*) AS n, round(avg(outcome.latency_ms), 4) AS latency, round(avg(outcome.confidence_score), 6) AS confidence, round(avg(retrieval."count"), 6) AS documents, count(CASE WHEN outcome.latency_ms > 30000 THEN 1 END) AS slow, count(CASE WHEN NOT outcome.is_answerable THEN 1 END) AS unanswerable FROM response_trajectory GROUP BY 1""")
def trace_summary(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "response_trajectory")
    ms = F.col("outcome.latency_ms")
    return t.groupBy(F.date_trunc("day", "received_at").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ms), 4).alias("latency"), F.round(F.avg("outcome.confidence_score"), 6).alias("confidence"), F.round(F.avg("retrieval.count"), 6).alias("documents"), F.count_if(ms > 30000).alias("slow"), F.count_if(~F.col("outcome.is_answerable")).alias("unanswerable"))


@query("""SELECT regexp_replace(ts_iso, '[0-9]', '9', 'g') AS shape, count(*) AS n, count(CASE WHEN ts_iso LIKE '____-__-__T__:__:__Z' THEN 1 END) AS utc FROM user_feedback GROUP BY 1""")
def timestamp_shapes(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "user_feedback")
    return f.groupBy(F.regexp_replace("ts_iso", "[0-9]", "9").alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ts_iso").like("____-__-__T__:__:__Z")).alias("utc"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 24 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
  SELECT user_id, min(ts) AS start, max(ts) AS last_at, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return S.sessions(table(spark, d, "events"), "user_id", "ts")


@query("""SELECT session, response_id, received_at, (n - back + 1)::INT AS turn FROM (SELECT *, least(3, count(*) OVER (PARTITION BY session)) AS n FROM (SELECT lower(trim(session_id)) AS session, response_id, received_at, row_number() OVER (PARTITION BY lower(trim(session_id)) ORDER BY received_at DESC, response_id DESC) AS back FROM response_trajectory WHERE trim(session_id) <> '')) WHERE back <= 3""")
def conversation_window(spark: SparkSession, d: str) -> DataFrame:
    """The last three turns of each session."""
    t = table(spark, d, "response_trajectory").withColumn("session", B.blank_to_null(F.lower("session_id")))
    return S.last_turns(t, "session", ["received_at", "response_id"]).select("session", "response_id", "received_at", "turn")


@query(r"""SELECT question, received_at FROM (SELECT question, received_at, response_id, row_number() OVER (PARTITION BY question ORDER BY received_at DESC, response_id DESC) AS k FROM response_trajectory WHERE question IS NOT NULL) WHERE k = 1 ORDER BY received_at DESC, response_id DESC LIMIT 20""")
def recent_questions(spark: SparkSession, d: str) -> DataFrame:
    """The twenty questions asked last (a top-k report)."""
    return S.recent_questions(table(spark, d, "response_trajectory"), "question", ["received_at", "response_id"]).select("question", "received_at")


@query(r"""WITH w AS (SELECT pair_id, list_filter(string_split_regex(trim(answer, E' \t\n\r\f'), '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM qa_pair WHERE answer IS NOT NULL),
  p AS (SELECT pair_id, w, unnest(range(0, (len(w) + 2) // 3)) AS i FROM w WHERE len(w) > 0)
  SELECT pair_id, i::INT AS part, array_to_string(w[i * 3 + 1 : i * 3 + 3], ' ') AS piece FROM p""")
def response_stream(spark: SparkSession, d: str) -> DataFrame:
    """Answers in groups of three words."""
    return S.word_groups(table(spark, d, "qa_pair"), "pair_id", "answer")


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts of the event log, run as a stream over its files to the end."""
    s = ST.log_stream(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return ST.run_to_end(ST.windowed_counts(s, "ts", "event_type", "value"), "hourly", "complete")


@query("""SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total, (sum(CAST(json_extract_string(props, '$.k') AS BIGINT)))::BIGINT AS k FROM events GROUP BY 1, 2""")
def daily_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.date_trunc("day", "ts").alias("day"), "user_id", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"), F.sum("k").alias("k"))
