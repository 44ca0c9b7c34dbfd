"""Feedback analytics: deduplication, joins with trajectories, rewards, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_share


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def moment(iso: Column) -> Column:
    """Timestamp of an ISO string, naive ones read as UTC; null where it cannot be read."""
    return F.try_to_timestamp(iso)


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Upsert semantics: of the rows of one key the last by ``order``; rows without a key stay out."""
    w = Window.partitionBy(key).orderBy(*[c.desc_nulls_last() for c in order])
    return rows.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def clamped_rating(rating: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(rating, F.lit(1))))


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def reward(feedback: DataFrame) -> Column:
    """A given reward signal, else two fifths of the rating's place in 1..5 and a fifth for each flag."""
    given = F.try_element_at("metadata", F.lit("reward_signal")).try_cast("double")
    made = 0.4 * (clamped_rating(F.col("rating")) - 1) / 4 + 0.2 * (yes(F.col("was_helpful")) + yes(F.col("was_accurate")) + yes(F.col("was_safe")))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(given, made))), 4)


def response_id(feedback: DataFrame) -> Column:
    """The response that feedback is about: from its metadata, else its question."""
    return F.lower(F.coalesce(blank_to_null(F.try_element_at("metadata", F.lit("response_id"))), blank_to_null(F.col("question_id"))))


def reward_by_response(feedback: DataFrame) -> DataFrame:
    """Feedback by response: counts, rewards, ratings, rates and the time of the last one."""
    f = feedback.select(response_id(feedback).alias("response_id"), reward(feedback).alias("reward"), clamped_rating(F.col("rating")).alias("rating"), yes(F.col("was_helpful")).alias("h"), yes(F.col("was_accurate")).alias("a"), yes(F.col("was_safe")).alias("s"), "received_at").where("response_id is not null")
    return f.groupBy("response_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("reward"), 4).alias("reward_mean"), F.min("reward").alias("reward_min"), F.max("reward").alias("reward_max"),
        F.round(F.avg("rating"), 4).alias("rating_mean"), F.min("rating").alias("rating_min"), F.max("rating").alias("rating_max"),
        F.round(F.avg("h"), 4).alias("helpful_rate"), F.round(F.avg("a"), 4).alias("accurate_rate"), F.round(F.avg("s"), 4).alias("safe_rate"), F.max("received_at").alias("last_at"),
    )


def first_texts(feedback: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` texts of each response by arrival: ``response_id, ids, texts``; the limit runs before
    the lists are made, so that no list grows."""
    f = feedback.select(response_id(feedback).alias("response_id"), "feedback_id", "feedback_text", "received_at").where("response_id is not null and feedback_text <> ''")
    w = Window.partitionBy("response_id").orderBy("received_at", "feedback_id", "feedback_text")
    few = f.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
    lists = few.groupBy("response_id").agg(F.array_sort(F.collect_list(F.struct("k", F.col("feedback_id").alias("id"), F.col("feedback_text").alias("text")))).alias("l"))
    return lists.select("response_id", F.col("l.id").alias("ids"), F.col("l.text").alias("texts"))


def event_rows(feedback: DataFrame, trajectories: DataFrame, train_share: float = 0.9) -> DataFrame:
    """One training row for each feedback: its reward, rating and flags (missing ones follow the rating,
    safety counts as given), whether its response has a trajectory, and a split by its own id."""
    rid = response_id(feedback)
    rating = clamped_rating(F.coalesce("rating", F.lit(3)))
    flag = lambda c, default: F.coalesce(F.col(c), default).cast("double")
    sample = F.coalesce(blank_to_null(F.col("feedback_id")), rid)
    rows = feedback.select(sample.alias("sample_id"), rid.alias("response_id"), "received_at", reward(feedback).alias("reward"), rating.alias("rating"), flag("was_helpful", rating >= 4).alias("helpful"), flag("was_accurate", rating >= 4).alias("accurate"), flag("was_safe", F.lit(True)).alias("safe")).where("response_id is not null")
    known = trajectories.select(F.lower(blank_to_null(F.col("response_id"))).alias("_r")).where("_r is not null").distinct()
    out = rows.join(known, F.col("response_id") == F.col("_r"), "left").withColumn("has_trajectory", F.col("_r").isNotNull()).drop("_r")
    return out.withColumn("split", F.when(hash_share(F.col("sample_id")) < train_share, F.lit("train")).otherwise(F.lit("val")))


def training_rows(feedback: DataFrame, trajectories: DataFrame, unmatched: bool = False, train_share: float = 0.9) -> DataFrame:
    """Aggregated feedback joined with the last trajectory of its response, flattened, with a split from
    the hash of the response id. The feedback is aggregated before the join."""
    t = trajectories.withColumn("response_id", F.lower(blank_to_null(F.col("response_id"))))
    t = latest(t, "response_id", [F.col("received_at"), F.col("ts_iso")])
    flat = t.select("response_id", F.col("question").alias("question"), F.col("action.pipeline").alias("pipeline"), F.col("action.model_choice").alias("model_choice"), F.col("retrieval.count").alias("retrieval_count"), F.col("retrieval.top_score").alias("top_score"), F.col("outcome.confidence_score").alias("confidence_score"), F.col("outcome.latency_ms").alias("latency_ms"), F.col("safety.level").alias("safety_level"))
    joined = reward_by_response(feedback).join(flat, "response_id", "left" if unmatched else "inner")
    return joined.withColumn("split", F.when(hash_share(F.col("response_id")) < train_share, F.lit("train")).otherwise(F.lit("val")))


def statistics(feedback: DataFrame) -> DataFrame:
    """One row of counts and rates, zeros for an empty table."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return feedback.agg(
        F.count(F.lit(1)).alias("total"), F.round(z(F.avg("rating")), 6).alias("average_rating"), F.round(z(F.avg(yes(F.col("was_helpful")))), 6).alias("helpful_rate"),
        F.round(z(F.avg(yes(F.col("was_accurate")))), 6).alias("accurate_rate"), F.round(z(F.avg(yes(F.col("was_safe")))), 6).alias("safe_rate"), F.count_if(F.col("rating") <= 2).alias("low_rated"),
    )


def export_rows(feedback: DataFrame, least: int = 4) -> DataFrame:
    """Feedback good enough to train on."""
    return feedback.where((F.col("rating") >= least) & F.col("was_helpful") & F.col("was_accurate"))
