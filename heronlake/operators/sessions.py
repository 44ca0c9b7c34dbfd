"""Sessions and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, user: str, time: str, gap: str = "24 hours") -> DataFrame:
    """Sessions that end after ``gap`` without an event: ``user, start, end, n``."""
    return events.where(F.col(user).isNotNull()).groupBy(user, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("last_at")).select(user, F.col("w.start").alias("start"), "last_at", "n")


def last_turns(turns: DataFrame, session: str, order: list[str], n: int = 3) -> DataFrame:
    """The last ``n`` turns of each session with their place, oldest first."""
    w = Window.partitionBy(session).orderBy(*[F.desc(c) for c in order])
    kept = turns.where(F.col(session).isNotNull()).withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= n)
    return kept.withColumn("turn", F.row_number().over(Window.partitionBy(session).orderBy(F.desc("_back")))).drop("_back")


def context_windows(turns: DataFrame, session: str, question: str, answer: str, order: list[str], n: int = 3, preview: int = 200, budget: int = 2000) -> DataFrame:
    """The text of each session's last ``n`` turns, answers cut after ``preview`` characters, up to the turn
    that would go beyond ``budget``: ``session, context, turns``. At most ``n`` rows of a session meet."""
    kept = last_turns(turns, session, order, n)
    said = F.when(F.length(answer) > preview, F.concat(F.substring(answer, 1, preview), F.lit("..."))).otherwise(F.col(answer))
    text = F.concat(F.lit("User: "), F.coalesce(F.col(question), F.lit("")), F.lit("\nAssistant: "), F.coalesce(said, F.lit("")))
    upto = F.sum(F.length("_text")).over(Window.partitionBy(session).orderBy("turn"))
    fits = kept.withColumn("_text", text).withColumn("_upto", upto).where(F.col("_upto") <= budget)
    return fits.groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "_text"))), lambda x: x["_text"]), "\n\n").alias("context"), F.count(F.lit(1)).alias("turns"))


def recent_questions(turns: DataFrame, question: str, order: list[str], n: int = 20) -> DataFrame:
    """The ``n`` questions asked last, each once; the partial limit runs before the final sort."""
    w = Window.partitionBy(question).orderBy(*[F.desc(c) for c in order])
    once = turns.where(F.col(question).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return once.orderBy(*[F.desc(c) for c in order]).limit(n)


def word_groups(answers: DataFrame, key: str, text: str, size: int = 3) -> DataFrame:
    """An answer as it is streamed: groups of ``size`` words in order."""
    w = answers.where(F.col(text).isNotNull()).select(key, F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    return w.select(key, "w", F.posexplode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / size).cast("int"))).alias("part", "p")).select(key, "part", F.array_join(F.slice("w", F.col("p") * size + 1, F.lit(size)), " ").alias("piece"))
