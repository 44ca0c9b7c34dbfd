"""Judgements without a key of relevant documents: gold marks, word overlap, agreement of annotators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from .evaluation import kappa, overlap_share
from .scoring import STOP_WORDS


def matches_gold(doc_id: Column, source: Column, content: Column, ids: Column, sources: Column, keywords: Column) -> Column:
    """Whether a hit is what a test item asks for: its id is named, its source contains a named part, or its
    content has half of the keywords (the one there is, if there is one). Nulls on either side match nothing."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    n = F.coalesce(F.size(keywords), F.lit(0))
    there = F.coalesce(F.size(F.filter(keywords, lambda k: F.contains(low(content), F.lower(k)))), F.lit(0))
    named = F.coalesce(F.array_contains(ids, doc_id), F.lit(False))
    within = F.coalesce(F.exists(sources, lambda s: F.contains(low(source), F.lower(s))), F.lit(False))
    return named | within | ((n > 0) & (there >= F.greatest(F.lit(1), F.floor(n / 2))))


def overlap_relevance(hits: DataFrame, answers: DataFrame, content: str, share: float = 0.6, letters: int = 4) -> DataFrame:
    """``query_id, doc_id, rank, relevant``: a hit is relevant that has ``share`` of the answer's words of at
    least ``letters`` characters; where none is, the first hit is.

    ``hits``: ``query_id, doc_id, rank`` and the content; ``answers``: ``query_id, answer``. Answers without
    such words tell nothing and are left out.
    """
    wanted = answers.select("query_id", F.filter(F.array_distinct(words(F.lower("answer"))), lambda w: F.length(w) >= letters).alias("_w")).where(F.size("_w") > 0)
    seen = hits.join(wanted, "query_id").select("query_id", "doc_id", "rank", (overlap_share(F.col("_w"), words(F.lower(content))) >= share).alias("_r"))
    by = seen.groupBy(F.col("query_id").alias("_q")).agg(F.max("_r").alias("_any"), F.min("rank").alias("_first"))
    return seen.join(by, F.col("query_id") == F.col("_q")).select("query_id", "doc_id", "rank", F.when(F.col("_any"), F.col("_r")).otherwise(F.col("rank") == F.col("_first")).cast("int").alias("relevant"))


def agreeing_sources(hits: DataFrame, answers: DataFrame, content: str, more_than: float = 0.15) -> DataFrame:
    """Share of an answer's hits that have more than ``more_than`` of its words: ``query_id, hits, agreement``."""
    said = answers.select("query_id", F.array_distinct(words(F.lower("answer"))).alias("_w")).where(F.size("_w") > 0)
    seen = hits.join(said, "query_id").select("query_id", (overlap_share(F.col("_w"), words(F.lower(content))) > more_than).alias("_s"))
    return seen.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.round(F.avg(F.col("_s").cast("int")), 6).alias("agreement"))


def annotator_agreement(judged: DataFrame, item: str, annotator: str, dimensions: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Cohen's kappa of every two annotators over the items that both judged: ``pair, dimension, n, agreement, kappa``.

    Of an annotator's judgements of one item the last by ``order`` counts, so an item has one row for each
    annotator in the self-join, however often it was judged. Rows without item or annotator are left out.
    """
    last = judged.where(F.col(item).isNotNull() & F.col(annotator).isNotNull()).groupBy(F.col(item).alias("_item"), F.col(annotator).alias("_by")).agg(F.max(F.struct(*order, *[F.col(d).alias(f"_{d}") for d in dimensions])).alias("_last"))
    marks = last.select("_item", "_by", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"_last._{d}").cast("string").alias("mark")) for d in dimensions])).alias("_m")).select("_item", "_by", "_m.*").where("mark is not null")
    other = marks.select("_item", "dimension", F.col("_by").alias("_to"), F.col("mark").alias("mark_b"))
    both = marks.join(other, ["_item", "dimension"]).where(F.col("_by") < F.col("_to"))
    return kappa(both.select(F.concat_ws("_vs_", "_by", "_to").alias("pair"), "dimension", "mark", "mark_b"), "mark", "mark_b", ["pair", "dimension"])


def kept_keywords(keywords: Column, stop: Sequence[str] = STOP_WORDS, letters: int = 3) -> Column:
    """Keywords of at least ``letters`` characters that are no stop words, in their order."""
    return F.filter(keywords, lambda k: (F.length(F.trim(k)) >= letters) & ~F.lower(F.trim(k)).isin(*stop))


def rating_of_flags(*flags: str) -> Column:
    """Rating 1..5 from the mean of the flags that are set, halves to the even number; null without any."""
    there = F.array_compact(F.array(*[F.col(f).cast("int") for f in flags]))
    mean = F.aggregate(there, F.lit(0), lambda a, x: a + x) / F.size(there)
    return F.when(F.size(there) > 0, F.greatest(F.lit(1), F.least(F.lit(5), F.bround(1 + 4 * mean).cast("int"))))


def mean_pool(rows: DataFrame, group: str, vector: str, mask: str | None = None) -> DataFrame:
    """Mean of each group's vectors, scaled to length one: ``group, place`` (from 0), ``value``.

    Vectors whose ``mask`` is null or 0 do not count; a group without any has no rows, a zero mean stays
    zero. Sums are combined before their shuffle, so a group of any size leaves one row a place and task.
    """
    kept = rows.where(F.col(vector).isNotNull())
    kept = kept if mask is None else kept.where(F.coalesce(F.col(mask).cast("double"), F.lit(0.0)) != 0)
    mean = kept.select(F.col(group).alias("_g"), F.posexplode(vector).alias("place", "_v")).groupBy("_g", "place").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    norm = mean.groupBy(F.col("_g").alias("_of")).agg(F.sqrt(F.sum(F.col("_m") * F.col("_m"))).alias("_n"))
    return mean.join(norm, F.col("_g").eqNullSafe(F.col("_of"))).select(F.col("_g").alias(group), "place", F.when(F.col("_n") > 0, F.col("_m") / F.col("_n")).otherwise(F.col("_m")).alias("value"))
