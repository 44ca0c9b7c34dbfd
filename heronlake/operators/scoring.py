"""Answer scoring: gates, confidence, grounding, attribution, contradictions, spans, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import CAUSE_MARKERS, CAUSE_QUESTIONS, CITATIONS
from .evaluation import overlap_share

# Words that carry no content in overlap tests; words of denial are none of them.
STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "must", "can",
    "of", "in", "on", "at", "to", "for", "by", "with", "from", "into",
    "this", "that", "these", "those", "it", "its",
    "and", "or", "but", "so", "yet",
    "he", "she", "they", "we", "you", "i", "me", "him", "her", "us",
    "his", "their", "our", "your", "my",
    "what", "which", "who", "whom", "when", "where", "why", "how",
    "all", "any", "both", "each", "few", "more", "most", "other",
    "some", "such", "only", "same", "than", "too", "very",
    "just", "also", "about", "above", "after", "before", "between",
    "during", "through", "over", "under", "again", "then", "here",
    "there", "once", "if", "as", "up", "out", "because", "while",
    "aren't", "won't",
)
# Words of denial, as they stand between blanks.
DENIALS = ("not", "no", "never", "neither", "nor", "cannot", "can't", "don't", "doesn't", "isn't", "aren't", "won't", "without")


def key_terms(text: Column) -> Column:
    """Distinct words between blanks, in small letters, of more than three characters that are no stop words."""
    w = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: F.length(x) > 3)
    return F.array_except(F.array_distinct(w), F.array(*[F.lit(s) for s in STOP_WORDS]))


def grounding(answer: Column, context: Column) -> Column:
    """Share of the answer's key terms that the context contains; null without key terms."""
    t = key_terms(answer)
    return F.when(F.size(t) > 0, F.size(F.filter(t, lambda w: F.contains(F.lower(F.coalesce(context, F.lit(""))), w))) / F.size(t))


def retrieval_confidence(scores: Column) -> Column:
    """Weighted sum of the first score, the mean, the drop to the last and the share above one half."""
    n = F.size(scores)
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / n
    first, last = F.element_at(scores, 1), F.element_at(scores, -1)
    drop = F.when(n > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), first - last))).otherwise(F.lit(0.5))
    above = F.size(F.filter(scores, lambda x: x > 0.5)) / n
    return F.when(F.coalesce(n, F.lit(0)) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.3 * first + 0.2 * mean + 0.25 * drop + 0.25 * above))).otherwise(F.lit(0.0))


def fast_confidence(mean: Column, top: Column) -> tuple[Column, Column]:
    """Score to six places, and the level of the unrounded score; without scores the level is low."""
    score = 0.4 * mean + 0.6 * top
    return F.round(score, 6), F.when(score >= 0.65, "high").when(score >= 0.35, "medium").otherwise("low")


def answerable(scores: Column, floor: float = 0.01) -> Column:
    """Number of scores at or above half of the best and the floor."""
    limit = F.greatest(F.lit(floor), 0.5 * F.array_max(scores))
    return F.coalesce(F.size(F.filter(scores, lambda x: x >= limit)), F.lit(0))


def answerable_hits(hits: DataFrame, questions: DataFrame, text: str, floor: float = 0.01, ratio: float = 0.5, covered: float = 0.3, least: int = 1) -> DataFrame:
    """Whether each question can be answered from its hits: ``query_id, kept, covering, answerable``.

    ``hits``: ``query_id, score`` and the text; a hit is kept at or above the floor and ``ratio`` of the
    best score; at least ``least`` of them, and one that has ``covered`` of the question's words of
    more than three letters, make it answerable. Questions without such words need no cover; a question
    after a cause needs a kept hit that speaks of one.
    """
    words = lambda c: F.filter(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))), lambda x: F.length(x) > 3)
    asked = questions.select("query_id", F.array_except(words(F.col("query")), F.array(*[F.lit(w) for w in (*STOP_WORDS, *DENIALS)])).alias("q"))
    top = hits.groupBy("query_id").agg(F.max("score").alias("top"))
    kept = hits.join(top, "query_id").where(F.col("score") >= F.greatest(F.lit(floor), ratio * F.col("top")))
    cover = F.when(F.size("q") > 0, F.size(F.array_intersect("q", words(F.col(text)))) / F.size("q")).otherwise(F.lit(1.0))
    has = lambda c, parts: F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(F.lower(F.coalesce(c, F.lit(""))), p))
    by = kept.join(asked, "query_id").groupBy("query_id").agg(F.count(F.lit(1)).alias("kept"), F.count_if(cover >= covered).alias("covering"), F.max(has(F.col(text), CAUSE_MARKERS)).alias("causal"))
    told = ~has(F.col("query"), CAUSE_QUESTIONS) | F.coalesce("causal", F.lit(False))
    z = lambda c: F.coalesce(c, F.lit(0))
    return questions.select("query_id", "query").join(by, "query_id", "left").select("query_id", z("kept").alias("kept"), z("covering").alias("covering"), ((z("kept") >= least) & (z("covering") > 0) & told).alias("answerable"))


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: F.length(s) >= 20)


def attribution(answers: DataFrame, key: str, answer: str, context: str, least: float = 0.3) -> DataFrame:
    """Each sentence of an answer with the sentence of its context that shares most of its words.

    ``key, claim_no, claim, evidence, overlap, supported``; the pairs stay within one answer.
    """
    claims = answers.where(F.col(answer).isNotNull()).select(key, context, F.posexplode(sentences(F.col(answer))).alias("claim_no", "claim"))
    share = lambda e: F.coalesce(overlap_share(key_terms(F.col("claim")), key_terms(e)), F.lit(0.0))
    scored = F.transform(sentences(F.coalesce(F.col(context), F.lit(""))), lambda e, i: F.struct(F.round(share(e), 6).alias("overlap"), (-i).alias("before"), e.alias("evidence")))
    best = claims.withColumn("best", F.array_max(scored))
    return best.select(key, "claim_no", "claim", F.col("best.evidence").alias("evidence"), F.coalesce("best.overlap", F.lit(0.0)).alias("overlap"), (F.coalesce("best.overlap", F.lit(0.0)) >= least).alias("supported"))


def coverage(attributed: DataFrame, key: str) -> DataFrame:
    """Share of each answer's claims that are supported: ``key, claims, coverage``."""
    return attributed.groupBy(key).agg(F.count(F.lit(1)).alias("claims"), F.round(F.avg(F.col("supported").cast("double")), 6).alias("coverage"))


def contradictions(answers: DataFrame, key: str, answer: str, least: float = 0.5) -> DataFrame:
    """Pairs of sentences of one answer that share more than ``least`` of the larger set of key terms while
    only one of them denies. Sentences of any length count; the pairs are made within the row."""
    parts = F.transform(F.split(F.col(answer), r"(?<=[.!?])\s+"), lambda x: F.struct(x.alias("s"), key_terms(x).alias("t"), F.arrays_overlap(F.split(F.lower(x), r"\s+"), F.array(*[F.lit(w) for w in DENIALS])).alias("no")))
    s = answers.where(F.col(answer).isNotNull()).select(key, parts.alias("p")).where(F.size("p") > 1)
    s = s.select(key, "p", F.posexplode("p").alias("i", "a")).select(key, "i", "a", F.posexplode("p").alias("j", "b")).where((F.col("i") < F.col("j")) & (F.col("a.no") != F.col("b.no")))
    share = F.size(F.array_intersect("a.t", "b.t")) / F.greatest(F.lit(1), F.size("a.t"), F.size("b.t"))
    return s.withColumn("overlap", F.round(share, 6)).where(share > least).select(key, "i", "j", F.col("a.s").alias("first"), F.col("b.s").alias("second"), "overlap")


def unfounded_citations(answer: Column, context: Column) -> Column:
    """What an answer cites as a study, paper or number of one and its context does not contain, in any case."""
    cited = F.concat(*[F.regexp_extract_all(answer, F.lit(p), F.lit(0)) for p in CITATIONS])
    return F.filter(cited, lambda c: ~F.contains(F.lower(F.coalesce(context, F.lit(""))), F.lower(c)))


def merge_spans(spans: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Union of intervals that overlap or touch, within each key: ``key, start, end, parts``."""
    before = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce((F.col(start) > F.max(end).over(before)).cast("int"), F.lit(1))
    island = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    return spans.withColumn("_new", new).withColumn("_island", F.sum("_new").over(island)).groupBy(key, "_island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("parts")).drop("_island")


def compress(rows: DataFrame, key: str, question: str, text: str, keep: int = 5) -> DataFrame:
    """The ``keep`` sentences nearest to the question, in their order: ``key, context, kept``."""
    s = rows.where(F.col(text).isNotNull()).select(key, question, F.posexplode(sentences(F.col(text))).alias("pos", "s"))
    score = F.round(F.coalesce(overlap_share(key_terms(F.col(question)), key_terms(F.col("s"))), F.lit(0.0)) + F.least(F.lit(1.0), F.length("s") / 200), 6)
    order = Window.partitionBy(key).orderBy(F.desc("score"), "pos")
    kept = s.withColumn("score", score).withColumn("r", F.row_number().over(order)).where(F.col("r") <= keep)
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), " ").alias("context"), F.count(F.lit(1)).alias("kept"))
