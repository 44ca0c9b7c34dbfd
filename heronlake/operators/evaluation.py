"""Evaluation analytics over ranked hits, scores and judgements."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import cut

#: Range buckets of a percentile; the one that holds the wanted place is looked at value by value.
BUCKETS = 4096


def values_at(values: DataFrame, group: str, value: str, places: Callable[[Column], list[Column]]) -> DataFrame:
    """The values at given places (from 1) in the order of each group: ``group, place_no, value``.

    ``places`` gives the wanted places from a group's count. Values are counted by ranges of equal
    width between a group's least and largest; running counts over the ranges tell which ones hold a
    wanted place, and only the values of those are counted one by one. Heavy groups stay spread
    over tasks, and no task holds a group's values.
    """
    v = cut(values.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")))
    ends = v.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
    # groups are few; a join by broadcast is left to the optimiser, which knows their size
    placed = v.join(ends.withColumnRenamed("g", "g2"), F.col("g").eqNullSafe(F.col("g2"))).select("g", "v", F.least(F.lit(BUCKETS - 1), F.floor(width * BUCKETS)).cast("int").alias("b"))
    counts = placed.groupBy("g", "b").agg(F.count(F.lit(1)).alias("c"))
    before = (F.sum("c").over(Window.partitionBy("g").orderBy("b")) - F.col("c")).alias("before")  # at most BUCKETS rows of a group
    wanted = ends.select(F.col("g").alias("g2"), F.posexplode(F.array(*places(F.col("n")))).alias("place_no", "place"))
    held = counts.select("g", "b", "c", before).join(wanted, F.col("g").eqNullSafe(F.col("g2"))).where((F.col("before") < F.col("place")) & (F.col("before") + F.col("c") >= F.col("place"))).select(F.col("g").alias("g2"), F.col("b").alias("b2"), "before", "place_no", "place")
    inside = placed.join(held, F.col("g").eqNullSafe(F.col("g2")) & (F.col("b") == F.col("b2"))).groupBy("g", "place_no", "place", "before", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("g", "place_no").orderBy("v"))
    return inside.withColumn("upto", upto).where((F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("c") < F.col("place"))).select(F.col("g").alias(group), "place_no", F.col("v").alias("value"))


def percentiles(values: DataFrame, group: str, value: str, shares: Sequence[float]) -> DataFrame:
    """Interpolated percentiles of each group: ``group`` and an array ``p`` in the order of ``shares``."""
    at = [lambda n, q=q: (n - 1) * q for q in shares]
    both = lambda n: [x for f in at for x in (F.floor(f(n)).cast("long") + 1, F.ceil(f(n)).cast("long") + 1)]
    sizes = values.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("_of")).agg(F.count(F.lit(1)).alias("n"))
    found = values_at(values, group, value, both).groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("place_no", "value"))).alias("m"))
    weight = lambda i: at[i](F.col("n")) - F.floor(at[i](F.col("n")))
    each = [F.col("m")[2 * i] + (F.col("m")[2 * i + 1] - F.col("m")[2 * i]) * weight(i) for i in range(len(at))]
    return found.join(sizes, F.col(group).eqNullSafe(F.col("_of"))).select(group, F.array(*each).alias("p"))


def ranking_metrics(hits: DataFrame, relevant: DataFrame, k: int = 10, empty: float | None = 0.0) -> DataFrame:
    """Per query: precision, recall, hit, reciprocal rank and NDCG at ``k``.

    ``hits``: ``query_id, rank, relevant`` (0/1); ``relevant``: ``query_id, n_relevant``. ``empty`` is
    the recall where nothing is relevant (None: left out of means).
    """
    top = hits.where(F.col("rank") <= k)
    gain = F.col("relevant") / F.log2(F.col("rank") + 1)
    by = top.groupBy("query_id").agg(F.sum("relevant").alias("found"), F.max("relevant").alias("hit"), F.sum(gain).alias("dcg"))
    first = hits.where("relevant = 1").groupBy("query_id").agg(F.min("rank").alias("first"))
    n = F.least(F.col("n_relevant"), F.lit(k))
    ideal = F.element_at(F.array(*[F.lit(sum(1 / math.log2(i + 1) for i in range(1, m + 1))) for m in range(k + 1)]), (n + 1).cast("int"))
    none = F.lit(empty).cast("double")
    return (
        relevant.join(by, "query_id", "left").join(first, "query_id", "left")
        .select(
            "query_id", F.round(F.coalesce("found", F.lit(0)) / k, 6).alias("precision"), F.round(F.when(F.col("n_relevant") > 0, F.coalesce("found", F.lit(0)) / F.col("n_relevant")).otherwise(none), 6).alias("recall"),
            F.coalesce("hit", F.lit(0)).alias("hit"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"), F.round(F.when(F.col("n_relevant") > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(F.lit(0.0)), 6).alias("ndcg"),
        )
    )


def summary(metrics: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """Long table of mean, least, largest and population deviation of each metric."""
    long = metrics.unpivot(by or [], names, "metric", "value")
    return long.groupBy(*(by or []), "metric").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("largest"), F.round(F.stddev_pop("value"), 6).alias("deviation"))


def calibration_error(scored: DataFrame, score: str, label: str, bins: int = 10, right_closed: bool = True) -> DataFrame:
    """Bins of a score with count, accuracy, mean score and share of the calibration error.

    Bins are (lo, hi], which leaves out 0, or [lo, hi), which leaves out 1. Ten rows at most.
    """
    x = F.col(score) * bins
    b = (F.ceil(x) - 1 if right_closed else F.floor(x)).cast("int")
    d = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumn("bin", b).where((F.col("bin") >= 0) & (F.col("bin") < bins))
    by = d.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("accuracy"), F.avg(score).alias("confidence"))
    total = by.agg(F.sum("n").alias("all_n"))
    return by.crossJoin(F.broadcast(total)).select("bin", "n", F.round("accuracy", 6).alias("accuracy"), F.round("confidence", 6).alias("confidence"), F.round(F.col("n") / F.col("all_n") * F.abs(F.col("accuracy") - F.col("confidence")), 6).alias("part"))


def kappa(pairs: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Cohen's kappa of two judgements, from their contingency counts."""
    by = by or []
    d = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    cells = d.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    marks = cells.select(*by, F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("v")), F.struct(F.lit("b").alias("side"), F.col("b").alias("v")))).alias("m"), "n")
    margin = marks.groupBy(*by, F.col("m.v").alias("v")).agg(F.sum(F.when(F.col("m.side") == "a", F.col("n")).otherwise(0)).alias("na"), F.sum(F.when(F.col("m.side") == "b", F.col("n")).otherwise(0)).alias("nb"))
    agree = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    chance = margin.groupBy(*by).agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("cross"))
    both = agree.join(chance, by) if by else agree.crossJoin(chance)
    po, pe = F.col("same") / F.col("n"), F.col("cross") / (F.col("n").cast("double") * F.col("n"))
    return both.select(*by, "n", F.round(po, 6).alias("agreement"), F.round(F.when(pe == 1, F.lit(1.0)).otherwise((po - pe) / (1 - pe)), 6).alias("kappa"))


def keyword_coverage(text: Column, keywords: Column) -> Column:
    """Share of keywords that the text contains, in any case; 1 without keywords."""
    n = F.size(keywords)
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.coalesce(n, F.lit(0)) <= 0, F.lit(1.0)).otherwise(F.size(F.filter(keywords, lambda k: F.contains(low, F.lower(k)))) / n)


def keyword_words(text: Column, keywords: Column) -> Column:
    """Share of keywords that stand in the text as whole words, in any case; 1 without keywords."""
    n = F.size(keywords)
    low = F.lower(F.coalesce(text, F.lit("")))
    pattern = lambda k: F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), F.regexp_replace(F.lower(k), r"([^\p{L}\p{N}_ ])", r"\\$1"), F.lit(r"(?![\p{L}\p{N}_])"))
    return F.when(F.coalesce(n, F.lit(0)) <= 0, F.lit(1.0)).otherwise(F.size(F.filter(keywords, lambda k: F.regexp_like(low, pattern(k)))) / n)


def ndcg_of_retrieved(hits: DataFrame, k: int = 10) -> DataFrame:
    """NDCG with gains 2^r - 1 and the ideal order of the hits themselves: ``query_id, ndcg``.

    ``hits``: ``query_id, rank, grade``; at most ``k`` of a query are looked at.
    """
    top = hits.where(F.col("rank") <= k)
    best = top.withColumn("_ideal", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "rank")))
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    by = best.groupBy("query_id").agg(F.sum(gain / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(gain / F.log2(F.col("_ideal") + 1)).alias("ideal"))
    return by.select("query_id", F.round(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(F.lit(0.0)), 6).alias("ndcg"))


def overlap_share(a: Column, b: Column) -> Column:
    """Share of the distinct words of ``a`` that ``b`` has; null where ``a`` has none."""
    d = F.array_distinct(a)
    return F.when(F.size(d) > 0, F.size(F.array_intersect(d, b)) / F.size(d))


def platt(scored: DataFrame, score: str, label: str, rounds: int = 25) -> DataFrame:
    """Two-parameter logistic fit by Newton steps; each step is one aggregation over all rows."""
    d = cut(scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(score).cast("double").alias("x"), F.col(label).cast("double").alias("y")))  # what leads to it runs once
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.lit(a) * F.col("x") + F.lit(b))))
        w = p * (1 - p)
        r = d.agg(F.sum((F.col("y") - p) * F.col("x")).alias("ga"), F.sum(F.col("y") - p).alias("gb"), F.sum(w * F.col("x") * F.col("x")).alias("haa"), F.sum(w * F.col("x")).alias("hab"), F.sum(w).alias("hbb")).first()
        if r.hbb is None:
            break
        det = r.haa * r.hbb - r.hab * r.hab
        if abs(det) < 1e-12:
            break
        da, db = (r.hbb * r.ga - r.hab * r.gb) / det, (r.haa * r.gb - r.hab * r.ga) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-9:
            break
    return scored.sparkSession.createDataFrame([(a, b)], "a double, b double")


def bootstrap_interval(values: DataFrame, value: str, replicates: int = 1000, seed: int = 42, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Mean with a percentile interval from Poisson resampling: each row draws its weight in every
    replicate from a hash of its key, so that replicates are sums and nothing is collected.

    ``values``: ``row_key`` and the value. One row out; an empty table gives nulls.
    """
    d = values.where(F.col(value).isNotNull()).select(F.xxhash64(F.col("row_key").cast("string"), F.lit(seed)).alias("k"), F.col(value).cast("double").alias("v"))
    below = np.cumsum([math.exp(-1.0) / math.factorial(i) for i in range(16)])[:-1]

    def draw(batches):
        sums, weights = np.zeros(replicates), np.zeros(replicates)
        turn = np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for pdf in batches:
            keys, v = pdf.k.to_numpy().astype(np.uint64), pdf.v.to_numpy()
            for i in range(0, len(keys), 512):  # a block of rows by all replicates
                z = keys[i : i + 512, None] + turn
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
                w = np.searchsorted(below, ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53).astype(float)
                sums += v[i : i + 512] @ w
                weights += w.sum(axis=0)
        yield pd.DataFrame({"r": range(replicates), "s": sums, "w": weights})

    per = d.mapInPandas(draw, T.StructType([T.StructField("r", T.IntegerType()), T.StructField("s", T.DoubleType()), T.StructField("w", T.DoubleType())])).groupBy("r").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    means = per.where("w > 0").select((F.col("s") / F.col("w")).alias("m"))
    return d.agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean")).crossJoin(means.agg(F.round(F.percentile("m", F.lit(low)), 6).alias("low"), F.round(F.percentile("m", F.lit(high)), 6).alias("high")))


@F.pandas_udf(T.DoubleType())
def rouge_l(answer: pd.Series, reference: pd.Series) -> pd.Series:
    """F-measure of the longest common subsequence of words."""

    def one(a: str | None, b: str | None) -> float:
        x, y = (a or "").lower().split(), (b or "").lower().split()
        if not x or not y:
            return 0.0
        row = [0] * (len(y) + 1)
        for w in x:
            last = 0
            for j, v in enumerate(y, 1):
                last, row[j] = row[j], last + 1 if w == v else max(row[j], row[j - 1])
        n = row[-1]
        return 0.0 if not n else round(2 * n / (len(x) + len(y)), 6)

    return pd.Series([one(a, b) for a, b in zip(answer, reference)])


def frequent_words(texts: DataFrame, key: str, text: str, n: int = 20, least: int = 4) -> DataFrame:
    """The ``n`` most frequent words of at least ``least`` letters of each row, by first place on ties."""
    w = texts.where(F.col(text).isNotNull()).select(key, F.posexplode(F.regexp_extract_all(F.lower(text), F.lit(f"([a-z]{{{least},}})"), F.lit(1))).alias("pos", "word"))
    c = w.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first"))).where(F.col("place") <= n).drop("first")
