"""Evaluation: ranking metrics, calibration, latency, agreement, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import evaluation as E
from ..operators import retrieval as R
from .queries_retrieval import _DENSE_SQL, _asked_vectors
from .registry import query, table

_REL = f"""WITH {_DENSE_SQL}, lab AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
  h AS (SELECT query_id, rank, (q.label = x.label)::INT AS rel, q.label, lab.n AS n_relevant FROM dense JOIN embeddings q ON q.vec_id = query_id JOIN embeddings x ON x.vec_id = doc_id JOIN lab ON lab.label = q.label WHERE rank <= 20),
  ideal AS (SELECT m, sum(1 / log2(i + 1)) AS best FROM range(1, 11) r(i), range(1, 11) s(m) WHERE i <= m GROUP BY m),
  m AS (SELECT query_id, label, round(sum(CASE WHEN rank <= 10 THEN rel END) / 10.0::DOUBLE, 6) AS "precision", round(sum(CASE WHEN rank <= 10 THEN rel END)::DOUBLE / n_relevant, 6) AS recall, max(CASE WHEN rank <= 10 THEN rel END) AS hit,
    round(coalesce(1.0::DOUBLE / min(CASE WHEN rel = 1 THEN rank END), 0), 6) AS reciprocal_rank, round(sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) END) / (SELECT best FROM ideal WHERE m = least(n_relevant, 10)), 6) AS ndcg FROM h GROUP BY query_id, label, n_relevant)"""


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the dense search, a hit being relevant that has the question's label."""
    v = table(spark, d, "embeddings")
    asked = _asked_vectors(spark, d)
    labels = v.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("dl"))
    of_query = labels.select(F.col("doc_id").alias("query_id"), F.col("dl").alias("label")).join(asked.select("query_id"), "query_id", "left_semi")
    hits = R.dense(v, asked, k=20).join(labels, "doc_id").join(of_query, "query_id").select("query_id", "rank", (F.col("dl") == F.col("label")).cast("int").alias("relevant"))
    n = v.groupBy("label").agg(F.count(F.lit(1)).alias("n_relevant"))
    return E.ranking_metrics(hits, of_query.join(F.broadcast(n), "label").select("query_id", "n_relevant"), 10).join(of_query, "query_id")


@query(_REL + ' SELECT query_id, "precision", recall, hit, reciprocal_rank, ndcg FROM m')
def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).drop("label")


@query(_REL + ', u AS (UNPIVOT (SELECT label, "precision"::DOUBLE AS "precision", recall::DOUBLE AS recall, hit::DOUBLE AS hit, reciprocal_rank, ndcg FROM m) ON "precision", recall, hit, reciprocal_rank, ndcg INTO NAME metric VALUE v) SELECT label, metric, count(*) AS n, round(avg(v), 6) AS mean, min(v) AS least, max(v) AS largest, round(stddev_pop(v), 6) AS deviation FROM u GROUP BY label, metric')
def metrics_by_type(spark: SparkSession, d: str) -> DataFrame:
    m = _metrics(spark, d).withColumn("hit", F.col("hit").cast("double"))
    return E.summary(m, ["precision", "recall", "hit", "reciprocal_rank", "ndcg"], ["label"])


_LABELLED = """j AS (SELECT t.outcome.confidence_score AS c, (f.h >= 0.5)::INT AS y, t.action.pipeline AS pipeline FROM response_trajectory t JOIN
  (SELECT lower(trim(question_id)) AS q, avg(was_helpful::INT) AS h FROM user_feedback WHERE was_helpful IS NOT NULL AND trim(question_id) <> '' GROUP BY 1) f ON lower(trim(t.response_id)) = f.q)"""


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of responses with whether most of their feedback found them helpful; the feedback is
    aggregated before the join."""
    f = table(spark, d, "user_feedback").where("was_helpful is not null and trim(question_id) <> ''").groupBy(F.lower(F.trim("question_id")).alias("q")).agg(F.avg(F.col("was_helpful").cast("int")).alias("h"))
    t = table(spark, d, "response_trajectory").select(F.lower(F.trim("response_id")).alias("q"), F.col("outcome.confidence_score").alias("c"), F.col("action.pipeline").alias("pipeline"), "response_id", "received_at")
    return t.join(f, "q").select("c", (F.col("h") >= 0.5).cast("int").alias("y"), "pipeline", F.concat_ws("|", "response_id", "received_at").alias("row_key"))


def _ece_sql(bin_: str) -> str:
    return f"""WITH {_LABELLED}, b AS (SELECT ({bin_})::INT AS bin, c, y FROM j WHERE c IS NOT NULL AND y IS NOT NULL), k AS (SELECT * FROM b WHERE bin >= 0 AND bin < 10)
      SELECT bin, count(*) AS n, round(avg(y), 6) AS accuracy, round(avg(c), 6) AS confidence, round(count(*)::DOUBLE / (SELECT count(*) FROM k) * abs(avg(y) - avg(c)), 6) AS part FROM k GROUP BY bin"""


@query(_ece_sql("ceil(c * 10) - 1"))
def ece_right_closed(spark: SparkSession, d: str) -> DataFrame:
    return E.calibration_error(_labelled(spark, d), "c", "y", 10, True)


@query(_ece_sql("floor(c * 10)"))
def ece_left_closed(spark: SparkSession, d: str) -> DataFrame:
    return E.calibration_error(_labelled(spark, d), "c", "y", 10, False)


@query()
def platt_fit(spark: SparkSession, d: str) -> DataFrame:
    return E.platt(_labelled(spark, d), "c", "y").select(F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return E.bootstrap_interval(_labelled(spark, d).withColumn("y", F.col("y").cast("double")), "y", 400)


@query("""SELECT action.pipeline AS pipeline, count(outcome.latency_ms) AS n, round(avg(outcome.latency_ms), 4) AS mean, round(quantile_cont(outcome.latency_ms, 0.5), 4) AS p50, round(quantile_cont(outcome.latency_ms, 0.95), 4) AS p95, round(quantile_cont(outcome.latency_ms, 0.99), 4) AS p99, min(outcome.latency_ms) AS least, max(outcome.latency_ms) AS largest FROM response_trajectory GROUP BY 1""")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "response_trajectory").select(F.col("action.pipeline").alias("pipeline"), F.col("outcome.latency_ms").alias("ms"))
    plain = t.groupBy("pipeline").agg(F.count("ms").alias("n"), F.round(F.avg("ms"), 4).alias("mean"), F.min("ms").alias("least"), F.max("ms").alias("largest"))
    p = E.percentiles(t, "pipeline", "ms", (0.5, 0.95, 0.99)).withColumnRenamed("pipeline", "_p")
    return plain.join(p, F.col("pipeline").eqNullSafe(F.col("_p")), "left").select("pipeline", "n", "mean", *(F.round(F.col("p")[i], 4).alias(c) for i, c in enumerate(("p50", "p95", "p99"))), "least", "largest")


@query("""SELECT pipeline, ms AS p90 FROM (SELECT action.pipeline AS pipeline, outcome.latency_ms AS ms, row_number() OVER (PARTITION BY action.pipeline ORDER BY outcome.latency_ms) AS r, count(*) OVER (PARTITION BY action.pipeline) AS n FROM response_trajectory WHERE outcome.latency_ms IS NOT NULL) WHERE r = floor(0.9 * n)::INT + 1""")
def latency_p90_index(spark: SparkSession, d: str) -> DataFrame:
    """The ninth decile without interpolation, from counts by range and then by value."""
    t = table(spark, d, "response_trajectory").select(F.col("action.pipeline").alias("pipeline"), F.col("outcome.latency_ms").alias("ms"))
    return E.values_at(t, "pipeline", "ms", lambda n: [(F.floor(n * 0.9) + 1).cast("long")]).select("pipeline", F.col("value").alias("p90"))


@query("""SELECT least(floor(outcome.confidence_score * 20), 19)::INT AS bin, count(*) AS n, round(avg(outcome.confidence_score), 6) AS mean FROM response_trajectory WHERE outcome.confidence_score IS NOT NULL GROUP BY 1""")
def confidence_histogram(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("outcome.confidence_score")
    return table(spark, d, "response_trajectory").select(c.alias("c")).where("c is not null").groupBy(F.least(F.floor(F.col("c") * 20), F.lit(19)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 6).alias("mean"))


@query("""WITH p AS (SELECT was_helpful AS a, was_accurate AS b FROM user_feedback WHERE was_helpful IS NOT NULL AND was_accurate IS NOT NULL),
  s AS (SELECT count(*) AS n, avg((a = b)::INT) AS po, avg(a::INT) AS pa, avg(b::INT) AS pb FROM p)
  SELECT n, round(po, 6) AS agreement, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa FROM s""")
def cohen_kappa(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the two judgements of each feedback."""
    return E.kappa(table(spark, d, "user_feedback"), "was_helpful", "was_accurate")


_KEYWORDS = """k AS (SELECT id, response, list_distinct(regexp_extract_all(lower(coalesce(reference, '')), '([a-z]{6,})', 1)) AS k FROM ragas_standard_tinyllama_10)"""


def _keywords() -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col("reference"), F.lit(""))), F.lit("([a-z]{6,})"), F.lit(1)))


@query(f"""WITH {_KEYWORDS} SELECT id, round(CASE WHEN len(k) = 0 THEN 1.0 ELSE len(list_filter(k, lambda x: contains(lower(coalesce(response, '')), x)))::DOUBLE / len(k) END, 6) AS coverage FROM k""")
def keyword_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of the reference's longer words that the response contains."""
    return table(spark, d, "ragas_standard_tinyllama_10").select("id", F.round(E.keyword_coverage(F.col("response"), _keywords()), 6).alias("coverage"))


@query(rf"""WITH {_KEYWORDS} SELECT id, round(CASE WHEN len(k) = 0 THEN 1.0 ELSE len(list_filter(k, lambda x: regexp_matches(lower(coalesce(response, '')), '(^|[^\p{{L}}\p{{N}}_])' || x || '([^\p{{L}}\p{{N}}_]|$)')))::DOUBLE / len(k) END, 6) AS coverage FROM k""")
def keyword_words(spark: SparkSession, d: str) -> DataFrame:
    """The same, as whole words."""
    return table(spark, d, "ragas_standard_tinyllama_10").select("id", F.round(E.keyword_words(F.col("response"), _keywords()), 6).alias("coverage"))


@query("""UNPIVOT (SELECT context_precision, context_recall, rouge_fmeasure, exact_match FROM ragas_standard_tinyllama_10) ON * INTO NAME metric VALUE v""".join(("WITH u AS (", ") SELECT metric, count(v) AS n, round(avg(v), 6) AS mean, min(v) AS least, max(v) AS largest, round(stddev_pop(v), 6) AS deviation FROM u WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY metric")))
def ragas_summary(spark: SparkSession, d: str) -> DataFrame:
    names = ["context_precision", "context_recall", "rouge_fmeasure", "exact_match"]
    r = table(spark, d, "ragas_standard_tinyllama_10")
    return E.summary(r.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) for c in names)), names)


@query()
def rouge_l(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "ragas_standard_tinyllama_10")
    return r.select("id", E.rouge_l(F.col("response"), F.col("reference")).alias("rouge_l"), F.round("rouge_fmeasure", 6).alias("given"))


@query(r"""WITH w AS (SELECT pair_id, list_distinct(list_filter(string_split_regex(lower(answer), '\s+'), lambda x: x <> '')) AS a, list_filter(string_split_regex(lower(coalesce(context, '')), '\s+'), lambda x: x <> '') AS c FROM qa_pair WHERE answer IS NOT NULL)
  SELECT pair_id, round(len(list_filter(a, lambda x: list_contains(c, x)))::DOUBLE / len(a), 6) AS faithfulness FROM w WHERE len(a) > 0""")
def faithfulness(spark: SparkSession, d: str) -> DataFrame:
    """Share of an answer's distinct words that its context has."""
    q = table(spark, d, "qa_pair").where("answer is not null")
    return q.select("pair_id", F.round(E.overlap_share(words(F.lower("answer")), words(F.lower("context"))), 6).alias("faithfulness")).where("faithfulness is not null")


@query(r"""WITH w AS (SELECT chunk_pk, unnest(regexp_extract_all(lower(content), '([a-z]{4,})', 1)) AS word, generate_subscripts(regexp_extract_all(lower(content), '([a-z]{4,})', 1), 1) AS pos FROM kb_chunk WHERE content IS NOT NULL),
  c AS (SELECT chunk_pk, word, count(*) AS n, min(pos) AS f FROM w GROUP BY 1, 2)
  SELECT chunk_pk, word, n, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY chunk_pk ORDER BY n DESC, f) AS place FROM c) WHERE place <= 20""")
def word_frequency(spark: SparkSession, d: str) -> DataFrame:
    """The twenty most frequent longer words of each chunk."""
    return E.frequent_words(table(spark, d, "kb_chunk"), "chunk_pk", "content", 20)


@query("""WITH t AS (SELECT source, category, reference_answer FROM test_set_eval30 UNION ALL SELECT source_dataset, category, reference FROM ragas_standard_tinyllama_10)
  SELECT source, coalesce(category, 'none') AS category, count(*) AS n, count(reference_answer) AS answered, round(avg(length(reference_answer)), 6) AS characters FROM t GROUP BY CUBE (source, coalesce(category, 'none'))""")
def test_set_profile(spark: SparkSession, d: str) -> DataFrame:
    """Held-out items and judged answers by source and category."""
    judged = table(spark, d, "ragas_standard_tinyllama_10").select(F.col("source_dataset").alias("source"), "category", F.col("reference").alias("reference_answer"))
    t = table(spark, d, "test_set_eval30").select("source", "category", "reference_answer").unionByName(judged).withColumn("category", F.coalesce("category", F.lit("none")))
    return t.cube("source", "category").agg(F.count(F.lit(1)).alias("n"), F.count("reference_answer").alias("answered"), F.round(F.avg(F.length("reference_answer")), 6).alias("characters"))


@query("""SELECT 'helpful' AS flag, count(*) AS n, round(corr(rating, was_helpful::INT), 6) AS r FROM user_feedback WHERE rating IS NOT NULL AND was_helpful IS NOT NULL
  UNION ALL SELECT 'accurate', count(*), round(corr(rating, was_accurate::INT), 6) FROM user_feedback WHERE rating IS NOT NULL AND was_accurate IS NOT NULL
  UNION ALL SELECT 'safe', count(*), round(corr(rating, was_safe::INT), 6) FROM user_feedback WHERE rating IS NOT NULL AND was_safe IS NOT NULL""")
def rating_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Pearson's r of the rating and each flag, in one pass."""
    f = table(spark, d, "user_feedback").select("rating", F.explode(F.create_map(F.lit("helpful"), "was_helpful", F.lit("accurate"), "was_accurate", F.lit("safe"), "was_safe")).alias("flag", "v")).where("rating is not null and v is not null")
    return f.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr(F.col("rating").cast("double"), F.col("v").cast("double")), 6).alias("r"))
