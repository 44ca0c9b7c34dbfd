"""Scores and gates over answers and trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring as C
from ..operators.evaluation import overlap_share
from .registry import query, table

# The SQL states the constants for itself.
_STOP = """string_split('a an the is are was were be been being have has had do does did will would could should may might shall must can of in on at to for by with from into this that these those it its and or but so yet he she they we you i me him her us his their our your my what which who whom when where why how all any both each few more most other some such only same than too very just also about above after before between during through over under again then here there once if as up out because while aren''t won''t', ' ')"""
_DENY = """string_split('not no never neither nor cannot can''t don''t doesn''t isn''t aren''t won''t without', ' ')"""


def _terms(col: str) -> str:
    return rf"list_filter(list_distinct(string_split_regex(lower(coalesce({col}, '')), '\s+')), lambda x: length(x) > 3 AND NOT list_contains({_STOP}, x))"


def _parts(col: str) -> str:
    return rf"string_split(regexp_replace({col}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


@query("""WITH s AS (SELECT response_id, received_at, retrieval.scores AS s FROM response_trajectory)
  SELECT response_id, received_at, round(CASE WHEN coalesce(len(s), 0) = 0 THEN 0 ELSE greatest(0, least(1, 0.3 * s[1] + 0.2 * list_avg(s) + 0.25 * (CASE WHEN len(s) > 1 THEN greatest(0, least(1, s[1] - s[-1])) ELSE 0.5 END) + 0.25 * len(list_filter(s, lambda x: x > 0.5)) / len(s))) END, 6) AS confidence FROM s""")
def retrieval_confidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "response_trajectory").select("response_id", "received_at", F.round(C.retrieval_confidence(F.col("retrieval.scores")), 6).alias("confidence"))


@query("""WITH s AS (SELECT response_id, received_at, 0.4::DOUBLE * retrieval.mean_score + 0.6::DOUBLE * retrieval.max_score AS score FROM response_trajectory)
  SELECT response_id, received_at, round(score, 6) AS score, CASE WHEN score >= 0.65::DOUBLE THEN 'high' WHEN score >= 0.35::DOUBLE THEN 'medium' ELSE 'low' END AS level FROM s""")
def fast_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Score and level from the mean and the best score."""
    score, level = C.fast_confidence(F.col("retrieval.mean_score"), F.col("retrieval.max_score"))
    return table(spark, d, "response_trajectory").select("response_id", "received_at", score.alias("score"), level.alias("level"))


@query("""SELECT action.pipeline AS pipeline, count(*) AS n, count(CASE WHEN len(list_filter(retrieval.scores, lambda x: x >= greatest(0.01, 0.5 * list_max(retrieval.scores)))) > 0 THEN 1 END) AS answerable, sum(coalesce(len(list_filter(retrieval.scores, lambda x: x >= greatest(0.01, 0.5 * list_max(retrieval.scores)))), 0))::BIGINT AS kept FROM response_trajectory GROUP BY 1""")
def answerability_gate(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "response_trajectory").select(F.col("action.pipeline").alias("pipeline"), C.answerable(F.col("retrieval.scores")).alias("kept"))
    return t.groupBy("pipeline").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kept") > 0).alias("answerable"), F.sum("kept").alias("kept"))


@query("""SELECT response_id, received_at, coalesce(len(retrieval.scores), 0)::INT AS n, round(coalesce(retrieval.scores[1], 0), 6) AS top, round(coalesce(list_avg(retrieval.scores), 0), 6) AS mean, round(coalesce(list_min(retrieval.scores), 0), 6) AS least, round(coalesce(list_max(retrieval.scores), 0), 6) AS largest FROM response_trajectory""")
def score_stats(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("retrieval.scores")
    z = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    mean = F.when(F.size(s) > 0, F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s))
    return table(spark, d, "response_trajectory").select("response_id", "received_at", F.greatest(F.lit(0), F.coalesce(F.size(s), F.lit(0))).alias("n"), z(F.try_element_at(s, F.lit(1))).alias("top"), z(mean).alias("mean"), z(F.array_min(s)).alias("least"), z(F.array_max(s)).alias("largest"))


@query(f"""WITH t AS (SELECT pair_id, {_terms('answer')} AS t, lower(coalesce(context, '')) AS c FROM qa_pair WHERE answer IS NOT NULL)
  SELECT pair_id, round(len(list_filter(t, lambda x: contains(c, x)))::DOUBLE / len(t), 6) AS grounding FROM t WHERE len(t) > 0""")
def grounding(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "qa_pair").where("answer is not null")
    return q.select("pair_id", F.round(C.grounding(F.col("answer"), F.col("context")), 6).alias("grounding")).where("grounding is not null")


@query(f"""WITH t AS (SELECT id, {_terms('response')} AS a, {_terms('reference')} AS b FROM ragas_standard_tinyllama_10), o AS (SELECT id, len(list_filter(a, lambda x: list_contains(b, x)))::DOUBLE / len(a) AS o FROM t WHERE len(a) > 0)
  SELECT count(*) AS n, round(avg(o), 6) AS overlap, count(CASE WHEN o > 0.15 THEN 1 END) AS agreeing FROM o""")
def source_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Answers that share more than a sixth of their terms with the reference."""
    r = table(spark, d, "ragas_standard_tinyllama_10").select(overlap_share(C.key_terms(F.col("response")), C.key_terms(F.col("reference"))).alias("o")).where("o is not null")
    return r.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o"), 6).alias("overlap"), F.count_if(F.col("o") > 0.15).alias("agreeing"))


_CLAIMS = f"""q AS (SELECT pair_id, list_filter({_parts('trim(answer)')}, lambda x: length(x) >= 20) AS cs, list_filter({_parts("trim(coalesce(context, ''))")}, lambda x: length(x) >= 20) AS es FROM qa_pair WHERE answer IS NOT NULL),
  c AS (SELECT pair_id, es, unnest(cs) AS claim, (generate_subscripts(cs, 1) - 1)::INT AS claim_no FROM q),
  t AS (SELECT *, {_terms('claim')} AS ct FROM c),
  e AS (SELECT pair_id, claim_no, unnest(es) AS evidence, generate_subscripts(es, 1) AS k, ct FROM t),
  o AS (SELECT *, CASE WHEN len(ct) = 0 THEN 0.0 ELSE round(len(list_intersect(ct, {_terms('evidence')}))::DOUBLE / len(ct), 6) END AS overlap FROM e),
  b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY pair_id, claim_no ORDER BY overlap DESC, k) = 1),
  a AS (SELECT t.pair_id, t.claim_no, t.claim, b.evidence, coalesce(b.overlap, 0.0) AS overlap, coalesce(b.overlap, 0.0) >= 0.3 AS supported FROM t LEFT JOIN b USING (pair_id, claim_no))"""


@query(f"WITH {_CLAIMS} SELECT * FROM a")
def attribution(spark: SparkSession, d: str) -> DataFrame:
    return C.attribution(table(spark, d, "qa_pair"), "pair_id", "answer", "context")


@query(f"WITH {_CLAIMS} SELECT pair_id, count(*) AS claims, round(avg(supported::INT), 6) AS coverage FROM a GROUP BY pair_id")
def attribution_coverage(spark: SparkSession, d: str) -> DataFrame:
    return C.coverage(attribution(spark, d), "pair_id")


@query(f"""WITH p AS (SELECT pair_id, {_parts('answer')} AS p FROM qa_pair WHERE answer IS NOT NULL),
  s AS (SELECT pair_id, unnest(p) AS s, (generate_subscripts(p, 1) - 1)::INT AS i FROM p),
  t AS (SELECT *, {_terms('s')} AS t, len(list_intersect(string_split_regex(lower(s), '\\s+'), {_DENY})) > 0 AS no FROM s),
  o AS (SELECT a.pair_id, a.i, b.i AS j, a.s AS first, b.s AS second, len(list_intersect(a.t, b.t))::DOUBLE / greatest(1, len(a.t), len(b.t)) AS o FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.i < b.i AND a.no <> b.no)
  SELECT pair_id, i, j, first, second, round(o, 6) AS overlap FROM o WHERE o > 0.5""")
def contradictions(spark: SparkSession, d: str) -> DataFrame:
    return C.contradictions(table(spark, d, "qa_pair"), "pair_id", "answer")


@query(f"""WITH q AS (SELECT pair_id, {_terms('question')} AS qt, list_filter({_parts('trim(context)')}, lambda x: length(x) >= 20) AS p FROM qa_pair WHERE question IS NOT NULL AND context IS NOT NULL),
  s AS (SELECT pair_id, qt, unnest(p) AS s, generate_subscripts(p, 1) AS k FROM q),
  v AS (SELECT *, round((CASE WHEN len(qt) = 0 THEN 0.0 ELSE len(list_intersect(qt, {_terms('s')}))::DOUBLE / len(qt) END) + least(1.0, length(s) / 200.0::DOUBLE), 6) AS v FROM s),
  r AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY v DESC, k) <= 5)
  SELECT pair_id, string_agg(s, ' ' ORDER BY k) AS context, count(*) AS kept FROM r GROUP BY pair_id""")
def compressed_context(spark: SparkSession, d: str) -> DataFrame:
    return C.compress(table(spark, d, "qa_pair").where("question is not null"), "pair_id", "question", "context")


_SPANS = """s AS (SELECT user_id, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + 3600 AS b FROM events WHERE event_type = 'error')"""


@query(f"""WITH {_SPANS}, n AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM s), k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM n)
  SELECT user_id, min(a) AS start, max(b) AS "end", count(*) AS parts FROM k GROUP BY user_id, i""")
def span_merge(spark: SparkSession, d: str) -> DataFrame:
    """Hours after errors of a user, merged where they meet."""
    e = table(spark, d, "events").where("event_type = 'error'").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long").alias("a")).withColumn("b", F.col("a") + 3600)
    return C.merge_spans(e, "user_id", "a", "b")
