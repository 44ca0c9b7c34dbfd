"""Matching, ablation, corrective retrieval, graded metrics and further reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fixed import SYNONYMS
from ..operators import evaluation, matching, retrieval, rewrite, scoring
from ..operators.evaluation import overlap_share
from ..streaming import feedback_stream as ST
from .queries_evaluation import _LABELLED
from .queries_retrieval import _DENSE_SQL, _asked_vectors, _titles, _type_sql
from .lineage import cut
from .registry import query, table

_NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query(rf"""WITH a AS (SELECT DISTINCT {_NORM.format('question')} AS t FROM response_trajectory WHERE question IS NOT NULL), b AS (SELECT DISTINCT {_NORM.format('question')} AS t FROM qa_pair WHERE question IS NOT NULL),
  aw AS (SELECT t, list_distinct(string_split(t, ' ')) AS w FROM a WHERE t <> ''), bw AS (SELECT t, list_distinct(string_split(t, ' ')) AS w FROM b WHERE t <> ''),
  ex AS (SELECT aw.t AS text, aw.t AS match, 1.0::DOUBLE AS similarity FROM aw JOIN bw USING (t)),
  p AS (SELECT aw.t AS text, bw.t AS match, len(list_intersect(aw.w, bw.w))::DOUBLE / (len(aw.w) + len(bw.w) - len(list_intersect(aw.w, bw.w))) AS s FROM aw, bw WHERE aw.t NOT IN (SELECT text FROM ex) AND len(aw.w) >= 0.75 * len(bw.w) AND len(bw.w) >= 0.75 * len(aw.w)),
  r AS (SELECT text, match, round(s, 6) AS similarity, row_number() OVER (PARTITION BY text ORDER BY round(s, 6) DESC, match) AS k FROM p WHERE s >= 0.75 - 1e-12)
  SELECT * FROM ex UNION ALL SELECT text, match, similarity FROM r WHERE k = 1""")
def question_match(spark: SparkSession, d: str) -> DataFrame:
    """Questions of the log matched to those of the pairs, exactly or by word sets."""
    return matching.match_questions(table(spark, d, "response_trajectory").where("question is not null"), table(spark, d, "qa_pair").where("question is not null"))


@query(f"""WITH s AS (SELECT retrieval.top_score AS a, retrieval.mean_score AS b, outcome.confidence_score AS c, outcome.factual_consistency AS f FROM response_trajectory WHERE retrieval.top_score IS NOT NULL AND retrieval.mean_score IS NOT NULL AND outcome.confidence_score IS NOT NULL AND outcome.factual_consistency IS NOT NULL),
  w AS (SELECT * FROM (VALUES ('all', 0.3, 0.2, 0.3, 0.2), ('no_top', 0, 0.2, 0.3, 0.2), ('no_mean', 0.3, 0, 0.3, 0.2), ('no_confidence', 0.3, 0.2, 0, 0.2), ('no_consistency', 0.3, 0.2, 0.3, 0)) v(setting, wa, wb, wc, wf))
  SELECT setting, count(*) AS n, round(avg((wa * a + wb * b + wc * c + wf * f) / (wa + wb + wc + wf)::DOUBLE), 6) AS mean, round(stddev_pop((wa * a + wb * b + wc * c + wf * f) / (wa + wb + wc + wf)::DOUBLE), 6) AS deviation FROM s, w GROUP BY setting""")
def ablation(spark: SparkSession, d: str) -> DataFrame:
    """A combined score with each signal left out in turn; one scan, five weight vectors."""
    t = table(spark, d, "response_trajectory").select(F.col("retrieval.top_score").alias("a"), F.col("retrieval.mean_score").alias("b"), F.col("outcome.confidence_score").alias("c"), F.col("outcome.factual_consistency").alias("f")).dropna()
    full = {"a": 0.3, "b": 0.2, "c": 0.3, "f": 0.2}
    settings = [("all", full)] + [(n, full | {k: 0.0}) for n, k in (("no_top", "a"), ("no_mean", "b"), ("no_confidence", "c"), ("no_consistency", "f"))]
    w = spark.createDataFrame([(n, *v.values(), sum(v.values())) for n, v in settings], "setting string, wa double, wb double, wc double, wf double, total double")
    score = (F.col("wa") * F.col("a") + F.col("wb") * F.col("b") + F.col("wc") * F.col("c") + F.col("wf") * F.col("f")) / F.col("total")
    return t.crossJoin(F.broadcast(w)).groupBy("setting").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 6).alias("mean"), F.round(F.stddev_pop(score), 6).alias("deviation"))


@query(r"""WITH s AS (SELECT pair_id, trim(s) AS s, lower(coalesce(context, '')) AS c FROM (SELECT pair_id, context, unnest(string_split(answer, '.')) AS s FROM qa_pair WHERE answer IS NOT NULL) WHERE length(trim(s)) > 10),
  w AS (SELECT pair_id, c, list_distinct(regexp_extract_all(lower(s), '([a-z0-9]{5,})', 1)) AS w FROM s),
  f AS (SELECT pair_id, bool_or(len(w) > 0 AND len(list_filter(w, lambda x: contains(c, x)))::DOUBLE / greatest(1, len(w)) < 0.3) AS odd FROM w GROUP BY pair_id)
  SELECT count(*) AS n, count(CASE WHEN odd THEN 1 END) AS flagged, round(avg(odd::INT), 6) AS rate FROM f""")
def unsupported_rate(spark: SparkSession, d: str) -> DataFrame:
    """Share of answers with a sentence of which less than three in ten longer words stand in the context."""
    s = table(spark, d, "qa_pair").where("answer is not null").select("pair_id", F.lower(F.coalesce("context", F.lit(""))).alias("c"), F.explode(F.split("answer", r"\.")).alias("s")).where(F.length(F.trim("s")) > 10)
    w = F.array_distinct(F.regexp_extract_all(F.lower(F.trim("s")), F.lit("([a-z0-9]{5,})"), F.lit(1)))
    odd = (F.size("w") > 0) & (F.size(F.filter("w", lambda x: F.contains(F.col("c"), x))) / F.greatest(F.lit(1), F.size("w")) < 0.3)
    f = s.select("pair_id", "c", w.alias("w")).groupBy("pair_id").agg(F.bool_or(odd).alias("odd"))
    return f.agg(F.count(F.lit(1)).alias("n"), F.count_if("odd").alias("flagged"), F.round(F.avg(F.col("odd").cast("int")), 6).alias("rate"))


@query(f"""WITH {_LABELLED}, t AS (SELECT outcome.factual_consistency AS f, retrieval.top_score AS s FROM response_trajectory)
  SELECT CASE WHEN f IS NOT NULL THEN 'consistency' WHEN s IS NOT NULL THEN 'score' ELSE 'none' END AS basis, count(*) AS n, count(CASE WHEN CASE WHEN f IS NOT NULL THEN f >= 0.5 WHEN s IS NOT NULL THEN s >= 0.6 ELSE false END THEN 1 END) AS positive FROM t GROUP BY 1""")
def calibration_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels from the first signal that is there."""
    f, s = F.col("outcome.factual_consistency"), F.col("retrieval.top_score")
    basis = F.when(f.isNotNull(), "consistency").when(s.isNotNull(), "score").otherwise("none")
    label = F.when(f.isNotNull(), f >= 0.5).when(s.isNotNull(), s >= 0.6).otherwise(F.lit(False))
    return table(spark, d, "response_trajectory").select(basis.alias("basis"), label.alias("y")).groupBy("basis").agg(F.count(F.lit(1)).alias("n"), F.count_if("y").alias("positive"))


@query(f"""SELECT {_type_sql('question')} AS query_type, count(*) AS n, round(avg(outcome.latency_ms), 4) AS latency, round(avg(outcome.is_answerable::INT), 6) AS answered, round(avg(retrieval.top_score), 6) AS top_score FROM response_trajectory GROUP BY 1""")
def profile_by_type(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "response_trajectory")
    return t.groupBy(retrieval.question_type(F.col("question")).alias("query_type")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("outcome.latency_ms"), 4).alias("latency"), F.round(F.avg(F.col("outcome.is_answerable").cast("int")), 6).alias("answered"), F.round(F.avg("retrieval.top_score"), 6).alias("top_score"))


@query(f"""WITH {_DENSE_SQL}, g AS (SELECT query_id, rank, (CASE WHEN q.label = x.label THEN 2 WHEN abs(q.label - x.label) = 1 THEN 1 ELSE 0 END) AS grade, q.label FROM dense JOIN embeddings q ON q.vec_id = query_id JOIN embeddings x ON x.vec_id = doc_id WHERE rank <= 10),
  n AS (SELECT q.label, count(CASE WHEN x.label = q.label THEN 1 END) AS two, count(CASE WHEN abs(x.label - q.label) = 1 THEN 1 END) AS one FROM (SELECT DISTINCT label FROM embeddings) q, embeddings x GROUP BY 1),
  i AS (SELECT label, sum((CASE WHEN p <= two THEN 2 WHEN p <= two + one THEN 1 ELSE 0 END) / log2(p + 1)) AS best FROM n, range(1, 11) r(p) GROUP BY 1)
  SELECT query_id, round(sum(grade / log2(rank + 1)) / max(best), 6) AS ndcg FROM g JOIN i USING (label) GROUP BY query_id""")
def ndcg_graded(spark: SparkSession, d: str) -> DataFrame:
    """NDCG with grades: 2 for the question's label, 1 for a label next to it."""
    v = table(spark, d, "embeddings")
    labels = v.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("dl"))
    asked = _asked_vectors(spark, d)
    mine = labels.select(F.col("doc_id").alias("query_id"), F.col("dl").alias("label")).join(asked.select("query_id"), "query_id", "left_semi")
    grade = F.when(F.col("dl") == F.col("label"), 2).when(F.abs(F.col("dl") - F.col("label")) == 1, 1).otherwise(0)
    got = retrieval.dense(v, asked, k=10).join(labels, "doc_id").join(mine, "query_id").groupBy("query_id", "label").agg(F.sum(grade / F.log2(F.col("rank") + 1)).alias("dcg"))
    sizes = v.groupBy(F.col("label").alias("l")).agg(F.count(F.lit(1)).alias("n"))
    near = sizes.select(F.explode(F.array(*[F.struct((F.col("l") + k).alias("label"), F.lit(2 if not k else 1).alias("g")) for k in (-1, 0, 1)])).alias("x"), "n").groupBy("x.label").agg(F.sum(F.when(F.col("x.g") == 2, F.col("n")).otherwise(0)).alias("two"), F.sum(F.when(F.col("x.g") == 1, F.col("n")).otherwise(0)).alias("one"))
    best = sum((F.when(F.lit(p) <= F.col("two"), 2.0).when(F.lit(p) <= F.col("two") + F.col("one"), 1.0).otherwise(0.0) / F.log2(F.lit(p + 1.0)) for p in range(1, 11)), F.lit(0.0))
    return got.join(F.broadcast(near.select("label", best.alias("best"))), "label").select("query_id", F.round(F.col("dcg") / F.col("best"), 6).alias("ndcg"))


@query(r"""WITH c AS (SELECT pair_id, answer, substr(answer, 1, 160) AS cut FROM qa_pair WHERE answer IS NOT NULL), e AS (SELECT *, length(regexp_extract(cut, '(?s)^(.*[.!?])', 1)) AS last_end, length(regexp_extract(cut, '(?s)^(.*) ', 1)) AS last_space FROM c)
  SELECT pair_id, CASE WHEN length(answer) <= 160 THEN answer WHEN last_end > 80 THEN substr(cut, 1, last_end) ELSE substr(cut, 1, last_space) || '...' END AS short FROM e""")
def shortened_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers cut to 160 characters at their last sentence end, or at a space."""
    c = table(spark, d, "qa_pair").where("answer is not null").select("pair_id", "answer", F.substring("answer", 1, 160).alias("cut"))
    end, space = F.length(F.regexp_extract("cut", r"(?s)^(.*[.!?])", 1)), F.length(F.regexp_extract("cut", r"(?s)^(.*) ", 1))
    return c.select("pair_id", F.when(F.length("answer") <= 160, F.col("answer")).when(end > 80, F.substring(F.col("cut"), F.lit(1), end)).otherwise(F.concat(F.substring(F.col("cut"), F.lit(1), space), F.lit("..."))).alias("short"))


@query("""WITH s AS (SELECT action.pipeline AS pipeline, unnest(retrieval.source_names) AS source FROM response_trajectory) SELECT pipeline, source, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY pipeline), 6) AS share FROM s GROUP BY pipeline, source""")
def source_use(spark: SparkSession, d: str) -> DataFrame:
    """How often each source is retrieved, by pipeline."""
    s = table(spark, d, "response_trajectory").select(F.col("action.pipeline").alias("pipeline"), F.explode("retrieval.source_names").alias("source")).groupBy("pipeline", "source").agg(F.count(F.lit(1)).alias("n"))
    return s.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("pipeline")), 6))


@query("""SELECT coalesce(metadata['client'], 'none') AS client, count(CASE WHEN rating = 1 THEN 1 END) AS "1", count(CASE WHEN rating = 2 THEN 1 END) AS "2", count(CASE WHEN rating = 3 THEN 1 END) AS "3", count(CASE WHEN rating = 4 THEN 1 END) AS "4", count(CASE WHEN rating = 5 THEN 1 END) AS "5" FROM user_feedback GROUP BY 1""")
def ratings_by_client(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "user_feedback").select(F.coalesce(F.try_element_at("metadata", F.lit("client")), F.lit("none")).alias("client"), "rating")
    return f.groupBy("client").pivot("rating", [1, 2, 3, 4, 5]).count().na.fill(0)


@query("""SELECT lower(trim(source)) AS source, count(*) AS n, count(content) AS there, round(avg(length(content)), 4) AS mean_length, max(length(content)) AS longest, count(DISTINCT parent_id) AS parents, count(CASE WHEN total_chunks IS NULL OR total_chunks <= chunk_id THEN 1 END) AS wrong_total FROM kb_chunk GROUP BY 1""")
def chunk_profile(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "kb_chunk")
    return k.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count("content").alias("there"), F.round(F.avg(F.length("content")), 4).alias("mean_length"), F.max(F.length("content")).alias("longest"), F.count_distinct("parent_id").alias("parents"), F.count_if(F.col("total_chunks").isNull() | (F.col("total_chunks") <= F.col("chunk_id"))).alias("wrong_total"))


@query("SELECT DISTINCT feedback_id FROM user_feedback WHERE feedback_id IS NOT NULL")
def stream_first_feedback(spark: SparkSession, d: str) -> DataFrame:
    """Each feedback id once, with state that is let go 400 days behind the newest arrival; one trigger
    over the whole log, so no repeat is too late for it."""
    s = ST.log_stream(spark, f"{d}/user_feedback.parquet", 1_000_000).where("feedback_id is not null").select("feedback_id", F.col("received_at").cast("timestamp").alias("received_at"))
    return ST.run_to_end(ST.first_by_key(s, "feedback_id", "received_at", "400 days").select("feedback_id"), "first", "append")


@query()
def corrective_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """Questions with fewer than two good hits asked once more, with three new longer words of their best
    hit; the second answer counts only where it has more good hits."""
    docs, asked, good = table(spark, d, "documents"), _titles(spark, d), 6.0
    counts = retrieval.term_counts(docs, "text")
    first = cut(retrieval.bm25(docs, "doc_id", "text", asked, 5, counts))
    weak = asked.join(first.groupBy("query_id").agg(F.count_if(F.col("score") >= good).alias("good")), "query_id", "left").where(F.coalesce("good", F.lit(0)) < 2)
    top = first.where("rank = 1")
    best = top.join(retrieval.of_hits(docs, "doc_id", top, "text"), "doc_id").select("query_id", scoring.key_terms(F.col("text")).alias("t"))
    more = F.slice(F.filter(F.array_except(F.col("t"), scoring.key_terms(F.col("query"))), lambda w: F.length(w) >= 5), 1, 3)
    again = weak.join(best, "query_id").select("query_id", F.concat_ws(" ", F.col("query"), F.array_join(more, " ")).alias("query"))
    second = cut(retrieval.bm25(docs, "doc_id", "text", again, 5, counts))
    count = lambda h, n: h.groupBy("query_id").agg(F.count_if(F.col("score") >= good).alias(n))
    better = count(second, "b").join(count(first, "a"), "query_id", "left").where(F.col("b") > F.coalesce("a", F.lit(0))).select("query_id")
    return first.join(better, "query_id", "left_anti").withColumn("corrected", F.lit(False)).unionByName(second.join(better, "query_id", "left_semi").withColumn("corrected", F.lit(True)))


@query(r"""WITH t AS (SELECT pair_id, question, answer FROM qa_pair WHERE question IS NOT NULL AND answer IS NOT NULL), w AS (SELECT pair_id, list_distinct(regexp_extract_all(lower(question), '([a-z0-9_]{4,})', 1)) AS q, regexp_extract_all(lower(answer), '([a-z0-9_]{4,})', 1) AS a FROM t)
  SELECT pair_id, round(len(list_filter(q, lambda x: list_contains(a, x)))::DOUBLE / len(q), 6) AS covered FROM w WHERE len(q) > 0""")
def question_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of a question's longer words that its answer takes up."""
    t = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]{4,})"), F.lit(1))
    q = table(spark, d, "qa_pair").where("question is not null and answer is not null")
    return q.select("pair_id", F.round(overlap_share(t("question"), t("answer")), 6).alias("covered")).where("covered is not null")


_SYN = "list_concat(" + ", ".join("CASE WHEN contains(q, '{0}') THEN [{1}] ELSE []::VARCHAR[] END".format(p.replace("'", "''"), ", ".join("replace(q, '{0}', '{1}')".format(p.replace("'", "''"), s.replace("'", "''")) for s in syn[:3])) for p, syn in SYNONYMS) + ")"


@query(f"""WITH t AS (SELECT response_id, received_at, lower(question) AS q FROM response_trajectory WHERE question IS NOT NULL), v AS (SELECT response_id, received_at, ({_SYN})[1:3] AS v FROM t)
  SELECT response_id, received_at, (generate_subscripts(v, 1) - 1)::INT AS variant, unnest(v) AS query FROM v""")
def synonym_variants(spark: SparkSession, d: str) -> DataFrame:
    """Questions with phrases replaced by words of the same meaning."""
    t = table(spark, d, "response_trajectory").where("question is not null")
    return t.select("response_id", "received_at", F.posexplode(rewrite.synonym_variants(F.col("question"))).alias("variant", "query"))


@query(r"""WITH t AS (SELECT category, rouge_fmeasure AS r, list_distinct(regexp_extract_all(lower(coalesce(reference, '')), '([a-z]{4,})', 1)) AS k, lower(coalesce(response, '')) AS a FROM ragas_standard_tinyllama_10),
  c AS (SELECT category, r, CASE WHEN len(k) = 0 THEN 1.0 ELSE len(list_filter(k, lambda x: contains(a, x)))::DOUBLE / len(k) END AS cov FROM t)
  SELECT category, count(*) AS n, round(avg(cov), 6) AS coverage, count(CASE WHEN cov >= 0.4 AND (r IS NULL OR r >= 0.2) THEN 1 END) AS correct FROM c GROUP BY category""")
def correctness(spark: SparkSession, d: str) -> DataFrame:
    """Answers that cover two fifths of the reference's words and come near it in sequence, by category."""
    r = table(spark, d, "ragas_standard_tinyllama_10")
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("reference", F.lit(""))), F.lit("([a-z]{4,})"), F.lit(1)))
    c = r.select("category", "rouge_fmeasure", evaluation.keyword_coverage(F.col("response"), words).alias("cov"))
    return c.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("cov"), 6).alias("coverage"), F.count_if((F.col("cov") >= 0.4) & (F.col("rouge_fmeasure").isNull() | (F.col("rouge_fmeasure") >= 0.2))).alias("correct"))


#: Kinds of values that are compared between answer and reference.
_ENTITIES = (("dose", r"([0-9]+(?:\.[0-9]+)? ?(?:mg/kg|mg|ml))"), ("duration", r"([0-9]+ (?:hours?|days?|weeks?|months?))"), ("percentage", r"([0-9]+(?:\.[0-9]+)?%)"))


@query(" UNION ALL ".join(f"""SELECT '{n}' AS kind, count(*) AS n, sum(len(list_intersect(a, b)))::BIGINT AS common, sum(len(a))::BIGINT AS given, sum(len(b))::BIGINT AS wanted,
  round(sum(len(list_intersect(a, b)))::DOUBLE / greatest(1, sum(len(a))), 6) AS "precision", round(sum(len(list_intersect(a, b)))::DOUBLE / greatest(1, sum(len(b))), 6) AS recall
  FROM (SELECT list_distinct(regexp_extract_all(lower(coalesce(response, '')), '{p}', 1)) AS a, list_distinct(regexp_extract_all(lower(coalesce(reference, '')), '{p}', 1)) AS b FROM ragas_standard_tinyllama_10)""" for n, p in _ENTITIES))
def entity_scores(spark: SparkSession, d: str) -> DataFrame:
    """Doses, durations and percentages of answers held against the references; one scan for all kinds."""
    r = table(spark, d, "ragas_standard_tinyllama_10")
    found = lambda c, p: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(p), F.lit(1)))
    e = r.select(F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), found("response", p).alias("a"), found("reference", p).alias("b")) for n, p in _ENTITIES])).alias("e")).select("e.*")
    both = F.size(F.array_intersect("a", "b"))
    g = e.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(both).alias("common"), F.sum(F.size("a")).alias("given"), F.sum(F.size("b")).alias("wanted"))
    share = lambda c: F.round(F.col("common") / F.greatest(F.lit(1), F.col(c)), 6)
    return g.select("*", share("given").alias("precision"), share("wanted").alias("recall"))


@query(r"""WITH c AS (SELECT pair_id, unnest(list_distinct(regexp_extract_all(answer, '((?:Fig|Sect|Table)\.? [0-9]+(?:\.[0-9]+)?)', 1))) AS cited, lower(coalesce(context, '')) AS c FROM qa_pair WHERE answer IS NOT NULL)
  SELECT pair_id, cited FROM c WHERE NOT contains(c, lower(cited))""")
def unseen_citations(spark: SparkSession, d: str) -> DataFrame:
    """Figures, sections and tables that an answer cites and its context does not name."""
    q = table(spark, d, "qa_pair").where("answer is not null")
    c = q.select("pair_id", F.lower(F.coalesce("context", F.lit(""))).alias("c"), F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(r"((?:Fig|Sect|Table)\.? [0-9]+(?:\.[0-9]+)?)"), F.lit(1)))).alias("cited"))
    return c.where(~F.contains("c", F.lower("cited"))).select("pair_id", "cited")


@query("""WITH s AS (SELECT response_id, received_at, greatest(0, least(1, 0.6::DOUBLE * coalesce(outcome.confidence_score, 0.7::DOUBLE) + 0.4::DOUBLE * coalesce(list_avg(retrieval.scores[1:3]), 0.5::DOUBLE) + least(0.05::DOUBLE * coalesce(len(retrieval.scores), 0), 0.2::DOUBLE))) AS c FROM response_trajectory)
  SELECT response_id, received_at, round(c, 6) AS confidence FROM s""")
def combined_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of generation, of the first three hits, and a little for each hit."""
    s = F.col("retrieval.scores")
    top = F.slice(s, 1, 3)
    mean = F.when(F.size(top) > 0, F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top))
    c = 0.6 * F.coalesce("outcome.confidence_score", F.lit(0.7)) + 0.4 * F.coalesce(mean, F.lit(0.5)) + F.least(0.05 * F.greatest(F.lit(0), F.coalesce(F.size(s), F.lit(0))), F.lit(0.2))
    return table(spark, d, "response_trajectory").select("response_id", "received_at", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 6).alias("confidence"))
