"""Whole searches, gates and training rows, composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import feedback as B
from ..operators import retrieval as R
from ..operators import scoring as C
from ..operators import sessions as S
from .queries_feedback import _RATING, _RESPONSE, _REWARD
from .queries_retrieval import _BM25_SQL, _DENSE_SQL, _HYBRID_SQL, _asked_vectors, _titles
from .queries_scoring import _DENY, _STOP
from .registry import query, table

_SOME = "lower(coalesce(lang, '')) = 'en'"
_NARROW = _HYBRID_SQL.replace("FROM documents WHERE text IS NOT NULL", f"FROM documents WHERE text IS NOT NULL AND {_SOME}").replace("FROM embeddings a, embeddings b WHERE", f"FROM embeddings a, (SELECT * FROM embeddings SEMI JOIN (SELECT doc_id AS vec_id FROM documents WHERE {_SOME}) USING (vec_id)) b WHERE").replace("rank <= 20", "rank <= 30")
_FLAG = r"""coalesce(regexp_matches(lower(text), '\bhow\s+to\s+(?:make|synthesize|produce|create)\s+\w+\s+(?:drug|poison|explosive)') OR regexp_matches(lower(text), '\bself[- ]harm\b') OR regexp_matches(lower(text), '\b(?:illegal|illicit)\s+drug\s+(?:synthesis|recipe|formula)'), false)"""


@query(f"""{_NARROW}, h AS (SELECT query_id, doc_id, round(least(s * 61 / 2, 1.0), 6) AS score FROM top WHERE rank <= 15),
  j AS (SELECT h.*, d.text, d.source, {_FLAG} AS flagged FROM h JOIN documents d USING (doc_id) WHERE score >= 0.4),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY flagged, score DESC, doc_id)::INT AS rank FROM j)
  SELECT query_id, rank, doc_id, score, flagged, text, source FROM r WHERE rank <= 5""")
def retrieve_documents(spark: SparkSession, d: str) -> DataFrame:
    """English documents alone ranked, flagged ones last, weak ones left out, with text and source."""
    asked = _titles(spark, d).join(_asked_vectors(spark, d), "query_id", "left")
    return R.retrieve(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "embeddings"), asked, 5, F.lower(F.coalesce("lang", F.lit(""))) == "en", 0.4, keep=("source",))


@query()
def retrieve_diverse(spark: SparkSession, d: str) -> DataFrame:
    """The whole search over all documents, equal scores in order of marginal relevance."""
    asked = _titles(spark, d).join(_asked_vectors(spark, d), "query_id", "left")
    return R.retrieve(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "embeddings"), asked, 5, diversity=0.5).select("query_id", "rank", "doc_id", "score", "flagged")


@query(rf"""WITH {_BM25_SQL}, h AS (SELECT query_id, doc_id, score FROM sparse WHERE rank <= 5), t AS (SELECT query_id, max(score) AS top FROM h GROUP BY 1),
  k AS (SELECT query_id, text FROM h JOIN t USING (query_id) JOIN documents USING (doc_id) WHERE score >= greatest(0.01, 0.5 * top)),
  a AS (SELECT doc_id AS query_id, list_filter(list_distinct(regexp_extract_all(lower(title), '([\p{{L}}\p{{N}}_]+)', 1)), lambda x: length(x) > 3 AND NOT list_contains({_STOP}, x) AND NOT list_contains({_DENY}, x)) AS q FROM documents WHERE doc_id % 50 = 0 AND title IS NOT NULL),
  c AS (SELECT query_id, CASE WHEN len(q) = 0 THEN 1.0 ELSE len(list_intersect(q, regexp_extract_all(lower(coalesce(text, '')), '([\p{{L}}\p{{N}}_]+)', 1)))::DOUBLE / len(q) END AS c, regexp_matches(lower(coalesce(text, '')), 'cause|etiology|due to|trigger|pathophysiology|mechanism') AS causal FROM k JOIN a USING (query_id)),
  g AS (SELECT query_id, count(*) AS kept, count(CASE WHEN c >= 0.3 THEN 1 END) AS covering, bool_or(causal) AS causal FROM c GROUP BY 1)
  SELECT query_id, coalesce(kept, 0) AS kept, coalesce(covering, 0) AS covering, coalesce(kept, 0) >= 1 AND coalesce(covering, 0) > 0 AND (NOT regexp_matches(lower(title), 'what causes?|caused by|why does|why do|etiology|reason for') OR coalesce(causal, false)) AS answerable
  FROM a JOIN (SELECT doc_id AS query_id, title FROM documents) USING (query_id) LEFT JOIN g USING (query_id)""")
def answerable_questions(spark: SparkSession, d: str) -> DataFrame:
    """Titles of every fiftieth document, by what their five best hits cover of them."""
    docs, asked = table(spark, d, "documents"), _titles(spark, d)
    hits = R.bm25(docs, "doc_id", "text", asked, 5)
    return C.answerable_hits(hits.join(R.of_hits(docs, "doc_id", hits, "text"), "doc_id"), asked, "text")


@query(f"""WITH {_DENSE_SQL}, g AS (SELECT query_id, rank, CASE WHEN q.label = x.label THEN 2 WHEN abs(q.label - x.label) = 1 THEN 1 ELSE 0 END AS g FROM dense JOIN embeddings q ON q.vec_id = query_id JOIN embeddings x ON x.vec_id = doc_id WHERE rank <= 10),
  i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g DESC, rank) AS k FROM g), s AS (SELECT query_id, sum((2.0 ** g - 1) / log2(rank + 1)) AS dcg, sum((2.0 ** g - 1) / log2(k + 1)) AS ideal FROM i GROUP BY 1)
  SELECT query_id, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 6) AS ndcg FROM s""")
def ndcg_retrieved(spark: SparkSession, d: str) -> DataFrame:
    """Same label counts 2, a neighbouring one 1."""
    v = table(spark, d, "embeddings")
    hits = R.dense(v, _asked_vectors(spark, d), k=10)
    labels = v.select(F.col("vec_id").alias("doc_id"), "label").join(hits, "doc_id").join(v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    grade = F.when(F.col("label") == F.col("wanted"), 2).when(F.abs(F.col("label") - F.col("wanted")) == 1, 1).otherwise(0)
    return E.ndcg_of_retrieved(labels.select("query_id", "rank", grade.alias("grade")), 10)


@query(f"""WITH f AS (SELECT {_RESPONSE} AS response_id, feedback_id, feedback_text, received_at FROM user_feedback WHERE feedback_text <> ''), k AS (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY received_at NULLS FIRST, feedback_id NULLS FIRST, feedback_text) AS k FROM f WHERE response_id IS NOT NULL)
  SELECT response_id, list(feedback_id ORDER BY k) AS ids, list(feedback_text ORDER BY k) AS texts FROM k WHERE k <= 5 GROUP BY 1""")
def feedback_texts(spark: SparkSession, d: str) -> DataFrame:
    """The first five texts about each response."""
    return B.first_texts(table(spark, d, "user_feedback"))


_RATED = _RATING.replace("coalesce(rating, 1)", "coalesce(rating, 3)")


@query(f"""WITH f AS (SELECT *, coalesce(nullif(trim(feedback_id), ''), {_RESPONSE}) AS sample_id, {_RESPONSE} AS response_id, {_REWARD} AS reward, {_RATED} AS stars FROM user_feedback WHERE {_RESPONSE} IS NOT NULL),
  t AS (SELECT DISTINCT lower(trim(response_id)) AS r FROM response_trajectory WHERE trim(response_id) <> '')
  SELECT sample_id, f.response_id, received_at, reward, stars AS rating, coalesce(was_helpful, stars >= 4)::INT::DOUBLE AS helpful, coalesce(was_accurate, stars >= 4)::INT::DOUBLE AS accurate, coalesce(was_safe, true)::INT::DOUBLE AS safe, r IS NOT NULL AS has_trajectory,
    CASE WHEN ('0x' || substr(sha1(sample_id), 1, 8))::UBIGINT / 4294967295.0 < 0.9 THEN 'train' ELSE 'val' END AS split FROM f LEFT JOIN t ON f.response_id = t.r""")
def feedback_events(spark: SparkSession, d: str) -> DataFrame:
    """One training row for each feedback."""
    return B.event_rows(table(spark, d, "user_feedback"), table(spark, d, "response_trajectory"))


@query(r"""WITH b AS (SELECT lower(trim(session_id)) AS session, question, effective_question, received_at, response_id FROM response_trajectory WHERE trim(session_id) <> ''),
  t AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY received_at DESC, response_id DESC) AS back FROM b), k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY back DESC) AS turn FROM t WHERE back <= 3),
  x AS (SELECT session, turn, 'User: ' || coalesce(question, '') || chr(10) || 'Assistant: ' || coalesce(CASE WHEN length(effective_question) > 40 THEN substr(effective_question, 1, 40) || '...' ELSE effective_question END, '') AS t FROM k),
  u AS (SELECT *, sum(length(t)) OVER (PARTITION BY session ORDER BY turn) AS upto FROM x)
  SELECT session, string_agg(t, chr(10) || chr(10) ORDER BY turn) AS context, count(*) AS turns FROM u WHERE upto <= 300 GROUP BY session""")
def session_context(spark: SparkSession, d: str) -> DataFrame:
    """The last three turns of a session as text within a budget, what was searched for standing in the answer's place."""
    t = table(spark, d, "response_trajectory").withColumn("session", B.blank_to_null(F.lower("session_id")))
    return S.context_windows(t, "session", "question", "effective_question", ["received_at", "response_id"], preview=40, budget=300)


_CUTS = r"list_filter(string_split(regexp_replace(trim(content), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"


@query(rf"""WITH c AS (SELECT chunk_pk, parent_id, chunk_id, content, {_CUTS} AS s FROM kb_chunk WHERE parent_id IS NOT NULL AND content IS NOT NULL),
  e AS (SELECT *, array_to_string(s[-2:], ' ') AS l, array_to_string(s[1:2], ' ') AS f FROM c),
  w AS (SELECT chunk_pk, content, nullif(lag(l) OVER (PARTITION BY parent_id ORDER BY chunk_id, chunk_pk), '') AS b, nullif(lead(f) OVER (PARTITION BY parent_id ORDER BY chunk_id, chunk_pk), '') AS a FROM e)
  SELECT chunk_pk, concat_ws(' ', b, content, a) AS "window" FROM w""")
def chunk_sentence_window(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with two sentences of their neighbours on either side."""
    k = table(spark, d, "kb_chunk").where("parent_id is not null and content is not null")
    return R.sentence_windows(k, "parent_id", ["chunk_id", "chunk_pk"], "content").select("chunk_pk", "window")


@query("""SELECT pair_id, 'Answer the question.' AS instruction, CASE WHEN context <> '' THEN question || chr(10) || context ELSE question END AS input, answer AS output FROM qa_pair WHERE length(question) >= 10 AND length(answer) BETWEEN 20 AND 4000""")
def instruction_rows(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of fit length as instruction, input and output."""
    q = table(spark, d, "qa_pair").where((F.length("question") >= 10) & F.length("answer").between(20, 4000))
    given = F.when(F.col("context") != "", F.concat_ws("\n", "question", "context")).otherwise(F.col("question"))
    return q.select("pair_id", F.lit("Answer the question.").alias("instruction"), given.alias("input"), F.col("answer").alias("output"))
