"""Judgements by gold marks, overlap and annotators; keywords, citations and pooled vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import marked_sentences, unveiled, words
from ..operators import chunking
from ..operators import judging as J
from ..operators import retrieval as R
from ..operators import scoring as C
from ..operators.feedback import blank_to_null
from .queries_retrieval import _BM25_SQL, _titles
from .queries_scoring import _STOP
from .registry import query, table

_SPLIT = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"
_WORDS = r"'([\p{L}\p{N}_]+)'"


def _five_hits(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    hits = R.bm25(docs, "doc_id", "text", _titles(spark, d), 5).select("query_id", "doc_id", "rank")
    return hits.join(R.of_hits(docs, "doc_id", hits, "text", "source"), "doc_id")


@query(rf"""WITH {_BM25_SQL}, h AS (SELECT query_id, doc_id, rank FROM sparse WHERE rank <= 5),
  g AS (SELECT doc_id AS query_id, list_filter(list_distinct(regexp_extract_all(lower(title), {_WORDS}, 1)), lambda x: length(x) > 3) AS k, nullif(lower(trim(source)), '') AS s FROM documents WHERE doc_id % 50 = 0 AND title IS NOT NULL),
  m AS (SELECT query_id, h.doc_id, rank, len(k) AS nk, s, lower(coalesce(d.source, '')) AS src, len(list_filter(k, lambda x: contains(lower(coalesce(d.text, '')), x))) AS n FROM h JOIN g USING (query_id) JOIN documents d ON d.doc_id = h.doc_id)
  SELECT query_id, doc_id, rank::INT AS rank, (doc_id = query_id OR coalesce(contains(src, s), false) OR CASE WHEN nk = 0 THEN false WHEN nk = 1 THEN n = 1 ELSE n >= nk // 2 END)::INT AS relevant FROM m""")
def gold_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Hits of titles that are the titled document, of its source, or have half of the title's longer words."""
    gold = table(spark, d, "documents").where("doc_id % 50 = 0 and title is not null").select(
        F.col("doc_id").alias("query_id"), F.array("doc_id").alias("ids"), F.array_compact(F.array(blank_to_null(F.lower("source")))).alias("sources"),
        F.filter(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit(_WORDS.strip("'")), F.lit(1))), lambda w: F.length(w) > 3).alias("keywords"),
    )
    hits = _five_hits(spark, d).join(gold, "query_id")
    found = J.matches_gold(F.col("doc_id"), F.col("source"), F.col("text"), F.col("ids"), F.col("sources"), F.col("keywords"))
    return hits.select("query_id", "doc_id", "rank", found.cast("int").alias("relevant"))


_TITLE_WORDS = f"SELECT doc_id AS query_id, list_distinct({_SPLIT.format('lower(title)')}) AS w FROM documents WHERE doc_id % 50 = 0 AND title IS NOT NULL"
_TITLE_HITS = rf"WITH {_BM25_SQL}, h AS (SELECT query_id, s.doc_id, rank, {_SPLIT.format('lower(text)')} AS t FROM sparse s JOIN documents d ON d.doc_id = s.doc_id WHERE rank <= 5)"


@query(f"""{_TITLE_HITS}, a AS (SELECT query_id, list_filter(w, lambda x: length(x) >= 4) AS w FROM ({_TITLE_WORDS})),
  r AS (SELECT query_id, doc_id, rank, len(list_intersect(w, t))::DOUBLE / len(w) >= 0.6 AS r FROM h JOIN a USING (query_id) WHERE len(w) > 0)
  SELECT query_id, doc_id, rank::INT AS rank, CASE WHEN bool_or(r) OVER (PARTITION BY query_id) THEN r ELSE rank = min(rank) OVER (PARTITION BY query_id) END::INT AS relevant FROM r""")
def overlap_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Hits of titles judged by the words that they share with them."""
    return J.overlap_relevance(_five_hits(spark, d), _titles(spark, d).withColumnRenamed("query", "answer"), "text")


@query(f"""{_TITLE_HITS}, a AS (SELECT * FROM ({_TITLE_WORDS}) WHERE len(w) > 0)
  SELECT query_id, count(*) AS hits, round(avg((len(list_intersect(w, t))::DOUBLE / len(w) > 0.15)::INT), 6) AS agreement FROM h JOIN a USING (query_id) GROUP BY query_id""")
def agreeing_sources(spark: SparkSession, d: str) -> DataFrame:
    """Share of a title's hits that have more than a little of its words."""
    return J.agreeing_sources(_five_hits(spark, d), _titles(spark, d).withColumnRenamed("query", "answer"), "text")


@query("""WITH j AS (SELECT nullif(trim(question_id), '') AS q, nullif(trim(metadata['client']), '') AS a, was_helpful AS h, was_accurate AS c, was_safe AS s, received_at, feedback_id FROM user_feedback),
  l AS (SELECT *, row_number() OVER (PARTITION BY q, a ORDER BY received_at DESC NULLS LAST, feedback_id DESC NULLS LAST, h DESC NULLS LAST, c DESC NULLS LAST, s DESC NULLS LAST) AS k FROM j WHERE q IS NOT NULL AND a IS NOT NULL),
  d AS (SELECT q, a, 'was_helpful' AS dimension, h AS v FROM l WHERE k = 1 UNION ALL SELECT q, a, 'was_accurate', c FROM l WHERE k = 1 UNION ALL SELECT q, a, 'was_safe', s FROM l WHERE k = 1),
  p AS (SELECT x.a || '_vs_' || y.a AS pair, dimension, x.v::INT AS u, y.v::INT AS w FROM d x JOIN d y USING (q, dimension) WHERE x.a < y.a AND x.v IS NOT NULL AND y.v IS NOT NULL),
  c AS (SELECT pair, dimension, count(*) AS n, avg((u = w)::INT) AS po, avg(u) * avg(w) + (1 - avg(u)) * (1 - avg(w)) AS pe FROM p GROUP BY ALL)
  SELECT pair, dimension, n, round(po, 6) AS agreement, round(CASE WHEN pe = 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM c""")
def annotator_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Clients as annotators of questions, by the last flags that each gave."""
    f = table(spark, d, "user_feedback").withColumns({"item": blank_to_null(F.col("question_id")), "client": blank_to_null(F.try_element_at("metadata", F.lit("client")))})
    return J.annotator_agreement(f, "item", "client", ["was_helpful", "was_accurate", "was_safe"], ["received_at", "feedback_id"])


@query(rf"""WITH w AS (SELECT pair_id, {_SPLIT.format('question')} AS w FROM qa_pair WHERE question IS NOT NULL), k AS (SELECT pair_id, w, list_filter(w, lambda x: length(x) >= 3 AND NOT list_contains({_STOP}, lower(x))) AS k FROM w)
  SELECT pair_id, array_to_string(k, ' ') AS keywords, (len(w) - len(k))::INT AS removed FROM k""")
def kept_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Words of questions without short and common ones."""
    w = table(spark, d, "qa_pair").where("question is not null").select("pair_id", words(F.col("question")).alias("w")).withColumn("k", J.kept_keywords(F.col("w")))
    return w.select("pair_id", F.array_join("k", " ").alias("keywords"), (F.size("w") - F.size("k")).alias("removed"))


@query(rf"""WITH w AS (SELECT doc_id, text, {_SPLIT.format('text')} AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT *, unnest(range(CASE WHEN len(w) <= 512 THEN 1 ELSE ceil(len(w) / 462.0)::BIGINT END)) AS i FROM w)
  SELECT doc_id, (i + 1)::INT AS chunk_id, len(w[i * 462 + 1 : i * 462 + 512])::INT AS n_words, CASE WHEN len(w) <= 512 THEN text ELSE array_to_string(w[i * 462 + 1 : i * 462 + 512], ' ') END AS chunk FROM s""")
def word_windows_to_end(spark: SparkSession, d: str) -> DataFrame:
    """Word windows that start anywhere in the text; short texts as they are."""
    return chunking.word_windows(table(spark, d, "documents"), "doc_id", "text", to_last_word=True)


_HIDDEN = "answer"
for _short in ("Dr.", "Mr.", "Mrs.", "Ms.", "mg.", "ml.", "vs.", "i.e.", "e.g.", "etc."):
    _HIDDEN = f"replace({_HIDDEN}, '{_short}', '{_short.replace('.', '<DOT>')}')"


@query(rf"""WITH s AS (SELECT pair_id, list_filter(list_transform(regexp_split_to_array({_HIDDEN}, '[.!?]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 10) AS s FROM qa_pair WHERE answer IS NOT NULL)
  SELECT pair_id, (generate_subscripts(s, 1) - 1)::INT AS sentence_no, replace(unnest(s), '<DOT>', '.') AS sentence FROM s""")
def answer_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of answers as they are marked in passages."""
    return table(spark, d, "qa_pair").where("answer is not null").select("pair_id", F.posexplode(marked_sentences(F.col("answer"))).alias("sentence_no", "sentence"))


@query("""WITH f AS (SELECT feedback_id, received_at, list_filter([was_helpful::INT, was_accurate::INT, was_safe::INT], lambda x: x IS NOT NULL) AS f FROM user_feedback WHERE rating IS NULL)
  SELECT feedback_id, received_at, greatest(1, least(5, round_even(1 + 4 * list_avg(f), 0)))::INT AS rating FROM f WHERE len(f) > 0""")
def rating_from_flags(spark: SparkSession, d: str) -> DataFrame:
    """Ratings of feedback that has flags alone."""
    f = table(spark, d, "user_feedback").where("rating is null")
    return f.select("feedback_id", "received_at", J.rating_of_flags("was_helpful", "was_accurate", "was_safe").alias("rating")).where("rating is not null")


@query("""WITH e AS (SELECT label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS p FROM embeddings WHERE embedding IS NOT NULL), m AS (SELECT label, p, avg(v) AS v FROM e GROUP BY ALL), n AS (SELECT label, sqrt(sum(v * v)) AS n FROM m GROUP BY label)
  SELECT m.label, (p - 1)::INT AS place, round(CASE WHEN n > 0 THEN v / n ELSE v END, 6) AS value FROM m JOIN n ON m.label IS NOT DISTINCT FROM n.label""")
def pooled_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the vectors of each label, scaled to length one."""
    return J.mean_pool(table(spark, d, "embeddings"), "label", "embedding").select("label", "place", F.round("value", 6).alias("value"))


@query(r"""WITH c AS (SELECT pair_id, lower(coalesce(context, '')) AS c, unnest(list_concat(regexp_extract_all(answer, '\(\s*[A-Z][a-z]+(?:\s+et\s+al\.?)?,?\s*\d{4}\s*\)'), regexp_extract_all(answer, 'according\s+to\s+(?:a\s+)?(?:recent\s+)?(?:study|research|paper)'),
    regexp_extract_all(answer, 'published\s+in\s+(?:the\s+)?[A-Z]'), regexp_extract_all(answer, '\b(?:doi|DOI)\s*:\s*10\.\d{4,}'))) AS cited FROM qa_pair WHERE answer IS NOT NULL)
  SELECT pair_id, cited FROM c WHERE NOT contains(c, lower(cited))""")
def unfounded_citations(spark: SparkSession, d: str) -> DataFrame:
    """Studies and papers that an answer cites and its context does not."""
    q = table(spark, d, "qa_pair").where("answer is not null")
    return q.select("pair_id", F.explode(C.unfounded_citations(F.col("answer"), F.col("context"))).alias("cited"))


@query()
def feedback_unveiled(spark: SparkSession, d: str) -> DataFrame:
    """Feedback texts in which patterns are not hidden by look-alikes and gaps."""
    return table(spark, d, "user_feedback").where("feedback_text is not null").select("feedback_id", "received_at", unveiled(F.col("feedback_text")).alias("plain"))
