"""Cleaning, ids, redaction, chunking and rewriting over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.fixed import HARM, LOG_REDACTION, REFORMULATIONS
from ..operators import chunking, rewrite, safety
from .registry import query, table


def _replace(expr: str, pattern: str, by: str) -> str:
    p = pattern.replace("'", "''")
    return f"regexp_replace({expr}, '{p}', '{by}', 'g')"


_CLEAN = _replace(_replace(_replace("content", r"<[^>]+>", " "), r"https?://\S+|www\.\S+", ""), r"\[\d+\]|\(\d+\)", "")


@query(rf"SELECT chunk_pk, trim(regexp_replace({_CLEAN}, '\s+', ' ', 'g'), ' ') AS cleaned FROM kb_chunk WHERE length(trim(regexp_replace({_CLEAN}, '\s+', ' ', 'g'), ' ')) >= 50")
def doc_clean(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned chunks of at least 50 characters."""
    return table(spark, d, "kb_chunk").select("chunk_pk", X.clean(F.col("content")).alias("cleaned")).where(F.length("cleaned") >= 50)


@query()
def doc_clean_compatible(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned and compatibility-normalised chunks."""
    return table(spark, d, "kb_chunk").select("chunk_pk", X.compatible(X.clean(F.col("content"))).alias("cleaned"))


def _redaction_sql(col: str) -> str:
    for p, tag in LOG_REDACTION:
        col = _replace(col, p, tag)
    return col


@query(f"SELECT feedback_id, received_at, {_redaction_sql('feedback_text')} AS redacted FROM user_feedback WHERE feedback_text IS NOT NULL")
def log_redaction(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "user_feedback").where("feedback_text is not null").select("feedback_id", "received_at", X.redact_log(F.col("feedback_text")).alias("redacted"))


@query("""SELECT chunk_pk, substr(sha256(source || '::chunk' || chunk_id || '::' || substr(sha256(content), 1, 16)), 1, 32) AS chunk_key,
  substr(sha256(source || '::' || substr(content, 1, 300)), 1, 16) AS document_key, md5('v2::' || lower(trim(content)) || '::' || source) AS cache_key FROM kb_chunk""")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "kb_chunk")
    return k.select("chunk_pk", X.chunk_key(F.col("source"), F.col("chunk_id"), F.col("content")).alias("chunk_key"), X.document_key(F.col("source"), F.col("content")).alias("document_key"), X.cache_key(F.col("content"), F.col("source")).alias("cache_key"))


@query("""SELECT CASE WHEN ('0x' || substr(sha1(feedback_id), 1, 8))::UBIGINT / 4294967295.0 < 0.9 THEN 'train' ELSE 'val' END AS split, count(*) AS n
  FROM user_feedback WHERE feedback_id IS NOT NULL GROUP BY 1""")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "user_feedback").where("feedback_id is not null")
    return f.groupBy(F.when(X.hash_share(F.col("feedback_id")) < 0.9, "train").otherwise("val").alias("split")).agg(F.count(F.lit(1)).alias("n"))


TERMS_SQL = r"string_split_regex(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s\-]', ' ', 'g'), '\s+')"


@query(rf"SELECT term, count(*) AS n, count(DISTINCT chunk_pk) AS chunks FROM (SELECT chunk_pk, unnest({TERMS_SQL.format('content')}) AS term FROM kb_chunk) WHERE length(term) >= 2 GROUP BY term")
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    """Frequency and document frequency of every search term; counted by chunk before the distinct count."""
    t = table(spark, d, "kb_chunk").select("chunk_pk", F.explode(X.terms(F.col("content"))).alias("term"))
    return t.groupBy("term", "chunk_pk").agg(F.count(F.lit(1)).alias("c")).groupBy("term").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("chunks"))


@query("""SELECT pair_id, CASE WHEN length(context) > 0 THEN 'Context: ' || context || chr(10) || chr(10) ELSE '' END || 'Question: ' || question || chr(10) || chr(10) || 'Answer: ' || answer AS content,
  coalesce(source, 'unknown') AS source FROM qa_pair WHERE length(question) > 0 AND length(answer) > 0""")
def qa_documents(spark: SparkSession, d: str) -> DataFrame:
    """Question-answer pairs as documents of the knowledge base."""
    q = table(spark, d, "qa_pair").where((F.length("question") > 0) & (F.length("answer") > 0))
    head = F.when(F.length("context") > 0, F.concat(F.lit("Context: "), "context", F.lit("\n\n"))).otherwise(F.lit(""))
    return q.select("pair_id", F.concat(head, F.lit("Question: "), "question", F.lit("\n\nAnswer: "), "answer").alias("content"), F.coalesce("source", F.lit("unknown")).alias("source"))


@query("""WITH u AS (SELECT question, answer, source FROM qa_pair UNION ALL SELECT user_input, response, source_dataset FROM ragas_standard_tinyllama_10 UNION ALL SELECT query, reference_answer, source FROM test_set_eval30)
  SELECT lower(trim(source)) AS source, count(*) AS n, count(CASE WHEN length(question) > 0 AND length(answer) > 0 THEN 1 END) AS complete FROM u GROUP BY ROLLUP (lower(trim(source)))""")
def qa_union(spark: SparkSession, d: str) -> DataFrame:
    """Rows and complete pairs of all question-answer sources, by source and in total."""
    a = table(spark, d, "qa_pair").select("question", "answer", "source")
    b = table(spark, d, "ragas_standard_tinyllama_10").select(F.col("user_input").alias("question"), F.col("response").alias("answer"), F.col("source_dataset").alias("source"))
    c = table(spark, d, "test_set_eval30").select(F.col("query").alias("question"), F.col("reference_answer").alias("answer"), "source")
    u = a.union(b).union(c).withColumn("source", F.lower(F.trim("source")))
    return u.rollup("source").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.length("question") > 0) & (F.length("answer") > 0)).alias("complete"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
  c AS (SELECT doc_id, w, unnest(range(0, greatest(1, ceil((len(w) - 50) / 462.0))::BIGINT)) AS j FROM w WHERE len(w) > 0)
  SELECT doc_id, (j + 1)::INT AS chunk_id, len(w[j * 462 + 1 : j * 462 + 512])::INT AS n_words, array_to_string(w[j * 462 + 1 : j * 462 + 512], ' ') AS chunk FROM c""")
def word_window_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.word_windows(table(spark, d, "documents"), "doc_id", "text")


@query()
def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, d, "documents"), "doc_id", "text", "source")


@query()
def recursive_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, d, "documents"), "doc_id", "text", "source", recursive=True)


@query("""SELECT chunk_pk, parent_id, concat_ws(' ', lag(content) OVER w, content, lead(content) OVER w) AS "window" FROM kb_chunk WHERE parent_id IS NOT NULL WINDOW w AS (PARTITION BY parent_id ORDER BY chunk_id, chunk_pk)""")
def chunk_neighbors(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.retrieval import with_neighbours

    return with_neighbours(table(spark, d, "kb_chunk").where("parent_id is not null"), "parent_id", ["chunk_id", "chunk_pk"], "content").select("chunk_pk", "parent_id", "window")


_FIRST = " ".join(f"WHEN starts_with(lower(trim(question)), '{p}') THEN regexp_replace(substr(trim(question), {len(p) + 1}), '^\\?+|\\?+$', '', 'g') || '{s}'" for p, s in REFORMULATIONS)


@query(f"SELECT response_id, received_at, question, CASE {_FIRST} END AS reformulated FROM response_trajectory WHERE question IS NOT NULL")
def reformulations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "response_trajectory").where("question is not null").select("response_id", "received_at", "question", rewrite.reformulation(F.col("question")).alias("reformulated"))


@query(r"""WITH p AS (SELECT pair_id, unnest(string_split(question, ' and ')) AS part, generate_subscripts(string_split(question, ' and '), 1) - 1 AS pos FROM qa_pair WHERE contains(question, ' and ')),
  t AS (SELECT pair_id, pos, trim(part) AS part FROM p)
  SELECT pair_id, pos::INT AS pos, regexp_replace(CASE WHEN regexp_matches(lower(part), '^(what|how|why|when|where|which|can|is)') THEN part ELSE 'What is ' || part END, '^\?+|\?+$', '', 'g') || '?' AS part FROM t""")
def decomposed_questions(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "qa_pair").select("pair_id", F.posexplode(rewrite.decomposed(F.col("question"))).alias("pos", "part"))
    return q.select("pair_id", "pos", "part")


@query()
def question_variants(spark: SparkSession, d: str) -> DataFrame:
    """Question and its variants: sanitised, abbreviations expanded, reformulated, decomposed."""
    t = table(spark, d, "response_trajectory").where("question is not null")
    return t.select("response_id", "received_at", F.posexplode(rewrite.variants(F.col("question"))).alias("variant", "query"))


@query(r"""WITH x AS (SELECT response_id, received_at, lower(question) AS q, regexp_matches(question, '(?i)\b(what\s+is|what\s+are|define|explain|tell\s+me\s+about|symptoms\s+of|causes\s+of|treatment\s+for)\b') AS edu FROM response_trajectory WHERE question IS NOT NULL),
  k AS (SELECT * FROM (VALUES (1,'suicide'),(2,'suicidal'),(3,'kill myself'),(4,'end my life'),(5,'heart attack'),(6,'can''t breathe'),(7,'chest pain'),(8,'stroke symptoms'),(9,'severe bleeding'),(10,'unconscious'),(11,'overdose'),(12,'poisoning'),(13,'anaphylaxis'),(14,'severe allergic reaction'),(15,'choking')) v(o, w)),
  h AS (SELECT x.*, k.o, k.w, substr(q, greatest(1, instr(q, w) - 40), least(40, instr(q, w) - 1)) AS before FROM x, k WHERE instr(q, w) > 0 AND NOT edu),
  u AS (SELECT response_id, received_at, q, arg_min(w, o) AS word FROM h WHERE NOT regexp_matches(before, 'not|no|don''t|dont|doesn''t|never|without|deny|denies|denied') GROUP BY ALL),
  s AS (SELECT *, regexp_matches(q, 'pregnancy|pregnant|abortion|mental health|depression|anxiety|psychiatric|cancer|tumor|malignant|hiv|aids|std|sexually transmitted|surgery|surgical|operation|prescription|controlled substance') AS topic FROM x)
  SELECT CASE WHEN u.word IS NOT NULL THEN 'emergency' WHEN topic THEN 'caution' ELSE 'safe' END AS level, count(*) AS n FROM s LEFT JOIN (SELECT DISTINCT q, word FROM u) u USING (q) GROUP BY 1""")
def input_levels(spark: SparkSession, d: str) -> DataFrame:
    """Questions by level of caution: urgent words with negation before them, then sensitive topics."""
    t = table(spark, d, "response_trajectory").where("question is not null")
    return t.groupBy(safety.input_level(F.col("question")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def _harm_sql() -> str:
    parts = " + ".join("CASE WHEN regexp_matches(coalesce(answer, ''), '(?i){0}') THEN {1}::DOUBLE ELSE 0 END".format(p.replace("'", "''"), w) for p, _, w in HARM)
    return f"SELECT pair_id, harm, CASE WHEN harm < 0.2 THEN 'low' WHEN harm < 0.5 THEN 'moderate' WHEN harm < 0.8 THEN 'high' ELSE 'critical' END AS level FROM (SELECT pair_id, round(least(1.0::DOUBLE, {parts}), 6) AS harm FROM qa_pair)"


@query(_harm_sql())
def answer_harm(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "qa_pair").select("pair_id", safety.harm_score(F.col("answer")).alias("harm"))
    return a.select("pair_id", "harm", safety.harm_level(F.col("harm")).alias("level"))


@query("""SELECT chunk_pk, parent_id, used FROM (SELECT chunk_pk, parent_id, sum(length(content)) OVER (PARTITION BY parent_id ORDER BY chunk_id, chunk_pk ROWS UNBOUNDED PRECEDING) AS used FROM kb_chunk WHERE parent_id IS NOT NULL AND content IS NOT NULL) WHERE used <= 2000""")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    """The first chunks of each parent that fit in 2,000 characters."""
    from ..operators.retrieval import within_budget

    k = table(spark, d, "kb_chunk").where("parent_id is not null and content is not null")
    return within_budget(k, "parent_id", ["chunk_id", "chunk_pk"], "content", 2000).select("chunk_pk", "parent_id", "used")


@query("""SELECT parent_id, chunk_id, max_by(content, struct_pack(a := ingested_at, b := chunk_pk)) AS content, max(ingested_at) AS ingested_at, count(*) AS versions FROM kb_chunk WHERE parent_id IS NOT NULL GROUP BY parent_id, chunk_id HAVING max_by(content, struct_pack(a := ingested_at, b := chunk_pk)) IS NOT NULL""")
def chunk_versions(spark: SparkSession, d: str) -> DataFrame:
    """The last version of every chunk of a parent; one aggregation instead of a sort."""
    k = table(spark, d, "kb_chunk").where("parent_id is not null")
    last = F.max_by(F.struct("content"), F.struct("ingested_at", "chunk_pk"))
    return k.groupBy("parent_id", "chunk_id").agg(last.alias("l"), F.max("ingested_at").alias("ingested_at"), F.count(F.lit(1)).alias("versions")).select("parent_id", "chunk_id", F.col("l.content").alias("content"), "ingested_at", "versions").where("content is not null")
