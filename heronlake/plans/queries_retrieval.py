"""Retrieval: sparse, dense and fused search over documents, chunks and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import COMPARISON_QUESTION, DEFINITION_QUESTION, DRUG_QUESTION, SYMPTOM_QUESTION
from ..operators import retrieval as R
from .ordered import running_sum
from .registry import query, table

#: Questions of a search are the rows whose id is divisible by this.
EVERY = 50


def _titles(spark: SparkSession, d: str) -> DataFrame:
    """Questions: the titles of every fiftieth document."""
    return table(spark, d, "documents").where(f"doc_id % {EVERY} = 0 and title is not null").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))


def _asked_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where(f"vec_id % {EVERY} = 0").select(F.col("vec_id").alias("query_id"), "embedding")


_TERMS = r"string_split_regex(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s\-]', ' ', 'g'), '\s+')"
_BM25_SQL = rf"""
  tok AS (SELECT doc_id AS doc, list_filter({_TERMS.format('text')}, lambda x: length(x) >= 2) AS t FROM documents WHERE text IS NOT NULL),
  len AS (SELECT doc, len(t) AS dl FROM tok),
  st AS (SELECT count(*) AS n, avg(dl) AS av FROM len),
  post AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(t) AS term FROM tok) GROUP BY 1, 2),
  raw AS (SELECT term, ln((SELECT n FROM st) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM post GROUP BY term),
  idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
  q AS (SELECT DISTINCT query_id, term FROM (SELECT doc_id AS query_id, unnest(list_filter({_TERMS.format('title')}, lambda x: length(x) >= 2)) AS term FROM documents WHERE doc_id % 50 = 0 AND title IS NOT NULL)),
  sp AS (SELECT query_id, doc AS doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.5 + 0.5 * dl / (SELECT av FROM st)))), 6) AS score FROM q JOIN idf USING (term) JOIN post USING (term) JOIN len USING (doc) GROUP BY 1, 2),
  sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sp WHERE score > 0)"""
_DENSE_SQL = """
  dn AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0),
  dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dn)"""


def _type_sql(col: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({col}, '(?i){p}') THEN '{n}'" for n, p in (("drug", DRUG_QUESTION), ("definition", DEFINITION_QUESTION), ("symptom", SYMPTOM_QUESTION), ("comparison", COMPARISON_QUESTION)))
    return f"CASE {cases} ELSE 'default' END"


_HYBRID_SQL = f"""WITH {_BM25_SQL}, {_DENSE_SQL},
  kind AS (SELECT doc_id AS query_id, {_type_sql('title')} AS query_type FROM documents WHERE doc_id % 50 = 0 AND title IS NOT NULL),
  w AS (SELECT * FROM (VALUES ('drug', 0.45, 0.55), ('definition', 0.8, 0.2), ('symptom', 0.65, 0.35), ('comparison', 0.8, 0.2), ('default', 0.7, 0.3)) v(query_type, dw, sw)),
  lists AS (SELECT query_id, doc_id, rank, query_type, sw::DOUBLE AS weight FROM sparse JOIN kind USING (query_id) JOIN w USING (query_type) WHERE rank <= 20
    UNION ALL SELECT query_id, doc_id, rank, query_type, dw::DOUBLE FROM dense JOIN kind USING (query_id) JOIN w USING (query_type) WHERE rank <= 20),
  f AS (SELECT query_id, query_type, doc_id, round(sum(weight / (60 + rank)), 9) AS s FROM lists GROUP BY ALL),
  top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM f)"""


@query(f"WITH {_BM25_SQL} SELECT query_id, doc_id, score, rank::INT AS rank FROM sparse WHERE rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Titles of every fiftieth document searched in all texts."""
    return R.bm25(table(spark, d, "documents"), "doc_id", "text", _titles(spark, d), 10)


@query(f"WITH {_DENSE_SQL} SELECT query_id, doc_id, score, rank::INT AS rank FROM dense WHERE rank <= 10")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth vector searched among all vectors."""
    return R.dense(table(spark, d, "embeddings"), _asked_vectors(spark, d), k=10)


@query(f"{_HYBRID_SQL} SELECT query_id, query_type, doc_id, round(least(s * 61 / 2, 1.0), 6) AS score, rank::INT AS rank FROM top WHERE rank <= 10")
def hybrid_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """Both searches fused with weights by question type; vector ids stand for document ids."""
    asked = _titles(spark, d).join(_asked_vectors(spark, d), "query_id", "left")
    return R.hybrid(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "embeddings"), asked)


@query(f"""{_HYBRID_SQL} SELECT query_id, doc_id, rank::INT AS rank, (CASE WHEN n < 3 OR rank = 1 THEN rank WHEN rank = 2 THEN n ELSE rank - 1 END)::INT AS position
  FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM top WHERE rank <= 10)""")
def lost_in_middle(spark: SparkSession, d: str) -> DataFrame:
    """Hits reordered so that the best come first and last."""
    from pyspark.sql import Window

    hits = hybrid_retrieve(spark, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    return hits.select("query_id", "doc_id", "rank", R.best_to_the_edges(F.col("rank"), F.col("n").cast("int")).alias("position"))


@query(f"""WITH {_BM25_SQL}, {_DENSE_SQL}, w AS (SELECT * FROM (VALUES (1, 0.9, 0.1), (2, 0.7, 0.3), (3, 0.5, 0.5), (4, 0.3, 0.7)) v(setting, dw, sw)),
  lists AS (SELECT setting, query_id, doc_id, rank, sw::DOUBLE AS weight FROM sparse, w WHERE rank <= 20 UNION ALL SELECT setting, query_id, doc_id, rank, dw::DOUBLE FROM dense, w WHERE rank <= 20),
  f AS (SELECT setting, query_id, doc_id, round(sum(weight / (60 + rank)), 9) AS s FROM lists GROUP BY ALL),
  top AS (SELECT *, row_number() OVER (PARTITION BY setting, query_id ORDER BY s DESC, doc_id) AS rank FROM f)
  SELECT setting, count(*) AS hits, count(CASE WHEN q.label = x.label THEN 1 END) AS same_label FROM top LEFT JOIN embeddings q ON q.vec_id = query_id LEFT JOIN embeddings x ON x.vec_id = doc_id WHERE rank <= 10 GROUP BY setting""")
def weight_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Four pairs of weights over one run of both searches; hits with the question's label."""
    docs, vectors = table(spark, d, "documents"), table(spark, d, "embeddings")
    w = spark.createDataFrame([(1, 0.9, 0.1), (2, 0.7, 0.3), (3, 0.5, 0.5), (4, 0.3, 0.7)], "setting int, dw double, sw double")
    sparse = R.bm25(docs, "doc_id", "text", _titles(spark, d), 20).withColumn("dense", F.lit(False))
    close = R.dense(vectors, _asked_vectors(spark, d), k=20).withColumn("dense", F.lit(True))
    lists = sparse.unionByName(close).crossJoin(F.broadcast(w)).select("setting", F.struct("setting", "query_id").alias("g"), "query_id", "doc_id", "rank", F.when(F.col("dense"), F.col("dw")).otherwise(F.col("sw")).alias("weight"))
    fused = lists.groupBy("g", "doc_id").agg(F.round(F.sum(F.col("weight") / (60 + F.col("rank"))), 9).alias("score"))
    top = R.top_k(fused, "g", "score", "doc_id", 10).select("g.setting", "g.query_id", "doc_id")
    labels = vectors.select(F.col("vec_id").alias("doc_id"), "label")
    out = top.join(labels, "doc_id", "left").join(labels.select(F.col("doc_id").alias("query_id"), F.col("label").alias("ql")), "query_id", "left")
    return out.groupBy("setting").agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("label") == F.col("ql")).alias("same_label"))


@query(f"SELECT query_type, count(*) AS n FROM (SELECT {_type_sql('question')} AS query_type FROM response_trajectory) GROUP BY 1")
def query_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "response_trajectory").groupBy(R.question_type(F.col("question")).alias("query_type")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT response_id, received_at, pos, round(s, 6) AS score, round(greatest(0, least(1, s)), 6) AS cosine, round(least(s * 61 / 2, 1.0), 6) AS rrf, round(1 / (1 + exp(-greatest(-60, least(60, s)))), 6) AS reranker
  FROM (SELECT response_id, received_at, unnest(retrieval.scores) AS s, (generate_subscripts(retrieval.scores, 1) - 1)::INT AS pos FROM response_trajectory)""")
def score_normalize(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "response_trajectory").select("response_id", "received_at", F.posexplode("retrieval.scores").alias("pos", "s"))
    return t.select("response_id", "received_at", "pos", F.round("s", 6).alias("score"), *(F.round(R.normalised(F.col("s"), b), 6).alias(b) for b in ("cosine", "rrf", "reranker")))


@query(r"""SELECT parent_id, chunk_pk, flagged, row_number() OVER (PARTITION BY parent_id ORDER BY flagged, chunk_id, chunk_pk)::INT AS place FROM
  (SELECT *, coalesce(regexp_matches(lower(content), '\bhow\s+to\s+(?:make|synthesize|produce|create)\s+\w+\s+(?:drug|poison|explosive)') OR regexp_matches(lower(content), '\bself[- ]harm\b') OR regexp_matches(lower(content), '\b(?:illegal|illicit)\s+drug\s+(?:synthesis|recipe|formula)'), false) AS flagged FROM kb_chunk WHERE parent_id IS NOT NULL)""")
def safety_partition(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a parent with flagged ones behind all others; places by blocks of the order."""
    k = table(spark, d, "kb_chunk").where("parent_id is not null").select("parent_id", "chunk_pk", "chunk_id", R.is_flagged(F.col("content")).alias("flagged"))
    placed = running_sum(k, "parent_id", ["flagged", "chunk_id"], ["chunk_id", "chunk_pk"], F.lit(1), "place")
    return placed.select("parent_id", "chunk_pk", "flagged", F.col("place").cast("int").alias("place"))


@query(f"""WITH {_DENSE_SQL}, lists AS (SELECT q.label, doc_id, rank FROM dense JOIN embeddings q ON q.vec_id = query_id WHERE rank <= 20),
  f AS (SELECT label, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS s FROM lists GROUP BY ALL)
  SELECT query_id, doc_id, round(s, 9) AS score, rank::INT AS rank FROM (SELECT label AS query_id, doc_id, s, row_number() OVER (PARTITION BY label ORDER BY s DESC, doc_id) AS rank FROM f) WHERE rank <= 10""")
def multi_query_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Several vectors of one label as variants of one question, their rankings fused."""
    v = table(spark, d, "embeddings")
    hits = R.dense(v, _asked_vectors(spark, d), k=20)
    named = hits.join(v.select(F.col("vec_id").alias("query_id"), "label"), "query_id").select(F.col("label").alias("query_id"), "doc_id", "rank", F.lit(1.0).alias("weight"))
    return R.fuse(named, 10).select("query_id", "doc_id", "score", "rank")


@query()
def mmr_diversity(spark: SparkSession, d: str) -> DataFrame:
    """Five diverse hits of the twenty nearest to each question."""
    v = table(spark, d, "embeddings")
    hits = R.dense(v, _asked_vectors(spark, d), k=20).join(v.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    return R.diverse(hits.select("query_id", "doc_id", "score", "embedding"), 5)


@query(f"""WITH {_DENSE_SQL} SELECT DISTINCT doc_id AS vec_id, e.label, list_transform(e.embedding, lambda x: round(x::DOUBLE, 6)) AS embedding FROM dense JOIN embeddings e ON e.vec_id = doc_id WHERE rank <= 15""")
def kb_subset(spark: SparkSession, d: str) -> DataFrame:
    """Vectors among the fifteen nearest of any question, whole and rounded to six places, for a small export."""
    v = table(spark, d, "embeddings")
    ids = R.dense(v, _asked_vectors(spark, d), k=15).select(F.col("doc_id").alias("vec_id")).distinct()
    return v.join(ids, "vec_id", "left_semi").select("vec_id", "label", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("embedding"))


@query(f"""WITH {_DENSE_SQL} SELECT DISTINCT doc_id AS vec_id, e.label, list_transform(e.embedding, lambda x: round(x::DOUBLE, 6)) AS embedding FROM dense JOIN embeddings e ON e.vec_id = doc_id WHERE rank <= 15""")
def kb_subset_whole(spark: SparkSession, d: str) -> DataFrame:
    """The same rows by the name that they had before."""
    return kb_subset(spark, d)
