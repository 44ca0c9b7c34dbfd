"""Judgements on small tables with nulls, ties and repeated rows."""

import re
import unicodedata

from pyspark.sql import functions as F

from heronlake.functions.text import marked_sentences, unveiled
from heronlake.operators import judging as J
from heronlake.operators import retrieval as R
from heronlake.operators import scoring as C
from heronlake.operators.chunking import word_windows


def test_gold_marks(spark):
    rows = [
        (1, "a", "web", "fever and rash", ["a"], None, None), (2, "a", "Web/X", "fever", ["b"], ["web"], None), (3, "a", None, "Fever and RASH", None, ["web"], ["fever", "rash", "cough", "pain"]),
        (4, "a", "s", "fever", None, None, ["fever", "rash", "cough", "pain"]), (5, "a", "s", "fever", None, None, ["Fever"]), (6, "a", "s", None, None, None, ["fever"]),
        (7, None, None, None, None, None, None), (8, "a", "s", "x", [], [], []), (9, "a", "s", "rash", None, None, ["fever", "rash", "cough"]),
    ]
    df = spark.createDataFrame(rows, "i int, doc string, source string, content string, ids array<string>, sources array<string>, words array<string>")
    got = df.select("i", J.matches_gold(*[F.col(c) for c in ("doc", "source", "content", "ids", "sources", "words")]).alias("m")).collect()
    assert {r.i for r in got if r.m} == {1, 2, 3, 5, 9} and all(r.m is not None for r in got)


def test_relevance_by_overlap_and_agreement(spark):
    hits = spark.createDataFrame([(1, 10, 1, "rest and water"), (1, 11, 2, "Plenty of water helps fever a lot"), (2, 12, 2, "nothing"), (2, 13, 3, None), (3, 14, 1, "x"), (9, 15, 1, "y")], "query_id int, doc_id int, rank int, text string")
    answers = spark.createDataFrame([(1, "Water helps fever fever"), (2, "Plenty water"), (3, "a b c"), (4, None), (5, "")], "query_id int, answer string")
    got = {(r.query_id, r.doc_id): r.relevant for r in J.overlap_relevance(hits, answers, "text").collect()}
    assert got == {(1, 10): 0, (1, 11): 1, (2, 12): 1, (2, 13): 0}
    assert {r.query_id: (r.hits, r.agreement) for r in J.agreeing_sources(hits, answers, "text").collect()} == {1: (2, 1.0), 2: (2, 0.0), 3: (1, 0.0)}
    assert J.overlap_relevance(hits.limit(0), answers, "text").count() == 0 and J.agreeing_sources(hits, answers.limit(0), "text").count() == 0


def test_agreement_of_annotators_takes_the_last_judgement(spark):
    rows = [("q1", "x", 1, True), ("q1", "x", 2, False), ("q1", "x", 2, False), ("q1", "y", 1, False), ("q2", "x", 1, True), ("q2", "y", 1, True), ("q3", "x", 1, True), ("q3", "y", 1, None), (None, "x", 1, True), ("q4", None, 1, True), ("q5", "z", 1, True)]
    df = spark.createDataFrame(rows, "q string, a string, t int, ok boolean")
    got = J.annotator_agreement(df, "q", "a", ["ok"], ["t"]).collect()
    assert [(r.pair, r.dimension, r.n, r.agreement, r.kappa) for r in got] == [("x_vs_y", "ok", 2, 1.0, 1.0)]
    assert J.annotator_agreement(df.limit(0), "q", "a", ["ok"], ["t"]).count() == 0


def test_keywords_and_ratings(spark):
    df = spark.createDataFrame([(["The", "ox", " in ", "fever", None, "fever"], True, None, False), ([], None, None, None), (None, True, True, False)], "k array<string>, a boolean, b boolean, c boolean")
    got = df.select(J.kept_keywords(F.col("k")).alias("k"), J.rating_of_flags("a", "b", "c").alias("r")).collect()
    assert [(r.k, r.r) for r in got] == [(["fever", "fever"], 3), ([], None), (None, 4)]


def test_pooled_vectors(spark):
    rows = [("g", [3.0, 0.0], 1), ("g", [0.0, 4.0], 1), ("g", [9.0, 9.0], 0), ("g", None, 1), ("g", [9.0, 9.0], None), ("zero", [0.0, 0.0], 1), ("none", [1.0, 1.0], 0), (None, [0.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "g string, v array<double>, m int")
    got = {(r.g, r.place): round(r.value, 6) for r in J.mean_pool(df, "g", "v", "m").collect()}
    assert got == {("g", 0): 0.6, ("g", 1): 0.8, ("zero", 0): 0.0, ("zero", 1): 0.0, (None, 0): 0.0, (None, 1): 1.0}
    assert J.mean_pool(df.limit(0), "g", "v").count() == 0


def test_windows_to_the_last_word(spark):
    words = [f"w{i}" for i in range(25)]
    df = spark.createDataFrame([(1, " ".join(words), "x"), (2, " two  words ", "x"), (3, "", "x"), (4, None, "x"), (5, " ".join(words[:10]), "x")], "id int, text string, chunk_id string")
    got = {(r.id, r.chunk_id): r.chunk for r in word_windows(df, "id", "text", 10, 2, to_last_word=True).collect()}
    want = {(1, n + 1): " ".join(words[i : i + 10]) for n, i in enumerate(range(0, 25, 8))}
    assert got == {**want, (2, 1): " two  words ", (3, 1): "", (5, 1): " ".join(words[:10])}


def test_sentences_and_citations(spark):
    text = "Dr. Ames gave 5 mg. twice a day!! Short one. It helped i.e. the fever fell"
    df = spark.createDataFrame([(text, None), ("As shown (Smith et al., 2023) and published in Nature, doi:10.12345 says so, according to a recent study.", "SMITH (smith et al., 2023) wrote"), (None, "x")], "a string, c string")
    got = df.select(marked_sentences(F.col("a")).alias("s"), C.unfounded_citations(F.col("a"), F.col("c")).alias("u")).collect()
    assert got[0].s == ["Dr. Ames gave 5 mg. twice a day", "It helped i.e. the fever fell"] and got[0].u == []
    assert got[1].u == ["according to a recent study", "published in N", "doi:10.12345"]
    assert got[2].s is None and got[2].u is None


def test_cause_needs_a_cause(spark):
    hits = spark.createDataFrame([(1, 2.0, "fever comes and goes"), (2, 2.0, "fever due to malaria"), (3, 2.0, "fever comes and goes"), (4, 2.0, None)], "query_id int, score double, text string")
    asked = spark.createDataFrame([(1, "What causes fever?"), (2, "What causes fever?"), (3, "fever relief"), (4, "fever"), (5, None)], "query_id int, query string")
    assert {r.query_id for r in C.answerable_hits(hits, asked, "text").collect() if r.answerable} == {2, 3}


def test_unveiled_as_in_python(spark):
    texts = ["ｉｇｎｏｒｅ　all", "a​b﻿c ‍ d", "é ﬁ ½", "plain  \t\n text", " x\x85y\x1cz\xa0", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")

    def want(t):
        return None if t is None else re.sub("[​‌‍﻿]", "", re.sub(r"\s+", " ", unicodedata.normalize("NFKD", t)))

    assert [r.p for r in df.select(unveiled(F.col("t")).alias("p")).collect()] == [want(t) for t in texts]


def test_models_of_the_caller(spark):
    def embedder():
        def embed(texts):
            assert 0 < len(texts) <= 3
            return [(len(t), t.count("a")) for t in texts]

        return embed

    df = spark.createDataFrame([(i, "a" * i if i % 4 else None, "x") for i in range(20)], "i int, t string, embedding_of string").repartition(2)
    got = {r.i: r.embedding for r in R.embedded(df, "t", embedder, batch=3).collect()}
    assert got == {i: [float(i), float(i)] if i % 4 else None for i in range(20)}
    assert R.embedded(df.limit(0), "t", embedder).count() == 0

    def reranker():
        return lambda pairs: [len(set(q.split()) & set(t.split())) for q, t in pairs]

    hits = spark.createDataFrame([(1, 10, "fever"), (1, 11, "rest and fever"), (1, 12, None), (1, 13, "rest"), (2, 10, "fever")], "query_id int, doc_id int, text string")
    asked = spark.createDataFrame([(1, "fever and rest"), (2, None)], "query_id int, query string")
    ranked = sorted((r.query_id, r.rank, r.doc_id, r.score) for r in R.reranked(hits, asked, "text", reranker, k=4, batch=2).collect())
    assert ranked == [(1, 1, 11, 3.0), (1, 2, 10, 1.0), (1, 3, 13, 1.0), (1, 4, 12, None), (2, 1, 10, None)]
