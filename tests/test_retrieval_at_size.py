"""The search keeps on disk neither documents nor pairs of a question and a document."""

import datetime
import os
import random
from collections import Counter
from math import log
from types import SimpleNamespace

import pyarrow as pa
import pytest

from heronlake.operators import retrieval as R
from heronlake.plans import catalogue

WORDS = [f"word{i}" for i in range(400)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """3,000 documents with 200 words each, 60 questions with six titles, and their bytes."""
    r, d = random.Random(5), str(tmp_path_factory.mktemp("tables"))
    titles = [" ".join(r.sample(WORDS, 3)) for _ in range(6)]
    rows = [(i, " ".join(r.choices(WORDS, k=200)), "en", r.choice("abc"), r.choice(titles), datetime.datetime(2024, 1, 1)) for i in range(1, 3001)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, title string, ingested_at timestamp").write.parquet(f"{d}/documents.parquet")
    vectors = [(i, [r.random() for _ in range(4)], i % 3) for i in range(1, 301)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d, sum(len(x[1]) for x in rows)


def stored(spark):
    """Bytes shuffled and in the checkpoints so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    shuffled = sum(sc.statusStore().executorList(False).apply(i).totalShuffleWrite() for i in range(sc.statusStore().executorList(False).size()))
    folder = (spark.sparkContext.getCheckpointDir() or "").removeprefix("file:")
    return shuffled + sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files if folder)


@pytest.mark.parametrize("name", ["bm25_topk", "hybrid_retrieve", "lost_in_middle", "weight_sweep", "retrieve_documents", "retrieve_diverse", "gold_relevance", "overlap_relevance", "agreeing_sources", "answerable_questions", "corrective_retrieve"])
def test_disk_is_less_than_the_texts(spark, tables, name):
    data, text_bytes = tables
    before = stored(spark)
    assert catalogue.queries()[name](spark, data).count()
    assert stored(spark) - before < text_bytes / 2


def by_hand(docs, asked, k):
    """BM25 as its definition has it: question to its (doc, score), best first."""
    there = {d: [w for w in t.lower().split() if len(w) >= 2] for d, t in docs}
    df = Counter(w for t in there.values() for w in set(t))
    raw = {w: log(len(there) + 0.5 - n) - log(n + 0.5) for w, n in df.items()}
    mean, length = sum(raw.values()) / len(raw), sum(map(len, there.values())) / len(there)
    out = {}
    for q, words in asked:
        score = {d: round(sum((0.25 * mean if raw[w] < 0 else raw[w]) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.5 + 0.5 * len(t) / length)) for w in sorted(set(words.split())) if w in t), 6) for d, t in there.items()}
        out[q] = sorted(((d, s) for d, s in score.items() if s > 0), key=lambda x: (-x[1], x[0]))[:k]
    return out


def some(n, seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    return [(i, " ".join(r.choices(words, range(1, 31), k=r.randint(0, 25)))) for i in range(n)], [(i, " ".join(r.choices(words, k=3))) for i in range(25)]


def test_questions_in_turns_and_repeated(spark, monkeypatch):
    docs, asked = some(300)
    asked += [(q + 100, " ".join(reversed(words.split()))) for q, words in asked]
    monkeypatch.setattr(R, "BROADCAST_ROWS", 20)  # several turns, and no join by broadcast
    got = {}
    for x in R.bm25(spark.createDataFrame(docs, "id long, t string"), "id", "t", spark.createDataFrame(asked, "query_id long, query string"), 4).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.doc_id, x.score))
    want = {q: hits for q, hits in by_hand(docs, asked, 4).items() if hits}
    assert {q: [d for d, _ in h] for q, h in got.items()} == {q: [d for d, _ in h] for q, h in want.items()}
    assert all(abs(a[1] - b[1]) < 2e-6 for q in want for a, b in zip(got[q], want[q]))


@pytest.mark.parametrize("portion, pairs", [(1, 1), (40, 3), (500, 50), (10**7, 10**7)])
def test_a_task_finds_the_best_whatever_it_holds_at_a_time(monkeypatch, portion, pairs):
    docs, asked = some(120)
    monkeypatch.setattr(R, "PORTION_BYTES", portion)
    monkeypatch.setattr(R, "PAIRS", pairs)
    df = Counter(w for _, t in docs for w in set(t.split()))
    raw = {w: log(len(docs) + 0.5 - n) - log(n + 0.5) for w, n in df.items()}
    idf = {w: 0.25 * sum(raw.values()) / len(raw) if x < 0 else x for w, x in raw.items()}
    rows = [(q, w, idf[w]) for q, words in asked for w in sorted(set(words.split())) if w in idf]
    sent = SimpleNamespace(value=R._postings(pa.table({"_set": [x[0] for x in rows], "term": [x[1] for x in rows], "idf": [x[2] for x in rows]})))
    batches = [pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs[i : i + 50]]), pa.array([t for _, t in docs[i : i + 50]])], ["doc_id", "t"]) for i in range(0, 120, 50)]
    got = {}
    for b in R._scorer(sent, sum(len(t.split()) for _, t in docs) / len(docs), 5)(iter(batches)):
        for x in b.to_pylist():
            got.setdefault(x["_set"], []).append(x["doc_id"])
    assert got == {q: [d for d, _ in hits] for q, hits in by_hand(docs, asked, 5).items() if hits}
