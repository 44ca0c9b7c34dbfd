import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heronlake.llm import mixing as M
from heronlake.llm import packing as P
from heronlake.llm import tokens as T

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(T.VOCABULARY), reason="no vocabulary file")
DOCS = "doc_id long, text string, source string, tokens int, container int"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_packing_is_whole_and_fits(sizes):
    boxes = P.best_two_fit(sizes, 50)
    assert sorted(i for b in boxes for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 50 for b in boxes)
    # never worse than twice the least number of containers
    assert len(boxes) <= 2 * max(1, -(-sum(sizes) // 50)) if sizes else not boxes


def test_two_for_one():
    # greedy would take 6 and then 3 (gap 1); two items of 2 fill the container instead
    sizes = [6, 3, 2, 2]
    assert [sorted(sizes[i] for i in b) for b in P.best_two_fit(sizes, 10)] == [[2, 2, 6], [3]]


def docs(spark):
    rows = [(i, "health text number %d. " % i * (1 + i % 40), [" Big", "big", "small", None, "other"][i % 5], 7, 7) for i in range(300)]
    return spark.createDataFrame([*rows, (900, None, "big", 1, 1), (901, "", "small", 1, 1), (902, "long " * 5000, "big", 1, 1), (1, rows[1][1], "big", 1, 1)], DOCS)


def test_pack_table(spark):
    d = docs(spark)
    packs = spark.createDataFrame([("s", 64), ("m", 256), ("none", 0)], "pack_name string, capacity_tokens int")
    got = P.pack(d, packs, shard_pieces=150)
    count = {r.doc_id: r.n for r in d.select("doc_id", T.token_count(F.col("text")).alias("n")).collect()}
    for name, cap in (("s", 64), ("m", 256)):
        mine = got.where(F.col("pack_name") == name).collect()
        boxes, upto = {}, {}
        for r in mine:
            boxes[r.shard, r.container] = boxes.get((r.shard, r.container), 0) + r.tokens
            upto.setdefault(r.doc_id, []).append((r.token_start, r.token_end))
        assert max(boxes.values()) <= cap and set(upto) == set(count)
        for k, parts in upto.items():
            if k != 1:
                parts.sort()
                assert parts[0][0] == 0 and parts[-1][1] == count[k] and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
                assert len(parts) == max(1, -(-count[k] // cap))
    filled = {r.pack_name: r.filled for r in P.pack_report(got).collect()}
    assert all(v > 0.9 for v in filled.values())
    assert P.pack(d.limit(0), packs).count() == 0


def test_permutation():
    for n in (1, 2, 7, 100, 1000):
        got = M.permuted(np.arange(n), np.full(n, n), np.full(n, 5))
        assert sorted(got) == list(range(n))
    assert list(M.permuted(np.arange(100), np.full(100, 100), np.full(100, 5))) != list(M.permuted(np.arange(100), np.full(100, 100), np.full(100, 6)))


def test_draws_keep_totals():
    wanted = {"a": 5000, "b": 700, "c": 3}
    got = M.draw_counts(wanted, 3)
    assert len(got) > 2 and {s: sum(g.get(s, 0) for g in got) for s in wanted} == wanted


@pytest.mark.parametrize("size", [3, 1_000, 2_000_000_000])
def test_draws_of_any_size_are_whole(size):
    wanted = {"a": 5 * size, "b": size, "c": 7, "d": 0}
    got = M.draw_counts(wanted, 8)
    assert {s: sum(g.get(s, 0) for g in got) for s in wanted} == wanted
    sizes = [sum(g.values()) for g in got]
    assert max(sizes) - min(sizes) <= 1
    if size > 10**6:
        first = [g["b"] / sum(g.values()) for g in got]
        assert max(abs(x - 1 / 6) for x in first) < 0.01 and len(set(first)) > len(first) / 2


def test_draws_are_hypergeometric():
    rng = np.random.default_rng(5)
    got = np.bincount([M.hypergeometric(rng, 12, 20, 9) for _ in range(40_000)], minlength=10) / 40_000
    from math import comb

    assert np.abs(got - [comb(12, k) * comb(20, 9 - k) / comb(32, 9) for k in range(10)]).max() < 0.01


def test_shares_are_exact_by_default():
    supply = {"a": (25_600, 100), "b": (25_600, 100), "c": (2_560_000, 10_000)}
    got = M.plan_totals(supply, {"a": (0.16, 1), "b": (0.04, 2), "c": (0.8, 1)}, None, 256, 0.0)
    assert got == {"a": 100, "b": 25, "c": 500}


def test_mix_table(spark):
    d = docs(spark)
    goal = spark.createDataFrame([("Big", 0.5, 1), ("Small", 0.4, 3), ("Absent", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = M.mix(d, goal, block=32)
    uses = mixed.groupBy("source", "block").agg(F.count_distinct("slot").alias("n")).groupBy("source").agg(F.max("n").alias("n")).collect()
    assert all(r.n <= {"Big": 1, "Small": 3}[r.source] for r in uses)
    assert mixed.groupBy("source", "slot").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("n")).agg(F.max("n")).first()[0] <= 32
    share = {r.source: r.share for r in M.mix_report(mixed, goal).collect()}
    assert abs(share["Big"] - 5 / 9) < 0.06 and abs(share["Small"] - 4 / 9) < 0.06 and share["Absent"] == 0
    assert M.mix(d.limit(0), goal).count() == 0
    segments = M.source_blocks(d, goal, block=32)
    whole = d.select("doc_id", F.lower(F.trim("source")).alias("s"), T.token_count(F.col("text")).alias("n")).where("s in ('big', 'small')").agg(F.sum("n")).first()[0]
    assert segments.agg(F.sum(F.col("token_end") - F.col("token_start"))).first()[0] == whole
