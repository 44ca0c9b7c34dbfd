"""Every operator over tables with extra columns of clashing names, nulls in any column, repeated rows, and
empty side tables."""

import pytest
from pyspark.sql import functions as F

from heronlake.llm import cutting, leaks, mixing, packing, pairs, pii, sentences, splits
from heronlake.llm.common import table

#: Names that the operators give columns of their own.
CLASHING = "key n unit split kind session question answer alone at node root lead block defect ending whole units length score finished term doc rank share test_id run text piece_no piece_start piece_end max_chars overlap_chars chunk_id own pieces tokens size bin weight capacity container pack_name source_clean slot lang sent_start sent_end sentence redacted pii_types value u v m _key _salt _n _w".split()

RUNS = {
    "splits": (("user_feedback", "split_share"), lambda f, s: splits.assign_splits(f, s), ["feedback_id", "session_id", "question_id", "split"]),
    "pairs": (("qa_pair", "ragas_standard_tinyllama_10"), lambda a, b: pairs.broken_pairs(pairs.pairs_of(a, b)), ["src_table", "pair_key", "defect"]),
    "leaks": (("kb_chunk", "test_set_eval30"), leaks.leaked_passages, ["chunk_pk", "test_id"]),
    "near": (("kb_chunk", "test_set_eval30"), leaks.near_passages, ["chunk_pk", "test_id"]),
    "cutting": (("kb_chunk", "chunk_limit"), cutting.cut_items, ["chunk_pk", "piece_no", "piece_start", "piece_end", "total_chunks"]),
    "pii": (("user_feedback", "given_name"), lambda f, g: pii.with_pii(f, "feedback_text", g, "secret"), ["feedback_id", "redacted", "pii_types"]),
    "packing": (("documents", "pack_size"), packing.pack, None),
    "mixing": (("documents", "mix_target"), mixing.mix, None),
    "sentences": (("documents",), sentences.sentence_units, ["doc_id", "sent_start", "sent_end"]),
}


def extended(df):
    there = {c.lower() for c in df.columns}
    return df.select("*", *[F.lit(i % 7).alias(c) for i, c in enumerate(CLASHING) if c not in there])


def rows_of(df, cols):
    cols = cols or sorted(df.columns)
    return sorted(map(str, df.select(*cols).collect()))


@pytest.mark.parametrize("name", RUNS)
def test_extra_columns_change_nothing(spark, data, name):
    names, run, cols = RUNS[name]
    tables = [table(spark, data, n) for n in names]
    plain = run(*tables)
    cols = cols or sorted(plain.columns)
    assert rows_of(run(*[extended(t) for t in tables]), cols) == rows_of(plain, cols)


@pytest.mark.parametrize("name", ["splits", "pii"])
def test_extra_columns_come_through(spark, data, name):
    names, run, _ = RUNS[name]
    wide = [extended(table(spark, data, n)) for n in names]
    made = {"splits": {"split"}, "pii": {"redacted", "pii_types"}}[name]
    got = run(*wide)
    assert set(got.columns) == set(wide[0].columns) | made
    kept = [c for c in CLASHING if c in wide[0].columns and c not in made]
    assert got.select(*kept).distinct().collect() == wide[0].select(*kept).distinct().collect()


def test_extra_columns_come_through_beside_hot_keys(spark, data):
    wide, shares = extended(table(spark, data, "user_feedback")), table(spark, data, "split_share")
    got = splits.assign_splits(wide, shares, heavy_rows=20)
    assert got.count() == wide.count() and set(got.columns) == set(wide.columns) | {"split"}
    assert got.select("_key", "_salt").distinct().collect() == wide.select("_key", "_salt").distinct().collect()


@pytest.mark.parametrize("name", RUNS)
def test_nulls_anywhere_and_repeated_rows(spark, data, name):
    names, run, _ = RUNS[name]
    tables = [table(spark, data, n) for n in names]
    first = tables[0]
    # each column is null in its own fifth of the rows, one row is null throughout, and rows stand twice
    holed = first.select(*[F.when(F.pmod(F.xxhash64(F.lit(c), *[x for x, t in first.dtypes if not t.startswith("map")]), F.lit(5)) != 0, F.col(c)).alias(c) for c in first.columns])
    nothing = spark.createDataFrame([tuple(None for _ in first.columns)], first.schema)
    holed = holed.union(nothing).union(holed.where(F.xxhash64(first.columns[0]) % 3 == 0))
    got = run(holed, *tables[1:])
    n = got.count()
    assert n >= 0 and (name not in ("splits", "pii") or n == holed.count())


@pytest.mark.parametrize("name", [n for n in RUNS if n not in ("splits", "sentences")])
def test_empty_side_tables(spark, data, name):
    names, run, _ = RUNS[name]
    first, *side = [table(spark, data, n) for n in names]
    try:
        got = run(first, *[s.limit(0) for s in side]).count()
    except ValueError:
        assert name == "cutting"  # without any limit nothing says what is too long
    else:
        assert name in ("pairs", "pii") or got == 0
    assert run(first.limit(0), *side).count() == (0 if name != "pairs" else pairs.pairs_of(first.limit(0), *side).count())
