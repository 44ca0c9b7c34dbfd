import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heronlake.llm import cutting as C

LIMITS = [("pubmedqa", 110, 9), ("default", 170, 10)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,\n!é́👩‍😀文。", max_size=400), st.integers(12, 60), st.integers(0, 11))
def test_pieces_cover_overlap_and_fit(text, largest, overlap):
    parts = C.cut_text(text, largest, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    for (a, b), (c, d) in zip(parts, parts[1:]):
        assert a < c <= b and d > b and b - c >= overlap
    assert all(b - a <= largest for a, b in parts)


def full_dp(text, largest, overlap):
    """Cost of the cheapest pieces over every place, one pair of places at a time."""
    at, cost = C.places(text, largest - overlap)
    ends, price = [*map(int, at), len(text)], [*cost, 0.0]
    count = -(-(len(text) - overlap) // (largest - overlap))
    even = min(largest, (len(text) - overlap) / count + overlap)
    total = []
    for i, e in enumerate(ends):
        ways = [price[i] + C.IMBALANCE * ((e - even) / largest) ** 2] if e <= largest else []
        for j in range(i):
            size = e - max(0, ends[j] - overlap)
            if size <= largest:
                ways.append(total[j] + price[i] + C.JOIN + C.IMBALANCE * ((size - even) / largest) ** 2)
        total.append(min(ways, default=float("inf")))
    return total[-1], even


def test_as_cheap_as_over_all_places():
    import random

    rng = random.Random(11)
    for _ in range(3000):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice((1, 3, 5, 8, 30)))) + rng.choice(("", "", "", "", ",", ".", ".", "\n", "\n\n")) for _ in range(rng.randrange(4, 36))]
        text, largest = " ".join(words), rng.randrange(20, 130)
        overlap = rng.randrange(largest)
        if len(text) > largest:
            want, even = full_dp(text, largest, overlap)
            parts = C.cut_text(text, largest, overlap)
            if want == float("inf"):
                continue
            price = dict(zip(*map(list, C.places(text, largest - overlap))))
            got = sum(C.IMBALANCE * ((b - a - even) / largest) ** 2 for a, b in parts) + sum(price[b] + C.JOIN for _, b in parts[:-1])
            assert got == pytest.approx(want, abs=1e-9), (text, largest, overlap)


def test_a_wide_overlap_is_honoured():
    parts = C.cut_text("t" * 49 + " " + "u" * 40, 50, 40)
    assert all(b - c == 40 for (_, b), (c, _) in zip(parts, parts[1:])) and len(parts) > 2
    with pytest.raises(ValueError):
        C.cut_text("t" * 99, 50, 50)


def test_many_limits(spark):
    schema = "source_kind string, max_chars int, overlap_chars int"
    rows = [(f"kind{i}x", 100 + i, 1) for i in range(C.MAX_KINDS - 1)] + [("default", 5000, 2)]
    df = spark.createDataFrame([(1, "p", "y" * 6000, " KIND9000X more", 0, 1), (2, "p", "y" * 6000, None, 1, 1)], "chunk_pk long, parent_id string, content string, source string, chunk_id int, total_chunks int")
    got = {r.chunk_pk: r.n for r in C.cut_items(df, spark.createDataFrame(rows, schema)).selectExpr("chunk_pk", "piece_end - piece_start as n").groupBy("chunk_pk").max("n").toDF("chunk_pk", "n").collect()}
    assert got[1] <= 9100 and got[2] <= 5000
    with pytest.raises(ValueError):
        C.limits_of(spark.createDataFrame([*rows, ("one more", 9, 1)], schema))
    with pytest.raises(ValueError):
        C.limits_of(spark.createDataFrame([("default", 9, 9)], schema))


def test_natural_cuts_are_taken():
    text = ("One short sentence here. " * 12 + "\n\n" + "Another short sentence. " * 12).strip()
    parts = C.cut_text(text, 320, 20)
    assert len(parts) == 2 and text[: parts[0][1]].endswith("here. \n\n")


def test_no_overlap_needed_and_exact_limit():
    assert C.cut_text("x" * 50, 50, 5) == [(0, 50)]
    assert C.cut_text("x" * 51, 50, 0)[-1][1] == 51
    with pytest.raises(ValueError):
        C.cut_text("abc", 0, 0)


def test_table(spark):
    long = "A sentence of some length ends here. " * 30
    rows = [
        (1, "p", long, " PubMedQA", 0, 9, 5), (2, "p", "short", "pubmedqa", 1, None, 5), (2, "p", "short", "pubmedqa", 1, None, 5), (3, "p", None, None, None, 0, 5),
        (4, None, long, None, 0, 1, 5), (5, None, "", "x", None, None, None), (6, "big", "x" * 20000, "other", 0, 1, 1),
    ]
    df = spark.createDataFrame(rows, "chunk_pk long, parent_id string, content string, source string, chunk_id int, total_chunks int, piece_no int")
    lim = spark.createDataFrame(LIMITS, "source_kind string, max_chars int, overlap_chars int")
    got = C.cut_items(df, lim).collect()
    assert {r.chunk_pk for r in got if r.oversized} == {1, 4, 6}
    for r in got:
        assert r.content is None or len(r.content) <= (110 if (r.source or "").strip().lower() == "pubmedqa" else 170)
    for p in ("p", "big"):
        mine = [r for r in got if r.parent_id == p]
        assert sorted(r.chunk_id for r in mine) == list(range(len(mine))) and {r.total_chunks for r in mine} == {len(mine)}
    assert [r.chunk_id for r in got if r.chunk_pk == 5] == [0]
    mine = sorted((r for r in got if r.chunk_pk == 1), key=lambda r: r.piece_no)
    assert mine[0].content + "".join(b.content[a.piece_end - b.piece_start :] for a, b in zip(mine, mine[1:])) == long
    assert all(a.piece_end - b.piece_start == 9 for a, b in zip(mine, mine[1:]))
    assert C.cut_items(df.limit(0), lim).count() == 0
