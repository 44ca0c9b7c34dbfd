import random

from heronlake.llm import leaks as L

CHUNKS = "chunk_pk long, content string, source string, offset int, item string"
TESTS = "id string, query string, reference_answer string"


def brute(chunks, tests, words=10):
    grams = {}
    for i, *texts in tests:
        for t in texts:
            w = L.words_of(t) if t else []
            for j in range(len(w) - words + 1):
                grams.setdefault(tuple(w[j : j + words]), set()).add(i)
    return {(c[0], i) for c in chunks if c[1] for w in [L.words_of(c[1])] for j in range(len(w) - words + 1) for i in grams.get(tuple(w[j : j + words]), ())}


def make():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    tests = [(f"t{i}", text(rng.randrange(5, 30)), text(rng.randrange(10, 50))) for i in range(25)]
    tests += [("same1", tests[0][1], None), ("same2", "", tests[0][2])]
    chunks = []
    for i in range(150):
        q = rng.choice(tests)
        w = (q[1 + rng.randrange(2)] or "").split()
        n = rng.choice([8, 9, 10, 11, 15])
        a = rng.randrange(max(1, len(w) - n))
        part = w[a : a + n]
        if i % 5 == 0:
            part = [x.upper() for x in part]
        if i % 7 == 0:
            part = [f"<b>{x}</b>," for x in part]
        if i % 11 == 0:
            part = [x[0] + "​" + x[1:] for x in part]
        if i % 13 == 0 and part:
            part[len(part) // 2] = "zzz"
        chunks.append((i, f"{text(rng.randrange(20))} {' '.join(part)} {text(rng.randrange(20))}", "s", 1, "x"))
    return [*chunks, (900, None, None, None, None), (901, "", None, None, None), (902, chunks[3][1] * 40, None, None, None), (903, chunks[3][1], None, None, None)], tests


def test_same_as_brute_force(spark):
    chunks, tests = make()
    c, t = spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(tests, TESTS)
    got = {(r.chunk_pk, r.test_id) for r in L.leaked_passages(c, t).collect()}
    want = brute(chunks, tests)
    assert got == want and len(want) > 40
    near = {(r.chunk_pk, r.test_id) for r in L.near_passages(c, t).collect()}
    whole = {(r.chunk_pk, r.test_id) for r in L.leaked_passages(c, t).where("share >= 0.95").collect()}
    assert whole <= near


def brute_near(chunks, tests, slop=3, words=10):
    """Passages of which four terms in five stand within ``slop`` places of one offset."""
    out = set()
    for pk, content, *_ in chunks:
        c = L.words_of(content)
        for i, *texts in tests:
            for w in (L.words_of(t) for t in texts if t):
                if len(w) >= words and any(5 * sum(x in c[max(0, j + o - slop) : max(0, j + o + slop + 1)] for j, x in enumerate(w)) >= 4 * len(w) for o in range(-len(w), len(c) + 1)):
                    out.add((pk, i))
    return out


def test_near_with_the_rarest_words_altered(spark):
    """Passages of 10 to 30 words, a fifth of them replaced: those looked up first, with the rest drifting."""
    rng = random.Random(9)
    tests, chunks = [], []
    for i in range(24):
        n = (10, 15, 20, 23, 25, 30)[i % 6]
        w = [f"p{i}x{j}" for j in range(n)]
        tests.append((f"t{i}", " ".join(w), None))
        lost = n // 5
        # all but one of the words looked up are altered, so are all of them, or one word too many is
        for k, gone in enumerate((range(lost), range(lost + 1), rng.sample(range(n), lost), range(n - lost, n))):
            part = [f"alt{i}x{j}" if j in set(gone) else x for j, x in enumerate(w)]
            at = rng.randrange(0, n - 3)
            if k == 2:
                part[at:at] = ["and", "so", "on"]
            chunks.append((10 * i + k, " ".join(["front"] * rng.randrange(6) + part + ["back"] * rng.randrange(4)), None, None, None))
        # both words that stand among those looked up drift by three places the same way
        kept = [x if j >= lost else f"alt{i}x{j}" for j, x in enumerate(w)]
        chunks.append((10 * i + 5, " ".join([*kept[: lost + 2], "a", "b", "c", *kept[lost + 2 :]]), None, None, None))
        chunks.append((10 * i + 6, " ".join([*kept[:lost], "a", "b", "c", *kept[lost : lost + 2], *kept[lost + 5 :], *kept[lost + 2 : lost + 5]]), None, None, None))
        # filler in which the last words are common, so that the first ones are looked up
        chunks.append((10 * i + 7, " ; ".join(w[lost:] * 2), None, None, None))
    c, t = spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(tests, TESTS)
    got = {(r.chunk_pk, r.test_id) for r in L.near_passages(c, t).collect()}
    want = brute_near(chunks, tests)
    assert got == want and len(want) > 60


def test_index_holds_every_place(spark):
    """Round trip: every document from its posting lists, whatever the size of the blocks."""
    import numpy as np

    chunks, _ = make()
    chunks = [*chunks, (904, "one two " * 500, None, None, None)]
    df = spark.createDataFrame(chunks, CHUNKS)
    hashed = df.where("content is not null").select("chunk_pk", L.tokens(df.content).alias("w")).selectExpr("chunk_pk", "transform(w, x -> xxhash64(x)) as t").where("size(t) > 0")
    want = sorted((r.chunk_pk, tuple(r.t)) for r in hashed.collect())
    for size in (1, 100, L.BLOCK_WORDS):
        blocks = {}
        for r in L.build_index(df, "chunk_pk", "content", block_words=size).collect():
            blocks.setdefault(r.block, []).append(r)
        got = []
        for rows in blocks.values():
            head = next(r for r in rows if r.term is None)
            places = lambda r: L.unpacked(bytes(r.places), np.array([r.n]))
            begin = places(head)
            at = {int(p): r.term for r in rows if r.term is not None for p in places(r)}
            assert all(len(places(r)) == r.n for r in rows)
            ends = np.append(begin[1:] - L.GAP, max(at) + 1)
            got += [(k, tuple(at[p] for p in range(a, b))) for k, a, b in zip(head.docs, begin, ends)]
        assert sorted(got) == want and (size > 1000 or len(blocks) > 20)


def test_packing_numbers():
    import numpy as np

    steps = np.array([0, 1, 127, 128, 16383, 16384, 5, 2**40, 0])
    raw, size = L.packed(steps)
    assert L.unpacked(raw.tobytes(), np.array([4, 5])).tolist() == [*np.cumsum(steps[:4]), *np.cumsum(steps[4:])] and size.sum() == len(raw)


def test_passages_in_turns(spark, monkeypatch):
    chunks, tests = make()
    c, t = spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(tests, TESTS)
    monkeypatch.setattr(L, "PASSAGE_TERMS", 300)
    assert {(r.chunk_pk, r.test_id) for r in L.leaked_passages(c, t).collect()} == brute(chunks, tests)


def test_long_tags_do_not_count():
    tag = '<a href="' + "x/" * 300 + '">'
    assert L.words_of(f"one {tag}two</a> 3 < 4 and 5 > 2") == ["one", "two", "3", "4", "and", "5", "2"]


def test_words():
    assert L.words_of("Der ﬁne <i>Über</i>-Test: ２ x­y 3.5 mg") == ["der", "fine", "über", "test", "2", "xy", "3", "5", "mg"]


def test_empty(spark):
    c, t = spark.createDataFrame([], CHUNKS), spark.createDataFrame([], TESTS)
    chunks, tests = make()
    assert L.leaked_passages(c, spark.createDataFrame(tests, TESTS)).count() == 0
    assert L.leaked_passages(spark.createDataFrame(chunks, CHUNKS), t).count() == 0
    assert L.near_passages(c, t).count() == 0
