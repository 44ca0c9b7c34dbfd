import random

import pandas as pd
import pytest

from heronlake.llm import sentences as S


def corpus(n=600, seed=1):
    """Documents with known sentences: abbreviations, initials, decimals, quotations, brackets."""
    rng = random.Random(seed)
    names = ["Berg", "Stone", "Hill", "Fox", "Lake", "Wood"]
    heads = ["Dosage", "Key points", "Side effects"]

    def sentence():
        a, i = rng.choice(names), rng.choice("ABCDEFGH")
        return rng.choice(
            [
                f"Dr. {i}. {a} saw {rng.randrange(90)} cases last winter.", f"Levels above {rng.randrange(9)}.{rng.randrange(9)} units (approx. {rng.randrange(99)} cells) are high.",
                "Take it p.o. with food, e.g. with bread.", f'"Does it hurt?" asked nurse {a}.', f'One patient wrote: "It was gone after {rng.randrange(9)} days."', "Seek help at once!", "Why does it itch at night?",
                f"See Fig. {rng.randrange(99)} and Sect. {rng.randrange(20)}.{rng.randrange(9)} for the plan.", f"(See Table {rng.randrange(30)} for children.)", "Many people stop too early ... and the pain returns.", "pH stayed normal during rest.",
            ]
        )

    out = []
    for k in range(n):
        text, spans = "", []
        for _ in range(rng.randrange(1, 5)):
            if rng.random() < 0.3:
                h = rng.choice(heads)
                spans.append((len(text), len(text) + len(h)))
                text += h + "\n"
            for j in range(rng.randrange(1, 5)):
                s = sentence()
                if j:
                    text += " "
                spans.append((len(text), len(text) + len(s)))
                text += s
            text += "\n\n"
        out.append((k, text, spans))
    return out


def test_held_out_accuracy(spark):
    docs = corpus()
    train = spark.createDataFrame([(k, t) for k, t, _ in docs[:400]], "doc_id long, text string")
    weights = S.fit(train)
    good = found = true = 0
    for _, t, spans in docs[400:]:
        got = set(S.split_text(t, weights))
        good, found, true = good + len(got & set(spans)), found + len(got), true + len(spans)
    assert good / found > 0.97 and good / true > 0.97


@pytest.mark.parametrize(
    "text, want",
    [
        ("", []), (" \n\t\xa0", []), ("Heading\nA line that\nruns on\n- item one\n- item two", ["Heading", "A line that\nruns on", "- item one", "- item two"]),
        ("今天很好。明天呢？“好的。”", ["今天很好。", "明天呢？", "“好的。”"]), ("อาการดี ควรพักผ่อน ยา aspirin หรือยา 5 เม็ด", ["อาการดี", "ควรพักผ่อน", "ยา aspirin หรือยา 5 เม็ด"]),
        ("患者应休息 请立即就医 服用 aspirin 后", ["患者应休息", "请立即就医", "服用 aspirin 后"]), ("\xa0 A first line.\xa0\n\n\nB", ["A first line.", "B"]), ("1. one\n2. two", ["1. one", "2. two"]),
    ],
)
def test_rules_without_a_model(text, want):
    assert [text[a:b] for a, b in S.split_text(text, {})] == want


def test_thai_gap_beside_latin():
    t = "ยาดี ควรกิน"
    assert len(S.split_text(t, {})) == 2


def test_table(spark):
    rows = [(1, "One. Two.", 5), (1, "One. Two.", 5), (2, None, 5), (3, "  ", 5), (None, "x", 5), (4, "A long text goes on. " * 5000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sent_no int")
    got = S.sentence_units(df, weights={}).collect()
    assert sum(r.doc_id == 1 for r in got) == 4 and sum(r.doc_id == 4 for r in got) == 5000 and {r.doc_id for r in got} == {1, 4}
    long = rows[-1][1]
    assert all(long[r.sent_start : r.sent_end] == r.sentence for r in got if r.doc_id == 4)
    assert S.sentence_units(df.limit(0)).count() == 0


def test_training_needs_no_reliable_boundaries():
    assert S.train(pd.DataFrame({"place": [], "last": [], "n": []})) == {}
