import pytest

from heronlake.llm import pairs as P
from heronlake.plans.neighbours import carried_on

Q = "What are the side effects of Brenolin?"


@pytest.mark.parametrize("a", [None, "", " \n", "​", "\xa0", "N/A", "nan", "None", "Answer:", "A:", '""', "<p></p>", "-", "...", "[no answer]", "TBD"])
def test_empty(a):
    assert P.is_empty(a)


@pytest.mark.parametrize("a", ["No.", "Yes.", "None known.", "A", "14.5 mg", "Rarely."][:3] + ["14.5 mg", "Rarely."])
def test_not_empty(a):
    assert not P.is_empty(a)


@pytest.mark.parametrize("a", [Q, Q.upper(), Q.rstrip("?"), f"Q: {Q}", f"The question is: {Q}", f"{Q} {Q}", "What are side effects of Brenolin?", f'"{Q}"', "What  are  the  side  effects of Brenolin?\n"])
def test_copy(a):
    assert P.is_copy(Q, a)


@pytest.mark.parametrize("a", [f"You asked: {Q} Mostly nausea.", "Mostly nausea.", None, ""])
def test_no_copy(a):
    assert not P.is_copy(Q, a)


@pytest.mark.parametrize("a", ["I'm sorry, but I can't help with that request.", "I don't know.", "As an AI assistant, I cannot give medical advice. Please speak to a midwife.", "Es tut mir leid, dabei kann ich nicht helfen.", "Lo siento, no puedo responder a esa pregunta.", "Je suis désolé, je ne peux pas répondre à cette question.", "No answer can be given on the basis of the context.", "抱歉，我无法回答这个问题。", "К сожалению, я не могу ответить на этот вопрос."])
def test_refusal(a):
    assert P.is_refusal(a)


@pytest.mark.parametrize("a", ["I'm sorry to hear about your trouble. Take it with food.", "I cannot stress enough how common this is. Rest helps.", "People who cannot swallow tablets can use drops. Ask a nurse.", "Take it with food. Always talk to a midwife first; I cannot see your records.", "Ne prenez pas brenolin avec du vin."])
def test_no_refusal(a):
    assert not P.is_refusal(a)


def test_language():
    assert P.is_foreign(Q, "Ältere Menschen vertragen das Mittel oft schlechter als jüngere.")
    assert P.is_foreign(Q, "この薬はいつまで飲めばよいですか。")
    assert not P.is_foreign(Q, 'The older leaflet calls it "Kopfschmerzen am Morgen" and so do we.')
    assert not P.is_foreign(Q, "No.") and not P.is_foreign(None, "Das ist nicht gut.")


def test_defects_of_a_table(spark):
    full = [f"Store Brenolin below {i} °C; discard it {i} weeks after opening." for i in range(1, 40)] + [f"Most adults notice nausea within {i} days of the first dose." for i in range(1, 40)]
    rows = [("qa_pair", str(i), Q, f"{full[i]} {full[-i - 1]}") for i in range(len(full))]
    rows += [
        ("qa_pair", "cut", Q, "Store Brenolin below 9 °C; discard it 3 weeks after opening. Most adults notice nausea wi"),
        ("qa_pair", "list", Q, "Take these steps:\n1. rest at night.\n2."), ("qa_pair", "bullets", Q, "Store Brenolin below 9 °C.\n- rest at night.\n-"), ("qa_pair", "whole list", Q, "Store Brenolin below 9 °C.\n1. Take it with food.\n2. Take it with food."),
        ("qa_pair", "stop", Q, "Most adults notice nausea within 5 days of the first dose"),
        ("qa_pair", "phrase", Q, "an ultrasound scan"),
        ("qa_pair", "null", None, None), ("qa_pair", "copy", Q, Q), ("qa_pair", "copy", Q, Q),
        ("qa_pair", "no question", None, "Take it with food."),
        ("qa_pair", "long", Q, "Take it with food. " * 3000),
    ]
    df = spark.createDataFrame(rows, "src_table string, pair_key string, question string, answer string")
    got = P.broken_pairs(df)
    assert got.count() == df.count()
    found = {r.pair_key: r.defect for r in got.collect() if r.defect}
    assert found == {"cut": "truncated", "list": "truncated", "bullets": "truncated", "null": "empty", "copy": "copied"}
    assert P.broken_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_carried_on_past_near_neighbours(spark, parts):
    """An ending whose next neighbours are one character longer, against brute force."""
    texts = ["In one clinic, 0% repo", "In one clinic, 0% repor", "In one clinic, 0% report", "In one clinic, 0% reported a fever", "a", "ab", "ac", "adé", "b", "bc", "bd", "be", "Ünd", "Ünde", "Ündi", "Ündig", "x y", "x y:", "z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(parts)
    got = {r.t: r.carried_on for r in carried_on(df, "t").collect()}
    assert got == {t: any(o.startswith(t) and len(o) > len(t) + 1 for o in texts) for t in texts}
    assert got["In one clinic, 0% repo"] and got["a"] and not got["b"]


@pytest.mark.parametrize("copies", [3, 60])
def test_copies_of_a_cut_answer_teach_nothing(spark, monkeypatch, copies):
    """A cut answer loaded again and again is taught as no phrase, whether a neighbour carries it on or
    not; a short answer to many questions is."""
    taught, train = [], P.train_endings
    monkeypatch.setattr(P, "train_endings", lambda units, phrases: taught.extend(phrases) or train(units, phrases))
    full = [f"Store Brenolin below {i} °C; discard it {i} weeks after opening." for i in range(1, 40)] + [f"Most adults notice nausea within {i} days of the first dose." for i in range(1, 40)]
    rows = [("qa_pair", str(i), f"{Q} {i}", f"{full[i]} {full[-i - 1]}") for i in range(len(full))]
    rows += [("qa_pair", f"known {i}", f"{Q} {i % 4}", "Most adults notice nausea wi") for i in range(copies)]
    rows += [("qa_pair", f"alone {i}", Q, "Some elderly adults notice nausea wi") for i in range(copies)]
    rows += [("qa_pair", f"phrase {i}", f"{Q} {i}", "Brenolin twice daily") for i in range(40)]
    df = spark.createDataFrame(rows, "src_table string, pair_key string, question string, answer string")
    found = {r.pair_key: r.defect for r in P.broken_pairs(df).collect() if r.defect and not r.pair_key.startswith("alone")}
    assert set(taught) == {"Brenolin twice daily"}
    assert found == {f"known {i}": "truncated" for i in range(copies)}


def test_held_out_accuracy_of_endings():
    import random

    rng = random.Random(1)
    parts = [("Take", "the pill", "with water", "at night"), ("Ask", "a doctor", "about rest", "before work"), ("Check", "the dose", "of the drops", "every week")]
    units = [f"{a} {b} {c} {d} for {n} days" for a, b, c, d in parts for n in ("two", "three", "four", "many")] * 20
    rng.shuffle(units)
    w = P.train_endings(units[:180], [])
    score = lambda u: sum(w.get(f, 0) for f in P._ending_features(u))
    good = sum(score(u) < 0 for u in units[180:]) / len(units[180:])
    cut = [u[: rng.randrange(4, len(u) - 3)] for u in units[180:]]
    bad = sum(score(u) > 0 for u in cut) / len(cut)
    assert good > 0.9 and bad > 0.85
