"""Rule tables over texts as column expressions; no row is repeated for a rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fixed import EDUCATIONAL, EMERGENCY_NEGATIONS, EMERGENCY_WORDS, HARM, SENSITIVE_TOPICS


def first_urgent_word(text: Column, reach: int = 40) -> Column:
    """The first listed urgent word whose first place has no negation in the ``reach`` characters before
    it; negations count anywhere in that stretch, inside words too."""
    low = F.lower(text)
    found = F.lit(None).cast("string")
    for w in reversed(EMERGENCY_WORDS):
        at = F.instr(low, w)
        before = F.substring(low, F.greatest(F.lit(1), at - reach), F.least(F.lit(reach), at - 1))
        denied = F.lit(False)
        for n in EMERGENCY_NEGATIONS:
            denied = denied | F.contains(before, F.lit(n))
        found = F.when((at > 0) & ~denied, F.lit(w)).otherwise(found)
    return F.when(text.rlike(f"(?i){EDUCATIONAL}"), F.lit(None).cast("string")).otherwise(found)


def sensitive_topics(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*[F.lit(t) for t in SENSITIVE_TOPICS]), lambda t: F.contains(low, t))


def input_level(text: Column) -> Column:
    return F.when(first_urgent_word(text).isNotNull(), "emergency").when(F.size(sensitive_topics(text)) > 0, "caution").otherwise("safe")


def harm_score(text: Column) -> Column:
    """Sum of the weights of the harm patterns that occur, one at most."""
    total = F.lit(0.0)
    for pattern, _, weight in HARM:
        total = total + F.when(text.rlike(f"(?i){pattern}"), F.lit(weight)).otherwise(F.lit(0.0))
    return F.round(F.least(F.lit(1.0), F.coalesce(total, F.lit(0.0))), 6)


def harm_level(score: Column) -> Column:
    return F.when(score < 0.2, "low").when(score < 0.5, "moderate").when(score < 0.8, "high").otherwise("critical")


def interactions(text: Column, rules: list[tuple[str, list[str], list[str]]], negations: tuple[str, ...], reach: int = 30) -> Column:
    """Names of the rules of which a word of either list is mentioned without a negation before it.

    ``rules``: (name, words of one side, words of the other); they come as data.
    """
    low = F.lower(F.coalesce(text, F.lit("")))

    def said(words: list[str]) -> Column:
        any_of = F.lit(False)
        for w in words:
            at = F.instr(low, w.lower())
            before = F.substring(low, F.greatest(F.lit(1), at - reach), F.least(F.lit(reach), at - 1))
            denied = F.lit(False)
            for n in negations:
                denied = denied | F.contains(before, F.lit(n))
            any_of = any_of | ((at > 0) & ~denied)
        return any_of

    return F.array_compact(F.array(*[F.when(said(a) & said(b), F.lit(name)) for name, a, b in rules]))
