"""Rewriting questions: sanitising, expanding, reformulating, decomposing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fixed import QUESTION_WORDS, REFORMULATIONS, SYNONYMS
from ..functions.text import expand_abbreviations, sanitise


def reformulation(question: Column) -> Column:
    """The rest of a question after the first opening that fits, with what replaces the opening."""
    low = F.lower(F.trim(question))
    out = F.lit(None).cast("string")
    for prefix, suffix in reversed(REFORMULATIONS):
        rest = F.regexp_replace(F.substr(F.trim(question), F.lit(len(prefix) + 1)), r"^\?+|\?+$", "")
        out = F.when(low.startswith(prefix), F.concat(rest, F.lit(suffix))).otherwise(out)
    return out


def synonym_variants(question: Column, most: int = 3) -> Column:
    """The lower-case question with each phrase that it contains replaced by its synonyms, ``most`` at most."""
    low = F.lower(question)
    none = F.array().cast("array<string>")
    made = [F.when(F.contains(low, F.lit(p)), F.array(*[F.replace(low, F.lit(p), F.lit(s)) for s in syn[:most]])).otherwise(none) for p, syn in SYNONYMS]
    return F.slice(F.concat(*made), 1, most)


def decomposed(question: Column) -> Column:
    """Parts of a question joined by "and", each made a question; empty where there is one part."""
    parts = F.transform(F.split(question, " and "), F.trim)

    def as_question(p: Column) -> Column:
        asks = F.lit(False)
        for w in QUESTION_WORDS:
            asks = asks | F.lower(p).startswith(w)
        whole = F.when(asks, p).otherwise(F.concat(F.lit("What is "), p))
        return F.concat(F.regexp_replace(whole, r"^\?+|\?+$", ""), F.lit("?"))

    return F.when(F.size(parts) > 1, F.transform(parts, as_question)).otherwise(F.array().cast("array<string>"))


def variants(question: Column, most: int = 3) -> Column:
    """The question and up to ``most`` others that differ from it and each other in any case: abbreviations
    expanded, synonyms, reformulated, decomposed."""
    clean = sanitise(question)
    made = F.concat(F.array(expand_abbreviations(clean)), synonym_variants(clean, most), F.array_compact(F.array(reformulation(clean))), decomposed(clean))
    kept = F.aggregate(
        made, F.array().cast("array<string>"),
        lambda acc, x: F.when(F.exists(F.concat(acc, F.array(clean)), lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return F.concat(F.array(clean), F.slice(kept, 1, most))
