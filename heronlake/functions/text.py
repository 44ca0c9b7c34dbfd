"""Text expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixed import ABBREVIATIONS, INJECTIONS, LOG_REDACTION, MARKED_ABBREVIATIONS


def terms(text: Column) -> Column:
    """Search terms: lower case, letters, digits, underscores and hyphens, two characters at least."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s\-]", " "), r"\s+")
    return F.filter(words, lambda w: F.length(w) >= 2)


def words(text: Column) -> Column:
    """White-space words; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def clean(text: Column) -> Column:
    """Tags to spaces, web addresses and numeric references out, white space collapsed, trimmed."""
    t = F.regexp_replace(text, r"<[^>]+>", " ")
    t = F.regexp_replace(t, r"https?://\S+|www\.\S+", "")
    t = F.regexp_replace(t, r"\[\d+\]|\(\d+\)", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


@F.pandas_udf(T.StringType())
def compatible(text: pd.Series) -> pd.Series:
    """Compatibility-normalised text; Spark has no expression for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def _decomposed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def unveiled(text: Column) -> Column:
    """Text in which patterns are not hidden: compatibility-decomposed (only texts beyond ASCII
    are sent to Python for it), white space of any kind as one blank, zero-width characters out."""
    plain = F.coalesce(_decomposed(F.when(F.regexp_like(text, F.lit(r"[^\x00-\x7F]")), text)), text)
    return F.regexp_replace(F.regexp_replace(plain, r"[\s\x1C-\x1F\x{85}\p{Z}]+", " "), r"[\x{200B}-\x{200D}\x{FEFF}]", "")


def marked_sentences(text: Column) -> Column:
    """Sentences for marking up: cut at runs of end marks but for those of common abbreviations, those of
    at most ten characters left out."""
    hide, show = "<DOT>", "."
    for short in MARKED_ABBREVIATIONS:
        text = F.replace(text, F.lit(short), F.lit(short.replace(show, hide)))
    parts = F.transform(F.split(text, r"[.!?]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.transform(F.filter(parts, lambda s: F.length(s) > 10), lambda s: F.replace(s, F.lit(hide), F.lit(show)))


def redact_log(text: Column) -> Column:
    for pattern, tag in LOG_REDACTION:
        text = F.regexp_replace(text, pattern, tag)
    return text


def sanitise(question: Column) -> Column:
    for pattern in INJECTIONS:
        question = F.regexp_replace(question, f"(?i){pattern}", "")
    return F.trim(question)


def expand_abbreviations(question: Column) -> Column:
    """Each word replaced by what it stands for, if it is an abbreviation but for ``?.,!`` at its end."""
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    return F.array_join(F.transform(words(question), lambda w: F.coalesce(F.try_element_at(table, F.regexp_replace(F.lower(w), r"^[?.,!]+|[?.,!]+$", "")), w)), " ")


def chunk_key(source: Column, chunk_id: Column, content: Column) -> Column:
    """Stable id of a stored chunk."""
    return F.substring(F.sha2(F.concat(source, F.lit("::chunk"), chunk_id.cast("string"), F.lit("::"), F.substring(F.sha2(content, 256), 1, 16)), 256), 1, 32)


def document_key(source: Column, content: Column) -> Column:
    """Stable id of a retrieved document."""
    return F.substring(F.sha2(F.concat(source, F.lit("::"), F.substring(content, 1, 300)), 256), 1, 16)


def cache_key(question: Column, context: Column) -> Column:
    return F.md5(F.concat(F.lit("v2::"), F.lower(F.trim(question)), F.lit("::"), context))


def hash_share(key: Column) -> Column:
    """A number in 0..1 from the first eight hex digits of the key's SHA-1."""
    return F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)
