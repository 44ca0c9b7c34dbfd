"""Chunkers: word windows as SQL, sentence and recursive chunkers as array functions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import words

# Chunk sizes in characters by kind of source; the recursive chunker takes four times as much.
SENTENCE_SIZES = (("pubmedqa", 256), ("medmcqa", 128), ("healthcaremagic", 512), ("clinical_guideline", 768))
SENTENCE_SIZE, SENTENCE_LEAST, SENTENCE_OVERLAP = 512, 100, 50
RECURSIVE_SIZES = (("pubmedqa", 1024), ("medmcqa", 512), ("healthcaremagic", 2048), ("clinical_guideline", 3072))
RECURSIVE_SIZE, RECURSIVE_LEAST, RECURSIVE_OVERLAP = 2048, 80, 100
SEPARATORS = ("\n\n", "\n", ". ", "; ", ", ", " ", "")


def size_of(source: Column, sizes: tuple, default: int) -> Column:
    """Size for the first kind that the source's lower-case name contains."""
    out = F.lit(default)
    for name, n in reversed(sizes):
        out = F.when(F.lower(source).contains(name), F.lit(n)).otherwise(out)
    return out


def word_windows(docs: DataFrame, key: str, text: str, size: int = 512, overlap: int = 50, to_last_word: bool = False) -> DataFrame:
    """Windows of ``size`` words, each starting ``size - overlap`` words after the one before, until one
    reaches the end: ``key, chunk_id`` (from 1), ``n_words, chunk``. All in the JVM.

    With ``to_last_word`` windows go on as long as they start within the text, so the last may lie wholly
    in the one before; and a text that fits one window, blank ones too, stays as it is written."""
    step = size - overlap
    if to_last_word:
        w = docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("t"), words(F.col(text)).alias("w"))
        fits = F.size("w") <= size
        cut = w.select(key, "t", "w", F.posexplode(F.sequence(F.lit(0), F.when(fits, F.lit(0)).otherwise(F.ceil(F.size("w") / step).cast("int") - 1))).alias("i", "j"))
        piece = F.slice("w", F.col("i") * step + 1, F.lit(size))
        return cut.select(key, (F.col("i") + 1).alias("chunk_id"), F.size(piece).alias("n_words"), F.when(fits, F.col("t")).otherwise(F.array_join(piece, " ")).alias("chunk"))
    w = docs.where(F.col(text).isNotNull()).select(key, words(F.col(text)).alias("w")).where(F.size("w") > 0)
    n = F.greatest(F.lit(1), F.ceil((F.size("w") - overlap) / step).cast("int"))
    cut = w.select(key, "w", F.posexplode(F.sequence(F.lit(0), n - 1)).alias("i", "j"))
    piece = F.slice("w", F.col("i") * step + 1, F.lit(size))
    return cut.select(key, (F.col("i") + 1).alias("chunk_id"), F.size(piece).alias("n_words"), F.array_join(piece, " ").alias("chunk"))


def _overlapped(chunks: list[str], overlap: int) -> list[str]:
    """Each chunk but the first behind the last ``overlap`` characters of the one before, from their first
    blank on (unless they begin with it)."""

    def tail(text: str) -> str:
        part = text[-overlap:]
        blank = part.find(" ")
        return part[blank + 1 :] if blank > 0 else part

    return chunks[:1] + [f"{tail(a)} {b}" for a, b in zip(chunks, chunks[1:])] if overlap else chunks


def _packed(parts: Iterable[str], size: int, blank: int) -> Iterator[tuple[str, bool]]:
    """Parts joined by blanks as long as they fit, and whether a line is the last one; ``blank`` is what the
    joining blank counts."""
    now = ""
    for part in parts:
        if now and len(now) + len(part) + blank > size:
            yield now, False
            now = part
        else:
            now = f"{now} {part}" if now else part
    yield now, True


def sentence_chunks_of(text: str, size: int, least: int = SENTENCE_LEAST, overlap: int = SENTENCE_OVERLAP) -> list[str]:
    """Sentences packed greedily up to ``size``, the joining blank not counted; of longer ones the words
    are packed (there it counts), and the last of these lines goes on with the next sentences. A last
    chunk below ``least`` is dropped; each chunk but the first begins with the end of the one before."""
    if len(text) <= size:
        return [text] if text and len(text) >= least else []
    chunks, now = [], ""
    for s in re.split(r"(?<=[.!?])\s+", text):
        if len(now) + len(s) <= size:
            now = f"{now} {s}" if now else s
            continue
        if now:
            chunks.append(now.strip())
        now = s
        if len(s) > size:
            for line, last in _packed(s.split(), size, 1):
                if last:
                    now = line
                elif line:
                    chunks.append(line.strip())
    if len(now) >= least:
        chunks.append(now.strip())
    return _overlapped(chunks, overlap)


def recursive_chunks_of(text: str, size: int, least: int = RECURSIVE_LEAST, overlap: int = RECURSIVE_OVERLAP, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Split at the coarsest separator that is there; parts above ``size`` again by finer ones; then, at
    every level, neighbours joined up to ``size``, lines below ``least`` dropped, and each line begun
    with the end of the last one. Separators that show stay with the part before them."""
    if not text:
        return []
    level = next(i for i, sep in enumerate(separators) if not sep or sep in text)
    sep, finer = separators[level], separators[level + 1 :]
    if not sep:
        return [text[i : i + size] for i in range(0, len(text), size)]
    *front, last = text.split(sep)
    shown = sep if sep.strip() else ""
    parts: list[str] = []
    for part in (p.strip() for p in [*(f + shown for f in front), last]):
        parts += recursive_chunks_of(part, size, least, overlap, finer) if len(part) > size else [part] if part else []
    return _overlapped([line for line, _ in _packed(parts, size, 1) if len(line) >= least], overlap)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _sentence(texts: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series([[] if t is None else sentence_chunks_of(t, int(n)) for t, n in zip(texts, sizes)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _recursive(texts: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series([[] if t is None else recursive_chunks_of(t, int(n)) for t, n in zip(texts, sizes)])


def chunk_documents(docs: DataFrame, key: str, text: str, source: str, recursive: bool = False) -> DataFrame:
    """``key, source, chunk_id`` (from 0), ``total_chunks, chunk_length, chunk``."""
    size = size_of(F.col(source), RECURSIVE_SIZES if recursive else SENTENCE_SIZES, RECURSIVE_SIZE if recursive else SENTENCE_SIZE)
    parts = (_recursive if recursive else _sentence)(F.col(text), size)
    made = docs.select(key, source, parts.alias("parts"))
    return made.select(key, source, F.size("parts").alias("total_chunks"), F.posexplode("parts").alias("chunk_id", "chunk")).select(key, source, "chunk_id", "total_chunks", F.length("chunk").alias("chunk_length"), "chunk")
