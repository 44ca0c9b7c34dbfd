"""Splitting oversized items at natural boundaries.

Cut places of a text get penalties by how natural they are (empty line, line, sentence, clause,
word, inside a word). Dynamic programming over the places minimises the sum of penalties and of the
squared departures from an even size, subject to the largest size and the overlap wanted.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import EDGE_SPACE

#: Penalty of a cut, by kind of place.
PENALTY = {"paragraph": 0.0, "line": 0.3, "sentence": 0.5, "clause": 2.0, "word": 4.0, "inside": 30.0}
#: Weight of the squared departure from the even size, as a share of the limit.
IMBALANCE = 3.0
#: Cost of every further piece.
JOIN = 1.0
#: The table of limits is a small one; a larger one is refused, as it is sent to every task.
MAX_KINDS = 10_000
_KINDS = (
    ("word", re.compile(r"\s+")),
    ("clause", re.compile(r"[,;:、，；：–—][\"'”’»)]*\s*")),
    ("sentence", re.compile(r"[.!?]+[\"'”’»)\]]*(?:\s+|$)|[。！？।؟]+[”」』）]*\s*")),
    ("line", re.compile(r"[^\S\n]*\n[^\S\n]*")),
    ("paragraph", re.compile(r"[^\S\n]*\n\s*\n\s*")),
)


def _joined(text: str, i: int) -> bool:
    """Whether the characters on either side of place ``i`` are one written sign."""
    if not 0 < i < len(text):
        return False
    c, before = text[i], text[i - 1]
    return bool(unicodedata.combining(c)) or c in "‍️⃣" or before == "‍" or "🏻" <= c <= "🏿" or unicodedata.category(c) in ("Mn", "Me", "Mc") or (before == "\r" and c == "\n") or ("🇦" <= c <= "🇿" and "🇦" <= before <= "🇿")


def places(text: str, room: int) -> tuple[np.ndarray, np.ndarray]:
    """All cut places in rising order with their penalties; inside a stretch without any, one place in
    every half of ``room`` (moved back where it would part a written sign)."""
    n = len(text)
    best: dict[int, float] = {}
    for kind, pattern in _KINDS:  # a later kind is more natural and wins
        for m in pattern.finditer(text):
            best[m.end()] = PENALTY[kind]
    best.pop(0, None)
    best.pop(n, None)
    step, last = max(1, room // 2), 0
    for p in [*sorted(best), n]:
        while p - last > step:
            last += step
            q = last
            while q > last - step + 1 and _joined(text, q):
                q -= 1
            best.setdefault(q, PENALTY["inside"])
        last = p
    best.pop(0, None)
    keys = sorted(best)
    return np.array(keys, dtype=np.int64), np.array([best[k] for k in keys])


def _best_cuts(ends: np.ndarray, price: np.ndarray, starts: np.ndarray, largest: int, even: float) -> tuple[float, np.ndarray]:
    """Least cost of cutting at some of ``ends`` (the last one is the end of the text), and for each end
    the end before it on the best way there (-1: it is the first)."""
    total = np.full(len(ends), np.inf)
    back = np.full(len(ends), -1, dtype=np.int64)
    first = np.searchsorted(starts, ends - largest).tolist()
    alone = np.where(ends <= largest, price + IMBALANCE * ((ends - even) / largest) ** 2, np.inf)
    base = (ends - even) / largest
    begin = starts / largest
    for i in range(len(ends)):
        total[i], lo = alone[i], first[i]
        if lo < i:
            size = base[i] - begin[lo:i]
            t = total[lo:i] + IMBALANCE * size * size
            k = int(t.argmin())
            c = t[k] + price[i] + JOIN
            if c < total[i]:
                total[i], back[i] = c, lo + k
    return float(total[-1]), back


def cut_text(text: str, largest: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces (start, end) of at most ``largest`` code points that cover ``text``; each piece but the
    first starts ``overlap`` code points before the end of the one before it, or as few more as it
    takes not to part a written sign. A text within the limit is one piece.

    The pieces are the cheapest over all places. A first pass over the coarse places gives a
    bound; a place is left out of the second only if any way through it costs more than that bound.
    """
    n = len(text)
    if largest <= 0:
        raise ValueError("the limit must be positive")
    if overlap < 0 or overlap >= largest:
        raise ValueError("the overlap must lie between 0 and the limit")
    if n <= largest:
        return [(0, n)]
    at, cost = places(text, largest - overlap)
    all_ends = np.append(at, n)
    all_price = np.append(cost, 0.0)
    all_starts = np.maximum(all_ends - overlap, 0)
    if overlap and not text.isascii():
        for i, s in enumerate(all_starts):
            while s > 0 and _joined(text, int(s)):
                s -= 1
            all_starts[i] = s
    count = -(-(n - overlap) // (largest - overlap))
    even = min(largest, (n - overlap) / count + overlap)

    def run(keep: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
        ends, starts = all_ends[keep], all_starts[keep]
        total, back = _best_cuts(ends, all_price[keep], starts, largest, even)
        out, i = [], len(ends) - 1
        while i >= 0:
            b = int(back[i])
            out.append((int(starts[b]) if b >= 0 else 0, int(ends[i])))
            i = b
        return total, out[::-1]

    coarse = all_price <= PENALTY["sentence"]
    bound, out = run(coarse)
    # every way has count - 1 cuts or more, each of which costs JOIN and the cheapest price at least
    least = float(cost.min())
    keep = all_price - least <= bound - (count - 1) * (JOIN + least) + 1e-9
    keep[-1] = True
    if (keep & ~coarse).any():
        bound, out = run(keep | coarse)
    if not np.isfinite(bound):  # one sign longer than the limit: even cuts
        step = largest - overlap
        return [(s, min(n, s + largest)) for s in range(0, max(1, n - overlap), step)]
    return out


PIECES = T.ArrayType(T.StructType([T.StructField("piece_start", T.IntegerType()), T.StructField("piece_end", T.IntegerType()), T.StructField("piece_text", T.StringType())]))


@F.pandas_udf(PIECES)
def _pieces(texts: pd.Series, largest: pd.Series, overlap: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [(a, b, t[a:b]) for a, b in cut_text(t, int(m), int(o))] for t, m, o in zip(texts, largest, overlap)])


def limits_of(limits: DataFrame) -> tuple[list[tuple[str, int, int]], tuple[int, int]]:
    """Kinds with their limits, longest name first, and the default. More than ``MAX_KINDS`` rows are
    refused, and so is an overlap that is not smaller than its limit. Of equal names the smallest
    limit counts."""
    rows = limits.where("source_kind is not null and max_chars is not null").limit(MAX_KINDS + 1).collect()
    if len(rows) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} limits")
    for r in rows:
        if r.max_chars <= 0 or not 0 <= (r.overlap_chars or 0) < r.max_chars:
            raise ValueError(f"{r.source_kind}: the overlap must lie between 0 and the limit")
    kinds = sorted(((r.source_kind.strip().lower(), int(r.max_chars), int(r.overlap_chars or 0)) for r in rows), key=lambda r: (-len(r[0]), *r))
    kinds = [k for i, k in enumerate(kinds) if not i or kinds[i - 1][0] != k[0]]
    default = [r[1:] for r in kinds if r[0] == "default"]
    if not default:
        raise ValueError("no default limit")
    return [k for k in kinds if k[0] != "default"], default[0]


def limit_columns(source: Column, limits: DataFrame) -> tuple[Column, Column]:
    """Largest size and overlap for a source: of the longest kind with which its clean spelling begins."""
    kinds, (size, lap) = limits_of(limits)
    clean = F.lower(F.regexp_replace(source, EDGE_SPACE, ""))
    if not kinds:
        return F.lit(size), F.lit(lap)
    # one look-up for each length of a name
    as_map = lambda pairs: F.from_json(F.lit(json.dumps(dict(pairs))), "map<string,int>")  # noqa: E731  (folded to one constant)
    sizes, laps = as_map((name, m) for name, m, _ in kinds), as_map((name, o) for name, _, o in kinds)
    lengths = sorted({len(name) for name, _, _ in kinds}, reverse=True)
    of = lambda table, other: F.coalesce(*[F.try_element_at(table, F.substring(clean, 1, n)) for n in lengths], F.lit(other))
    return of(sizes, size), of(laps, lap)


def cut_items(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Every row of ``chunks`` as its pieces, with ``chunk_id`` and ``total_chunks`` set anew for the parent.

    Added columns: ``piece_no`` (from 0), ``piece_start``, ``piece_end`` (code points in the old
    content), ``oversized``. Rows within the limit, null and blank contents pass as one piece; copies
    of a chunk stay; rows without a parent are parents of their own. Only oversized texts reach
    Python. Numbers come from counts for each parent and block of old ids and a running sum
    over blocks, so a parent with a third of all rows is no single task.
    """
    largest, overlap = limit_columns(F.col("source"), limits)
    # columns of these names that come with the table give way to the new ones
    rows = chunks.drop("piece_no", "piece_start", "piece_end", "oversized").withColumns({"_max": largest, "_lap": overlap})
    rows = rows.withColumn("oversized", F.coalesce(F.length("content") > F.col("_max"), F.lit(False)))
    whole = F.array(F.struct(F.lit(0).alias("piece_start"), F.coalesce(F.length("content"), F.lit(0)).alias("piece_end"), F.col("content").alias("piece_text")))
    # non-deterministic to the optimiser: a filter on the pieces would cut the texts a second time
    pieces = F.when(F.col("oversized"), _pieces.asNondeterministic()(F.when(F.col("oversized"), F.col("content")), "_max", "_lap")).otherwise(whole)
    cut = rows.withColumn("_pieces", pieces)
    parent = F.coalesce(F.concat(F.lit("p"), "parent_id"), F.concat(F.lit("c"), F.col("chunk_pk").cast("string")))
    cut = cut.withColumns({"_parent": parent, "_block": F.when(F.col("chunk_id").isNull(), F.floor(F.col("chunk_pk") / 4096) - (1 << 60)).otherwise(F.floor(F.col("chunk_id") / 4096)).cast("long"), "_n": F.size("_pieces")})
    blocks = cut.groupBy("_parent", "_block").agg(F.sum("_n").alias("_in"))
    over = Window.partitionBy("_parent").orderBy("_block")
    blocks = blocks.select("_parent", "_block", (F.sum("_in").over(over) - F.col("_in")).alias("_before"), F.sum("_in").over(Window.partitionBy("_parent")).alias("_total"))
    inside = Window.partitionBy("_parent", "_block").orderBy("chunk_id", "chunk_pk")
    numbered = cut.withColumn("_first", F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).join(blocks, ["_parent", "_block"])
    out = numbered.select("*", F.posexplode("_pieces").alias("piece_no", "_piece"))
    fresh = {"content": F.col("_piece.piece_text"), "piece_start": F.col("_piece.piece_start"), "piece_end": F.col("_piece.piece_end"), "chunk_id": (F.col("_before") + F.col("_first") + F.col("piece_no")).cast("int"), "total_chunks": F.col("_total").cast("int")}
    return out.withColumns(fresh).drop("_max", "_lap", "_pieces", "_piece", "_parent", "_block", "_n", "_before", "_total", "_first")
