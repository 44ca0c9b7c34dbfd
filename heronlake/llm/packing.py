"""Filling fixed-capacity containers with items: best-two-fit, run in shards of the documents."""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .tokens import token_count

#: Pieces packed together in one task; a shard ends with a few containers less full than the rest.
SHARD_PIECES = 20_000


def best_two_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of item numbers; every size is in 1..capacity.

    A container is filled greedily with the largest item that fits; then its smallest item gives
    way to the two unpacked items that fill the gap and its place more tightly, as long as a pair does.
    """
    stock: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, s in sorted(enumerate(sizes), key=lambda x: -x[0]):
        stock[s].append(i)  # the first item of a size is taken first
    there = np.array([bool(x) for x in stock])
    have = sorted(s for s in range(1, capacity + 1) if stock[s])
    left, out = len(sizes), []

    def take(s: int) -> int:
        i = stock[s].pop()
        if not stock[s]:
            there[s] = False
            have.pop(bisect_right(have, s) - 1)
        return i

    def put(s: int, i: int) -> None:
        if not stock[s]:
            there[s] = True
            insort(have, s)
        stock[s].append(i)

    while left:
        box: list[tuple[int, int]] = []
        gap = capacity
        while have and have[0] <= gap:
            s = have[bisect_right(have, gap) - 1]
            box.append((s, take(s)))
            gap -= s
        while gap and have and box:
            small, item = min(box)
            room = gap + small
            found = None
            top = min(room, capacity)
            for total in range(room, small, -1):
                lo = max(1, total - top)
                a = np.arange(lo, total // 2 + 1)
                ok = there[a] & there[total - a]
                if total % 2 == 0 and len(a) and a[-1] * 2 == total and ok[-1] and len(stock[total // 2]) < 2:
                    ok[-1] = False
                hit = np.flatnonzero(ok)
                if len(hit):
                    found = (int(a[hit[0]]), int(total - a[hit[0]]))
                    break
            if not found:
                break
            box.remove((small, item))
            put(small, item)
            box += [(s, take(s)) for s in found]
            gap = room - sum(found)
        out.append([i for _, i in box])
        left -= len(box)
    return out


def token_pieces(documents: DataFrame, packs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every document for every pack: whole documents within the capacity, and of longer
    ones full pieces and a rest: ``pack_name, capacity, key, piece_no, token_start, token_end, tokens``."""
    counted = cut(documents.select(F.col(key), token_count(F.col(text), path).alias("all_tokens")))
    sizes = packs.where("pack_name is not null and capacity_tokens > 0").select("pack_name", F.col("capacity_tokens").alias("capacity"))
    both = counted.crossJoin(F.broadcast(sizes))  # packs: a table of a few rows
    each = both.select("pack_name", "capacity", key, "all_tokens", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("all_tokens") - 1) / F.col("capacity")).cast("int")))).alias("piece_no"))
    start = F.col("piece_no") * F.col("capacity")
    end = F.least(start + F.col("capacity"), F.col("all_tokens"))
    return each.select("pack_name", "capacity", key, "piece_no", start.alias("token_start"), end.alias("token_end"), (end - start).alias("tokens"))


def pack(documents: DataFrame, packs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pieces with ``shard`` and ``container`` (numbered within pack and shard).

    Only documents longer than the capacity are cut. Null and empty texts have no tokens and lie in
    the first container of their shard. Repeated rows are packed as often as they come. Shards are
    dealt by hash of key and piece, their number follows from the count, so none grows with the data.
    """
    pieces = cut(token_pieces(documents, packs, path, key, text))
    n = pieces.groupBy("pack_name").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    shards = max(1, -(-n // shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(F.col(key).cast("string"), "piece_no"), F.lit(shards)).cast("int"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "piece_no", "token_end"], na_position="first").reset_index(drop=True)
        real = np.flatnonzero(pdf.tokens.to_numpy() > 0)
        box = np.zeros(len(pdf), dtype="int32")
        if len(real):
            for c, items in enumerate(best_two_fit(pdf.tokens.to_numpy()[real].tolist(), int(pdf.capacity.iloc[0]))):
                box[real[items]] = c
        return pdf.assign(container=box)

    schema = f"pack_name string, capacity int, {key} {dict(documents.dtypes)[key]}, piece_no int, token_start int, token_end int, tokens int, shard int, container int"
    return dealt.select("pack_name", "capacity", key, "piece_no", F.col("token_start").cast("int"), F.col("token_end").cast("int"), F.col("tokens").cast("int"), "shard").groupBy("pack_name", "shard").applyInPandas(fill, schema)


def pack_report(packed: DataFrame) -> DataFrame:
    """By pack: containers, tokens, documents cut, and the share of the capacity that is filled."""
    boxes = packed.groupBy("pack_name", "capacity", "shard", "container").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.sum((F.col("piece_no") > 0).cast("int")).alias("later"))
    by = boxes.groupBy("pack_name", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum("pieces").alias("pieces"), F.sum("later").alias("pieces_of_cut_documents"), F.max("tokens").alias("fullest"))
    return by.withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))
