"""Mixing sources to target weights.

The tokens of each source are laid end to end in pseudorandom order and cut into blocks of fixed
length. The mix is a number of output shards; for each shard the number of blocks from every source is
drawn (a multinomial draw, conditioned on the totals that the target asks for), and each slot of a
source is mapped through a keyed permutation of the source's block numbers, a new one for each repeat.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import cut
from .common import EDGE_SPACE
from .tokens import token_count

BLOCK_TOKENS = 256
#: Documents of a source are put in order within so many hash buckets, each summed on its own.
BUCKETS = 4096
#: Output shards; bounds what the draw holds on the driver (shards x sources).
MAX_SHARDS = 4096
SLOTS_PER_SHARD = 2048


def source_blocks(documents: DataFrame, targets: DataFrame, path: str | None = None, block: int = BLOCK_TOKENS, key: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """Segments ``source, block, key, token_start, token_end, at`` of the documents of wanted sources.

    Sources are compared trimmed and in lower case and named as in ``targets``. Offsets come from
    sums over hash buckets, so a source with a third of all rows is no single task. Every token of a
    source lies in one block; only a source's last block may be short.
    """
    wanted = targets.where("source is not null").select(F.col("source").alias("name"), F.lower(F.regexp_replace("source", EDGE_SPACE, "")).alias("clean"))
    docs = documents.select(F.col(key), F.col(text), F.lower(F.regexp_replace("source", EDGE_SPACE, "")).alias("clean")).join(F.broadcast(wanted), "clean").select(key, F.col("name").alias("source"), token_count(F.col(text), path).alias("tokens")).where("tokens > 0")
    h = F.xxhash64(F.col(key).cast("string"), F.lit(seed))
    docs = cut(docs.withColumns({"hash": h, "bucket": F.pmod(h, F.lit(BUCKETS))}))
    sums = docs.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    before = sums.select("source", "bucket", (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("hash", key, "tokens").rowsBetween(Window.unboundedPreceding, 0)
    laid = docs.withColumn("upto", F.sum("tokens").over(inside)).join(before, ["source", "bucket"])
    begin = (F.col("before") + F.col("upto") - F.col("tokens")).cast("long")
    laid = laid.select("source", key, "tokens", begin.alias("begin"))
    first, last = F.floor(F.col("begin") / block).cast("long"), F.floor((F.col("begin") + F.col("tokens") - 1) / block).cast("long")
    parts = laid.select("*", F.explode(F.sequence(first, last)).alias("block"))
    a = F.greatest(F.col("block") * block, F.col("begin"))
    b = F.least((F.col("block") + 1) * block, F.col("begin") + F.col("tokens"))
    return parts.select("source", "block", key, (a - F.col("begin")).cast("int").alias("token_start"), (b - F.col("begin")).cast("int").alias("token_end"), (a - F.col("block") * block).cast("int").alias("at"))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Image of ``index`` under a keyed permutation of 0..size-1 (Feistel network, walking cycles)."""
    index, size = index.astype("uint64").copy(), size.astype("uint64")
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2).astype(float))).astype("uint64") + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index, np.arange(len(index))
    while len(todo):
        x, m, hb, k = out[todo], mask[todo], half[todo], key[todo].astype("uint64")
        a, b = x >> hb, x & m
        for r in range(6):
            z = b + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64((r + 1) * 0xBF58476D1CE4E5B9 % 2**64)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            a, b = b, a ^ ((z ^ (z >> np.uint64(31))) & m)
        out[todo] = (a << hb) | b
        todo = todo[out[todo] >= size[todo]]
    return out.astype("int64")


def plan_totals(supply: dict[str, tuple[int, int]], targets: dict[str, tuple[float, int]], total: int | None, block: int, shortfall: float) -> dict[str, int]:
    """Blocks wanted of each source. ``supply``: (tokens, blocks); ``targets``: (share, most repeats).

    Without ``total`` the mix is as large as it can be while the sources that run out before their
    share is full lack nothing, or ``shortfall`` of the mix together; shares of absent sources are spread
    over the rest in proportion.
    """
    there = {s: t for s, t in targets.items() if s in supply and t[0] > 0 and t[1] > 0}
    scale = sum(t[0] for t in there.values())
    if not there or not scale:
        return {}
    share = {s: t[0] / scale for s, t in there.items()}
    most = {s: supply[s][1] * t[1] for s, t in there.items()}
    if total is None:
        sizes = sorted(most[s] / share[s] for s in there)
        blocks = sizes[0]
        for n in () if shortfall <= 0 else np.geomspace(sizes[0], sizes[-1], 400):
            got = sum(min(most[s], share[s] * n) for s in there)
            lack = sum(max(0.0, share[s] - most[s] / got) for s in there if most[s] < share[s] * n)
            if lack > shortfall:
                break
            blocks = n
    else:
        blocks = total / block
    return {s: min(most[s], max(1, round(share[s] * blocks))) for s in there}


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` taken without replacement from ``good + bad`` are good.

    By inversion over the terms around the mode: ratios of neighbouring terms give their weights;
    twelve standard deviations to either side leave out less than a double can hold. Works for
    any counts below 2**53.
    """
    lo, hi = max(0, draws - bad), min(good, draws)
    if lo == hi:
        return lo
    n = good + bad
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (n + 2)))
    sd = math.sqrt(draws * (good / n) * (bad / n) * ((n - draws) / max(1, n - 1)))
    a, b = max(lo, mode - int(12 * sd) - 40), min(hi, mode + int(12 * sd) + 40)
    k = np.arange(a, b, dtype=float)  # log of term k+1 over term k
    step = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    w = np.concatenate([[0.0], np.cumsum(step)])
    w = np.cumsum(np.exp(w - w[mode - a]))
    return a + int(min(np.searchsorted(w, rng.random() * w[-1], side="right"), b - a))


def draw_counts(wanted: dict[str, int], seed: int) -> list[dict[str, int]]:
    """Blocks of each source in each output shard: draws without replacement, which are multinomial
    draws given the totals. One method at every size: source by source, what is left of one against
    what is left of those behind it."""
    names = sorted(wanted)
    left = {s: int(wanted[s]) for s in names}
    total = sum(left.values())
    if total >= 1 << 53:
        raise ValueError("more blocks than can be drawn")
    shards = max(1, min(MAX_SHARDS, -(-total // SLOTS_PER_SHARD)))
    rng = np.random.default_rng(seed)
    out = []
    for i in range(shards):
        size = (total * (i + 1)) // shards - (total * i) // shards
        rest, got = sum(left.values()), {}
        for s in names:
            rest -= left[s]
            n = hypergeometric(rng, left[s], rest, size)
            left[s] -= n
            size -= n
            if n:
                got[s] = n
        out.append(got)
    return out


def mix(documents: DataFrame, targets: DataFrame, path: str | None = None, total_tokens: int | None = None, block: int = BLOCK_TOKENS, key: str = "doc_id", text: str = "text", seed: int = 1, shortfall: float = 0.0) -> DataFrame:
    """The mix: ``shard, slot, source, block, repeat, key, token_start, token_end, at``.

    A slot is one block; the rows of a slot in order of ``at`` are its tokens. No block, and so no
    record, is used more than ``max_repeats`` times. Null and empty texts have no tokens. With no
    wanted source in the table the mix is empty. By default the mix is the largest that gives every
    source that is there its share exactly (to a block); ``shortfall`` buys a larger one.
    """
    segments = cut(source_blocks(documents, targets, path, block, key, text, seed))
    sums = segments.groupBy("source").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("tokens"), (F.max("block") + 1).alias("blocks"))
    supply = {r.source: (int(r.tokens), int(r.blocks)) for r in sums.collect()}  # a row for each target
    goal = {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in targets.where("source is not null").collect()}
    counts = draw_counts(plan_totals(supply, goal, total_tokens, block, shortfall), seed)
    spark, done, rows = documents.sparkSession, {}, []
    for shard, got in enumerate(counts):
        for s in sorted(got):
            salt = int.from_bytes(hashlib.blake2b(f"{seed}|{s}".encode(), digest_size=7).digest(), "big")
            rows.append((shard, s, done.get(s, 0), got[s], supply[s][1], salt))
            done[s] = done.get(s, 0) + got[s]
    plan = spark.createDataFrame(rows, "shard int, source string, first long, n long, blocks long, salt long")

    @F.pandas_udf(T.LongType())
    def image(index: pd.Series, size: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series(permuted(index.to_numpy(), size.to_numpy(), salt.to_numpy()))

    slots = plan.repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism))).select("shard", "source", "blocks", "salt", F.col("first") + F.col("n") - 1, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1, F.lit(SLOTS_PER_SHARD))).alias("run")).toDF("shard", "source", "blocks", "salt", "last", "run")
    # in runs, so that no row holds a long array
    slots = slots.select("shard", "source", "blocks", "salt", F.explode(F.sequence("run", F.least("last", F.col("run") + (SLOTS_PER_SHARD - 1)))).alias("slot"))
    turn = F.floor(F.col("slot") / F.col("blocks")).cast("long")
    slots = slots.select("shard", "source", "slot", turn.cast("int").alias("repeat"), image(F.col("slot") % F.col("blocks"), "blocks", F.col("salt") + turn * 7919).alias("block"))
    return slots.join(segments, ["source", "block"]).select("shard", "slot", "source", "block", "repeat", key, "token_start", "token_end", "at")


def mix_report(mixed: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """By source: wanted share, tokens, share reached, and the most times a token of a record is used."""
    by = mixed.groupBy("source").agg(F.sum(F.col("token_end").cast("long") - F.col("token_start")).alias("tokens"), (F.max("repeat") + 1).alias("most_uses"), F.count_distinct("shard", "slot").alias("blocks"))
    total = by.agg(F.sum("tokens").alias("all_tokens"))
    joined = targets.where("source is not null").join(by, "source", "left").crossJoin(F.broadcast(total))
    return joined.select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.round(F.coalesce(F.col("tokens"), F.lit(0)) / F.col("all_tokens"), 6).alias("share"))
