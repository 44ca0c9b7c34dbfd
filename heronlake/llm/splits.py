"""Splits that keep related records together.

Records that share a session or a question, directly or through other records, form one unit.
Units are balanced by the largest-differencing method over K bins, which is run on blocks of
units inside tasks and then on the blocks' bin totals, and whole bins are dealt to the splits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.lineage import cut
from ..plans.skew import heavy_keys, salted_join, unused
from .common import clean_id

BINS = 200
#: Blocks whose bin totals are differenced together in one group: a group has BLOCKS * BINS rows.
BLOCKS = 64


def tied_keys(feedback: DataFrame, heavy_rows: int = 200_000) -> DataFrame:
    """Every key by which rows are placed, with its rows and its unit: ``kind, key, n, unit``.

    ``kind`` is ``s`` (session), ``q`` (question of rows without a session) or ``r`` (rows with
    neither, by the hash of the row). The table is read once, for the counts by session and question.
    A question's sessions are tied to its smallest session, so the graph has sessions only and
    a question asked in n sessions gives n-1 edges instead of all pairs.
    """
    session, question = clean_id("session_id"), clean_id("question_id")
    alone = F.when(session.isNull() & question.isNull(), F.sha1(F.to_json(F.struct(*[F.col(f"`{c}`") for c in feedback.columns]))))
    seen = cut(feedback.select(session.alias("session"), question.alias("question"), alone.alias("alone")).groupBy("session", "question", "alone").agg(F.count(F.lit(1)).alias("n")))
    both = seen.where("session is not null and question is not null").select("session", "question")
    # of each question its sessions, and the rows that have no session
    lead = seen.where("question is not null").groupBy("question").agg(F.min("session").alias("lead"), F.count("session").alias("sessions"), F.sum(F.when(F.col("session").isNull(), F.col("n"))).alias("loose"))
    lead = cut(lead.where("sessions > 1 or loose is not null"))
    shared = lead.where("sessions > 1")
    heavy = heavy_keys(shared, "question", least=heavy_rows, weight="sessions")
    edges = salted_join(both, shared.select("question", "lead"), "question", heavy=heavy, spread_by=["session"]).select("session", "lead")
    nodes = connected_components(edges, "session", "lead", heavy_rows=heavy_rows)
    of_session = seen.where("session is not null").groupBy(F.col("session").alias("key")).agg(F.sum("n").alias("n")).withColumn("kind", F.lit("s")).withColumn("at", F.col("key"))
    of_question = lead.where("loose is not null").select(F.col("question").alias("key"), F.col("loose").alias("n"), F.lit("q").alias("kind"), F.col("lead").alias("at"))
    placed = of_session.unionByName(of_question).join(nodes, F.col("at") == F.col("node"), "left")
    named = placed.select("kind", "key", "n", F.coalesce(F.concat(F.lit("s|"), F.coalesce("root", "at")), F.concat_ws("|", "kind", "key")).alias("unit"))
    return named.unionByName(seen.where("alone is not null").select(F.lit("r").alias("kind"), F.col("alone").alias("key"), "n", F.concat(F.lit("r|"), "alone").alias("unit")))


#: Sessions of a unit that are paired in one go: larger units are paired in blocks of this many.
PAIR_BLOCK = 1000


def tied_sessions(placed: DataFrame) -> DataFrame:
    """Pairs of different sessions that share a unit (``session_a < session_b``), from the keys that
    ``place_keys`` gives.

    Quadratic in the sessions of one unit, as it is defined over pairs. The first of a pair is spread
    over blocks of its unit, each of which meets all sessions of the unit, so that a unit with a
    third of all sessions is many tasks.
    """
    s = placed.where("kind = 's'").select(F.col("key").alias("session"), "unit")
    sizes = s.groupBy("unit").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("unit", F.ceil(F.col("m") / PAIR_BLOCK).cast("int").alias("blocks"))
    s = cut(s.join(sizes, "unit"))
    a = s.select(F.col("session").alias("session_a"), "unit", F.pmod(F.xxhash64("session"), F.col("blocks")).cast("int").alias("block"))
    b = s.select(F.col("session").alias("session_b"), "unit", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return a.join(b, ["unit", "block"]).where("session_a < session_b").select("session_a", "session_b")


def unit_members(placed: DataFrame) -> DataFrame:
    """One row for each key: its unit, the unit's split, sessions and rows."""
    sizes = placed.groupBy("unit").agg(F.count_if(F.col("kind") == "s").alias("sessions"), F.sum("n").alias("rows"))
    return placed.join(sizes, "unit").select("kind", "key", "unit", "split", "sessions", "rows")


def _difference(items: list[tuple[float, list[tuple[float, int]]]], bins: int, parent: dict[int, int]) -> list[tuple[float, int]]:
    """Largest differencing: the two items of the widest spread are combined, the heavy bins of one
    with the light bins of the other, until one item is left. An item is a list of (weight, node)
    in falling order, bins not listed being empty; ``parent`` gets which nodes share a bin."""
    heap = [(-spread, i, slots) for i, (spread, slots) in enumerate(items)]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - bins
        if over <= 0:
            slots = a + b
        else:
            start, light = bins - len(b), b[::-1]
            slots = a[:start]
            for (wa, na), (wb, nb) in zip(a[start:], light):
                parent[nb] = na
                slots.append((wa + wb, na))
            slots += light[over:]
        slots.sort(key=lambda s: (-s[0], s[1]))
        spread = slots[0][0] - (slots[-1][0] if len(slots) == bins else 0)
        heapq.heappush(heap, (-spread, serial, slots))
        serial += 1
    return heap[0][2] if heap else []


def _slots_of(weights: list[list[tuple[float, int]]], bins: int, nodes: int) -> list[int]:
    """Bin number of each node after differencing the given items."""
    parent: dict[int, int] = {}
    items = []
    for slots in weights:
        slots = sorted(slots, key=lambda s: (-s[0], s[1]))
        items.append((slots[0][0] - (slots[-1][0] if len(slots) == bins else 0), slots))
    final = {node: i for i, (_, node) in enumerate(_difference(items, bins, parent))}
    out = []
    for n in range(nodes):
        r = n
        while r in parent:
            r = parent[r]
        while n in parent and parent[n] != r:
            parent[n], n = r, parent[n]
        out.append(final[r])
    return out


def balance(units: DataFrame, unit: str, weight: str, bins: int = BINS) -> DataFrame:
    """Bin of every unit: columns ``unit, weight, bin``, bins near equal in total weight.

    Units are dealt by hash to tasks and sorted there, so that a task that runs again gives the
    same blocks; a block is one Arrow batch. Block totals are differenced in groups of ``BLOCKS``
    until one block is left. No task holds more than a batch or ``BLOCKS * bins`` totals.
    """
    spread = units.select(F.col(unit).cast("string").alias("unit"), F.col(weight).cast("double").alias("weight")).repartition("unit").sortWithinPartitions(F.desc("weight"), "unit").withColumn("part", F.spark_partition_id())

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for i, pdf in enumerate(batches):
            if len(pdf):
                slot = _slots_of([[(w, n)] for n, w in enumerate(pdf.weight)], bins, len(pdf))
                yield pd.DataFrame({"unit": pdf.unit, "weight": pdf.weight, "block": pdf.part.astype("int64") * (1 << 32) + i, "bin": slot})

    placed = cut(spread.mapInPandas(blocks, "unit string, weight double, block long, bin int"))
    bin_of = placed.select("block", "bin").distinct().withColumns({"top": F.col("block"), "top_bin": F.col("bin")})
    totals = placed.groupBy("block", "bin").agg(F.sum("weight").alias("weight"))
    while (n := totals.select("block").distinct().count()) > 1:
        groups = -(-n // BLOCKS)
        totals = totals.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)))

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["block", "bin"]).reset_index(drop=True)
            items: dict[int, list] = {}
            for node, (block, w) in enumerate(zip(pdf.block, pdf.weight)):
                items.setdefault(block, []).append((w, node))
            return pdf.assign(new_bin=_slots_of(list(items.values()), bins, len(pdf)))[["block", "bin", "weight", "group", "new_bin"]]

        step = cut(totals.groupBy("group").applyInPandas(merge, "block long, bin int, weight double, group long, new_bin int"))
        bin_of = cut(bin_of.join(step.select(F.col("block").alias("top"), F.col("bin").alias("top_bin"), "group", "new_bin"), ["top", "top_bin"]).select("block", "bin", F.col("group").alias("top"), F.col("new_bin").alias("top_bin")))
        totals = step.groupBy(F.col("group").alias("block"), F.col("new_bin").alias("bin")).agg(F.sum("weight").alias("weight"))
    return placed.join(bin_of.select("block", "bin", "top_bin"), ["block", "bin"]).select("unit", "weight", F.col("top_bin").alias("bin"))


def deal_bins(weights: dict[int, float], shares: dict[str, float]) -> dict[int, str]:
    """Whole bins to splits, heaviest first, each to the split that lacks most of its share."""
    total = sum(weights.values())
    lack = {name: share * total for name, share in shares.items()}
    out = {}
    for b, w in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        name = max(sorted(lack), key=lambda s: lack[s])
        out[b] = name
        lack[name] -= w
    return out


def place_keys(feedback: DataFrame, split_share: DataFrame, bins: int = BINS, heavy_rows: int = 200_000) -> DataFrame:
    """The keys of ``tied_keys`` with the ``split`` of their unit: units are differenced over bins and
    whole bins dealt. Shares are scaled to sum to one; null or negative shares count as zero."""
    shares = {r.split_name: max(0.0, r.target_share or 0.0) for r in split_share.where("split_name is not null").collect()}
    if not sum(shares.values()):
        raise ValueError("no split has a share")
    shares = {k: v / sum(shares.values()) for k, v in shares.items()}
    keys = cut(tied_keys(feedback, heavy_rows))
    placed = cut(balance(keys.groupBy("unit").agg(F.sum("n").alias("n")), "unit", "n", bins))
    totals = {r.bin: r.w for r in placed.groupBy("bin").agg(F.sum("weight").alias("w")).collect()}
    dealt = deal_bins(totals, shares)
    name = F.element_at(F.create_map(*[F.lit(x) for pair in dealt.items() for x in pair]), F.col("bin")) if dealt else F.lit(None).cast("string")
    return keys.join(placed.select("unit", name.alias("split")), "unit").select("kind", "key", "n", "unit", "split")


def assign_splits(feedback: DataFrame, split_share: DataFrame, bins: int = BINS, heavy_rows: int = 200_000) -> DataFrame:
    """Every row of ``feedback`` with a column ``split`` added.

    Rows with neither id are units of their own (equal rows share one). An empty table stays empty;
    a column named ``split`` that is already there is replaced, all others come through under whatever
    name. Unit weights are rows.
    """
    rows = feedback.drop("split")
    keys = cut(place_keys(rows, split_share, bins, heavy_rows))
    session, question = clean_id("session_id"), clean_id("question_id")
    alone = F.sha1(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])))
    key = F.coalesce(F.concat(F.lit("s|"), session), F.concat(F.lit("q|"), question), F.concat(F.lit("r|"), alone))
    own = unused("_key", rows.columns)
    split_of = keys.select(F.concat_ws("|", "kind", "key").alias(own), "split", "n")
    heavy = heavy_keys(split_of, own, least=heavy_rows, weight="n")
    return salted_join(rows.withColumn(own, key), split_of.drop("n"), own, heavy=heavy, spread_by=["feedback_id", "received_at"]).drop(own)


def split_report(assigned: DataFrame, split_share: DataFrame) -> DataFrame:
    """Rows and share reached by each split beside the wanted share."""
    got = assigned.groupBy(F.col("split").alias("split_name")).agg(F.count(F.lit(1)).alias("rows"))
    total = got.agg(F.sum("rows").alias("all_rows"))
    return split_share.join(got, "split_name", "left").crossJoin(F.broadcast(total)).select("split_name", "target_share", F.coalesce("rows", F.lit(0)).alias("rows"), F.round(F.coalesce("rows", F.lit(0)) / F.col("all_rows"), 6).alias("share"))
