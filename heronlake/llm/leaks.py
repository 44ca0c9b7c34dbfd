"""Evaluation texts leaking into training text.

A positional inverted index is built over the corpus and stored as a table: for every block of
documents and every term one posting list, the places of the term in the block, delta-coded.
Blocks are what one task reads in a row, so building needs no shuffle, and a term that is in every
document has a list in every block and no long one anywhere. A held-out passage is looked up by
the rarest term of each of its windows, so that every window of ``words`` consecutive words holds a
term that is looked up; the lists of its other terms, moved by their offsets, are intersected
with what the rarest ones leave. Rarity is that within the block, which its list lengths tell. Runs of consecutive places give the exact phrases, the share of
terms found near an offset gives proximity matches.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import cut, ensure_checkpoint_dir

#: Words after which a block is closed.
BLOCK_WORDS = 1 << 18
#: Empty places between two documents of a block; bounds the slop of a proximity match.
GAP = 64
#: Held-out terms that are sent to all tasks at a time (eight bytes each); more are looked up in turns.
PASSAGE_TERMS = 500_000
#: Places of looked-up terms that are tried together.
CANDIDATES = 1 << 20
_TAG = re.compile(r"<[A-Za-z/!?][^<>]*>")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters and digits in a compatibility-normalised, case-folded text; markup tags and
    invisible characters do not count."""
    t = _TAG.sub("", text)
    t = "".join(c for c in unicodedata.normalize("NFKC", t) if unicodedata.category(c) != "Cf")
    return _WORD.findall(t.casefold())


@F.pandas_udf(T.ArrayType(T.StringType()))
def _odd_words(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else words_of(t))


def tokens(text: Column) -> Column:
    """Array of words. Plain ASCII stays in the JVM; only other texts go through Python, in a function
    marked non-deterministic so that no filter on its result runs it a second time."""
    plain = ~text.rlike(r"[^\x00-\x7F]")
    ascii_words = F.regexp_extract_all(F.lower(F.regexp_replace(text, r"<[A-Za-z/!?][^<>]*>", "")), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.when(plain, ascii_words).otherwise(_odd_words.asNondeterministic()(F.when(~plain, text)))


def held_out(tests: DataFrame) -> DataFrame:
    """Passages of the held-out items: ``test_id``, ``field`` (q or a) and ``terms`` as 64-bit hashes;
    query and reference answer each taken alone, equal passages of different items kept apart."""
    each = tests.select(F.col("id").alias("test_id"), F.explode(F.array(F.struct(F.lit("q").alias("field"), F.col("query").alias("t")), F.struct(F.lit("a").alias("field"), F.col("reference_answer").alias("t")))).alias("p")).where("p.t is not null and test_id is not null")
    return each.select("test_id", "p.field", tokens(F.col("p.t")).alias("w")).select("test_id", "field", F.transform("w", lambda t: F.xxhash64(t)).alias("terms")).distinct()


# ---- the index -----------------------------------------------------------------------------


def packed(deltas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative numbers in seven bits a byte, the high bit set on all but the last byte of each:
    the bytes, and how many each number takes."""
    d = deltas.astype(np.uint64)
    size = np.ones(len(d), dtype=np.int64)
    for k in range(1, 9):
        size += d >= np.uint64(1 << (7 * k))
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(d) else 0, dtype=np.uint8)
    start = end - size
    for k in range(int(size.max()) if len(d) else 0):
        has = size > k
        part = (d[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[start[has] + k] = part.astype(np.uint8) | ((size[has] > k + 1) * 128).astype(np.uint8)
    return out, size


def unpacked(raw: bytes, n: np.ndarray) -> np.ndarray:
    """Places of posting lists of lengths ``n``, one behind the other: the inverse of ``packed`` and of
    taking differences within each list."""
    b = np.frombuffer(raw, dtype=np.uint8)
    if not len(b):
        return np.zeros(0, dtype=np.int64)
    last = np.flatnonzero(b < 128)
    start = np.concatenate([[0], last[:-1] + 1])
    shift = (np.arange(len(b)) - np.repeat(start, last - start + 1)) * 7
    upto = np.cumsum(np.add.reduceat((b & 127).astype(np.int64) << shift, start))
    return upto - np.repeat(np.append(0, upto)[np.cumsum(n) - n], n)


def _block_rows(block: int, keys: list[pa.Array], terms: list[np.ndarray], sizes: list[np.ndarray], key_type: pa.DataType) -> pa.RecordBatch:
    """One block as rows ``block, term, n, places, docs``: a row without a term that holds the documents
    and where each begins, and a row for every term."""
    words, size = np.concatenate(terms), np.concatenate(sizes)
    docs = pa.concat_arrays(keys)
    begin = np.cumsum(size + GAP) - size  # a gap before the first document too
    place = np.arange(len(words)) + np.repeat(begin - (np.cumsum(size) - size), size)
    order = np.argsort(words, kind="stable")
    words, place = words[order], place[order]
    new = np.concatenate([[True], words[1:] != words[:-1]]) if len(words) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(new)
    step = np.diff(place, prepend=0)
    step[first] = place[first]
    raw, width = packed(np.concatenate([np.diff(begin, prepend=0), step]))
    n = np.concatenate([[len(begin)], np.diff(np.append(first, len(words)))])
    edges = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], len(begin) + first, [len(begin) + len(words)]])]
    rows = len(n)
    lists = pa.BinaryArray.from_buffers(pa.binary(), rows, [None, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
    term = pa.array(np.concatenate([[0], words[first]]).astype(np.int64), mask=np.arange(rows) == 0)
    held = pa.ListArray.from_arrays(pa.array([0] + [len(docs)] * rows, pa.int32()), docs)
    return pa.RecordBatch.from_arrays([pa.array(np.full(rows, block)), term, pa.array(n.astype(np.int64)), lists, held.cast(pa.list_(key_type))], names=["block", "term", "n", "places", "docs"])


def build_index(corpus: DataFrame, key: str, text: str, path: str | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Writes the index as a table to ``path`` (by default a new folder under the shared checkpoint
    folder) and reads it back: ``block, term, n, places, docs``.

    Rows with a null key or text, or without a word, are not in it; repeated rows each are.
    """
    spark = corpus.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    found = corpus.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("doc"), tokens(F.col(text)).alias("w"))
    hashed = found.select("doc", F.transform("w", lambda t: F.xxhash64(t)).alias("terms")).where(F.size("terms") > 0)
    kind = hashed.schema["doc"].dataType

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, ([], [], [])
        for batch in batches:
            docs, lists = batch.column(0), batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            upto = np.cumsum(size)
            at = 0
            while at < len(docs):  # as many documents as fill the block, one at least
                room = block_words - sum(map(len, held[1]))
                before = upto[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(upto, before + room, side="right")))
                for part, value in zip(held, (docs.slice(at, to - at), flat[before : upto[to - 1]], size[at:to])):
                    part.append(value)
                at = to
                if sum(map(len, held[1])) >= block_words or at < len(docs):
                    yield _block_rows(number, *held, docs.type)
                    number, held = number + 1, ([], [], [])
        if held[0]:
            yield _block_rows(number, *held, held[0][0].type)

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("term", T.LongType()), T.StructField("n", T.LongType()), T.StructField("places", T.BinaryType()), T.StructField("docs", T.ArrayType(kind))])
    hashed.mapInArrow(blocks, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


# ---- look-up -------------------------------------------------------------------------------


class Block:
    """The posting lists of one block that a look-up needs, as one sorted array of (term, place)."""

    def __init__(self, terms: np.ndarray, n: np.ndarray, raw: list[bytes], begins: bytes, docs: list):
        order = np.argsort(terms)
        self.terms, self.n = terms[order], n[order]
        self.first = np.cumsum(self.n) - self.n
        self.place = unpacked(b"".join([raw[i] for i in order]), self.n)
        self.begin = unpacked(begins, np.array([len(docs)]))
        self.docs = docs
        self.span = int(max(self.place.max(initial=0), self.begin[-1])) + GAP
        self.key = np.repeat(np.arange(len(terms)), self.n) * self.span + self.place

    def rank(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each term's list and its length (0 where the block lacks the term)."""
        if not len(self.terms):
            return np.zeros(len(terms), dtype=np.int64), np.zeros(len(terms), dtype=np.int64)
        r = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return r, np.where(self.terms[r] == terms, self.n[r], 0)

    def within(self, rank: np.ndarray | int, there: np.ndarray | bool, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether a list (which must be ``there``) has a place from ``lo`` to ``hi``; both lie in the block."""
        i = np.minimum(np.searchsorted(self.key, rank * self.span + lo), len(self.key) - 1)
        return there & (lo <= hi) & (self.key[i] >= rank * self.span + lo) & (self.key[i] <= rank * self.span + hi)

    def bounds(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place of a document and the last that can be its own."""
        return self.begin[doc], np.append(self.begin[1:], self.span + GAP)[doc] - GAP - 1

    def doc_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, place, side="right") - 1


class Passages:
    """Held-out passages laid one behind the other."""

    def __init__(self, terms: list[np.ndarray]):
        self.n = np.array([len(t) for t in terms], dtype=np.int64)
        self.flat = np.concatenate(terms)
        self.begin = np.cumsum(self.n) - self.n
        self.owner = np.repeat(np.arange(len(terms)), self.n)


def _ragged(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place in the row, for rows of lengths ``n``."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def phrases(block: Block, held: Passages, words: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Passage, document, longest run and matched terms, for each offset with a run of ``words``."""
    rank, count = block.rank(held.flat)
    if len(count) < words:
        return
    # the rarest term of each window; one that the block lacks rules its windows out
    windows = np.lib.stride_tricks.sliding_window_view(count, words)
    best = windows.argmin(axis=1)
    whole = held.owner[: len(best)] == held.owner[words - 1 :]
    anchors = np.unique((np.arange(len(best)) + best)[whole & (windows.min(axis=1) > 0)])
    # as many of them at a time as have CANDIDATES places
    upto = np.cumsum(count[anchors])
    for part in np.split(anchors, np.flatnonzero(np.diff(upto // CANDIDATES)) + 1):
        row, i = _ragged(count[part])
        at = part[row]
        place = block.place[block.first[rank[at]] + i]
        doc = block.doc_of(place)
        lo, hi = block.bounds(doc)

        def stands(step: int, at=at, place=place, lo=lo, hi=hi) -> np.ndarray:
            j = np.clip(at + step, 0, len(held.flat) - 1)
            p = place + step
            inside = (held.owner[j] == held.owner[at]) & (j == at + step) & (p >= lo) & (p <= hi)
            return block.within(rank[j], inside & (count[j] > 0), p, p)

        # a run of five or more around the looked-up term has two more terms on one side at least
        keep = stands(1)
        keep[keep] = stands(2)[keep]
        left = np.flatnonzero(~keep)
        keep[left] = (stands(-1) & stands(-2))[left]
        at, place, doc = at[keep], place[keep], doc[keep]
        own = held.owner[at]
        tries = np.unique(np.stack([own, place - (at - held.begin[own]), doc], axis=1), axis=0)
        if not len(tries):
            continue
        own, offset, doc = tries.T
        lo, hi = block.bounds(doc)
        row, j = _ragged(held.n[own])
        p, term = offset[row] + j, held.begin[own][row] + j
        inside = (p >= lo[row]) & (p <= hi[row])
        hit = block.within(rank[term], inside & (count[term] > 0), p, p)
        head = np.cumsum(held.n[own]) - held.n[own]
        number = np.arange(len(hit))
        missed = np.maximum.accumulate(np.where(hit, head[row] - 1, number))
        run = np.maximum.reduceat(number - missed, head)
        matched = np.add.reduceat(hit.astype(np.int64), head)
        good = run >= words
        yield own[good], doc[good], run[good], matched[good]


def proximity(block: Block, held: Passages, slop: int, share: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Passage, document and matched terms, for each offset near which ``share`` of the terms stand.

    Of the rarest terms three more than may be missing are looked up, so three of them stand within
    ``slop`` places of any offset that counts; every offset of which that holds is tried.
    """
    rank, count = block.rank(held.flat)
    need = np.maximum(1, np.ceil(held.n * share - 1e-9)).astype(np.int64)
    around = np.arange(-slop, slop + 1)
    for own in np.flatnonzero(np.add.reduceat((count > 0).astype(np.int64), held.begin) >= need):
        n, begin = int(held.n[own]), int(held.begin[own])
        r, c = rank[begin : begin + n], count[begin : begin + n]
        least = min(3, int(need[own]))
        rare = [j for j in np.argsort(c, kind="stable")[: n - need[own] + least] if c[j]]
        # an offset of the last place and one of the first are never the same number
        near = [np.unique((block.doc_of(p) * (2 * block.span) + block.span // 2 + (p - j))[:, None] + around) for j in rare for p in [block.place[block.first[r[j]] : block.first[r[j]] + c[j]]]]
        if len(near) < least:
            continue
        packed_offset, times = np.unique(np.concatenate(near), return_counts=True)
        packed_offset = packed_offset[times >= least]
        doc = packed_offset // (2 * block.span)
        offset = packed_offset - doc * (2 * block.span) - block.span // 2
        lo, hi = block.bounds(doc)
        # from the rarest term on, an offset leaves as soon as it misses more than the share allows
        left, missed = np.arange(len(doc)), np.zeros(len(doc), dtype=np.int64)
        for j in np.argsort(c, kind="stable").tolist():
            if c[j]:
                missed = missed + ~block.within(int(r[j]), True, np.maximum(offset[left] + (j - slop), lo[left]), np.minimum(offset[left] + (j + slop), hi[left]))
            else:
                missed = missed + 1
            stay = missed <= n - need[own]
            if not stay.all():
                left, missed = left[stay], missed[stay]
                if not len(left):
                    break
        yield np.full(len(left), own), doc[left], n - missed


def _matcher(sent: Broadcast, search: Callable, names: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One block's lists against the passages that were sent."""

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        named, head = pdf[~pdf["head"]], pdf[pdf["head"]].iloc[0]
        block = Block(named.term.to_numpy(), named.n.to_numpy(), named.places.tolist(), head.places, head.docs)
        items, passages = sent.value
        found = []
        for own, doc, *values in search(block, passages) if len(named) else ():
            if not len(doc):
                continue  # a frame without rows has no types that Arrow could take for text
            found.append(pd.DataFrame(dict(zip(names, ([block.docs[i] for i in doc], [items[i][0] for i in own], [items[i][1] for i in own], *values)))))
        return pd.concat(found) if found else pd.DataFrame({n: [] for n in names}, dtype=object)

    return match


def _look_up(index: DataFrame, held: DataFrame, search: Callable, out: str, key: str) -> DataFrame:
    """Runs ``search(block, passages)`` for all passages against every block that has lists of their terms.

    Passages are sent to all tasks, ``PASSAGE_TERMS`` terms at a time (counted before); the
    rest of them have their turn after that, each turn reading only the lists of its own terms.
    Lists meet by block, so nothing grows with the corpus but the number of groups.
    """
    spark = index.sparkSession
    held = cut(held)
    turns = -(-(held.agg(F.sum(F.size("terms"))).first()[0] or 0) // PASSAGE_TERMS)
    kind = index.schema["docs"].dataType.elementType.simpleString()
    names = [key, "test_id", "field", *(c.split()[0] for c in out.split(", "))]
    schema = f"{key} {kind}, test_id {held.schema['test_id'].dataType.simpleString()}, field string, {out}"
    whole = spark.createDataFrame([], schema)
    for turn in range(turns):
        mine = held.where(F.pmod(F.xxhash64("test_id", "field", "terms"), F.lit(turns)) == turn)
        rows = mine.collect()  # about PASSAGE_TERMS terms
        if not rows:
            continue
        sent = spark.sparkContext.broadcast(([(r.test_id, r.field) for r in rows], Passages([np.array(r.terms, dtype=np.int64) for r in rows])))
        wanted = F.broadcast(mine.select(F.explode("terms").alias("term")).distinct())

        lists = index.where("term is not null").join(wanted, "term", "left_semi").select("block", "term", "n", "places", F.lit(None).cast(index.schema["docs"].dataType).alias("docs"), F.lit(False).alias("head"))
        heads = index.where("term is null").select("block", F.lit(0), "n", "places", "docs", F.lit(True))
        whole = whole.unionAll(lists.unionAll(heads).groupBy("block").applyInPandas(_matcher(sent, search, names), schema))
    return whole


def _checked(tests: DataFrame, words: int) -> DataFrame:
    if words < 5:
        raise ValueError("runs of at least five words")
    return held_out(tests).where(F.size("terms") >= words)


def leaked_passages(corpus: DataFrame, tests: DataFrame, key: str = "chunk_pk", text: str = "content", words: int = 10, index: DataFrame | None = None) -> DataFrame:
    """Every (document, item) in which at least ``words`` consecutive words of the item's query or
    reference answer stand: ``key, test_id, field, run`` (longest run), ``matched`` (terms found on
    that offset) and ``share`` of the passage's terms.

    Passages with fewer words cannot be given away and yield nothing; null texts hold nothing;
    repeated documents yield one row for a key. ``words`` is at least 5. ``index`` is one that
    ``build_index`` made of the corpus before; by default it is made now.
    """
    held = _checked(tests, words)
    index = build_index(corpus, key, text) if index is None else index

    found = _look_up(index, held, lambda block, passages: phrases(block, passages, words), "run long, matched long", key)
    best = found.groupBy(key, "test_id", "field").agg(F.max(F.struct("run", "matched")).alias("b"))
    return _with_share(best.select(key, "test_id", "field", F.col("b.run").alias("run"), F.col("b.matched").alias("matched")), held)


def _with_share(found: DataFrame, held: DataFrame) -> DataFrame:
    """``share``: matched terms over those of the passage, the shortest where a field has more than one."""
    sizes = held.groupBy("test_id", "field").agg(F.min(F.size("terms")).alias("_n"))
    return found.join(sizes, ["test_id", "field"]).withColumn("share", F.round(F.least(F.lit(1.0), F.col("matched") / F.col("_n")), 4)).select(*found.columns, "share")


def near_passages(corpus: DataFrame, tests: DataFrame, key: str = "chunk_pk", text: str = "content", words: int = 10, slop: int = 3, share: float = 0.8, index: DataFrame | None = None) -> DataFrame:
    """Proximity matches: (document, item) where at least ``share`` of the terms of a passage stand
    within ``slop`` places of one offset: ``key, test_id, field, matched, share``. Nulls, copies
    and ``index`` as in ``leaked_passages``."""
    if not 0 <= 2 * slop < GAP:
        raise ValueError(f"slop must lie below {GAP // 2}")
    held = _checked(tests, words)
    index = build_index(corpus, key, text) if index is None else index

    found = _look_up(index, held, lambda block, passages: proximity(block, passages, slop, share), "matched long", key)
    return _with_share(found.groupBy(key, "test_id", "field").agg(F.max("matched").alias("matched")), held)
