"""Sentence boundaries across languages and scripts.

Line and white-space rules fix the segments; inside a segment every run of end marks is a candidate
boundary. Candidates are classified by a maximum-entropy (logistic) model over the mark, the closing
quotes after it, the neighbouring tokens, their case, length and digits, the script and whether the
place lies inside a quotation or bracket. The model trains on reliable boundaries only: an end mark
at the end of a line is a boundary; a kind of place that is frequent and never stands at the end of a
line ("Dr.", "z. B.", a question mark before a quoting verb) is none. Everything else is unlabelled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import logistic

#: Bound on the documents from which the classifier learns; counts of documents are not affected.
TRAIN_DOCS = 20_000
#: Bound on the distinct labelled places that are brought together for training.
TRAIN_PLACES = 400_000
#: A kind of place counts as never ending a line when this many line ends were to be expected.
EXPECTED = 5.0

_BREAK = re.compile(r"\s*\n\s*")
_SPECIAL = re.compile(r"[.!?…。！？｡؟۔।॥|]+|[\"“”„«»「」『』（）()\[\]{}]")
_LIST_MARK = re.compile(r"\s*(?:\d{1,3}|[A-Za-z])[.)](?=\s)")
_CLOSING = {"”": "“„", "“": "„", "»": "«", "«": "»", "」": "「", "』": "『", "）": "（", ")": "(", "]": "[", "}": "{"}
_OPENING = set("“„«「『（([{")
_WIDE = set("。！？｡…")
_THAI_GAP = re.compile(r"(?<=[฀-๏๚-๿])[^\S\n]+(?=[฀-๏๚-๿])")
_HAN_GAP = re.compile(r"(?<=[㐀-鿿豈-﫿。！？”」』）…])[^\S\n]+(?=[㐀-鿿豈-﫿“「『（])")
#: A sentence end glued to the word that follows it ("decides.Dr").
_GLUED = re.compile(r"^.*[^\W\d_]{2}[.!?][\"'”’»)]*(?=[^\W\d_])(?=.?[^\W\d_])")
_DIGITS = re.compile(r"\d+")
_KANA = re.compile(r"[぀-ヿ]")
_THAI = re.compile(r"[฀-๿]")
_HAN = re.compile(r"[㐀-鿿]")


def segments(text: str) -> Iterator[tuple[int, int]]:
    """Spans ended by an empty line, or by a line break that no lower-case letter follows."""
    start = 0
    for m in _BREAK.finditer(text):
        if m.group().count("\n") > 1 or m.end() >= len(text) or not text[m.end()].islower():
            if text[start : m.start()].strip():
                yield start, m.start()
            start = m.end()
    if text[start:].strip():
        yield start, len(text)


@lru_cache(1 << 16)
def _script(c: str) -> str:
    o = ord(c)
    if o < 0x250:
        return "digit" if c.isdigit() else "latin"
    for lo, hi, name in ((0x370, 0x3FF, "greek"), (0x400, 0x52F, "cyrillic"), (0x590, 0x5FF, "hebrew"), (0x600, 0x6FF, "arabic"), (0x900, 0xDFF, "indic"), (0xE00, 0xE7F, "thai"), (0x3040, 0x30FF, "kana"), (0x3400, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul")):
        if lo <= o <= hi:
            return name
    return "other"


@lru_cache(1 << 16)
def _kind(c: str) -> str:
    """Class of the first character after a candidate."""
    if not c:
        return "end"
    if c.isdigit():
        return "digit"
    if c.isupper():
        return "upper"
    if c.islower():
        return "lower"
    if c.isalpha():
        return "letter"
    if c in _OPENING or c in "\"'¿¡‘":
        return "open"
    if c in ",;:،؛、，；：":
        return "comma"
    return "dash" if c in "-–—" else "mark"


@lru_cache(1 << 16)
def _shape(w: str) -> str:
    if not w:
        return "none"
    size = "1" if len(w) == 1 else "2" if len(w) == 2 else "3" if len(w) == 3 else "5" if len(w) < 6 else "long"
    what = "num" if w[-1].isdigit() else "upper" if w.isupper() else "title" if w[:1].isupper() else "lower"
    return f"{what}{size}{'.' if '.' in w else ''}"


def places(text: str, start: int, end: int) -> Iterator[tuple[int, bool, tuple]]:
    """Candidates of one segment: position after mark and closers, whether the segment ends there,
    and the description that the classifier sees."""
    head = _LIST_MARK.match(text, start, end)
    skip = head.end() if head else start
    stack: list[str] = []
    pos = skip
    while m := _SPECIAL.search(text, pos, end):
        pos, s = m.end(), m.group()
        if s in _CLOSING and stack and stack[-1] in _CLOSING[s] and not (s == "«"):
            stack.pop()
            continue
        if s == '"':
            if '"' in stack:
                while stack.pop() != '"':
                    pass
            else:
                stack.append(s)
            continue
        if s in _OPENING:
            stack.append(s)
            continue
        if s in _CLOSING:
            continue
        before = text[m.start() - 1] if m.start() > start else ""
        if s[0] == "|" and _script(before or " ") != "indic":
            continue
        closers = ""
        while pos < end:
            c = text[pos]
            if c in _CLOSING and stack and stack[-1] in _CLOSING[c]:
                stack.pop()
            elif c == '"' and '"' in stack:
                while stack.pop() != '"':
                    pass
            elif c in "’'" and not closers and pos + 1 < end and not text[pos + 1].isalnum():
                pass
            elif c in "   " and pos + 1 < end and text[pos + 1] == "»" and "«" in stack:
                pos += 1
                continue
            else:
                break
            closers += c
            pos += 1
        nxt = pos
        while nxt < end and text[nxt].isspace():
            nxt += 1
        last = nxt >= end
        spaced = last or nxt > pos
        after = text[nxt] if not last else ""
        wide = s[-1] in _WIDE or s[-1] in "।॥؟۔"
        if not spaced and not wide and not (after.isupper() and before.islower()) and not (after in '"«„“(' and after) and not (closers and _script(after) not in ("latin", "digit")):
            continue
        word = text[max(start, m.start() - 24) : m.start()]
        word = ("" if not word or word[-1].isspace() else word.rsplit(None, 1)[-1]).lstrip("\"'“„«「『（([{¿¡—–-•*")
        if "." in word or "!" in word or "?" in word:
            word = _GLUED.sub("", word)
        low = _DIGITS.sub("0", word.lower())
        scr = _script(before) if before else "none"
        if scr in ("han", "kana", "thai"):
            low = word[-2:]
        if last:
            n = end
            while n < len(text) and text[n].isspace():
                n += 1
            after = text[n] if n < len(text) else ""
            head = _LIST_MARK.match(text, n)
            nxt = n
            if head or after in "•*-–":
                after = ""
        b = nxt
        if after.isalpha():
            while b < len(text) and b < nxt + 16 and text[b].isalpha():
                b += 1
        following = text[nxt:b] if after else ""
        initial = len(following) == 1 and text[b : b + 1] == "."
        follow = following.lower() if _script(after or " ") in ("latin", "cyrillic") and not initial else "."
        mark = s if len(s) < 3 else s[:1] * 3
        yield pos, last, (mark, closers[:2], scr, bool(stack), low if s[0] == "." and len(s) == 1 else "", _shape(word), _kind(after), follow if not initial else "initial", spaced)


def _features(p: tuple) -> list[str]:
    mark, closers, script, inside, low, shape, kind, follow, spaced = p
    out = ["b", f"m{mark}{closers}|{script}", f"m{mark}{closers}|{script}|{kind}", f"i{inside}", f"i{inside}|{mark}", f"sp{spaced}|{script}|{mark}"]
    if mark == ".":
        return out + [f"w{low}", f"w{low}|{kind}", f"s{shape}", f"s{shape}|{kind}", f"s{shape}|{kind}|{script}", f"f{follow}", f"k{kind}|{script}", f"t{low[-3:]}|{script}"]
    return out + [f"f{mark}|{follow}", f"k{mark}{closers}|{kind}"]


def _kind_key(p: tuple) -> tuple:
    mark, closers, script, inside, low, _, kind, _, _ = p
    return mark, closers, script, inside, low, "dash" if kind in ("dash", "comma") else ""


def train(described: pd.DataFrame) -> dict[str, float]:
    """Weights by feature. ``described``: a row for each distinct description, with columns
    ``place``, ``last`` (at a line end) and ``n``."""
    seen, ends = Counter(), Counter()
    base_n, base_e = Counter(), Counter()
    rows = [(tuple(p), bool(e), int(n)) for p, e, n in zip(described.place, described["last"], described.n)]
    for p, e, n in rows:
        k = _kind_key(p)
        seen[k] += n
        base_n[k[2]] += n
        if e:
            ends[k] += n
            base_e[k[2]] += n
    overall = sum(base_e.values()) / max(1, sum(base_n.values()))
    data: list[tuple[list[str], int, float]] = []
    for p, e, n in rows:
        k = _kind_key(p)
        rate = base_e[k[2]] / base_n[k[2]] if base_e[k[2]] else overall
        if e:
            data.append((_features(p[:6] + (p[6] if p[6] not in ("end",) else "upper",) + p[7:]), 1, n))
        elif not ends[k] and seen[k] * rate >= EXPECTED:
            data.append((_features(p), 0, n))
        elif ends[k] >= 3 and ends[k] >= 0.25 * rate * seen[k] and p[6] in ("upper", "letter", "open", "digit"):
            data.append((_features(p), 1, n))
    return logistic([(fs, y, math.log1p(n)) for fs, y, n in data])


def fit(documents: DataFrame, text: str = "text", key: str = "doc_id", train_docs: int = TRAIN_DOCS, total: int | None = None) -> dict[str, float]:
    """The classifier, fitted on at most about ``train_docs`` documents taken by hash of their key.

    Descriptions are found and counted in tasks; at most ``TRAIN_PLACES`` distinct ones, the most
    frequent, reach the driver. A corpus without reliable boundaries gives an empty model, with
    which every candidate counts as a boundary unless a lower-case letter follows.
    """
    docs = documents.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    total = total if total is not None else documents.count()
    if total > train_docs:
        docs = docs.where(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < math.ceil(1_000_000 * train_docs / total))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c: Counter = Counter()
            for t in pdf.t:
                for a, b in segments(t):
                    for _, last, p in places(t, a, b):
                        c[p, last] += 1
            if c:
                yield pd.DataFrame({"place": ["\x1f".join(map(str, p)) for p, _ in c], "last": [e for _, e in c], "n": list(c.values())})

    counted = docs.mapInPandas(describe, "place string, last boolean, n long").groupBy("place", "last").agg(F.sum("n").alias("n"))
    got = counted.orderBy(F.desc("n"), "place", "last").limit(TRAIN_PLACES).toPandas()

    def back(s: str) -> tuple:
        x = s.split("\x1f")
        return (x[0], x[1], x[2], x[3] == "True", *x[4:8], x[8] == "True")

    got["place"] = got.place.map(back)
    return train(got)


def split_text(text: str, weights: dict[str, float], memo: dict | None = None) -> list[tuple[int, int]]:
    """Sentence units of one text as (start, end) in code points."""
    memo = {} if memo is None else memo
    out = []
    thai, han = bool(_THAI.search(text)), bool(_HAN.search(text)) and not _KANA.search(text)
    for a, b in segments(text):
        cuts = []
        for pos, last, p in places(text, a, b):
            if last:
                continue
            ok = memo.get(p)
            if ok is None:
                ok = p[6] != "comma" and (sum(weights.get(f, 0.0) for f in _features(p)) > 0 if weights else p[6] != "lower" and not p[3])
                if len(memo) < 500_000:
                    memo[p] = ok
            if ok:
                cuts.append(pos)
        if thai:
            cuts += [m.start() for m in _THAI_GAP.finditer(text, a, b)]
        if han:
            cuts += [m.start() for m in _HAN_GAP.finditer(text, a, b)]
        for e in [*sorted(set(cuts)), b]:
            x, y = a, e
            while x < y and text[x].isspace():
                x += 1
            while y > x and text[y - 1].isspace():
                y -= 1
            if x < y:
                out.append((x, y))
            a = e
    return out


def sentence_units(documents: DataFrame, weights: dict[str, float] | None = None, text: str = "text", key: str = "doc_id", with_text: bool = True) -> DataFrame:
    """One row for each unit: ``key, sent_no, sent_start, sent_end`` and, if wished, ``sentence``.

    Positions count code points from 0, the end is exclusive, no white space stands at an edge.
    Null and blank texts give no rows; repeated rows give repeated units; texts of any length are
    read whole, one at a time; other columns are left aside. Narrow: no shuffle beyond training.
    """
    weights = fit(documents, text, key) if weights is None else weights
    kind = dict(documents.dtypes)[key]
    model = documents.sparkSession.sparkContext.broadcast(weights)  # bounded by TRAIN_PLACES

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        w = model.value
        for pdf in batches:
            ids, no, start, end, parts = [], [], [], [], []
            for k, t in zip(pdf["k"], pdf["t"]):
                for i, (a, b) in enumerate(split_text(t, w, memo)):
                    ids.append(k), no.append(i), start.append(a), end.append(b)
                    if with_text:
                        parts.append(t[a:b])
            if ids:
                yield pd.DataFrame({"k": ids, "sent_no": no, "sent_start": start, "sent_end": end} | ({"sentence": parts} if with_text else {}))

    schema = f"k {kind}, sent_no int, sent_start int, sent_end int" + (", sentence string" if with_text else "")
    return documents.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("k").isNotNull() & F.col("t").isNotNull()).mapInPandas(cut_up, schema).withColumnRenamed("k", key)
