"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space at the edges in the Unicode sense, no-break spaces included.
EDGE_SPACE = r"^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$"

#: Characters that show nothing: format characters, and controls but for tab and line break.
INVISIBLE = re.compile(
    "[" + "".join(re.escape(chr(i)) for i in (*range(0x110), *range(0x600, 0x620), *range(0x6D0, 0x760), *range(0x890, 0x8F0), *range(0x1800, 0x1820), *range(0x2000, 0x2070), 0xFEFF, *range(0xFFF0, 0x10000)) if unicodedata.category(chr(i)) in ("Cf", "Cc") and chr(i) not in "\t\n") + "\U000e0001\U000e0020-\U000e007f]"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_id(c: Column | str) -> Column:
    """Trimmed, lower-cased id; null where nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.regexp_replace(c, EDGE_SPACE, "")), F.lit(""))


def logistic(examples: list[tuple[list[str], int, float]], rounds: int = 120, l2: float = 1e-4) -> dict[str, float]:
    """Maximum-entropy weights by feature from (features, label, weight), by full-batch Adagrad."""
    if not examples:
        return {}
    index: dict[str, int] = {}
    cols, owner = [], []
    for i, (fs, _, _) in enumerate(examples):
        for f in fs:
            cols.append(index.setdefault(f, len(index)))
            owner.append(i)
    cols, owner = np.array(cols), np.array(owner)
    y = np.array([e[1] for e in examples], float)
    w = np.array([e[2] for e in examples], float)
    w /= w.sum()
    theta, grad2 = np.zeros(len(index)), np.full(len(index), 1e-8)
    for _ in range(rounds):
        z = np.bincount(owner, theta[cols], len(y))
        g = np.bincount(cols, (w * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y))[owner], len(index)) + l2 * theta / len(y)
        grad2 += g * g
        theta -= 0.5 * g / np.sqrt(grad2)
    return {f: float(theta[i]) for f, i in index.items() if abs(theta[i]) > 1e-3}
