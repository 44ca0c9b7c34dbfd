"""Sources and sinks: tolerant readers, unions of sources, upserts, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is at a path or pattern; a reader that needs no schema is asked, which runs no job."""
    try:
        spark.read.text(path)
        return True
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def parquet_if_there(spark: SparkSession, *paths: str) -> DataFrame | None:
    """The first of the paths that exists, else None."""
    for p in paths:
        if exists(spark, p):
            return spark.read.parquet(p)
    return None


def parquet_union(spark: SparkSession, *paths: str, stem: str | None = None) -> DataFrame | None:
    """All paths that exist, by column names; ``stem`` names a column for each file's stem."""
    out = None
    for p in paths:
        if exists(spark, p):
            d = spark.read.parquet(p)
            d = d.withColumn(stem, F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)) if stem else d
            out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """JSON lines; blank ones are skipped, malformed ones dropped, or refused if ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def json_document(spark: SparkSession, path: str, schema: T.StructType | str, rows: str | None = None) -> DataFrame:
    """One JSON document, or the elements of its array field ``rows``."""
    d = spark.read.schema(schema).option("multiLine", True).json(path)
    return d.select(F.explode(rows).alias("r")).select("r.*") if rows else d


def annotations(spark: SparkSession, path: str, scores: Sequence[str]) -> DataFrame:
    """CSV annotations; rows with a score that is missing or no whole number are dropped."""
    d = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    for c in scores:
        d = d.withColumn(c, F.col(c).try_cast("int")).where(F.col(c).isNotNull())
    return d


def any_column(df: DataFrame, *names: str) -> Column:
    """The first of the named columns that is there and not null."""
    there = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def qa_pairs(df: DataFrame, source: str, question: Sequence[str] = ("Question", "question"), answer: Sequence[str] = ("Answer", "answer"), context: Sequence[str] = ("context",), drop_empty: bool = False) -> DataFrame:
    """A source brought to ``question, answer, context, source``."""
    out = df.select(any_column(df, *question).alias("question"), any_column(df, *answer).alias("answer"), any_column(df, *context).alias("context"), F.lit(source).alias("source"))
    return out.where((F.length("question") > 0) & (F.length("answer") > 0)) if drop_empty else out


def drug_documents(drugs: DataFrame) -> DataFrame:
    """Four documents of each drug record: overview, side effects, dosage, interactions."""
    name = F.concat(F.col("drug_name"), F.lit(" ("), F.col("generic_name"), F.lit(")"))
    parts = (("overview", F.concat_ws(" ", F.lit("Class:"), "drug_class", F.lit("Uses:"), "uses")), ("side_effects", F.col("side_effects")), ("dosage", F.col("dosage")), ("interactions", F.concat_ws(" ", "interactions", F.lit("Warnings:"), "warnings")))
    each = F.array(*[F.struct(F.lit(k).alias("part"), F.concat(name, F.lit(": "), v).alias("content")) for k, v in parts])
    return drugs.select("drug_name", F.explode(each).alias("d")).select("drug_name", "d.part", "d.content").where("content is not null")


def upsert(stored: DataFrame | None, fresh: DataFrame, key: str, order: str = "_order") -> DataFrame:
    """``stored`` with the rows of ``fresh`` in the place of those of the same key; of several fresh
    rows of a key the last one by ``order``, a column of ``fresh`` that is not stored.

    One aggregation that combines before its shuffle, so a key with a third of all rows is no long task.
    """
    if order not in fresh.columns:
        raise ValueError(f"no column {order} tells which row of a key is the last")
    kept = [c for c in fresh.columns if c != order]
    new = fresh.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in kept]), order).alias("r")).select("r.*")
    return new if stored is None else stored.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def rekeyed(store: DataFrame, source: str, content: str, chunk: str, key: str = "id") -> DataFrame:
    """A store under new deterministic ids: the digest of source, content and chunk number. Rows that
    get the same id are one row; of these the one with the largest content is kept."""
    made = store.drop(key).withColumn(key, F.sha1(F.concat_ws("\u0001", F.coalesce(F.col(source), F.lit("")), F.coalesce(F.col(content), F.lit("")), F.coalesce(F.col(chunk).cast("string"), F.lit("")))))
    rows = made.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*made.columns), F.length(content)).alias("r"))
    return rows.select("r.*").select(key, *[c for c in store.columns if c != key])


def export(df: DataFrame, path: str, kind: str = "json") -> None:
    """JSON lines or CSV, nested values as JSON text in CSV, columns of CSV in name order."""
    if kind == "csv":
        flat = [F.to_json(c).alias(c) if isinstance(t.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(c) for c, t in sorted((f.name, f) for f in df.schema)]
        df.select(*flat).write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").json(path)
