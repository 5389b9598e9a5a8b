"""A corpus pipeline of five stages over ``documents``; each stage works on all that the one before kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents. ``run``
writes each stage's rows as Parquet into the cluster's shared folder and reads them again for the next.

Defined cases, beside those of the operators: null and empty texts are in no language and go with the first stage; very
long texts are judged whole; rows with a null id are judged like others and are never near duplicates; rows that repeat
an id and its text are one document, and rows with one id and other texts are documents of their own; of a group the
least id stays; an empty table stays empty; further columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txstream.llm import langid, mixing, near_dedup, packing, quality_rules
from txstream.llm.common import free_name, stored, table
from txstream.operators.joins import looked_up, sifted

#: A document whose main language has a smaller share of its words than this, among the languages that it is found to be
#: in, is rejected, as one without a letter is, and one that letters drawn by chance explain better than its languages do.
LEAST_SHARE = 0.5


def _restored(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The carried columns under their own names."""
    return rows.select(*[F.col(f"carry_{k}").alias(c) for k, c in enumerate(columns)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without a letter, in none of the languages or without a main one go."""
    found = langid.identify(docs, langid.fit(docs), carry=tuple(docs.columns))
    return _restored(found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("gain") >= 0) & (F.col("score") >= LEAST_SHARE)), docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the calibrated classifier keep."""
    judged = quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")), carry=tuple(docs.columns))
    return _restored(judged.where("kept"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    Of rows that share an id, the one of least hashed text has that id here and the others have ids beyond all others, by
    their text; so each is judged by its own text.
    """
    own, kept, rows = (free_name(n, docs.columns) for n in ("__dedup_id", "__dedup_kept", "__dedup_rows"))
    text = F.coalesce(F.xxhash64("text"), F.lit(0))
    shared = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(own)).agg(F.count("*").alias(rows), F.min(text).alias(kept)).where(F.col(rows) > 1)
    named = looked_up(docs.withColumn(own, F.col("doc_id")), stored(shared, "shared"), own, rows)
    beyond = F.lit(1 << 62) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 61))
    named = named.withColumn(own, F.when(F.col(kept).isNull() | (F.col(kept) == text), F.col("doc_id").cast("long")).otherwise(beyond)).drop(kept)
    found = near_dedup.near_duplicates(named.select(F.col(own).alias("doc_id"), "text"), size=5, percent=80).where("doc_id is not null")
    # only ids that go, or that several rows share, are joined with the texts; other texts stay where they are
    marks = found.groupBy(F.col("doc_id").alias(own)).agg(F.min("kept").alias(kept), F.count("*").alias(rows)).where(~F.col(kept) | (F.col(rows) > 1))
    marks = stored(marks.drop(rows), "marks")
    some, others = sifted(named, marks, own)
    marked = some.join(marks, own, "left")
    once = others.select(docs.columns).union(marked.where(F.col(kept).isNull()).select(docs.columns))
    return once.union(marked.where(kept).dropDuplicates([own]).select(docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents repeated at their sources' target rates, shuffled."""
    return mixing.mix(docs, details=False)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, with their ids."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can express neither the models nor the tokenizer; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
