"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gif_media, html_extract, langid, mixing, near_dedup, packing, quality_classifier, quality_rules, token_counts, warc
from .common import fold, scratch, stored, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold("doc_id", 3, 1)
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality_classifier.score(docs, model, held_out)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold("doc_id", 4, 2)
    return langid.identify(docs, langid.fit(docs, ~held_out), held_out)


#: Versions of the two counts that op7 keeps: an estimate from bytes, and the ids of the tokenizer.
ESTIMATE, EXACT = "bytes/4", "word_bpe_49k"


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents after four batches: estimates inserted, revised to exact counts, documents without a token
    deleted and inserted again.

    The revision is committed twice, as after a driver's restart; it counts once.
    """
    rollups = token_counts.Rollups(spark, scratch(spark, "rollups"))
    rows = stored(token_counts.counted(table(spark, sf_dir, "documents")), "token-counts")
    estimate = F.ceil(F.col("bytes") / 4)
    rollups.commit("insert-1", token_counts.inserts(rows, ESTIMATE, estimate))
    revised = token_counts.revisions(rows, (ESTIMATE, estimate), (EXACT, "tokens"))
    rollups.commit("revise-1", revised)
    rollups.commit("revise-1", revised)
    rollups.compact()
    rollups.commit("delete-1", token_counts.deletes(rows.where("tokens = 0"), EXACT, "tokens"))
    rollups.commit("insert-2", token_counts.inserts(rows.where("tokens = 0"), EXACT, "tokens"))
    return rollups.totals()


def op8_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = gif_media.stored_media(table(spark, sf_dir, "documents"))
    return gif_media.digests(stored(media, "media", compression="zstd"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_quality_classifier": op1_quality_classifier,
    "op2_quality_rules": op2_quality_rules,
    "op3_mixing": op3_mixing,
    "op4_html_extraction": op4_html_extraction,
    "op5_near_dedup": op5_near_dedup,
    "op6_language_id": op6_language_id,
    "op7_token_counts": op7_token_counts,
    "op8_gif_media": op8_gif_media,
    "op9_packing": op9_packing,
    "op10_warc": op10_warc,
}

#: Links by counting the shingles that two documents share; components by following links upwards from each id.
_NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w WHERE len(ws) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON d.doc_id = m.id
"""

#: DuckDB SQL for the queries that SQL can express; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_mixing": mixing.SQL,
    "op5_near_dedup": _NEAR_SQL,
    "op10_warc": warc.SQL,
}
