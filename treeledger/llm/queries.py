"""One query for each operator, over its whole table with production parameters, and SQL that checks it."""

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from treeledger.llm import (
    bpe,
    embedding_join,
    external_shuffle,
    ngram_join,
    order_minhash,
    packing,
    pfor,
    pii,
    pivotal_grams,
    quality,
    secret_scan,
    toxicity,
    whitening,
)

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def tokenizer_path(name: str) -> str:
    """A public vocabulary file: in TOKENIZER_DIR, or where the package of these files has it."""
    path = os.path.join(TOKENIZERS, name)
    if os.path.exists(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


_DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
_LABELS = "doc_id long, quality int, toxic int"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(_DOCUMENTS).parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(_LABELS).parquet(f"{sf_dir}/labels.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "vec_id long, embedding array<float>, label int"
    return spark.read.schema(schema).parquet(f"{sf_dir}/embeddings.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, labels(spark, sf_dir))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.selectExpr(
        "doc_id", f"{toxicity.HELD_OUT} AS held_out", "score", "CAST(score >= 0.5 AS INT) AS predicted"
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(documents(spark, sf_dir), words=4, percent=85)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir))
    kinds = pii.KINDS[:4]
    base = "filter(spans, x -> x.base)"
    return found.selectExpr(
        "doc_id",
        *[f"CAST(size(filter(spans, x -> x.base AND x.kind = '{k}')) AS LONG) AS n_{k}" for k in kinds],
        f"sha2({pii.listed(base, pii.KINDS)}, 256) AS base_sha256",
        f"{pii.listed('spans', pii.KINDS)} AS spans",
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, known = documents(spark, sf_dir), labels(spark, sf_dir)
    model = quality.fit(docs, known, held_out=True)
    scored = quality.score(docs.select("doc_id", "text", "source", "lang"), known, model, held_out=True)
    return scored.selectExpr("doc_id", f"{toxicity.HELD_OUT} AS held_out", "score", "score >= 0.5 AS kept")


def op5_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_vectors(embeddings(spark, sf_dir), 0.93)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(documents(spark, sf_dir))
    base = "filter(spans, x -> x.kind <> 'random')"
    return found.selectExpr(
        "doc_id",
        *[f"CAST(size(filter(spans, x -> x.kind = '{k}')) AS LONG) AS n_{k}" for k in secret_scan.KINDS[:3]],
        f"sha2({pii.listed(base, secret_scan.KINDS, by_start=True)}, 256) AS base_sha256",
        f"{pii.listed('spans', secret_scan.KINDS, by_start=True)} AS spans",
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_with_edit(documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.round_trip(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op11_pivotal_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivotal_grams.spelling_groups(documents(spark, sf_dir))


def op12_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return external_shuffle.shard_documents(documents(spark, sf_dir), shards=8)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(embeddings(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_toxicity,
        op2_ngram_join,
        op3_pii,
        op4_quality,
        op5_embedding_join,
        op6_packing,
        op7_secret_scan,
        op8_bpe,
        op9_order_minhash,
        op10_token_files,
        op11_pivotal_grams,
        op12_external_shuffle,
        op13_whitening,
        pipeline,
    ]
    return {f.__name__: f for f in found}


# From links in both directions to the smallest node that each node reaches.
_REACH = """
reach AS (
  SELECT {id} AS a, {id} AS b FROM {nodes}
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
smallest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)"""

_NGRAM = (
    """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 2, 2)),
         lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words),
grams AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * c >= 85 * (len(x.s) + len(y.s) - c)),"""
    + _REACH.format(id="doc_id", nodes="sets")
    + """
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN smallest ON a = doc_id"""
)

_VECTORS = (
    """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS MATERIALIZED (
  SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS length FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND NOT list_contains(list_transform(e, lambda x: x IS NULL OR NOT isfinite(x)), true)
    AND list_contains(list_transform(e, lambda x: x <> 0), true)),
links AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_dot_product(x.e, y.e) / (x.length * y.length) >= 0.93),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a),"""
    + _REACH.format(id="vec_id", nodes="v")
    + """
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN smallest s ON s.a = vec_id LEFT JOIN counted c ON c.a = vec_id"""
)


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express; the others are tested against plain versions and round trips."""
    return {"op2_ngram_join": _NGRAM, "op5_embedding_join": _VECTORS}
