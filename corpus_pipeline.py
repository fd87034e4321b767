"""A corpus from raw documents to packed sequences: each stage works on all that the one before kept."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.llm import ngram_join, packing, quality, secret_scan, toxicity
from treeledger.llm.queries import documents, labels, tokenizer_path
from treeledger.llm.shared import free_name, stored

# Documents with a chance of being toxic from here on go.
TOXIC = 0.5
# Documents with a chance of being good below this go.
GOOD = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; a null text stays."""
    score = free_name(docs, "toxic_score")
    model = toxicity.fit(documents(spark, sf_dir), labels(spark, sf_dir), held_out=False)
    return toxicity.score(docs, model, score).where(F.col(score) < TOXIC).drop(score)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    score, known = free_name(docs, "quality_score"), labels(spark, sf_dir)
    model = quality.fit(documents(spark, sf_dir), known)
    return quality.score(docs, known, model, name=score).where(F.col(score) >= GOOD).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the document with the smallest doc_id stays.

    Rows without doc_id stay; of rows that share one, those of a kept doc_id stay all.
    """
    groups = ngram_join.ngram_components(docs, words=5, percent=80)
    gone = stored(groups.where("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    # The copies are those in the smaller table, so that is the side to broadcast if it is small.
    side = F.broadcast(gone) if gone.count() <= 1_000_000 else gone
    return docs.join(side, docs["doc_id"] == side["doc_id"], "left_anti").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; n_chars follows the text."""
    redacted = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return redacted
    length = "if(text IS NULL, n_chars, CAST(length(text) AS LONG)) AS n_chars"
    return redacted.selectExpr(*[length if c == "n_chars" else f"`{c}`" for c in docs.columns])


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near copies", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack_windows),
]

# Models and tokenizers have no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
