"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last
keep the columns of ``docs``, whatever they are. ``run`` applies them in order,
writing each stage's result as Parquet and reading it again. Empty tables give
empty results; null texts, which have no language, go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import bpe, decontaminate, langid, near_dup, secrets
from lodestack.llm.arrow import stash

#: Least share of a document's letters that its language must have.
LEAST_SHARE = 0.5


def _packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The whole row as one column, so that no operator's column can clash with it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *needed)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go."""
    rows = _packed(docs, "doc_id", "text", "lang")
    model = langid.fit(rows.filter(~langid.held_out() & F.col("doc_id").isNotNull()))
    found = langid.identify(rows, model, keep=["__row"])
    return found.filter((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SHARE)).select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return near_dup.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_contamination(_packed(docs, "text"), benchmark, keep=["__row"])
    return found.filter(F.size("decon_spans") == 0).select("__row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; ``n_chars`` follows."""
    found = secrets.redact(secrets.scan(_packed(docs, "text"))).select("__row", "text")
    changed = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return found.select(*[changed.get(c, F.col("__row")[c]).alias(c) for c in docs.columns])


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    rows = docs.select("doc_id", "lang", "source", "text")
    coded = bpe.decode(bpe.encode(rows))
    return coded.select(
        "doc_id", "lang", "source", "bpe_ids",
        F.size("bpe_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("bpe_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.col("bpe_text").eqNullSafe(F.col("text")).alias("round_trip"),
    )


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe_round_trip", bpe_round_trip),
]

#: No stage but decontamination can be put in SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
