"""Training corpus: language, near copies, benchmark overlap, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes what
a stage gives to a fresh shared folder and hands the next one what it reads back.
All but the last return the columns of ``documents``; further columns of the input
are not passed on.

* language: documents of no language, those without a letter, go; ``lang`` of all others is
  the language that the model finds. Short texts are near no prototype, so a low score is no
  reason to drop one.
* near_copies: documents link when they share 80 percent or more of their five-word n-grams.
  Of each group of linked documents the one with the smallest id stays, of several texts of
  that id the one with the smallest digest; a NULL id comes last.
* decontaminate: documents go of which benchmark phrases cover a twentieth or more.
* secrets: secrets in a text are replaced by a mark; n_chars follows.
* tokens: the token ids of each text, and whether they decode to it again.

A NULL or empty text goes at the first stage. Repeated rows of one id and text stay
once; an id with several texts stands for several documents. Empty tables give empty
tables at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thingroups.llm import bpe, decontaminate, jaccard, langid, secrets
from thingroups.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of an n-gram, and the percentage that near copies share.
NGRAM, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.identify(docs, COLUMNS)
    return found.where(F.col("lang_pred") != "und").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.col("text").cast("binary"), 256)
    classes = jaccard.near_copies(docs.withColumn("digest", digest), NGRAM, PERCENT, also=["digest"])
    found = stored(classes, "pipeline-components")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    first = found.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(order).alias("first")).select("first.*")
    apart = found.where(F.col("component").isNull()).select(order.alias("first")).select("first.*").distinct()
    kept = first.unionByName(apart).select(F.col("doc_id").alias("kept"), F.col("digest").alias("kept_digest"))
    same = F.col("doc_id").eqNullSafe(F.col("kept")) & digest.eqNullSafe(F.col("kept_digest"))
    return docs.select(*COLUMNS).join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlaps(docs, table(spark, sf_dir, "benchmark"), COLUMNS)
    return found.where(~decontaminate.contaminated()).select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scanned = secrets.scan(docs.select(*COLUMNS))
    clean = scanned.withColumn("text", secrets.redact(scanned))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    keys = ["doc_id", "lang", "source", "digest"]
    encoded = bpe.encode(docs.withColumn("digest", digest), path, public_tokenizers.PATTERN, keys=keys, decoded="decoded")
    return encoded.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        (F.sha2("decoded", 256) == F.col("digest")).alias("round_trip"),
    )


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("decontaminate", decontaminated),
    ("secrets", without_secrets),
    ("tokens", tokens),
]
#: The stages use models, connected components and an encoder: no SQL gives their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
