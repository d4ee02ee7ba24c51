"""The text problems' queries (p6 to p8). SQL can express none of them; tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialforge.functions.lineage import materialize
from trialforge.functions.text import folded
from trialforge.llm import mixing, pii, tokenizer
from trialforge.sources.files import exists
from trialforge.sources.tables import table

SEED = 20240


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Each document's token ids."""
    return tokenizer.encode(table(spark, d, "documents"))


def p6_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Texts and tokens of each source."""
    docs = table(spark, d, "documents").select("doc_id", "text", folded("source").alias("source"))
    counts = tokenizer.token_counts(docs.select(F.struct("doc_id", "source").alias("k"), "text"), "k")
    return counts.groupBy("k.source").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n_tokens").alias("n_tokens"))


def _language(lang: Column) -> Column:
    """The base code of a language tag of two or three letters; empty for everything else, so that there are few."""
    return F.regexp_extract(F.coalesce(folded(lang), F.lit("")), r"^([a-z]{2,3})(?:[-_].*)?$", 1)


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, list[mixing.Leaf]]:
    targets = table(spark, d, "mix_targets").select("mix_id", folded("source").alias("leaf"), "target_share", "max_repeats")
    docs = table(spark, d, "documents").select("doc_id", "text", folded("source").alias("leaf"), _language(F.col("lang")).alias("lang"))
    wanted = targets.select("leaf").distinct()
    docs = docs.join(F.broadcast(wanted) if mixing.is_small(targets) else wanted, "leaf", "left_semi")
    # every text is encoded once; the sums, the cuts and the drawing read the counts
    key = F.struct("doc_id", "leaf", "lang").alias("k")
    counted, _ = materialize(tokenizer.token_counts(docs.select(key, "text"), "k").select("k.*", "n_tokens"), "counts")
    sizes = counted.groupBy("leaf", "lang").agg(F.sum("n_tokens").alias("tokens"))
    # a table of the domains that sources belong to, where there is one
    domains = table(spark, d, "source_domains").select(folded("source").alias("leaf"), "domain") if exists(spark, f"{d}/source_domains.parquet") else None
    leaves = mixing.leaves_of(targets, sizes, domains)
    mixing.plan(leaves)
    return mixing.draw(counted, leaves, SEED), leaves


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The texts of each mix with their repeats."""
    drawn, _ = _mixed(spark, d)
    return drawn.withColumnRenamed("leaf", "source")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source of each mix."""
    return mixing.shares(*_mixed(spark, d)).withColumnRenamed("leaf", "source")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Each passage that holds personal information."""
    return pii.found(table(spark, d, "documents"))


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts with typed placeholders."""
    return pii.redacted(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p6_ids, p6_sizes, p7_mix, p7_shares, p8_found, p8_redacted)}
ORACLE: dict[str, str] = {}
