"""A training-corpus pipeline of the library's operators, each stage a written table.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; docs is what the stage
before it returned, read again from Parquet.  All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontamination, jaccard_join, mixing, quality_rules, token_files
from weftline.llm.common import held_filter, new_path, numbered, small, spool, unspool

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Ids of labelled documents that are broadcast; more of them are joined by shuffle.
BROADCAST_ROWS = 500_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules and the learned list keep, each judged by its own text.

    The list is learned from all labelled documents in a first pass; the second judges and
    filters every document where it is read, so no text is shuffled or copied.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    known = small(labels.select("doc_id").where("doc_id is not null").distinct(), BROADCAST_ROWS)
    stats = spool(quality_rules.text_stats(docs.join(known, "doc_id", "left_semi"), keep=["doc_id"]), "quality-stats")
    rules = quality_rules.learn(stats.where(~quality_rules.base_failed()), labels)
    unspool(stats)
    judged = quality_rules.text_stats(docs, keep=COLUMNS)
    return held_filter(judged, ~quality_rules.base_failed() & rules.kept()).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, repeated rows and rows without an id among them."""
    return jaccard_join.one_of_each(numbered(docs, "document-files"), row_col="_row").select(COLUMNS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, whatever their ids."""
    rows = numbered(docs, "document-files")
    return decontamination.clean(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), row_col="_row").select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that source, language and topic meet their target shares."""
    return mixing.mix(docs).where("_sampled").select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, read back."""
    out_dir = new_path(spark, "token-files")
    manifest = token_files.write_token_files(docs, out_dir, token_files.default_tokenizer())
    return token_files.read_token_files(spark, out_dir, manifest)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("mixing sources", mixed),
    ("token output", tokens),
]

#: The learned rules have no SQL form; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        after = spool(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        unspool(docs)
        docs = after
    return docs
