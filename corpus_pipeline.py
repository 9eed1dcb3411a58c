"""A corpus pipeline of five stages: documents that pass are encoded.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Stages 1 to 4 return the columns of
`documents`; the last returns the encoding. Rejected: low quality, near duplicates but one of each group, documents with
benchmark passages. Secrets are replaced in the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from almanack.llm import bpe, decontaminate, jaccard_join, quality_classifier, secrets
from almanack.llm.common import fresh_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the classifier rejects go. It is fitted on those of docs that have labels."""
    return quality_classifier.keep(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of each group of near duplicates the document with the smallest id stays."""
    return jaccard_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents with a benchmark passage go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: secrets are replaced by a mark."""
    return secrets.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: ids and their decoding, in figures."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secret_scan), ("encoding", encoding)]
#: A classifier's verdicts can't be had from SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = fresh_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
