"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents:

1. language_id: documents without an identifiable language go.
2. near_dedup: of each group of near-duplicates (five-word shingles, a similarity of 0.8 or more) the one of the smallest doc_id stays.
3. decontamination: documents that hold a benchmark item, exactly or edited, go.
4. secret_scan: live-looking secrets are replaced in the text; copied examples stay.
5. source_mix: every document gets its place in the mix of sources.

Defined cases: null, empty and very long texts, repeated rows, ties and clashing columns are treated as each stage's
docstring says; an empty table gives an empty table; columns that documents have beyond its own pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import decontam, langid, mixing, secrets, simhash
from tarn.llm.common import discard, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is null, empty or without a letter go, and those that no learnt language explains; all other rows, repeated ones too, stay as they are, in columns of any name. A tie with the background stays."""
    return langid.keep_known(docs, langid.learn(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that of the smallest doc_id, of equal ids the first; rows with a null doc_id stay. Null and empty texts are alike, so they form one group. Columns of any name pass through."""
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds an item at the least score or above go; null and empty texts hold none. All other rows, repeated ones too, stay as they are, in columns of any name; without items all stay."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; only text changes, and a null text stays null. A value that as many owners have as the limit still counts as live. Columns of any name pass through."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays and gets five columns (mix_...), which take the place of input columns of these names; a null source is one of its own, repeated rows have places of their own."""
    return mixing.interleave(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
]

#: SQL can state neither the trained model nor the alignment nor the components: tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done = written(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
