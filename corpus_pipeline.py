"""The corpus pipeline: five stages over `documents`, each written and read again by its runner.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of `docs`. Each works on all that its predecessor kept.

Defined results, for every stage: an empty table gives an empty table; very long texts
are read whole; other columns are passed through, whatever their names. A null or blank
text goes in the language stage, as it has no language; given to another stage, null
counts as empty, empty texts are copies of each other, hold no benchmark passage and are
no words for the mix. Of rows that repeat an id and its text the two dedup stages keep
one, the others treat each alike. Ties: of copies the smallest id stays; of languages
equally likely the first by name; a null id stays only where its group has no other. A
null source is a source of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import cut, quoted
from lodestrata.llm.decontaminate import decontaminate
from lodestrata.llm.exact_dedup import exact_dedup
from lodestrata.llm.langid import UND, held_out, identify, train
from lodestrata.llm.mixing import emit_mix
from lodestrata.llm.simhash_parts import near_dedup

#: A document is rejected without a language, or when the calibrated probability of the best one is lower. It is low, because
#: clean texts of a few words are right at 0.4 and over, and texts without a letter have no language at all.
MIN_LANGUAGE_SCORE = 0.35


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a recognisable language. Learns from the rows that op5 learns from."""
    model = train(docs.filter(~held_out(F.col("doc_id"), 5, 0)).select("doc_id", "text", "lang"))
    marked = identify(docs.withColumnsRenamed({"lang_pred": "__ls_lp", "score": "__ls_sc"}), model)
    kept = marked.filter((F.col("lang_pred") != UND) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.drop("lang_pred", "score").withColumnsRenamed({"__ls_lp": "lang_pred", "__ls_sc": "score"}).select(*quoted(docs.columns))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity 0.8 of five-word shingles) stays."""
    return near_dedup(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return emit_mix(docs)


STAGES = [
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("mix", mixing_stage),
]

#: Language ID and SimHash have no SQL equivalent: tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
