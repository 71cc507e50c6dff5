"""The corpus pipeline: documents without toxic, unreadable, near-duplicate and contaminated ones, packed for training.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept; all but the last
return the columns of ``documents``. Tables with nothing in them pass through as such.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import fold, materialize, table
from claimweave.llm.decontam import decontaminate
from claimweave.llm.jaccard import JaccardJoin
from claimweave.llm.langid import UNKNOWN, RankOrderProfiles
from claimweave.llm.packing import best_fit
from claimweave.llm.queries import labelled
from claimweave.llm.tokens import token_counts
from claimweave.llm.toxicity import FactorizationMachine

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents farther than this from every profile (as a share of the largest distance) are in no known language; documents in a known
#: language stay below 0.6.
MOST_DISTANCE = 0.85
BATCH = 2000


def lean(spark: SparkSession) -> None:
    """Rows that go to a Python worker at once: whole texts of 10,000 rows (the default) fill a small executor that also writes Parquet."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxicity score of 0.5 or more go. Labels of the held-out fold are not learned from."""
    lean(spark)
    rows = docs.select(*COLUMNS)
    train = labelled(rows.where(fold("doc_id") % 5 != 0).select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return FactorizationMachine().fit(train).predict(rows).where("predicted = 0").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter and documents far from every language's profile go. Without any profile all with letters stay."""
    lean(spark)
    rows = docs.select(*COLUMNS)
    model = RankOrderProfiles().fit(rows, where=fold("doc_id") % 5 != 0)
    if not model.profiles:
        return rows.where(F.col("text").rlike(r"\p{L}"))
    return model.predict(rows).where((F.col("lang_pred") != UNKNOWN) & (F.col("distance") <= MOST_DISTANCE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five-word shingles, similarity of 0.8 or more) the smallest id stays."""
    lean(spark)
    return JaccardJoin(80, 100, 5).keep_one(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more stands in benchmark windows go."""
    return decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, by its token counts, in bins of the permitted lengths."""
    lean(spark)
    return best_fit(token_counts(docs.select("doc_id", "text")).select("doc_id", "n_tokens"), "n_tokens")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Learned scores and bin packing are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
