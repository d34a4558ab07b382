"""A corpus pipeline: quality, near duplicates, decontamination, personal data, packing.

Each stage's output is written as Parquet to the shared folder and read as the next one's documents.
``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir).  All but the last return the
columns of documents.

Rows without a doc_id pass every stage; nothing can be linked to them.  Rows with one id and one text are
one document, of which one stays.  A null or empty text is judged by its quality score like any other, is in no class,
holds no benchmark text and no personal data, and has no piece in the packing.  Texts of any length are read whole; an
empty table passes through; further columns are handed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.decontam import RESULTS, contaminated, find_contamination
from panelforge.llm.jaccard import near_duplicate_classes
from panelforge.llm.packing import pack, token_count
from panelforge.llm.pii import redact
from panelforge.llm.quality import fit_quality, learning_labels, score_quality
from panelforge.llm.stored import Scratch
from panelforge.llm.tables import table, unused


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = fit_quality(docs, learning_labels(table(spark, sf_dir, "labels"), "quality"))
    score = unused(docs, "__score")
    return score_quality(docs, model, out=score).where(F.col(score) >= 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: five-word shingles, a similarity of 0.8 or more."""
    classes = near_duplicate_classes(docs.select("doc_id", "text"), k=5, percent=80)
    extra = classes.where("doc_id <> component_id").select("doc_id")
    kept = docs.join(extra, "doc_id", "left_anti")
    hashed = unused(docs, "__text")
    named = kept.where("doc_id is not null").withColumn(hashed, F.xxhash64("text")).dropDuplicates(["doc_id", hashed])
    return named.select(*docs.columns).unionByName(kept.where("doc_id is null").select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    aside = {c: unused(docs, f"{c}_kept") for c in docs.columns if c.lower() in RESULTS}
    renamed = docs.withColumnsRenamed(aside)
    found = find_contamination(renamed, table(spark, sf_dir, "benchmark"), carry=renamed.columns)
    _, bad = contaminated(F.col("__spans"), F.col("__n_words"))
    return found.where(~bad).select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    masked = redact(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return pack(docs.select("doc_id", token_count(F.col("text")).alias("n_tokens")))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: A trained classifier's decisions can't be given in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
