"""A corpus pipeline over the operators of weftline.llm: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of documents. A stage
works on all that the stage before it kept. SQL cannot express the hashing and drawing of the later stages, so there
is no ORACLE_SQL: the first stage is tested against SQL, the others against brute-force versions on small fixtures.

In every stage null and empty texts are documents without words, null doc_ids are kept and come last in any choice,
repeated rows are documents of their own, ties go to the least doc_id and then the first row, texts of any length are
read whole, columns of any name pass through, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.line_dedup import drop_repeated_lines
from weftline.llm.mixing import mix_documents
from weftline.llm.near_documents import drop_near_duplicates
from weftline.llm.packing import pack_documents
from weftline.llm.quality import keep_good
from weftline.llm.scratch import Scratch, swept


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, those without words among them. Repeated rows are judged each."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines the first stays; every document stays, with the lines that are left to it, maybe none.

    Null texts stay null. Of repeated rows the first keeps its lines.
    """
    return drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard at least 0.8) the document of the least doc_id stays.

    Candidates are documents whose SimHash fingerprints differ in two bits at most, or that share a MinHash band.
    Documents without words, null texts too, are one group, and so are repeated rows.
    """
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their target weights: a document stands in the mix as often as it is taken.

    A null source is a source; documents without words are not taken.
    """
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents of the mix with their places in sequences. A document taken twice is packed twice."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-duplicate removal", near_duplicates),
    ("source mixing", mixing),
    ("best-fit packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each on the written result of the one before.

    What a stage has written for itself goes when its result is written, and so does the result of the stage before.
    """
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        with swept():
            docs = scratch.keep(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
