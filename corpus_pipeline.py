"""A corpus pipeline of five operators, each stage written as Parquet and read again by the next.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents. Columns
besides doc_id and text stay as they are, whatever their names (n_chars follows the text in pii). No rows give no
rows; null texts are rejected by the first stage. Rows that share an id are treated each on its own, but near_dedup
keeps one of them. Every stage works on all rows it is given, and deletes its intermediate tables before it returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import delete, packed, shared_path, table
from strandline.llm.decontamination import decontaminate
from strandline.llm.langid import fit, identify, rejected
from strandline.llm.neardup import keep_one
from strandline.llm.packing import pack_documents
from strandline.llm.privacy import redact


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the rows with a language; texts whose language stays unknown, or is told too narrowly, go."""
    rows, unpack = packed(docs, "text")
    named = identify(rows, fit(docs.select("text", "lang"))).where(~rejected())
    return named.select(*unpack(named))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    rows, unpack = packed(docs, "doc_id", "text")
    marked = decontaminate(rows, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated"))
    return marked.select(*unpack(marked))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is put as <KIND>; n_chars follows."""
    rows, unpack = packed(docs, "doc_id", "text")
    out = redact(rows)
    out = out.select(*unpack(out))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in as few sequences as can be."""
    return pack_documents(docs.select("doc_id", "text"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]

#: Compression, sketches, span classification and tokenizers have no SQL; tests/llm holds stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        out, path = stage(spark, docs, sf_dir), shared_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if last:
            delete(spark, last)
        last = path
    out = STAGES[-1][1](spark, docs, sf_dir)  # stored by its operator
    delete(spark, last)
    return out
