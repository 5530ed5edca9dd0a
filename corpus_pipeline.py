"""The corpus pipeline: documents in, a training mix out. Each stage calls one of the training-data operators; its result
is written as Parquet and read again as the next stage's documents.

All stages: texts are read whole, however long. Rows that repeat are rows like any others, but for near dedup. Columns
besides those named below may hold nulls and may have names that the operators use themselves: they travel under names of
their own and come out as they came in. An empty table gives an empty table. A rerun gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontam, langid, line_dedup, mixing, near_dedup
from granary.llm.util import stored, table

#: A language's documents are rejected under this cosine with its prototype: the text is no running text of any of them.
LEAST_SCORE = 0.10


def shielded(docs: DataFrame) -> tuple[DataFrame, list[str], str]:
    """`docs` with columns under names that no operator uses, and the text's name among them."""
    names = [f"__c{k}" for k in range(len(docs.columns))]
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)]), names, names[docs.columns.index("text")]


def restored(judged: DataFrame, names: list[str], columns: list[str], **instead) -> DataFrame:
    """The shielded columns under their own names again; `instead` gives new values for some."""
    return judged.select(*[instead.get(c, F.col(n)).alias(c) for c, n in zip(columns, names, strict=True)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which a language is found: neither `und` nor under LEAST_SCORE. Null and empty texts, and
    those without letters, are `und`. Learns from the rows with a lang that are not held out, as op5 does; of equal
    scores, the first language in code point order is taken."""
    profiles = langid.train_profiles(docs.filter(~langid.is_held_out()))
    inner, names, text = shielded(docs)
    judged = langid.identify(inner, profiles, names, text)
    return restored(judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), names, docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that stand in 10 documents or more; n_chars follows the text. Rows count as documents, whatever their
    ids; a null text comes out empty; lines of white space alone stay."""
    inner, names, text = shielded(docs)
    beside = [n for n in names if n != text]
    inner = inner.withColumnsRenamed({text: "text"}).withColumn("doc_id", F.col(names[docs.columns.index("doc_id")]))
    kept = line_dedup.dedup_lines(inner, min_docs=10, keep=beside)
    return restored(kept, names, docs.columns, text=F.col("kept"), n_chars=F.length("kept").cast("long"))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more) stays: the one with the
    smallest id, and of rows equal in id and text one. Rows without an id, and texts without words, all stay; of several
    texts under one id, those stay whose id names their group."""
    found = near_dedup.near_duplicates(docs, words=5, percent=80).filter("kept")
    found = found.groupBy(F.col("doc_id").alias("__k_id"), F.col("th").alias("__k_th")).agg(F.count("*").alias("__k_n"))
    found = stored(found)
    on = [F.col("doc_id").eqNullSafe(F.col("__k_id")), F.xxhash64("text") == F.col("__k_th")]
    single = (F.col("__k_n") == 1) | F.col("__k_id").isNull()
    once = docs.join(found.filter(single), on, "left_semi")
    again = docs.withColumn("__k_text", F.xxhash64("text")).join(found.filter(~single), on).dropDuplicates(["doc_id", "__k_text"]).select(*docs.columns)
    return once.unionByName(again)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no item of the benchmark: less than half of the tokens of each, in any order. A row is
    judged by its text alone; null and empty texts stay."""
    inner, names, text = shielded(docs)
    judged = decontam.contamination(inner, table(spark, sf_dir, "benchmark"), keep=names, text=text)
    return restored(judged.filter(~F.col("contaminated")), names, docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes: doc_id, size, source_size, target, taken. A null source is a source;
    ties go by doc_id, then size; a null text has size 0."""
    return mixing.mix_sources(docs, table(spark, sf_dir, "labels"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: Language ID, the confirmation of near duplicates after line dedup and string tiling have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, with each stage's result but the last one's written and read back: the mix."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
