"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.llm import ann, chat_format, collocations, conversation_repair, decontam, html_extract, langid, line_dedup, mixing, near_dedup, pii, simhash, substring_dedup
from granary.llm.util import table


def op1_line_dedup(spark, sf_dir):
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op2_chat_format(spark, sf_dir):
    return chat_format.digests(chat_format.format_conversations(chat_format.with_hard_case(table(spark, sf_dir, "conversations"))))


def op3_ann_search(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))


def op4_source_mixing(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_id(spark, sf_dir):
    return langid.langid(table(spark, sf_dir, "documents"))


def op6_personal_data(spark, sf_dir):
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return found.withColumn("base_sha256", F.sha2("base", 256)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def personal_data_counts(spark, sf_dir):
    """The numbers of base spans, for which there is SQL."""
    return pii.personal_data(table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def op7_html_text(spark, sf_dir):
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op8_substring_dedup(spark, sf_dir):
    return substring_dedup.dedup_spans(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85).drop("th")


def op10_decontamination(spark, sf_dir):
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark, sf_dir):
    return conversation_repair.damaged_and_repaired(table(spark, sf_dir, "conversations"))


def op12_simhash_dedup(spark, sf_dir):
    return simhash.simhash_components(table(spark, sf_dir, "documents"), words=3, distance=2)


def op13_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries():
    own = {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit() and callable(f)}
    return own | {"personal_data_counts": personal_data_counts}


def oracle_sql():
    return {"op1_line_dedup": line_dedup.ORACLE, "op2_chat_format": chat_format.ORACLE, "op4_source_mixing": mixing.ORACLE, "op9_near_dedup": near_dedup.ORACLE, "op11_conversation_repair": conversation_repair.ORACLE, "op12_simhash_dedup": simhash.ORACLE, "op13_collocations": collocations.ORACLE, "personal_data_counts": pii.COUNTS_ORACLE}
